"""Integrity rules of the catalogue as counts of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What each enumerated column may hold.
ENUMS: dict[str, dict[str, tuple[str, ...]]] = {
    "accounts": {"status": ("active", "legacy", "flagged"), "platform_state": ("unknown", "ok", "private", "unavailable", "banned")},
    "links": {"provider": ("instagram", "imginn", "pixnoy", "picuki", "dumpor", "sotwe", "twitter", "custom"), "kind": ("primary", "derived", "manual")},
    "media": {"media_type": ("image", "video", "other")},
    "remote": {"media_type": ("image", "video", "other"), "state": ("pending", "downloaded", "duplicate", "failed", "gone", "skipped")},
    "jobs": {
        "job_type": ("sync", "discover", "backfill", "verify", "probe"),
        "status": ("queued", "claimed", "running", "succeeded", "failed", "cancelled", "deferred"),
        "trigger": ("manual", "schedule", "batch", "retry", "bootstrap"),
    },
    "events": {"level": ("debug", "info", "warn", "error", "critical"), "source": ("backend", "scraper", "scheduler", "scanner", "web")},
    "workers": {"status": ("starting", "idle", "working", "paused", "backoff", "stopping", "error")},
}

#: Other conditions that no row may meet.
FORBIDDEN = {"media": {"bytes": "bytes < 0"}, "jobs": {"lease": "status IN ('claimed', 'running') AND lease_expires_at IS NULL"}}

#: Expressions that together occur once, among the rows of a condition.
UNIQUE = {
    "accounts": {"name": (("lower(name)",), "true")},
    "links": {"url": (("account_id", "url"), "true")},
    "media": {"path": (("account_id", "rel_path"), "true"), "live_hash": (("account_id", "content_hash"), "deleted_at IS NULL AND content_hash IS NOT NULL")},
    "remote": {"key": (("account_id", "provider", "remote_id"), "true")},
    "jobs": {"live": (("account_id", "job_type"), "status IN ('queued', 'claimed', 'running') AND account_id IS NOT NULL")},
}

#: Columns that name a row of another table.
REFERENCES = (
    ("links", "account_id", "accounts"), ("media", "account_id", "accounts"), ("remote", "account_id", "accounts"), ("jobs", "account_id", "accounts"), ("events", "account_id", "accounts"),
    ("media", "duplicate_of", "media"), ("remote", "media_file_id", "media"), ("events", "job_id", "jobs"), ("workers", "current_job_id", "jobs"),
)


def integrity_audit(tables: dict[str, DataFrame], parts: dict[str, int] | None = None) -> DataFrame:
    """(rule, violations) for the tables given, by the names above: one pass of conditional counts a
    table, one grouping a key and one a reference.

    Rules of columns that a table lacks are left out. Nulls break no enumeration and no reference.
    References are counted by their value before they meet the other table, so a value that most rows
    share is one row there. Flags are booleans and can't be wrong.

    ``parts`` names tables whose keys hardly repeat: their rows are dealt by the keys into so many partitions
    and counted there, as counting them before the exchange would hold a split's keys and save nothing.
    """
    out, parts = [], parts or {}
    for name, rows in tables.items():
        has = set(rows.columns)
        counts = [F.count_if(~F.col(c).isin(*allowed)).alias(f"{name}.{c}") for c, allowed in ENUMS.get(name, {}).items() if c in has]
        counts += [F.count_if(F.expr(condition)).alias(f"{name}.{rule}") for rule, condition in FORBIDDEN.get(name, {}).items()]
        if counts:
            found = rows.agg(*counts)
            out.append(found.select(F.inline(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("violations")) for c in found.columns)))))
        for rule, (keys, among) in UNIQUE.get(name, {}).items():
            by = [F.expr(k) for k in keys if k in has or not k.isidentifier()]
            chosen = rows.filter(among)
            groups = (chosen.repartition(parts[name], *by) if name in parts else chosen).groupBy(*by).agg(F.count("*").alias("n"))
            out.append(groups.agg(F.lit(f"{name}.{rule}_unique").alias("rule"), F.count_if(F.col("n") > 1).alias("violations")))
    for child, column, parent in REFERENCES:
        if child in tables and parent in tables and column in tables[child].columns:
            named = tables[child].filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n"))
            lost = named.join(tables[parent].select("id"), "id", "left_anti")
            out.append(lost.agg(F.lit(f"{child}.{column}_orphan").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations")))
    return reduce(DataFrame.unionByName, out)
