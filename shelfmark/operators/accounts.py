"""Accounts: dashboard, cards, search, ranking and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pacing import estimated_missing
from . import events as E
from . import jobs as J
from . import media as M


def pending_counts(accounts: DataFrame, index: DataFrame, links: DataFrame, log: DataFrame) -> DataFrame:
    """Pending remote rows, enabled links and open errors of every account."""
    count = lambda rows, name: rows.groupBy("account_id").agg(F.count("*").alias(name))
    out = accounts.select(F.col("id").alias("account_id"))
    for rows, name in ((index.filter("state = 'pending'"), "pending_remote_count"), (links.filter("is_enabled"), "link_count"), (log.filter("resolved_at IS NULL AND level IN ('error', 'critical')"), "unresolved_error_count")):
        out = out.join(count(rows, name), "account_id", "left")
    return out.fillna(0)


def dashboard(accounts: DataFrame, files: DataFrame, index: DataFrame, jobs: DataFrame, log: DataFrame, links: DataFrame) -> DataFrame:
    """One row an account. Every child is read once and brought to one row an account, then joined."""
    out = accounts.withColumnRenamed("id", "account_id")
    pending = index.filter("state = 'pending'").groupBy("account_id").agg(F.count("*").alias("pending_remote_count"))
    enabled = links.filter("is_enabled").groupBy("account_id").agg(F.count("*").alias("link_count"))
    for child in (M.account_counters(files, M.cover()), J.active_job(jobs), E.last_open_error(log), pending, enabled):
        out = out.join(child, "account_id", "left")
    out = out.fillna(0, ["image_count", "video_count", "other_count", "total_bytes", "unresolved_error_count", "pending_remote_count", "link_count"])
    return out.withColumns(
        {
            "media_count": F.col("image_count") + F.col("video_count") + F.col("other_count"),
            "estimated_missing_count": estimated_missing(F.col("expected_image_count"), F.col("image_count")) + estimated_missing(F.col("expected_video_count"), F.col("video_count")),
            "is_new": F.col("last_success_at").isNull(),
        }
    )


def sorts() -> dict[str, list[Column]]:
    """Named orders of the dashboard, favourites first, ties by id."""
    named = {
        "name": [F.lower("name")],
        "recent": [F.coalesce("last_download_at", "last_import_at").desc()],
        "added": [F.desc("account_id")],
        "media": [F.desc("media_count")],
        "size": [F.desc("total_bytes")],
        "errors": [F.desc("unresolved_error_count"), F.desc("last_error_ts")],
        "backlog": [F.desc("estimated_missing_count"), F.desc("pending_remote_count")],
    }
    return {k: [F.desc("is_favorite"), *v, F.asc("account_id")] for k, v in named.items()}


def search(board: DataFrame, term: str | None = None, favorite: bool | None = None, status: str | None = None, scrape_enabled: bool | None = None, has_errors: bool | None = None, sort: str = "name", limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of the dashboard, with the number of all matching rows. % and _ in the term are wildcards."""
    rows = board
    if term:
        pattern = "%" + term.strip().replace("\\", "\\\\") + "%"
        rows = rows.filter(F.col("name").ilike(pattern) | F.coalesce("display_name", F.lit("")).ilike(pattern))
    for column, value in (("is_favorite", favorite), ("status", status), ("scrape_enabled", scrape_enabled)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    if has_errors is not None:
        rows = rows.filter(F.col("unresolved_error_count") > 0 if has_errors else F.col("unresolved_error_count") == 0)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*sorts()[sort]).offset(offset).limit(limit).crossJoin(total)


def cards(board: DataFrame) -> DataFrame:
    """Nested form: structs for the live job and the last error, null where there is none."""
    return board.select(
        "account_id", "name", "is_favorite", "scrape_enabled", "is_new",
        F.when(F.col("active_job_id").isNotNull(), F.struct(F.col("active_job_id").alias("id"), F.col("active_job_status").alias("status"))).alias("active_job"),
        F.when(F.col("last_error_id").isNotNull(), F.struct(F.col("last_error_id").alias("id"), F.col("last_error_ts").alias("ts"), F.col("last_error_event").alias("event"))).alias("last_error"),
        F.when(F.col("cover_media_id").isNotNull(), F.concat(F.lit("/api/media/"), F.col("cover_media_id").cast("string"), F.lit("/raw"))).alias("cover_url"),
    )


#: What a detail tells of a file and of a job.
MEDIA = ("id", "media_type", "rel_path", "bytes", "content_hash", "captured_at", "downloaded_at")
JOBS = ("id", "status", "priority", "scheduled_for", "finished_at", "attempts", "error_summary", "items_expected", "items_downloaded")


def detail(board: DataFrame, files: DataFrame, jobs: DataFrame, links: DataFrame) -> DataFrame:
    """Cards with links in order, recent media and recent jobs, as rows of theirs."""
    rows = F.array_sort(F.collect_list(F.struct("sort_order", "id", "url", "provider", "label", "is_enabled")))
    listed = links.groupBy("account_id").agg(rows.alias("links"))
    out = cards(board)
    for child in (listed, M.recent_media(files, fields=MEDIA), J.recent_jobs(jobs, fields=JOBS)):
        out = out.join(child, "account_id", "left")
    return out


def archive_stats(accounts: DataFrame, files: DataFrame, jobs: DataFrame, log: DataFrame, beats: DataFrame, now: Column) -> DataFrame:
    """One row over the whole archive: one conditional aggregate a table."""
    n = F.count_if
    a = accounts.agg(F.count("*").alias("account_count"), *(n(F.col("status") == s).alias(f"{s}_count") for s in ("active", "legacy", "flagged")), n("is_favorite").alias("favorite_count"), n("scrape_enabled").alias("scrape_enabled_count"))
    m = files.filter("deleted_at IS NULL").agg(n(F.col("media_type") == "image").alias("image_count"), n(F.col("media_type") == "video").alias("video_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    j = jobs.agg(n(F.col("status").isin("queued", "deferred")).alias("queued_jobs"), n(F.col("status").isin("claimed", "running")).alias("running_jobs"))
    e = log.agg(n(F.col("level").isin("error", "critical") & F.col("resolved_at").isNull()).alias("open_errors"))
    w = J.worker_liveness(beats, now).agg(n("alive").alias("live_workers"))
    return a.crossJoin(m).crossJoin(j).crossJoin(e).crossJoin(w)


def stale_accounts(accounts: DataFrame, jobs: DataFrame, now: Column, limit: int = 12, boost: int = 10) -> DataFrame:
    """Accounts that deserve a run most: enabled, not flagged, eligible, without a waiting job."""
    waiting = jobs.filter(F.col("status").isin("queued", "claimed", "running", "deferred")).select(F.col("account_id").alias("id")).distinct()
    rows = accounts.filter(F.col("scrape_enabled") & (F.col("status") != "flagged") & (F.col("next_eligible_at").isNull() | (F.col("next_eligible_at") <= now))).join(waiting, "id", "left_anti")
    rows = rows.orderBy(F.desc("is_favorite"), F.desc("priority"), F.col("last_scrape_at").isNotNull(), F.asc("last_scrape_at"), "id").limit(limit)
    return rows.select("id", "name", "last_scrape_at", (F.col("priority") + F.when(F.col("is_favorite"), boost).otherwise(0)).alias("effective_priority"), F.when(F.col("status") == "legacy", 168).when(F.col("is_favorite"), 6).otherwise(24).alias("revisit_hours"))


def auto_flag(accounts: DataFrame, threshold: int = 5) -> DataFrame:
    """Enabled accounts with too many failures in a row, as they become."""
    rows = accounts.filter(F.col("scrape_enabled") & (F.col("status") != "flagged") & (F.col("consecutive_failures") >= max(1, threshold)))
    return rows.select("id", F.lit("flagged").alias("status"), F.lit(False).alias("scrape_enabled"), "consecutive_failures")


def apply_patch(accounts: DataFrame, patch: DataFrame) -> DataFrame:
    """Patched accounts; null leaves a value alone. Enabling also clears waits and failures."""
    columns = [c for c in patch.columns if c != "id"]
    p = patch.select("id", *(F.col(c).alias(f"p_{c}") for c in columns))
    rows = accounts.join(p, "id", "left").withColumns({c: F.coalesce(f"p_{c}", c) for c in columns})
    on = F.coalesce("p_scrape_enabled", F.lit(False)) if "scrape_enabled" in columns else F.lit(False)
    rows = rows.withColumns({"next_eligible_at": F.when(~on, F.col("next_eligible_at")), "consecutive_failures": F.when(on, 0).otherwise(F.col("consecutive_failures"))})
    return rows.select(*accounts.columns)


def record_profile(accounts: DataFrame, probes: DataFrame, now: Column) -> DataFrame:
    """Expected counts, last run and the platform's state from profile probes; unavailable accounts are flagged and disabled."""
    p = probes.select("id", "state", F.col("images").alias("p_i"), F.col("videos").alias("p_v"))
    rows = accounts.join(p, "id")
    ok = F.col("state") == "ok"
    return rows.select(
        "id", F.when(ok, F.coalesce("p_i", "expected_image_count")).otherwise(F.col("expected_image_count")).alias("expected_image_count"),
        F.when(ok, F.coalesce("p_v", "expected_video_count")).otherwise(F.col("expected_video_count")).alias("expected_video_count"),
        F.when(ok, F.col("status")).otherwise("flagged").alias("status"), (ok & F.col("scrape_enabled")).alias("scrape_enabled"), F.when(ok, now).otherwise(F.col("last_scrape_at")).alias("last_scrape_at"),
        F.col("state").alias("platform_state"),
    )


def cascade_delete(gone: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each child table without the rows of deleted accounts."""
    ids = gone.select(F.col("id").alias("account_id")).distinct()
    return {name: rows.join(ids, "account_id", "left_anti") for name, rows in children.items()}


def null_dangling(rows: DataFrame, column: str, kept: DataFrame) -> DataFrame:
    """``column`` as null where it points at an id that is no longer there."""
    k = kept.select(F.col("id").alias(column)).distinct().withColumn("there", F.lit(True))
    return rows.join(k, column, "left").withColumn(column, F.when(F.col("there"), F.col(column))).drop("there").select(*rows.columns)


def link_order(links: DataFrame) -> DataFrame:
    """Enabled links of each account in the order in which they are tried."""
    return links.filter("is_enabled").select("account_id", "id", "url", F.row_number().over(Window.partitionBy("account_id").orderBy("sort_order", "id")).cast("long").alias("place"))
