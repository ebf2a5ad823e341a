"""Links of accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import infer_provider

# Provider, label, URL with the name's place, order.
DERIVED = (("instagram", "Instagram", "https://www.instagram.com/%s/", 10), ("imginn", "Imginn", "https://imginn.com/%s/", 20), ("pixnoy", "Pixnoy", "https://www.pixnoy.com/profile/%s/", 30))


def derive_links(accounts: DataFrame, links: DataFrame) -> DataFrame:
    """The standard links of every account that it doesn't have yet."""
    kinds = F.array(*(F.struct(F.lit(p).alias("provider"), F.lit("primary" if k == 0 else "derived").alias("kind"), F.lit(label).alias("label"), F.lit(url).alias("form"), F.lit(order).alias("sort_order")) for k, (p, label, url, order) in enumerate(DERIVED)))
    rows = accounts.select(F.col("id").alias("account_id"), "name", F.explode(kinds).alias("k"))
    rows = rows.select("account_id", "k.provider", "k.kind", F.replace("k.form", F.lit("%s"), F.col("name")).alias("url"), "k.label", "k.sort_order")
    return rows.join(links.select("account_id", "url").distinct(), ["account_id", "url"], "left_anti")


def add_manual_links(new: DataFrame, links: DataFrame, hints: tuple[tuple[str, str], ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Users' URLs that their account doesn't have: provider inferred, label by provider.

    Of a URL that an account is given more than once, the first by ``order`` stays, as when they are
    inserted one by one; rows that this leaves open go by provider and label.
    """
    rows = new.withColumns({"url": F.trim("url"), "provider": F.coalesce("provider", infer_provider(F.trim("url"), hints))})
    kept = F.struct("provider", F.coalesce("label", F.initcap("provider")).alias("label"))
    rows = rows.groupBy("account_id", "url").agg(F.min_by(kept, F.struct(*order, kept.alias("__kept"))).alias("k")).select("account_id", "url", "k.provider", "k.label", F.lit("manual").alias("kind"))
    return rows.join(links.select("account_id", "url").distinct(), ["account_id", "url"], "left_anti")


def link_health(links: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Last good and last bad time of each link from ``outcomes(account_id, provider, ok, ts)``."""
    at = lambda ok: F.max(F.when(F.col("ok") == ok, F.col("ts")))
    sums = outcomes.groupBy("account_id", "provider").agg(at(True).alias("last_ok_at"), at(False).alias("last_error_at"))
    return links.join(sums, ["account_id", "provider"], "left").select("id", "account_id", "provider", "last_ok_at", "last_error_at")
