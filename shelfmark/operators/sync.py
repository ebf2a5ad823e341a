"""One run of all accounts: listings read, upserted, set against what is held, cut to budgets and guarded.

Every key of these steps begins with the account, so listing, index and held rows are dealt by account
once and all steps are groupings and windows within that deal. Accounts of more than ``GIANT`` rows go
another way, exact too: their rows are joined by whole keys, which parts an account, and only the first
items of each part meet in its work list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pacing import Pace, plan_run
from . import remote as R

#: Rows of an account's index and held files from which on it isn't one task's work.
GIANT = 5_000_000

FIELDS = ["remote_url", "media_type", "remote_hash", "remote_bytes", "posted_at", "discovered_at", "id", "state", "attempts"]


def giant_accounts(index: DataFrame, held: DataFrame, limit: int = GIANT) -> DataFrame | None:
    """(account_id) of accounts with more than ``limit`` rows in both tables, None if there are none.

    The ids come to the driver: at most the rows of both tables divided by ``limit``.
    """
    rows = index.select("account_id").unionAll(held.select("account_id"))
    found = rows.groupBy("account_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("account_id").collect()
    return index.sparkSession.createDataFrame(found, "account_id long") if found else None


def dealt(listing: DataFrame, index: DataFrame, held: DataFrame, now: Column, streak: int = R.STREAK, most: int = R.MOST) -> DataFrame:
    """The index after the listings were read and upserted, with ``open``, ``found`` and ``new``; one exchange in all.

    ``listing`` is numbered without gaps in each account (``number_listing``). A pass stops where the gap
    after a new item (or the start) reaches ``streak`` known ones: with new items at P1 < P2 < ..., at the
    least P + streak that the next new item isn't within. ``open`` tells whether an item is still to be
    fetched; ``found`` how many listed items of the key were read.
    """
    item = F.struct("position", "url", "content_hash", "size_bytes", "posted_at", "media_type")
    none = lambda t: F.lit(None).cast(t)
    item_type, row_type = listing.select(item.alias("x")).schema["x"].dataType, index.select(F.struct(*FIELDS).alias("x")).schema["x"].dataType
    rows = (
        listing.filter(F.col("position") <= most).select(*R.KEY, item.alias("item"), none(row_type).alias("row"), none("boolean").alias("dead"))
        .unionAll(index.select(*R.KEY, none(item_type), F.struct(*FIELDS), none("boolean")))
        .unionAll(held.filter("remote_id IS NOT NULL").select("account_id", F.col("source_provider"), "remote_id", none(item_type), none(row_type), "is_tombstone"))
        .repartition("account_id")
    )
    keys = rows.groupBy("account_id", "remote_id", "provider").agg(
        F.array_sort(F.collect_list("item")).alias("items"), F.max("row").alias("row"), F.max(~F.col("dead")).alias("live"), F.max("dead").alias("dead"),
    )
    keys = keys.withColumn("dead", F.max("dead").over(Window.partitionBy("account_id", "remote_id")))

    new_at = F.when(F.col("row").isNull(), F.try_element_at("items", F.lit(1))["position"])
    keys = keys.filter("row IS NOT NULL OR size(items) > 0").withColumn("new_at", new_at)
    by = Window.partitionBy("account_id")
    following = F.lead("new_at").over(by.orderBy(F.col("new_at").asc_nulls_last()))
    keys = keys.withColumn("stops", F.when(following.isNull() | (following > F.col("new_at") + streak), F.col("new_at") + streak))
    begin = F.when(F.coalesce(F.min("new_at").over(by), F.lit(most + streak + 1)) > streak, F.lit(streak))
    keys = keys.withColumn("stop", F.least(F.min("stops").over(by), begin))

    read = F.filter("items", lambda x: x["position"] <= F.col("stop"))
    last = lambda c: F.try_element_at(F.filter("read", lambda x: x[c].isNotNull()), F.lit(-1))[c]
    known = lambda c: F.col("row")[c]
    merged = keys.withColumn("read", read).filter("row IS NOT NULL OR size(read) > 0").select(
        *R.KEY,
        F.coalesce(last("url"), known("remote_url")).alias("remote_url"), F.coalesce(known("media_type"), F.try_element_at("read", F.lit(1))["media_type"]).alias("media_type"),
        F.coalesce(last("content_hash"), known("remote_hash")).alias("remote_hash"), F.coalesce(last("size_bytes"), known("remote_bytes")).alias("remote_bytes"), F.coalesce(last("posted_at"), known("posted_at")).alias("posted_at"),
        F.coalesce(known("discovered_at"), now).alias("discovered_at"), known("id").alias("id"), F.coalesce(known("state"), F.lit("pending")).alias("state"), F.coalesce(known("attempts"), F.lit(0)).alias("attempts"),
        F.size("read").cast("long").alias("found"), F.col("row").isNull().alias("new"),
        F.coalesce(F.col("live") | F.col("dead"), F.col("live"), F.col("dead"), F.lit(False)).alias("taken"),
    )
    return merged.withColumn("open", F.col("state").isin("pending", "failed") & (F.col("attempts") < R.TRIES) & ~F.col("taken")).drop("taken")


def by_keys(listing: DataFrame, index: DataFrame, held: DataFrame, now: Column, streak: int = R.STREAK, most: int = R.MOST) -> DataFrame:
    """The same for giant accounts, by joins on whole keys. Only listings, at most ``most`` rows an account, meet by account."""
    read = R.discovery_cutoff(listing, index, streak, most)
    merged = R.upsert_remote(index, read, now)
    counts = read.groupBy(*R.KEY).agg(F.count("*").alias("found"), F.max("is_new").alias("new"))
    merged = merged.join(counts, R.KEY, "left").fillna(0, ["found"]).fillna(False, ["new"])
    open_ = R.open_items(merged, held).select(*R.KEY, F.lit(True).alias("open"))
    return merged.join(open_, R.KEY, "left").fillna(False, ["open"])


@dataclass
class Run:
    """``index`` after the upsert (with open, found, new), ``work``, the items of this run, and ``plan``, a row an account."""

    index: DataFrame
    plan: DataFrame
    work: DataFrame


def sync_run(listing: DataFrame, index: DataFrame, held: DataFrame, accounts: DataFrame, now: Column, giants: DataFrame | None = None, pace: Pace = Pace(), streak: int = R.STREAK, most: int = R.MOST) -> Run:
    """Plan a run of every account in ``accounts(id, is_new, is_favorite, consecutive_failures)``.

    ``giants(account_id)`` names the accounts that aren't dealt as a whole (``giant_accounts``); the result
    is the same either way. Items of accounts that aren't given are upserted and not planned.
    """
    budgets = lambda open_count: plan_run(open_count, F.col("is_new"), F.col("is_favorite"), F.col("consecutive_failures"), pace)
    settings = accounts.select(F.col("id").alias("account_id"), "is_new", "is_favorite", "consecutive_failures")
    cap = max(1, pace.items_per_run)
    columns = ["account_id", "backlog", "place", *R.KEY[1:], *FIELDS]
    order = R.newest()

    def planned(rows: DataFrame) -> DataFrame:
        made = budgets(F.col("backlog"))
        return rows.select("*", *(made[c].alias(c) for c in ("budget", "base_delay_ms", "requeue_delay_seconds")))

    if giants is None:
        small, large = (listing, index, held), None
    else:
        part = lambda rows, how: rows.join(giants.select("account_id"), "account_id", how)
        small, large = ([part(t, how) for t in (listing, index, held)] for how in ("left_anti", "left_semi"))
    merged = dealt(*small, now, streak, most)
    window = Window.partitionBy("account_id")
    work = merged.filter("open").withColumn("backlog", F.count("*").over(window)).withColumn("place", F.row_number().over(window.orderBy(*order)).cast("long"))
    work = work.filter(F.col("place") <= cap).select(*columns)
    backlog = merged.groupBy("account_id").agg(F.count_if("open").alias("backlog"))
    if large:
        keyed = by_keys(*large, now, streak, most)
        count = keyed.groupBy("account_id").agg(F.count_if("open").alias("backlog"))
        backlog = backlog.unionByName(count)
        # the limit on places goes down before the exchange: a part of a giant sends its first items only
        first = keyed.filter("open").withColumn("place", F.row_number().over(window.orderBy(*order)).cast("long")).filter(F.col("place") <= cap)
        work = work.unionByName(first.join(count, "account_id").select(*columns))
        merged = merged.unionByName(keyed.select(*merged.columns))
    work = planned(work.join(settings, "account_id")).filter("place <= budget").drop("is_new", "is_favorite", "consecutive_failures")
    plan = planned(settings.join(backlog, "account_id", "left").fillna(0, ["backlog"])).select("account_id", "backlog", "budget", "base_delay_ms", "requeue_delay_seconds")
    return Run(merged, plan, work)
