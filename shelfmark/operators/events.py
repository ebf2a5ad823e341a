"""Event log: coalescing, resolution, search and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.events import FAILING, fingerprint, level_rank

#: Seconds of a slice of time, which is one task's work at most.
SLICE = 3600


def with_fingerprint(events: DataFrame) -> DataFrame:
    return events.withColumn("fingerprint", fingerprint(F.col("account_id"), F.col("event"), F.col("error_type"), F.col("message")))


def time_slice(seconds: int) -> Column:
    """Number of the slice of ``seconds`` that ``ts`` is in; rows without a time come before all others."""
    return F.coalesce(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(seconds * 1_000_000)), F.lit(-(2**62)))


def coalesce_events(events: DataFrame, minutes: int = 30, slice_seconds: int = SLICE) -> DataFrame:
    """One row for repeats of a fingerprint and level, each under ``minutes`` after the one before.

    A resolution between two repeats starts a new row: what was resolved at one time (or is still
    open) is one epoch. Occurrences, first and last time, last message, last detail and job that aren't
    null; source, error type, traceback and retryable of the first.

    Runs are found within slices of time first. Their summaries, a few a slice, are then put together
    where the gap between two is short, so a fingerprint that repeats without end is many tasks' work.
    """
    key, fields = ["fingerprint", "level", "resolved_at"], ("source", "error_type", "traceback", "retryable")
    rows = with_fingerprint(events).withColumn("slice", time_slice(slice_seconds)).withColumn("at", F.struct("ts", "id"))

    def runs(frame: DataFrame, by: list[str], order: list[str], begins: str, ends: str) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order)
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        gap = micros(F.col(begins)) - micros(F.lag(ends).over(window))
        starts = F.coalesce((gap >= minutes * 60_000_000).cast("int"), F.lit(1))
        return frame.withColumn("starts", starts).withColumn("run", F.sum("starts").over(window.rowsBetween(Window.unboundedPreceding, 0)))

    some = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    when = lambda c: F.max(F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"{c}_at")
    parts = runs(rows, [*key, "slice"], ["ts", "id"], "ts", "ts").groupBy(*key, "slice", "run").agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.max_by("message", "at").alias("message"), some("detail"), when("detail"), some("job_id"), when("job_id"),
        *(F.min_by(c, "at").alias(c) for c in fields),
    )
    parts = runs(parts.drop("run").withColumn("begins", F.col("first")["ts"]).withColumn("ends", F.col("last")["ts"]), key, ["first"], "begins", "ends")
    return parts.groupBy(*key, "run").agg(
        F.min("first")["id"].alias("id"), F.sum("n").alias("occurrences"), F.min("begins").alias("first_seen_at"), F.max("ends").alias("ts"),
        F.max_by("message", "last").alias("message"), F.max_by("detail", "detail_at").alias("detail"), F.max_by("job_id", "job_id_at").alias("job_id"),
        *(F.min_by(c, "first").alias(c) for c in fields),
    ).drop("run")


def resolve_errors(events: DataFrame, successes: DataFrame, slice_seconds: int = SLICE) -> DataFrame:
    """Open errors get the first success of their account at or after them.

    A forward as-of in two steps: within slices of time, and from the least success of each slice, carried
    backwards over the account's slices (one row each). An account is as many tasks' work as it has
    slices. Events without account never resolve and stay apart.
    """
    errors = events.filter(F.col("level").isin(*FAILING) & F.col("resolved_at").isNull() & F.col("account_id").isNotNull())
    marks = successes.filter("account_id IS NOT NULL").select("account_id", "ts", F.lit(None).cast("long").alias("id"))
    both = errors.select("account_id", "ts", "id").unionByName(marks).withColumn("slice", time_slice(slice_seconds))
    # at one instant errors come before successes
    ahead = Window.partitionBy("account_id", "slice").orderBy("ts", F.col("id").isNull()).rowsBetween(0, Window.unboundedFollowing)
    local = both.withColumn("near", F.min(F.when(F.col("id").isNull(), F.col("ts"))).over(ahead)).filter("id IS NOT NULL")
    later = Window.partitionBy("account_id").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    slices = both.groupBy("account_id", "slice").agg(F.min(F.when(F.col("id").isNull(), F.col("ts"))).alias("least"))
    carried = slices.select("account_id", "slice", F.min("least").over(later).alias("far"))
    return local.join(carried, ["account_id", "slice"]).select("account_id", "ts", "id", F.coalesce("near", "far").alias("resolved_at"))


def resolve_account(events: DataFrame, accounts: DataFrame, now: Column, event: str | None = None) -> DataFrame:
    """Events with the open errors of ``accounts(id)``, or only those of one ``event``, resolved now."""
    named = accounts.select(F.col("id").alias("account_id"), F.lit(True).alias("named")).distinct()
    hit = F.col("named") & F.col("level").isin(*FAILING) & F.col("resolved_at").isNull()
    hit = hit & (F.col("event") == event) if event else hit
    return events.join(named, "account_id", "left").withColumn("resolved_at", F.when(hit, now).otherwise(F.col("resolved_at"))).select(*events.columns)


def log_search(events: DataFrame, floor: str | None = None, account_id: int | None = None, source: str | None = None, unresolved_only: bool = False, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of events, newest first; ``floor`` is the lowest level."""
    rows = events
    if floor:
        rows = rows.filter(level_rank(F.col("level")) >= level_rank(F.lit(floor)))
    if account_id is not None:
        rows = rows.filter(F.col("account_id") == account_id)
    if source:
        rows = rows.filter(F.col("source") == source)
    if unresolved_only:
        rows = rows.filter("resolved_at IS NULL")
    return rows.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)


def prune_events(events: DataFrame, now: Column, keep_days: int = 90, keep_debug: int = 500, per_account: bool = False) -> DataFrame:
    """Drop resolved rows older than ``keep_days``, and debug rows beyond the newest ``keep_debug``.

    The limit is over all accounts, or each account's with ``per_account``.
    """
    kept = events.filter(~(F.col("resolved_at").isNotNull() & (F.col("ts") < now - F.expr(f"INTERVAL '{keep_days}' DAY"))))
    debug = kept.filter("level = 'debug'")
    if per_account:
        place = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("ts"), F.desc("id")))
        debug = debug.withColumn("place", place).filter(F.col("place") <= keep_debug).drop("place")
    else:
        debug = debug.orderBy(F.desc("ts"), F.desc("id")).limit(keep_debug)
    return kept.filter("level <> 'debug'").unionByName(debug)


def last_open_error(events: DataFrame) -> DataFrame:
    """Newest open error of each account, and how many there are."""
    rows = events.filter(F.col("level").isin(*FAILING) & F.col("resolved_at").isNull() & F.col("account_id").isNotNull())
    last = F.struct("ts", "id")
    return rows.groupBy("account_id").agg(F.max_by("id", last).alias("last_error_id"), F.max("ts").alias("last_error_ts"), F.max_by("event", last).alias("last_error_event"), F.count("*").alias("unresolved_error_count"))
