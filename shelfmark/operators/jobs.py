"""Job and worker tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pacing import percent_complete
from .media import in_place

LIVE = ("queued", "claimed", "running")


def stuck_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Claimed or running jobs whose lease is over or missing, with the state to move them to."""
    rows = jobs.filter(F.col("status").isin("claimed", "running") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now)))
    spent = F.col("attempts") >= F.col("max_attempts")
    return rows.select("id", "account_id", F.when(spent, "failed").otherwise("queued").alias("next_status"), F.coalesce("error_summary", F.lit("lease expired")).alias("error_summary"), F.when(spent, now).alias("finished_at"))


def active_job(jobs: DataFrame) -> DataFrame:
    """One live job of each account: running, claimed, queued; then priority, then id."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "claimed", 1).otherwise(2)
    best = F.min_by(F.struct("id", "status"), F.struct(rank, -F.col("priority"), "id"))
    rows = jobs.filter(F.col("status").isin(*LIVE)).groupBy("account_id").agg(best.alias("j"))
    return rows.select("account_id", F.col("j.id").alias("active_job_id"), F.col("j.status").alias("active_job_status"))


def job_outcomes(jobs: DataFrame) -> DataFrame:
    """Last run, success and error of each account, and failures since the last success."""
    done = jobs.filter(F.col("status").isin("succeeded", "failed") & F.col("account_id").isNotNull())
    at = lambda s: F.max(F.when(F.col("status") == s, F.col("finished_at")))
    sums = done.groupBy("account_id").agg(F.max("finished_at").alias("last_scrape_at"), at("succeeded").alias("last_success_at"), at("failed").alias("last_error_at"))
    since = done.filter("status = 'failed'").join(sums.select("account_id", "last_success_at"), "account_id")
    since = since.filter("last_success_at IS NULL OR finished_at > last_success_at").groupBy("account_id").agg(F.count("*").alias("consecutive_failures"))
    return sums.join(since, "account_id", "left").fillna(0, ["consecutive_failures"])


def scrape_queue(jobs: DataFrame, accounts: DataFrame) -> DataFrame:
    a = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"), "is_favorite")
    return jobs.join(a, "account_id", "left").withColumn("percent_complete", percent_complete(F.col("items_downloaded"), F.col("items_skipped"), F.col("items_expected")))


def job_listing(jobs: DataFrame, accounts: DataFrame, status: str | None = None, account_id: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = scrape_queue(jobs, accounts)
    rows = rows if status is None else rows.filter(F.col("status") == status)
    rows = rows if account_id is None else rows.filter(F.col("account_id") == account_id)
    return rows.orderBy(F.desc("scheduled_for"), F.desc("id")).offset(offset).limit(limit)


def recent_jobs(jobs: DataFrame, n: int = 10, fields: tuple[str, ...] = ()) -> DataFrame:
    """The latest jobs of each account, as a list of ids, or of structs of ``fields``."""
    place = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("scheduled_for"), F.desc("id")))
    rows = jobs.withColumn("place", place).filter(F.col("place") <= n)
    return rows.groupBy("account_id").agg(in_place(fields).alias("recent_jobs"))


def heartbeat_upsert(beats: DataFrame) -> DataFrame:
    """Latest state of each worker; the last version that isn't null; the first beat."""
    last = F.struct("beat_at", "status")
    return beats.groupBy("worker_id").agg(F.max_by("status", last).alias("status"), F.max_by("version", F.when(F.col("version").isNotNull(), F.struct("beat_at", "version"))).alias("version"), F.min("beat_at").alias("started_at"), F.max("beat_at").alias("beat_at"))


def worker_liveness(beats: DataFrame, now: Column, seconds: int = 90) -> DataFrame:
    return heartbeat_upsert(beats).select("worker_id", "status", "beat_at", (F.col("beat_at") > now - F.expr(f"INTERVAL '{seconds}' SECOND")).alias("alive"))
