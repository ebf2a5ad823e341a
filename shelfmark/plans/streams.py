"""Streaming queries over the test tables, run to their end, with the SQL of their batch twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import tables, with_tables
from ..functions.hashing import hash_files
from ..sources.listing import TABLES, land_files, load_table, read_table, save_table, shared_folder, write_table
from ..sources.listing import list_files as lister
from ..streaming import streams as S
from .catalog import COALESCED, PRINT


#: Batches that a stream's rows land in, least files of each, and rows that a batch lands in one file.
BATCHES, FILES, FILE_ROWS = 6, 2, 250_000


#: Groups that stand-in tables are dealt in ranges of where they are stored: account and remote id of the index, as in TABLES.
RANGES = {"remote_index": (0, 2)}

#: A text column of each data table.
TABLE_TEXT = {"accounts": "name", "links": "url", "media_files": "rel_path", "remote_index": "remote_url", "scrape_jobs": "error_summary", "event_log": "message", "heartbeats": "version"}


def _landed(spark: SparkSession, rows: DataFrame, label: str, order: str | None = "ts", late_days: int = 0, watermark: str = S.WATERMARK) -> DataFrame:
    """Land rows as files, BATCHES slices one after the other, and read them as a stream with event time.

    Slices go by the time in ``order``, or by hash (None), as rows do that come in no order. With
    ``late_days``, each row comes up to so many days late, by hash.
    """
    folder = shared_folder(spark, label)
    if order:
        seconds = F.unix_micros(F.col(order).cast("timestamp"))
        seconds = seconds + F.pmod(F.xxhash64(*rows.columns), F.lit(late_days * 86_400_000_000 + 1))
        first, last = rows.agg(F.min(seconds), F.max(seconds)).first()
        slice_ = F.least(F.floor((seconds - F.lit(first or 0)) * BATCHES / F.lit(max((last or 0) - (first or 0), 1))), F.lit(BATCHES - 1))
    else:
        slice_ = F.pmod(F.xxhash64(*rows.columns), F.lit(BATCHES))
    slice_ = F.coalesce(slice_, F.lit(0))
    counts = [r["count"] for r in rows.groupBy(slice_.alias("slice")).count().collect()]
    # a batch takes whole slices: every slice lands in as many files, and none of them may stay empty
    files = max(FILES, min(-(-max(counts, default=0) // FILE_ROWS), min(counts, default=0) // 100))
    for k in range(BATCHES):
        rows.filter(slice_ == k).repartition(files, F.rand(k)).write.mode("append").parquet(folder)
    return S.event_stream(spark, folder, rows.schema, files, watermark)


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    """The latest version of each key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("batch", *(c for c in ("occurrences", "closed") if c in others))).alias("v")).select(*keys, "v.*")


def tables_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    (files,) = tables(spark, sf_dir, "media_files")
    path = shared_folder(spark, "media_files")
    write_table(files, path, "account_id", "rel_path")
    return read_table(spark, path, files.schema).select("id", "account_id", "rel_path", "bytes")


def all_tables_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and checksums of every data table, written and read back."""
    folder = shared_folder(spark, "catalogue")
    out = []
    for name, rows in zip(TABLES, tables(spark, sf_dir, *TABLES, ranges=RANGES)):
        save_table(rows, name, folder, ranged=name in RANGES)
        found = load_table(spark, name, folder)
        key = F.col("account_id" if "account_id" in found.columns else "id" if "id" in found.columns else "worker_id")
        text = F.col(TABLE_TEXT[name])
        out.append(found.agg(F.lit(name).alias("name"), F.count("*").alias("row_count"), F.count_distinct(key).alias("keys"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("text_length")))
    return reduce(DataFrame.unionByName, out)


def _archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Contents landed as files below a folder an account, and that folder."""
    (files,) = tables(spark, sf_dir, "media_files")
    root = shared_folder(spark, "archive").removeprefix("file:")
    land_files(files.select(F.col("account_id").cast("string").alias("account"), "rel_path", "content"), root)
    return files.select(F.col("account_id").cast("string").alias("account")).distinct(), root


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lister finds of landed files."""
    found = lister(*_archive(spark, sf_dir)).filter("error IS NULL")
    return found.select(F.col("account").cast("long").alias("account_id"), "rel_path", "bytes")


def hash_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of landed files as listed, read in tasks of about equal bytes."""
    accounts, root = _archive(spark, sf_dir)
    found = lister(accounts, root).filter("error IS NULL").select(F.concat(F.lit(f"{root}/"), "account", F.lit("/"), "rel_path").alias("path"), "bytes")
    place = F.split(F.substring("path", len(root) + 2, 1_000_000), "/", 2)
    return hash_files(found, tasks=16).select(place[0].cast("long").alias("account_id"), place[1].alias("rel_path"), "content_hash")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    (log,) = tables(spark, sf_dir, "event_log")
    stream = _landed(spark, log.select("id", "ts", "level", "account_id"), "events")
    out = S.run_to_table(stream, shared_folder(spark, "stream"), "append")
    return out.select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "level", "account_id")


def _coalesced(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    (log,) = tables(spark, sf_dir, "event_log")
    columns = ("id", "ts", "level", "account_id", "event", "error_type", "message", "detail", "job_id", "source", "traceback", "retryable", "resolved_at")
    out = S.run_to_table(S.stream_coalesce(_landed(spark, log.select(*columns), "events"), minutes), shared_folder(spark, "coalesced"))
    back = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return S.standing(out).select("fingerprint", "level", "id", "occurrences", back("first_us").alias("first_seen_at"), back("last_us").alias("ts"), "message", "detail", "job_id", "source", "error_type", "traceback", "retryable")


def coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coalesced(spark, sf_dir, 24 * 60).drop("traceback", "retryable")


def coalesce_half_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coalesced(spark, sf_dir, 30)


def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    (beats,) = tables(spark, sf_dir, "heartbeats")
    stream = _landed(spark, beats.withColumnRenamed("beat_at", "ts"), "beats")
    out = S.run_to_table(S.stream_liveness(stream), shared_folder(spark, "liveness"))
    return _last(out, "worker_id").select("worker_id", "status", F.col("beat_at").cast("timestamp_ntz").alias("beat_at"), "online")


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    (files,) = tables(spark, sf_dir, "media_files")
    changes = files.select("account_id", "media_type", "bytes", F.lit(1).alias("sign"), F.col("first_seen_at").alias("ts"))
    gone = files.filter("deleted_at IS NOT NULL").select("account_id", "media_type", "bytes", F.lit(-1).alias("sign"), F.col("first_seen_at").alias("ts"))
    out = S.run_to_table(S.stream_counters(_landed(spark, changes.unionByName(gone), "changes", None)), shared_folder(spark, "counters"))
    return _last(out, "account_id").select("account_id", "image_count", "video_count", "other_count", "total_bytes")


def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that come up to thirty days late, over a watermark of forty."""
    (jobs,) = tables(spark, sf_dir, "scrape_jobs")
    stream = _landed(spark, jobs.select("account_id", "status", F.col("finished_at").alias("ts")), "jobs", late_days=30, watermark="40 days")
    out = S.run_to_table(S.stream_job_outcomes(stream), shared_folder(spark, "outcomes"))
    return _last(out, "account_id").select("account_id", F.timestamp_micros("last_success_us").cast("timestamp_ntz").alias("last_success_at"), F.timestamp_micros("last_error_us").cast("timestamp_ntz").alias("last_error_at"), "consecutive_failures")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed keys in the order of their times, years in all, against a stored index and what was admitted before."""
    listing, index = tables(spark, sf_dir, "listing", "remote_index", plain=("listing",))
    rows = listing.select("account_id", "provider", "remote_id", F.col("posted_at").alias("ts"))
    known = shared_folder(spark, "known")
    write_table(index.filter("remote_bytes > 25000").select("account_id", "provider", "remote_id"), known, "account_id", "remote_id")
    known = read_table(spark, known)
    out = S.stream_first_seen(_landed(spark, rows, "listing"), known, shared_folder(spark, "seen"))
    return known.limit(0) if out is None else out.select("account_id", "provider", "remote_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "S1_list_files": list_files,
    "S2_hash_files": hash_listed,
    "S3_tables_io": tables_io,
    "S3_all_tables_io": all_tables_io,
    "S5_event_stream": event_stream,
    "T1_stream_coalesce": coalesce,
    "T1_stream_coalesce_half_hour": coalesce_half_hour,
    "T2_stream_liveness": liveness,
    "T3_stream_counters": counters,
    "T4_stream_job_outcomes": job_outcomes,
    "T5_stream_first_seen": first_seen,
}

ORACLES: dict[str, str] = {
    "S3_tables_io": with_tables("SELECT id, account_id, rel_path, bytes FROM media_files", "media_files"),
    "S1_list_files": with_tables("SELECT account_id, rel_path, strlen(coalesce(content, ''))::BIGINT AS bytes FROM media_files", "media_files"),
    "S2_hash_files": with_tables("SELECT account_id, rel_path, sha256(coalesce(content, '')) AS content_hash FROM media_files", "media_files"),
    "S3_all_tables_io": with_tables(
        " UNION ALL ".join(
            f"SELECT '{t}' AS name, count(*) AS row_count, count(DISTINCT {'id' if t == 'accounts' else 'worker_id' if t == 'heartbeats' else 'account_id'}) AS keys, coalesce(sum(length({c})), 0)::BIGINT AS text_length FROM {t}" for t, c in TABLE_TEXT.items()
        ),
        *TABLE_TEXT,
    ),
    "S5_event_stream": with_tables("SELECT id, ts, level, account_id FROM event_log", "event_log"),
    "T1_stream_coalesce": with_tables(
        f"SELECT fingerprint, level, id, occurrences, first_seen_at, ts, message, detail, job_id, source, error_type FROM ({COALESCED.format(minutes=24 * 60, print=PRINT)})",
        "event_log",
    ),
    "T1_stream_coalesce_half_hour": with_tables(
        f"SELECT fingerprint, level, id, occurrences, first_seen_at, ts, message, detail, job_id, source, error_type, traceback, retryable FROM ({COALESCED.format(minutes=30, print=PRINT)})",
        "event_log",
    ),
    "T2_stream_liveness": with_tables("SELECT worker_id, arg_max(status, (beat_at, status)) AS status, max(beat_at) AS beat_at, max(beat_at) + INTERVAL 90 SECOND >= (SELECT max(beat_at) FROM heartbeats) - INTERVAL 10 MINUTE AS online FROM heartbeats GROUP BY 1", "heartbeats"),
    "T3_stream_counters": with_tables(
        """SELECT account_id, count(*) FILTER (t = 'image') AS image_count, count(*) FILTER (t = 'video') AS video_count, count(*) FILTER (t = 'other') AS other_count, coalesce(sum(b), 0)::BIGINT AS total_bytes
    FROM (SELECT account_id, CASE WHEN deleted_at IS NULL THEN media_type END AS t, CASE WHEN deleted_at IS NULL THEN bytes END AS b FROM media_files) GROUP BY 1""",
        "media_files",
    ),
    "T4_stream_job_outcomes": with_tables(
        """SELECT account_id, any_value(ok) AS last_success_at, max(finished_at) FILTER (status = 'failed') AS last_error_at, count(*) FILTER (status = 'failed' AND (ok IS NULL OR finished_at > ok)) AS consecutive_failures
    FROM (SELECT *, max(finished_at) FILTER (status = 'succeeded') OVER (PARTITION BY account_id) AS ok FROM scrape_jobs WHERE status IN ('succeeded', 'failed')) GROUP BY 1""",
        "scrape_jobs",
    ),
    "T5_stream_first_seen": with_tables("SELECT DISTINCT account_id, provider, remote_id FROM listing l WHERE NOT EXISTS (SELECT 1 FROM remote_index r WHERE r.remote_bytes > 25000 AND r.account_id = l.account_id AND r.provider = l.provider AND r.remote_id = l.remote_id)", "listing", "remote_index"),
}
