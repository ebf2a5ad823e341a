"""Files of account folders as a manifest, and tables in the catalogue's layout."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "account string, rel_path string, bytes long, mtime_ns long, error string"


#: Rows that a listing or hashing task sends at once.
SENT = 10_000


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def list_files(accounts: DataFrame, root: str) -> DataFrame:
    """Files below ``root/<account>`` for each row of ``accounts(account)``.

    Level by level: each round reads the folders that the last one found, dealt by name, and sends names
    as the file system gives them, so no folder is held. Sizes and times are read after that, file by
    file, dealt anew: the files of one large folder are many tasks' work.
    Folders that begin with a dot are skipped at the top level. What can't be read comes as a row
    with an error instead of failing the job. Names that begin with _ are kept.
    """
    spark, found = accounts.sparkSession, "account string, path string, folder boolean, error string"

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for account, folder in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with os.scandir(os.path.join(root, account, folder)) as entries:
                        for entry in entries:
                            inner = entry.is_dir(follow_symlinks=False)
                            if inner and not folder and entry.name.startswith("."):
                                continue
                            rows.append((account, f"{folder}/{entry.name}" if folder else entry.name, inner, None))
                            if len(rows) >= SENT:
                                yield _arrow(rows, found)
                                rows = []
                except OSError as e:
                    rows.append((account, folder or ".", False, str(e)))
        if rows:
            yield _arrow(rows, found)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for account, path, error in zip(*(c.to_pylist() for c in batch.columns)):
                size = mtime = None
                if error is None:
                    try:
                        stat = os.stat(os.path.join(root, account, path))
                        size, mtime = stat.st_size, stat.st_mtime_ns
                    except OSError as e:
                        error = str(e)
                rows.append((account, path, size, mtime, error))
            if rows:
                yield _arrow(rows, MANIFEST)

    level, files = accounts.select("account", F.lit("").alias("folder")).distinct(), None
    while level is not None:
        path = shared_folder(spark, "level")
        level.repartition("account", "folder").mapInArrow(names, found).write.parquet(path)
        read = spark.read.schema(found).parquet(path)
        files = read.filter("NOT folder") if files is None else files.unionByName(read.filter("NOT folder"))
        inner = read.filter("folder").select("account", F.col("path").alias("folder"))
        level = None if inner.isEmpty() else inner
    return files.select("account", "path", "error").repartition("account", "path").mapInArrow(stats, MANIFEST)


def land_files(rows: DataFrame, root: str) -> None:
    """Write ``rows(account, rel_path, content)`` as files below ``root/<account>``, null content as an empty one."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for account, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                full = os.path.join(root, account, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                aside = f"{full}.{uuid.uuid4().hex}.part"
                with open(aside, "wb") as out:
                    out.write((content or "").encode())
                os.replace(aside, full)
            yield pa.RecordBatch.from_pydict({"written": pa.array([batch.num_rows], pa.int64())})

    rows.select("account", "rel_path", "content").mapInArrow(write, "written long").agg(F.sum("written")).collect()


# Layout of the data tables, as columns and types, and the order that they are written in: by
# account where there is one, then by a column that parts the rows of a large account.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "accounts": (
        "id long, name string, display_name string, status string, platform_state string, is_favorite boolean, scrape_enabled boolean, priority int, expected_image_count long, expected_video_count long,"
        " consecutive_failures long, next_eligible_at timestamp_ntz, last_scrape_at timestamp_ntz, last_success_at timestamp_ntz",
        ("id",),
    ),
    "links": ("id long, account_id long, url string, provider string, label string, is_enabled boolean, sort_order long", ("account_id", "id")),
    "media_files": (
        "id long, account_id long, content string, bytes long, media_type string, rel_path string, mtime_ns long, content_hash string, duplicate_of long, remote_id string, source_provider string, remote_url string,"
        " captured_at timestamp_ntz, first_seen_at timestamp_ntz, downloaded_at timestamp_ntz, imported_at timestamp_ntz, is_missing boolean, deleted_at timestamp_ntz",
        ("account_id", "rel_path"),
    ),
    "remote_index": ("account_id long, provider string, remote_id string, remote_url string, media_type string, remote_hash string, remote_bytes long, posted_at timestamp_ntz, discovered_at timestamp_ntz, id long, state string, attempts int", ("account_id", "remote_id")),
    "scrape_jobs": (
        "id long, account_id long, status string, job_type string, priority int, scheduled_for timestamp_ntz, finished_at timestamp_ntz, lease_expires_at timestamp_ntz, attempts int, max_attempts int,"
        " error_summary string, items_expected long, items_downloaded long, items_skipped long, items_failed long",
        ("account_id", "id"),
    ),
    "event_log": (
        "id long, ts timestamp_ntz, level string, source string, account_id long, job_id long, event string, message string, detail string, error_type string, retryable boolean,"
        " traceback string, resolved_at timestamp_ntz",
        ("account_id", "ts", "id"),
    ),
    "heartbeats": ("worker_id string, status string, version string, beat_at timestamp_ntz", ("worker_id", "beat_at")),
}


def write_table(rows: DataFrame, path: str, *by: str, ranged: bool = False) -> None:
    """Write a catalogue table in ranges of ``by``, sorted in each file, so that readers skip files and row groups.

    Ranges go by all columns of ``by``, so the rows of one large account are parted too. Rows that come
    in such ranges (``ranged``) are not dealt again: sampling them for bounds would compute them twice.
    """
    dealt = rows if ranged or not by else rows.repartitionByRange(*by)
    (dealt.sortWithinPartitions(*by) if by else dealt).write.mode("overwrite").parquet(path)


def save_table(rows: DataFrame, name: str, folder: str, ranged: bool = False) -> None:
    """Write one of TABLES below ``folder`` with its own columns and types."""
    schema, by = TABLES[name]
    columns = [c.split() for c in schema.split(", ")]
    write_table(rows.select(*(F.col(c).cast(t).alias(c) for c, t in columns)), f"{folder}/{name}", *by, ranged=ranged)


def load_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """Read one of TABLES below ``folder``; its schema is declared, not inferred."""
    return read_table(spark, f"{folder}/{name}", TABLES[name][0])


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; a local session without it gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shelfmark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/shelfmark/{label}-{uuid.uuid4().hex}"
