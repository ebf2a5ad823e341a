"""Queries whose results are merged into stored tables and read back, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as fn
from ..functions.hashing import content_hash
from ..operators import accounts as A
from ..operators import media as M
from ..operators import remote as R
from ..sources import store
from ..sources.fixtures import account_parts, tables, with_tables
from ..sources.listing import shared_folder
from .catalog import JOBS_NOW, MERGED, at

#: Buckets of the tables stored here; larger tables take more, so that one is about a file.
BUCKETS = 8
MEDIA_KEYS, MEDIA = ("account_id", "rel_path"), ["id", "account_id", "rel_path", "bytes", "mtime_ns", "media_type", "content_hash", "duplicate_of_path", "is_missing", "deleted_at", "first_seen_at"]


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings upserted into a stored index; the second merge of the same rows changes nothing."""
    parts = account_parts(spark, sf_dir)
    index, listing = tables(spark, sf_dir, "remote_index", "listing", parts=parts)
    index = index.filter("remote_bytes > 25000").select(*R.KEY, "remote_url", "media_type", "remote_hash", "remote_bytes", "posted_at", "discovered_at", "id", "state", "attempts")
    folder = shared_folder(spark, "remote-store")
    store.create(index, folder, tuple(R.KEY), BUCKETS, dealt=parts)
    for _ in range(2):
        table = store.upsert(spark, folder, R.listed(listing), R.upserted(at(JOBS_NOW)), parts)
        store.vacuum(spark, folder)
    return store.read(spark, table)


def stored_media(spark: SparkSession, files: DataFrame, label: str) -> store.Table:
    return store.create(files.withColumn("duplicate_of_path", F.lit(None).cast("string")).select(*MEDIA), shared_folder(spark, label), MEDIA_KEYS, BUCKETS)


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of every account: reconcile, hash what is new or changed, find holders, write back."""
    manifest, files = tables(spark, sf_dir, "manifest", "media_files")
    manifest = manifest.withColumn("media_type", fn.classify_media(F.col("rel_path")))
    table = stored_media(spark, files, "media-store")
    index = store.read(spark, table)
    need = M.scan_reconcile(manifest, index).filter("action IN ('new', 'changed')").select(*MEDIA_KEYS)
    hashes = manifest.join(need, list(MEDIA_KEYS)).select(*MEDIA_KEYS, content_hash(F.col("content")).alias("content_hash"))
    return store.read(spark, store.merge(spark, table.folder, M.scan(manifest, index, hashes, at(JOBS_NOW))))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched and adopted files indexed into a stored table: inserts, and what known paths lacked of their origin."""
    files, manifest = tables(spark, sf_dir, "media_files", "manifest")
    columns = ["id", *MEDIA_KEYS, "media_type", "bytes", "content_hash", "source_provider", "remote_id", "remote_url", "captured_at", "downloaded_at", "imported_at", "last_verified_at", "deleted_at"]
    media = files.withColumn("last_verified_at", F.col("first_seen_at")).withColumn("remote_id", F.when(F.col("id") % 5 > 0, F.col("remote_id"))).select(*columns)
    table = store.create(media, shared_folder(spark, "indexed-store"), MEDIA_KEYS, BUCKETS)
    got = manifest.select(
        *MEDIA_KEYS, fn.classify_media(F.col("rel_path")).alias("media_type"), "bytes", content_hash(F.col("content")).alias("content_hash"), F.when(F.col("mtime_ns") % 2 == 0, "pixnoy").otherwise("imginn").alias("provider"),
        F.concat(F.lit("n"), "rel_path").alias("remote_id"), F.concat(F.lit("https://m.example.com/"), "rel_path").alias("url"), at("2001-05-05 00:00:00").alias("posted_at"), (F.col("bytes") % 2 == 0).alias("downloaded"),
    )
    table = store.merge(spark, table.folder, R.index_media(store.read(spark, table), got, at(JOBS_NOW)))
    return store.read(spark, table).select("id", *MEDIA_KEYS, "media_type", "bytes", "content_hash", "source_provider", "remote_id", "remote_url", "captured_at", "downloaded_at", "imported_at", "last_verified_at")


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts deleted with all that belongs to them, from stored tables; what pointed at deleted rows points at nothing."""
    accounts, links, files, index, jobs, log = tables(spark, sf_dir, "accounts", "links", "media_files", "remote_index", "scrape_jobs", "event_log")
    gone = accounts.filter("id % 4 = 0").select(F.col("id").alias("account_id"))
    children = {
        "links": links.select("account_id", F.col("id").cast("string").alias("key"), F.lit(None).cast("long").alias("ref")),
        "media": files.select("account_id", F.col("id").cast("string").alias("key"), F.col("duplicate_of").alias("ref")),
        "remote": index.select("account_id", F.concat_ws("/", "provider", "remote_id").alias("key"), F.when(F.col("attempts") > 1, F.col("id") % 900).alias("ref")),
        "jobs": jobs.select("account_id", F.col("id").cast("string").alias("key"), F.lit(None).cast("long").alias("ref")),
        "events": log.select("account_id", F.col("id").cast("string").alias("key"), F.col("job_id").alias("ref")),
    }
    out, stored = None, {}
    for name, rows in children.items():
        table = store.create(rows, shared_folder(spark, f"cascade-{name}"), ("account_id", "key"), BUCKETS)
        stored[name] = store.read(spark, store.merge(spark, table.folder, rows.limit(0), gone=gone))
    for name, parent in (("links", None), ("media", "media"), ("remote", "media"), ("jobs", None), ("events", "jobs")):
        rows = stored[name]
        if parent:
            rows = A.null_dangling(rows, "ref", stored[parent].select(F.col("key").cast("long").alias("id")))
        rows = rows.select(F.lit(name).alias("child"), "account_id", "key", "ref")
        out = rows if out is None else out.unionByName(rows)
    return out


SCANNED = """SELECT *, live AND keeper <> rel_path AS loses FROM (SELECT *, first_value(rel_path) OVER (PARTITION BY account_id, hash, live ORDER BY NOT holds, string_split(rel_path, '/'), id NULLS FIRST) AS keeper FROM (
    SELECT *, deleted_at IS NULL AND hash IS NOT NULL AS live FROM (SELECT i.id, coalesce(m.account_id, i.account_id) AS account_id, coalesce(m.rel_path, i.rel_path) AS rel_path, coalesce(m.bytes, i.bytes) AS bytes, coalesce(m.mtime_ns, i.mtime_ns) AS mtime_ns,
      coalesce(i.media_type, CASE WHEN m.rel_path LIKE '%.jpg' THEN 'image' WHEN m.rel_path LIKE '%.mp4' THEN 'video' ELSE 'other' END) AS media_type, m.rel_path IS NOT NULL AS met,
      CASE WHEN m.rel_path IS NOT NULL AND NOT coalesce(i.content_hash IS NOT NULL AND i.bytes = m.bytes AND i.mtime_ns = m.mtime_ns, false) THEN sha256(m.content) ELSE i.content_hash END AS hash,
      i.content_hash IS NOT NULL AND NOT (m.rel_path IS NOT NULL AND NOT coalesce(i.bytes = m.bytes AND i.mtime_ns = m.mtime_ns, false)) AS holds,
      CASE WHEN m.rel_path IS NOT NULL THEN false ELSE i.is_missing OR i.deleted_at IS NULL END AS is_missing, CASE WHEN m.rel_path IS NULL THEN i.deleted_at END AS deleted_at, coalesce(i.first_seen_at, TIMESTAMP '2001-08-02 00:00:00') AS first_seen_at
      FROM manifest m FULL JOIN media_files i ON m.account_id = i.account_id AND m.rel_path = i.rel_path)))"""

INDEXED = """WITH media AS (SELECT * REPLACE (CASE WHEN id % 5 > 0 THEN remote_id END AS remote_id) FROM media_files),
  got AS (SELECT account_id, rel_path, CASE WHEN rel_path LIKE '%.jpg' THEN 'image' WHEN rel_path LIKE '%.mp4' THEN 'video' ELSE 'other' END AS media_type, bytes, sha256(content) AS content_hash, CASE WHEN mtime_ns % 2 = 0 THEN 'pixnoy' ELSE 'imginn' END AS provider, 'n' || rel_path AS remote_id, 'https://m.example.com/' || rel_path AS url, bytes % 2 = 0 AS downloaded FROM manifest)
  SELECT m.id, m.account_id, m.rel_path, m.media_type, m.bytes, m.content_hash, coalesce(m.source_provider, g.provider) AS source_provider, coalesce(m.remote_id, g.remote_id) AS remote_id, coalesce(m.remote_url, g.url) AS remote_url, m.captured_at, m.downloaded_at, m.imported_at,
    CASE WHEN g.rel_path IS NOT NULL THEN TIMESTAMP '2001-08-02 00:00:00' ELSE m.first_seen_at END AS last_verified_at FROM media m LEFT JOIN got g ON g.account_id = m.account_id AND g.rel_path = m.rel_path
  UNION ALL SELECT NULL, account_id, rel_path, media_type, bytes, content_hash, provider, remote_id, url, TIMESTAMP '2001-05-05 00:00:00', CASE WHEN downloaded THEN TIMESTAMP '2001-08-02 00:00:00' END, CASE WHEN NOT downloaded THEN TIMESTAMP '2001-08-02 00:00:00' END, TIMESTAMP '2001-08-02 00:00:00'
  FROM (SELECT *, row_number() OVER (PARTITION BY account_id, content_hash ORDER BY provider, remote_id) AS turn FROM got) g
  WHERE turn = 1 AND NOT EXISTS (SELECT 1 FROM media m WHERE m.account_id = g.account_id AND m.rel_path = g.rel_path) AND NOT EXISTS (SELECT 1 FROM media m WHERE m.account_id = g.account_id AND m.content_hash = g.content_hash AND m.deleted_at IS NULL)"""

GONE = "(SELECT id FROM accounts WHERE id % 4 = 0)"


def _kept(table: str) -> str:
    return f"{table} c WHERE c.account_id IS NULL OR c.account_id NOT IN {GONE}"


CASCADE = f"""SELECT 'links' AS child, account_id, id::VARCHAR AS key, NULL::BIGINT AS ref FROM {_kept('links')} UNION ALL SELECT 'jobs', account_id, id::VARCHAR, NULL FROM {_kept('scrape_jobs')}
  UNION ALL SELECT 'media', account_id, id::VARCHAR, CASE WHEN duplicate_of IN (SELECT id FROM {_kept('media_files')}) THEN duplicate_of END FROM {_kept('media_files')}
  UNION ALL SELECT 'remote', account_id, provider || '/' || remote_id, CASE WHEN attempts > 1 AND id % 900 IN (SELECT id FROM {_kept('media_files')}) THEN id % 900 END FROM {_kept('remote_index')}
  UNION ALL SELECT 'events', account_id, id::VARCHAR, CASE WHEN job_id IN (SELECT id FROM {_kept('scrape_jobs')}) THEN job_id END FROM {_kept('event_log')}"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"G1_upsert_stored": upsert, "WL1_scan_stored": scan, "G2_index_stored": indexed, "J12_cascade_stored": cascade}

ORACLES: dict[str, str] = {
    "G1_upsert_stored": with_tables(MERGED.format(listing="listing"), "remote_index", "listing"),
    "WL1_scan_stored": with_tables(
        f"SELECT id, account_id, rel_path, bytes, mtime_ns, media_type, CASE WHEN NOT loses THEN hash END AS content_hash, CASE WHEN loses THEN keeper END AS duplicate_of_path, is_missing, deleted_at, first_seen_at FROM ({SCANNED})", "manifest", "media_files"
    ),
    "G2_index_stored": with_tables(INDEXED.removeprefix("WITH "), "media_files", "manifest").replace("\nmedia AS", ",\nmedia AS"),
    "J12_cascade_stored": with_tables(CASCADE, "accounts", "links", "media_files", "remote_index", "scrape_jobs", "event_log"),
}
