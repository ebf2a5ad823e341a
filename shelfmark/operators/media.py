"""Media index: reconciliation with a listing, duplicates, counters, listings."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import content_hash

PRESENT = "deleted_at IS NULL AND NOT is_missing"


def scan_reconcile(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """What a scan does with each path: unchanged, changed, new, restored, missing or none.

    A path is unchanged when its row holds a hash and size and mtime agree. Rows of the index that
    are deleted or missing come back as restored when the listing has them.
    """
    m = manifest.select("account_id", "rel_path", F.col("bytes").alias("new_bytes"), F.col("mtime_ns").alias("new_mtime_ns"), F.lit(True).alias("listed"))
    i = index.select("id", "account_id", "rel_path", "bytes", "mtime_ns", "content_hash", "is_missing", "deleted_at")
    both = m.join(i, ["account_id", "rel_path"], "full_outer")
    same = F.col("content_hash").isNotNull() & (F.col("bytes") == F.col("new_bytes")) & (F.col("mtime_ns") == F.col("new_mtime_ns"))
    gone = F.col("is_missing") | F.col("deleted_at").isNotNull()
    action = (
        F.when(F.col("listed").isNull() & (F.col("is_missing") | F.col("deleted_at").isNotNull()), "none")
        .when(F.col("listed").isNull(), "missing")
        .when(F.col("id").isNull(), "new")
        .when(same & gone, "restored")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    return both.select("account_id", "rel_path", "id", F.coalesce("new_bytes", "bytes").alias("bytes"), action.alias("action"))


def scan_duplicates(actions: DataFrame, manifest: DataFrame, index: DataFrame) -> DataFrame:
    """``actions`` with ``is_duplicate``: new or changed files whose content the account holds already.

    Rows that the scan leaves as they are hold their hash; else the first by path parts does.
    ``manifest`` has content_hash.
    """
    fresh = actions.filter(F.col("action").isin("new", "changed")).join(manifest.select("account_id", "rel_path", F.col("content_hash").alias("new_hash")), ["account_id", "rel_path"])
    stays = actions.filter(~F.col("action").isin("new", "changed")).select("id")
    held = index.filter("content_hash IS NOT NULL AND deleted_at IS NULL").join(stays, "id").select("account_id", F.col("content_hash").alias("new_hash")).distinct().withColumn("held", F.lit(True))
    first = fresh.groupBy("account_id", "new_hash").agg(F.min(F.split("rel_path", "/")).alias("first"))
    rows = fresh.join(held, ["account_id", "new_hash"], "left").join(first, ["account_id", "new_hash"])
    again = rows.filter(F.col("held") | (F.split("rel_path", "/") != F.col("first"))).select("account_id", "rel_path", F.lit(True).alias("is_duplicate"))
    return actions.join(again, ["account_id", "rel_path"], "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def scan_report(actions: DataFrame) -> DataFrame:
    """Counts of each account's actions (see ``scan_duplicates``), and of all (account null).

    A duplicate is neither added nor updated.
    """
    count = lambda a: F.count_if((F.col("action") == a) & ~F.col("is_duplicate"))
    listed = ~F.col("action").isin("missing", "none")
    return actions.rollup("account_id").agg(
        F.count_if(listed).alias("files_seen"),
        count("new").alias("files_added"),
        count("changed").alias("files_updated"),
        F.count_if(F.col("action").isin("new", "changed")).alias("files_rehashed"),
        F.count_if("is_duplicate").alias("duplicates_found"),
        count("missing").alias("files_marked_missing"),
        count("restored").alias("files_restored"),
        F.coalesce(F.sum(F.when(listed, F.col("bytes"))), F.lit(0)).alias("bytes_indexed"),
    )


def vanished_paths(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """Indexed paths that are neither listed nor marked missing or deleted."""
    return index.filter(PRESENT).join(manifest.select("account_id", "rel_path").distinct(), ["account_id", "rel_path"], "left_anti").select("id", "account_id", "rel_path")


def dedup_keeper(files: DataFrame, holds: Column | None = None) -> DataFrame:
    """One holder for each hash of an account; the others point at it.

    A row that ``holds`` the hash already keeps it; else the first by path parts does. The holder comes from an aggregate, so a hot hash isn't sorted in one task.
    """
    hashed = files.filter("deleted_at IS NULL AND content_hash IS NOT NULL").select("id", "account_id", "rel_path", "content_hash", (F.lit(False) if holds is None else holds).alias("holds"))
    first = hashed.groupBy("account_id", "content_hash").agg(F.min(F.struct((~F.col("holds")).alias("later"), F.split("rel_path", "/").alias("parts"), "id"))["id"].alias("keeper"))
    return hashed.join(first, ["account_id", "content_hash"]).select(
        "id", "account_id", "rel_path",
        F.when(F.col("id") == F.col("keeper"), F.col("content_hash")).alias("content_hash"),
        F.when(F.col("id") != F.col("keeper"), F.col("keeper")).alias("duplicate_of"),
    )


def with_effective_hash(files: DataFrame) -> DataFrame:
    origin = files.select(F.col("id").alias("duplicate_of"), F.col("content_hash").alias("origin_hash"))
    return (
        files.filter("deleted_at IS NULL").join(origin, "duplicate_of", "left")
        .withColumn("effective_hash", F.coalesce("content_hash", "origin_hash")).filter("effective_hash IS NOT NULL")
        .withColumn("is_duplicate", F.col("duplicate_of").isNotNull())
    )


def duplicate_groups(files: DataFrame, limit: int = 100) -> DataFrame:
    """The largest groups of live files of equal content."""
    groups = with_effective_hash(files).groupBy(F.col("effective_hash").alias("content_hash")).agg(
        F.count("*").alias("copies"), F.count_distinct("account_id").alias("accounts"), F.min("bytes").alias("bytes"), F.count_if("is_duplicate").alias("same_account_copies"),
    )
    return groups.filter("copies > 1").orderBy(F.desc("copies"), F.desc("bytes"), "content_hash").limit(limit)


def duplicate_members(files: DataFrame, limit: int = 100) -> DataFrame:
    """The members of the reported groups, numbered by account, holder first, path."""
    hit = with_effective_hash(files).join(duplicate_groups(files, limit).select(F.col("content_hash").alias("effective_hash")), "effective_hash")
    order = Window.partitionBy("effective_hash").orderBy("account_id", "is_duplicate", "rel_path", "id")
    return hit.select(F.col("effective_hash").alias("content_hash"), F.row_number().over(order).cast("long").alias("place"), F.col("id").alias("media_id"), "account_id", "rel_path", "bytes", "is_duplicate")


def duplicate_report(files: DataFrame, limit: int = 100, members: int = 1000) -> DataFrame:
    """The largest groups of equal content, each with the list of its members, the first ``members`` of them.

    Members go by account, holder first, path; ``copies`` counts all. The long form, ``duplicate_members``,
    has no such limit.
    """
    listed = duplicate_members(files, limit).filter(F.col("place") <= members).groupBy("content_hash").agg(in_place(("media_id", "account_id", "rel_path", "bytes", "is_duplicate")).alias("members"))
    return duplicate_groups(files, limit).join(listed, "content_hash")


def find_duplicate(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The best live holder of each (hash, account): of the account itself, then the lowest id.

    Holders are reduced to one an account and one a hash before the joins.
    """
    held = files.filter("deleted_at IS NULL AND content_hash IS NOT NULL")
    own = held.groupBy("content_hash", "account_id").agg(F.min("id").alias("own"))
    first = held.groupBy("content_hash").agg(F.min("id").alias("first"))
    return wanted.select("content_hash", "account_id").distinct().join(own, ["content_hash", "account_id"], "left").join(first, "content_hash").select(
        "content_hash", "account_id", F.coalesce("own", "first").alias("media_id"), F.col("own").isNotNull().alias("same_account"),
    )


def media_with_account(files: DataFrame, accounts: DataFrame) -> DataFrame:
    a = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    return files.join(a, "account_id").select("id", "account_id", "account_name", "rel_path")


def account_counters(files: DataFrame, *more: Column) -> DataFrame:
    """Counts and sizes of live rows; missing files still count. ``more`` aggregates join the same pass."""
    return files.filter("deleted_at IS NULL").groupBy("account_id").agg(
        *(F.count_if(F.col("media_type") == t).alias(f"{t}_count") for t in ("image", "video", "other")),
        F.sum("bytes").alias("total_bytes"), F.max("downloaded_at").alias("last_download_at"), F.max("imported_at").alias("last_import_at"), *more,
    )


def counter_deltas(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Counters after changes (old row, new row; null where there is none), floored at 0.

    ``changes`` has old_/new_ columns account_id, media_type, bytes, live.
    """
    side = lambda p, sign: changes.filter(f"{p}_live").select(F.col(f"{p}_account_id").alias("account_id"), F.col(f"{p}_media_type").alias("t"), (F.col(f"{p}_bytes") * sign).alias("b"), F.lit(sign).alias("n"))
    delta = side("old", -1).unionByName(side("new", 1)).groupBy("account_id").agg(
        *(F.sum(F.when(F.col("t") == t, F.col("n")).otherwise(0)).alias(f"d_{t}") for t in ("image", "video", "other")), F.sum("b").alias("d_bytes"),
    )
    both = base.join(delta, "account_id", "full_outer")
    add = lambda c, d: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)) + F.coalesce(d, F.lit(0))).alias(c)
    return both.select("account_id", *(add(f"{t}_count", f"d_{t}") for t in ("image", "video", "other")), add("total_bytes", "d_bytes"))


def counts_by_type(files: DataFrame) -> DataFrame:
    return files.filter(PRESENT).groupBy("account_id", "media_type").agg(F.count("*").alias("files"))


def media_sorts() -> dict[str, list[Column]]:
    when = F.coalesce("captured_at", "downloaded_at", "first_seen_at")
    return {"newest": [when.desc(), F.desc("id")], "oldest": [when.asc(), F.asc("id")], "name": [F.lower(F.element_at(F.split("rel_path", "/"), -1)), F.asc("id")], "size": [F.desc("bytes"), F.asc("id")]}


def media_listing(files: DataFrame, media_type: str | None = None, include_missing: bool = False, sort: str = "newest", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of live files of every account."""
    rows = files.filter("deleted_at IS NULL" if include_missing else PRESENT)
    rows = rows if media_type is None else rows.filter(F.col("media_type") == media_type)
    place = F.row_number().over(Window.partitionBy("account_id").orderBy(*media_sorts()[sort])).cast("long")
    return rows.withColumn("place", place).filter(F.col("place").between(offset + 1, offset + limit)).select("account_id", "place", "id", "rel_path")


def soft_delete(files: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Stamp the given ids that aren't deleted yet."""
    hit = ids.select(F.col("id")).distinct().withColumn("hit", F.lit(True))
    return files.join(hit, "id", "left").withColumn("deleted_at", F.when(F.col("hit"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).drop("hit")


def inventory_digest(files: DataFrame, most: int = 20 * 1024**3, media_type: str | None = None) -> DataFrame:
    """Digest of an account's present files in path order, with size, number and an oversize flag.

    With ``media_type``, size and number are those of its folder (photos for images, else videos), and
    the digest, still of all files, names the type. Files come to an account's task in path order, sorted
    by Spark, and go into a running digest one by one: memory doesn't grow with the account.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    inside = F.lit(True) if media_type is None else F.coalesce(F.col("rel_path").startswith("photos/" if media_type == "image" else "videos/"), F.lit(False))
    rows = files.filter(PRESENT).withColumn("inside", inside)
    lines = rows.withColumn("line", F.concat("rel_path", F.lit(":"), text("bytes"), F.lit(":"), text("mtime_ns"))).withColumn("size", F.when(F.col("inside"), F.coalesce("bytes", F.lit(0))).otherwise(F.lit(0)))
    sorted_ = lines.repartition("account_id").sortWithinPartitions("account_id", "rel_path", "bytes", "mtime_ns").select("account_id", "line", "size", "inside")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, digest, size, number, out = None, None, 0, 0, []
        close = lambda: out.append((account, digest.hexdigest()[:16], size, number))
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["account_id", "digest", "total_bytes", "file_count"])
        for batch in batches:
            accounts = batch.column(0)
            # where one account's rows end within the batch
            edges = [0, *(pc.indices_nonzero(pc.not_equal(pc.fill_null(accounts[1:], -(2**63)), pc.fill_null(accounts[:-1], -(2**63)))).to_numpy() + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for begin, end in itertools.pairwise(edges):
                part = batch.slice(begin, end - begin)
                now = part.column(0)[0].as_py()
                if digest is None or now != account:
                    if digest is not None:
                        close()
                    account, digest, size, number = now, hashlib.sha256(), 0, 0
                digest.update("".join(x for x in part.column(1).to_pylist() if x is not None).encode())
                size += pc.sum(part.column(2)).as_py()
                number += pc.sum(part.column(3)).as_py()
            if len(out) >= 10_000:
                yield table()
                out.clear()
        if digest is not None:
            close()
        if out:
            yield table()

    found = sorted_.mapInArrow(digests, "account_id long, digest string, total_bytes long, file_count long")
    name = F.col("digest") if media_type is None else F.concat("digest", F.lit(f"-{media_type}"))
    return found.withColumn("digest", name).withColumn("oversize", F.col("total_bytes") > most)


def cover_media(files: DataFrame) -> DataFrame:
    """Newest present image of each account."""
    return files.filter(PRESENT).filter("media_type = 'image'").groupBy("account_id").agg(cover())


def cover() -> Column:
    """Aggregate: the newest present image among live rows."""
    fits = (F.col("media_type") == "image") & ~F.col("is_missing")
    return F.max_by("id", F.when(fits, F.struct(F.coalesce("captured_at", "first_seen_at"), "id"))).alias("cover_media_id")


def recent_media(files: DataFrame, n: int = 24, fields: tuple[str, ...] = ()) -> DataFrame:
    """The newest present files of each account, as a list of ids, or of structs of ``fields``."""
    place = F.row_number().over(Window.partitionBy("account_id").orderBy(*media_sorts()["newest"]))
    rows = files.filter(PRESENT).withColumn("place", place).filter(F.col("place") <= n)
    return rows.groupBy("account_id").agg(in_place(fields).alias("recent_media"))


def in_place(fields: tuple[str, ...]) -> Column:
    """Aggregate: ids, or structs of ``fields``, in the order of ``place``."""
    return F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*fields).alias("v") if fields else F.col("id").alias("v")))), lambda x: x["v"])


def hash_content(files: DataFrame) -> DataFrame:
    return files.select("id", content_hash(F.col("content")).alias("content_hash"))


def scan(manifest: DataFrame, index: DataFrame, hashes: DataFrame, now: Column) -> DataFrame:
    """The index rows that a scan changes, whole: with ``duplicate_of_path`` where another file holds the content.

    ``manifest(account_id, rel_path, bytes, mtime_ns, media_type)`` is the listing, ``hashes(account_id,
    rel_path, content_hash)`` has at least the files that need one: what ``scan_reconcile`` calls new or
    changed. Listed files come back from missing and deleted; files that aren't listed become missing. Of
    live rows with equal content one holds it, a row that held it before or else the first by path parts;
    the others have no hash and point at its path. New rows have no id yet. Unchanged rows are left out,
    but for those that the content of another one concerns.
    """
    at = ["account_id", "rel_path"]
    listed = manifest.select(*at, *(F.col(c).alias(f"m_{c}") for c in ("bytes", "mtime_ns", "media_type")), F.lit(True).alias("listed"))
    rows = index.join(listed, at, "full_outer").join(hashes.select(*at, F.col("content_hash").alias("m_hash")), at, "left")
    same = F.col("content_hash").isNotNull() & F.col("bytes").eqNullSafe(F.col("m_bytes")) & F.col("mtime_ns").eqNullSafe(F.col("m_mtime_ns"))
    met, fresh = F.col("listed").isNotNull(), F.col("listed").isNotNull() & ~F.coalesce(same, F.lit(False))
    after = rows.select(
        "id", *at, F.coalesce("m_bytes", "bytes").alias("bytes"), F.coalesce("m_mtime_ns", "mtime_ns").alias("mtime_ns"), F.coalesce("media_type", "m_media_type").alias("media_type"),
        F.when(fresh, F.col("m_hash")).otherwise(F.col("content_hash")).alias("hash"), (F.col("content_hash").isNotNull() & ~fresh).alias("holds"),
        F.when(fresh, F.lit(None)).otherwise(F.col("duplicate_of_path")).alias("duplicate_of_path"),
        F.when(met, False).otherwise(F.coalesce("is_missing", F.lit(False)) | F.col("deleted_at").isNull()).alias("is_missing"),
        F.when(~met, F.col("deleted_at")).alias("deleted_at"), F.coalesce("first_seen_at", now).alias("first_seen_at"),
        (fresh | (met & (F.col("is_missing") | F.col("deleted_at").isNotNull())) | (~met & ~F.col("is_missing") & F.col("deleted_at").isNull())).alias("touched"),
    )
    live = F.col("deleted_at").isNull() & F.col("hash").isNotNull()
    turn = F.struct((~F.col("holds")).alias("later"), F.split("rel_path", "/").alias("parts"), "id", "rel_path")
    keeper = after.filter(live).groupBy("account_id", "hash").agg(F.min(turn)["rel_path"].alias("keeper"))
    done = after.join(keeper, ["account_id", "hash"], "left")
    loses = live & (F.col("keeper") != F.col("rel_path"))
    return done.filter(F.col("touched") | loses).select(
        "id", *at, "bytes", "mtime_ns", "media_type", F.when(~loses | F.col("keeper").isNull(), F.col("hash")).alias("content_hash"),
        F.when(loses, F.col("keeper")).otherwise(F.col("duplicate_of_path")).alias("duplicate_of_path"), "is_missing", "deleted_at", "first_seen_at",
    )
