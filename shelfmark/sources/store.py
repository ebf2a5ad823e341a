"""Stored catalogue tables that results are merged back into.

A table is a folder of buckets by account, each a folder of Parquet files, and a manifest that names the
folder of every bucket. A merge writes new folders for the buckets that its changes touch, next to the
old ones, and then puts a new manifest in place by one rename: readers see all of a merge or nothing,
a merge that fails leaves the table as it was, and of two merges at once the later one fails. Rows that
agree with what is stored are no changes, so a merge that was done before adds no file to the table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    """``keys`` name a row; ``buckets`` deal rows by account, those of ``giants`` by all keys."""

    folder: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int
    giants: tuple[int, ...]
    version: int
    #: Bucket to the version whose folder holds it.
    places: dict[int, int]
    #: Function that deals accounts; ``hash`` is the one that repartition goes by.
    deal: str = "xxhash64"

    @property
    def bucket(self) -> Column:
        whole = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))
        by_account = F.pmod(getattr(F, self.deal)("account_id"), F.lit(self.buckets))
        return (F.when(F.col("account_id").isin(*self.giants), whole).otherwise(by_account) if self.giants else by_account).cast("int")


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _switch(spark: SparkSession, table: Table) -> Table:
    """Make ``table`` what readers see: its manifest is written aside and renamed, which fails if that version is there."""
    store, path = _files(spark, table.folder)
    store.mkdirs(path(f"{table.folder}/manifest"))
    aside, place = path(f"{table.folder}/.{table.version}-{spark._jvm.java.util.UUID.randomUUID()}"), path(f"{table.folder}/manifest/{table.version:09d}.json")
    out = store.create(aside)
    text = {"schema": table.schema.json(), "keys": table.keys, "buckets": table.buckets, "giants": table.giants, "places": table.places, "deal": table.deal}
    out.write(bytearray(json.dumps(text).encode()))
    out.close()
    if store.exists(place) or not store.rename(aside, place):
        store.delete(aside, False)
        raise RuntimeError(f"version {table.version} of {table.folder} was written by another merge")
    return table


def open_table(spark: SparkSession, folder: str) -> Table:
    """The table as its last manifest has it."""
    store, path = _files(spark, folder)
    last = max(s.getPath().getName() for s in store.listStatus(path(f"{folder}/manifest")))
    file = store.open(path(f"{folder}/manifest/{last}"))
    text = json.loads(bytes(file.readAllBytes()))
    file.close()
    return Table(folder, StructType.fromJson(json.loads(text["schema"])), tuple(text["keys"]), text["buckets"], tuple(text["giants"]), int(last.split(".")[0]), {int(b): v for b, v in text["places"].items()}, text.get("deal", "xxhash64"))


def read(spark: SparkSession, table: Table, buckets: list[int] | None = None) -> DataFrame:
    """The stored rows, of all buckets or some; no other folder is listed or opened."""
    chosen = [f"{table.folder}/data/version={v}/bucket={b}" for b, v in sorted(table.places.items()) if buckets is None or b in buckets]
    if not chosen:
        return spark.createDataFrame([], table.schema)
    return spark.read.schema(table.schema).parquet(*chosen)


def _write(rows: DataFrame, table: Table, version: int, dealt: bool = False) -> list[int]:
    """Write buckets as folders of ``version``; those that have rows. Rows that come ``dealt`` aren't moved."""
    spark, base = rows.sparkSession, f"{table.folder}/data/version={version}"
    rows = rows.withColumn("bucket", table.bucket)
    (rows if dealt else rows.repartition("bucket")).sortWithinPartitions("bucket", *table.keys).write.partitionBy("bucket").mode("overwrite").parquet(base)
    store, path = _files(spark, base)
    return sorted(int(s.getPath().getName().split("=")[1]) for s in store.listStatus(path(base)) if s.getPath().getName().startswith("bucket="))


def create(rows: DataFrame, folder: str, keys: tuple[str, ...], buckets: int = 64, giant: int = 5_000_000, bucket_rows: int = 500_000, dealt: int | None = None) -> Table:
    """Store ``rows``, unique by ``keys`` (which begin with account_id).

    Accounts of over ``giant`` rows are dealt by all keys; their ids, at most the rows divided by ``giant``,
    are part of the manifest. ``buckets`` is the least number: there are more where one would hold over
    ``bucket_rows`` on average, as a bucket is sorted and written by one task. Rows that come dealt by account
    into ``dealt`` partitions, with no giant among them, are as many buckets and neither counted nor dealt again.
    """
    if dealt:
        table = Table(folder, rows.schema, tuple(keys), dealt, (), 0, {}, "hash")
        return _switch(rows.sparkSession, Table(**vars(table) | {"places": {b: 0 for b in _write(rows, table, 0, True)}}))
    sizes = rows.groupBy("account_id").agg(F.count("*").alias("n"))
    large = F.when((F.col("n") > giant) & F.col("account_id").isNotNull(), F.col("account_id"))
    found = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_sort(F.collect_list(large)).alias("giants")).first()
    table = Table(folder, rows.schema, tuple(keys), max(buckets, -(-found["n"] // bucket_rows)), tuple(found["giants"]), 0, {}, "hash")
    written = _write(rows, table, 0)
    return _switch(rows.sparkSession, Table(**vars(table) | {"places": {b: 0 for b in written}}))


def merge(spark: SparkSession, folder: str, rows: DataFrame, gone: DataFrame | None = None) -> Table:
    """Put whole ``rows`` in place of those of equal keys, add those that are new, drop the keys of ``gone``.

    ``rows`` has the table's columns, one row a key; it may be all of the table or a part. Only buckets
    with a row that differs from what is stored are rewritten. Keys that are both given and gone go.
    ``gone`` may lack keys but account_id: all rows of its other keys go then, and none of them is dealt to be found.
    """
    table = open_table(spark, folder)
    keys, names = list(table.keys), table.schema.names
    given = rows.select(*(F.col(f.name).cast(f.dataType) for f in table.schema))
    match = lambda a, b, how, by=keys: a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by], how)
    stored = read(spark, table)
    same = stored.withColumn("__stored", F.struct(*names)).select(*keys, "__stored")
    changed = match(given, same, "left").filter(~F.struct(*(F.col(f"a.{c}") for c in names)).eqNullSafe(F.col("b.__stored"))).select("a.*")
    by = [] if gone is None else [k for k in keys if k in gone.columns]
    if gone is not None and "account_id" not in by:
        raise ValueError("gone must name accounts at least")
    if gone is not None:
        changed = match(changed, gone.select(*by), "left_anti", by)
    aside = f"{folder}/changes/version={table.version + 1}"
    changed.withColumn("__gone", F.lit(False)).write.mode("overwrite").parquet(f"{aside}/rows")
    marked = spark.read.parquet(f"{aside}/rows")
    if by == keys:
        lost = match(stored, gone.select(*keys).distinct(), "left_semi")
        lost.withColumn("__gone", F.lit(True)).write.mode("overwrite").parquet(f"{aside}/gone")
        marked = marked.unionByName(spark.read.parquet(f"{aside}/gone"))
    buckets = marked.select(table.bucket.alias("bucket"))
    if by and by != keys:
        gone.select(*by).distinct().write.mode("overwrite").parquet(f"{aside}/gone")
        gone = spark.read.parquet(f"{aside}/gone")
        buckets = buckets.unionByName(match(stored.select(*by, table.bucket.alias("bucket")).distinct(), gone, "left_semi", by).select("bucket"))
    touched = [r["bucket"] for r in buckets.distinct().collect()]
    if touched:
        kept = match(read(spark, table, touched), marked.select(*keys), "left_anti")
        if by and by != keys:
            kept = match(kept, gone, "left_anti", by)
        written = _write(kept.unionByName(marked.filter("NOT __gone").drop("__gone")), table, table.version + 1)
        places = {b: v for b, v in table.places.items() if b not in touched} | {b: table.version + 1 for b in written}
        table = _switch(spark, Table(**vars(table) | {"version": table.version + 1, "places": places}))
    store, path = _files(spark, aside)
    store.delete(path(aside), True)
    return table


def _remade(spark: SparkSession, table: Table, given: DataFrame, made: dict[str, Column], dealt: int | None) -> DataFrame:
    """All rows as ``made`` of what is stored and given, with bucket and ``__changed``; stored and given rows move once."""
    keys, extra = list(table.keys), [c for c in given.columns if c not in table.keys]
    rest = [f for f in table.schema if f.name not in keys]
    stored = read(spark, table).select(*keys, F.struct(*(f.name for f in rest)).alias("__stored"))
    given = given.select(*(F.col(k).cast(table.schema[k].dataType).alias(k) for k in keys), F.struct(*extra).alias("__given"))
    meet = lambda rows, *by: rows.groupBy(*by, *keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("__stored", "__given")))
    if dealt == table.buckets and not table.giants and table.deal == "hash":
        both = meet(stored.repartition(dealt, "account_id").unionByName(given, allowMissingColumns=True)).withColumn("bucket", table.bucket)
    else:
        both = meet(stored.unionByName(given, allowMissingColumns=True).withColumn("bucket", table.bucket).repartition(table.buckets, "bucket"), "bucket")
    both = both.select("bucket", *keys, "__stored", *(F.col("__stored")[f.name].alias(f.name) for f in rest), *(F.col("__given")[c].alias(c) for c in extra))
    after = [made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in rest]
    return both.select("bucket", *keys, *after, (~F.col("__stored").eqNullSafe(F.struct(*after))).alias("__changed"))


def upsert(spark: SparkSession, folder: str, given: DataFrame, made: dict[str, Column], dealt: int | None = None) -> Table:
    """Make every row anew from what is stored (nulls for new keys) and what ``given``, one row a key, says of it.

    ``made`` holds the columns made of both; others stay. For changes all over the table: stored and given rows
    meet in one deal, which writes all buckets aside; those with a row that differs are moved in, the others deleted.
    ``given`` that comes dealt by account into ``dealt`` partitions isn't moved if the table has as many buckets and no giants.
    """
    table = open_table(spark, folder)
    rows = _remade(spark, table, given, made, dealt)
    aside = f"{folder}/changes/{uuid.uuid4().hex}"
    store, path = _files(spark, aside)
    try:
        rows.sortWithinPartitions("bucket", *table.keys).write.partitionBy("bucket").parquet(aside)
        touched = [r["bucket"] for r in spark.read.schema("__changed boolean, bucket int").parquet(aside).filter("__changed").select("bucket").distinct().collect()]
        if touched:
            version = table.version + 1
            if store.exists(path(f"{folder}/manifest/{version:09d}.json")):
                raise RuntimeError(f"version {version} of {folder} was written by another merge")
            store.mkdirs(path(f"{folder}/data/version={version}"))
            for b in touched:
                place = path(f"{folder}/data/version={version}/bucket={b}")
                store.delete(place, True)  # what a merge that failed left there
                if not store.rename(path(f"{aside}/bucket={b}"), place):
                    raise RuntimeError(f"{place} could not be moved in")
            table = _switch(spark, Table(**vars(table) | {"version": version, "places": table.places | {b: version for b in touched}}))
    finally:
        store.delete(path(aside), True)
    return table


def vacuum(spark: SparkSession, folder: str) -> None:
    """Delete folders of buckets that the last manifest doesn't name, and older manifests; readers of these must be done."""
    table = open_table(spark, folder)
    store, path = _files(spark, folder)
    for version in store.listStatus(path(f"{folder}/data")):
        number, named = int(version.getPath().getName().split("=")[1]), False
        for bucket in store.listStatus(version.getPath()):
            name = bucket.getPath().getName()
            if name.startswith("bucket=") and table.places.get(int(name.split("=")[1])) == number:
                named = True
            elif name.startswith("bucket="):
                store.delete(bucket.getPath(), True)
        if not named:
            store.delete(version.getPath(), True)
    for manifest in store.listStatus(path(f"{folder}/manifest")):
        if manifest.getPath().getName() != f"{table.version:09d}.json":
            store.delete(manifest.getPath(), False)
