"""Content hashes of binary columns and of files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 64 * 1024


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def quick_signature(content: Column, sample: int = SAMPLE) -> Column:
    """Size and a hash of both ends: a cheap test before the full hash."""
    data = content.cast("binary")
    size = F.octet_length(data)
    tail = F.when(size > 2 * sample, F.substring(data, -sample, sample)).otherwise(F.lit(b""))
    digest = F.sha2(F.concat(size.cast("string").cast("binary"), F.substring(data, 1, sample), tail), 256)
    return F.concat(F.lit("qs1:"), size.cast("string"), F.lit(":"), F.substring(digest, 1, 32))


def dealt_by_bytes(paths: DataFrame, tasks: int, column: str = "path", size: str = "bytes") -> DataFrame:
    """``paths`` dealt to ``tasks`` partitions of about equal bytes, whatever a file's size.

    Files are laid end to end (in the order of a hash) and cut at equal shares; where a file begins is a
    prefix sum, of a thousand groups first and within each then. A task has a share and at most the rest
    of one file more.
    """
    rows = paths.withColumn("__h", F.xxhash64(column)).withColumn("__g", F.pmod("__h", F.lit(1024))).withColumn("__b", F.coalesce(F.col(size), F.lit(0)) + 1)
    groups = rows.groupBy("__g").agg(F.sum("__b").alias("n"))
    before = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("__g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"), F.sum("n").over(Window.partitionBy()).alias("__all"))
    within = Window.partitionBy("__g").orderBy("__h", column).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.join(bases, "__g").withColumn("__at", F.col("__base") + F.coalesce(F.sum("__b").over(within), F.lit(0)))
    task = F.least(F.floor(F.col("__at") / F.col("__all") * tasks), F.lit(tasks - 1)).cast("int")
    return starts.withColumn("__task", task).repartitionById(tasks, F.col("__task")).select(*paths.columns)


def hash_files(paths: DataFrame, column: str = "path", chunk: int = 1 << 20, tasks: int | None = None) -> DataFrame:
    """SHA-256 of files by path, read in chunks, for files too large for a column; null where unreadable.

    With ``tasks``, ``paths`` has their sizes in ``bytes`` and is dealt to so many tasks of about equal size.
    """
    paths = paths if tasks is None else dealt_by_bytes(paths, tasks, column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column(0).to_pylist():
                try:
                    with open(path, "rb") as file:
                        digest = hashlib.sha256()
                        while block := file.read(chunk):
                            digest.update(block)
                    digests.append(digest.hexdigest())
                except OSError:
                    digests.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=[column, "content_hash"])

    return paths.select(column).mapInArrow(work, f"{column} string, content_hash string")
