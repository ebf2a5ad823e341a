"""Shared folder, written tables and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster without it
    is an error, as a machine-local folder would lose files there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shelfmark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/shelfmark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; ``discard`` deletes it.

    Cuts the lineage, computes the rows once for all later readers, and survives lost executors.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which still reads ``tables`` of ``materialize``: whoever writes it discards ``df.reads``."""
    df.reads = tables
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for each in tables:
        context = each.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(each.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with ``__id`` and ``__mark``: rows that agree in both agree in doc_id and ``columns``.

    Narrow tables carry the pair, so that texts are moved once, when a decision is attached.
    """
    key = F.col("doc_id").cast("long")
    each = [F.xxhash64(text_of() if c == "text" else F.col(c)) for c in columns]
    return docs.withColumn("__mark", F.xxhash64(key.isNull(), *each)).withColumn("__id", F.coalesce(key, F.lit(0)))


def attach(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """One of the rows of ``keyed`` for each ``(__id, __mark)`` of ``decisions``, and its columns."""
    turn = F.row_number().over(Window.partitionBy("__id", "__mark").orderBy(F.lit(0)))
    return rows.join(decisions, ["__id", "__mark"]).withColumn("__turn", turn).filter("__turn = 1").drop("__turn")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))

