"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Every document of a source is expected target / size of its source times. Expected copies are
summed along the source's documents, one offset drawn for the source is added, and a document is
taken once for each whole number that its stretch of the sum covers. Documents go in order of
size class, so what a source takes stays near its target.

The running number of a document within its source comes from counts at three grains (classes of a
source, bins of a class, rows of a bin), so no window holds more than a bin of rows, a class's 256
bins or a source's classes, however large the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, attach, discard, keyed, materialize, reading, text_of

#: Weights by rank of the source, repeating; the most copies of a source.
WEIGHTS, CAP = (5, 2, 1), 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add ``target`` to ``sizes(source, source_size)``, one row a source.

    Sources by code point, null last, weigh ``weights`` in turn and share the total of all sizes.
    Targets stop at ``cap`` times their size; the excess is reshared by weight. In closed form: the
    capped sources are those first by cap * size / weight, and the rest share what is left.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*map(F.lit, weights))[((F.row_number().over(turn) - 1) % len(weights)).cast("int")]
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("most", cap * F.col("source_size"))
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_ = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    # what one weight would get, were exactly the sources before this one capped
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("most").over(before), F.lit(0))
    unit = left / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("unit", unit).withColumn("turn", F.row_number().over(full))
    free = F.when(F.col("weight") * F.col("unit") <= F.col("most"), F.col("turn"))
    share = F.col("weight") * F.min_by("unit", free).over(all_)
    return ranked.select("source", "source_size", F.least(share, F.col("most").cast("double")).alias("target"))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """The columns ``keep`` of every row with size, source_size, target, copies and taken words.

    Rows with copies 0 are not in the mix. Null text has size 0. Rows of size 0 are sampled like
    others and add no words; a source without words has target 0 and gives nothing. Repeated rows
    count each by itself. Bins come from doc_id (null as empty), so reruns agree. ``keep`` may name
    columns that clash with none of the new ones.
    """
    binary = F.bin(F.col("size"))
    base = docs.select(
        *(F.col(c) for c in keep),
        F.col("source").cast("string").alias("__source"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__doc"),
    )
    # eight classes to each doubling of the size; 256 bins by digest
    base = base.withColumn("__class", F.concat(F.lpad(F.length(binary).cast("string"), 2, "0"), F.substring(binary, 2, 3)))
    base = base.withColumn("__bin", F.substring(F.md5(F.col("__doc").cast("string")), 1, 2))
    base = base.withColumn("__key", F.coalesce(F.concat(F.lit("="), "__source"), F.lit("")))
    base = materialize(base, "sizes")

    bins = base.groupBy("__key", "__source", "__class", "__bin").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = bins.groupBy("__key", "__source", "__class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sources = classes.groupBy("__key", "__source").agg(F.sum("n").alias("n"), F.sum("words").alias("source_size"))
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda *keys: F.coalesce(F.sum("n").over(earlier(*keys)), F.lit(0))
    class_starts = classes.select("__key", "__class", sum_before("__key", "__class").alias("__class_start"))
    bin_starts = bins.select("__key", "__class", "__bin", sum_before("__key", "__class", "__bin").alias("__bin_start"))

    targets = source_targets(sources.select(F.col("__source").alias("source"), "source_size"), weights, cap)
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 5), 16, 10).cast("double") / 16**5
    rates = targets.select(key.alias("__key"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"), draw.alias("__draw"))

    starts = bin_starts.join(class_starts, ["__key", "__class"]).withColumn("__start", F.col("__class_start") + F.col("__bin_start"))
    starts = starts.join(rates, "__key").drop("__class_start", "__bin_start")
    place = F.row_number().over(Window.partitionBy("__key", "__class", "__bin").orderBy("size", "__doc"))
    placed = base.withColumn("__place", place).join(starts, ["__key", "__class", "__bin"]).withColumn("__upto", F.col("__start") + F.col("__place"))
    crossed = F.floor(F.col("__draw") + F.col("__rate") * F.col("__upto")) - F.floor(F.col("__draw") + F.col("__rate") * (F.col("__upto") - 1))
    copies = F.least(crossed, F.lit(cap).cast("long")).alias("copies")
    return reading(placed.select(*keep, "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size")), base)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of ``docs``.

    Copies are dealt among narrow rows; texts move once, when the copies meet them. Rows that are equal
    in every column are taken together. Null text has size 0; no rows give no rows.
    """
    rows = keyed(docs, *docs.columns)
    made = mix(rows, ("__id", "__mark"), weights, cap, seed)
    taken = materialize(made.groupBy("__id", "__mark").agg(F.sum("copies").alias("__copies")).filter("__copies > 0"), "taken")
    discard(*made.reads)
    return reading(attach(rows, taken).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns), taken)


#: The same mix in DuckDB's SQL.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS skey, coalesce(doc_id, -1) AS id,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
classed AS (
  SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substring(bin(size), 2, 3) AS class,
         substring(md5(id::VARCHAR), 1, 2) AS digest
  FROM sized),
sources AS (SELECT source, skey, sum(size)::BIGINT AS source_size FROM classed GROUP BY ALL),
weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS most
  FROM sources),
units AS (
  SELECT *, row_number() OVER f AS turn,
         (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS unit
  FROM weighed
  WINDOW f AS (ORDER BY most::DOUBLE / weight, source ASC NULLS LAST),
         b AS (ORDER BY most::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT skey, source_size,
         least(weight * (SELECT unit FROM units WHERE weight * unit <= most ORDER BY turn LIMIT 1), most::DOUBLE) AS target,
         ('0x' || substring(md5('7:' || skey), 1, 5))::BIGINT / 1048576.0::DOUBLE AS draw
  FROM units),
placed AS (
  SELECT c.*, row_number() OVER (PARTITION BY skey ORDER BY class, digest, size, id) AS upto FROM classed c),
crossed AS (
  SELECT p.doc_id, p.size, t.source_size, t.target,
         floor(t.draw + CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END * p.upto)
           - floor(t.draw + CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END * (p.upto - 1)) AS crossed
  FROM placed p JOIN targets t USING (skey))
SELECT doc_id, size, source_size, target, least(crossed, 3)::BIGINT AS copies, least(crossed, 3)::BIGINT * size AS taken
FROM crossed
"""
