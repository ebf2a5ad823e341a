"""Merkle manifest of a dataset: a digest a row, a tree a source, one root, and each row's proof.

Rows of a source, by ascending doc_id, are dealt to aligned partitions of FANOUT ** LEVELS leaves; each
hashes its own subtree. Partitions then exchange roots as in a butterfly: in round r, those whose numbers
differ in the r-th digit (base FANOUT) only hold the roots of FANOUT neighbouring subtrees among them;
they swap these, and each hashes the common parent for itself. After the last round every partition holds
the root and, level by level, what its leaves' proofs need above it: no pass goes back down. The roots
of sources are leaves of one more such tree.

What moves are digests only: texts are read once, where they lie. A group of an exchange has at most
FANOUT members, however many rows a source has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Children of a node; levels that a partition hashes by itself.
FANOUT, LEVELS = 16, 3
#: Copies of a source's upper path, so that the partitions of a large source meet it in several tasks.
SPREAD = 16

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf(*values: Column) -> Column:
    """Digest of a row's values: each its length in UTF-8 bytes, a colon and itself, or - for null."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*map(part, values)).cast("binary"), 256))


def parent(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Rows with ``place``, their number among those of their ``tree``, and ``total``, the tree's size.

    Ranges of (tree, order) go to tasks, whose counts a tree are summed before them: no task holds a
    tree. Rows that agree in all are parted too, as they can stand for one another.
    """
    stable = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), f"{label}-rows")
    keys = ["tree", *order, "__row"]
    sorted_ = stable.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row").withColumn("__at", F.monotonically_increasing_id())
    parts = materialize(sorted_.withColumn("part", F.shiftright("__at", 33)), label)
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("tree")))
    small = materialize(counts.drop("n"), f"{label}-counts")
    out = materialize(parts.join(small, ["tree", "part"]).withColumn("place", F.col("base") + F.col("__at") - F.col("first")).drop("part", "__at", "first", "base"), f"{label}-numbered")
    discard(stable, parts, small)
    return out


def butterfly(nodes: DataFrame, most: int, fanout: int = FANOUT) -> DataFrame:
    """``nodes(tree, place, total, root)`` with the tree's root and ``up``, the way to it.

    ``up`` has an entry a round: the roots of neighbouring subtrees, and which of them is one's own.
    ``most`` is the size of the largest tree. Where the last subtree has fewer nodes than the others,
    its nodes serve those partners that it lacks.
    """
    step = "array<struct<digit:int,roots:array<binary>>>"
    rows, span = nodes.withColumn("up", F.array().cast(step)), 1
    while span < most:
        subtree = F.floor(F.col("place") / span)
        last, size = F.floor((F.col("total") - 1) / span), (F.col("total") - 1) % span + 1
        low, digit = F.col("place") % span, (subtree % fanout).cast("int")
        ragged = (subtree == last) & (digit > 0)
        partners = F.when(ragged, F.sequence(low, F.lit(span - 1), size)).otherwise(F.array(low))
        sent = rows.withColumn("digit", digit).withColumn("high", F.floor(subtree / fanout)).withColumn("low", F.explode(partners))
        own = F.when(F.col("low") == low, F.struct("place", "total", "digit", "up"))
        met = sent.groupBy("tree", "high", "low").agg(F.sort_array(F.collect_list(F.struct("digit", "root"))).alias("found"), F.collect_list(own).alias("members"))
        roots = F.transform("found", lambda x: x["root"])
        # a finished tree keeps its root
        made = F.unhex(F.sha2(F.array_join(F.transform("roots", lambda x: F.lower(F.hex(x))), "").cast("binary"), 256))
        each = met.withColumn("roots", roots).withColumn("made", made).withColumn("m", F.explode("members")).select("tree", "m.*", "roots", "made")
        going = F.col("total") > span
        rows = each.select(
            "tree", "place", "total",
            F.when(going, F.col("made")).otherwise(F.element_at("roots", 1)).alias("root"),
            F.when(going, F.concat("up", F.array(F.struct("digit", "roots")).cast(step))).otherwise(F.col("up")).alias("up"),
        )
        span *= fanout
    return rows


@dataclass
class Manifest:
    """``blocks``, a row a partition of leaves (numbers and digests packed); ``paths``, its way to the root."""

    blocks: DataFrame
    paths: DataFrame
    fanout: int
    levels: int


def local_levels(leaves: list[str], whole: bool, fanout: int, levels: int) -> list[list[str]]:
    """The levels of a partition's subtree; a ``whole`` tree ends at its root, others have all levels."""
    out = [leaves]
    while (len(out[-1]) > 1) if whole else (len(out) <= levels):
        out.append([parent(out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def hexes(packed: bytes) -> list[str]:
    text = packed.hex()
    return [text[k : k + 64] for k in range(0, len(text), 64)]


def build(docs: DataFrame, claim: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The manifest of ``docs(doc_id, source, lang, n_chars, text)``.

    ``claim`` is another text that a row is to be verified with; null or absent: its own. Null values
    are values of their own; a null source is a tree, before all others; null doc_ids come first. Rows
    that repeat are leaves of their own; rows that share a doc_id go by their digest. Other columns
    don't count. No rows make no partition.
    """
    size = fanout**levels
    values = [F.col(c) for c in FIELDS]
    own = leaf(*values)
    other = F.lit(None).cast("binary") if claim is None else F.when(claim.isNotNull(), leaf(*values[:-1], claim))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = numbered(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("leaf"), other.alias("claim")), ["doc_id", "leaf"], "leaves")

    member = F.struct("place", "doc_id", "leaf", "claim")
    grouped = rows.groupBy("tree", F.floor(F.col("place") / size).alias("block")).agg(F.sort_array(F.collect_list(member)).alias("m"), F.first("total").alias("leaves"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                members = batch.column(2).slice(k, 1).flatten()
                digests = b"".join(members.field("leaf").to_pylist())
                top = local_levels(hexes(digests), batch.column(3)[k].as_py() <= size, fanout, levels)[-1][0]
                yield pa.RecordBatch.from_pydict({
                    "tree": batch.column(0).slice(k, 1), "block": batch.column(1).slice(k, 1), "leaves": batch.column(3).slice(k, 1), "root": [bytes.fromhex(top)],
                    "doc_ids": pa.ListArray.from_arrays([0, len(members)], members.field("doc_id")), "digests": [digests], "claims": pa.ListArray.from_arrays([0, len(members)], members.field("claim")),
                })

    blocks = materialize(grouped.mapInArrow(hashed, "tree string, block long, leaves long, root binary, doc_ids array<long>, digests binary, claims array<binary>"), "blocks")
    discard(rows)

    total = F.ceil(F.col("leaves") / size)
    most = blocks.agg(F.max(total)).first()[0] or 0
    nodes = blocks.select("tree", F.col("block").alias("place"), total.alias("total"), "root")
    inner = materialize(butterfly(nodes, most, fanout), "inner")

    tops = inner.filter("place = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), "root")
    sources = numbered(tops, ["name"], "sources")
    count = sources.agg(F.max("total")).first()[0] or 0
    named = sources.select("place", "name", F.col("root").alias("subroot"))
    outer = butterfly(sources.select("tree", "place", "total", "root"), count, fanout).join(named, "place")
    ends = outer.select(F.col("name").alias("tree"), "subroot", "root", F.col("up").alias("over"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    whole = inner.select("tree", F.col("place").alias("block"), "up", (F.col("place") % SPREAD).cast("int").alias("salt")).join(ends, ["tree", "salt"])
    paths = materialize(whole.select("tree", "block", "subroot", "root", F.concat("up", "over").alias("up")), "paths")
    discard(inner, sources)
    return Manifest(blocks, paths, fanout, levels)


def proofs(manifest: Manifest) -> DataFrame:
    """For each leaf: its digest, its source's root, the root, the digest of its proof, and what the proof gives.

    The proof is the siblings of all nodes from the leaf to the root. ``folded_root`` comes from the
    claimed leaf where there is one, else from the leaf, and the siblings; ``verified`` tells whether it
    is the root. Repeated rows have rows of their own.
    """
    fanout, levels, size = manifest.fanout, manifest.levels, manifest.fanout**manifest.levels

    def fold(value: str, siblings: list[tuple[list[str], int]]) -> str:
        for group, own in siblings:
            value = parent([*group[:own], value, *group[own + 1 :]])
        return value

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                leaves = hexes(row["digests"])
                tree = local_levels(leaves, row["leaves"] <= size, fanout, levels)
                above = [([d.hex() for d in s["roots"]], s["digit"]) for s in row["up"]]
                rest = "".join(d for group, own in above for j, d in enumerate(group) if j != own).encode()
                folded, out, root = {}, ([], [], []), row["root"].hex()
                for k, claim in enumerate(row["claims"]):
                    below = [(level[(k // fanout**r) // fanout * fanout :][:fanout], k // fanout**r % fanout) for r, level in enumerate(tree[:-1])]
                    proof = hashlib.sha256("".join(d for group, own in below for j, d in enumerate(group) if j != own).encode())
                    proof.update(rest)
                    top = fold(leaves[k] if claim is None else claim.hex(), below)
                    if top not in folded:
                        folded[top] = fold(top, above)
                    for column, value in zip(out, (proof.hexdigest(), folded[top], folded[top] == root)):
                        column.append(value)
                n = len(leaves)
                source = [row["tree"][1:] if row["tree"] else None] * n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(source, pa.string()), pa.array(leaves), pa.array([row["subroot"].hex()] * n), pa.array([root] * n), *map(pa.array, out)],
                    names=[f.split()[0] for f in PROOF.split(", ")],
                )

    rows = manifest.blocks.drop("root").join(manifest.paths, ["tree", "block"])
    return rows.mapInArrow(prove, PROOF)


def tampered(docs: DataFrame) -> Column:
    """Lower-cased text (A-Z) of the rows whose decimal doc_id has an unsigned crc32 that 5 divides; else null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")) % 5 == 0, F.translate(docs["text"].cast("string"), upper, upper.lower()))


def digest(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, tampered ones folded from their changed text; a null doc_id or text is never tampered."""
    return proofs(build(docs, tampered(docs))).drop("source")


def oracle(depth: int = 6) -> str:
    """SQL of ``digest`` for sources, and numbers of sources, of up to FANOUT ** depth."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    digest_of = lambda text: "sha256(" + " || ".join(part(c) for c in (*FIELDS[:-1], text)) + ")"
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ctes = [
        f"base AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {digest_of('text')} AS leaf, CASE WHEN {crc} % 5 = 0 AND text IS NOT NULL THEN {digest_of(f'translate(text, {upper!r}, {upper.lower()!r})')} END AS claim FROM documents)",
        "a0 AS (SELECT *, leaf AS folded, '' AS proof, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM base)",
        "n0 AS (SELECT tree, place, leaf AS d FROM a0)",
    ]

    def climb(k: int, rows: str, nodes: str) -> None:
        size = f"(SELECT tree, count(*) AS total FROM {nodes} GROUP BY 1)"
        ctes.append(f"g{k} AS (SELECT n.tree, n.place // {FANOUT} AS place, list(n.d ORDER BY n.place) AS ds, any_value(s.total) AS total FROM {nodes} n JOIN {size} s USING (tree) GROUP BY 1, 2)")
        ctes.append(f"n{k + 1} AS (SELECT tree, place, CASE WHEN total > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM g{k})")
        own = f"(a.place % {FANOUT})::INT"
        ctes.append(
            f"a{k + 1} AS (SELECT a.* EXCLUDE (folded, proof, place), a.place // {FANOUT} AS place, CASE WHEN g.total > 1 THEN a.proof || array_to_string(g.ds[:{own}], '') || array_to_string(g.ds[{own} + 2:], '') ELSE a.proof END AS proof,"
            f" CASE WHEN g.total > 1 THEN sha256(array_to_string(g.ds[:{own}], '') || a.folded || array_to_string(g.ds[{own} + 2:], '')) ELSE a.folded END AS folded FROM {rows} a JOIN g{k} g ON g.tree = a.tree AND g.place = a.place // {FANOUT})"
        )

    ctes[1] = ctes[1].replace("leaf AS folded", "coalesce(claim, leaf) AS folded")
    for k in range(depth):
        climb(k, f"a{k}", f"n{k}")
    ctes.append(f"tops AS (SELECT tree AS name, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank FROM n{depth})")
    ctes.append(f"a{depth}s AS (SELECT a.* EXCLUDE (tree, place), t.subroot, '' AS tree, t.rank AS place FROM a{depth} a JOIN tops t ON t.name = a.tree)")
    ctes.append(f"n{depth}s AS (SELECT '' AS tree, rank AS place, subroot AS d FROM tops)")
    climb(depth + 1, f"a{depth}s", f"n{depth}s")
    for k in range(depth + 2, depth + 4):
        climb(k, f"a{k}", f"n{k}")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified FROM a{depth + 4} JOIN n{depth + 4} USING (tree)"
