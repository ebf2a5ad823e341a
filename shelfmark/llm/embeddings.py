"""Near-duplicate vectors by cosine, through an inverted multi-index.

Vectors are scaled to length 1. Each half has a codebook of its own, and a vector's cell is its
nearest code of either half. Cells of the product grid are visited in the order of the summed
distances of their two codes (the multi-sequence order). Every pair met in a cell is verified by its
cosine in double precision. A pair is met if either vector visits the other's cell.

How many cells are visited is measured on two sets of pairs, and the larger number holds: partners
planted at just the threshold from sampled vectors (so the figure doesn't hang on how many links a
sample happens to hold), and the true links of sampled queries among all vectors, by brute force, each
query counting as one. TARGET of either must be met. Nothing bounds the number but the grid itself.

Large groups of near copies are balls: leaders are found in the sample that the codebooks are fitted on,
and every vector within half the threshold's angle of its nearest leader is in that leader's ball. Two
vectors of one ball link whatever they are, so a ball is counted and linked as a whole and its pairs are
neither dealt nor compared.

Cells are cut into blocks of at most MEMBERS members by VISITORS visitors; a ball that is large in a cell has
blocks of its own there, which never meet each other. A block reports counts and a spanning forest, never its
pairs. Vectors of different length have no cosine: each length has an index of its own, and lengths whose
grid would have one cell need none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, reading
from .components import connected_components, join_labels
from .simhash import runs

#: Rows that the codebooks are fitted on, queries and planted pairs that the traversal is measured with, and
#: the numbers that the driver holds of either set of rows (128 MB): longer vectors, fewer rows.
FIT_ROWS, QUERIES, PLANTED, NUMBERS = 20_000, 1024, 4000, 1 << 24
#: Rows of the sample that leaders are sought among, and how many of them make a ball: groups of about a
#: two-thousandth of all vectors.
LEADER_ROWS, LEAST = 8192, 4
#: Rows of a small table up to which it is broadcast (about 40 MB).
SMALL = 1_000_000
TARGET = 0.97
MEMBERS, VISITORS = 2048, 8192
#: A grid has no more cells than CODES * CODES, whatever the number of vectors.
MEMBERS_PER_CELL, CODES = 2048, 1024
#: Numbers that a step of the traversal or of a block holds, and what ties of distances may differ by.
ROOM, TIE = 1 << 21, 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1. Each is divided by its largest component first, so that no square leaves the doubles."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=0)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def codebook(x: np.ndarray, size: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k-means codes of the rows of ``x``."""
    codes = x[np.sort(np.random.default_rng(seed).choice(len(x), min(size, len(x)), replace=False))]
    for _ in range(rounds):
        near = distances(x, codes).argmin(axis=1)
        count = np.bincount(near, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, near, x)
        codes = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], codes)
    return codes


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1)


def half_distances(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    half = books[0].shape[1]
    return distances(x[:, :half], books[0]), distances(x[:, half:], books[1])


def traverse(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], visits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells visited, as (row, cell), and how far each row went: all cells at most that far, at least ``visits``.

    Only codes i, j of ranks with (i + 1)(j + 1) <= visits can be among the nearest ones, as all cells of
    lower ranks come before.
    """
    n1, n2 = map(len, books)
    visits = min(visits, n1 * n2)
    ranks = np.array([(i, j) for i in range(min(n1, visits)) for j in range(min(n2, visits // (i + 1)))])
    out, reach = [], np.empty(len(x))
    for at in range(0, len(x), step := max(1, ROOM // max(len(ranks), n1 + n2))):
        first, second = half_distances(x[at : at + step], books)
        rows = np.arange(len(first))[:, None]
        order1, order2 = (np.argsort(d, axis=1, kind="stable") for d in (first, second))
        i, j = order1[:, ranks[:, 0]], order2[:, ranks[:, 1]]
        far = first[rows, i] + second[rows, j]
        reach[at : at + step] = edge = np.partition(far, visits - 1, axis=1)[:, visits - 1] + TIE
        row, k = np.nonzero(far <= edge[:, None])
        out.append((row + at, i[row, k] * n2 + j[row, k]))
    return *(np.concatenate([o[k] for o in out] or [np.zeros(0, int)]) for k in (0, 1)), reach


def homes(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The nearest cell of each row."""
    first, second = half_distances(x, books)
    return first.argmin(axis=1) * len(books[1]) + second.argmin(axis=1)


def ranks_of(x: np.ndarray, cells: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The place of ``cells[k]`` in the traversal from ``x[k]``: how many cells are as near or nearer."""
    first, second = half_distances(x, books)
    out = np.empty(len(x), np.int64)
    for k, (a, b) in enumerate(zip(first, np.sort(second, axis=1))):
        i, j = divmod(int(cells[k]), len(books[1]))
        out[k] = np.searchsorted(b, first[k, i] + second[k, j] + TIE - a, "right").sum()
    return out


def array_of(column: pa.Array, width: int) -> np.ndarray:
    """Vectors that travel as the bytes of their doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def usable(vector: str) -> Column:
    """Whether a vector can have a cosine: not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x.isNotNull() & (x != 0)), F.lit(False))


def grid_side(total: Column | int) -> Column | int:
    """Codes of a half for ``total`` vectors."""
    if isinstance(total, Column):
        return F.greatest(F.lit(1), F.least(F.lit(CODES), F.rint(F.sqrt(total / MEMBERS_PER_CELL)).cast("int")))
    return int(np.clip(np.rint((total / MEMBERS_PER_CELL) ** 0.5), 1, CODES))


def sampled(vectors: DataFrame, rows: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and vectors of at most ``rows`` rows (and ``NUMBERS`` numbers) in the order of a hash."""
    got = vectors.orderBy(F.xxhash64("packed", F.lit(seed)), "node").select("node", "packed").limit(max(1, min(rows, NUMBERS // width))).toArrow()
    return got["node"].to_numpy(), unit(array_of(got["packed"].combine_chunks(), width))


def fit(sample: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of the two halves."""
    size, half = grid_side(total), max(1, sample.shape[1] // 2)
    return codebook(sample[:, :half], size), codebook(sample[:, half:], size)


def inner(threshold: float) -> float:
    """The cosine with a leader from which on two vectors link in any case: half the threshold's angle, less a margin for rounding."""
    return ((1 + threshold) / 2) ** 0.5 + TIE


def leaders(sample: np.ndarray, threshold: float) -> np.ndarray:
    """Middles of the sample's dense groups: at least LEAST rows within a ball, each row in one ball at most.

    Tries as many rows, those with most neighbours first, as there could be balls. A group that isn't found
    is compared in blocks like all else: only the work depends on it.
    """
    x = sample[:LEADER_ROWS]
    near = np.concatenate([x[at : at + 1024] @ x.T >= threshold for at in range(0, len(x), 1024)])
    count, free, found, tries = near.sum(axis=1), np.ones(len(x), bool), [], len(x) // LEAST
    for k in np.argsort(-count, kind="stable"):
        if count[k] < LEAST or not tries:
            break
        group = np.flatnonzero(near[k] & free)
        if not free[k] or len(group) < LEAST:
            continue
        tries -= 1
        middle = unit(x[group].sum(axis=0)[None])[0]  # of vectors that share a half-space, so not zero
        ball = group[x[group] @ middle >= inner(threshold)]
        free[k] = False
        if len(ball) >= LEAST:
            free[ball] = False
            found.append(middle)
    return np.array(found).reshape(-1, x.shape[1])


def balls_of(x: np.ndarray, middles: np.ndarray, threshold: float) -> np.ndarray:
    """The ball of each row: its nearest leader's, -1 if that is too far."""
    out = np.full(len(x), -1, np.int64)
    if len(middles):
        for at in range(0, len(x), step := max(1, ROOM // len(middles))):
            near = x[at : at + step] @ middles.T
            best = near.argmax(axis=1)
            out[at : at + step] = np.where(near[np.arange(len(near)), best] >= inner(threshold), best, -1)
    return out


def planted_ranks(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Places at which vectors and partners at a cosine of just ``threshold`` in random directions meet."""
    rng = np.random.default_rng(8)
    x = sample[rng.integers(0, len(sample), PLANTED)]
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    y = unit(threshold * x + (1 - threshold**2) ** 0.5 * np.divide(away, size, out=np.zeros_like(away), where=size > 0))
    return np.minimum(ranks_of(x, homes(y, books), books), ranks_of(y, homes(x, books), books))


def enough(ranks: np.ndarray, weights: np.ndarray) -> int:
    """The least number of visits that meets TARGET of the weights."""
    order = np.argsort(ranks)
    share = np.cumsum(weights[order]) / weights.sum()
    return int(ranks[order][min(np.searchsorted(share, TARGET - 1e-12), len(order) - 1)])


def measured_visits(vectors: DataFrame, books: tuple[np.ndarray, np.ndarray], sample: np.ndarray, threshold: float) -> int:
    """Cells to visit, from planted pairs and from the true links of sampled queries."""
    visits = enough(planted_ranks(sample, books, threshold), np.ones(PLANTED))
    nodes, queries = sampled(vectors, QUERIES, sample.shape[1], 1)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(array_of(batch.column(1), queries.shape[1]))
                q, k = np.nonzero((queries @ x.T >= threshold) & (nodes[:, None] != batch.column(0).to_numpy()[None]))
                met, count = np.unique(np.stack([q, homes(x, books)[k]], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(met[:, 0]), pa.array(ranks_of(queries[met[:, 0]], met[:, 1], books)), pa.array(count)], names=["q", "rank", "n"])

    found = vectors.select("node", "packed").mapInArrow(links, "q long, rank long, n long").groupBy("q", "rank").agg(F.sum("n").alias("n")).collect()
    if found:
        q, rank, n = np.array(found, np.int64).T
        visits = max(visits, enough(rank, n / np.bincount(q, n)[q]))
    return visits


#: What names a block: a cell, a ball (-1: the rest) and a part of its members, a ball and a part of the visitors.
BLOCK = ("width", "cell", "ma", "a", "vb", "b")


def small(table: DataFrame) -> DataFrame:
    """``table`` to be broadcast if it has at most SMALL rows; beyond that the join deals both sides."""
    return F.broadcast(table) if table.count() <= SMALL else table


def blocks_of(indexed: DataFrame) -> DataFrame:
    """Members and visitors of every cell, dealt to blocks named by BLOCK.

    A ball with more rows in a cell than a block holds is cut into blocks of its own. They meet all blocks of that
    cell but their own ball's, so a hot group isn't dealt against itself.
    """
    members = indexed.groupBy("width", F.col("home").alias("cell"), "ball").agg(F.count("*").alias("m"))
    visitors = indexed.select("width", "ball", F.explode("cells").alias("cell")).groupBy("width", "cell", "ball").agg(F.count("*").alias("v"))
    counts = members.join(visitors, ["width", "cell", "ball"], "full").fillna(0, ["m", "v"])
    alone = (F.col("ball") >= 0) & ((F.col("m") > MEMBERS) | (F.col("v") > VISITORS))
    counts = counts.groupBy("width", "cell", F.when(alone, F.col("ball")).otherwise(-1).alias("g")).agg(F.sum("m").alias("m"), F.sum("v").alias("v"))
    group = F.struct("g", F.ceil(F.col("m") / MEMBERS).alias("m"), F.ceil(F.col("v") / VISITORS).alias("v"))
    # a row for each cell that has members
    cut = materialize(counts.groupBy("width", "cell").agg(F.collect_list(group).alias("groups"), F.sum("m").alias("n")).filter("n > 0").drop("n"), "cut")
    cells = small(cut)

    def dealt(rows: DataFrame, own: str, other: str, seed: int) -> DataFrame:
        """Each row in its own part, ``(g, k)``, once for every part of the ``other`` side, ``(og, ok)``."""
        rows = rows.join(cells, ["width", "cell"])
        rows = rows.withColumn("mine", F.try_element_at(F.filter("groups", lambda x: (x["g"] == F.col("ball")) & (x["g"] >= 0)), F.lit(1)))
        rows = rows.withColumn("mine", F.coalesce("mine", F.try_element_at(F.filter("groups", lambda x: x["g"] == -1), F.lit(1))))
        rows = rows.withColumns({"g": F.col("mine")["g"], "k": F.pmod(F.xxhash64("node", F.lit(seed)), F.greatest(F.col("mine")[own], F.lit(1).cast("long")))})
        numbers = lambda x: F.when(x[other] > 0, F.sequence(F.lit(1).cast("long"), x[other])).otherwise(F.array().cast("array<long>"))
        meets = F.filter("groups", lambda x: (x["g"] == -1) | (x["g"] != F.col("g")))
        parts = F.flatten(F.transform(meets, lambda x: F.transform(numbers(x), lambda k: F.struct(x["g"].alias("og"), (k - 1).alias("ok")))))
        return rows.withColumn("part", F.explode(parts)).withColumns({"og": F.col("part")["og"], "ok": F.col("part")["ok"]})

    rest = ("node", "copies", "home", "reach", "ball", "member", "packed")
    stay = dealt(indexed.withColumn("cell", F.col("home")), "m", "v", 1).withColumn("member", F.lit(True))
    come = dealt(indexed.withColumn("cell", F.explode("cells")), "v", "m", 2).withColumn("member", F.lit(False))
    stay = stay.select("width", "cell", F.col("g").alias("ma"), F.col("k").alias("a"), F.col("og").alias("vb"), F.col("ok").alias("b"), *rest)
    come = come.select("width", "cell", F.col("og").alias("ma"), F.col("ok").alias("a"), F.col("g").alias("vb"), F.col("k").alias("b"), *rest)
    return reading(stay.unionByName(come).repartition(*BLOCK).sortWithinPartitions(*BLOCK), cut)


def within_balls(indexed: DataFrame) -> DataFrame:
    """Links of vectors in the same ball: (node, links, peer), as ``compare`` gives them."""
    inside = indexed.filter("ball >= 0").select("width", "ball", "node", "copies")
    totals = inside.groupBy("width", "ball").agg(F.sum("copies").alias("total"), F.min("node").alias("peer"))
    return inside.join(small(totals), ["width", "ball"]).filter("total > copies").select("node", (F.col("total") - F.col("copies")).alias("links"), "peer")


def compare(rows: DataFrame, index: dict[int, tuple], threshold: float) -> DataFrame:
    """Links within each block: (node, links, peer), peer being in the same component."""

    def block(t: pa.Table) -> pa.RecordBatch | None:
        member = t["member"].to_numpy()
        node, copies, home, reach, ball = (t[c].to_numpy() for c in ("node", "copies", "home", "reach", "ball"))
        width = t["width"][0].as_py()
        books = index[width][0] if width in index else None
        m, v = np.flatnonzero(member), np.flatnonzero(~member)
        if not len(m) or not len(v):
            return None
        x = unit(array_of(t["packed"].combine_chunks(), width))
        links = np.zeros(len(node), np.int64)
        names, same = np.unique(node, return_inverse=True)
        label = np.arange(len(names))
        near = None if books is None else half_distances(x[m], books)  # of members, to know which visitors' cells they visit themselves
        row = np.zeros(len(node), np.int64)
        row[m] = np.arange(len(m))
        for at in range(0, len(v), step := max(1, ROOM // len(m))):
            b, a = np.nonzero(x[v[at : at + step]] @ x[m].T >= threshold)
            a, b = m[a], v[at + b]
            # a pair met in both cells counts in the lower one; within a cell, from the lower node; in a ball, not here
            once = node[a] < node[b]
            if near is not None:
                i, j = np.divmod(home[b], len(books[1]))
                both = near[0][row[a], i] + near[1][row[a], j] <= reach[a]
                once = np.where(home[a] == home[b], once, ~both | (home[a] < home[b]))
            once &= (ball[a] < 0) | (ball[a] != ball[b])
            a, b = a[once], b[once]
            links += (np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))).astype(np.int64)
            label = join_labels(label, same[a], same[b])
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(names[label[same[some]]])], names=["node", "links", "peer"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, len(BLOCK)):
            if (out := block(t)) is not None:
                yield out

    return rows.mapInArrow(blocks, "node long, links long, peer long")


def near_duplicate_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """``(key, n_links, component_id, kept)`` of every row.

    Vectors that can have no cosine (see ``usable``) link with nothing. Equal vectors are one node
    that counts as often as it occurs. A null key is nobody's smallest. No rows give no rows.
    """
    spark = rows.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            data = (values - 0.0 + 0.0).astype("<f8").tobytes()  # no negative zero
            start = ends[0]
            packed = [data[8 * (s - start) : 8 * (e - start)] for s, e in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["key", "packed"])

    values = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    good = materialize(values.filter(usable("vector")).mapInArrow(pack, "key long, packed binary"), "vectors")
    nodes = good.groupBy("packed").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), (F.octet_length("packed") / 8).cast("int").alias("width"), "least", "copies", "packed"), "nodes")

    # lengths with a grid of several cells, at most one for every few thousand vectors; all others are one cell each
    index: dict[int, tuple] = {}
    for width, total in sorted(map(tuple, nodes.groupBy("width").count().filter(grid_side(F.col("count")) > 1).collect())):
        vectors = nodes.filter(F.col("width") == width)
        sample = sampled(vectors, FIT_ROWS, width, 42)[1]
        books = fit(sample, total)
        index[width] = books, measured_visits(vectors, books, sample, threshold), leaders(sample, threshold)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(1).to_numpy()
            plain = ~np.isin(widths, list(index))
            if n := int(plain.sum()):
                part, nothing = batch.filter(pa.array(plain)), pa.array(np.zeros(n, np.int64))
                listed = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32), nothing)
                yield pa.RecordBatch.from_arrays([*part.columns, nothing, pa.array(np.zeros(n)), pa.array(np.full(n, -1)), listed], names=names)
            for width in np.unique(widths[~plain]).tolist():
                part = batch.filter(pa.array(widths == width))
                books, visits, middles = index[width]
                x = unit(array_of(part.column(3), width))
                row, cell, reach = traverse(x, books, visits)
                order = np.argsort(row, kind="stable")
                listed = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(row, minlength=len(x)))).astype(np.int32), pa.array(cell[order]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(homes(x, books)), pa.array(reach), pa.array(balls_of(x, middles, threshold)), listed], names=names)

    names = ["node", "width", "copies", "packed", "home", "reach", "ball", "cells"]
    indexed = nodes.select("node", "width", "copies", "packed").mapInArrow(visit, "node long, width int, copies long, packed binary, home long, reach double, ball long, cells array<long>")
    indexed = materialize(indexed, "index")
    dealt = blocks_of(indexed)
    met = materialize(compare(dealt, index, threshold).unionByName(within_balls(indexed)), "met")
    discard(*dealt.reads)
    found = connected_components(met.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = nodes.join(links, "node", "left").join(found, "node", "left").select("packed", "least", F.coalesce("links", F.lit(0)).alias("links"), "copies", F.coalesce("component", "node").alias("label"))
    labelled = materialize(labelled, "labelled")
    # written, so that a join on a label that many share is between plain exchanges
    smallest = materialize(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "smallest")
    known = labelled.join(smallest, "label").select("packed", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = materialize(good.join(known, "packed").select(F.col("key").alias(key), "n_links", "component_id"), "linked")
    discard(good, nodes, indexed, met, labelled, smallest, *found.reads)
    # vectors that can have no cosine are alone
    alone = values.filter(~usable("vector")).select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
