"""SimHash near-duplicates: 64-bit fingerprints, linked through a Gray-order hierarchical index.

Equal fingerprints are one node from the start. Two fingerprints at most 4 bits apart agree on one
block of five (or on two of six, three of seven: the more fingerprints, the finer the cut, so
groups keep their size). Each group of fingerprints that share a block becomes one index:
fingerprints sorted by Gray rank, runs of 16 under a node that keeps the bits which all of them
share, runs of nodes under upper nodes. A query counts its differences against the shared bits from
the top down and drops a whole node once they exceed the limit; a node whose members are all within
the limit of each other is linked as a whole. Groups report a spanning forest, never all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, discard, keyed, materialize, reading, text_of
from .components import connected_components, join_labels

FAN_OUT = 16
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(texts: list[str], size: int = 4, seed: int = 42) -> np.ndarray:
    """Fingerprints of ``texts``: a bit is set where over half the shingles' XXH64 have it.

    A-Z are lower-cased, words are what ASCII white space parts, shingles have ``size`` words
    (a shorter text is one shingle); without words the fingerprint is 0.
    """
    digest = xxhash.xxh64_intdigest
    hashes, counts = [], []
    for text in texts:
        words = text.encode().translate(LOWER).split()
        joined = b" ".join(words)
        starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
        if len(words) <= size:
            made = [digest(joined, seed)] if words else []
        else:
            made = [digest(joined[s : e - 1], seed) for s, e in zip(starts, starts[size:])]
        hashes += made
        counts.append(len(made))
    n = np.array(counts, np.int64)
    out = np.zeros(len(n), np.uint64)
    if hashes:
        bits = np.unpackbits(np.array(hashes, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        some = n > 0
        sums = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * sums > n[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", size: int = 4) -> DataFrame:
    """``(key, fingerprint)`` of each row of ``docs(key, text)``; null text is empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = simhash(part.column(1).to_pylist(), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made)], names=[key, "fingerprint"])

    return docs.select(F.col(key).cast("long").alias(key), text_of().alias("text")).mapInArrow(compute, f"{key} long, fingerprint long")


def blocks(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``count`` blocks of 64 bits."""
    edges = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def group_keys(n: int, limit: int, leaf: int) -> list[Column]:
    """Group keys of a column ``fingerprint``: fingerprints at most ``limit`` bits apart share one.

    ``limit + c`` blocks, of which any ``c`` make a key: the smallest c whose keys part ``n``
    fingerprints into groups of about ``leaf``. One group if they are no more than that.
    """
    bits = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    if not bits:
        return [F.lit(0).cast("long")]
    cut = next(c for c in range(1, 9) if c == 8 or c * (64 // (limit + c)) >= bits)
    keys = []
    for t, chosen in enumerate(itertools.combinations(blocks(limit + cut), cut)):
        key, left = F.lit(t).cast("long"), bits
        for low, width in chosen:
            take = min(width, left)
            left -= take
            key = F.shiftleft(key, take).bitwiseOR(F.shiftrightunsigned("fingerprint", low + width - take).bitwiseAND(F.lit((1 << take) - 1)))
        keys.append(key)
    return keys


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where each number stands in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def gray_order(x: np.ndarray) -> np.ndarray:
    """Order of the rows of ``x`` (n, words), each row one long number, by Gray rank."""
    ranks, odd = [], np.zeros(len(x), np.uint64)
    for word in x.T:
        ranks.append(gray_rank(word) ^ (np.uint64(0) - odd))  # an odd number of bits before turns the order round
        odd = odd ^ (np.bitwise_count(word).astype(np.uint64) & np.uint64(1))
    return np.lexsort(ranks[::-1])


def apart(x: np.ndarray) -> np.ndarray:
    """Bits set in each row."""
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int16)


def index_levels(sorted_: np.ndarray, wanted: int = FAN_OUT) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes from the leaves' parents up: pattern, mask of shared bits, first member of each."""
    ones, any_, first, levels = sorted_, sorted_, np.arange(len(sorted_)), []
    while len(ones) > 1:
        at = np.arange(0, len(ones), wanted)
        ones, any_, first = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(any_, at), first[at]
        levels.append((ones, ~(ones ^ any_), first))
    return levels


def below(q: np.ndarray, node: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query with the children of its node; a level has ``width`` nodes."""
    q, node = np.repeat(q, FAN_OUT), (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
    return q[node < width], node[node < width]


def group_forest(found: np.ndarray, limit: int, room: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the distinct fingerprints at most ``limit`` bits apart: (members, their roots).

    ``room`` bounds the candidate pairs in memory at a time.
    """
    x = found[:, None][gray_order(found[:, None])]
    n, label, levels = len(x), np.arange(len(x)), index_levels(x)
    dense = [apart(~mask) <= limit for _, mask, _ in levels]
    ends = [np.append(first[1:], n) for _, _, first in levels]
    for k, (_, _, first) in enumerate(levels):  # members of a dense node are linked to its first
        for node in np.flatnonzero(dense[k]):
            members = np.arange(first[node] + 1, ends[k][node])
            label = join_labels(label, members, np.full(len(members), first[node]))
    step = max(1, room // max(n, 1))
    for at in range(0, n if levels else 0, step):
        q = np.repeat(np.arange(at, min(n, at + step)), len(levels[-1][0]))
        node = np.tile(np.arange(len(levels[-1][0])), min(n, at + step) - at)
        for k in range(len(levels) - 1, -1, -1):
            pattern, mask, first = levels[k]
            keep = (ends[k][node] > q + 1) & (apart((x[q] ^ pattern[node]) & mask[node]) <= limit)
            q, node = q[keep], node[keep]
            # all members are within the limit, and linked among themselves
            whole = dense[k][node] & (apart((x[q] ^ pattern[node]) | ~mask[node]) <= limit)
            label = join_labels(label, q[whole], first[node[whole]])
            q, node = below(q[~whole], node[~whole], len(levels[k - 1][0]) if k else n)
        linked = (node > q) & (apart(x[q] ^ x[node]) <= limit)
        label = join_labels(label, q[linked], node[linked])
    off = label != np.arange(n)
    return x[off, 0], x[label[off], 0]


def near_pairs(asked: np.ndarray, held: np.ndarray, limit: int, room: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``asked``, row of ``held``) at most ``limit`` bits apart, through an index on ``held``."""
    order = gray_order(held)
    x = held[order]
    levels = index_levels(x)
    for at in range(0, len(asked), step := max(1, room // max(len(x), 1))):
        q = np.arange(at, min(len(asked), at + step))
        node = np.zeros(len(q), int)
        for k in range(len(levels) - 1, -1, -1):
            pattern, mask, _ = levels[k]
            keep = apart((asked[q] ^ pattern[node]) & mask[node]) <= limit
            q, node = below(q[keep], node[keep], len(levels[k - 1][0]) if k else len(x))
        near = apart(asked[q] ^ x[node]) <= limit
        yield q[near], order[node[near]]


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Each run of rows with equal values in the first ``width`` columns."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in range(width)], axis=1)
        edges = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1).tolist(), len(key)]
        for s, e in itertools.pairwise(edges):
            if held and tuple(key[s]) != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(s, e - s))
            last = tuple(key[s])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_edges(dealt: DataFrame, limit: int) -> DataFrame:
    """Forests of the parts of ``dealt(group, part, fingerprint)``, each within one task."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            x = np.unique(t["fingerprint"].to_numpy().view(np.uint64))
            if len(x) > 1:
                a, b = group_forest(x, limit)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.select("group", "part", "fingerprint").repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(forest, "a long, b long")


def part_of(many: Column, seed: int, node: str = "node") -> Column:
    return F.pmod(F.xxhash64(node, F.lit(seed)), many)


def each_part(many: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), many - 1))


def open_blocks(members: DataFrame, classes: DataFrame, columns: tuple[str, ...], parts) -> DataFrame:
    """Blocks of those groups of ``members(group, lead, node, *columns)`` that hold several ``classes``.

    In each, every row outside the class of the lead meets every row of the group, as left and right
    side of the blocks (k0, k1, k2). ``parts(condition)`` is an aggregate: the blocks that such rows fill.
    """
    named = classes.select(F.col("node").alias("lead"), F.col("component").alias("lead_label"))
    labelled = members.join(classes, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    leads = materialize(members.select("group", "lead").distinct().join(named, "lead", "left").select("group", F.coalesce("lead_label", "lead").alias("lead_label")), "leads")
    labelled = materialize(labelled.join(leads, "group"), "labelled")
    outside = F.col("label") != F.col("lead_label")
    cut = materialize(labelled.groupBy("group").agg(parts(outside).alias("i"), parts(F.lit(True)).alias("j")).filter("i > 0"), "cut")
    rows = labelled.join(cut, "group")
    asking = rows.filter(outside).withColumns({"k1": part_of(F.col("i"), 1), "k2": each_part(F.col("j")), "left": F.lit(True)})
    asked = rows.withColumns({"k1": each_part(F.col("i")), "k2": part_of(F.col("j"), 2), "left": F.lit(False)})
    blocks = asking.unionByName(asked).select(F.col("group").alias("k0"), "k1", "k2", "left", "node", "label", *columns)
    return reading(blocks, leads, labelled, cut)


def block_edges(blocks: DataFrame, limit: int) -> DataFrame:
    """Links between the labels of ``blocks(k0, k1, k2, left, node, label)``, nodes being fingerprints."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            side, x = t["left"].to_numpy(), t["node"].to_numpy().view(np.uint64)[:, None]
            names, own = np.unique(t["label"].to_numpy(), return_inverse=True)
            label, left, right = np.arange(len(names)), np.flatnonzero(side), np.flatnonzero(~side)
            for a, b in near_pairs(x[left], x[right], limit) if len(left) and len(right) else ():
                label = join_labels(label, own[left[a]], own[right[b]])
            off = label != np.arange(len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names[off]), pa.array(names[label[off]])], names=["a", "b"])

    return blocks.repartition("k0", "k1", "k2").sortWithinPartitions("k0", "k1", "k2").mapInArrow(work, "a long, b long")


def link_fingerprints(distinct: DataFrame, limit: int = 4, leaf: int = 2048, most: int = 16_384) -> DataFrame:
    """``(node, component)`` of the distinct fingerprints that link with another one.

    A group of more than ``most`` is cut into parts, each with the group's least fingerprint; what is
    then still in several classes is compared across the parts, block by block.
    """
    keys = group_keys(distinct.count(), limit, leaf)
    dealt = distinct.select(F.explode(F.array(*keys)).alias("group"), "fingerprint") if len(keys) > 1 else distinct.select(keys[0].alias("group"), "fingerprint")
    large = dealt.groupBy("group").agg(F.count("*").alias("n"), F.min("fingerprint").alias("lead")).filter(F.col("n") > most)
    large = materialize(large.select("group", F.ceil(F.col("n") / most).alias("many"), "lead"), "large")
    found = large.count()
    if not found:
        discard(large)
        return connected_components(group_edges(dealt.withColumn("part", F.lit(0)), limit))
    cut = F.broadcast(large) if found <= 100_000 else large
    parted = dealt.join(cut, "group", "left").withColumn("part", F.coalesce(part_of(F.col("many"), 1, "fingerprint"), F.lit(0)))
    leads = large.select("group", each_part(F.col("many")).alias("part"), F.col("lead").alias("fingerprint"))
    first = materialize(group_edges(parted.select("group", "part", "fingerprint").unionByName(leads), limit), "first")
    joined = connected_components(first)
    classes = materialize(joined, "classes")
    discard(*joined.reads)
    members = dealt.join(cut, "group").select("group", "lead", F.col("fingerprint").alias("node"))
    parts = lambda c: F.ceil(F.count(F.when(c, 1)) / most)
    blocks = open_blocks(members, classes, (), parts)
    found = connected_components(first.unionByName(block_edges(blocks, limit)))
    discard(large, first, classes, *blocks.reads)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", size: int = 4, limit: int = 4) -> DataFrame:
    """``(key, fingerprint, component_id)``: each row's fingerprint and the smallest key reachable.

    Null text is empty; texts without words share fingerprint 0 and link like any other. A null key
    takes part and is nobody's smallest (a class of null keys alone has a null component_id).
    """
    made = materialize(fingerprints(docs, key, size), "fingerprints")
    distinct = materialize(made.groupBy("fingerprint").agg(F.min(key).alias("least")), "distinct")
    found = link_fingerprints(distinct.select("fingerprint"), limit)
    labelled = distinct.join(found, distinct["fingerprint"] == found["node"], "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("label"))
    # written, so that a join on a label that many share is between plain exchanges
    labelled = materialize(labelled, "labelled")
    discard(distinct, *found.reads)
    smallest = materialize(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "smallest")
    return made.join(labelled.join(smallest, "label").select("fingerprint", "component_id"), "fingerprint").select(key, "fingerprint", "component_id")


# ---- texts of a similarity or more ----

#: Differing bits of 128 up to which a pair is compared by its exact sets: four standard deviations
#: over the mean of a pair of just 0.8, whatever the number of rows.
WIDE_LIMIT = 36
#: Least hashes in a key, and keys of a text: a pair of just 0.8 shares none of them once in 66.
KEY_HASHES, KEYS = 4, 8
#: Rows, and shingles of their sets, that one side of a block has about.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20

_draw = np.random.default_rng(9)
ODD = _draw.integers(0, 1 << 63, KEY_HASHES * KEYS, np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _draw.integers(0, 1 << 63, KEY_HASHES * KEYS, np.uint64)
PLACE = _draw.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
#: Words whose hashes a task keeps.
WORDS_KEPT = 1 << 18


def stir(x: np.ndarray) -> np.ndarray:
    """Spread every bit of each number over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word -> its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 42)
        return out


def shingle_sets(texts: list[str], size: int, known: Words) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; words and shingles as in ``simhash``."""
    split = [t.encode().translate(LOWER).split() for t in texts]
    n = np.array(list(map(len, split)))
    ends = np.cumsum(n)
    h = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(split)), np.uint64, int(n.sum()))
    made = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size):
        made += h[k : k + len(made)] * PLACE[k % len(PLACE)]
    made = stir(made)
    out = []
    for words, e in zip(split, ends.tolist()):
        if len(words) >= size:
            own = np.sort(made[e - len(words) : e - size + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:  # a text of fewer words is one shingle
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), 43)] if words else [], np.uint64))
    return out


def profiles(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each set of shingles: its 128-bit digest (n, 2), 128-bit fingerprint (n, 2), size, and keys
    (n, KEYS). A key joins KEY_HASHES least hashes; sets with none have the keys 0."""
    n = np.array(list(map(len, sets)))
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<u8").reshape(-1, 2)
    prints, least = np.zeros((len(n), 2), np.uint64), np.zeros((len(n), len(ODD)), np.uint64)
    some = n > 0
    if some.any():
        h = np.concatenate(sets)
        starts = (np.cumsum(n) - n)[some]
        for k in range(2):
            bits = np.unpackbits((h if not k else stir(h + np.uint64(k))).view("u1").reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            prints[some, k] = np.packbits(2 * sums > n[some, None], axis=1, bitorder="little").view("<u8").ravel()
        for k, (a, b) in enumerate(zip(ODD, PLUS)):
            least[some, k] = np.minimum.reduceat(h * a + b, starts)
    keys = np.stack([stir(sum(stir(least[:, t * KEY_HASHES + k] + np.uint64(k)) for k in range(KEY_HASHES)) + np.uint64(t)) for t in range(KEYS)], axis=1)
    return digest, prints, n, np.where(some[:, None], keys, np.uint64(0))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    both = int((b[at] == a).sum()) if len(b) else 0
    return both / max(len(a) + len(b) - both, 1)


BLOCK = "k0 long, k1 long, k2 long, left boolean, node long, label long, w0 long, w1 long, weight long"


def candidates(t: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (left, right) of a block's rows whose labels differ and whose fingerprints and sizes allow ``similarity``."""
    side, label, weight = (t[c].to_numpy() for c in ("left", "label", "weight"))
    x = np.stack([t["w0"].to_numpy(), t["w1"].to_numpy()], axis=1).view(np.uint64)
    left, right = np.flatnonzero(side), np.flatnonzero(~side)
    if len(left) and len(right):
        for a, b in near_pairs(x[left], x[right], WIDE_LIMIT):
            a, b = left[a], right[b]
            may = (label[a] != label[b]) & (np.minimum(weight[a], weight[b]) >= similarity * np.maximum(weight[a], weight[b]))
            yield a[may], b[may]


def in_question(blocks: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``blocks`` that are in a pair of ``candidates``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            met = np.zeros(len(t), bool)
            for a, b in candidates(t, similarity):
                met[a] = met[b] = True
            if met.any():
                yield from t.filter(pa.array(met)).to_batches()

    return blocks.repartition("k0", "k1", "k2").sortWithinPartitions("k0", "k1", "k2").mapInArrow(work, BLOCK)


def verified(blocks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of ``blocks`` whose exact sets are similar enough: a forest over each block's labels."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            node, held = t["node"].to_numpy(), t["held"].combine_chunks()
            class_ = np.unique(t["label"].to_numpy(), return_inverse=True)[1]
            out, opened = [], {}

            def of(k: int) -> np.ndarray:
                if k not in opened:
                    opened[k] = np.frombuffer(held[k].as_buffer(), "<u8")
                return opened[k]

            for a, b in candidates(t, similarity):
                for p, q in zip(a.tolist(), b.tolist()):
                    if class_[p] != class_[q] and overlap(of(p), of(q)) >= similarity:
                        class_[class_ == class_[q]] = class_[p]
                        out.append((node[p], node[q]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = blocks.join(sets, "node").select("k0", "k1", "k2", "left", "node", "label", "w0", "w1", "weight", "held")
    return dealt.repartition("k0", "k1", "k2").sortWithinPartitions("k0", "k1", "k2").mapInArrow(work, "a long, b long")


def parts(rows: Column, weight: Column) -> Column:
    """Blocks for so many rows and shingles."""
    return F.ceil(rows / BLOCK_ROWS + weight / BLOCK_SHINGLES)


def links_of(nodes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` between ``nodes``, as many as join every class of texts of that similarity.

    Nodes that share a key form a group. First all of a group are compared with its least node; what
    that joins is one class. Then, in groups that still hold several classes, every row outside the
    least node's class is compared with every row of another class. Both go block by block: no
    task holds a group, and a group's blocks are as many as its rows need.
    """
    own = ("node", "w0", "w1", "weight")
    dealt = nodes.filter("weight > 0").select(F.explode(F.array(*(f"b{t}" for t in range(KEYS)))).alias("group"), *own).distinct()
    groups = dealt.groupBy("group").agg(F.count("*").alias("n"), F.min("node").alias("lead")).filter("n > 1")
    groups = materialize(groups.select("group", "lead"), "groups")
    members = materialize(dealt.join(groups, "group"), "members")
    discard(groups)

    wanted = members.select("node").distinct().join(nodes, "node").select("node", "__id", "__mark")
    known_sets = materialize(attach(keyed(docs, "text").select("__id", "__mark", text_of().alias("text")), wanted).select("node", "text").mapInArrow(set_writer(size), "node long, held binary"), "sets")

    # each member against its groups' least nodes
    pairs = materialize(members.filter("node <> lead").select("lead", *own).distinct(), "pairs")
    leads = pairs.groupBy("lead").agg(parts(F.count("*"), F.sum("weight")).alias("many"))
    leads = materialize(leads.join(nodes.select(F.col("node").alias("lead"), *(F.col(c).alias(f"lead_{c}") for c in own[1:])), "lead"), "leads")
    zero = F.lit(0).cast("long")
    right = pairs.join(leads.select("lead", "many"), "lead").select(F.col("lead").alias("k0"), part_of(F.col("many"), 1).alias("k1"), zero.alias("k2"), F.lit(False).alias("left"), "node", F.col("node").alias("label"), *own[1:])
    left = leads.select(F.col("lead").alias("k0"), each_part(F.col("many")).alias("k1"), zero.alias("k2"), F.lit(True).alias("left"), F.col("lead").alias("node"), F.col("lead").alias("label"), *(F.col(f"lead_{c}").alias(c) for c in own[1:]))
    first = materialize(verified(in_question(right.unionByName(left), similarity), known_sets, similarity), "first")
    discard(pairs, leads)

    # in groups of several classes, each row outside the least node's class against all of another class
    joined = connected_components(first)
    classes = materialize(joined, "classes")
    count = lambda c: parts(F.count(F.when(c, 1)), F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0)))
    blocks = open_blocks(members, classes, own[1:], count)
    second = materialize(verified(in_question(blocks, similarity), known_sets, similarity), "second")
    discard(known_sets, members, classes, *joined.reads, *blocks.reads)
    return reading(first.unionByName(second), first, second)


def set_writer(size: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held = [s.tobytes() for s in shingle_sets(part.column(1).to_pylist(), size, known)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.binary())], names=["node", "held"])

    return write


def nodes_of(docs: DataFrame, size: int) -> DataFrame:
    """One row for each distinct set of shingles of ``docs``: its least row, fingerprint, size and keys."""
    names = ["d0", "d1", "w0", "w1", "weight", *(f"b{t}" for t in range(KEYS))]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                digest, prints, n, keys = profiles(shingle_sets(part.column(3).to_pylist(), size, known))
                numbers = [*digest.T.view(np.int64), *prints.T.view(np.int64), n, *keys.T.view(np.int64)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(np.ascontiguousarray(v)) for v in numbers)], names=["none", "__id", "__mark", *names])

    narrow = keyed(docs, "text").select(F.col("doc_id").isNull().alias("none"), "__id", "__mark", text_of().alias("text"))
    made = narrow.mapInArrow(profile, "none boolean, __id long, __mark long, " + ", ".join(f"{c} long" for c in names))
    # rows are one node only if their whole sets are equal
    least = F.min(F.struct("none", "__id", "__mark")).alias("least")
    nodes = made.groupBy("d0", "d1").agg(least, *(F.first(c).alias(c) for c in names[2:])).withColumn("node", F.monotonically_increasing_id())
    return materialize(nodes.select("node", "least", "least.__id", "least.__mark", *names[2:]), "nodes")


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, one of each class of near-duplicates: that with the smallest doc_id.

    Texts are linked if they share ``similarity`` of their distinct shingles of ``size`` words, decided
    on the exact sets; texts with equal sets are one node, those without words among themselves.
    Null text is empty. Null doc_ids come last; of rows that repeat a doc_id one stays, any of those
    with the same text being as good. No rows give no rows.
    """
    nodes = nodes_of(docs, size)
    links = links_of(nodes, docs, size, similarity)
    found = connected_components(links)
    discard(*links.reads)
    chosen = nodes.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("least"))
    chosen = materialize(chosen.select("least.__id", "least.__mark"), "chosen")
    discard(nodes, *found.reads)
    return reading(attach(keyed(docs, "text"), chosen).select(*docs.columns), chosen)
