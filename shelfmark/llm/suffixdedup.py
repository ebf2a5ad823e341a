"""Exact repeated passages: suffixes ordered only through ``DEPTH`` bytes, digit by digit.

Two windows of 200 bytes are equal if and only if their suffixes fall into one group of a
most-significant-digit radix sort that stops at depth 200. To move every suffix would shuffle
sixteen times the input. The passes therefore take a digit inside the window first: of the 169
grams of 32 bytes in a window, the one with the least hash. Equal windows choose the same gram at
the same place, so the suffixes that start at chosen grams (one in 85) stand for all windows around
them. A group that a pass leaves alone holds no repeat and goes.

1. By the gram's 32 bytes. What occurs once is dropped.
2. By a 128-bit digest of all that any window with this gram can hold (168 bytes on either side). Two
   alike: every window with the gram is a repeat.
3. Where a gram has over ``LOCAL`` different surroundings: by 84 more bytes to the left or to the
   right, one of which each window holds.
4. Through all 200 bytes, for each place of the gram in the window, within what is still together:
   passes over the bytes themselves split the groups digit by digit, first over the bytes that all of
   the windows hold (eight a pass), then one byte further to the left and to the right. Windows whose
   groups of both sides agree are equal; no hash decides here. Groups that are still over ``LOCAL`` do
   this by a shuffle on 128-bit digests of the windows.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, new_folder, reading, text_of

DEPTH, GRAM = 200, 32
REACH = DEPTH - GRAM
HALF = REACH // 2
#: Contexts that step 4 compares within a task (368 bytes each).
LOCAL = 20_000
#: Files of the table of texts, from which on its rows are dealt to their buckets before writing.
FILES = 20_000
#: Bytes that are hashed at a time.
AT_ONCE = 1 << 19

_draw = np.random.default_rng(20)
#: A random code of each byte value, and of the powers that codes are multiplied with.
CODE = _draw.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
POWER = np.cumprod(np.full(GRAM + 2 * REACH, BASE, np.uint64))


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``data`` of the grams that some window of their document chooses, and their hashes."""
    if len(data) < DEPTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = CODE[data]
    for step in (1, 2, 4, 8, 16):
        gram = gram[:-step] * np.uint64(pow(int(BASE), step, 1 << 64)) + gram[step:]
    value = ((gram ^ gram >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    # windows and grams that lie within one document
    inside = np.zeros(len(data) + 1, np.int8)
    long = sizes >= DEPTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, (starts + sizes - DEPTH + 1)[long], -1)
    window = np.cumsum(inside[:-1], dtype=np.int8)[: len(data) - DEPTH + 1].astype(bool)
    least = spread(value, np.minimum)
    least[~window] = 0
    chosen = spread(np.concatenate([np.zeros(REACH, np.uint32), least, np.zeros(REACH, np.uint32)]), np.maximum)
    covered = np.zeros(len(data) + 1, np.int8)
    np.add.at(covered, starts[long], 1)
    np.add.at(covered, (starts + sizes - GRAM + 1)[long], -1)
    at = np.flatnonzero((chosen == value) & np.cumsum(covered[:-1], dtype=np.int8)[: len(value)].astype(bool))
    return at, gram[at]


def spread(x: np.ndarray, of: np.ufunc) -> np.ndarray:
    """``of`` over each run of REACH + 1 values."""
    width, wanted = 1, REACH + 1
    while 2 * width <= wanted:
        x, width = of(x[:-width], x[width:]), 2 * width
    return of(x[: len(x) - (wanted - width)], x[wanted - width :])


def contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, 2 * REACH + GRAM) bytes around each place of one document, 0 beyond it; bytes there are to the left and right."""
    padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(REACH, np.uint8)])
    left, right = np.minimum(at, REACH), np.minimum(len(data) - GRAM - at, REACH)
    return padded[at[:, None] + np.arange(2 * REACH + GRAM)], left, right


def coded(rows: np.ndarray) -> np.ndarray:
    return (CODE[rows] * POWER[: rows.shape[1]]).sum(axis=1, dtype=np.uint64)


def wholes_of(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """128-bit digests (n, 2) of all around a gram, and of how much that is."""
    size = np.stack([left, right], axis=1).astype("<i4")
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(a.tobytes() + b.tobytes()) for a, b in zip(rows, size)), "<i8").reshape(-1, 2)


def halves_of(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with HALF more bytes to the left and to the right (0: not there)."""
    to_left = np.where(left >= HALF, coded(rows[:, REACH - HALF : REACH + GRAM]), np.uint64(0))
    to_right = np.where(right >= HALF, coded(rows[:, REACH : REACH + GRAM + HALF]), np.uint64(0))
    return to_left, to_right


def split_classes(class_: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Class numbers after one more digit; only classes in which the digit differs are looked at."""
    size = int(class_.max(initial=0)) + 1
    shown = np.zeros(size, digit.dtype)
    shown[class_] = digit
    differ = np.zeros(size, bool)
    differ[class_[digit != shown[class_]]] = True
    some = np.flatnonzero(differ[class_])
    if not len(some):
        return class_
    order = some[np.lexsort((digit[some], class_[some]))]
    new = (class_[order][1:] != class_[order][:-1]) | (digit[order][1:] != digit[order][:-1])
    out = class_.copy()
    out[order] = size + np.append(0, np.cumsum(new))
    return np.unique(out, return_inverse=True)[1] if size + len(some) > 4 * len(class_) else out


def shared(class_: np.ndarray) -> np.ndarray:
    """Rows whose class has another row."""
    return np.bincount(class_)[class_] > 1 if len(class_) else np.zeros(0, bool)


def equal_windows(rows: np.ndarray, left: np.ndarray, right: np.ndarray, class_: np.ndarray, to_left: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the gram in the window, rows whose window there equals another row's) for one half of the places."""
    places = range(HALF, REACH + 1) if to_left else range(HALF + 1)
    some = np.flatnonzero((left >= places[0]) & (right >= REACH - places[-1]))
    # bytes that all windows hold: the gram and HALF more on one side
    first = REACH - HALF if to_left else REACH
    for at in range(first, first + GRAM + HALF, 8):
        some = some[shared(class_[some])]
        width = min(8, first + GRAM + HALF - at)
        digit = np.zeros((len(some), 8), np.uint8)
        digit[:, :width] = rows[some, at : at + width]
        class_ = class_.copy()
        class_[some] = split_classes(class_[some], digit.view(np.uint64).ravel()) + int(class_.max(initial=0)) + 1
        class_ = np.unique(class_, return_inverse=True)[1]
    some = some[shared(class_[some])]
    rows, left, right, class_ = rows[some], left[some], right[some], np.unique(class_[some], return_inverse=True)[1]
    if not len(some):
        return
    fewest = REACH - places[-1]  # bytes to the right that the last place needs
    to_right = [class_]
    for q in range(fewest, REACH - places[0]):
        to_right.append(split_classes(to_right[-1], rows[:, REACH + GRAM + q]))
    for place in places:
        if place > places[0]:
            class_ = split_classes(class_, rows[:, REACH - place])
        beside_ = to_right[REACH - place - fewest]
        here = np.flatnonzero((left >= place) & (right >= REACH - place))
        here = here[shared(class_[here]) & shared(beside_[here])]
        key = class_[here] * (int(beside_.max()) + 1) + beside_[here]
        order = np.argsort(key)
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        yield place, some[here[order[np.union1d(same, same + 1)]]]


def window_digests(rows: np.ndarray, left: np.ndarray, right: np.ndarray, to_left: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the gram in the window, rows that have such a window, its 128-bit digest) for one half of the places."""
    for place in range(HALF, REACH + 1) if to_left else range(HALF + 1):
        some = np.flatnonzero((left >= place) & (right >= REACH - place))
        cut = np.ascontiguousarray(rows[some, REACH - place : REACH - place + DEPTH])
        yield place, some, np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in cut), "<i8").reshape(-1, 2)


def store(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    """``docs`` as bytes in a table bucketed by a row number: later joins on it don't move the texts."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"shelfmark_{uuid.uuid4().hex}"
    rows = docs.select(*(F.col(c) for c in keep), text_of().cast("binary").alias("__data")).withColumn("__row", F.monotonically_increasing_id())
    if rows.rdd.getNumPartitions() * n > FILES:
        rows = rows.repartition(n, "__row")
    rows.write.bucketBy(n, "__row").sortBy("__row").option("path", new_folder(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the plan knows them; the catalogue keeps nothing
    return texts, n


def batched(rows: list[tuple]) -> Iterator[list[np.ndarray]]:
    """Columns of equal-length arrays, joined."""
    if rows:
        yield [np.concatenate(c) for c in zip(*rows)]


def find_anchors(texts: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, data = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            size = np.fromiter(map(len, data), np.int64, len(data))
            group = np.cumsum(size) // AT_ONCE
            for part in np.split(np.arange(len(data)), np.flatnonzero(np.diff(group)) + 1):
                if not len(part):
                    continue
                starts = np.cumsum(size[part]) - size[part]
                at, gram = anchors(np.frombuffer(b"".join(data[k] for k in part), np.uint8), starts, size[part])
                which = np.searchsorted(starts, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(numbers[part][which]), pa.array((at - starts[which]).astype(np.int32))], names=["gram", "row", "at"])

    return texts.select("__row", "__data").mapInArrow(find, "gram long, row long, at int")


def with_places(texts: DataFrame, places: DataFrame, n: int, *more: str) -> DataFrame:
    """The texts that have places, with arrays of them; only the places move."""
    listed = places.repartition(n, "row").groupBy("row").agg(F.collect_list(F.struct("at", *more)).alias("places"))
    joined = texts.select("__row", "__data").join(listed.hint("merge"), F.col("__row") == F.col("row"))
    return joined.select("row", "__data", *(F.col("places")[c].alias(c) for c in ("at", *more)))


def around(texts: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
    """Step 2: a hash of all around each repeated gram, and where a window with it ends at most."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, data, at, gram in zip(*(c.to_pylist() for c in batch.columns)):
                at, gram = np.array(at, np.int64), np.array(gram, np.int64)
                for k in range(0, len(at), 4096):
                    cut = at[k : k + 4096]
                    found = contexts(np.frombuffer(data, np.uint8), cut)
                    rows.append((gram[k : k + 4096], np.full(len(cut), row), cut, cut + GRAM + found[2], *np.ascontiguousarray(wholes_of(*found).T)))
            for columns in batched(rows):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "row", "at", "end", "w0", "w1"])

    return with_places(texts, repeated, n, "gram").mapInArrow(look, "gram long, row long, at long, end long, w0 long, w1 long")


def beside(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Step 3: (gram, side, mark) of each place in ``wanted``, both sides where they are."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, data, at, gram, count in zip(*(c.to_pylist() for c in batch.columns)):
                at, gram, count = (np.array(x, np.int64) for x in (at, gram, count))
                for k in range(0, len(at), 4096):
                    cut = slice(k, k + 4096)
                    for side, mark in enumerate(halves_of(*contexts(np.frombuffer(data, np.uint8), at[cut]))):
                        some = np.flatnonzero(mark)
                        rows.append((gram[cut][some], np.full(len(some), side), mark.view(np.int64)[some], np.full(len(some), row), at[cut][some], count[cut][some]))
            for columns in batched(rows):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "side", "mark", "row", "at", "n"])

    return with_places(texts, wanted, n, "gram", "n").mapInArrow(look, "gram long, side long, mark long, row long, at long, n long")


def compare_local(dealt: DataFrame) -> DataFrame:
    """Step 4 within tasks, for rows sorted by (gram, side, mark): least and greatest repeated place."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([t[c].to_numpy() for c in ("gram", "side", "mark")], axis=1)
        group = np.cumsum(np.concatenate([[True], (np.diff(key, axis=0) != 0).any(axis=1)]))
        left, right = t["left"].to_numpy(), t["right"].to_numpy()
        rows = np.frombuffer(b"".join(t["context"].to_pylist()), np.uint8).reshape(len(t), -1)
        low, high = np.full(len(t), DEPTH), np.full(len(t), -1)
        for side in (0, 1):  # 2: both
            of = np.flatnonzero((key[:, 1] == side) | (key[:, 1] == 2))
            if not len(of):
                continue
            for place, some in equal_windows(rows[of], left[of], right[of], group[of], side == 0):
                twice = of[some]
                low[twice], high[twice] = np.minimum(low[twice], place), np.maximum(high[twice], place)
        hit = np.flatnonzero(high >= 0)
        at = t["at"].to_numpy()[hit]
        yield pa.RecordBatch.from_arrays([pa.array(t["row"].to_numpy()[hit]), pa.array(at - high[hit]), pa.array(at + DEPTH - low[hit])], names=["row", "start", "end"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 8 * LOCAL:
                t = pa.Table.from_batches(held)
                key = np.stack([t[c].to_numpy() for c in ("gram", "side", "mark")], axis=1)
                cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
                if cut:
                    yield from work(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield from work(pa.Table.from_batches(held))

    return dealt.mapInArrow(groups, "row long, start long, end long")


def fetch(texts: DataFrame, wanted: DataFrame, n: int, shuffled: bool) -> DataFrame:
    """Contexts of ``wanted``; with ``shuffled`` the hashes of their windows instead, a row each."""
    names = ["gram", "side", "mark", "row", "at", "left", "right"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at, gram, side, mark in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(data, np.uint8)
                for k in range(0, len(at), 1024):
                    cut = slice(k, k + 1024)
                    places, sides = np.array(at[cut], np.int64), np.array(side[cut])
                    around_, left, right = contexts(data, places)
                    if not shuffled:
                        columns = [gram[cut], sides, mark[cut], np.full(len(places), row), places, left, right]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([x.tobytes() for x in around_], pa.binary())], names=[*names, "context"])
                        continue
                    for s in (0, 1):
                        of = np.flatnonzero(sides == s)
                        grams, marked = np.array(gram[cut])[of], np.array(mark[cut])[of]
                        for place, some, code in window_digests(around_[of], left[of], right[of], s == 0):
                            columns = [grams[some], np.full(len(some), s), marked[some], np.full(len(some), row), places[of][some], np.full(len(some), place), *np.ascontiguousarray(code.T)]
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*names[:5], "place", "c0", "c1"])

    longs = ", ".join(f"{c} long" for c in (names[:5] + ["place", "c0", "c1"] if shuffled else names))
    return with_places(texts, wanted, n, "gram", "side", "mark").mapInArrow(look, longs if shuffled else f"{longs}, context binary")


def repeated_spans(texts: DataFrame, n: int) -> DataFrame:
    """``(row, start, end)``: spans that repeated windows cover together; they may overlap."""
    found = materialize(find_anchors(texts), "anchors")
    # written, so that the join on grams that many places share is between plain exchanges
    more = materialize(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "more")
    seen = materialize(around(texts, found.join(more, "gram", "left_semi"), n), "around")
    discard(found, more)

    wholes = seen.groupBy("gram", "w0", "w1").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("one"))
    wholes = materialize(wholes.select("gram", "w0", "w1", "n", "one.row", "one.at"), "wholes")
    repeats = seen.join(wholes.filter("n > 1").select("gram", "w0", "w1"), ["gram", "w0", "w1"], "left_semi")
    spans = repeats.select("row", F.greatest(F.col("at") - REACH, F.lit(0)).alias("start"), "end")

    # one of each context, where a context seen once has company
    size = lambda rows, *keys: rows.groupBy(*keys).agg(F.count("*").alias("contexts"), F.min("n").alias("fewest")).filter("contexts > 1 and fewest = 1").drop("fewest")
    companies = materialize(size(wholes, "gram"), "companies")
    wanted = materialize(wholes.drop("w0", "w1").join(companies, "gram"), "wanted")
    discard(companies)
    reads = [seen, wholes, wanted]
    keys = ["gram", "side", "mark"]
    few = wanted.filter(F.col("contexts") <= LOCAL).withColumns({"side": F.lit(2).cast("long"), "mark": F.lit(0).cast("long")}).select(*keys, "row", "at")
    many, windows = wanted.filter(F.col("contexts") > LOCAL), None
    if not many.isEmpty():
        both = materialize(beside(texts, many.select("gram", "row", "at", "n"), n), "sided")
        sided = materialize(both.join(size(both, *keys), keys), "sided")
        discard(both)
        reads.append(sided)
        few = few.unionByName(sided.filter(F.col("contexts") <= LOCAL).select(*keys, "row", "at"))
        hot = sided.filter(F.col("contexts") > LOCAL)
        windows = None if hot.isEmpty() else materialize(fetch(texts, hot, n, True), "windows")
    dealt = fetch(texts, few, n, False).repartition(*keys).sortWithinPartitions(*keys)
    spans = spans.unionByName(compare_local(dealt))
    if windows is not None:
        reads.append(windows)
        at = [*keys, "place", "c0", "c1"]
        twice = windows.groupBy(*at).agg(F.count("*").alias("n")).filter("n > 1").select(*at)
        ends = windows.join(twice, at, "left_semi").groupBy("row", "at").agg(F.min("place").alias("low"), F.max("place").alias("high"))
        spans = spans.unionByName(ends.select("row", (F.col("at") - F.col("high")).alias("start"), (F.col("at") + DEPTH - F.col("low")).alias("end")))
    return reading(spans, *reads)


def mark_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row, its bytes as ``data``, and ``spans`` to remove, sorted and apart.

    Texts are UTF-8 bytes, null is empty, matches never cross documents; repeated rows are documents
    of their own. ``keep`` may not name __data or __row.
    """
    texts, n = store(docs, keep)
    found = repeated_spans(texts, n)
    spans = materialize(found, "spans")
    discard(*found.reads)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(1).to_pylist():
                s, e = np.array([(x["start"], x["end"]) for x in found]).T
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.concatenate([[True], s[1:] > e[:-1]])
                last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
                out.append([{"start": a, "end": b} for a, b in zip(s[new].tolist(), e[last].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["row", "spans"])

    listed = spans.distinct().repartition(n, "row").groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    merged = listed.mapInArrow(merge, "row long, spans array<struct<start: bigint, end: bigint>>").repartition(n, "row")
    return texts.join(merged.hint("merge"), F.col("__row") == F.col("row"), "left").select(*keep, F.col("__data").alias("data"), "spans")


def digest(marked: DataFrame) -> DataFrame:
    """Sizes and the checksum of what is kept of each document.

    A row for each row of ``marked``, repeated ones too; no spans (null or empty) keep all; no rows give no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data, spans in zip(*(c.to_pylist() for c in batch.columns)):
                edges = [0, *itertools.chain.from_iterable((x["start"], x["end"]) for x in spans or ()), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((doc_id, len(data), len(data) - len(kept), len(spans or ()), hashlib.sha256(kept).hexdigest()))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.select(F.col("doc_id").cast("long"), "data", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
