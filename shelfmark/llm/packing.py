"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Every partition packs its own pieces best-fit, longest first. Bins with little room left are
final. The others go on as single items: they are dealt to fewer groups, each group packs them
best-fit again, and so on until one group holds all that is open or merging gains nothing. A group
never has more than ``group_limit`` items, so no task grows with the input.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of
from .encoding import encoder, id_type

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"


def pieces(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, capacity: int) -> DataFrame:
    """The documents' pieces of at most ``capacity`` ids, each with an item number of its own.

    Null text is empty: one piece, the end id. Repeated rows are documents of their own.
    """
    kind = id_type(tokenizer, end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, number = encoder(tokenizer, spaces, kind), TaskContext.get().partitionId() << 36
        end, width = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(code.encode(text) + end, kind).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), number))
                    number += 1
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "item"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each item the item that opened its bin, and its place there."""
    opener, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they have left
    some = 0  # bit r is set where room[r] has a bin
    order = np.argsort(-lengths, kind="stable")
    for k, n in zip(order.tolist(), lengths[order].tolist()):
        if fits := some >> n:
            left = n + (fits & -fits).bit_length() - 1
            bin_ = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            left, bin_ = capacity, k
        opener[k], offset[k] = bin_, capacity - left
        left -= n
        room[left].append(bin_)
        some |= 1 << left
    return opener, offset


def pack_round(items: DataFrame, capacity: int) -> DataFrame:
    """Pack each partition of ``items(item, length)``: adds bin (its first item), place and used."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        item, length = (whole.column(c).to_numpy() for c in ("item", "length"))
        opener, offset = best_fit(length, capacity)
        used = np.bincount(opener, length, len(item)).astype(np.int64)[opener]
        for at in range(0, len(item), 50_000):
            cut = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (item, item[opener], offset, used)], names=["item", "bin", "place", "used"])

    return items.select("item", "length").mapInArrow(pack, "item long, bin long, place long, used long")


def pack(found: DataFrame, capacity: int, slack: int = 16, group_limit: int = 50_000, least_gain: int = 1) -> DataFrame:
    """Add sequence_id and offset to ``found(item, length, ...)``; no rows give no rows.

    ``item`` is unique and not null, and no length exceeds ``capacity``. Other columns are kept.

    ``slack``: a bin with this many ids of room or fewer is full. ``group_limit``: the most bins
    that one group packs again; a further round, dealt anew, follows until a single group held all
    open bins, or until a round saves fewer than ``least_gain`` of them: by default none.
    """
    found = materialize(found, "pieces")
    level = materialize(pack_round(found, capacity), "packed")
    placed = level.select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    for turn in itertools.count():
        # the item at place 0 stands for its bin
        waiting = level.filter((F.col("place") == 0) & (F.col("used") < capacity - slack)).select(F.col("bin").alias("item"), F.col("used").alias("length"))
        n = waiting.count()
        groups = -(-n // group_limit)
        if n < 2:
            break
        dealt = waiting.repartition(1) if groups == 1 else waiting.repartition(groups, F.xxhash64("item", F.lit(turn)))
        level = materialize(pack_round(dealt, capacity), "packed")
        moved = level.select(F.col("item").alias("sequence_id"), F.col("bin").alias("to"), "place")
        placed = placed.join(moved, "sequence_id", "left").select("item", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("place", F.lit(0))).alias("offset"))
        if groups == 1 or n - level.filter("place = 0").count() < least_gain:
            break
        placed = materialize(placed, "placed")  # many rounds would make one long plan
    return found.join(placed, "item").drop("item")


def pack_documents(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, capacity: int) -> DataFrame:
    """Encode, cut and pack ``docs(doc_id, text)``: one row a piece, with its sequence and place.

    Null text is empty: its end id alone is a piece. Null doc_ids are kept, repeated rows are packed each
    for itself, other columns don't count, no rows give no rows.
    """
    return pack(pieces(docs, tokenizer, spaces, end_id, capacity), capacity)
