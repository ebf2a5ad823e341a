"""Token-ID output: flat files of unsigned integers with 64-bit document offsets.

``write_tokens`` deals the documents by ascending doc_id to shards. Each shard is two files:
``*.bin`` holds the ids of its documents one after another (16 bits where the vocabulary allows,
else 32), and ``*.idx`` holds MAGIC, the width in bytes and the number of documents (both unsigned
64-bit), then ``n + 1`` unsigned 64-bit offsets counted in ids, ``n`` signed 64-bit doc_ids and
``n`` bytes that are 1 where the doc_id is null. The manifest has one row a shard; the ids before
a shard are the prefix sum of the shards' sizes.

Every attempt of a task writes under a name of its own, and only names that Spark got back from
finished tasks are in the manifest: lost executors and repeated tasks leave no trace in a result.
"""

from __future__ import annotations

import contextlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, text_of
from .encoding import encoder, id_type

MAGIC = b"SHELFTOK"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that Spark names, and the path there."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


@dataclass(frozen=True)
class Shard:
    number: int
    name: str
    documents: int
    tokens: int
    base: int


def write_tokens(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, folder: str | None = None) -> tuple[str, list[Shard]]:
    """Encode ``docs(doc_id, text)`` and write the shards; returns the folder and its manifest.

    Null text is empty: the document is then its end id. Rows with a null doc_id come first, and
    repeated doc_ids follow one another, each with its own ids. An empty table makes no shard.
    The manifest comes to the driver: a row of numbers a shard, none a document.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    kind = id_type(tokenizer, end_id)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part, code = TaskContext.get().partitionId(), encoder(tokenizer, spaces, kind)
        name, end = f"{part:06d}-{uuid.uuid4().hex}", np.array([end_id], kind).tobytes()
        ids, offsets = [], [0]
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}.bin") as out:
            for batch in itertools.chain([first], batches):
                ids.append(batch.column(0))
                for text in batch.column(1).to_pylist():
                    out.write(data := code.encode(text) + end)
                    offsets.append(offsets[-1] + len(data) // len(end))
        column = pa.chunked_array(ids)
        with store.open_output_stream(f"{path}/{name}.idx") as out:
            out.write(MAGIC + np.array([len(end), len(column)], "<u8").tobytes() + np.array(offsets, "<u8").tobytes())
            out.write(column.fill_null(0).to_numpy().astype("<i8").tobytes())
            out.write(column.is_null().to_numpy().astype("u1").tobytes())
        yield pa.RecordBatch.from_pydict({"number": pa.array([part], pa.int32()), "name": [name], "documents": [len(column)], "tokens": [offsets[-1]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    sorted_ = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    found = sorted(sorted_.mapInArrow(shard, "number int, name string, documents long, tokens long").collect())
    bases = itertools.accumulate((r.tokens for r in found), initial=0)
    return folder, [Shard(r.number, r.name, r.documents, r.tokens, base) for r, base in zip(found, bases)]


@contextlib.contextmanager
def mapped(folder: str, name: str):
    """A shard's ids (memory-mapped where the folder is a local or mounted one), offsets and doc_ids."""
    store, path = filesystem(folder)
    with contextlib.ExitStack() as stack:
        def data(suffix):
            full = f"{path}/{name}.{suffix}"
            if isinstance(store, pafs.LocalFileSystem):
                return np.memmap(full, "u1", "r")
            return np.frombuffer(stack.enter_context(store.open_input_file(full)).read_buffer(), "u1")

        index = data("idx")
        if index[:8].tobytes() != MAGIC:
            raise ValueError(f"{name}.idx is no token index")
        width, n = (int(x) for x in index[8:24].view("<u8"))
        at = 24 + 8 * (n + 1)
        offsets, ids, nulls = index[24:at].view("<u8"), index[at : at + 8 * n].view("<i8"), index[at + 8 * n :]
        yield data("bin").view(f"<u{width}"), offsets, ids, nulls


def read_tokens(spark: SparkSession, folder: str, shards: list[Shard]) -> DataFrame:
    """One row a document, from the files alone: its place among all ids and their checksum.

    Null doc_ids come back null, repeated ones as often as they were written; no shards give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with mapped(folder, row["name"]) as (tokens, offsets, ids, nulls):
                    for at in range(0, len(ids), 10_000):
                        edge = offsets[at : at + 10_001].astype(np.int64)
                        sums = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in itertools.pairwise(edge.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids[at : at + 10_000], pa.int64(), mask=nulls[at : at + 10_000].astype(bool)),
                                pa.array(edge[:-1] + row["base"]),
                                pa.array(np.diff(edge)),
                                pa.array(sums, pa.int64()),
                                pa.array([row["number"]] * len(sums), pa.int32()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                        )

    rows = [(s.number, s.name, s.base) for s in shards]
    listed = spark.createDataFrame(rows, "number int, name string, base long")
    return listed.repartition(max(1, len(rows)), "number").mapInArrow(read, READ_SCHEMA)
