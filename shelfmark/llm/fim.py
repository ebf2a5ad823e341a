"""Fill-in-the-middle: documents cut into prefix, middle and suffix and written in another order.

A text is cut at unit borders (lines). Its pieces, chunks of whole units of one part (a unit of over
CHUNK characters is several pieces), carry the document's key and their place in the output; a secondary
sort (repartition by document, sort within the partition by document and place) brings them to a task in
output order, which streams them into running digests and never holds a document. To restore a text the
same stream finds the marks in the output, gives each piece its place in the text, and the pieces are
sorted once more, within their partitions, and streamed again.

Cuts and forms come from a digest of doc_id and a salt, so a rerun makes the same output.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Characters of a piece, but for the units it ends with; characters that a task emits at once.
CHUNK, BATCH = 1 << 15, 1 << 22
UNIT = re.compile(r"[^\n]*\n|[^\n]+")
PIECES = "doc_id long, mark long, part int, turn int, place long, n long, form string, piece string"
PLACED = "doc_id long, mark long, part int, turn int, n long, form string, at long, output_sha256 string, prefix_chars long, middle_chars long, piece string"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
ROW = ["doc_id", "mark", "part", "turn"]


@dataclass(frozen=True)
class Rule:
    """How documents are cut: of 100, ``rate`` are cut at all, and ``suffix_first`` of these have the suffix first."""

    salt: str = "7"
    rate: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def order(self, form: str) -> str:
        """Parts (p, m, s) in the order of the output."""
        return {"psm": "psm", "spm": "spm"}.get(form, "p")

    def mark(self, part: str) -> str:
        return {"p": self.prefix, "s": self.suffix, "m": self.middle}[part]

    def draws(self, doc_id: int | None) -> list[int]:
        digest = hashlib.sha256(f"{self.salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def unit_count(text: str) -> int:
    return text.count("\n") + (text != "" and not text.endswith("\n"))


def plan(text: str, doc_id: int | None, rule: Rule) -> tuple[int, str, int, int]:
    """Number of units, form, and the units before the middle and before the suffix."""
    n, (a, b, c, d) = unit_count(text), rule.draws(doc_id)
    if not text or any(m in text for m in rule.marks) or c % 100 >= rule.rate:
        return n, "plain", n, n
    cut = sorted((a % (n + 1), b % (n + 1)))
    return n, "spm" if d % 100 < rule.suffix_first else "psm", *cut


def chunks(text: str, edges: tuple[int, int], chunk: int) -> Iterator[tuple[str, str]]:
    """(part, piece) in the order of the text: units of one part, together until they have ``chunk`` characters."""
    held, size, part = [], 0, "p"
    for k, found in enumerate(UNIT.finditer(text)):
        now = "p" if k < edges[0] else "m" if k < edges[1] else "s"
        if held and (now != part or size >= chunk):
            yield part, "".join(held)
            held, size = [], 0
        part, unit = now, found.group()
        while size + len(unit) > 2 * chunk:
            cut = 2 * chunk - size
            yield part, "".join(held) + unit[:cut]
            held, size, unit = [], 0, unit[cut:]
        held.append(unit)
        size += len(unit)
    if held:
        yield part, "".join(held)


def pieces(docs: DataFrame, rule: Rule = Rule(), chunk: int = CHUNK) -> DataFrame:
    """The output of each row of ``docs(doc_id, text)`` as pieces with their place in it.

    Null text is empty: one empty piece, form plain. A null doc_id draws as an empty number. Rows that
    repeat are documents of their own: ``part`` and ``turn`` (input partition, number among equal rows
    there) tell them apart. Other columns don't count. No rows give no pieces.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("part", pa.int32()), ("turn", pa.int32()), ("place", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("piece", pa.string())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, turns, rows, size = TaskContext.get().partitionId(), Counter(), [], 0
        for batch in batches:
            for doc_id, mark, text in zip(*(batch.column(k) for k in range(3))):
                doc_id, mark, text = doc_id.as_py(), mark.as_py(), text.as_py()
                key = (doc_id, mark, here, turns[doc_id, mark])
                turns[doc_id, mark] += 1
                n, form, first, second = plan(text, doc_id, rule)
                order = rule.order(form)
                # places of a part follow those of the parts before it in the output
                next_ = {part: order.index(part) << 40 for part in order}
                started = set() if form != "plain" else set(order)
                for part, piece in [*chunks(text, (first, second), chunk)] or [("p", "")]:
                    lead = "" if part in started else rule.mark(part)
                    started.add(part)
                    rows.append((*key, next_[part], n, form, lead + piece))
                    next_[part] += 1
                    size += len(piece)
                rows += [(*key, next_[part], n, form, rule.mark(part)) for part in order if part not in started]
                if size > BATCH or len(rows) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text"))
    return rows.mapInArrow(emit, PIECES)


def in_order(made: DataFrame) -> DataFrame:
    """Pieces by document, in output order: the secondary sort."""
    return made.repartition(*ROW).sortWithinPartitions(*ROW, "place")


def output(made: DataFrame) -> DataFrame:
    """(doc_id, form, output): the output of each document as one text."""
    texts = made.groupBy(*ROW, "form").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), "").alias("output"))
    return texts.select("doc_id", "form", "output")


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows of one document, as they come; a stream must be read before the next one is asked for."""
    rows = (row for batch in batches for k in range(0, batch.num_rows, 256) for row in batch.slice(k, 256).to_pylist())
    ahead = next(rows, None)

    def run(key: tuple) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and tuple(ahead[c] for c in ROW) == key:
            row, ahead = ahead, next(rows, None)
            yield row

    while ahead is not None:
        key = tuple(ahead[c] for c in ROW)
        yield key, run(key)


def digests(made: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """A row a document: units, form, characters of prefix and middle (null if plain), digests of output and restored text.

    The first stream, in output order, digests the output and finds where each piece of it belongs:
    a mark begins a part, whatever the piece was made from. The second, in the order of the text, digests
    what was restored.
    """
    # a part's pieces come before those of the parts after it in the text
    rank = {"p": 0, "m": 1, "s": 2}
    names = [f.split()[0] for f in PLACED.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for key, found in streams(batches):
            digest, chars, parts, part, at = hashlib.sha256(), {"p": 0, "m": 0, "s": 0}, None, "p", 0
            for row in found:
                piece, n, form = row["piece"], row["n"], row["form"]
                digest.update(piece.encode("utf-8", "surrogatepass"))
                if parts is None:
                    parts = list(rule.order(form)) if form != "plain" else []
                if parts and piece.startswith(rule.mark(parts[0])):
                    part, at = parts.pop(0), 0
                    piece = piece[len(rule.mark(part)) :]
                chars[part] += len(piece)
                rows.append((*key, n, form, (rank[part] << 40) + at, None, None, None, piece))
                at += 1
                size += len(piece)
                if size > BATCH or len(rows) > 10_000:
                    yield table(rows)
                    rows, size = [], 0
            counts = (None, None) if form == "plain" else (chars["p"], chars["m"])
            rows.append((*key, n, form, -1, digest.hexdigest(), *counts, ""))
        if rows:
            yield table(rows)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        names = [f.split()[0] for f in DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        for key, found in streams(batches):
            head, digest = next(found), hashlib.sha256()
            for row in found:
                digest.update(row["piece"].encode("utf-8", "surrogatepass"))
            out.append((key[0], head["n"], head["form"], head["prefix_chars"], head["middle_chars"], head["output_sha256"], digest.hexdigest()))
            if len(out) >= 10_000:
                yield batch()
                out = []
        if out:
            yield batch()

    placed = in_order(made).mapInArrow(assemble, PLACED)
    return placed.sortWithinPartitions(*ROW, "at").mapInArrow(restore, DIGESTS)


def oracle(rule: Rule = Rule()) -> str:
    """SQL of the digests of ``pieces`` over ``documents``."""
    draw = lambda k: f"('0x' || substring(h, {8 * k + 1}, 8))::BIGINT"
    holds = " OR ".join(f"contains(t, '{m}')" for m in rule.marks)
    p, m, s = "array_to_string(u[:a], '')", "array_to_string(u[a + 1:b], '')", "array_to_string(u[b + 1:], '')"
    cut = f"SELECT *, CASE WHEN t = '' OR {holds} OR {draw(2)} % 100 >= {rule.rate} THEN 'plain' WHEN {draw(3)} % 100 < {rule.suffix_first} THEN 'spm' ELSE 'psm' END AS form, least({draw(0)} % (n + 1), {draw(1)} % (n + 1)) AS a, greatest({draw(0)} % (n + 1), {draw(1)} % (n + 1)) AS b"
    units = "SELECT doc_id, t, u, len(u)::BIGINT AS n, sha256('%s:' || coalesce(doc_id::VARCHAR, '')) AS h FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u FROM documents)" % rule.salt
    return f"""SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length({p}) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length({m}) END::BIGINT AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{rule.prefix}' || {p} || '{rule.suffix}' || {s} || '{rule.middle}' || {m} ELSE '{rule.suffix}' || {s} || '{rule.prefix}' || {p} || '{rule.middle}' || {m} END) AS output_sha256, sha256(t) AS restored_sha256
    FROM ({cut} FROM ({units}))"""
