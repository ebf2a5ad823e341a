"""Secret scans: three fixed patterns, and zstandard novelty against primed dictionaries.

Novelty: a long unbroken string near a word that speaks of credentials is measured by the bytes
that it adds to the compressed text around it. The compressor is primed with a dictionary that
zstandard's trainer makes of identifiers: words of the whole corpus and names of Python's own
library, joined as names and paths are. What counts as incompressible is no constant: the string
must add more than ordinary names of its length, put into the same surroundings, some of whose
words the dictionary doesn't hold.
"""

from __future__ import annotations

import builtins
import collections
import functools
import hashlib
import importlib
import random
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

KINDS = ("assign", "access", "hex", "novel")

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # those maximal runs of [0-9a-f]+ that are long enough
LEAST = {"assign": 6, "access": 20}
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Words near which an incompressible string is reported; modules whose names are primed.
SENSITIVE = re.compile(r"passw|secret|token|api[_-]?key|access[_-]?key|private|credential|auth|bearer|signature|session|certificate|\bkey\b|\bpwd\b", re.I | re.A)
MODULES = """
argparse ast asyncio codecs collections configparser csv datetime email.message http.client http.server importlib inspect io
json logging logging.handlers multiprocessing os pathlib pickle re shelve shutil socket sqlite3 ssl string subprocess tarfile
tempfile threading tokenize typing unittest urllib.parse urllib.request xml.dom.minidom zipfile pyspark.sql.functions
"""

#: The shortest candidate, the characters on either side that count as its surroundings, and those before it that hold the sensitive word.
SHORTEST, AROUND, NEAR = 16, 160, 64
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Corpus words that are primed (the most frequent of all), bytes of the dictionary, and names that it is trained on.
WORDS, SIZE, TRAINED = 4000, 1 << 16, 20_000
#: Ordinary names of each length, how many of them may add as much as a novel string, one word in how many is not primed, and the longest names.
NAMES, ABOVE, UNKNOWN, LONGEST = 64, 0, 4, 64
LEVEL = 19
#: A whole word: no digit or sign of base64 adjoins it, so no part of a key with a digit is one.
WORD = re.compile(r"(?<![A-Za-z0-9+=])[A-Za-z]{3,}(?![A-Za-z0-9+=])")
#: Parts of names in camel case.
PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
CUT = re.compile(r"(?<=[a-z])(?=[A-Z])|[_/-]+")
LONGEST_WORD = 20
#: Different words that a task holds before it hands them on.
HELD = 200_000


class Model(NamedTuple):
    """A trained dictionary, and ordinary names of each length from SHORTEST to LONGEST, in ``plain`` spelling."""

    dictionary: bytes
    names: tuple[tuple[str, ...], ...]


def parts(name: str) -> list[str]:
    return [p.lower() for p in PART.findall(name) if 3 <= len(p) <= LONGEST_WORD]


def library_words() -> set[str]:
    """Words of the names in MODULES and their classes."""
    names = {*dir(builtins), *sys.stdlib_module_names, *SENSITIVE.pattern.split("|")}
    for module in map(importlib.import_module, MODULES.split()):
        names.update(dir(module))
        for value in vars(module).values():
            if isinstance(value, type):
                names.update(dir(value))
    return {p for n in names for p in parts(n)}


def corpus_words(docs: DataFrame, most: int = WORDS) -> list[str]:
    """The ``most`` most frequent words of all whole texts, parts of names in camel case each for themselves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: collections.Counter = collections.Counter()

        def hand_on() -> pa.RecordBatch:
            each: collections.Counter = collections.Counter()
            for word, n in held.items():
                for part in [word] if word.islower() and len(word) <= LONGEST_WORD else parts(word):
                    each[part] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(each.keys(), pa.string()), pa.array(each.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(m[0] for m in WORD.finditer(text))
                if len(held) > HELD:
                    yield hand_on()
        yield hand_on()

    counted = docs.select(text_of().alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def ordinary_name(words: list[str], rng: random.Random) -> str:
    """Words joined as in names, constants, paths and options, with a number at the end."""
    some, number = [rng.choice(words) for _ in range(rng.randint(2, 6))], str(rng.randrange(10 ** rng.randint(1, 3)))
    return rng.choice(("".join(w.title() for w in some), some[0] + "".join(w.title() for w in some[1:]), "_".join(some) + "_v", "/".join(some), "-".join(some) + "-")) + number


def train(corpus: list[str]) -> Model:
    """The dictionary and the names, from words of the corpus and of MODULES; equal words give an equal model."""
    words = sorted(library_words().union(corpus))
    rng = random.Random(3)
    rng.shuffle(words)
    primed = [w for k, w in enumerate(words) if k % UNKNOWN]
    samples = [plain(ordinary_name(primed, rng)).encode() for _ in range(TRAINED)] + [w.encode() for w in primed for _ in (0, 1)]
    dictionary = zstandard.train_dictionary(SIZE, samples, level=LEVEL).as_bytes()
    names: dict[int, list[str]] = {n: [] for n in range(SHORTEST, LONGEST + 1)}
    while any(len(x) < NAMES for x in names.values()):
        name = plain(ordinary_name(words, rng))
        if len(name) in names and len(names[len(name)]) < NAMES:
            names[len(name)].append(name)
    return Model(dictionary, tuple(map(tuple, names.values())))


def learn(docs: DataFrame) -> Model:
    """The model for ``docs``: words are counted in every whole text, null ones as empty; no rows leave the library's words."""
    return train(corpus_words(docs))


@functools.lru_cache(4)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(dictionary)
    settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    primed.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=primed)


def plain(text: str) -> str:
    """Small letters, parts of names set apart by spaces: one spelling for all ways to write a name."""
    return CUT.sub(" ", text).lower()


def is_novel(model: Model, before: str, candidate: str, after: str) -> bool:
    """Whether ``candidate`` adds more compressed bytes to its surroundings than ordinary names of its length do.

    The names stand in the same surroundings; all but ABOVE of them must add less. Strings longer than
    the names are compared by bytes a character. Most names are told by the first few comparisons.
    """
    around, tested = plain(f"{before} {after}\n").encode(), plain(candidate)
    press, size = compressor(model.dictionary).compress, max(SHORTEST, min(len(tested), LONGEST))
    alone = len(press(around))
    added = (len(press(around + tested.encode())) - alone) * size / max(size, len(tested))
    above = 0
    for name in model.names[size - SHORTEST]:
        above += len(press(around + name.encode())) - alone >= added
        if above > ABOVE:
            return False
    return True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches; short ones are consumed and dropped."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if longest_word(text) >= LEAST["access"]:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
        found += [(*m.span(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(found, key=in_order)


def in_order(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def longest_word(text: str) -> int:
    return max(map(len, text.split()), default=0)


def novel_spans(text: str, base: list[tuple[int, int, str]], model: Model) -> list[tuple[int, int, str]]:
    """Candidates near a sensitive word that base spans don't touch and that hardly compress."""
    found, k, covered = [], 0, 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while k < len(base) and base[k][0] < e:
            covered, k = max(covered, base[k][1]), k + 1
        if covered > s or not (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])):
            continue
        before, after = text[max(0, s - AROUND) : s], text[e : e + AROUND]
        if SENSITIVE.search(before[-NEAR:]) and is_novel(model, before, m[0], after):
            found.append((s, e, "novel"))
    return found


def spans_of(text: str, model: Model) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    if longest_word(text) < SHORTEST:  # no candidate
        return base
    return sorted(base + novel_spans(text, base, model), key=in_order)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: Model | None = None) -> DataFrame:
    """The columns ``keep`` of each row with ``found``: array of (start, end, kind), by start, then kind.

    Places are code points, ends are exclusive. Null text is empty; repeated rows are scanned each for
    itself, other columns don't count, no rows give no rows. ``model``: what ``learn`` made; without
    one it is learned from ``docs``, whose texts are then read twice.
    """
    model = model or learn(docs)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("start", "end", "kind"), x)) for x in spans_of(t, model)] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kind)], names=[*keep, "found"])

    rows = docs.select(*(F.col(c) for c in keep), text_of().alias("__text"))
    schema = rows.drop("__text").schema.add(T.StructType.fromDDL("found array<struct<start: bigint, end: bigint, kind: string>>")[0])
    return rows.mapInArrow(look, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and spans as text: kind:start:end by start, then kind, comma-joined.

    A row for each row of ``found``; without spans, zeros and empty text; no rows give no rows.
    """
    named = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("found", lambda x: x["kind"] != "novel")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(F.array_join(F.transform(base, named), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("found", named), ",").alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, each span of its text replaced by ``mask``; overlapping spans are one.

    Null stays null, and every other column is as it was but for n_chars, where there is one: it
    counts the new text. ``model`` as in ``scan``.
    """
    model = model or learn(docs)
    names = docs.columns
    schema = docs.schema
    where = names.index("text")

    def cover(text: str | None) -> str | None:
        if not text or not (found := spans_of(text, model)):
            return text
        out, at, end = [], 0, -1
        for s, e, _ in found:
            if s >= end:
                out += [text[at:s], mask]
            at = end = max(end, e)
        return "".join(out) + text[at:]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([cover(t) for t in batch.column(where).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == where else c for k, c in enumerate(batch.columns)], names=names)

    out = docs.mapInArrow(apply, schema)
    if "n_chars" in names:
        changed = F.when(F.col("text").isNotNull(), F.length("text").cast(schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*names)
