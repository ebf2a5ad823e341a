"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased text, its runs of white space and digits as one space each, gives hashed n-grams of one to
ORDERS characters. Document frequencies are counted over all rows that may be learned from. Weights are
fitted on a bounded sample by follow-the-regularised-leader (per-coordinate steps, elastic-net penalties;
most weights stay exactly zero), and a temperature, fitted on a part of the sample that took no part in
that, makes the scores probabilities. Whole texts are scored, long ones in blocks whose n-grams add up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .toxicity import held_out, steps

ORDERS, SLOTS = 3, 1 << 16
#: Rows of a language that are fitted, the longest text among them, and what all languages may have together.
PER_LANG, FIT_BYTES, MOST_ROWS = 600, 1 << 16, 20_000
#: Follow-the-regularised-leader: step, its start, penalties; rounds over the sample; rows of a step.
ALPHA, BETA, L1, L2, ROUNDS, STEP = 0.5, 1.0, 0.02, 0.1, 3, 8
#: Of ten fitted rows, these calibrate.
CALIBRATE = 2
#: Characters of a block of a long text.
BLOCK = 1 << 20

PLAIN = re.compile(r"[\s\d]+")


def grams(text: str) -> np.ndarray:
    """Slots of the character n-grams of one to ORDERS characters of an already plain text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, mixed = [], np.zeros(len(codes), np.uint64)
    for n in range(1, ORDERS + 1):
        if len(codes) < n:
            break
        mixed = mixed[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        out.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(SLOTS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def counts(text: str, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a whole text, ascending, and how often each occurs."""
    plain = PLAIN.sub(" ", f" {text.lower()} ")
    if len(plain) <= block:
        return np.unique(grams(plain), return_counts=True)
    total = np.zeros(SLOTS, np.int64)
    for k in range(0, len(plain), block):
        before = plain[max(0, k - ORDERS + 1) : k]  # n-grams that begin in the block before; those within it were counted there
        total += np.bincount(grams(before + plain[k : k + block]), minlength=SLOTS) - np.bincount(grams(before), minlength=SLOTS)
    slots = np.flatnonzero(total)
    return slots, total[slots]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and TF-IDF weights, of length 1."""
    slots, times = counts(text)
    values = np.log1p(times) * idf[slots]
    return slots, (values / max(np.sqrt(values @ values), 1e-12)).astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """Languages, IDF of the slots, the slots with weights (ascending), their weights, bias and temperature."""

    langs: list[str]
    idf: np.ndarray
    slots: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(self.slots):
            return self.bias
        at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
        hit = self.slots[at] == slots
        return values[hit].astype(np.float64) @ self.weights[at[hit]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; ``und`` and 0 without a letter or a learned language."""
        if not self.langs or not any(map(str.isalpha, text or "")):
            return "und", 0.0
        p = softmax(self.logits(*vector(text, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, rounds: int = ROUNDS, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots with weights, weights and bias by follow-the-regularised-leader in steps of STEP rows.

    Each coordinate keeps the sum of its gradients, corrected for what its weight was, and of their
    squares; a weight is the minimum of that linearised loss with both penalties, zero where the sum is
    within ``l1``. The bias, a coordinate that is always on, isn't pulled to zero.
    """
    width = SLOTS + 1
    z, n = np.zeros((width, classes)), np.zeros((width, classes))

    def weights(slots: np.ndarray) -> np.ndarray:
        zs, pull = z[slots], np.where(slots == SLOTS, 0.0, l1)[:, None]
        rate = (BETA + np.sqrt(n[slots])) / ALPHA + l2
        return np.where(np.abs(zs) <= pull, 0.0, -(zs - np.sign(zs) * pull) / rate)

    for turn in range(rounds):
        order = np.random.default_rng(turn).permutation(len(rows))
        for k in range(0, len(order), STEP):
            chosen = order[k : k + STEP]
            slots = np.unique(np.concatenate([*(rows[i][0] for i in chosen), [SLOTS]]))
            dense = np.zeros((len(chosen), len(slots)))
            for j, i in enumerate(chosen):
                dense[j, np.searchsorted(slots, rows[i][0])] = rows[i][1]
            dense[:, -1] = 1.0
            w = weights(slots)
            wrong = softmax(dense @ w)
            wrong[np.arange(len(chosen)), labels[chosen]] -= 1.0
            g = dense.T @ wrong
            grown = n[slots] + g * g
            z[slots] += g - (np.sqrt(grown) - np.sqrt(n[slots])) / ALPHA * w
            n[slots] = grown
    w = weights(np.arange(width))
    some = np.flatnonzero(np.any(w[:-1] != 0, axis=1))
    return some, w[some], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits under which the labels are likeliest, by golden-section search on its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    a, b, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def learnable(docs: DataFrame) -> DataFrame:
    """(lang, text) of the rows that may be learned from: a language, a text, and crc32(doc_id as text) mod 5 not 0."""
    return docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), text_of().alias("text"))


def frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of ``rows(text)``, and how many of them hold each slot. A task sends at most SLOTS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                held[counts(text.as_py())[0]] += 1
                seen += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"slot": pa.array([SLOTS, *some.tolist()], pa.int64()), "docs": pa.array([seen, *held[some].tolist()], pa.int64())})

    found = rows.select("text").mapInArrow(count, "slot long, docs long").groupBy("slot").agg(F.sum("docs").alias("docs")).toPandas()
    out = np.zeros(SLOTS + 1, np.int64)
    out[found["slot"].to_numpy(np.int64)] = found["docs"].to_numpy(np.int64)
    return int(out[-1]), out[:-1]


def sample(rows: DataFrame, per_lang: int = PER_LANG, most_bytes: int = FIT_BYTES, most_rows: int = MOST_ROWS) -> list[tuple[str, str]]:
    """(lang, text) to fit: at most ``per_lang`` different texts of a language, first by a hash, none over ``most_bytes``.

    With very many languages all have fewer, so that ``most_rows`` bounds what reaches the driver. The
    hash is cut off first at twice the share that is wanted, so no task sorts a language.
    """
    fits = rows.filter(F.octet_length("text") <= most_bytes).withColumn("turn", F.xxhash64("text", "lang"))
    sizes = {r["lang"]: r["n"] for r in fits.groupBy("lang").agg(F.approx_count_distinct("turn").alias("n")).orderBy(F.desc("n"), "lang").limit(most_rows).collect()}
    each = max(1, min(per_lang, most_rows // max(1, len(sizes))))
    limits = [(lang, int(-(2**63) + min(1.0, (2 * each + 50) / max(n, 1)) * (2**64 - 1))) for lang, n in sizes.items()]
    if not limits:
        return []
    cut = rows.sparkSession.createDataFrame([(lang, min(limit, 2**63 - 1)) for lang, limit in limits], "lang string, most long")
    near = fits.join(F.broadcast(cut), "lang").filter(F.col("turn") <= F.col("most")).groupBy("lang", "turn").agg(F.min("text").alias("text"))
    chosen = near.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("turn", "text"))), 1, each).alias("rows"))
    return [(r["lang"], x["text"]) for r in chosen.orderBy("lang").collect() for x in r["rows"]]


def fit(rows: DataFrame) -> Model:
    """The model of ``rows(lang, text)``: frequencies of all of them, weights of a sample.

    Without rows there is no language to predict; with one, it is certain. Rows whose text has no letter
    count for frequencies alone.
    """
    number, held = frequencies(rows)
    idf = np.log((1 + number) / (1 + held)).astype(np.float32) + 1
    found = [(lang, text) for lang, text in sample(rows) if any(map(str.isalpha, text))]
    langs = sorted({lang for lang, _ in found})
    labels = np.array([langs.index(lang) for lang, _ in found], np.int64)
    vectors = [vector(text, idf) for _, text in found]
    # the sample is in the order of a hash, so each tenth of it is as good as any other
    keep = np.arange(len(found)) % 10 >= CALIBRATE
    for k in range(len(langs)):  # a language of a few rows is learned, rather than calibrated
        if not keep[labels == k].any():
            keep[labels == k] = True
    fitted, checked = np.flatnonzero(keep), np.flatnonzero(~keep)
    slots, weights, bias = leader([vectors[i] for i in fitted], labels[fitted], len(langs)) if langs else (np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0))
    model = Model(langs, idf, slots, weights, bias)
    if len(checked) and len(langs) > 1:
        model.temperature = temperature(np.stack([model.logits(*vectors[i]) for i in checked]), labels[checked])
    return model


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row, the language of its whole text and its probability.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned. Equal texts are
    predicted alike, repeated rows each for itself; no rows give no rows.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, batch.num_columns - 1, rows=1024):
                made = [model.predict(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=[*keep, "lang_pred", "score"])

    rows = docs.select(*(F.col(c) for c in keep), text_of().alias("__text"))
    return rows.mapInArrow(apply, rows.drop("__text").schema.add("lang_pred", "string").add("score", "double"))


def keep_languages(docs: DataFrame, model: Model, langs: list[str], least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is in one of ``langs`` with a score of at least ``least``, as they are."""
    where = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, where):
                made = [model.predict(t) for t in part.column(where).to_pylist()]
                yield part.filter(pa.array([lang in langs and p >= least for lang, p in made]))

    return docs.mapInArrow(apply, docs.schema)

