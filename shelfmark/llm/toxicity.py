"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of a word vector, a vector of its first five letters (both for what the
fitted sample's vocabulary holds) and the mean of the vectors of its character trigrams, so unseen
words still carry their letters. Two gated recurrent layers read
a window of words, one from each end; attention weighs their states, and a logistic unit scores the
window. All windows of a text are scored, each overlapping the next, and the highest is the text's.

Only a bounded sample of labelled rows is fitted (``per_class`` documents of each label, first by a
hash of doc_id). Labels are of documents, so each round trains on the window that scores highest.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

WINDOW, STRIDE = 32, 24
HIDDEN, INPUT = 8, 12
TRIGRAMS = 1 << 13
#: Documents of either label that are fitted, rounds over them; documents that make a word known.
PER_CLASS, ROUNDS, LEAST_DOCS = 800, 12, 5
#: Bytes of the longest text that is fitted.
FIT_BYTES = 1 << 17
#: Steps of a round.
BATCHES = 13
#: Distinct words whose inputs a worker keeps before it starts anew.
KNOWN_WORDS = 100_000

LETTERS = re.compile(r"[\W\d_]+")


def plain(word: str) -> str:
    """A lower-cased word without marks and digits."""
    return word if word.isalpha() else LETTERS.sub("", word)


def forms(stem: str) -> tuple[str, str]:
    """What of a plain word can be in a vocabulary: itself and its first letters."""
    return stem, f"{stem[:5]}~"


def trigrams(word: str) -> list[int]:
    """Hashed character trigrams of a plain word with its ends marked."""
    data = f"^{word}$".encode("utf-8", "replace")
    return [zlib.crc32(data[k : k + 3]) % TRIGRAMS for k in range(max(1, len(data) - 2))]


def windows(n: int) -> range:
    """Starts of the windows over ``n`` words: they overlap, and the last one ends the text."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """Weights by name; ``prior`` alone scores where nothing could be fitted."""

    prior: float = 0.0
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    vocabulary: dict[str, int] = field(default_factory=dict)  # from 1 on; 0 is any other word

    @staticmethod
    def start(vocabulary: dict[str, int], seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by=0.2: (rng.standard_normal(shape) * by).astype(np.float32)
        w = {"word": draw(len(vocabulary) + 1, INPUT, by=0.05), "tri": draw(TRIGRAMS, INPUT, by=0.02), "attend": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            w |= {f"w{side}": draw(INPUT, 3 * HIDDEN), f"u{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        return Model(0.5, w, vocabulary)

    def vectors(self, words: list[str]) -> np.ndarray:
        return self.combine(*self.numbers(words))

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary number of each word, all their trigrams, and how many each has."""
        stems = list(map(plain, words))
        tri = list(map(trigrams, stems))
        n = np.fromiter(map(len, tri), np.int64, len(tri))
        return np.array([[self.vocabulary.get(f, 0) for f in forms(w)] for w in stems], np.int64).reshape(-1, 2), np.fromiter(itertools.chain.from_iterable(tri), np.int64, n.sum()), n

    def combine(self, word: np.ndarray, tri: np.ndarray, n: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(self.weights["tri"].take(tri, axis=0), np.cumsum(n) - n, axis=0) / n[:, None]
        return (self.weights["word"].take(word, axis=0).sum(axis=1) + mean).astype(np.float32)

    def run(self, side: str, steps: list[np.ndarray], keep: bool = False):
        """States after each step of (batch, 3 * HIDDEN) projected inputs; gates too if kept."""
        u = self.weights[f"u{side}"]
        h = np.zeros((len(steps[0]), HIDDEN), np.float32)
        states, gates = [], []
        for x in steps:
            a = h @ u
            zr = sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            if keep:
                gates.append((h, z, r, n, a[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            states.append(h)
        return (states, gates) if keep else states

    def forward(self, ids: np.ndarray, tables: dict[str, np.ndarray], keep: bool = False):
        """Logits of windows of word numbers (0: padding); tables hold each word's projected input."""
        w, span = self.weights, range(ids.shape[1])
        ahead = self.run("f", [tables["f"].take(ids[:, t], axis=0) for t in span], keep)
        back = self.run("b", [tables["b"].take(ids[:, t], axis=0) for t in reversed(span)], keep)
        if keep:
            (ahead, gates_f), (back, gates_b) = ahead, back
        h = np.concatenate([np.stack(ahead, 1), np.stack(back[::-1], 1)], axis=2)
        score = np.where(ids > 0, np.tanh(h) @ w["attend"], -1e4)
        weight = np.exp(score - score.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = (weight[:, :, None] * h).sum(axis=1)
        logit = pooled @ w["out"] + w["bias"]
        return (logit, (h, weight, pooled, gates_f, gates_b)) if keep else logit

    def project(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """Projected inputs; row 0 is padding."""
        x = np.concatenate([np.zeros((1, INPUT), np.float32), vectors.astype(np.float32)])
        return {s: x @ self.weights[f"w{s}"] + self.weights[f"c{s}"] for s in "fb"}

    def gradient(self, ids: np.ndarray, tables: dict[str, np.ndarray], y: np.ndarray, share: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the logistic loss, weighed by ``share``: of the weights, and of the projected inputs."""
        w = self.weights
        logit, (h, weight, pooled, gates_f, gates_b) = self.forward(ids, tables, keep=True)
        d = ((sigmoid(logit) - y) * share).astype(np.float32)
        out = {"bias": d.sum(keepdims=True), "out": pooled.T @ d}
        dpool = d[:, None] * w["out"]
        dweight = (h * dpool[:, None]).sum(axis=2)
        dscore = weight * (dweight - (weight * dweight).sum(axis=1, keepdims=True)) * (ids > 0)
        th = np.tanh(h)
        out["attend"] = np.einsum("bth,bt->h", th, dscore)
        dh = weight[:, :, None] * dpool[:, None] + dscore[:, :, None] * w["attend"] * (1 - th * th)
        steps = ids.shape[1]
        dtables = {s: np.zeros_like(tables[s]) for s in "fb"}
        for s, gates, order, part in (("f", gates_f, range(steps), slice(0, HIDDEN)), ("b", gates_b, range(steps - 1, -1, -1), slice(HIDDEN, None))):
            u, du = w[f"u{s}"], np.zeros_like(w[f"u{s}"])
            carry = np.zeros((len(ids), HIDDEN), np.float32)
            for k in range(steps - 1, -1, -1):
                t = order[k]
                before, z, r, n, an = gates[k]
                g = carry + dh[:, t, part]
                dn = g * (1 - z) * (1 - n * n)
                dz = g * (before - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ da
                carry = g * z + da @ u.T
                np.add.at(dtables[s], ids[:, t], np.concatenate([dz, dr, dn], axis=1))
            out[f"u{s}"] = du
        return out, dtables


class Texts:
    """Texts as windows of word numbers."""

    def __init__(self, texts: list[str]):
        self.number: dict[str, int] = {}
        self.words: list[str] = []
        self.ids, self.owner = window_ids(texts, self.lookup)

    def lookup(self, words: list[str]) -> list[int]:
        for w in set(words) - self.number.keys():
            self.words.append(w)
            self.number[w] = len(self.words)
        return list(map(self.number.__getitem__, words))


def window_ids(texts: list[str], lookup) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) word numbers, 0 beyond a text's end; the text of each window."""
    rows, owner = [], []
    for k, text in enumerate(texts):
        ids = np.array(lookup(text.lower().split()), np.int32)
        starts = np.array(windows(len(ids)))
        padded = np.zeros(starts[-1] + WINDOW, np.int32)
        padded[: len(ids)] = ids
        rows.append(padded[starts[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(starts), k))
    return np.concatenate(rows), np.concatenate(owner)


def fit(texts: list[str], labels: list[int], rounds: int = ROUNDS, guess: bool = True) -> Model:
    """Train on whole texts; with one label only, the model is that label's share.

    With ``guess``, word vectors start from how much more often texts of label 1 hold the word.
    """
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return Model(float(y.mean()) if len(y) else 0.0)
    data = Texts(texts)
    stems = list(map(plain, data.words))
    seen = [{f for k in np.unique(data.ids[data.owner == d]) if k for f in forms(stems[k - 1])} for d in range(len(texts))]
    counts = [Counter(itertools.chain.from_iterable(s for s, c in zip(seen, labels) if c == label)) for label in (0, 1)]
    known = sorted(w for w, c in (counts[0] + counts[1]).items() if c >= LEAST_DOCS and w not in ("", "~"))
    model = Model.start({w: k for k, w in enumerate(known, 1)})
    w = model.weights
    w["word"][0] = 0
    if guess:
        rate = [np.array([counts[c][x] + 4 for x in known]) / ((y == c).sum() + 8) for c in (0, 1)]
        w["word"][1:, 0] += np.clip(np.log(rate[1] / rate[0]), -2, 4).astype(np.float32)
    word, tri, n = model.numbers(data.words)
    size = np.bincount(data.owner)
    first = np.cumsum(size) - size
    strength = np.concatenate([[-9], w["word"][word, 0].sum(axis=1)])[data.ids].max(axis=1)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    share = np.where(y == 1, (y == 0).sum(), (y == 1).sum())  # both labels weigh the same
    step, rng = 0, np.random.default_rng(11)
    for turn in range(rounds):
        if turn:
            tables = model.project(model.combine(word, tri, n))
            strength = np.concatenate([model.forward(data.ids[a : a + 4096], tables) for a in range(0, len(data.ids), 4096)])
        best = np.array([s + strength[s:e].argmax() for s, e in zip(first, [*first[1:], len(strength)])])
        for chosen in np.array_split(rng.permutation(len(texts)), min(BATCHES, len(texts))):
            ids = data.ids[best[chosen]]
            local, inverse = np.unique(np.append(ids, 0), return_inverse=True)
            at = local[1:] - 1
            if not len(at):  # no words at all
                continue
            pick = np.concatenate([np.arange(s, s + c) for s, c in zip((np.cumsum(n) - n)[at], n[at])])
            x = np.concatenate([np.zeros((1, INPUT), np.float32), model.combine(word[at], tri[pick], n[at])])
            tables = {s: x @ w[f"w{s}"] + w[f"c{s}"] for s in "fb"}
            grad, dtables = model.gradient(inverse[:-1].reshape(ids.shape), tables, y[chosen], share[chosen] / share[chosen].sum())
            dx = sum(dtables[s] @ w[f"w{s}"].T for s in "fb")[1:]
            for s in "fb":
                grad |= {f"w{s}": x.T @ dtables[s], f"c{s}": dtables[s].sum(axis=0)}
            grad["word"], grad["tri"] = np.zeros_like(w["word"]), np.zeros_like(w["tri"])
            np.add.at(grad["word"], word[at], dx[:, None])
            grad["word"][0] = 0
            np.add.at(grad["tri"], tri[pick], np.repeat(dx / n[at][:, None], n[at], axis=0))
            step += 1
            for k, g in grad.items():  # Adam
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return model


class Scorer:
    """Scores texts, keeping the projected inputs of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.tables = self.model.project(np.zeros((0, INPUT), np.float32)) if self.model.weights else {}
        self.room = 1

    def learn(self, words: list[str]) -> None:
        made = self.model.project(self.model.vectors(words))
        size = len(self.number) + 1
        if (need := size + len(words)) > self.room:
            self.room = max(2 * self.room, need)
            self.tables = {s: np.concatenate([t[:size], np.zeros((self.room - size, t.shape[1]), np.float32)]) for s, t in self.tables.items()}
        for s in "fb":
            self.tables[s][size:need] = made[s][1:]
        self.number.update(zip(words, range(size, need)))

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.model.weights:
            return np.full(len(texts), self.model.prior)
        if not texts:
            return np.zeros(0)
        if len(self.number) > KNOWN_WORDS:
            self.forget()
        split = [t.lower().split() for t in texts]
        if new := list(set().union(*split) - self.number.keys()):
            self.learn(new)
        rows = iter(split)
        ids, owner = window_ids(texts, lambda _: list(map(self.number.__getitem__, next(rows))))
        logit = np.concatenate([self.model.forward(ids[a : a + 2048], self.tables) for a in range(0, len(ids), 2048)])
        first = np.searchsorted(owner, np.arange(len(texts)))
        return sigmoid(np.maximum.reduceat(logit, first).astype(np.float64))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = FIT_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels to fit: labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    At most ``per_class`` rows of a label are drawn, and those with texts of over ``most_bytes`` are not
    fitted (they are scored like all others), so what reaches the driver is bounded by their product.
    Null ids, labels other than 0 and 1 are left out; repeated rows count once.
    """
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).distinct()
    chosen = [usable.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).filter(F.octet_length("text") <= most_bytes).join(chosen[0].unionByName(chosen[1]), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = sorted(rows.select("doc_id", "toxic", "text").collect())
    return [r["text"] for r in found], [r["toxic"] for r in found]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def steps(batch: pa.RecordBatch, where: int, rows: int = 64, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose texts have about ``size`` bytes together, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(where)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, upto - at)
        at = upto


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row and the score of its whole text; null text is empty.

    Equal texts score alike, repeated rows each for itself; no rows give no rows.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in steps(batch, batch.num_columns - 1):
                made = scorer.score(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.float64())], names=[*keep, "score"])

    rows = docs.select(*(F.col(c) for c in keep), text_of().alias("__text"))
    return rows.mapInArrow(apply, rows.drop("__text").schema.add("score", "double"))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, as they are; null text is empty, no rows give no rows."""
    where = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in steps(batch, where):
                texts = [t or "" for t in part.column(where).to_pylist()]
                yield part.filter(pa.array(scorer.score(texts) < threshold))

    return docs.mapInArrow(apply, docs.schema)
