"""The pipeline's stages on odd and empty tables, and its whole against a plain version."""

import collections

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline as P
from shelfmark.llm import common, components, mixing, queries, simhash


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stage(spark, odd, empty, name):
    stage = dict(P.STAGES)[name]
    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = stage(spark, docs, folder)
        rows = out.count()
        assert rows == 0 if folder == empty else rows > 0
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_near_duplicates_keep_one(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = collections.Counter(r["doc_id"] for r in P.drop_near_duplicates(spark, docs, odd).select("doc_id").collect())
    # 12 and 13 repeat 1, 14 is 0 with a word changed, 15 to 18 have no words
    assert {0, 1, 2, 15} <= set(kept) and not {12, 13, 14, 16, 17, 18} & set(kept)


def test_similar_finds_planted_copies(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{v}" for v in rng.integers(0, 5000, 200)] for _ in range(300)]
    docs, want = [(k, " ".join(b)) for k, b in enumerate(base)], set()
    for k in range(0, 300, 3):
        copy = list(base[k])
        copy[50] = copy[120] = "new"
        docs.append((1000 + k, " ".join(copy)))
        want.add(1000 + k)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(rows).collect()}
    assert kept & want == set() and kept == set(range(300))


def draw(rng, n):
    return [f"w{v}" for v in rng.integers(0, 10**9, n)]


def test_equal_fingerprints_are_no_proof(spark):
    """Texts that share one line, repeated often, have few shingles in common."""
    rng = np.random.default_rng(5)
    docs = []
    for k, length in enumerate((9, 11, 13)):
        line = draw(rng, length) * 40
        docs += [(2 * k + side, " ".join(line + draw(rng, 100))) for side in (0, 1)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == set(range(6))


def test_repeated_words_do_not_hide_copies(spark):
    """A text and the same with its first words repeated differ in few distinct shingles."""
    rng = np.random.default_rng(6)
    base = [draw(rng, 200) for _ in range(12)]
    docs = [(k, " ".join(b)) for k, b in enumerate(base)]
    docs += [(100 + k, " ".join(b[:12] * (10 + 3 * k) + b)) for k, b in enumerate(base)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == set(range(12))


def plain_set(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_similarity_is_decided_exactly(spark):
    """Pairs from 0.76 to 0.84, against a brute-force version over exact sets."""
    rng = np.random.default_rng(8)
    docs, near = [], {}
    for k in range(120):
        base = draw(rng, 404)
        cut = 30 + k % 21  # 400 shingles, of which cut + 4 change
        copy = base[:100] + draw(rng, cut) + base[100 + cut :]
        docs += [(k, " ".join(base)), (1000 + k, " ".join(copy))]
        x, y = (plain_set(t) for _, t in docs[-2:])
        near[k] = len(x & y) / len(x | y)
    gone = {d for d, _ in docs} - {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {1000 + k for k, v in near.items() if v >= 0.8}
    assert min(near.values()) < 0.78 and max(near.values()) > 0.83
    assert gone <= want and len(want - gone) <= 0.05 * len(want)


def test_large_groups_lose_no_link(spark, monkeypatch):
    """a-b and c-d are nearest to each other, b-c links the two: one class, however large the group."""
    rng = np.random.default_rng(10)
    docs, size = [], 40
    for k in range(size):
        chain = [draw(rng, 404)]
        for cut in (12, 28, 12):  # similarity 0.92, 0.85 and 0.92; a-c, b-d are below 0.8
            at = 100 * len(chain)
            chain.append(chain[-1][:at] + draw(rng, cut) + chain[-1][at + cut :])
        docs += [(1000 * side + k, " ".join(c)) for side, c in enumerate(chain)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    # one group of all rows: nothing but its own pairs can find a link; blocks of a few rows
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 50)
    nodes = simhash.nodes_of(rows, 5)
    one = nodes.withColumns({f"b{t}": F.lit(7).cast("long") for t in range(simhash.KEYS)})
    classes = collections.Counter(r["component"] for r in components.connected_components(simhash.links_of(one, rows, 5, 0.8)).collect())
    assert len(classes) == size and set(classes.values()) == {4}


def test_pairs_of_each_similarity(spark):
    """Recall of pairs, by similarity, among texts with nothing else in common: at least 0.9 from 0.8 on, none below."""
    rng = np.random.default_rng(18)
    docs, near = [], {}
    for k in range(1500):
        n = int(rng.integers(60, 300))
        base = draw(rng, n + 4)
        cut = round(n * (0.10 - 0.05 * (k % 3)) / 1.9 * 1.1) or 1  # about 0.80 to 0.83, 0.9, 0.95
        at = int(rng.integers(5, n - cut - 5))
        copy = base[:at] + draw(rng, cut) + base[at + cut :]
        docs += [(k, " ".join(base)), (10_000 + k, " ".join(copy))]
        x, y = (plain_set(t) for _, t in docs[-2:])
        near[k] = len(x & y) / len(x | y)
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = {k for k in near if 10_000 + k not in kept}
    assert all(near[k] >= 0.8 for k in found) and set(range(1500)) <= kept
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        there = {k for k, v in near.items() if low <= v < high}
        assert len(there) > 30 and len(found & there) >= 0.95 * len(there)


def test_mixing_repeats_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    copies = mixing.mix(docs.select("doc_id", "source", "text")).groupBy().sum("copies").first()[0]
    assert mixing.mixed(docs).count() == copies


def test_run(spark, odd):
    got = P.run(spark, odd).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 4096
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, odd)
    # without the tables between the stages the same documents arrive
    assert sorted(got[got.piece == 0].doc_id.fillna(-1).astype(int)) == sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name, stay", [("op4_simhash", {"fingerprints", "labelled", "smallest"}), ("op6_suffix_dedup", {"texts", "spans"}), ("op10_embedding_near_dup", {"linked"}), ("pipeline", {"pieces", "packed", "placed"})])
def test_tables_that_nothing_reads_are_deleted(spark, tmp_path, monkeypatch, name, stay):
    """What is left in the shared folder is what the returned plan reads."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    rows = out.count()
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "shelfmark").iterdir()}
    assert left <= stay, left - stay
    assert rows == out.count() > 0
