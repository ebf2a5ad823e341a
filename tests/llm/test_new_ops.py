"""Merkle manifest, fill-in-the-middle and language ID against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import fim, langid, licenses, manifest, queries, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """All levels of a tree, and its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, k, fanout):
    """(siblings before, siblings after) of the k-th leaf, level by level."""
    for level in levels[:-1]:
        first = k // fanout * fanout
        yield level[first:k], level[k + 1 : first + fanout]
        k //= fanout


def plain_manifest(docs, fanout):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row of (doc_id, source, lang, n_chars, text)."""
    trees = collections.defaultdict(list)
    for row in docs:
        tampered = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        trees[row[1]].append((row[0] is not None, row[0] or 0, leaf(*row), leaf(*row[:4], row[4].translate(LOWER)) if tampered else None, row[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: climb([r[2] for r in sorted(trees[s], key=lambda r: r[:3])], fanout) for s in names}
    outer = climb([inner[s][-1][0] for s in names], fanout)
    out = []
    for j, s in enumerate(names):
        for k, (_, _, own, claim, doc_id) in enumerate(sorted(trees[s], key=lambda r: r[:3])):
            steps = [*path(inner[s], k, fanout), *path(outer, j, fanout)]
            value = claim or own
            for before, after in steps:
                value = sha(*before, value, *after)
            root = outer[-1][0]
            out.append((doc_id, own, inner[s][-1][0], root, sha(*(d for b, a in steps for d in (*b, *a))), value, value == root))
    return out


def key(row):
    return str(row)


FIVE = "doc_id long, source string, lang string, n_chars long, text string"


def test_merkle_on_odd_rows(spark, odd):
    docs = [tuple(r) for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in queries.op11_merkle_manifest(spark, odd).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=key) == sorted(plain_manifest(docs, 16), key=key)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (3, 1), (2, 3), (4, 2)])
def test_butterfly_of_any_shape(spark, fanout, levels):
    """Trees of one to many ragged partitions, a large source among them, and more sources than a node has children."""
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 13, 27, 28, 31, 33, 64, 65, 170]
    docs = [(n * 1000 + k if k % 9 else 5 * k, None if n == 4 else f"s{n}", "en", 1, f"Text {k}") for n in sizes for k in range(n)] + [(7, "s1", "en", 1, "Text"), (7, "s1", "en", 1, "Text"), (None, "s1", None, None, None)]
    rows = spark.createDataFrame(docs, FIVE).repartition(5)
    made = manifest.proofs(manifest.build(rows, manifest.tampered(rows), fanout, levels))
    got = [tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=key) == sorted(plain_manifest(docs, fanout), key=key)


def test_merkle_sees_any_change(spark):
    docs = [(k, "a" if k % 3 else "b", "en", 5, f"Text {k}") for k in range(40)]
    root = lambda rows: manifest.proofs(manifest.build(spark.createDataFrame(rows, FIVE), fanout=4, levels=1)).select("root").distinct().collect()[0]["root"]
    first = root(docs)
    assert root(docs[::-1]) == first
    assert len({first, root([*docs[:-1], (39, "b", "en", 5, "Text 38")]), root(docs[:-1]), root([*docs, docs[0]])}) == 4


def plain_fim(doc_id, text, rule=fim.Rule()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{rule.salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rule.rate:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < rule.suffix_first else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def fim_rows(docs, rule=fim.Rule()):
    for doc_id, text in docs:
        n, form, p, m, out = plain_fim(doc_id, text, rule)
        yield doc_id, n, form, p, m, sha(out), sha(text or "")


COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_fim_on_odd_rows(spark, odd):
    docs = [tuple(r) for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op12_fill_in_middle(spark, odd).collect()]
    assert sorted(got, key=key) == sorted(fim_rows(docs), key=key)


FIM_TEXTS = ["", "\n", "\n\n\n", "one", "a\nb\nc", "a\nb\nc\n", "x<P>y", "<S", "ends <\nP>", "<P\n>", "<M>\n", "é日\n𝒳\r\n\x0b", "long " * 900 + "\n" + "z" * 5000, "\n".join("line %d" % k for k in range(3000))]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 15])
def test_fim_pieces_of_any_size(spark, chunk):
    docs = [(k * 31 + j, t) for k in range(6) for j, t in enumerate(FIM_TEXTS[: None if chunk > 1 else -2])] + [(None, None), (None, "a\nb"), (3, "a\nb"), (3, "a\nb")]
    for rule in (fim.Rule(), fim.Rule(rate=40, suffix_first=20)):
        made = fim.pieces(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), rule, chunk)
        got = [tuple(r[c] for c in COLUMNS) for r in fim.digests(made, rule).collect()]
        assert sorted(got, key=key) == sorted(fim_rows(docs, rule), key=key)
        texts = sorted((str(r["doc_id"]), r["form"], r["output"]) for r in fim.output(made).collect())
        assert texts == sorted((str(i), *(lambda x: (x[1], x[4]))(plain_fim(i, t, rule))) for i, t in docs)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fim_moves_pieces_once(spark, odd):
    plan = queries.op12_fill_in_middle(spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_fill_in_middle"])
def test_sql_agrees(spark, name, odd):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = queries.QUERIES[name](spark, odd)
    assert set(columns) <= set(got.columns)
    assert sorted(map(key, want)) == sorted(key(tuple(r)) for r in got.select(*columns).collect())


TONGUES = {"aa": "the of and to in that is was", "bb": "der die und das ist nicht ein zu", "cc": "le la les et des est que dans", "dd": "что это не на и с как он"}


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(3)

    def text(lang, n):
        stems = TONGUES[lang].split()
        return " ".join(rng.choice(stems) + ("" if rng.random() < 0.6 else rng.choice(stems)) for _ in range(n))

    rows = [(k, text(lang, rng.randint(4, 60)), lang, "s", 0) for k in range(900) for lang in [rng.choice([*TONGUES])]]
    rows += [(1000 + k, v, "aa", "s", 0) for k, v in enumerate([None, "", " 12 345 ", "!?", "½ Ⅷ ٣"])] + [(2000, "the of and", None, None, None), (None, "the and of that", "aa", None, None), (5, rows[5][1], rows[5][2], "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_language_held_out(spark, tongues):
    docs, rows = tongues
    model = langid.fit(langid.learnable(docs))
    assert model.langs == [*TONGUES] and 0.01 < model.temperature < 60
    assert 0 < len(model.slots) < 6000  # the penalties leave most slots without a weight
    got = langid.predict(docs, model, keep=("doc_id", "lang", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["text"] is None or not any(map(str.isalpha, r["text"])):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert 0 < r["score"] <= 1
    tested = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(tested) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in tested]) > 0.98
    kept = langid.keep_languages(docs, model, ["bb"]).collect()
    assert {r["lang"] for r in kept} == {"bb"} and kept[0].asDict().keys() == set(docs.columns)


def plain_prediction(model, text):
    """Scores by loops over n-grams and languages."""
    plain = re.sub(r"[\s\d]+", " ", f" {text.lower()} ")
    found = collections.Counter(int(langid.grams(plain[k : k + n])[-1]) for n in (1, 2, 3) for k in range(len(plain) - n + 1))
    values = {s: np.log1p(n) * model.idf[s] for s, n in found.items()}
    length = sum(v * v for v in values.values()) ** 0.5
    logits = list(model.bias)
    for j, s in enumerate(model.slots):
        for c in range(len(logits)):
            logits[c] += values.get(int(s), 0.0) / length * model.weights[j][c]
    e = np.exp((np.array(logits) - max(logits)) / model.temperature)
    return model.langs[int(e.argmax())], float(e.max() / e.sum())


def test_language_scores_by_loops(tongues):
    docs, rows = tongues
    model = langid.fit(langid.learnable(docs))
    for _, text, *_ in rows[:12]:
        lang, p = model.predict(text)
        assert (lang, pytest.approx(p, abs=1e-5)) == plain_prediction(model, text)


def test_language_learns_from_its_own_rows_only(spark, tongues):
    """Rows that are held out, or their labels, change nothing."""
    docs, _ = tongues
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    other = docs.withColumn("lang", F.when(out, "zz").otherwise(F.col("lang"))).withColumn("text", F.when(out, F.lit("zzz")).otherwise(F.col("text")))
    a, b = (langid.fit(langid.learnable(d)) for d in (docs, other))
    assert a.langs == b.langs and np.array_equal(a.idf, b.idf) and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_frequencies_by_loops(spark, tongues):
    docs, rows = tongues
    number, held = langid.frequencies(langid.learnable(docs).repartition(4))
    texts = [t for i, t, lang, *_ in rows if t is not None and lang is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 5]
    want = np.zeros(langid.SLOTS, np.int64)
    for t in texts:
        for s in {int(s) for s in langid.counts(t)[0]}:
            want[s] += 1
    assert number == len(texts) and np.array_equal(held, want)


@given(text=st.text(alphabet=st.sampled_from(list("ab  \n12é日")), max_size=200), block=st.integers(3, 40))
@settings(max_examples=200, deadline=None)
def test_blocks_add_up(text, block):
    whole, parts = langid.counts(text), langid.counts(text, block)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_sample_is_bounded(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3900, "hot").otherwise("rare").alias("lang"), F.concat(F.lit("text "), F.col("id") % 3950).alias("text"))
    found = collections.Counter(lang for lang, _ in langid.sample(rows, per_lang=60))
    assert found == {"hot": 60, "rare": 50 + 10} or (found["hot"] == 60 and 40 <= found["rare"] <= 60)
    assert len(langid.sample(rows, per_lang=60, most_rows=10)) == 10
    assert langid.sample(rows.withColumn("text", F.repeat("text", F.lit(20))), most_bytes=50) == []


def test_one_language_and_none(spark):
    docs = spark.createDataFrame([(k, "some words", "aa" if k < 50 else None) for k in range(60)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(langid.learnable(docs))).collect()} == {"aa"}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(none, langid.fit(langid.learnable(none))).collect()} == {("und", 0.0)}


BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = "3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"


def plain_sentences(text):
    """Identifiers by loops over characters, without the operator's patterns."""
    lines, blocks = [], [[]]
    for line in text.lower().replace("\r\n", "\n").split("\n"):
        body = line if not lines else line.lstrip("".join(c for c in set(line) if not (c.isascii() and c.isalnum())))
        lines.append(body)
        if body.strip():
            blocks[-1].append(body)
        else:
            blocks.append([])
    out = []
    for block in blocks:
        sentence = ""
        for word in " ".join(block).split():
            bare = word.rstrip(".!?;:")
            sentence += " " + bare
            if bare != word:
                out.append(sentence)
                sentence = ""
        out.append(sentence)
    known = {v: k for k, v in licenses.SENTENCES.items()}
    found = []
    for sentence in out:
        words = "".join(c if c.isascii() and (c.isalnum() or c == ".") else " " for c in sentence).split()
        if words[:4] == ["neither", "the", "name", "of"] and "nor" in words:
            words[4 : words.index("nor")] = ["the", "copyright", "holder"]
        text = " ".join(words)
        if text in known:
            found.append(known[text])
        elif "endorse or promote products" in text:
            found.append("endorsement-other")
    return found


def test_licence_sentences_that_name_somebody(spark):
    other = "3. The authors' names may never be used to endorse or promote products derived from this software.\n"
    cases = {
        "BSD-2-Clause": [BSD2, BSD2 + "\nTHIS SOFTWARE IS PROVIDED AS IT COMES.\n"],
        "BSD-3-Clause": [BSD2 + "\n" + NAMES.format(n) for n in ("the University", "the copyright holder", "Example Corp., Inc", "The Regents of the University of X")],
        "": [BSD2 + "\n" + other, NAMES.format("the University")],
    }
    docs = [(k, t, want) for k, (want, t) in enumerate((w, t) for w, texts in cases.items() for t in (*texts, *("\n".join("# " + x for x in t.split("\n")) for t in texts)))]
    for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string, want string"), keep=("doc_id", "text", "want")).collect():
        assert r["licenses"] == r["want"], r["text"]
        if not r["text"].startswith("#"):
            assert r["sentence_ids"].split(",") == plain_sentences(r["text"])


def plain_toxicity(model, text):
    """A text's score by loops over windows, words and units."""
    w, words = model.weights, text.lower().split()
    dot = lambda v, m: [sum(float(v[i]) * float(m[i][j]) for i in range(len(v))) for j in range(len(m[0]))]
    gate = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        stem = word if word.isalpha() else re.sub(r"[\W\d_]+", "", word)
        data = f"^{stem}$".encode()
        tri = [w["tri"][zlib.crc32(data[k : k + 3]) % toxicity.TRIGRAMS] for k in range(max(1, len(data) - 2))]
        known = [w["word"][model.vocabulary.get(f, 0)] for f in (stem, stem[:5] + "~")]
        return [sum(float(t[i]) for t in tri) / len(tri) + sum(float(k[i]) for k in known) for i in range(toxicity.INPUT)]

    def states(inputs, side):
        h, out, n = [0.0] * toxicity.HIDDEN, [], toxicity.HIDDEN
        for x in inputs:
            p = [a + float(c) for a, c in zip(dot(x, w[f"w{side}"]), w[f"c{side}"])]
            a = dot(h, w[f"u{side}"])
            z, r = ([gate(p[j] + a[j]) for j in range(k, k + n)] for k in (0, n))
            new = [np.tanh(p[2 * n + j] + r[j] * a[2 * n + j]) for j in range(n)]
            h = [new[j] + z[j] * (h[j] - new[j]) for j in range(n)]
            out.append(h)
        return out

    best, at = -np.inf, 0
    while True:
        part = words[at : at + toxicity.WINDOW]
        inputs = [vector(x) for x in part] + [[0.0] * toxicity.INPUT] * (toxicity.WINDOW - len(part))
        both = [f + b for f, b in zip(states(inputs, "f"), states(inputs[::-1], "b")[::-1])]
        here = both[: len(part)] or both  # a text without words is all padding
        share = np.exp([sum(np.tanh(x) * float(a) for x, a in zip(h, w["attend"])) for h in here])
        pooled = [sum(s * h[j] for s, h in zip(share / share.sum(), here)) for j in range(2 * toxicity.HIDDEN)]
        best = max(best, sum(p * float(o) for p, o in zip(pooled, w["out"])) + float(w["bias"][0]))
        if at + toxicity.WINDOW >= len(words):
            return gate(best)
        at += toxicity.STRIDE


def test_toxicity_scores_by_loops(spark):
    """Whole texts, by the operator and by loops: no word, one, a window's edge, several windows, unknown words."""
    model = toxicity.Model.start({f: k for k, f in enumerate(["alpha", "alpha~", "beta", "beta~", "gamma~"], 1)})
    rng = random.Random(6)
    texts = ["", "alpha", "Alpha, BETA! 42 é日", *(" ".join(rng.choice([*WORDS, "gamma", "x-9", "ALPHA"]) for _ in range(n)) for n in (31, 32, 33, 56, 57, 90))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got[99] == got[0]
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(plain_toxicity(model, t), abs=1e-5), t
