"""The corpus pipeline: raw documents to packed training sequences.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. In every stage a null text counts as empty, null doc_ids are rows like others, columns beyond
those of ``documents`` are kept as they are, repeated rows are rows of their own unless said otherwise,
and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that score 0.5 or more go.

    The model is fitted on at most 800 labelled documents of each label, of whatever ``docs`` holds;
    without labels, or with one label only, it scores every text by that label's share. Equal texts
    score alike.
    """
    from shelfmark.llm import toxicity
    from shelfmark.llm.common import table

    model = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, on shingles of five words: one document of each class of similarity 0.8 stays.

    It is the one with the smallest doc_id, a null one only where there is no other; of repeated rows
    one stays. Texts without words are one class.
    """
    from shelfmark.llm import simhash

    return simhash.keep_one(docs, size=5, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every document stays, each secret in it is masked; null text stays null."""
    from shelfmark.llm import secrets

    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rows leave or repeat until sources have their target weights.

    A null source is one, after all others; texts without words add nothing and are sampled like others.
    """
    from shelfmark.llm import mixing

    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: pieces of documents, each with its sequence and place; an empty text is its end id."""
    import public_tokenizers

    from shelfmark.llm import packing

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), "dropped", end_id=1, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Training, fingerprints and packing have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next.

    A stage's tables are deleted once the next one is written; packing has read the last of them when it
    returns its pieces. Odd rows are treated as the stages say; an empty ``documents`` gives no sequences.
    """
    from shelfmark.llm.common import discard, materialize, table

    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        result = stage(spark, docs, sf_dir)
        after = materialize(result, f"stage-{name}")
        discard(*getattr(result, "reads", ()), *([docs] if k else []))
        docs = after
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return packed
