"""The corpus pipeline: five filters and edits in a row, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `documents`. run() applies them to the documents of sf_dir.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, neardup, packing, substrings, toxicity
from tessera.llm.common import materialize, small_batches, text_batches

LEAST_LANGUAGE_SCORE = 0.3  # of a posterior among the learned languages, so no test of whether any of them fits


def _filter(docs: DataFrame, keep) -> DataFrame:
    """The rows, unchanged, of which keep(texts) is true; a map without a shuffle."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in text_batches(batches, at, 128):
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist(), state), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose toxicity score is at least one half. Null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = spark.sparkContext.broadcast(toxicity.fit_model(docs, labels))

    def keep(texts: list[str | None], memo: dict) -> list[bool]:
        return [toxicity.score(model.value, p) < 0.5 for p in toxicity.document_marginals(model.value, [t or "" for t in texts], memo)]

    return _filter(docs, keep)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of undetermined language: null or without a letter. LEAST_LANGUAGE_SCORE drops
    besides only texts that four or more learned languages fit about equally well, in practice a few
    words; a text in none of the learned languages stays. A corpus without any labelled language is
    kept as it is."""
    model = spark.sparkContext.broadcast(langid.fit_model(docs))

    def keep(texts: list[str | None], _: dict) -> list[bool]:
        if not model.value.languages:
            return [True] * len(texts)
        names, score = langid.predict(model.value, texts)
        return [n != langid.UNDETERMINED and s >= LEAST_LANGUAGE_SCORE for n, s in zip(names, np.asarray(score), strict=True)]

    return _filter(docs, keep)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class. Documents without words are alone and stay."""
    return neardup.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of windows of 35 words that also start elsewhere, joined by blanks, and
    n_chars to match. Texts that lose nothing stay as they are, white space included; no row goes."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    renamed = docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in names.items()))  # no clash with the operator's columns
    edited = substrings.remove_repeats(renamed, carry=[*names.values()], keep_unchanged=True)
    out = {c: F.col(n).alias(c) for c, n in names.items()} | {"doc_id": F.col("doc_id"), "text": F.col("kept").alias("text")}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(kind)).otherwise(F.col(names["n_chars"])).alias("n_chars")
    return edited.select(*(out[c] for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens along the curve."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_identified),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: No stage but the last two is expressible in SQL (learned models, sketches); tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
