"""Quality by logistic regression over hashed runs of words, trained by follow-the-regularised-leader updates.

A text is a sequence of tokens: runs of word bytes and runs of other visible bytes, white space apart. Two streams of
names are read from it: the words themselves with A-Z as a-z, and what they look like (capitals, mixed, digits, letters
beyond ASCII, a repetition of the word before; other runs keep their bytes). Runs of one and two words and of one to
three looks are hashed to buckets, and a text is the vector of the logarithms of its counts, of length one. Weights come
from FTRL-proximal updates with a rate of its own for each bucket, one labelled document after another; L1
regularisation leaves most of them zero. A score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_fold, lists, small_batches, text_batches
from .hashing import GOLDEN, byte_hashes, mix, times

SAMPLE_ROWS = 2000  # the most training documents of each label that the fit reads
SAMPLE_CELLS = 4_000_000  # and the most cells of their vectors, of each label (one document at least)
FOLDS, HELD_OUT = 5, 0
BUCKETS = 1 << 18
WORD_RUN, LOOK_RUN = 2, 3  # the longest runs of words and of looks
RATE, SMOOTH, L1, L2 = 0.5, 1.0, 0.02, 0.1
ROUNDS = 12

_SPACE, _WORD, _MARK = 0, 1, 2
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = _SPACE
_CLASS[0x30:0x3A] = _CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = _WORD
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


class Model(NamedTuple):
    """Weights of the buckets and the constant term."""

    weights: np.ndarray
    bias: float


def _tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and class of the tokens of a buffer of texts; at: where texts begin, and the end of the last."""
    kind = _CLASS[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[0] = cut[-1] = True
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[at] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    seen = kind[starts] != _SPACE
    return starts[seen], ends[seen], kind[starts][seen]


def _looks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray, same: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A name for what each token looks like. own: hashes of the tokens, which other runs than words keep."""

    def count(low: int, high: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum((raw >= low) & (raw <= high))])
        return sums[ends] - sums[starts]

    upper, lower, digit, far = count(0x41, 0x5A), count(0x61, 0x7A), count(0x30, 0x39), count(0x80, 0xFF)
    begins = (raw[starts] >= 0x41) & (raw[starts] <= 0x5A)
    look = (begins * 1 + (upper > begins) * 2 + (lower > 0) * 4 + (digit > 0) * 8 + (far > 0) * 16).astype(np.uint64)
    return np.where(word, np.where(same, np.uint64(32), look) + np.uint64(1), own)


def _runs(names: np.ndarray, owner: np.ndarray, longest: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the runs of 1 to `longest` names of one owner, and their owners."""
    salt = times(GOLDEN, [seed])
    chain = mix(names + salt)
    found, whose = [chain], [owner]
    for n in range(1, longest):
        chain = mix(chain[:-1] * np.uint64(3) + mix(names[n:] + salt))
        inside = owner[: len(chain)] == owner[n:]
        found.append(chain[inside])
        whose.append(owner[: len(chain)][inside])
    return found, whose


def vectors(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cuts, buckets and values of the sparse vectors of the texts: text i has the cells cuts[i]:cuts[i + 1], by bucket."""
    rows = len(column)
    _, offsets, values = column.buffers()
    if values is None or not rows:
        return np.zeros(rows + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    raw = np.frombuffer(values, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    starts, ends, kind = _tokens(raw, at)
    owner = np.searchsorted(at, starts, side="right") - 1
    word = kind == _WORD
    own = byte_hashes(_FOLD[raw], starts, ends)
    words, theirs = own[word], owner[word]
    same = np.zeros(len(own), bool)
    same[np.flatnonzero(word)[1:]] = (words[1:] == words[:-1]) & (theirs[1:] == theirs[:-1])
    by_word, by_look = _runs(words, theirs, WORD_RUN, 1), _runs(_looks(raw, starts, ends, word, same, own), owner, LOOK_RUN, 2)
    found, whose = np.concatenate(by_word[0] + by_look[0]), np.concatenate(by_word[1] + by_look[1])
    cells, count = np.unique(whose * np.int64(buckets) + (found % np.uint64(buckets)).astype(np.int64), return_counts=True)
    text, value = cells // buckets, np.log1p(count)
    length = np.sqrt(np.bincount(text, value * value, minlength=rows))
    return np.searchsorted(text, np.arange(rows + 1)), cells % buckets, value / length[text]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], share: float | None = None, buckets: int = BUCKETS, rounds: int = ROUNDS) -> Model:
    """FTRL-proximal over rows of (buckets, values, label), in the given order, `rounds` times.

    z holds the sums of gradients corrected by what earlier weights have moved, n those of squared gradients; the
    weight of a bucket is zero while |z| <= L1 and else the closed-form minimum. The constant term is the log odds of
    label 1, so that a text without cells scores its share. share: that of label 1 among all labelled documents, where
    the rows were picked by label; an update counts as many documents as its row stands for."""
    mine = sum(label for *_, label in rows)
    here = (mine + 0.5) / (len(rows) + 1)
    share = min(max(here if share is None else share, 1e-6), 1 - 1e-6)
    stands_for, bias = {1: share / here, 0: (1 - share) / (1 - here)}, math.log(share / (1 - share))
    z, n = np.zeros(buckets), np.zeros(buckets)

    def weights(pull: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return np.where(np.abs(pull) <= L1, 0.0, -(pull - np.sign(pull) * L1) / ((SMOOTH + np.sqrt(seen)) / RATE + L2))

    for _ in range(rounds):
        for cells, values, label in rows:
            w, before = weights(z[cells], n[cells]), n[cells]
            gradient = (_sigmoid(w @ values + bias) - label) * values * stands_for[label]
            n[cells] += gradient * gradient
            z[cells] += gradient - (np.sqrt(n[cells]) - np.sqrt(before)) / RATE * w
    return Model(weights(z, n).astype(np.float32), bias)


def dot(model: Model, cuts: np.ndarray, cells: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each sparse vector."""
    sums = np.concatenate([[0.0], np.cumsum(model.weights[cells].astype(float) * values)])
    return _sigmoid(sums[cuts[1:]] - sums[cuts[:-1]] + model.bias)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, most: int) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], float]:
    """A bounded sample of vectors, in the order of a hash of the id, and the share of label 1 among all training ids.

    Of the training ids of each label that have a document, the `sample` first by hash, and of those the first whose
    vectors hold `most` cells together, one at least. Ids with both labels are left out; a repeated id gives one row, that
    with the smallest text. Only the picked ids (at most 2 * sample) are broadcast, texts become vectors where they are
    read, and only vectors come to the driver."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_fold(id_col, FOLDS) != HELD_OUT))
    usable = usable.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"), F.max(label_col).alias("__high")).where("__label = __high")
    usable = usable.join(docs.select(F.col(id_col).alias("__id")).distinct(), "__id", "left_semi").select("__id", F.col("__label").cast("int").alias("__label"))
    total = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum("__label"), F.lit(0)).alias("good")).first()
    place = F.xxhash64(F.lit(11), "__id")
    picked = [usable.where(F.col("__label") == y).orderBy(place, "__id").limit(sample) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts_of = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text"))
    texts_of = texts_of.join(F.broadcast(picked), "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text"))
    key_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2):
            cuts, cells, values = vectors(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(cells, cuts, pa.int32()), lists(values, cuts, pa.float32())], names=["__id", "__label", "cells", "values"])

    found = texts_of.mapInArrow(run, f"`__id` {key_type}, `__label` int, cells array<int>, values array<float>")
    order = W.partitionBy("__label").orderBy(place, "__id").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("__before", F.coalesce(F.sum(F.size("cells").cast("long")).over(order), F.lit(0)))
    kept = found.where((F.col("__before") == 0) | (F.col("__before") + F.size("cells") <= most)).withColumn("__place", place).collect()
    kept.sort(key=lambda r: (r["__place"], str(r["__id"])))
    rows = [(np.array(r["cells"], np.int64), np.array(r["values"], float), r["__label"]) for r in kept]
    return rows, total["good"] / max(1, total["n"])


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_ROWS, most: int = SAMPLE_CELLS) -> Model:
    """Fit on training rows only (crc32 of the id modulo 5 is not 0), whole texts, at most `sample` documents of each label and
    `most` cells of their vectors. Without training rows every text scores one half."""
    rows, share = training_rows(docs, labels, id_col, text_col, label_col, sample, most)
    return train(rows, share if rows else None)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: id_col and score double, the probability of label 1.

    Null and empty texts, and texts of white space, have no cells and score the constant term; repeated rows are scored
    each; an empty table gives no rows; other columns are not read. A map without a shuffle; the model is one float a bucket.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in text_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dot(model, *vectors(batch.column(1))), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key_type}, score double")
