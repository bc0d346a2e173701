"""Importance resampling of documents towards a target collection, over hashed runs of words.

A feature is a run of words; its bucket is the crc32 of its bytes modulo the number of buckets. The gain of a bucket is
the log ratio of its share in the target and in the documents, a document's weight the mean gain of its features, and
Gumbel noise from a hash of the id turns the highest scores into a draw without replacement.

Features are never cut out as strings. A table classifies the bytes of an Arrow text buffer, differences of the classes
give the word boundaries, the words are moved together with one space between, and one table-driven checksum register a
feature advances over all features at once, a byte a step. Texts are read twice, once for the counts of the buckets and
once for the weights; shuffled are counts (at most one row a bucket and task) and one short row a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, text_batches
from .ranks import placed

BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
TOGETHER = 64  # bytes of a feature that registers read side by side; the rest of longer ones goes one at a time

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True


def _checksum_table() -> np.ndarray:
    """What each value of the low byte adds to the register: eight steps of the reflected CRC-32 polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_TABLE = _checksum_table()


def checksums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of raw[start:end] for all pairs at once."""
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that those still reading are a prefix
    begin, size = starts[order], (ends - starts)[order]
    state = np.full(len(begin), 0xFFFFFFFF, np.uint32)
    longest = int(size[0]) if len(size) else 0
    reading = len(size) - np.cumsum(np.bincount(np.minimum(size, TOGETHER), minlength=TOGETHER + 1))  # more than k bytes, by k
    for k in range(min(longest, TOGETHER)):
        live = state[: reading[k] if k < TOGETHER else 0]
        live[:] = _TABLE[(live ^ raw[begin[: len(live)] + k]) & np.uint32(0xFF)] ^ (live >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > TOGETHER).tolist():
        state[i] = zlib.crc32(raw[begin[i] + TOGETHER : begin[i] + size[i]], int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def word_features(column: pa.Array, most_words: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 of every run of 1 to most_words words of each text, and how many features and words each text has.

    Features of a text stand together, in the order of the texts. Null has none."""
    rows = len(column)
    _, offsets, values = column.buffers()
    none = np.zeros(rows, np.int64)
    if values is None or not rows:
        return np.zeros(0, np.uint32), none, none
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    raw = _FOLD[np.frombuffer(values, np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _IN_WORD[raw]
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = at[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(raw))])
    split = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)]  # two texts meet within a run of word bytes
    starts, ends = np.sort(np.concatenate([first, split])), np.sort(np.concatenate([last, split]))
    words = np.diff(np.searchsorted(starts, at))
    if most_words == 1:
        return checksums(raw, starts, ends), words, words
    size = ends - starts
    begin = np.cumsum(size + 1) - size - 1  # in the buffer of words, each with a space behind
    together = np.full(int((size + 1).sum()), 0x20, np.uint8)
    source = np.repeat(starts - begin, size) + (place := np.repeat(begin, size) + _ramp(size))
    together[place] = raw[source]
    owner = np.repeat(np.arange(rows), words)
    found, whose = [], []
    for n in range(1, most_words + 1):
        head = np.arange(max(0, len(begin) - n + 1))
        head = head[owner[head] == owner[head + n - 1]] if len(head) else head
        found.append(checksums(together, begin[head], begin[head + n - 1] + size[head + n - 1]))
        whose.append(owner[head])
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return np.concatenate(found)[order], np.bincount(whose, minlength=rows), words


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def bucket_counts(rows: DataFrame, text_col: str = "text", most_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the features of all rows in it; buckets without features are missing. Each task adds its own up first."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_batches(batches, 0):
            total += np.bincount(word_features(batch.column(0), most_words)[0] % np.uint32(buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    return rows.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket from the counts of both sides (at most `buckets` rows each come to the driver)."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((source, s), (target, t)):
        for row in counts.collect():
            into[row["bucket"]] = row["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most_words: int = 1) -> DataFrame:
    """id_col, n_words, n_features and weight (the floored mean gain, 0 without features) of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    key_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in text_batches(batches, 1):
            found, count, words = word_features(batch.column(1), most_words)
            sums = np.concatenate([[0], np.cumsum(table[found % np.uint32(len(table))])])
            ends = np.cumsum(count)
            weight = np.where(count > 0, (sums[ends] - sums[ends - count]) // np.maximum(count, 1), 0)
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, count, weight))]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_words", "n_features", "weight"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key_type}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = PERCENT,
    most_words: int = 1,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Draw `percent` in a hundred (rounded down) of the documents with at least `least_words` words towards `target`.

    Returns id_col, n_words, n_features, weight, score and rank (from 1, best score first; null for documents that are
    not drawn) of every document. Null and empty texts have no words, weight 0, and are not drawn, nor are texts of
    fewer words; an empty target weighs by rarity alone. Ties of scores go to the smaller id, null before all others
    and hashed as empty text; rows that repeat an id share its noise, are each weighed, and stand by their number of
    features. An empty table gives no rows. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, most_words, buckets), bucket_counts(target, target_text_col, most_words, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = weigh(docs, gain, id_col, text_col, most_words).withColumnRenamed(id_col, "__id")
    scored = weighed.select(F.lit("").alias("__all"), "__id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("__may"))
    scored = materialize(scored, "resample-scores")
    drawn = scored.where("__may").count() * percent // 100
    ranked = placed(scored, "__all", [F.desc("__may"), F.desc("score"), "__id", "n_features"], "resample")
    rank = F.when(F.col("__at") < drawn, F.col("__at") + 1).alias("rank")
    return ranked.select(F.col("__id").alias(id_col), "n_words", "n_features", "weight", "score", rank)
