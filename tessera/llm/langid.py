"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order tree of byte contexts with frozen counts. A symbol that
a context has not seen is coded by an escape (method C: as likely as the context has
distinct symbols) and then by the next shorter context with the seen symbols excluded,
down to a uniform code. The exact code length of every (context, symbol) pair is compiled
into one table for all languages, so a text's code length under each language is a sum of
table rows; the language with the shortest code wins.

A-Z count as a-z; all other ASCII bytes that are not letters count as one symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_fold, small_batches, text_batches, within_bytes

SAMPLE_ROWS = 300  # the most training documents of each language that the fit reads
SAMPLE_BYTES = 32_000_000  # and the most bytes of their texts, of each language
FOLDS, HELD_OUT = 4, 2
SPARE = 8  # how many times the sample the ids are that are sorted for it
ORDER = 3
LEAST_SEEN = 4  # longer contexts seen less often, in all languages together, have no node
UNDETERMINED = "und"
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
_WINDOW = 500_000


class Model:
    """languages; symbol: byte -> symbol; row: context -> table row; bits[row * S + symbol, language]."""

    def __init__(self, languages: list[str], symbol: np.ndarray, row: np.ndarray, bits: np.ndarray):
        self.languages, self.symbol, self.row, self.bits = languages, symbol, row, bits
        self.size = int(symbol.max(initial=0)) + 1


def _symbols(texts_of: list[str]) -> np.ndarray:
    """Folded bytes of the texts, with blanks around each."""
    joined = "   ".join(["", *texts_of, ""]).encode("utf-8", "surrogatepass")
    return np.frombuffer(joined.translate(_FOLD), np.uint8)


def fit(rows: list[tuple[str, str]], order: int = ORDER) -> Model:
    """rows: language and whole text. Order 3 uses S^3 context cells, at most 4 million."""
    languages = sorted({lang for lang, _ in rows})
    streams = [_symbols([t for lang, t in rows if lang == name]) for name in languages]
    seen = np.unique(np.concatenate([np.array([0x20], np.uint8), *streams]))
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)  # 0: a byte that no language has seen
    size, count = len(seen) + 1, len(languages)
    # counts[k]: contexts of k symbols (sorted codes, most recent symbol last) and counts by language
    levels = []
    coded = [symbol[s] for s in streams]
    for k in range(order + 1):
        pairs = []
        for s in coded:
            context = np.zeros(max(0, len(s) - order), np.int64)
            for back in range(k, 0, -1):
                context = context * size + s[order - back : len(s) - back]
            pairs.append(np.unique(context * size + s[order:], return_counts=True))
        contexts = np.unique(np.concatenate([p // size for p, _ in pairs] or [np.zeros(0, np.int64)]))
        table = np.zeros((len(contexts), size, count), np.float32)
        for j, (codes, n) in enumerate(pairs):
            table[np.searchsorted(contexts, codes // size), codes % size, j] = n
        often = table.sum(axis=(1, 2)) >= (LEAST_SEEN if k > 1 else 1)
        levels.append((contexts[often], table[often]))
    rows_of, chances, first = {}, [np.full((1, size, count), 1 / 256, np.float32)], 1
    parent_of = np.zeros(1, np.int64)  # context code -> row, one level shorter
    for k, (contexts, table) in enumerate(levels):
        up = parent_of[contexts % size ** (k - 1)] if k > 1 else np.full(len(contexts), 0 if k == 0 else rows_of[0])
        above = np.concatenate(chances)[up]
        total, distinct = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
        rest = np.where(table > 0, 0, above).sum(axis=1, keepdims=True)
        escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
        chance = np.where(table > 0, table / np.maximum(total + distinct, 1), escape * above / np.maximum(rest, 1e-9)).astype(np.float32)
        chance = np.where(total > 0, chance, above)
        chances.append(chance)
        here = np.arange(first, first + len(contexts))
        first += len(contexts)
        rows_of[k] = int(here[0]) if len(here) else 0
        now = np.full(size**k, rows_of.get(0, 0), np.int64) if k <= 1 else np.tile(parent_of, size)
        now[contexts] = here
        parent_of = now
    bits = -np.log2(np.maximum(np.concatenate(chances), 1e-12)).reshape(first * size, count)
    return Model(languages, symbol.astype(np.int16), parent_of.astype(np.int32), bits.astype(np.float32))


def code_lengths(model: Model, batch: list[str], order: int = ORDER) -> np.ndarray:
    """Bits of each whole text under each language. Each text is coded after `order` blanks."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_FOLD) for t in batch]
    ends = np.cumsum([len(r) + order for r in raw])
    stream = model.symbol[np.frombuffer(b"".join(b" " * order + r for r in raw), np.uint8)].astype(np.int64)
    owner_ends, size = ends - 1, model.size
    lead = np.zeros(len(stream), bool)  # the blanks before a text are context only
    lead[(np.concatenate([[0], ends[:-1]])[:, None] + np.arange(order)).ravel()] = True
    total = np.zeros((len(batch), len(model.languages)))
    for at in range(0, len(stream), _WINDOW):
        end = min(len(stream), at + _WINDOW)
        start = max(at, order)
        if start >= end:
            continue
        context = stream[start - order : end - order]
        for back in range(order - 1, 0, -1):
            context = context * size + stream[start - back : end - back]
        bits = model.bits[model.row[context] * np.int64(size) + stream[start:end]]
        bits[lead[start:end]] = 0
        first = int(np.searchsorted(owner_ends, start))
        last = int(np.searchsorted(owner_ends, end - 1))
        cuts = np.maximum(np.concatenate([[start], ends[first:last]]), start) - start
        total[first : last + 1] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
    return total


def predict(model: Model, batch: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text; `und` with score 0 for null and for texts without a letter."""
    usable = [bool(t) and _LETTER.search(t) is not None for t in batch]
    if not model.languages:
        return [UNDETERMINED] * len(batch), np.zeros(len(batch))
    bits = code_lengths(model, [t if ok else "" for t, ok in zip(batch, usable, strict=True)])
    best = bits.argmin(axis=1)
    gap = (bits - bits.min(axis=1, keepdims=True)) * np.log(2)
    score = np.where(usable, 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1), 0.0)
    return [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, usable, strict=True)], score


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int, most: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """Of the training rows of each language the `sample` first by hash of the id, whole texts.

    Ids are picked without their texts; only the picked ids (sample times languages) are broadcast. Of each language
    only the beginning of the order that holds about SPARE times the sample is sorted, so no task follows the size
    of a language; hashes are even, so that beginning holds the sample. Where the
    texts of a language hold more than `most` bytes, the first that fit are taken, one at least."""
    train = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (crc_fold(id_col, FOLDS) != HELD_OUT))
    ids = train.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang")).distinct()  # the limit counts documents, not rows
    place = F.xxhash64("__id")
    sizes = ids.groupBy("__lang").agg(F.count("*").alias("__n"))
    share = (place.cast("double") / 2.0**64 + 0.5) * F.col("__n")  # about how many ids of the language come before
    first = ids.join(sizes, "__lang").where(share <= SPARE * max(sample, 100))
    picked = first.withColumn("__at", F.row_number().over(W.partitionBy("__lang").orderBy(place, "__id"))).where(F.col("__at") <= sample).select("__id", "__lang")
    texts_of = train.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    rows = texts_of.join(F.broadcast(picked), ["__id", "__lang"]).groupBy("__id", "__lang").agg(F.min("__text").alias("__text"))
    rows = within_bytes(rows, "__text", "__lang", most).collect()
    return sorted((r["__lang"], r["__text"]) for r in rows)


def fit_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> Model:
    """Fit on training rows only: crc32 of the id modulo 4 is not 2, language and text not null; of each language at
    most `sample` documents and `most` bytes of them."""
    return fit(training_rows(docs, id_col, text_col, lang_col, sample, most))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text.

    Returns id_col, lang_pred string and score double (posterior under equal priors). Null texts and texts without a letter
    are `und` with score 0; equal code lengths go to the first language by name; repeated rows are
    scored each; other columns are not read. A map without a shuffle; the model's tables are bounded
    by the sample.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in text_batches(batches, 1, 128):
            names, score = predict(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key_type}, lang_pred string, score double")
