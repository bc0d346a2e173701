"""Exact removal of long repeated word sequences by recompression.

Naming. Names are hashes: this replaces the exchange of a dictionary in a Spark round a level, as a
name depends on the named symbols alone and is the same wherever it is computed. So all levels
run in one map, and what Spark shuffles are anchors. A text's words are level-0 symbols. A round names maximal runs of one symbol and
then pairs of neighbours whose first is of the left and second of the right class; classes
are bits of hashes of symbols. Whether symbols merge depends on themselves alone, so the parse of a
substring is the same wherever it stands, except near its ends: there a symbol may merge
with one outside. Following that rule level by level gives, for each window of `size`
words, the symbols that its content alone determines; the highest level that still has one
provides the window's anchor (the one with the least hash). Equal windows therefore have
equal anchors at equal offsets: a window that occurs twice has an anchor that occurs twice.
Windows that are left without a symbol above the first levels (long runs) are their own anchors.

Revealing and verifying. Neighbouring windows with one anchor form an occurrence: anchor,
hash of all words it spans. Anchors that occur once are dropped. An occurrence whose span
hash occurs again under its anchor is repeated as a whole. Of the others (the edges of repeats),
and of one occurrence of each span they could share windows with, single windows are compared.
Equality is by two 64-bit hashes of different kinds, the anchor's (a tree of mixed symbols) and the
span's or window's (a polynomial modulo a prime), not by comparing words. The two start from hashes of the words under
two secret keys of the run, so words that agree in one do not agree in the other, and none can be made to agree. Groups are only
counted, never collected: a passage in a million documents costs a row each. Rows are known by
128 bits; equal rows share their occurrences, which are told once to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, release, slices, small_batches, text_batches
from .hashing import GOLDEN, PLAIN, Keys, Spans, fresh_keys, hashed_under, mix, times

WINDOW = 35
TEXTS_AT_ONCE, ROWS_AT_ONCE = 500, 16_384  # texts that come from Spark with their notes, and notes that go back, at once
ROUNDS, RUN_ROUNDS, LEAST_LEVEL = 6, (0, 4), 2
_IN_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
ALL, WINDOWS = 1, 2  # what a document is told of an occurrence: repeated as a whole, compare its windows


def word_hashes(column: pa.StringArray, keys: Keys = PLAIN) -> list[list[np.ndarray]]:
    """Under each key. Words stand between blanks and U+0009 to U+000D."""
    return hashed_under(column, _IN_WORD, keys)


def _run_step(sym: np.ndarray, start: np.ndarray):
    """Names runs. Returns the new symbols, starts, and where the first and last certain symbol go:
    a window's first and last runs may go on outside it."""
    m = len(sym)
    begins = np.ones(m, bool)
    begins[1:] = sym[1:] != sym[:-1]
    group = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    length = np.diff(np.append(first, m))
    names = sym[first].copy()
    long = length > 1
    names[long] = mix(names[long] + times(GOLDEN, length[long]) + np.uint64(7))
    low = np.append(group + 1, len(first))
    high = np.concatenate([[0], group])
    return names, np.append(start[first], start[-1]), low, high


def _pair_step(sym: np.ndarray, start: np.ndarray, wall: np.ndarray, step: int):
    """Names pairs of a left and a right symbol. At a window's ends a right symbol may pair with one
    before it and a left symbol with one after it."""
    m = len(sym)
    right = ((mix(sym + times(GOLDEN, step + 1)) >> np.uint64(17)) & np.uint64(1)).astype(bool)
    left = ~right & ~wall
    right &= ~wall
    pair = np.zeros(m, bool)
    pair[:-1] = left[:-1] & right[1:]
    begins = np.ones(m, bool)
    begins[1:] = ~pair[:-1]
    group = np.append(np.cumsum(begins) - 1, begins.sum())
    first = np.flatnonzero(begins)
    names = sym[first].copy()
    merged = pair[first]
    names[merged] = mix(mix(names[merged] + times(GOLDEN, step)) * np.uint64(3) + sym[first[merged] + 1])
    at = np.arange(m + 1)
    low = group[np.minimum(at + np.append(right, False), m)]
    high = group[np.maximum(at - np.concatenate([[False], left]), 0)]
    return names, np.append(start[first], start[-1]), wall[first], low, high


def anchors(docs: list[np.ndarray], size: int = WINDOW, rounds: int = ROUNDS, others: list[np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Occurrences in documents given as word hashes: doc, first (window), count, key, span. Symbols and keys are built
    from `docs`, spans from `others`, the hashes of the same words under another key (by default the same)."""
    docs_of = [i for i, d in enumerate(docs) if len(d) >= size]
    kept = [docs[i] for i in docs_of]
    if not kept:
        return {k: np.zeros(0, np.int64) for k in ("doc", "first", "count", "key", "span")}
    lengths = np.array([len(d) for d in kept])
    bases = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])  # a wall after each document
    total = int((lengths + 1).sum())
    words, wall = np.zeros(total, np.uint64), np.zeros(total, bool)
    ends = bases + lengths
    wall[ends] = True
    words[~wall] = np.concatenate(kept)
    words[ends] = mix(times(GOLDEN, np.arange(len(ends)) + 1))
    checked = words.copy()
    if others is not None:
        checked[~wall] = np.concatenate([others[i] for i in docs_of])
    counts = lengths - size + 1
    window = np.repeat(bases - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    key, pick = np.zeros(len(window), np.uint64), np.zeros(len(window), np.int64)
    spans, own = Spans(checked), None
    sym, start, live, low, high, level = words, np.arange(total + 1), np.arange(len(window)), window.copy(), window + size, 0

    def settle(who, lo, hi):
        nonlocal own
        if level < LEAST_LEVEL:
            own = own or Spans(words)
            key[who] = mix(own.hash(window[who], window[who] + size))
            pick[who] = window[who]
            return
        best = lo.copy()
        least = mix(sym[best] + np.uint64(99))
        for k in range(1, int((hi - lo).max(initial=0))):
            at = np.minimum(lo + k, hi - 1)
            value = mix(sym[at] + np.uint64(99))
            better = value < least
            best, least = np.where(better, at, best), np.where(better, value, least)
        key[who], pick[who] = sym[best], start[best]

    for step in range(rounds):
        lo, hi, now = low, high, (sym, start, wall)
        if step in RUN_ROUNDS:
            names, starts, f, g = _run_step(now[0], now[1])
            lo, hi, now = f[lo], g[hi], (names, starts, wall[np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))])
        names, starts, walls, f, g = _pair_step(*now, step)
        inside = lo < hi
        lo, hi = f[lo], g[hi]
        stay = inside & (lo < hi)
        if not stay.all():
            settle(live[~stay], low[~stay], high[~stay])
        live, low, high, sym, start, wall, level = live[stay], lo[stay], hi[stay], names, starts, walls, level + 1
        if not len(live):
            break
    if len(live):
        settle(live, low, high)
    owner = np.repeat(np.arange(len(kept)), counts)
    begins = np.ones(len(window), bool)
    begins[1:] = (key[1:] != key[:-1]) | (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, len(window)))
    span = mix(spans.hash(window[first], window[first] + count + size - 1) + times(GOLDEN, pick[first] - window[first]))
    return {"doc": np.array(docs_of)[owner[first]], "first": window[first] - bases[owner[first]], "count": count, "key": key[first].view(np.int64), "span": span.view(np.int64)}


def _told(column: pa.ListArray) -> tuple[np.ndarray, ...]:
    """text index, first, count, key and code of all notes of a batch."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    notes = column.flatten()
    return np.repeat(np.arange(len(column)), counts), *(notes.field(i).to_numpy(zero_copy_only=False) for i in range(4))


def _covered(lengths: np.ndarray, owner: np.ndarray, first: np.ndarray, count: np.ndarray, size: int) -> list[np.ndarray]:
    """Of texts of so many words, which words lie in the windows that start at first, first + 1, ... (count of them)."""
    base = np.concatenate([[0], np.cumsum(lengths + 1)])
    step = np.zeros(base[-1] + 1, np.int32)
    np.add.at(step, base[owner] + first, 1)
    np.add.at(step, base[owner] + first + count - 1 + size, -1)
    cover = np.cumsum(step) > 0
    return [cover[a : a + n] for a, n in zip(base[:-1].tolist(), lengths.tolist(), strict=True)]


def occurrences(rows: DataFrame, size: int = WINDOW, rounds: int = ROUNDS, keys: Keys = PLAIN) -> DataFrame:
    """key, span, __row, __twin, first, count of rows __row, __twin, __text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2):
            words, others = word_hashes(batch.column(2), keys)
            found = anchors(words, size, rounds, others)
            own = pa.array(found["doc"], pa.int64())
            out = pa.RecordBatch.from_arrays(
                [pa.array(found["key"]), pa.array(found["span"]), batch.column(0).take(own), batch.column(1).take(own), pa.array(found["first"], pa.int32()), pa.array(found["count"], pa.int32())],
                names=["key", "span", "__row", "__twin", "first", "count"],
            )
            yield from slices([out], ROWS_AT_ONCE)

    return rows.mapInArrow(run, "key long, span long, __row long, __twin long, first int, count int")


def told(found: DataFrame) -> DataFrame:
    """__row, __twin and its occurrences that matter, each once: array<struct<first, count, key, code>>.

    Shuffle files of a step are released before the next, so that the largest step bounds the disk."""
    spark = found.sparkSession
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi")).where("n > 1")
    keys = materialize(keys.select("key", (F.col("lo") == F.col("hi")).alias("pure")), "keys")
    release(spark)
    shared = materialize(found.join(keys, "key"), "shared")
    forget(keys)
    release(spark)
    mixed = shared.where("NOT pure").groupBy("key", "span").agg(F.count("*").alias("n"), F.min(F.struct("__row", "__twin", "first")).alias("one"))
    mixed = materialize(mixed.select("key", "span", "n", F.col("one.__row").alias("one_row"), F.col("one.__twin").alias("one_twin"), F.col("one.first").alias("one_first")), "mixed")
    again = shared.where("NOT pure").join(mixed, ["key", "span"])
    stands = (F.col("__row") == F.col("one_row")) & (F.col("__twin") == F.col("one_twin")) & (F.col("first") == F.col("one_first"))
    code = F.when(F.col("n") > 1, F.lit(ALL)).otherwise(0) + F.when((F.col("n") == 1) | stands, F.lit(WINDOWS)).otherwise(0)
    coded = again.select("__row", "__twin", "first", "count", "key", code.cast("int").alias("code")).unionAll(shared.where("pure").select("__row", "__twin", "first", "count", "key", F.lit(ALL).alias("code")))
    lists = materialize(coded.groupBy("__row", "__twin").agg(F.collect_set(F.struct("first", "count", "key", "code")).alias("__told")), "told")
    forget(shared, mixed)
    return lists


_TOLD = "array<struct<first:int,count:int,key:bigint,code:int>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, rounds: int = ROUNDS, carry: list[str] | None = None, keep_unchanged: bool = False) -> DataFrame:
    """Remove every word covered by a window of `size` words that also starts anywhere else.

    Returns id_col, the columns named in `carry`, n_words, n_removed and kept (the remaining
    words joined by one blank; with keep_unchanged, texts that lose nothing as they are). Windows are judged on the input. Null and empty texts have
    no words; texts of fewer than `size` words keep all; repeated rows are documents of their
    own, so their long texts go. Other columns are not read.
    """
    spark, keys = docs.sparkSession, fresh_keys()
    small_batches(spark, TEXTS_AT_ONCE)
    carried = [c for c in carry or [] if c not in (id_col, text_col)]
    kept_columns = F.struct(F.col(id_col).alias("__id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)))
    rows = docs.select(F.xxhash64(id_col, text_col, F.lit(1)).alias("__row"), F.xxhash64(F.lit(2), id_col, text_col).alias("__twin"), F.col(text_col).alias("__text"), kept_columns.alias("__kept"))
    kept_type = rows.schema["__kept"].dataType.simpleString()
    found = materialize(occurrences(rows.select("__row", "__twin", "__text"), size, rounds, keys), "occurrences")
    release(spark)
    lists = told(found)
    forget(found)
    release(spark)
    judged = rows.join(lists, ["__row", "__twin"], "left").select("__row", "__twin", "__text", "__kept", "__told")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2):
            whole = batch.column(2).to_pylist()
            words = [_split(t) for t in whole]
            lengths = np.array([len(w) for w in words], np.int64)
            owner, first, count, _, code = _told(batch.column(4))
            sure = (code & ALL) > 0
            covers = _covered(lengths, owner[sure], first[sure], count[sure], size)
            is_open = np.zeros(len(words), bool)
            is_open[owner[(code & WINDOWS) > 0]] = True
            only_open = pa.array(np.arange(len(words)), mask=~is_open)  # null where nothing is left to compare
            kept = pa.array([None if o else _kept(t, w, c, keep_unchanged) for t, w, c, o in zip(whole, words, covers, is_open.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(lengths), pa.array([int(c.sum()) for c in covers], pa.int64()), kept, batch.column(2).take(only_open), batch.column(4).take(only_open), pa.array(is_open)],
                names=["__row", "__twin", "__kept", "n_words", "n_removed", "kept", "__text", "__told", "__open"],
            )

    first = judged.mapInArrow(judge, f"__row long, __twin long, __kept {kept_type}, n_words long, n_removed long, kept string, __text string, __told {_TOLD}, __open boolean")
    first = materialize(first, "judged")
    forget(lists)
    release(spark)
    pending = first.where("__open")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2):
            hashed = hashed_under(batch.column(2), _IN_WORD, keys[1:])[0]
            owner, first, count, key, code = _told(batch.column(3))
            ask = (code & WINDOWS) > 0
            owner, first, count, key = owner[ask], first[ask], count[ask], key[ask]
            base = np.concatenate([[0], np.cumsum([len(h) for h in hashed])]).astype(np.int64)
            place = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            at = np.repeat(base[owner], count) + place
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(key, count)), pa.array(Spans(np.concatenate(hashed)).hash(at, at + size).view(np.int64)), *(batch.column(c).take(pa.array(np.repeat(owner, count))) for c in (0, 1)), pa.array(place, pa.int32())],
                names=["key", "window", "__row", "__twin", "place"],
            )
            yield from slices([out], ROWS_AT_ONCE)

    single = materialize(pending.select("__row", "__twin", "__text", "__told").mapInArrow(windows, "key long, window long, __row long, __twin long, place int"), "windows")
    twice = materialize(single.groupBy("key", "window").agg(F.count("*").alias("n")).where("n > 1").select("key", "window"), "twice")
    release(spark)
    # A repeated window is repeated wherever it stands; places already covered as a whole are no harm.
    hits = materialize(single.join(twice, ["key", "window"]).groupBy("__row", "__twin").agg(F.collect_set("place").alias("__places")), "hits")
    forget(single, twice)
    release(spark)
    closing = pending.select("__row", "__twin", "__text", "__kept", "__told").join(hits, ["__row", "__twin"], "left").select("__text", "__kept", "__told", "__places")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 0):
            whole = batch.column(0).to_pylist()
            words = [_split(t) for t in whole]
            lengths = np.array([len(w) for w in words], np.int64)
            owner, first, count, _, code = _told(batch.column(2))
            sure = (code & ALL) > 0
            places = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            place_owner = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy(zero_copy_only=False))
            covers = _covered(lengths, np.concatenate([owner[sure], place_owner]), np.concatenate([first[sure], places]), np.concatenate([count[sure], np.ones(len(places), np.int64)]), size)
            kept = [_kept(t, w, c, keep_unchanged) for t, w, c in zip(whole, words, covers, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lengths), pa.array([int(c.sum()) for c in covers], pa.int64()), pa.array(kept, pa.string())], names=["__kept", "n_words", "n_removed", "kept"])

    closed = closing.mapInArrow(close, f"__kept {kept_type}, n_words long, n_removed long, kept string")
    out = first.where("NOT __open").select("__kept", "n_words", "n_removed", "kept").unionAll(closed)
    return out.select(F.col("__kept.__id").alias(id_col), *(F.col(f"__kept.c{i}").alias(c) for i, c in enumerate(carried)), "n_words", "n_removed", "kept")


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _kept(text: str | None, words: list[bytes], cover: np.ndarray, keep_unchanged: bool) -> str | None:
    if cover.any():
        words = [words[i] for i in np.flatnonzero(~cover).tolist()]
    elif keep_unchanged:
        return text
    return b" ".join(words).decode("utf-8", "surrogatepass")
