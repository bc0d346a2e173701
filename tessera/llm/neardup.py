"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Sketch. A document is the set of its five-word shingles, weighted by 1 + ln(count). Each
shingle starts a Poisson process whose rate is its weight; each arrival falls on a random
register and the earliest arrival keeps it. A shingle's process ends once its next arrival
is later than every register's (early termination). Two documents agree on a register with
the probability Jaccard similarity of their weights.

Banding. Registers are grouped in bands; documents that share a band share a bucket. Links are
decided by sets without counts, so a text with repeated shingles is posted by a second sketch
of unit weights too (without repeats both sketches are the same). Copies
(equal word sequences) are folded into one representative before that.

Verification. A link is a pair whose shingle sets have Jaccard similarity of at least the
threshold, computed exactly. Pairs are checked in two steps, neither of which expands a group
into all its pairs: first each member of a bucket against the bucket's centre (the member
that meets most others in all its buckets), which joins most groups; then the members of buckets
that still hold several classes, whatever their number, are joined exactly: every pair of
different classes that reaches the threshold shares a shingle among the rarest of both (a
prefix filter), and no filter drops a pair that could reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, release, slices, small_batches, text_batches
from .graphs import components
from .hashing import PLAIN, Keys, fresh_keys, hashed_under, mix

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
BITS = 2048  # of the bitmap that bounds how much two sets share
CHUNK = 256  # members of one shingle that are compared at once; more are dealt into pairs of chunks
PAIRS = 500_000  # pairs that are held at once
_SLACK = 1e-9  # against rounding: bounds only ever let more pairs through
#: Words are runs of ASCII letters and digits and of all other characters beyond ASCII.
_IN_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes(column: pa.StringArray, keys: Keys = PLAIN) -> list[list[np.ndarray]]:
    """Hashes of the lower-case words of each text, under each key."""
    return hashed_under(pc.utf8_lower(column), _IN_WORD, keys)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words; a shorter text is one run."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total += mix(words[i : len(words) - size + 1 + i] + _FACTORS[i % 5] * np.uint64(i // 5 + 1)) * _FACTORS[(i + 1) % 5]
    return mix(total + np.uint64(size))


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, count: int, registers: int) -> np.ndarray:
    """Signatures (count x registers) of weighted sets given flat; owner: the set of each element.
    Sets without elements have zeros. All sets advance together, one arrival of each live process a round."""
    earliest = np.full(count * registers, np.inf)
    holder = np.zeros(count * registers, np.uint64)
    live, time, step = np.arange(len(elements)), np.zeros(len(elements)), 0
    limit = np.full(count, np.inf)
    while len(live):
        step += 1
        random = mix(elements[live] + np.array([step], np.uint64) * _STEP)
        uniform = ((random >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        time = time - np.log(uniform) / weights[live]
        stay = time < limit[owner[live]]
        live, time, random = live[stay], time[stay], random[stay]
        cell = owner[live] * registers + (mix(random) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, cell, time)
        won = earliest[cell] == time
        holder[cell[won]] = elements[live[won]]
        touched = np.unique(owner[live])
        limit[touched] = earliest.reshape(count, registers)[touched].max(axis=1)
        stay = time < limit[owner[live]]
        live, time = live[stay], time[stay]
    return holder.reshape(count, registers)


def _band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Hashes (count x bands) of the bands of signatures."""
    grouped = signature.reshape(len(signature), bands, rows)
    hashed = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(signature), 1))
    for i in range(rows):
        hashed = mix(hashed ^ grouped[:, :, i]) + _FACTORS[i % 5]
    return hashed.view(np.int64)


def _contents(*both: list[np.ndarray]) -> list[np.ndarray]:
    """content and check: hashes of each word sequence by its words' hashes under one key and under the other, so
    that only sequences with equal words, or with two equal hashes of 64 bits, have both in common."""
    return [np.array([xxhash.xxh3_64_intdigest(w.tobytes()) for w in words], np.uint64).view(np.int64) for words in both]


def _apart(clashes: list[int]):
    """content, or where different sequences share it, a hash of both halves."""
    known = F.col("content")
    return (F.when(known.isin(clashes), F.xxhash64("content", "check")).otherwise(known) if clashes else known).alias("content")


def sketch_batch(batch: pa.StringArray, bands: int, rows: int, keys: Keys = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each text: hashes of its word sequence, words, distinct shingles, band hashes (of both sketches, each once)."""
    words, others = word_hashes(batch, keys)
    content, check = _contents(words, others)
    sets = [np.unique(shingles(w), return_counts=True) for w in words]
    sizes = np.array([len(s) for s, _ in sets], np.int64)
    elements = np.concatenate([s for s, _ in sets]) if sets else np.zeros(0, np.uint64)
    weights = 1 + np.log(np.concatenate([c for _, c in sets])) if sets else np.zeros(0)
    owner = np.repeat(np.arange(len(batch)), sizes)
    hashed = _band_hashes(prob_minhash(elements, weights, owner, len(batch), bands * rows), bands, rows)
    posted = list(hashed)
    again = np.zeros(len(batch), bool)
    again[owner[weights > 1]] = True
    if again.any():
        mine, place = again[owner], np.cumsum(again) - 1
        unit = _band_hashes(prob_minhash(elements[mine], np.ones(int(mine.sum())), place[owner[mine]], int(again.sum()), bands * rows), bands, rows)
        for i, row in zip(np.flatnonzero(again), unit, strict=True):
            posted[i] = np.concatenate([hashed[i], row[row != hashed[i]]])
    return content, check, np.array([len(w) for w in words], np.int64), sizes, posted


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, keys: Keys = PLAIN) -> DataFrame:
    """__id, content and check (hashes of the word sequence), n_words, size (distinct shingles), bands array<long>; a map."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1):
            content, check, n, sizes, hashed = sketch_batch(batch.column(1), bands, rows, keys)
            ends = np.cumsum([0, *map(len, hashed)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(hashed) if hashed else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content), pa.array(check), pa.array(n), pa.array(sizes), lists], names=["__id", "content", "check", "n_words", "size", "bands"])

    return docs.select(id_col, text_col).mapInArrow(run, f"__id {id_type}, content long, check long, n_words long, size long, bands array<long>")


def shingle_sets(docs: DataFrame, keys: Keys = PLAIN) -> DataFrame:
    """content, check and the sorted distinct shingle hashes (binary) of __text rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 0):
            words, others = word_hashes(batch.column(0), keys)
            yield pa.RecordBatch.from_arrays([*map(pa.array, _contents(words, others)), pa.array([np.unique(shingles(w)).tobytes() for w in words], pa.binary())], names=["content", "check", "shingles"])

    return docs.mapInArrow(run, "content long, check long, shingles binary")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose sets have Jaccard similarity of at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = shared >= threshold * (len(x) + len(y) - shared)
            chosen = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(chosen.columns[:2], names=["a", "b"])

    first = pairs.join(sets.select(F.col("content").alias("a"), F.col("shingles").alias("__x")), "a")
    both = first.join(sets.select(F.col("content").alias("b"), F.col("shingles").alias("__y")), "b")
    return both.select("a", "b", "__x", "__y").mapInArrow(run, "a long, b long")


def _ordered(left: str, right: str):
    return F.least(left, right).alias("a"), F.greatest(left, right).alias("b")


def _sizes_fit(a: str, b: str, threshold: float):
    """Sets whose sizes differ more than this cannot reach the threshold."""
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)


def _labelled(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int, keys: Keys | None) -> tuple[DataFrame, DataFrame, list[int], Keys]:
    """The sketch of every row, for each content (with words) class_id and class_content, the smallest
    id of its class and the content that has it, the contents that different sequences had, and the keys of the run."""
    spark, keys = docs.sparkSession, keys or fresh_keys()
    small_batches(spark)
    sketched = materialize(sketch(docs, id_col, text_col, bands, rows, keys), "sketch")
    fold = lambda: sketched.where("n_words > 0").groupBy("content").agg(F.min("__id").alias("low"), F.min("size").alias("size"), F.min("bands").alias("bands"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    folded = materialize(fold(), "folded")
    clashes = [r[0] for r in folded.where("lo <> hi").select("content").collect()]  # n^2 / 2^65 of n sequences: none, or about 70 of 5e10
    if clashes:
        sketched = sketched.withColumn("content", _apart(clashes))
        folded = materialize(fold(), "folded")
    posted = folded.select("content", "size", F.explode("bands").alias("bucket"))
    shared = materialize(posted.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = materialize(posted.join(shared, "bucket"), "members")
    release(spark)
    degrees = materialize(members.groupBy("content").agg(F.sum(F.col("n") - 1).alias("degree")), "degrees")
    members_by = materialize(members.join(degrees, "content"), "members")
    forget(members)
    centres = materialize(members_by.groupBy("bucket").agg(F.max(F.struct("degree", "content", "size")).alias("c")).select("bucket", F.col("c.content").alias("centre"), F.col("c.size").alias("centre_size")), "centres")
    star = members_by.join(centres, "bucket").where((F.col("content") != F.col("centre")) & _sizes_fit("size", "centre_size", threshold))
    star = materialize(star.select(*_ordered("content", "centre")).distinct(), "pairs")
    # Texts are fetched for documents that share a bucket, by the id that stands for their content.
    asked = degrees.select("content").join(folded.select("content", "low"), "content")
    named = docs.select(F.col(id_col).alias("low"), F.col(text_col).alias("__text"))
    wanted = asked.select(F.col("low").alias("__low")).distinct()
    sets = shingle_sets(named.join(wanted, F.col("low").eqNullSafe(F.col("__low")), "left_semi").select("__text"), keys)
    sets = materialize(sets.select(_apart(clashes), "shingles").dropDuplicates(["content"]), "sets")
    release(spark)
    links = materialize(verify(star, sets, threshold), "links")
    found = components(links)
    more = materialize(_residual(members_by, found, sets, threshold).exceptAll(star), "pairs")
    forget(star)
    late = materialize(verify(more, sets, threshold), "links")
    forget(more, sets, members_by, centres)
    if late.limit(1).count():
        found = components(links.union(late))
    release(spark)
    # Classes by content, with the smallest id; ties go to the smaller content.
    labelled = folded.select("content", "low").join(found.withColumnRenamed("node", "content"), "content", "left").withColumn("component", F.coalesce("component", "content"))
    lowest = labelled.groupBy("component").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "content")).alias("head"))
    by_content = labelled.join(lowest, "component").select("content", F.col("head.low").alias("class_id"), F.col("head.content").alias("class_content"))
    return sketched, materialize(by_content, "classes"), clashes, keys


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, keys: Keys | None = None) -> DataFrame:
    """The near-duplicate class of every row: id_col, class_id (smallest id of the class), n_words.

    Copies of one word sequence share a class; so do documents joined by links (see the module).
    Texts are lower-cased; words are runs of ASCII letters and digits and of all characters beyond ASCII. Null, empty and wordless texts
    are alone: class_id is their own id. Texts under five words are one shingle. Repeated rows
    share a class; a class without a non-null id has class_id null; other columns are not read. Words are hashed under two
    keys, by default secret ones of this run.
    """
    sketched, by_content, *_ = _labelled(docs, id_col, text_col, threshold, bands, rows, keys)
    out = sketched.select(F.col("__id").alias(id_col), "content", "n_words").join(by_content, "content", "left")
    return out.select(id_col, F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col(id_col)).alias("class_id"), "n_words")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, keys: Keys | None = None) -> DataFrame:
    """One row of each near-duplicate class, unchanged: one with the smallest id (of repeated rows
    the smallest by all columns). Null, empty and wordless texts all stay."""
    sketched, by_content, clashes, keys = _labelled(docs, id_col, text_col, threshold, bands, rows, keys)
    heads = by_content.where("content = class_content").select(F.col("content").alias("__head"), F.col("class_id").alias("__low"))
    held = materialize(sketched.where("n_words > 0").groupBy("__id", "content").agg(F.count("*").alias("__n")), "held")
    heads = held.join(heads, (F.col("content") == F.col("__head")) & F.col("__id").eqNullSafe(F.col("__low"))).select("__head", "__low", "__n")
    heads = materialize(heads, "heads")
    # Columns of the caller are carried under names of our own, so that none can clash.
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    own = docs.toDF(*names)
    id_own, at = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, int(at[1:])):
            words, others = word_hashes(batch.column(int(at[1:])), keys)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, _contents(words, others)), pa.array([len(w) > 0 for w in words])], names=[*names, "content", "check", "worded"])

    schema = T.StructType([*own.schema.fields, T.StructField("content", T.LongType()), T.StructField("check", T.LongType()), T.StructField("worded", T.BooleanType())])
    marked = own.mapInArrow(run, schema).select(*names, _apart(clashes), "worded")
    found = marked.join(heads, F.col("worded") & (F.col("content") == F.col("__head")) & F.col(id_own).eqNullSafe(F.col("__low")), "left")
    kept = found.where("__head IS NOT NULL OR NOT worded")
    back = [F.col(n).alias(c) for n, c in names.items()]
    if not heads.where("__n > 1").limit(1).count():
        return kept.select(back)
    again = kept.where("__n > 1 AND worded").groupBy("content", "__low").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return kept.where("__n = 1 OR NOT worded").select(*names).unionByName(again).select(back)


def _shingle_rows(sets: DataFrame) -> DataFrame:
    """content, component, size and each shingle of content, component, shingles rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
            sizes = np.array([len(x) for x in each], np.int64)
            own = pa.array(np.repeat(np.arange(len(each)), sizes))
            columns = [batch.column(0).take(own), batch.column(1).take(own), pa.array(sizes).take(own), pa.array(np.concatenate(each) if each else np.zeros(0, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["content", "component", "size", "shingle"])

    return sets.select("content", "component", "shingles").mapInArrow(run, "content long, component long, size long, shingle long")


def _bitmaps(sets: DataFrame) -> DataFrame:
    """content and a bitmap of its shingles modulo BITS, of content, shingles rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            bits = np.zeros((batch.num_rows, BITS), bool)
            for i, x in enumerate(batch.column(1)):
                bits[i, np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(BITS)] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary())], names=["content", "bits"])

    return sets.select("content", "shingles").mapInArrow(run, "content long, bits binary")


def _pairs_of_groups(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows i < j of equal group, for rows sorted by group, about PAIRS at a time."""
    n = len(group)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n) if n else np.zeros(0, np.int64)
    later = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n) - 1
    total = np.cumsum(later)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        count = later[at:end]
        first = np.repeat(np.arange(at, end), count)
        yield first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        at = end


def _could_link(members: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of different classes in whole groups (shingle, lo, hi, sorted) that may reach the threshold.
    Four bounds on what two sets share, none below the truth: sizes, places of the common shingle in
    both, bitmaps. Pairs of equal chunks are left to the group lo = hi."""
    shingle, lo, hi, chunk, content, component, size, place = (members.column(i).to_numpy() for i in range(8))
    bits = np.frombuffer(b"".join(members.column(8).to_pylist()), np.uint64).reshape(len(content), BITS // 64)
    change = np.ones(len(content), bool)
    change[1:] = (shingle[1:] != shingle[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    for i, j in _pairs_of_groups(np.cumsum(change)):
        fit = (component[i] != component[j]) & ((lo[i] == hi[i]) | (chunk[i] != chunk[j]))
        fit &= np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - _SLACK
        i, j = i[fit], j[fit]
        need = threshold / (1 + threshold) * (size[i] + size[j]) - _SLACK
        fit = np.minimum(place[i], place[j]) + np.minimum(size[i] - place[i], size[j] - place[j]) >= need
        i, j, need = i[fit], j[fit], need[fit]
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), 20_000):
            x, y = i[at : at + 20_000], j[at : at + 20_000]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            keep[at : at + 20_000] = (size[x] + size[y] - apart) / 2 >= need[at : at + 20_000]
        a, b = content[i[keep]], content[j[keep]]
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _residual(members: DataFrame, found: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different classes, both with members in buckets of several classes, that may reach the
    threshold; none that reaches it is missing, whatever the width of its buckets.

    Shingles of one class only come first in the order of shingles, then the rarer ones: sets that
    reach the threshold share one among the first size - threshold * size + 1 of both."""
    label = found.select(F.col("node").alias("content"), "component")
    now = members.select("bucket", "content").join(label, "content", "left").withColumn("component", F.coalesce("component", "content"))
    now = materialize(now, "residual")
    open_buckets = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    asked = materialize(now.join(open_buckets, "bucket", "left_semi").select("content", "component").distinct(), "open")
    forget(now)
    wanted = materialize(sets.join(asked, "content"), "open-sets")
    flat = _shingle_rows(wanted)
    shared = flat.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle", "n")
    own = W.partitionBy("content")
    placed = flat.join(shared, "shingle").withColumn("place", F.row_number().over(own.orderBy("n", "shingle")) - 1 + F.col("size") - F.count("*").over(own))
    prefix = placed.where(F.col("place") <= F.col("size") - F.ceil(threshold * F.col("size") - _SLACK)).select("shingle", "content", "component", "size", "place")
    prefix = materialize(prefix, "prefix")
    counts = materialize(prefix.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle", F.ceil(F.col("n") / CHUNK).alias("chunks")), "counts")
    dealt = prefix.join(counts, "shingle").withColumn("chunk", F.pmod(F.xxhash64("content"), F.col("chunks")))
    dealt = dealt.join(_bitmaps(wanted), "content").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("shingle", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "content", "component", "size", F.col("place").cast("long").alias("place"), "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            if not len(keys[0]):
                continue
            starts = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))  # rows of groups before the last
            cut = int(starts[-1]) + 1 if len(starts) else 0
            same = bool(held) and all(k[0] == held[-1].column(i)[-1].as_py() for i, k in enumerate(keys))
            if cut or not same:
                ready = [*held, batch.slice(0, cut)]
                yield from _could_link(pa.Table.from_batches(ready), threshold)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from _could_link(pa.Table.from_batches(held), threshold)

    return dealt.repartition("shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi").mapInArrow(run, "a long, b long").distinct()
