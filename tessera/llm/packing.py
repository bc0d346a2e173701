"""Sequence packing along a space-filling curve.

A document's words are hashed into a count vector, projected to three dimensions and placed
on a Hilbert curve. Documents are range-partitioned and sorted by their place on the curve,
so neighbours in text are neighbours in order, and are cut into sequences as one token
stream per range. The end of a range is cut into sequences whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PRE_SPLIT, byte_letters, read_vocabulary, vocabulary_path
from .common import small_batches, text_batches, texts
from .hashing import hashed_words

SEQUENCE, END = 1024, 0
DIMENSIONS, BITS, BUCKETS = 3, 10, 256
TIE_BITS = 20  # rows of a cell are spread by a hash of id, text and input partition
RANGE_ROWS = 16_384  # a range holds about so many rows at most
CELL_BITS = 16  # of the curve: rows are counted in at most so many cells (2^16), whatever the size of the input
CELLS_A_RANGE, ROWS_A_CELL = 16, 64  # cells, and rows of the sample in a cell, that set the ranges; all rows are packed
LONG_TEXT, LONG_BLANK = 100_000, regex.compile(r"\s{50000}")  # beyond which the rank encoder's pattern gets no blanks to split
_IN_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_PROJECTION = np.random.default_rng(20).normal(size=(BUCKETS, DIMENSIONS))


def hilbert_index(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (one a row), by the transpose method."""
    x = places.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            swap = (x[i] & q) == 0
            t = np.where(swap, (x[0] ^ x[i]) & (q - 1), 0)
            x[0] ^= np.where(swap, t, q - 1)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def curve_keys(column: pa.StringArray) -> np.ndarray:
    """Hilbert keys of whole texts; null counts as empty."""
    hashed = hashed_words(pc.ascii_lower(column), _IN_WORD)
    owner = np.repeat(np.arange(len(hashed)), [len(h) for h in hashed])
    bucket = (np.concatenate(hashed) % np.uint64(BUCKETS)).astype(np.int64) if hashed else np.zeros(0, np.int64)
    vectors = np.bincount(owner * BUCKETS + bucket, minlength=len(hashed) * BUCKETS).reshape(len(hashed), BUCKETS).astype(float)
    vectors /= np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-9)
    spread = 0.5 * (1 + np.tanh(0.8 * (vectors @ _PROJECTION)))
    return hilbert_index(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


class RankEncoder:
    """The ids that the tokenizers library gives for a byte-level vocabulary without post-processing,
    from the same vocabulary read as merge ranks: ids of such a file are the ranks of its merges.
    Strings of special tokens are cut out first, as the library does."""

    def __init__(self, vocabulary: str):
        import tiktoken

        spec, letters = json.loads(vocabulary), byte_letters()
        self.specials = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.specials}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PRE_SPLIT.pattern, mergeable_ranks=ranks, special_tokens={})

    def _ordinary(self, text: str) -> bytes:
        """Of a text without special strings. The encoding's own pattern runs out of stack on very long
        runs of white space, so those texts are split here and encoded word by word."""
        if len(text) < LONG_TEXT or not LONG_BLANK.search(text):
            return array("I", self.encoding.encode_ordinary(text)).tobytes()
        piece = self.encoding._core_bpe.encode_single_piece
        return b"".join(array("I", piece(word.encode("utf-8", "surrogatepass"))).tobytes() for word in PRE_SPLIT.findall(text))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if self.cut and self.cut.search(text):
            return b"".join(self.specials.get(x) or self._ordinary(x) for x in self.cut.split(text))
        return self._ordinary(text)


_ENCODERS: dict[int, RankEncoder] = {}


def rank_encoder(vocabulary: str) -> RankEncoder:
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = RankEncoder(vocabulary)
    return _ENCODERS[key]


class Packer:
    """Cuts a stream of documents into sequences; rows are pieces."""

    def __init__(self, first_sequence: int, length: int = SEQUENCE):
        self.length, self.sequence, self.filled = length, first_sequence, 0
        self.open: list[tuple] = []  # pieces of the sequence that is not full

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        """(doc, start, length, ids, doc_tokens, sequence, offset) of sequences that are full now."""
        total, start = len(ids) // 4, 0
        while start < total:
            take = min(total - start, self.length - self.filled)
            self.open.append((doc, start, ids[4 * start : 4 * (start + take)], total))
            start += take
            self.filled += take
            if self.filled == self.length:
                yield from self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, ids, total, self.sequence, offset
            offset += len(ids) // 4
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        """The rest, in sequences whose lengths are powers of two, longest first."""
        pieces, left = self.open[::-1], self.filled
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            now = []
            while room:
                doc, start, ids, total = pieces.pop()
                take = min(room, len(ids) // 4)
                now.append((doc, start, ids[: 4 * take], total))
                if take < len(ids) // 4:
                    pieces.append((doc, start + take, ids[4 * take :], total))
                room -= take
            yield from self._close(now)
        self.open, self.filled = [], 0


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = SEQUENCE, end: int = END) -> DataFrame:
    """Pack all whole texts: one row for each piece.

    Returns id_col, start, length (tokens), ids (binary: little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. A document is its ids and then `end`; null and empty texts are `end` alone;
    repeated rows are packed each; other columns are not read. `length` must be a power of two.
    One shuffle, by ranges of the curve. Rows of a bounded sample are counted by cell of the curve; a
    cell's rows are spread over its ranges by a hash, so copies, however many, are spread too, and
    no range follows the size of a group. Equal rows are told apart by their input partition.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(path or vocabulary_path()))
    id_type = docs.schema[id_col].dataType.simpleString()
    spread = F.xxhash64(id_col, text_col, F.spark_partition_id()).bitwiseAND((1 << TIE_BITS) - 1)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), spread.alias("__tie"))
    total = rows.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / 64)), math.ceil(total / RANGE_ROWS))
    cell_bits = min(CELL_BITS, (CELLS_A_RANGE * parts).bit_length())
    shift = DIMENSIONS * BITS - cell_bits

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 0):
            cells, counts = np.unique(curve_keys(batch.column(0)) >> shift, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts, pa.int64())], names=["cell", "n"])

    every = max(1, total // (ROWS_A_CELL << cell_bits))
    sample = rows.where(F.monotonically_increasing_id() % every == 0).select("__text").mapInArrow(celled, "cell long, n long")
    held = np.zeros(1 << cell_bits)
    for cell, n in sample.groupBy("cell").agg(F.sum("n")).collect():  # at most 2^CELL_BITS rows
        held[cell] = n
    held *= parts / max(1, held.sum())  # in ranges
    before = np.cumsum(held) - held

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1):
            keys, tie = curve_keys(batch.column(1)), np.asarray(batch.column(2))
            cell = keys >> shift
            at = np.minimum(before[cell] + tie / (1 << TIE_BITS) * held[cell], parts - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys << TIE_BITS | tie, pa.int64()), pa.array(at)], names=["__id", "__text", "__key", "__range"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(shared.value)
        packer = Packer(TaskContext.get().partitionId() << 32, length)
        tail = array("I", [end]).tobytes()
        for batch in text_batches(batches, 1):
            coded = map(encoder.encode, texts(batch, 1))
            yield table([piece for i, ids in zip(batch.column(0).to_pylist(), coded, strict=True) for piece in packer.add(i, ids + tail)])
        yield table([*packer.finish()])

    def table(pieces: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*pieces, strict=True)) or [()] * 7
        kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    key_type = _arrow_type(docs, id_col)
    dealt = rows.mapInArrow(ranged, f"__id {id_type}, __text string, __key long, __range int").repartitionById(parts, "__range")
    dealt = dealt.sortWithinPartitions("__key", "__id", "__text").select("__id", "__text")
    return dealt.mapInArrow(packed, f"`{id_col}` {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)
