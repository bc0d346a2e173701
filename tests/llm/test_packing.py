import itertools
import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, queries

from .test_bpe import PIECES


def check(pieces, texts_of):
    """Every id lies in exactly one piece, sequences are gapless and full or powers of two."""
    library = Tokenizer.from_file(bpe.vocabulary_path())
    docs, sequences = {}, {}
    for r in pieces:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,) for _, t in texts_of)
    have = []
    for rows in docs.values():
        rows.sort(key=lambda r: r.start)
        copies = sum(r.start == 0 for r in rows)
        if copies > 1:  # repeated rows: follow the pieces of equal texts together
            assert len({bytes(r.ids) for r in rows if r.start == 0 and r.length == r.doc_tokens}) == 1
            have += [tuple(np.frombuffer(r.ids, np.uint32)) for r in rows]
            continue
        ids = np.concatenate([np.frombuffer(r.ids, np.uint32) for r in rows])
        assert [r.start for r in rows] == [0, *itertools.accumulate(r.length for r in rows)][:-1]
        assert len(ids) == rows[0].doc_tokens
        have.append(tuple(ids.tolist()))
    assert sorted(have) == want
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *itertools.accumulate(r.length for r in rows)][:-1]
        total = sum(r.length for r in rows)
        assert total <= 1024 and total & (total - 1) == 0


def test_pieces_hold_every_id_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    query = queries.op3_hilbert_packing(spark, "/root/testdata/sf0.001")
    assert query.count() == packing.pack(docs).count() and "ids_crc32" in query.columns


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "same", 1), (3, "same", 1), (4, "two  blanks \n end ", 1), (5, "many words " * 40_000, 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    check(packing.pack(docs).collect(), [r[:2] for r in rows])
    assert packing.pack(docs.limit(0)).collect() == []


def test_ids_equal_the_library():
    vocabulary = bpe.read_vocabulary(bpe.vocabulary_path())
    library, encoder = Tokenizer.from_str(vocabulary), packing.RankEncoder(vocabulary)
    draw = random.Random(3)
    for _ in range(4000):
        text = "".join(draw.choice([*PIECES, "\x1c", "\x85", "\u200b", "\u2028", "\u180e", "\u0301", "\x00", "\ufeff"]) for _ in range(draw.randint(0, 16)))
        assert np.frombuffer(encoder.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    long = (" " * 300_000, "a" * 300_000, "\n" * 100_000 + "x", "?" * 100_000, " " * 2_000_000 + "x", "\n" * 2_000_000, "x \t" + " \n" * 1_000_000 + "y it's", "<|endoftext|>" + "\u3000" * 200_000 + " end", "a" * 2_000_000, "?" * 2_000_000, "7" * 2_000_000)
    for text in long:
        assert np.frombuffer(encoder.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_ranges_are_even_whatever_the_rows_hold(spark):
    """One document in a third of the rows, and one id in another third."""
    rows = [(7, "the same text in very many rows")] * 2000 + [(8, f"word{i} " * 5) for i in range(2000)] + [(i, f"all kinds of {i % 90} words {i}") for i in range(100, 2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        pieces = packing.pack(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    sizes = {}
    for r in pieces:
        sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + (r.start == 0)
    assert sum(sizes.values()) == 6000 and len(sizes) > 35 and max(sizes.values()) < 3 * 6000 / 40


def test_curve_visits_every_cell_in_unit_steps():
    cells = np.array([*itertools.product(range(8), repeat=3)])
    index = packing.hilbert_index(cells, bits=3)
    assert sorted(index) == [*range(512)]
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_like_texts_are_near_on_the_curve():
    base = "the quick brown fox jumps over the lazy dog again and again " * 5
    keys = packing.curve_keys(pa.array([base, base + "once", "völlig andere wörter stehen in diesem text " * 5, None, ""]))
    assert abs(keys[0] - keys[1]) < abs(keys[0] - keys[2]) and keys[3] == keys[4]
