import random

import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

PIECES = [*"aabcdehtl  \n\t'srß日😀²½٣_.,!01<|>", "<|endoftext|>", "  ", "the", " \n\n ", "　", "\xa0", "l" * 9, "\r\n", "'ll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def test_automaton_equals_the_library_on_random_texts(library):
    machine, encoder = bpe.automaton(bpe.read_vocabulary(bpe.vocabulary_path()))
    draw = random.Random(7)
    for _ in range(3000):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 16)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids, repr(text)
        assert machine.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(text)


def test_long_words_and_small_tables(library, monkeypatch):
    vocabulary = bpe.read_vocabulary(bpe.vocabulary_path())
    draw = random.Random(3)
    words = [" " * 5000 + "x", "-" * 3000, "".join(draw.choices("abcdefghij", k=20_000)), "".join(draw.choices("日本語é", k=3000)), "=" * 777 + "\n" * 999]
    for states in (3, 50, bpe.STATES):
        monkeypatch.setattr(bpe, "STATES", states)
        monkeypatch.setattr(bpe, "_LOADED", {})
        machine, encoder = bpe.automaton(vocabulary)
        for word in words:
            assert encoder.encode(word).tolist() == library.encode(word, add_special_tokens=False).ids
            assert len(machine.known) <= states


def test_a_known_word_takes_one_transition_a_byte(monkeypatch):
    machine, _ = bpe.automaton(bpe.read_vocabulary(bpe.vocabulary_path()))
    word = " unbelievably".encode()
    first = machine.encode(word)
    monkeypatch.setattr(machine, "_compile", None)  # all transitions are in the table by now
    assert machine.encode(word) == first and b"".join(machine.labels[i] for i in first) == word


def test_table_of_odd_rows(spark, library):
    long = "over and over. " * 20_000
    rows = [(1, "two  words\n", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "no id", "x"), (4, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.encode_decode(docs).collect(), key=lambda r: (r.doc_id or 0, r.ids))
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3, 3, 4]
    for r in got:
        text = {1: rows[0][1], None: "no id", 4: long}.get(r.doc_id, "")
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.decoded == text
    assert bpe.encode_decode(docs.limit(0)).collect() == []


def test_decode_alone_gives_the_text_back(spark):
    docs = spark.createDataFrame([(1, "Grüße, 世界"), (2, None)], "doc_id long, text string")
    back = bpe.decode_ids(bpe.encode_decode(docs, decode=False)).collect()
    assert {r.doc_id: r.decoded for r in back} == {1: "Grüße, 世界", 2: ""}
