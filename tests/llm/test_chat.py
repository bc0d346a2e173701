import random

import numpy as np
import pyarrow as pa

from tessera.llm import chat, queries

from .oracle import same

DATA = "/root/testdata/sf0.01"


def test_query_equals_sql(spark):
    same(queries.op10_chat_format(spark, DATA).collect(), queries.OP10_SQL, DATA)


def test_random_texts_come_back_and_spans_hold_assistant_texts(spark):
    draw = random.Random(5)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE x] ", "[/ROLE]", "\\", "<", "[", "/", "s>", " ", "\n", "é", "😀", "a", "<\\s>", "[\\\\INST]"]
    rows = []
    for conv in range(60):
        for turn in range(draw.randint(1, 6)):
            role = draw.choice(["user", "assistant", "system", "tool", "a] [b\n", "", None])
            rows.append((conv if conv else None, turn, role, draw.choice([None, "", "".join(draw.choices(parts, k=9))]), "x"))
    rows += [(7, 0, "user", "tie", "x"), (7, 0, "user", "tie", "x"), (100, 0, "assistant", "long " * 100_000, "x")]
    rows += [(101, i, "user", str(i), "x") for i in range(9000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    formatted = chat.format_conversations(turns)
    back = {r.conv_id: r for r in chat.read_conversations(formatted).collect()}
    assert len(back) == formatted.count() == 62
    for conv, r in back.items():
        mine = sorted([(x[1], x[2] or "", x[3] or "") for x in rows if x[0] == conv])
        assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, a, b in mine]
        assert r.loss_text == "".join(b for _, a, b in mine if a == "assistant")


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).collect() == []


def test_memory_follows_the_text():
    import tracemalloc

    body = "some words of a long turn " * 400_000  # 10 MB
    roles = pa.array(["user", "assistant"] * 3 + ["tool"] * 2000)
    contents = pa.array([body, "short", "é" * 2_000_000, "x", body, ""] + ["many little texts"] * 2000)
    first = np.zeros(len(roles), bool)
    first[[0, 4, 6]] = True
    tracemalloc.start()
    text, _ = chat.assemble(roles, contents, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(len(x.as_py().encode()) for x in text)
    assert size > 24_000_000 and peak < 6 * size
    turns = [t for x in text.to_pylist() for t in chat.parse(x)]
    assert [t["text"] for t in turns] == contents.to_pylist() and [t["role"] for t in turns] == roles.to_pylist()


def test_pieces_are_scattered_in_bounded_steps(monkeypatch):
    monkeypatch.setattr(chat, "SCATTER", 7)
    texts = ["", "a", "bcd", "a long piece of text", "", "é", "<s>", "x" * 7]
    text, spans = chat.assemble(pa.array(["user", "assistant"] * 4), pa.array(texts), np.array([True, False] * 4))
    assert [t["text"] for x in text.to_pylist() for t in chat.parse(x)] == texts
