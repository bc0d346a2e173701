import random
import re

import numpy as np

from tessera.llm import substrings, queries

from .oracle import same

DATA = "/root/testdata"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, size=35):
    words = [WORD.findall(t or "") for t in texts]
    places = {}
    for d, w in enumerate(words):
        for i in range(len(w) - size + 1):
            places.setdefault(tuple(w[i : i + size]), []).append((d, i))
    cover = [np.zeros(len(w), bool) for w in words]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                cover[d][i : i + size] = True
    return [(len(w), int(c.sum()), " ".join(x for x, gone in zip(w, c) if not gone)) for w, c in zip(words, cover)]


def check(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, **options).collect()}
    for i, want in enumerate(brute(texts, options.get("size", 35))):
        assert got[i] == want, (i, got[i][:2], want[:2])


def test_equal_windows_have_equal_anchors():
    draw = np.random.default_rng(0)
    for alphabet in (1, 2, 3, 50, 10_000):
        passage = draw.integers(1, alphabet + 1, 60).astype(np.uint64)
        docs = [np.concatenate([draw.integers(1, alphabet + 1, draw.integers(0, 90)).astype(np.uint64), passage, draw.integers(1, alphabet + 1, draw.integers(0, 90)).astype(np.uint64)]) for _ in range(20)]
        found = substrings.anchors([substrings.mix(d) for d in docs])
        key = {}
        for doc, first, count, k in zip(found["doc"], found["first"], found["count"], found["key"]):
            for w in range(first, first + count):
                assert key.setdefault(tuple(docs[doc][w : w + 35]), k) == k
        assert found["count"].sum() == sum(len(d) - 34 for d in docs)


def test_supplied_documents_equal_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").orderBy("doc_id").collect()
    check(spark, [r.text for r in rows])


def test_runs_periods_and_edges(spark):
    draw = random.Random(6)
    passage = [f"p{i}" for i in range(70)]
    texts = [None, "", "a " * 34, "a " * 35, "a " * 36, "b " * 34, "b " * 35 + "c", "x y " * 40, "z " + "x y " * 40, "u v w " * 13, " ".join(passage[:35]), " ".join(passage), "\t".join(passage[20:60]) + "\xa0end", "n " * 20_000]
    for _ in range(60):
        words = [f"r{draw.randrange(400)}" for _ in range(draw.randrange(10, 120))]
        at, n = draw.randrange(35), draw.randrange(1, 36)
        texts.append(" ".join(words[:7] + passage[at : at + n] + words[7:]))
    texts += texts[20:25]
    check(spark, texts)


def test_small_windows_on_few_words(spark):
    draw = random.Random(8)
    check(spark, [" ".join(draw.choices("abcd", k=draw.randrange(0, 40))) for _ in range(60)], size=6)


def test_empty_table_and_carried_columns(spark):
    docs = spark.createDataFrame([(1, "w " * 40, "en"), (1, "w " * 40, "en"), (None, "short", None)], "doc_id long, text string, lang string")
    got = substrings.remove_repeats(docs, carry=["lang"]).collect()
    assert sorted(((r.doc_id, r.lang, r.n_words, r.n_removed, r.kept) for r in got), key=str) == sorted([(1, "en", 40, 40, ""), (1, "en", 40, 40, ""), (None, None, 1, 0, "short")], key=str)
    assert substrings.remove_repeats(docs.limit(0)).collect() == []


def test_query_equals_sql(spark):
    same(queries.op4_recompression_dedup(spark, f"{DATA}/sf0.01").collect(), queries.OP4_SQL, f"{DATA}/sf0.01")


def thue_morse(n):
    order = [0]
    while len(order) < n:
        order += [1 - x for x in order]
    return order


def test_words_and_spans_in_thue_morse_order_are_told_apart(spark):
    order = thue_morse(1024)
    common = " ".join(f"c{i}" for i in range(34))
    spell = lambda a, b, by: by.join((a, b)[x] for x in order)
    check(spark, [f"{common} {spell('a', 'b', '')}", f"{common} {spell('b', 'a', '')}", spell("one", "two", " "), spell("two", "one", " "), f"x {spell('on', 'tw', ' ')} y", f"y {spell('on', 'tw', ' ')} x"])


def test_equal_rows_share_one_list(spark):
    text = " ".join(f"w{i % 700}" for i in range(1500))
    docs = spark.createDataFrame([(1, text)] * 50 + [(2, "other words " + text)], "doc_id long, text string")
    found = substrings.occurrences(docs.selectExpr("xxhash64(doc_id) AS __row", "0L AS __twin", "text AS __text"))
    longest = substrings.told(found).selectExpr("max(size(__told)) AS n").first().n
    assert longest <= 1500
    check(spark, [text] * 50 + ["other words " + text])


def test_words_of_equal_plain_hashes_are_told_apart(spark):
    """Made for the hash without a key; the run's keys are secret."""
    from tessera.llm import hashing, neardup

    head = [f"w{i}" for i in range(34)]
    one, two = "licensecorpusabc", "6chxko2tluvu7idc"
    raw = np.frombuffer((one + two).encode(), np.uint8)
    plain = hashing.byte_hashes(raw, np.array([0, 16]), np.array([16, 32]))
    keyed = hashing.byte_hashes(raw, np.array([0, 16]), np.array([16, 32]), 12345)
    assert plain[0] == plain[1] and keyed[0] != keyed[1]
    docs = spark.createDataFrame([(1, " ".join([*head, one])), (2, " ".join([*head, two])), (3, one), (4, two), (5, "x" * 65 + "a"), (6, "x" * 65 + "b")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()} == dict.fromkeys(range(1, 7), 0)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got[3] == 3 and got[4] == 4 and got[5] == 5 and got[6] == 6 and got[1] == 1
    assert len(neardup.representatives(docs).where("doc_id IN (3, 4)").collect()) == 2
