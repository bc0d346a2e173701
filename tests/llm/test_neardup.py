import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import hashing, neardup, queries

from .oracle import same

DATA = "/root/testdata"


def brute_classes(rows, threshold=0.8):
    """Classes by all pairs with a shared shingle."""
    words = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for _, t in rows]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    posted = {}
    for i, s in enumerate(sets):
        for g in s:
            posted.setdefault(g, []).append(i)
    shared = {}
    for group in posted.values():
        for x in group:
            for y in group:
                if x < y:
                    shared[x, y] = shared.get((x, y), 0) + 1
    for (x, y), n in shared.items():
        if n >= threshold * (len(sets[x]) + len(sets[y]) - n):
            parent[root(x)] = root(y)
    out = {}
    for i in range(len(rows)):
        out.setdefault(root(i), []).append(i)
    return {frozenset(v) for v in out.values()}


def found_classes(result):
    out = {}
    for r in result.collect():
        out.setdefault(r.class_id, []).append(r.doc_id)
    assert all(min(v) == k for k, v in out.items())
    return {frozenset(v) for v in out.values()}


def test_sketch_estimates_probability_jaccard():
    draw = np.random.default_rng(2)
    names = np.arange(1, 61, dtype=np.uint64)
    x, y = draw.uniform(0.5, 4, 40), draw.uniform(0.5, 4, 40)
    xs, ys = dict(zip(names[:40], x)), dict(zip(names[20:], y))
    truth = sum(1 / sum(max(xs.get(j, 0) / xs[i], ys.get(j, 0) / ys[i]) for j in names) for i in names[20:40])
    signature = neardup.prob_minhash(np.concatenate([names[:40], names[20:]]), np.concatenate([x, y]), np.repeat([0, 1], 40), 2, 20_000)
    assert abs((signature[0] == signature[1]).mean() - truth) < 0.015


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert found_classes(neardup.classes(docs)) == brute_classes(rows)


def edits(draw, words, share):
    return " ".join(draw.choice("abcdefgh") * 6 + str(draw.randrange(10**6)) if draw.random() < share else w for w in words)


def test_large_group_of_near_copies_loses_no_member(spark):
    draw = random.Random(4)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    rows = [(i, edits(draw, base, draw.choice([0.002, 0.01, 0.015, 0.03]))) for i in range(300)] + [(300 + i, " ".join(f"x{draw.randrange(9000)}" for _ in range(80))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_classes(neardup.classes(docs)) == brute_classes(rows)


def test_links_in_wide_buckets_are_found(spark):
    # Template-like strangers (0.6 to 0.8) in one wide bucket, and pairs of them that are links and lie anywhere in it.
    draw = random.Random(11)
    base = [f"w{draw.randrange(5000)}" for _ in range(200)]

    def changed(words, places):
        return [f"z{draw.randrange(10**9)}" if i in places else w for i, w in enumerate(words)]

    rows = []
    for k in range(400):
        apart = changed(base, set(draw.sample(range(200), 5)))
        rows.append((len(rows), " ".join(apart)))
        if k % 4 == 0:
            rows.append((len(rows), " ".join(changed(apart, set(draw.sample(range(200), 3))))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bucket = {r["__id"]: r.bands[0] for r in neardup.sketch(docs, bands=1, rows=1).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    links = [(x, y) for x in sets for y in sets if x < y and bucket[x] == bucket[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    found = {r.doc_id: r.class_id for r in neardup.classes(docs, bands=1, rows=1, keys=hashing.PLAIN).collect()}
    assert max(Counter(bucket.values()).values()) > 32 and len(links) > 50
    assert [p for p in links if found[p[0]] != found[p[1]]] == []


def test_texts_with_a_sentence_repeated_share_bands():
    # Set Jaccard of at least 0.8 but weighted Jaccard of about a half: of 400 such pairs some miss all bands of the weighted sketch.
    draw = random.Random(7)
    texts = []
    for _ in range(400):
        words = [f"w{draw.randrange(10**6)}" for _ in range(90)]
        times = draw.randrange(60, 100)
        texts += [" ".join(words), " ".join(words + words[:13] * times)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    assert all(len(x & y) >= 0.8 * len(x | y) for x, y in zip(sets[::2], sets[1::2]))
    bands = neardup.sketch_batch(pa.array(texts), neardup.BANDS, neardup.ROWS)[4]
    assert [k for k in range(400) if not set(bands[2 * k]) & set(bands[2 * k + 1])] == []


def test_candidates_of_the_residual_join_hold_every_link(spark):
    # Every content is a class of its own in one bucket; the candidates must hold every pair that reaches the threshold.
    draw = random.Random(12)
    base = [f"w{draw.randrange(5000)}" for _ in range(120)]
    texts = [edits(draw, base, draw.choice([0.005, 0.01, 0.02, 0.03])) for _ in range(700)] + [" ".join(draw.choice("abcdef") for _ in range(draw.randrange(1, 12))) for _ in range(100)]
    sets = neardup.shingle_sets(spark.createDataFrame([(t,) for t in texts], "__text string")).dropDuplicates(["content"])
    have = {r.content: frozenset(np.frombuffer(r.shingles, np.uint64).tolist()) for r in sets.collect()}
    members = sets.select(F.lit(1).cast("long").alias("bucket"), "content")
    found = spark.createDataFrame([], "node long, component long")
    got = {(r.a, r.b) for r in neardup._residual(members, found, sets, 0.8).collect()}
    ids = sorted(have)
    links = {(x, y) for i, x in enumerate(ids) for y in ids[i + 1 :] if len(have[x] & have[y]) >= 0.8 * len(have[x] | have[y])}
    assert len(links) > 1000 and links <= got
    assert len(got) < len(ids) * (len(ids) - 1) / 4


def test_a_dense_family_loses_no_link(spark):
    # One template, two variants a place: 4,000 documents whose mean Jaccard similarity is far below the threshold.
    draw = np.random.default_rng(31)
    variant = np.zeros((4000, 200), bool)
    for row in variant:
        row[draw.choice(200, 5, replace=False)] = True
    words = np.where(variant, np.char.add("b", np.arange(200).astype(str)), np.char.add("a", np.arange(200).astype(str)))
    texts = [" ".join(row) for row in words]
    code = sum(variant[:, i : 196 + i].astype(np.int64) << i for i in range(5)) + 32 * np.arange(196)
    sets = np.zeros((4000, 32 * 196), np.float32)
    np.put_along_axis(sets, code, 1, axis=1)
    shared = sets @ sets.T
    a, b = np.nonzero(np.triu(shared >= 0.8 * (2 * 196 - shared), 1))
    assert 100 < len(a) and shared.mean() / (392 - shared.mean()) < 0.65
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert [(x, y) for x, y in zip(a.tolist(), b.tolist()) if found[x] != found[y]] == []
    label = list(range(4000))
    for _ in range(4000):
        new = list(label)
        for x, y in zip(a.tolist(), b.tolist()):
            new[x] = new[y] = min(new[x], new[y])
        if new == label:
            break
        label = new
    assert [found[i] for i in range(4000)] == label


def test_words_in_thue_morse_order_are_different_documents(spark):
    order = [0]
    while len(order) < 1024:
        order += [1 - x for x in order]
    texts = ["".join("ab"[x] for x in order), "".join("ba"[x] for x in order)]
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(0, 0), (1, 1)]


def test_columns_of_the_caller_may_have_any_name(spark):
    names = ["content", "check", "worded", "__head", "__low", "__n", "c0", "bands", "component"]
    docs = spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in enumerate(["one text", "one text", None])] + [(0, "one text", *["x"] * len(names))], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = neardup.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " ,. "), (4, "two words"), (5, "Two, words!"), (4, "two words"), (6, "two words more"), (7, long), (8, long + " end"), (None, "two words"), (None, "alone here")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, content int, class_id string")
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (None, 4), (None, None)], key=str)
    assert neardup.classes(docs.limit(0)).collect() == []


def test_query_equals_sql(spark):
    same(queries.op1_prob_minhash(spark, f"{DATA}/sf0.01").collect(), queries.OP1_SQL, f"{DATA}/sf0.01")
