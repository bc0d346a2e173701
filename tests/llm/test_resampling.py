import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import queries, resampling

from .oracle import same

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most=1):
    words = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, most + 1) for i in range(len(words) - n + 1)], len(words)


def by_hand(docs, target, percent=10, most=1, buckets=10_000, least=20, seed=2024):
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for texts, into in (([x for _, x in docs], s), (target, t)):
        for text in texts:
            for f in features(text, most)[0]:
                into[f % buckets] += 1
    out = []
    for key, text in docs:
        found, words = features(text, most)
        gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(s.sum() + buckets) / (float(s[b] + 1) * float(t.sum() + buckets)))) for b in (f % buckets for f in found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = may[: percent * len(may) // 100]
    return [(*r, drawn.index(r) + 1 if r in drawn else None) for r in out]


def test_query_equals_its_sql(spark):
    rows = queries.op13_importance_resampling(spark, DATA).collect()
    same(rows, queries.OP13_SQL, DATA)
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 1 + sum(r.rank is not None for r in rows)))


def some_texts():
    rng = random.Random(5)
    alphabet = ["a", "Z", "9", " ", " ", ".", "é", "Б", "\n", "語", "\x7f", "_", "😀", "\x00"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(300)]
    return texts + [None, "", " ", "one", "x" * 5000, "w" * 64, "w" * 65, "a b " * 20_000, "É" * 70 + " tail", "end", "début"]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_automaton_equals_zlib_over_cut_words(most):
    texts = some_texts()
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["head", *texts]).slice(1), pa.array(texts[:1] + [None]), pa.array([None, None], pa.string()), pa.array([], pa.string())):
        found, count, words = resampling.word_features(column, most)
        want = [features(t, most) for t in column.to_pylist()]
        assert words.tolist() == [w for _, w in want] and count.tolist() == [len(f) for f, _ in want]
        ends = np.cumsum(count)
        for (f, _), start, end in zip(want, ends - count, ends, strict=True):
            assert found[start:end].tolist() == f


@pytest.mark.parametrize("most", [1, 2])
def test_draw_equals_brute_force_on_odd_rows(spark, most):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices(["tea", "Coffee", "milk", "über", "x1", "salt"], k=rng.randrange(40)))) for i in range(150)]
    docs += [(900, None), (901, ""), (None, "tea " * 30), (902, "salt " * 19), (903, "salt " * 20), (3, docs[3][1] + " tea" * 50), (904, "Milk-" * 100_000)]
    target = ["tea and milk", None, "", "TEA x1"]
    table = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, rank string").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(table, goal, percent=33, most_words=most, buckets=50).collect()
    want = by_hand(docs, target, 33, most, 50)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_repeated_rows_ties_and_empty_tables(spark):
    docs = [(8, "one two " * 12)] * 40 + [(9, "three " * 30)] * 40
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    none = spark.createDataFrame([], "doc_id long, text string")
    got = resampling.resample(table, none, percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 41)) and len({r.doc_id for r in got if r.rank}) == 1
    assert sorted({(r.doc_id, r.n_features, r.weight, r.score) for r in got}) == sorted({(r[0], *r[2:5]) for r in by_hand(docs, [])})
    assert resampling.resample(none, table).collect() == []


def test_weights_of_all_rows_count_whatever_the_batches(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    counts = {r.bucket: r.n for r in resampling.bucket_counts(docs).collect()}
    want = {}
    for row in docs.collect():
        for f in features(row.text)[0]:
            want[f % 10_000] = want.get(f % 10_000, 0) + 1
    assert counts == want
