import math

import numpy as np

from tessera.llm import permutation, queries, topk

from .oracle import same

DATA = "/root/testdata"


def vectors_of(spark, sf):
    rows = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def test_exact_top_k_equals_sql(spark):
    same(queries.op8_block_topk(spark, f"{DATA}/sf0.01").collect(), queries.OP8_SQL, f"{DATA}/sf0.01")


def test_pruning_skips_ranges_and_stays_exact():
    draw = np.random.default_rng(1)
    centres = draw.normal(0, 1, (8, 16))
    vectors = np.concatenate([c + draw.normal(0, 0.02, (200, 16)) for c in centres])
    ids = draw.permutation(len(vectors))
    index = topk.RangeIndex(ids, vectors, 10)
    q, r, s = index(ids[:20], vectors[:20])
    assert index.scored < 20 * len(index.starts) / 2
    weights = np.floor(1024 * vectors).astype(int)
    for i in range(20):
        scores = weights @ weights[i]
        want = [j for j in np.lexsort((ids, -scores)) if j != i][:10]
        assert r[q == i].tolist() == want and s[q == i].tolist() == scores[want].tolist()


def odd(spark):
    rows = [(i, [float(i % 3), 1.0 + i % 5], "x") for i in range(300)] + [(100, [1.0, 1.0], "x")] * 40 + [(7, [7.0, 7.0], "x")] * 3
    rows += [(None, [1.0, 1.0], "x"), (900, None, "x"), (901, [], "x"), (902, [1.0, None], "x"), (903, [math.nan, 1.0], "x"), (904, [math.inf, 1.0], "x"), (905, [0.0, 0.0], "x"), (906, [1.0], "x"), (1000, [1.0, 2.0, 3.0], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def brute(rows, measure, low_first, zero):
    usable = [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = {}
    for q in {i for i, _ in usable if i % 100 == 0}:
        own = min(v for i, v in usable if i == q)
        best = {}
        for i, v in usable:
            if i != q and len(v) == len(own):
                s = measure(own, v)
                best[i] = s if i not in best else (min if low_first else max)(s, best[i])
        out[q] = sorted(((s if low_first else -s, i) for i, s in best.items()))[:10]
    return out


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.score, r.id))
    return {q: sorted(v) for q, v in out.items()}


def test_odd_rows_equal_brute_force(spark):
    df = odd(spark)
    rows = [tuple(r) for r in df.collect()]
    asked = df.where("vec_id % 100 = 0")
    want = brute(rows, lambda a, b: sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(a, b)), False, True)
    have = got(topk.top_k(df, asked, block_rows=64))
    assert {q: [(-s, i) for _, s, i in v] for q, v in have.items()} == {q: v for q, v in want.items() if v}
    want = brute(rows, math.dist, True, False)
    have = got(permutation.nearest(df, asked, share=1, block_rows=64))
    assert {q: [i for _, _, i in v] for q, v in have.items()} == {q: [i for _, i in v] for q, v in want.items() if v}
    assert all(math.isclose(s, t) for q in have for (_, s, _), (t, _) in zip(have[q], want[q]))
    for f in (topk.top_k, permutation.nearest):
        assert f(df.limit(0), asked.limit(0)).collect() == []
        assert f(df, asked.limit(0)).collect() == []


def test_huge_components_do_not_overflow(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    have = got(topk.top_k(df, df.where("vec_id = 0")))
    assert have[0][0][1] == 2**63 - 1 and have[0][-1][1] == -(2**63)


def test_recall_against_brute_force(spark):
    ids, vectors = vectors_of(spark, "sf0.1")
    table = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    have = got(permutation.nearest(table, table.where("vec_id % 100 = 0"), block_rows=1500))
    hits = total = 0
    for q, found in have.items():
        far = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        want = [ids[j] for j in np.lexsort((ids, far)) if ids[j] != q][:10]
        hits, total = hits + len(set(want) & {i for _, _, i in found}), total + 10
    assert hits / total >= 0.9


def recall(ids, vectors, found):
    hits = total = 0
    for q, rows in found.items():
        far = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        want = [ids[j] for j in np.lexsort((ids, far)) if ids[j] != q][:10]
        hits, total = hits + len(set(want) & {i for _, _, i in rows}), total + len(want)
    return hits / total


def test_the_files_are_walked_and_few_rows_are_reranked():
    draw = np.random.default_rng(5)
    vectors, ids = draw.normal(size=(300, 8)), np.arange(300)
    pivots = vectors[draw.choice(300, 32, replace=False)]
    for prefix, met in ((32, 32 * 300), (12, 0)):
        files = permutation.PivotFiles(ids, vectors, pivots, prefix, 10, 0.1)
        assert files.reranked == 30 and sum(len(p) for _, p in files.files) == prefix * 300
        q, r, s = files(ids[:20], vectors[:20])
        assert files.met == 20 * met if met else 0 < files.met < 20 * prefix * 300
        order = permutation.orders(vectors, pivots, prefix)
        place = np.full((300, 32), prefix)
        place[np.arange(300)[:, None], order] = np.arange(prefix)
        for i in range(20):  # the set that is reranked: least footrule distance of the orders
            footrule = np.abs(place - place[i]).sum(axis=1)
            near = files._candidates(order[i])
            assert sorted(footrule[near]) == sorted(footrule)[:30]
        every = permutation.PivotFiles(ids, vectors, pivots, prefix, 10, 1.0)
        assert recall(ids, vectors, {i: [(0, 0, every.ids[b]) for a, b in zip(*every(ids[:20], vectors[:20])[:2]) if a == i] for i in range(20)}) == 1


def test_repeated_rows_leave_room_for_k_others(spark):
    rows = [(i, [math.cos(i * j) for j in range(1, 9)]) for i in range(400)] + [(5, [math.cos(5 * j) for j in range(1, 9)])] * 60
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    have = got(permutation.nearest(df, df.where("vec_id % 100 = 0"), share=0.01, block_rows=100))
    assert {q: [k for k, _, _ in v] for q, v in have.items()} == {q: [*range(1, 11)] for q in (0, 100, 200, 300)}


def test_recall_on_a_small_table(spark):
    ids, vectors = vectors_of(spark, "sf0.01")
    rows = queries.op7_permutation_ann(spark, f"{DATA}/sf0.01").collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert len(rows) == 10 * len(found) and recall(ids, vectors, found) >= 0.9
    for r in rows:
        assert math.isclose(r.score, math.dist(vectors[ids == r.query_id][0], vectors[ids == r.vec_id][0]))
