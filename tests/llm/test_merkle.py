import hashlib
import zlib

from pyspark.sql import functions as F

from tessera.llm import merkle, queries
from tessera.llm.common import crc_fold

from .oracle import same

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, place):
    out = []
    for level in tree[:-1]:
        start = place // 8 * 8
        out.append(("".join(level[start:place]), "".join(level[place + 1 : start + 8])))
        place //= 8
    return out


def by_hand(rows):
    lowered = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf(r, r[4])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: levels([x[1] for x in groups[g]]) for g in names}
    crown = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for place, (r, own) in enumerate(groups[g]):
            steps = siblings(trees[g], place) + siblings(crown, k)
            tampered = zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 3 == 0
            now = leaf(r, r[4] and r[4].translate(lowered)) if tampered else own
            for before, after in steps:
                now = sha(before, now, after)
            out.append((r[0], own, trees[g][-1][0], crown[-1][0], sha(*(b + a for b, a in steps)), now, now == crown[-1][0]))
    return out


def found(docs):
    text = F.when(crc_fold("doc_id", 3) == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    rows = merkle.proofs(docs, changed={"text": text}).drop("steps").collect()
    return sorted(map(tuple, rows), key=str)


def test_query_equals_its_sql(spark):
    rows = queries.op12_merkle_proofs(spark, DATA).collect()
    same(rows, queries.OP12_SQL, DATA)
    assert {r.verified for r in rows} == {True, False}


def test_nulls_repeats_odd_texts_and_runs_of_every_size(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} É") for i in range(586)]  # 586 = 512 + 74: four levels, last runs of 2, 2 and 2
    rows += [(i, None, "de", None, "A") for i in range(65)] + [(7, "s", "one", 1, "Only")] + [(i, "s", None, 1, None) for i in range(9)]
    rows += [(3, "s", "", 1, ""), (None, "s", "", 1, "x"), (None, "s", "", 1, "x"), (3, "s", "", 1, "W" * 300_000), (-4, "s", "", 1, "Z\x00")]
    rows += [(5, "s", "rep", 1, "same")] * 200
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("leaf", F.lit(1)).withColumn("__at", F.lit("x"))
    assert found(docs) == sorted(by_hand(rows), key=str)


def test_more_groups_than_a_run(spark):
    rows = [(i, "s", f"l{i % 77}é", i, f"T{i}") for i in range(400)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == sorted(by_hand(rows), key=str)


def test_one_group_and_one_row(spark):
    for n in (1, 2, 8, 9):
        rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
        assert found(spark.createDataFrame(rows, SCHEMA)) == sorted(by_hand(rows), key=str)
    lone = merkle.proofs(spark.createDataFrame([(1, "s", "en", 1, "t")], SCHEMA)).first()
    assert lone.leaf == lone.subroot == lone.root and lone.steps == [] and lone.verified and lone.proof_sha256 == sha()


def test_empty_table(spark):
    got = merkle.proofs(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == ["doc_id", "leaf", "subroot", "root", "steps", "proof_sha256", "folded_root", "verified"]
