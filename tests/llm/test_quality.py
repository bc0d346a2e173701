import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, queries
from tessera.llm.common import crc_fold
from tessera.llm.hashing import byte_hashes, mix

DATA = "/root/testdata/sf0.01"


def tokens(text):
    """Runs of word bytes and of other visible bytes."""
    out, kind = [], None
    for b in (text or "").encode():
        now = " " if b in b"\t\n\x0b\x0c\r " else "w" if b >= 0x80 or chr(b).isalnum() else "m"
        if now != " ":
            out = [*out[:-1], (now, out[-1][1] + bytes([b]))] if now == kind else [*out, (now, bytes([b]))]
        kind = now
    return out


def hashed(raw):
    return int(byte_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])


def by_hand(text, buckets):
    """The vector of a text, one token at a time."""
    low = bytes(range(65, 91)), bytes(range(97, 123))
    words, looks, last = [], [], None
    for kind, raw in tokens(text):
        own = hashed(raw.translate(bytes.maketrans(*low)))
        if kind == "m":
            looks.append(own)
            continue
        words.append(own)
        first, capitals = 65 <= raw[0] <= 90, sum(65 <= b <= 90 for b in raw)
        look = first + 2 * (capitals > first) + 4 * any(97 <= b <= 122 for b in raw) + 8 * any(48 <= b <= 57 for b in raw) + 16 * any(b > 127 for b in raw)
        looks.append((32 if own == last else look) + 1)
        last = own
    counts = {}
    salt = lambda seed: seed * 0x9E3779B97F4A7C15 % 2**64
    one = lambda x: int(mix(np.array([x % 2**64], np.uint64))[0])
    for names, longest, seed in ((words, 2, 1), (looks, 3, 2)):
        for n in range(longest):
            for i in range(len(names) - n):
                chain = one(names[i] + salt(seed))
                for k in range(1, n + 1):
                    chain = one(chain * 3 + one(names[i + k] + salt(seed)))
                counts[chain % buckets] = counts.get(chain % buckets, 0) + 1
    length = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
    return {b: math.log1p(c) / length for b, c in counts.items()}


@pytest.mark.parametrize("buckets", [64, quality.BUCKETS])
def test_vectors_equal_counting_tokens(buckets):
    texts = ["The the cat!! sat", None, "", "  ", "É É ÉTÉ été 12a 12A B2", "a|b | c *** d", "x", "long" * 40 + " LONG" * 3, "end\x00of", "日本 日本"]
    for column in (pa.array(texts), pa.array(["zz", *texts], pa.large_string()).slice(1), pa.array([None], pa.string())):
        cuts, cells, values = quality.vectors(column, buckets)
        for i, text in enumerate(column.to_pylist()):
            got = dict(zip(cells[cuts[i] : cuts[i + 1]].tolist(), values[cuts[i] : cuts[i + 1]].tolist(), strict=True))
            assert got == pytest.approx(by_hand(text, buckets)), text


def test_updates_equal_plain_ftrl():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6), int(i % 4 > 0)) for i in range(60)]
    model = quality.train(rows, 0.6, buckets=40, rounds=3)
    z, n, here = [0.0] * 40, [0.0] * 40, 45.5 / 61
    weight = lambda i: 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.SMOOTH + math.sqrt(n[i])) / quality.RATE + quality.L2)
    for _ in range(3):
        for cells, values, label in rows:
            w = [weight(i) for i in cells]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, values, strict=True)) - math.log(0.6 / 0.4)))
            for i, x, old in zip(cells, values, w, strict=True):
                g = (p - label) * x * (0.6 / here if label else 0.4 / (1 - here))
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.RATE * old
                n[i] += g * g
    assert model.weights.tolist() == pytest.approx([weight(i) for i in range(40)], abs=1e-6)
    assert model.bias == pytest.approx(math.log(1.5))


def test_scores_are_sparse_dot_products():
    model = quality.Model(np.linspace(-3, 3, 512).astype(np.float32), 0.25)
    texts = ["some words here", None, "more words, many more words", ""]
    got = quality.dot(model, *quality.vectors(pa.array(texts), 512))
    for p, text in zip(got, texts, strict=True):
        odds = 0.25 + sum(float(model.weights[b]) * x for b, x in by_hand(text, 512).items())
        assert p == pytest.approx(1 / (1 + math.exp(-odds)))


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = queries.op11_quality_ftrl(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    good, bad = (np.array([r.score for r in rows if r.quality == y]) for y in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.99
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98 and (good >= 0.3).mean() > 0.99


def test_training_reads_only_labelled_rows_of_the_other_folds(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(5, "a repeated id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(1, 0, 0), (2, None, 0), (None, 1, 0), (777, 1, 1)], "doc_id long, quality int, toxic int")
    rows, share = quality.training_rows(docs, labels, "doc_id", "text", "quality", 100, 10**6)
    fold = {r.doc_id for r in docs.where(crc_fold("doc_id", 5) != 0).collect()}
    want = [i for i in range(50) if i in fold and i != 1]
    assert len(rows) == len(want) and share == sum(i % 2 for i in want) / len(want)
    assert sum(y for *_, y in rows) == sum(i % 2 for i in want)
    few, _ = quality.training_rows(docs, labels, "doc_id", "text", "quality", 4, 10**6)
    assert sorted(y for *_, y in few) == [0] * 4 + [1] * 4
    again, _ = quality.training_rows(docs.repartition(7), labels.repartition(3), "doc_id", "text", "quality", 4, 10**6)
    assert [(c.tolist(), y) for c, _, y in few] == [(c.tolist(), y) for c, _, y in again]


def test_a_label_of_only_long_texts_is_learned(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{j}" for j in range(3000 + i))) for i in range(10)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows, _ = quality.training_rows(docs, labels, "doc_id", "text", "quality", 100, 50)
    assert sorted(y for *_, y in rows) == [0, 1]  # one each, though beyond the bound
    assert all(len(cells) > 3000 for cells, *_ in rows)


def test_odd_rows_and_no_labels(spark):
    odd = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, " \n", "s"), (4, "word " * 200_000, "s"), (4, "word " * 200_000, "s"), (None, "x" * 300_000, "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(odd, quality.fit_model(odd, none)).collect()} == {0.5}
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_model(docs, labels)
    got = quality.score_documents(odd, model).collect()
    scores = {r.doc_id: r.score for r in got}
    assert len(got) == 6 and scores[1] == scores[2] == scores[3] and 0 <= scores[4] <= 1 and len({r.score for r in got if r.doc_id == 4}) == 1
    assert scores[1] == pytest.approx(1 / (1 + math.exp(-model.bias)))
    assert quality.score_documents(odd.limit(0), model).collect() == []
