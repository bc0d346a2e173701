import itertools
import math
import random

import numpy as np

from tessera.llm import toxicity

DATA = "/root/testdata/sf0.01"


def brute_marginals(unary, arcs):
    """By enumeration of all state sequences."""
    n, mass, total = len(unary), np.zeros(len(unary)), 0.0
    for states in itertools.product((0, 1), repeat=n):
        weight = math.exp(sum(u for u, s in zip(unary, states) if s) + sum(arcs[2 * a + b] for a, b in itertools.pairwise(states)))
        total += weight
        mass += weight * np.array(states)
    return mass / total


def test_forward_backward_equals_enumeration():
    draw = np.random.default_rng(3)
    arcs = (0.4, -0.7, -0.2, 0.9)
    counts = np.array([1, 7, 3, 10, 2])
    unary = draw.normal(0, 2, counts.sum())
    got = toxicity.marginals(unary, counts, arcs)
    for part, u in zip(np.split(got, np.cumsum(counts)[:-1]), np.split(unary, np.cumsum(counts)[:-1]), strict=True):
        assert np.allclose(part, brute_marginals(u, arcs))


def synthetic(n, seed=1):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(300)]
    rows = []
    for i in range(n):
        words = draw.choices(vocabulary, k=40)
        if i % 4 == 0:
            for _ in range(3):
                words.insert(draw.randrange(40), draw.choice(["zorkish", "zorkful", "grubnik"]))
        rows.append((" ".join(words) + ".", int(i % 4 == 0)))
    return rows


def test_learns_words_and_leaves_clean_texts_alone():
    model = toxicity.fit(synthetic(400))
    test = synthetic(200, seed=2) + [("", 0)]
    p = toxicity.document_marginals(model, [t for t, _ in test], {})
    predicted = [int(toxicity.score(model, x) >= 0.5) for x in p]
    assert predicted == [y for _, y in test]


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_model(docs, labels)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (3, "You idiot! You moron.", 0.5), (4, "fine words here " * 30_000, 0.5)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in toxicity.score_documents(odd, model).collect()}
    assert got[1].score == got[2].score < 0.5 and not got[1].spans
    assert got[3].score >= 0.5 and [("You idiot! You moron."[s.start : s.end]) for s in got[3].spans] == ["idiot", "moron"]
    assert got[4].score < 0.5
    assert toxicity.score_documents(odd.limit(0), model).collect() == []
    held = labels.join(toxicity.score_documents(docs, model), "doc_id").where(toxicity.crc_fold("doc_id", 5) == 0).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in held)
    assert right / len(held) > 0.9


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, toxicity.fit_model(docs, labels)).first().score < 0.5


def test_sample_stays_within_its_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (100 + i)) for i in range(40)] + [(40, None), (41, "é" * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(42)], "doc_id long, toxic int")
    whole, share = toxicity.training_rows(docs, labels, "doc_id", "text", 100)
    kept, same = toxicity.training_rows(docs, labels, "doc_id", "text", 100, 1000)
    assert share == same and set(kept) < set(whole) and {y for _, y in kept} == {0, 1}
    assert all(sum(len(t.encode()) for t, y in kept if y == label) <= 1000 for label in (0, 1))
    assert toxicity.training_rows(docs, labels, "doc_id", "text", 100, 1_000_000) == (whole, share)


def test_long_sentences_equal_the_walk_and_cost_little():
    import time

    draw = np.random.default_rng(8)
    for n in (2, 3, 50, 2500):
        unary, arcs = draw.normal(-1, 4, n), draw.normal(0, 2, 4)
        walked = [x[0] for x in toxicity.log_odds(unary[None], np.array([n]), arcs)]
        for got, want in zip(toxicity.long_log_odds(unary, arcs), walked, strict=True):
            assert np.allclose(got, want, atol=1e-8)
    model = toxicity.Model({"wbad": 9.0}, -4.0, (1.0, -1.0, -1.0, 1.0), (0.0, 1.0, 1.0))
    text = "some plain words and bad ones " * 170_000
    began = time.perf_counter()
    p = toxicity.document_marginals(model, [text], {})[0]
    assert len(p) == 1_020_000 and time.perf_counter() - began < 5
    short = toxicity.document_marginals(model, ["some plain words and bad ones " * 100], {})[0]
    assert np.allclose(p[60:300], short[60:300], atol=1e-6)


def test_the_stride_is_a_parameter_and_one_trains_on_all():
    rows = [(f"plain talk number {i}. another sentence {i}. a third one.", 0) for i in range(40)] + [(f"you{i} idiot number{i}. a plain sentence {i}.", 1) for i in range(40)]
    for stride in (1, 5):
        model = toxicity.fit(rows, stride=stride)
        scores = [toxicity.score(model, p) for p in toxicity.document_marginals(model, [t for t, _ in rows], {})]
        assert min(scores[40:]) > max(scores[:40])


def test_document_counts_and_telling_words_by_hand():
    rows = [("bad dog here. bad dog here.", 1), ("a bad cat", 1), ("bad dog here.", 1), ("good dog", 0)]
    sample = toxicity.Sample(rows)
    counts = dict(zip(sample.names, sample.document_counts(1).tolist(), strict=True))
    met, want = set(), {}
    for number, (text, label) in enumerate(rows):  # a word counts once between the same neighbours, in the first document that has it there
        for sentence in text.replace(".", "|").split("|"):
            words = sentence.split()
            for i, w in enumerate(words):
                key = (words[i - 1] if i else None, w, words[i + 1] if i + 1 < len(words) else None)
                if label == 1 and key not in met:
                    met.add(key)
                    for f in toxicity.features(w):
                        want.setdefault(f, set()).add(number)
    assert {f: n for f, n in counts.items() if n} == {f: len(d) for f, d in want.items()}
    assert toxicity._telling(40, 0, 0.5, 1.0) and not toxicity._telling(2, 0, 0.1, 1.0) and not toxicity._telling(40, 10, 0.5, 1.0) and not toxicity._telling(5, 0, 0.5, 1.0)
