import corpus_pipeline
from tessera.llm import langid, toxicity

from .test_neardup import brute_classes
from .test_packing import check as check_pieces
from .test_substrings import brute as brute_repeats

DATA = "/root/testdata/sf0.01"


def texts_by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts_by_id(docs)
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.write.parquet(f"{tmp_path}/{k}")
            out = spark.read.parquet(f"{tmp_path}/{k}")
            after = texts_by_id(out)
            assert out.count() == len(after) and set(after) <= set(before)
        if name == "toxicity":
            model = toxicity.fit_model(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            bad = {i for (i, t), p in zip(before.items(), toxicity.document_marginals(model, [*before.values()], {})) if toxicity.score(model, p) >= 0.5}
            assert bad and set(before) - set(after) == bad
        elif name == "language":
            names, score = langid.predict(langid.fit_model(docs), [*before.values()])
            assert set(before) - set(after) == {i for i, n, s in zip(before, names, score) if n == "und" or s < 0.3}
        elif name == "near_duplicates":
            rows = sorted(before.items())
            assert set(after) == {rows[min(c)][0] for c in brute_classes(rows)}
        elif name == "repeated_passages":
            rows = sorted(before.items())
            want = {i: (kept if gone else t) for (i, t), (_, gone, kept) in zip(rows, brute_repeats([t for _, t in rows]))}
            assert after == want and want != before
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.text != before[r.doc_id])
        else:
            check_pieces(out.collect(), [*before.items()])
        docs = out


def test_odd_rows_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the and of to is the and of"), (4, "the and of to is the and of"), (5, "the and of to is, the and of"), (None, "the ring of and it"), (None, "the thing of and it was"), (6, "that is the and " * 30), (7, long)]
    docs = spark.createDataFrame([(i, t, "en" if t else None, "s", len(t or ""), 1, "x", 2, 3.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_removed int, kept string, content int, score double")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.columns == docs.columns, name
    got = sorted(((r.doc_id, r.text) for r in now.collect()), key=str)
    assert [i for i, _ in got] == [4, 6, 7, None, None] or {i for i, _ in got} == {4, 6, 7, None}
    assert len(got) == 5
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).collect() == [], name


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and out.count() > 50
