"""Postings of the line index: one row a run and part, whatever the number of blocks; parts that cut blocks lose nothing."""

import random

from pyspark.sql import functions as F

from tessera.operators import text
from tessera.sources import line_index


def test_runs_are_those_of_each_line():
    draw = random.Random(7)
    letters = ["ab c", "aé😀\x00b", "".join(map(chr, range(0x20, 0x1000)))]
    for choice in (*letters, "".join(map(chr, range(0x10000, 0x40000)))):
        texts = ["".join(draw.choices(choice, k=draw.choice((0, 1, 2, 3, 9, 80)))) for _ in range(60)] + ([choice] if len(choice) > 100_000 else [])
        places = [i // 7 for i in range(len(texts))]
        got = {(run, int(p)) for names, bounds, found in line_index._runs(texts, places) for n, run in enumerate(names) for p in found[bounds[n] : bounds[n + 1]]}
        assert got == {(t[i : i + 3], p) for t, p in zip(texts, places, strict=True) for i in range(len(t) - 2)}
    assert [names for names, _, _ in line_index._runs([""], [0])] == [[]]


def test_postings_of_many_blocks_are_few_rows_and_parts_may_cut_blocks(spark, tmp_path, monkeypatch):
    lines = spark.range(0, 20_000, 1, 4).select((F.col("id") / 10).cast("long").cast("string").alias("path"), (F.col("id") % 10 * 32).cast("int").alias("line_no"), F.concat(F.lit("license no "), F.hex(F.col("id"))).alias("text"))
    line_index.build(lines, str(tmp_path / "one"))
    rows = spark.read.schema(line_index.POSTINGS).parquet(str(tmp_path / "one" / "postings"))
    assert rows.where("gram = 'lic'").count() == spark.read.schema(line_index.PARTS).parquet(str(tmp_path / "one" / "parts")).count() < 100
    assert rows.where("gram = 'lic'").agg(F.sum(F.size("places"))).first()[0] >= 10_000
    want = sorted((r.path, r.line_no, r.hit) for r in text.search(lines, "no 4E|no 1F").collect())
    assert want and sorted((r.key, r.line_no, r.hit) for r in line_index.search(spark, str(tmp_path / "one"), "no 4E|no 1F").collect()) == want
