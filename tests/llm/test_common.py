import zlib

import pyarrow as pa

from tessera.llm import common, graphs, hashing


def test_folds_equal_crc32_of_decimal_text(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, -3, 10**15, None)], "doc_id long")
    got = rows.select("doc_id", common.crc_fold("doc_id", 5).alias("fold")).collect()
    assert all(r.fold == zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 for r in got)


def test_tables_are_written_read_and_forgotten(spark):
    table = common.materialize(spark.range(10), "numbers")
    assert table.count() == 10 and table.dtypes == spark.range(1).dtypes
    common.forget(table)
    at = spark._jvm.org.apache.hadoop.fs.Path(table._tessera_path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_smaller_batches_of_the_session_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for set_, want in (("10000", "2000"), ("500", "500"), ("0", "2000")):
        spark.conf.set(name, set_)
        common.small_batches(spark)
        assert spark.conf.get(name) == want
    spark.conf.set(name, before)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 120)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 120)} == {100} and {got[i] for i in (200, 201, 202)} == {200}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_words_are_hashed_alike_wherever_they_stand():
    blank = __import__("numpy").array([b != 0x20 for b in range(256)])
    column = pa.array(["pad", "a bc  a", None, "", "bc", " é bc"]).slice(1)
    a, b, c, d, e = hashing.hashed_words(column, blank)
    assert len(a) == 3 and a[0] == a[2] and not len(b) and not len(c) and d[0] == a[1] == e[1] and len(e) == 2
