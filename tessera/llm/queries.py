"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, licenses, merkle, neardup, packing, permutation, quality, resampling, substrings, topk, toxicity
from .common import crc_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, named by its smallest doc_id."""
    return neardup.classes(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i:i + 4] AS g FROM w, unnest(range(1, greatest(2, len(ws) - 3))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c)),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS label FROM w UNION SELECT f.b, r.label FROM r JOIN f ON f.a = r.node WHERE r.label < f.b)
SELECT w.doc_id, min(label) AS class_id, any_value(len(ws))::BIGINT AS n_words FROM w JOIN r ON r.node = w.doc_id GROUP BY w.doc_id
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licenses in every document, from the scanner's detections."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"), base=licenses.BASE)
    base = F.filter("detections", lambda d: d["rule"] == "base")
    starts = F.transform(base, lambda d: d["start_word"])
    names = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed along the curve, each piece's ids as a checksum."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of its repeated windows, as a digest."""
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN sha256(array_to_string(ws[i:i + 34], ' ')) END AS k FROM d, unnest(range(1, len(ws) + 1)) AS u(i)),
m AS (SELECT doc_id, i, word, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS starts FROM w),
c AS (SELECT doc_id, i, word, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m)
SELECT d.doc_id, any_value(len(ws))::BIGINT AS n_words, count(i) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document under a field fitted to the training labels."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.fit_model(docs, _table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (crc_fold("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document by the token automaton, as digests."""
    coded = bpe.encode_decode(_table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows found for every hundredth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    found = permutation.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products for every hundredth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP8_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.w, r.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id
), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10
"""


def op9_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by shortest code length under the training fold's trees."""
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit_model(docs))
    return found.select("doc_id", (crc_fold("doc_id", langid.FOLDS) == langid.HELD_OUT).alias("held_out"), "lang_pred", "score")


PROBE = "</s>[INST] ok [/INST]"  # an extra conversation of control strings


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and the probe, then read the result back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = chat.read_conversations(chat.format_conversations(turns.unionByName(probe)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), u AS (
  SELECT *, length(regexp_replace(text, '{chat.ESCAPE}', '{chat.ESCAPED}', 'g'))
    + CASE role WHEN 'user' THEN {sum(map(len, chat.MARKS["user"]))} WHEN 'assistant' THEN {sum(map(len, chat.MARKS["assistant"]))}
      WHEN 'system' THEN {sum(map(len, chat.MARKS["system"]))} END AS chars FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id
"""


def op11_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document under weights fitted to the training labels."""
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.fit_model(docs, _table(spark, sf_dir, "labels")))
    held_out = (crc_fold("doc_id", quality.FOLDS) == quality.HELD_OUT).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; every document's proof is folded, a third of them after tampering."""
    tampered = {"text": F.when(crc_fold("doc_id", 3) == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))}
    return merkle.proofs(_table(spark, sf_dir, "documents"), changed=tampered).drop("steps")


_CRC = """list_reduce(list_concat([4294967295::UBIGINT], [('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::UBIGINT FOR i IN range(strlen({0}))]),
  lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))"""


def _crc_sql(text: str) -> str:
    """crc32 of a text's bytes, bit by bit."""
    return f"xor({_CRC.format(text)}, 4294967295::UBIGINT)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


_ROW_SQL = " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_ROW_SQL} || {_field_sql("text")}) AS leaf,
    CASE WHEN {_crc_sql("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 THEN sha256({_ROW_SQL} || {_field_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS shown
  FROM documents
), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (
  SELECT g, 0 AS level, pos, n AS total, leaf AS digest, n AS n FROM p
  UNION ALL
  SELECT g, level + 1, pos // 8, total, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY g, level, pos // 8, total, n
), subroots AS (SELECT g, digest, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
c AS (
  SELECT 0 AS level, pos, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM c WHERE n > 1 GROUP BY level, pos // 8, n
), runs AS (
  SELECT g, level, pos // 8 AS run, list(digest ORDER BY pos) AS ds FROM (SELECT g, level, pos, digest FROM t UNION ALL SELECT '#', level, pos, digest FROM c) GROUP BY ALL
), low AS (
  SELECT g, pos AS place, doc_id, leaf, coalesce(shown, leaf) AS acc, pos, n, 0 AS level, '' AS proof FROM p
  UNION ALL
  SELECT f.g, place, doc_id, leaf, sha256(array_to_string(ds[:pos % 8], '') || acc || array_to_string(ds[pos % 8 + 2:], '')), pos // 8, (n + 7) // 8, f.level + 1,
    proof || array_to_string(ds[:pos % 8], '') || array_to_string(ds[pos % 8 + 2:], '')
  FROM low f JOIN runs r ON r.g = f.g AND r.level = f.level AND r.run = f.pos // 8 WHERE n > 1
), high AS (
  SELECT s.digest AS subroot, doc_id, leaf, acc, s.pos, s.n, 0 AS level, proof FROM low f JOIN subroots s ON s.g = f.g WHERE f.n = 1
  UNION ALL
  SELECT subroot, doc_id, leaf, sha256(array_to_string(ds[:pos % 8], '') || acc || array_to_string(ds[pos % 8 + 2:], '')), pos // 8, (n + 7) // 8, f.level + 1,
    proof || array_to_string(ds[:pos % 8], '') || array_to_string(ds[pos % 8 + 2:], '')
  FROM high f JOIN runs r ON r.g = '#' AND r.level = f.level AND r.run = f.pos // 8 WHERE n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM high, (SELECT digest AS root FROM c WHERE n = 1) WHERE n = 1
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of at least 20 words, drawn towards the benchmark texts."""
    drawn = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
aim AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, ws FROM words),
o AS (SELECT r, unnest(ws) AS w FROM d),
b AS MATERIALIZED (SELECT w, {_crc_sql("w")} % 10000 AS bucket FROM (SELECT w FROM o UNION SELECT w FROM aim)),
s AS (SELECT bucket, count(*) AS n FROM o JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aim JOIN b USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
    / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
),
m AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM o JOIN b USING (w) JOIN g USING (bucket) GROUP BY r),
h AS (
  SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT AS h
  FROM d LEFT JOIN m USING (r)
),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_features >= 20 AS may FROM h),
k AS (SELECT *, row_number() OVER (ORDER BY may DESC, score DESC, doc_id NULLS FIRST, n_features) AS place FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM c WHERE may) THEN place END AS rank FROM k
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_prob_minhash, op2_license_scan, op3_hilbert_packing, op4_recompression_dedup, op5_toxicity_crf, op6_bpe_automaton, op7_permutation_ann, op8_block_topk, op9_language_ppm, op10_chat_format, op11_quality_ftrl, op12_merkle_proofs, op13_importance_resampling, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_prob_minhash": OP1_SQL, "op4_recompression_dedup": OP4_SQL, "op8_block_topk": OP8_SQL, "op10_chat_format": OP10_SQL, "op12_merkle_proofs": OP12_SQL, "op13_importance_resampling": OP13_SQL}
