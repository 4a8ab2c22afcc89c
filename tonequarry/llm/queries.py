"""The thin queries of the operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from . import best_fit, common, fingerprint, langid, line_dedup, lm_score, manifest, mixing, near_dedup, packing, pii, prefix_trie, quality, secret_scan


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(common.documents(spark, sf_dir).select("doc_id", "text"))


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "text")
    # Words are counted once; the rows that all else reads are narrow.
    mixed = mixing.mix(written(mixing.sized(docs, "doc_id"), "sizes"))
    at = lambda k: F.get("__reads", F.lit(k))["position"]
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.aggregate("__reads", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("taken"),
        at(0).alias("position"),
        at(1).alias("position_again"),
    )


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(common.documents(spark, sf_dir).select("doc_id", "text"), written=written)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", F.col("__held_out").alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op5_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(common.documents(spark, sf_dir).select("doc_id", "text"), written=written)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(common.documents(spark, sf_dir).select("doc_id", "text"))


def op7_pack_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), written=written)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(common.documents(spark, sf_dir).select("doc_id", "text"), words=3, percent=85, written=written)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.documents(spark, sf_dir).select("doc_id", "text", "lang"), written=written)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.dedup_lines(docs, written=written).select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op11_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return best_fit.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), written=written)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", "text")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = manifest.leaf(*others, common.ascii_lower(F.col("text")))
    claimed = F.when(common.remainder(3) == 0, tampered).otherwise(manifest.leaf(*others, F.col("text")))
    return manifest.manifest(docs, claimed, written=written)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie.prefix_trie(turns, written=written)


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_curriculum_mix": op2_curriculum_mix,
    "op3_personal_data": op3_personal_data,
    "op4_language_id": op4_language_id,
    "op5_context_trees": op5_context_trees,
    "op6_secret_scan": op6_secret_scan,
    "op7_pack_ffd": op7_pack_ffd,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_pack_best_fit": op11_pack_best_fit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_trie": op13_prefix_trie,
}



def _crc32(text: str) -> str:
    """crc32 of a text expression of ASCII characters, bit by bit; 3988292384 is the fixed polynomial."""
    byte = "list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(r, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda r, b: {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _said(*columns: str) -> str:
    return " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in columns)


ORACLE_SQL = {
    "op2_curriculum_mix": r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS skey,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS total FROM d GROUP BY skey),
k AS (SELECT skey, total, row_number() OVER (ORDER BY skey) - 1 AS rnk FROM s),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS wt, total * 2.0::DOUBLE AS cap FROM k),
r AS (SELECT *, cap / wt AS ratio FROM w),
c AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS caps_before,
         sum(wt) OVER (ORDER BY ratio, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from,
         (sum(total) OVER ())::BIGINT * 1.5::DOUBLE AS everything
  FROM r),
l AS (SELECT *, (everything - caps_before) / w_from AS lvl FROM c),
f AS (SELECT (SELECT lvl FROM l WHERE lvl <= ratio ORDER BY ratio, rnk LIMIT 1) AS lvl),
t AS (
  SELECT l.skey, l.total, round(CASE WHEN f.lvl IS NULL OR l.cap <= l.wt * f.lvl THEN l.cap ELSE l.wt * f.lvl END, 6) AS target
  FROM l, f),
e AS (
  SELECT coalesce(sum(round(t.target * 1000000)::BIGINT) FILTER (WHERE k.rnk % 2 = 0), 0)::BIGINT / 1000000.0::DOUBLE AS even,
         coalesce(sum(round(t.target * 1000000)::BIGINT) FILTER (WHERE k.rnk % 2 = 1), 0)::BIGINT / 1000000.0::DOUBLE AS odd
  FROM t JOIN k USING (skey)),
p AS (
  SELECT d.doc_id, d.size, t.total AS source_size, t.target, round(t.target)::BIGINT AS stop, k.rnk % 2 = 0 AS falls,
         coalesce(sum(d.size) OVER (PARTITION BY d.skey ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef
  FROM d JOIN t USING (skey) JOIN k USING (skey)),
q AS (
  SELECT *, least(size, stop - bef) AS w0, least(size, stop - bef - source_size) AS w1,
         CASE WHEN falls THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS a, CASE WHEN falls THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS m
  FROM p),
r2 AS (SELECT *, bef + w0 / 2.0::DOUBLE AS m0, bef + source_size + w1 / 2.0::DOUBLE AS m1 FROM q),
u AS (
  SELECT *, CASE WHEN target > 0 THEN (sqrt(greatest(0.0::DOUBLE, a * a + 2.0::DOUBLE * m * (m0 / target))) - a) / m END AS t0,
         CASE WHEN target > 0 THEN (sqrt(greatest(0.0::DOUBLE, a * a + 2.0::DOUBLE * m * (m1 / target))) - a) / m END AS t1
  FROM r2)
SELECT doc_id, size, source_size, target, (greatest(0, w0) + greatest(0, w1))::BIGINT AS taken,
       CASE WHEN (w0 > 0 OR (w0 = 0 AND size = 0 AND bef < stop)) AND m0 < target
            THEN round((1.5::DOUBLE * even + 0.5::DOUBLE * odd) * t0 + 0.5::DOUBLE * (odd - even) * t0 * t0, 3) END AS position,
       CASE WHEN w1 > 0 AND m1 < target
            THEN round((1.5::DOUBLE * even + 0.5::DOUBLE * odd) * t1 + 0.5::DOUBLE * (odd - even) * t1 * t1, 3) END AS position_again
FROM u, e""",
    "op10_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, (c.key IS NOT NULL AND k.doc_id <> c.last) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op12_merkle_manifest": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place,
         count(*) OVER (PARTITION BY lang) AS n, sha256({_said("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
         CASE WHEN {_crc32("coalesce(doc_id::VARCHAR, '')")} % 3 = 0
              THEN sha256({_said("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS tampered
  FROM documents),
u AS (
  SELECT tree, 0 AS lvl, place, n, leaf AS h FROM d
  UNION ALL
  SELECT tree, lvl + 1, place // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY place)) FROM u WHERE n > 1 GROUP BY tree, lvl, place // 8),
w AS (
  SELECT 0 AS lvl, tree AS place, count(*) OVER () AS n, h FROM u WHERE n = 1
  UNION ALL
  SELECT lvl + 1, place // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY place)) FROM w WHERE n > 1 GROUP BY lvl, place // 8),
su AS (
  SELECT tree, lvl, place, coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM u WHERE n > 1),
sw AS (
  SELECT lvl, place, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY lvl, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM w WHERE n > 1),
f AS (
  SELECT doc_id, tree, 0 AS lvl, place, coalesce(tampered, leaf) AS h, '' AS proof FROM d
  UNION ALL
  SELECT f.doc_id, f.tree, f.lvl + 1, f.place // 8, sha256(su.l || f.h || su.r), f.proof || su.l || su.r
  FROM f JOIN su ON su.tree = f.tree AND su.lvl = f.lvl AND su.place = f.place),
g AS (
  SELECT f.doc_id, f.tree, 0 AS lvl, f.tree AS place, f.h, f.proof FROM f JOIN u ON u.n = 1 AND u.tree = f.tree AND u.lvl = f.lvl
  UNION ALL
  SELECT g.doc_id, g.tree, g.lvl + 1, g.place // 8, sha256(sw.l || g.h || sw.r), g.proof || sw.l || sw.r
  FROM g JOIN sw ON sw.lvl = g.lvl AND sw.place = g.place)
SELECT d.doc_id, d.leaf, u.h AS subroot, w.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = w.h AS verified
FROM g JOIN w ON w.n = 1 AND w.lvl = g.lvl JOIN d ON d.doc_id = g.doc_id JOIN u ON u.n = 1 AND u.tree = d.tree""",
    "op13_prefix_trie": rf"""
WITH t AS (
  SELECT conv_id, strlen(coalesce(text, '')) AS size, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, max(place) AS length, conv_id - conv_id % 5 AS base, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM t GROUP BY conv_id),
k AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.length, 0)) AS lent FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (
  SELECT conv_id, 0 AS place, 0 AS size, '' AS h FROM k
  UNION ALL SELECT k.conv_id, t.place, t.size, t.h FROM k JOIN t ON t.conv_id = k.base AND t.place <= k.lent
  UNION ALL SELECT k.conv_id, t.place - k.h + k.lent, t.size, t.h FROM k JOIN t ON t.conv_id = k.conv_id AND t.place > k.h),
p AS (
  SELECT conv_id, place, size, md5(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY place)) AS id,
         place = max(place) OVER (PARTITION BY conv_id) AS last
  FROM r),
v AS (
  SELECT id, place, min(conv_id) AS least, count(*) AS n, max(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends
  FROM p GROUP BY id, place),
e AS (SELECT v.*, up.id AS above FROM v LEFT JOIN p up ON up.conv_id = v.least AND up.place = v.place - 1),
x AS (SELECT above, count(*) AS children FROM e WHERE above IS NOT NULL GROUP BY above),
s AS (
  SELECT p.id, sum((e.n - 1) * e.size)::BIGINT AS saved, (count(*) FILTER (WHERE x.children IS NULL))::BIGINT AS leaves
  FROM e LEFT JOIN x ON x.above = e.id JOIN p ON p.conv_id = e.least AND p.place <= e.place GROUP BY p.id)
SELECT e.least AS conv_id, e.place::BIGINT AS depth, up.least AS parent_conv_id, e.n::BIGINT AS n_convs, coalesce(x.children, 0)::BIGINT AS n_children,
       s.leaves AS n_leaves, s.saved AS saved_tokens, e.ends AS ends_sha256
FROM e LEFT JOIN v up ON up.id = e.above LEFT JOIN x ON x.above = e.id JOIN s ON s.id = e.id""",
}
