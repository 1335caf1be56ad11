"""Minimum slice: which known passages (`benchmark`) were copied into which submitted
texts (`documents`)? Whole text = one block (X6) -> N4 -> word 5-gram X1 through the
gram join (R9 `grams`) -> floor (F9) -> dedup (P1) -> top-10 (P2) -> file report (P3, P5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.functions import text as T
from copyhound.operators import report as R
from copyhound.operators.similarity import gram_similarity
from copyhound.sources.tables import read_table, spread


def normalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id", "source", T.normalize_generic("text").alias("norm"))


def normalized_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, sf_dir, "benchmark")
    return b.select("item_id", T.normalize_generic("text").alias("norm"))


def passage_pairs(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Every (doc, passage) pair sharing a word k-gram, with the Dice score and
    containment of the passage in the document."""
    pairs = gram_similarity(normalized_documents(spark, sf_dir), normalized_passages(spark, sf_dir),
                            "doc_id", "item_id", k=k, unit="word")
    return pairs.withColumnRenamed("left_grams", "doc_grams").withColumnRenamed("right_grams", "item_grams")


def copied_passages(spark: SparkSession, sf_dir: str, cfg: C.CheckConfig = C.CheckConfig()) -> DataFrame:
    """Flagship: per document the best ``top_code`` passages at or above the floor."""
    return copied_from_pairs(passage_pairs(spark, sf_dir, cfg.gram_k), cfg)


def copied_from(docs: DataFrame, profile: DataFrame, cfg: C.CheckConfig = C.CheckConfig()) -> DataFrame:
    """The flagship over given documents (doc_id, text) and a passage profile (item_id, h, c2, right_grams)."""
    d = docs.select("doc_id", T.normalize_generic("text").alias("norm"))
    pairs = gram_similarity(d, None, "doc_id", "item_id", k=cfg.gram_k, unit="word", right_profile=profile)
    pairs = pairs.withColumnRenamed("left_grams", "doc_grams").withColumnRenamed("right_grams", "item_grams")
    return copied_from_pairs(pairs, cfg)


def copied_from_pairs(pairs: DataFrame, cfg: C.CheckConfig = C.CheckConfig()) -> DataFrame:
    pairs = R.match_floor(pairs, "code", floor=cfg.code_floor)
    top = R.top_matches(pairs, ["doc_id"], cfg.top_code, tiebreak=["item_id"])
    return top.select(
        "doc_id", "item_id", "shared", "doc_grams", "item_grams", "similarity", "containment",
        T.percent_text("similarity").alias("similarity_percentage"),
        R.match_badge("similarity").alias("badge"),
        "match_rank",
    )


def passage_file_report(spark: SparkSession, sf_dir: str, cfg: C.CheckConfig = C.CheckConfig()) -> DataFrame:
    """P3 + P5 over every document: best passage score, number of matches, label."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    matches = copied_passages(spark, sf_dir, cfg)
    rep = R.file_report(docs, ["doc_id"], code_matches=matches)
    return rep.join(docs, "doc_id").select("source", "doc_id", "code_max", "n_code", "web_max", "n_web", "label",
                                           R.file_badge("code_max").alias("badge"))


def passage_overall_report(spark: SparkSession, sf_dir: str, cfg: C.CheckConfig = C.CheckConfig()) -> DataFrame:
    """File, submission (= source) and overall rows from one ROLLUP."""
    rep = passage_file_report(spark, sf_dir, cfg)
    return R.overall_report(rep, "source", "doc_id")


# ---------------------------------------------------------------------------
# DuckDB oracles
# ---------------------------------------------------------------------------
def norm_generic_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '(?ms)//.*?$|/\\*.*?\\*/', '', 'g'), '{T.WHITE}+', ' ', 'g'))"


def _words_sql(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, ' ') END"


def pairs_sql(k: int = 5) -> str:
    return f"""
WITH d AS (SELECT doc_id, {_words_sql(norm_generic_sql('text'))} AS w FROM documents),
b AS (SELECT item_id, {_words_sql(norm_generic_sql('text'))} AS w FROM benchmark),
dg AS (SELECT doc_id, g, count(*) AS c1 FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS g FROM d)
       GROUP BY doc_id, g),
bg AS (SELECT item_id, g, count(*) AS c2 FROM (
        SELECT item_id, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS g FROM b)
       GROUP BY item_id, g),
s AS (SELECT doc_id, item_id, CAST(sum(least(c1, c2)) AS BIGINT) AS shared FROM dg JOIN bg USING (g) GROUP BY doc_id, item_id),
dt AS (SELECT doc_id, CAST(greatest(len(w) - {k - 1}, 0) AS BIGINT) AS doc_grams FROM d),
bt AS (SELECT item_id, CAST(greatest(len(w) - {k - 1}, 0) AS BIGINT) AS item_grams FROM b)
SELECT doc_id, item_id, shared, doc_grams, item_grams,
       2 * shared / (doc_grams + item_grams) AS similarity,
       shared / item_grams AS containment
FROM s JOIN dt USING (doc_id) JOIN bt USING (item_id)
"""


def copied_sql() -> str:
    return f"""
WITH p AS ({pairs_sql()}),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, item_id) AS match_rank
      FROM p WHERE similarity >= {C.CODE_MATCH_FLOOR})
SELECT doc_id, item_id, shared, doc_grams, item_grams, similarity, containment,
       {T.percent_sql('similarity')} AS similarity_percentage,
       CASE WHEN similarity > 0.8 THEN 'high' WHEN similarity > 0.6 THEN 'medium' ELSE 'low' END AS badge,
       match_rank
FROM f WHERE match_rank <= {C.TOP_CODE_MATCHES}
"""


def file_report_sql() -> str:
    return f"""
WITH m AS ({copied_sql()}),
a AS (SELECT doc_id, max(similarity) AS code_max, count(*) AS n_code FROM m GROUP BY doc_id),
r AS (SELECT d.source, d.doc_id, coalesce(a.code_max, 0.0) AS code_max, CAST(coalesce(a.n_code, 0) AS BIGINT) AS n_code,
             0.0 AS web_max, CAST(0 AS BIGINT) AS n_web
      FROM documents d LEFT JOIN a USING (doc_id))
SELECT source, doc_id, code_max, n_code, web_max, n_web,
       CASE WHEN code_max >= {C.RISK_THRESHOLD} OR web_max >= {C.RISK_THRESHOLD} THEN 'potential_issues'
            WHEN n_code + n_web > 0 THEN 'minor' ELSE 'original' END AS label,
       CASE WHEN code_max * 100 > 50 THEN 'high' WHEN code_max * 100 > 30 THEN 'medium' ELSE 'low' END AS badge
FROM r
"""


def overall_sql() -> str:
    return f"""
WITH r AS ({file_report_sql()}),
g AS (SELECT CASE WHEN grouping(source, doc_id) = 0 THEN 'file' WHEN grouping(source, doc_id) = 1 THEN 'submission' ELSE 'overall' END AS level,
             source, doc_id, max(code_max) AS code_max, max(web_max) AS web_max,
             CAST(sum(n_code + n_web) AS BIGINT) AS total_matches, CAST(count(*) AS BIGINT) AS n_files
      FROM r GROUP BY ROLLUP (source, doc_id))
SELECT level, source, doc_id, code_max, web_max, greatest(code_max, web_max) AS max_overall, total_matches, n_files,
       CASE WHEN code_max >= {C.RISK_THRESHOLD} OR web_max >= {C.RISK_THRESHOLD} THEN 'potential_issues'
            WHEN total_matches > 0 THEN 'minor' ELSE 'original' END AS label,
       CASE WHEN round(greatest(code_max, web_max) * 100, 1) < 30 THEN 'low'
            WHEN round(greatest(code_max, web_max) * 100, 1) < 70 THEN 'medium' ELSE 'high' END AS band
FROM g
"""
