"""Normalization and hashing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound.functions import text as T
from copyhound.plans import code_views as V
from copyhound.plans import passages as PS
from copyhound.plans.catalog import register
from copyhound.sources.tables import read_table

# --- DuckDB fragments (RE2: no look-behind, so N2 is the quote-free form) ----
def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{T.WHITE}+|{T.WHITE}+$', '', 'g')"


def curly_sql(x: str) -> str:
    y = f"regexp_replace({x}, '(?m)//.*?$', '', 'g')"
    y = f"regexp_replace({y}, '(?s)/\\*.*?\\*/', '', 'g')"
    y = f"regexp_replace({y}, '[ \\t]+', ' ', 'g')"
    y = f"regexp_replace({y}, '\\n{T.WHITE}*\\n', chr(10), 'g')"
    return strip_sql(y)


def python_sql(x: str) -> str:
    y = f"regexp_replace({x}, '[ \\t]*#[^\\n]*', '', 'g')"
    y = f"regexp_replace({y}, '(?s)\"\"\".*?\"\"\"', '', 'g')"
    y = f"regexp_replace({y}, '(?s)''''''.*?''''''', '', 'g')"
    y = f"regexp_replace({y}, '[ \\t]+', ' ', 'g')"
    y = f"regexp_replace({y}, '\\n{T.WHITE}*\\n', chr(10), 'g')"
    return strip_sql(y)


def generic_sql(x: str) -> str:
    return PS.norm_generic_sql(x)


def normalize_sql(x: str, lang: str) -> str:
    return (f"CASE WHEN {lang} = 'python' THEN {python_sql(x)} "
            f"WHEN {lang} IN ('javascript', 'java', 'c', 'cpp', 'csharp') THEN {curly_sql(x)} "
            f"ELSE {generic_sql(x)} END")


def strip_comments_sql(x: str, lang: str) -> str:
    line = f"regexp_replace({x}, '(?m)//.*?$', '', 'g')"
    curly = f"regexp_replace({line}, '(?s)/\\*.*?\\*/', '', 'g')"
    csharp = f"regexp_replace({curly}, '(?m)///.*?$', '', 'g')"
    generic = (f"regexp_replace(regexp_replace(regexp_replace({x}, '(?m)#.*?$', '', 'g'), '(?m)//.*?$', '', 'g'), "
               f"'(?s)/\\*.*?\\*/', '', 'g')")
    return (f"CASE WHEN {lang} IN ('javascript', 'typescript', 'java', 'c', 'cpp') THEN {curly} "
            f"WHEN {lang} = 'csharp' THEN {csharp} WHEN {lang} = 'python' THEN {x} ELSE {generic} END")


CODE = V.code_files_sql()


@register("n1_normalize", f"SELECT path, language, {normalize_sql('code', 'language')} AS norm FROM {CODE} c")
def q_n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.code_files(spark, sf_dir)
    return c.select("path", "language", T.normalize("code", "language").alias("norm"))


@register("n2_normalize_python", f"SELECT path, {python_sql('code')} AS norm FROM {V.code_files_sql(['python'])} c")
def q_n2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.code_files(spark, sf_dir, ["python"])
    return c.select("path", T.normalize_python("code").alias("norm"))


@register("n3_normalize_curly",
          f"SELECT path, {curly_sql('code')} AS norm FROM {V.code_files_sql(['javascript', 'java', 'c'])} c")
def q_n3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.code_files(spark, sf_dir, ["javascript", "java", "c"])
    return c.select("path", T.normalize_curly("code").alias("norm"))


@register("n4_normalize_generic", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, {generic_sql('text')} AS norm FROM documents
UNION ALL SELECT path AS id, {generic_sql('code')} AS norm FROM {V.code_files_sql(['go'])} c""")
def q_n4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), T.normalize_generic("text").alias("norm"))
    g = V.code_files(spark, sf_dir, ["go"]).select(F.col("path").alias("id"), T.normalize_generic("code").alias("norm"))
    return d.unionByName(g)


@register("n5_strip_comments",
          f"SELECT path, language, {strip_comments_sql('code', 'language')} AS clean FROM {CODE} c")
def q_n5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.code_files(spark, sf_dir)
    return c.select("path", "language", T.strip_comments("code", "language").alias("clean"))


@register("n6_fingerprint", f"SELECT path, sha256({normalize_sql('code', 'language')}) AS fingerprint FROM {CODE} c")
def q_n6(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.code_files(spark, sf_dir)
    return c.select("path", T.fingerprint(T.normalize("code", "language")).alias("fingerprint"))


def exact_clones(df: DataFrame, id_col: str, norm_col: str) -> DataFrame:
    """Groups of equal fingerprints. Only counts and the smallest id are kept per
    group (partial aggregation: a hot fingerprint never gathers its rows)."""
    return (df.select(id_col, T.fingerprint(norm_col).alias("fingerprint"))
            .groupBy("fingerprint")
            .agg(F.count(F.lit(1)).cast("long").alias("n_copies"), F.min(id_col).alias("first_id"),
                 F.max(id_col).alias("last_id"))
            .where(F.col("n_copies") > 1))


@register("n7_exact_clones", f"""
SELECT fingerprint, CAST(count(*) AS BIGINT) AS n_copies, min(id) AS first_id, max(id) AS last_id
FROM (SELECT doc_id AS id, sha256({generic_sql('text')}) AS fingerprint FROM documents) d
GROUP BY fingerprint HAVING count(*) > 1""")
def q_n7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"),
                                                      T.normalize_generic("text").alias("norm"))
    return exact_clones(d, "id", "norm")


@register("n7_clone_members", f"""
WITH d AS (SELECT doc_id, sha256({generic_sql('text')}) AS fingerprint FROM documents),
g AS (SELECT fingerprint, min(doc_id) AS first_id FROM d GROUP BY fingerprint HAVING count(*) > 1)
SELECT d.doc_id, g.first_id FROM d JOIN g USING (fingerprint)""")
def q_n7_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of a clone group with the group's smallest id (joined back on
    the fingerprint, so no group is ever collected)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(T.normalize_generic("text"))
                                                      .alias("fingerprint"))
    groups = (d.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").drop("n"))
    return d.join(groups, "fingerprint").select("doc_id", "first_id")


@register("n9_clip", """
SELECT page_id, substring(html, 1, 300) || '...' AS clipped, substring(html, 1, 5000) AS head FROM pages""")
def q_n9(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", T.clip("html").alias("clipped"), F.substring("html", 1, 5000).alias("head"))


@register("n10_percent_text", f"""
SELECT doc_id, item_id, {T.percent_sql('similarity')} AS similarity_percentage FROM ({PS.pairs_sql()}) p""")
def q_n10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = PS.passage_pairs(spark, sf_dir)
    return p.select("doc_id", "item_id", T.percent_text("similarity").alias("similarity_percentage"))
