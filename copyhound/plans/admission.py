"""Admission queries over the files view and the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.operators import admit as A
from copyhound.operators import report as R
from copyhound.plans import code_views as V
from copyhound.plans.catalog import register
from copyhound.session import kept, scratch_path
from copyhound.sources.tables import read_table

# --- SQL fragments (DuckDB) -------------------------------------------------
EXT_SQL = "CASE WHEN contains({p}, '.') THEN '.' || lower(regexp_extract({p}, '\\.([^.]*)$', 1)) ELSE '' END"
SPLITEXT_SQL = "lower(regexp_extract(regexp_extract({p}, '([^/]*)$', 1), '^\\.*[^.].*?(\\.[^.]*)$', 1))"


def ext_sql(p: str) -> str:
    return EXT_SQL.format(p=p)


def lang_sql(p: str) -> str:
    seen = {}
    for ext, lang, _, _ in C.language_rows():
        seen.setdefault(ext, lang)
    whens = " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in seen.items())
    return f"CASE WHEN contains({p}, '.') THEN (CASE {SPLITEXT_SQL.format(p=p)} {whens} END) END"


def allowed_sql(p: str) -> str:
    exts = ", ".join(f"'{e}'" for e in C.allowed_extensions())
    return f"({ext_sql(p)} IN ({exts}))"


def searchable_sql(lang: str) -> str:
    return f"({lang} IN ({', '.join(repr(x) for x in C.SEARCHABLE_LANGUAGES)}))"


def tags_sql(t: str) -> str:
    parts = ", ".join(f"CASE WHEN regexp_matches({t}, '(?i){p}') THEN '{n}' END" for n, p in C.SUSPICIOUS_PATTERNS)
    return f"concat_ws(',', {parts})"


def long_line_sql(t: str) -> str:
    return f"(len(list_filter(string_split({t}, chr(10)), lambda l: length(l) > {C.MAX_LINE_CHARS})) > 0)"


def valid_sql(t: str) -> str:
    return f"(NOT {long_line_sql(t)} AND length({t}) <= {C.MAX_CONTENT_CHARS})"


def url_allowed_sql(u: str) -> str:
    return "NOT (" + " OR ".join(f"contains(lower({u}), '{x}')" for x in C.URL_BLOCKLIST) + ")"


FILES = V.upload_files_sql()


# --- F1 ---------------------------------------------------------------------
@register("f1_allowed_ext", f"SELECT path, {ext_sql('path')} AS ext, {allowed_sql('path')} AS allowed FROM {FILES} f")
def q_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.upload_files(spark, sf_dir)
    return f.select("path", A.last_ext("path").alias("ext"), A.allowed_ext("path").alias("allowed"))


# --- F2 ---------------------------------------------------------------------
@register("f2_detect_language",
          f"SELECT path, {lang_sql('path')} AS language, coalesce({searchable_sql(lang_sql('path'))}, false) AS searchable "
          f"FROM {FILES} f")
def q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.upload_files(spark, sf_dir)
    lang = A.detect_language("path")
    return f.select("path", lang.alias("language"), F.coalesce(A.searchable(lang), F.lit(False)).alias("searchable"))


# --- F3 ---------------------------------------------------------------------
@register("f3_size_guard", f"""
WITH f AS {FILES}, b AS (SELECT submission_id FROM f GROUP BY submission_id HAVING max(length) > {C.MAX_UPLOAD_BYTES})
SELECT f.submission_id, f.path, f.length, (b.submission_id IS NOT NULL) AS blocked
FROM f LEFT JOIN b USING (submission_id)""")
def q_size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.size_guard(V.upload_files(spark, sf_dir))
    return g.select("submission_id", "path", "length", "blocked")


# --- F4 ---------------------------------------------------------------------
@register("f4_validate_content", f"""
SELECT 'doc' AS kind, CAST(doc_id AS VARCHAR) AS id, CAST(length(text) AS BIGINT) AS n_chars, {long_line_sql('text')} AS long_line, {valid_sql('text')} AS valid FROM documents
UNION ALL SELECT 'file', path, CAST(length(text) AS BIGINT), {long_line_sql('text')}, {valid_sql('text')} FROM {FILES} f""")
def q_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text")
    f = V.upload_files(spark, sf_dir).select(F.lit("file").alias("kind"), F.col("path").alias("id"), "text")
    return d.unionByName(f).select("kind", "id", F.length("text").cast("long").alias("n_chars"),
                                   A.long_line("text").alias("long_line"), A.valid_content("text").alias("valid"))


# --- F5 ---------------------------------------------------------------------
@register("f5_tag_suspicious", f"""
SELECT 'doc' AS kind, CAST(doc_id AS VARCHAR) AS id, {tags_sql('text')} AS tags FROM documents
UNION ALL SELECT 'code', path, {tags_sql('code')} FROM {V.code_files_sql()} c
UNION ALL SELECT 'file', path, {tags_sql('text')} FROM {FILES} f""")
def q_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select(
        F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("id"), A.suspicious_tags("text").alias("tags"))
    c = V.code_files(spark, sf_dir).select(
        F.lit("code").alias("kind"), F.col("path").alias("id"), A.suspicious_tags("code").alias("tags"))
    f = V.upload_files(spark, sf_dir).select(F.lit("file").alias("kind"), F.col("path").alias("id"), A.suspicious_tags("text").alias("tags"))
    return d.unionByName(c).unionByName(f)


# --- F8 ---------------------------------------------------------------------
# `pages` has no blocked address, so each page also stands for a link to one kind of it
LINKS_SQL = """(SELECT page_id, url FROM pages UNION ALL
SELECT page_id, concat(url, CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '/a.zip' WHEN 2 THEN '?r=youtube.com' ELSE '/page' END) FROM pages)"""


@register("f8_url_filter", f"SELECT page_id, url, {url_allowed_sql('url')} AS allowed FROM {LINKS_SQL} l")
def q_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    tail = F.expr("CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '/a.zip' WHEN 2 THEN '?r=youtube.com' ELSE '/page' END")
    links = p.unionByName(p.select("page_id", F.concat("url", tail).alias("url")))
    return links.select("page_id", "url", A.url_allowed("url").alias("allowed"))


# --- F10 --------------------------------------------------------------------
MEMBERS = V.archive_members_sql()
READ_MEMBERS = f"""(SELECT * FROM {MEMBERS} m
WHERE NOT ends_with(path, '/') AND NOT starts_with(regexp_extract(path, '([^/]*)$', 1), '.') AND is_text)"""


def admit_sql(with_text: bool = False) -> str:
    lang = lang_sql("path")
    return f"""
WITH f AS {FILES}, b AS (SELECT submission_id FROM f GROUP BY submission_id HAVING max(length) > {C.MAX_UPLOAD_BYTES}),
m AS {READ_MEMBERS},
z AS (SELECT *, {ext_sql('path')} = '{C.ARCHIVE_EXTENSION}' AS is_archive FROM f),
a AS (SELECT submission_id, NULL AS archive, path, length, text, is_text, false AS nothing FROM z WHERE NOT is_archive
      UNION ALL SELECT submission_id, NULL, path, length, text, is_text, true FROM z ANTI JOIN (SELECT submission_id, archive AS path FROM m) r USING (submission_id, path) WHERE is_archive
      UNION ALL SELECT submission_id, archive, path, length, text, is_text, false FROM m),
g AS (SELECT a.*, (b.submission_id IS NOT NULL) AS blocked FROM a LEFT JOIN b USING (submission_id))
SELECT submission_id, archive, path, length, {lang} AS language,
       CASE WHEN blocked THEN 'oversize_submission'
            WHEN nothing THEN 'empty_archive'
            WHEN NOT {allowed_sql('path')} THEN 'unsupported_type'
            WHEN archive IS NULL AND NOT is_text THEN 'not_text'
            WHEN {lang} IS NULL THEN 'no_language'
            WHEN NOT {valid_sql('text')} THEN 'bad_content' END AS reason,
       {tags_sql('text')} AS tags{", text" if with_text else ""}
FROM g"""


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the view is a long expression: printed once as a table, so that no column repeats it
    uploads = kept(V.upload_files(spark, sf_dir), "uploads")
    return A.admit(uploads, V.archive_members(spark, sf_dir, uploads))


@register("f10_admit", admit_sql())
def q_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(spark, sf_dir).drop("text")


# --- S7 ---------------------------------------------------------------------
@register("s7_write_rejects", f"SELECT submission_id, path, reason FROM ({admit_sql()}) a WHERE reason IS NOT NULL")
def q_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected files written as a table by reason in the shared folder, and read back."""
    path = scratch_path(spark, f"rejects/{uuid.uuid4().hex[:8]}")
    rejected = admitted(spark, sf_dir).where(F.col("reason").isNotNull()).select("submission_id", "path", "reason")
    rejected.write.partitionBy("reason").parquet(path)
    return spark.read.parquet(path).select("submission_id", "path", "reason")


# --- S2 ---------------------------------------------------------------------
@register("s2_read_members", f"SELECT submission_id, archive, path, {lang_sql('path')} AS language FROM {READ_MEMBERS} r")
def q_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.read_members(V.archive_members(spark, sf_dir))
    return m.select("submission_id", "archive", "path", A.detect_language("path").alias("language"))


# --- P7 ---------------------------------------------------------------------
@register("p7_upload_summary", f"""
WITH a AS ({admit_sql()}),
t AS (SELECT submission_id, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(length) AS BIGINT) AS total_bytes,
             CAST(count(*) FILTER (WHERE reason IS NOT NULL) AS BIGINT) AS n_skipped FROM a GROUP BY submission_id),
s AS (SELECT submission_id, path, row_number() OVER (PARTITION BY submission_id ORDER BY path) AS rn FROM a WHERE reason IS NOT NULL),
p AS (SELECT submission_id, string_agg('''' || path || '''', ', ' ORDER BY path) AS pv FROM s WHERE rn <= 8 GROUP BY submission_id)
SELECT submission_id, n_files, total_bytes, n_skipped,
       CASE WHEN n_skipped > 8 THEN coalesce(pv, '') || '...' ELSE coalesce(pv, '') END AS skipped_preview
FROM t LEFT JOIN p USING (submission_id)""")
def q_upload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = admitted(spark, sf_dir).withColumn("accepted", F.col("reason").isNull())
    return R.upload_summary(a, "submission_id", "path", "length", "accepted")
