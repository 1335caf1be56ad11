"""Block queries over the code views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.functions import text as T
from copyhound.operators import blocks as B
from copyhound.plans import code_views as V
from copyhound.plans.catalog import register
from copyhound.session import kept, shuffled
from copyhound.sources.tables import spread
from copyhound.plans.normalization import strip_comments_sql

REGEX_LANGS = V.LANGS


def _q(p: str) -> str:
    return p.replace("'", "''")


def nl_sql(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{T.WHITE}+|{T.WHITE}+$', '', 'g')"


def regex_blocks_sql(src: str, pattern: str, block_type: str, place: int = 0, keep: str = "true") -> str:
    """Rows (path, language, block_type, name, raw, code, line_start, ord) of every match."""
    p = _q(pattern)
    return f"""
SELECT path, language, '{block_type}' AS block_type, m1[i] AS name, m0[i] AS raw, {strip_sql('m0[i]')} AS code,
       CAST(1 + coalesce(list_sum(pn[1:i]), 0) + coalesce(list_sum(mn[1:i - 1]), 0) AS INTEGER) AS line_start,
       {place} AS o1, i AS o2, 0 AS o3
FROM (SELECT path, language, regexp_extract_all(clean, '{p}', 0) AS m0, regexp_extract_all(clean, '{p}', 1) AS m1,
             list_transform(regexp_split_to_array(clean, '{p}'), lambda s: {nl_sql('s')}) AS pn,
             list_transform(regexp_extract_all(clean, '{p}', 0), lambda s: {nl_sql('s')}) AS mn
      FROM {src}) m, range(1, len(m0) + 1) t(i)
WHERE {keep}"""


def java_boiler_sql(name: str, raw: str) -> str:
    short = f"len(string_split({raw}, chr(10))) < 5"
    return (f"(regexp_matches({name}, '{C.JAVA_BOILERPLATE_NAME}') OR (contains({raw}, 'return') AND {short}) "
            f"OR (contains({raw}, 'this.') AND contains({raw}, '=') AND {short}))")


def generic_blocks_sql(src: str) -> str:
    lines = f"list_transform(string_split(clean, chr(10)), lambda l: {strip_sql('l')} || chr(10))"
    return f"""
SELECT path, language, 'code_block' AS block_type, 'block_' || CAST(i - 1 AS VARCHAR) AS name, kept[i] AS raw,
       kept[i] AS code, CAST(i AS INTEGER) AS line_start, 0 AS o1, i AS o2, 0 AS o3
FROM (SELECT path, language, list_filter(list_transform(pc[1:len(pc) - 1], lambda p: regexp_replace(p, '^\\n+', '')),
                                   lambda r: r <> '' AND len(string_split(r, chr(10))) > 2) AS kept
      FROM (SELECT path, language, regexp_split_to_array(array_to_string({lines}, ''), '\\n\\n+') AS pc FROM {src}) x) k, range(1, len(kept) + 1) t(i)"""


def python_blocks_sql(src: str) -> str:
    """Rows of every Python block: the same running values over (file, indentation level) as SQL windows."""
    return f"""
WITH files AS {src},
lines AS (
  SELECT path, i, length(regexp_extract(t, '^[ \\t]*', 0)) AS ind, regexp_extract(t, '{B.PY_DEF}', 1) AS def, regexp_extract(t, '{B.PY_CLASS}', 1) AS cls,
    regexp_extract(t, '{B.PY_LOGIC}', 1) AS logic, regexp_extract(t, '{B.PY_LOGIC}', 1) = 'elif' OR regexp_matches(t, '{B.PY_ELSE}') AS part,
    CAST(regexp_matches(t, '{B.PY_EXCEPT}') AS INTEGER) AS exc
  FROM (SELECT path, i - 1 AS i, ls[i] AS t FROM (SELECT path, string_split(clean, chr(10)) AS ls FROM files) f, range(1, len(ls) + 1) r(i)) x
  WHERE regexp_matches(t, '[^{T.WHITE[1:]}')),
at0 AS (
  SELECT l.*, v.level, ind <= level AS near, ind = level AS same, ind <= level AND NOT (ind = level AND part) AS start,
    sum(CASE WHEN ind = level AND logic = 'elif' THEN 1 ELSE 0 END) OVER (PARTITION BY path, level ORDER BY i) AS elifs
  FROM lines l JOIN (SELECT DISTINCT path, ind AS level FROM lines) v USING (path)
  WHERE ind <= level OR def <> '' OR cls <> '' OR logic <> ''),
at1 AS (SELECT *, elifs - coalesce(last_value(CASE WHEN start THEN elifs END IGNORE NULLS) OVER (PARTITION BY path, level ORDER BY i), 0) AS chain FROM at0),
at2 AS (
  SELECT *, last_value(CASE WHEN near THEN {{'ind': ind, 'more': CASE WHEN part THEN chain ELSE 0 END + exc}} END IGNORE NULLS) OVER b AS anchor,
    last_value(CASE WHEN ind < level THEN {{'cls': cls, 'line': i}} END IGNORE NULLS) OVER b AS parent,
    min(CASE WHEN near THEN i END) OVER a AS next_any, min(CASE WHEN start THEN i END) OVER a AS next_start
  FROM at1
  WINDOW b AS (PARTITION BY path, level ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY path, level ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
heads AS (
  SELECT path, i, max(ind) AS ind, max(def) AS def, max(cls) AS cls, max(logic) AS logic,
    sum(CASE WHEN same THEN CASE WHEN logic = 'elif' THEN chain ELSE 0 END WHEN ind > level AND anchor.ind = level THEN 1 + anchor.more ELSE 0 END) AS depth,
    max(CASE WHEN same THEN CASE WHEN logic <> '' THEN next_start ELSE next_any END END) AS stop,
    max(CASE WHEN same THEN parent.cls END) AS owner, max(CASE WHEN same THEN parent.line END) AS owner_i
  FROM at2 WHERE def <> '' OR cls <> '' OR logic <> '' GROUP BY path, i),
named AS (
  SELECT path, i, ind, stop, CASE WHEN def <> '' THEN 'function' ELSE 'logic' END AS block_type,
    CASE WHEN def <> '' THEN def ELSE 'logic_block_' || CAST(i + 1 AS VARCHAR) END AS name, depth AS o1, i AS o2, 0 AS o3
  FROM heads WHERE def <> '' OR logic <> ''
  UNION ALL
  SELECT h.path, h.i, h.ind, h.stop, 'method', h.owner || '.' || h.def, c.depth, c.i, h.i + 1
  FROM heads h JOIN heads c ON c.path = h.path AND c.i = h.owner_i WHERE h.def <> '' AND c.cls <> '')
SELECT n.path, 'python' AS language, block_type, name, '' AS raw,
  regexp_replace(array_to_string(list_transform(string_split(clean, chr(10))[i + 1:coalesce(stop, len(string_split(clean, chr(10))))],
    lambda l: CASE WHEN length(l) >= ind THEN substring(l, ind + 1) ELSE ltrim(l, ' ') END), chr(10)), '\\s+$', '') AS code,
  CAST(i + 1 AS INTEGER) AS line_start, o1, o2, o3
FROM named n JOIN files USING (path)"""


def complexity_sql(x: str) -> str:
    return "(1 + " + " + ".join(f"len(regexp_extract_all({x}, '(?i)\\b{w}\\b', 0))" for w in C.COMPLEXITY_WORDS) + ")"


def blocks_sql(langs=REGEX_LANGS, files: str | None = None) -> str:
    """Blocks of the code views, or of ``files`` (path, language, code)."""
    src = (f"(SELECT path, language, {strip_comments_sql('code', 'language')} AS clean "
           f"FROM {files or V.code_files_sql(langs)} c)")
    parts = []
    for lang, sub in (("python", f"(SELECT path, language, clean FROM {src} s WHERE language = 'python')"),
                      ("javascript", f"(SELECT * FROM {src} s WHERE language IN ('javascript', 'typescript'))"),
                      ("java", f"(SELECT * FROM {src} s WHERE language = 'java')"),
                      ("c", f"(SELECT * FROM {src} s WHERE language IN ('c', 'cpp'))"),
                      ("generic", f"(SELECT * FROM {src} s WHERE language NOT IN "
                                  "('python', 'javascript', 'typescript', 'java', 'c', 'cpp', 'csharp'))")):
        if lang == "python":
            parts.append(python_blocks_sql(sub))
        elif lang == "javascript":
            parts += [regex_blocks_sql(sub, B.JS_FUNCTION, "function"),
                      regex_blocks_sql(sub, B.JS_ARROW, "arrow_function", 1)]
        elif lang == "java":
            parts += [regex_blocks_sql(sub, B.JAVA_METHOD, "method", keep=f"NOT {java_boiler_sql('m1[i]', 'm0[i]')}"),
                      regex_blocks_sql(sub, B.JAVA_CLASS, "class", 1,
                                       keep="m1[i] NOT IN (" + ", ".join(f"'{x}'" for x in C.JAVA_BOILERPLATE_CLASSES) + ")")]
        elif lang == "c":
            parts += [regex_blocks_sql(sub, B.C_FUNCTION_RE2, "function",
                                       keep="m1[i] NOT IN ('main', 'printf', 'scanf') AND NOT starts_with(m1[i], '_')"),
                      regex_blocks_sql(sub, B.CPP_CLASS, "class", 1)]
        else:
            parts.append(generic_blocks_sql(sub))
    u = " UNION ALL ".join(f"({p})" for p in parts)
    return f"""
WITH u AS ({u}),
b AS (SELECT path, language, block_type, name, code, line_start,
             CAST(row_number() OVER (PARTITION BY path ORDER BY o1, o2, o3) - 1 AS INTEGER) AS block_id,
             CAST({complexity_sql('code')} AS INTEGER) AS complexity FROM u)
SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY complexity DESC, block_id) AS INTEGER) AS block_rank FROM b"""


def spark_blocks(spark: SparkSession, sf_dir: str, langs=REGEX_LANGS) -> DataFrame:
    return B.block_rows(V.code_files(spark, sf_dir, langs), ["path"])


BLOCK_COLS = ["path", "language", "block_type", "name", "code", "line_start", "block_id", "complexity", "block_rank"]


@register("b1_extract_blocks", blocks_sql())
def q_b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_blocks(spark, sf_dir).select(*BLOCK_COLS)


for _name, _langs in (("b2_blocks_python", ["python"]), ("b3_blocks_js", ["javascript"]), ("b4_blocks_java", ["java"]), ("b5_blocks_c", ["c"]),
                      ("b7_blocks_generic", ["go"])):
    register(_name, f"SELECT * FROM ({blocks_sql()}) x WHERE language IN ("
             + ", ".join(f"'{x}'" for x in _langs) + ")")(
        (lambda langs: lambda s, d: spark_blocks(s, d, langs).select(*BLOCK_COLS))(_langs))


@register("b6_blocks_csharp", "SELECT path, name, code, CAST(line_start AS INTEGER) AS line_start FROM ("
          + regex_blocks_sql(f"(SELECT path, 'csharp' AS language, {strip_comments_sql('code', chr(39) + 'csharp' + chr(39))} AS clean "
                             f"FROM {V.code_files_sql(['java'])} c)", B.CSHARP_METHOD, "method",
                             keep=f"NOT regexp_matches(m1[i], '{C.CSHARP_BOILERPLATE_NAME}')") + ") x")
def q_b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C# extraction run over the Java view (same brace syntax; no C# table exists)."""
    c = V.code_files(spark, sf_dir, ["java"])
    ex = c.select("path", F.explode(B.blocks_csharp(T.strip_comments("code", F.lit("csharp")))).alias("b"))
    return ex.select("path", "b.name", "b.code", "b.line_start")


def placed_sql(name: str, src: str, pattern: str) -> str:
    """CTE of a pattern's matches and where they begin."""
    p = _q(pattern)
    return f"""{name} AS (SELECT path, k, m, CAST(sum(length(gap) + length(m)) OVER w AS BIGINT) - length(m) AS start, CAST(sum(length(gap) + length(m)) OVER w AS BIGINT) AS stop,
  1 + sum({nl_sql('gap')} + {nl_sql('m')}) OVER w - {nl_sql('m')} AS line_start
  FROM (SELECT path, k, regexp_split_to_array(clean, '{p}')[k] AS gap, regexp_extract_all(clean, '{p}', 0)[k] AS m
        FROM {src} s, range(1, len(regexp_extract_all(clean, '{p}', 0)) + 1) r(k)) WINDOW w AS (PARTITION BY path ORDER BY k))"""


def balanced_sql() -> str:
    ctes, heads = [], []
    for language, kinds in B.BALANCED_HEADS.items():
        for kind, pattern in kinds:
            name = f"h_{language}_{kind}"
            ctes.append(placed_sql(name, f"(SELECT * FROM f WHERE language = '{language}')", pattern))
            heads.append(f"SELECT path, '{kind}' AS block_type, regexp_extract(m, '{_q(pattern)}', 1) AS name, start, stop - 1 AS brace, line_start FROM {name}")
    words = ", ".join(f"'{w}'" for w in B.CONTROL_WORDS)
    return f"""
WITH f AS (SELECT path, language, {strip_comments_sql('code', 'language')} AS clean FROM {V.code_files_sql(list(B.BALANCED_HEADS))} c),
{placed_sql('br', 'f', '[{}]')},
dp AS (SELECT *, sum(CASE WHEN m = '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY k) + CASE WHEN m = '{{' THEN 0 ELSE 1 END AS level FROM br),
cl AS (SELECT path, m, start AS brace, level, lead(start) OVER (PARTITION BY path, level ORDER BY k) AS closed FROM dp),
{", ".join(ctes)},
hd AS ({" UNION ALL ".join(heads)}),
fd AS (SELECT hd.*, closed, level FROM hd JOIN cl USING (path, brace) WHERE m = '{{' AND closed IS NOT NULL AND name NOT IN ({words})),
ow AS (SELECT a.*, c.name AS owner FROM fd a LEFT JOIN fd c ON c.path = a.path AND c.block_type = 'class' AND a.level = c.level + 1 AND a.brace > c.brace AND a.brace < c.closed)
SELECT path, block_type, CASE WHEN block_type = 'method' THEN owner || '.' || name ELSE name END AS name, CAST(line_start AS INTEGER) AS line_start,
  substring(clean, start + 1, closed - start + 1) AS code
FROM ow JOIN f USING (path) WHERE (block_type <> 'method' OR owner IS NOT NULL) AND (block_type <> 'function' OR owner IS NULL)"""


@register("b9_blocks_balanced", balanced_sql())
def q_b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.code_files(spark, sf_dir, list(B.BALANCED_HEADS)).select("path", "language", T.strip_comments("code", "language").alias("clean"))
    # the languages cost differently, so a stored file holds some of each
    return B.balanced_blocks(kept(spread(f, "path", always=True), "cleaned"), ["path"], keep=kept)


@register("b8_blocks_fallback", f"""
SELECT path, array_to_string(list_filter(string_split(code, chr(10)), lambda l: {strip_sql('l')} <> '' AND NOT ("""
          + " OR ".join(f"starts_with({strip_sql('l')}, '{p}')" for p in C.FALLBACK_SKIP_PREFIXES)
          + f""")), chr(10)) AS fallback FROM {V.code_files_sql()} c""")
def q_b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.code_files(spark, sf_dir)
    return c.select("path", B.fallback_block("code").alias("fallback"))


@register("b10_java_boilerplate", f"""
SELECT path, m1[i] AS name, {java_boiler_sql('m1[i]', 'm0[i]')} AS boilerplate
FROM (SELECT path, regexp_extract_all(clean, '{_q(B.JAVA_METHOD)}', 0) AS m0, regexp_extract_all(clean, '{_q(B.JAVA_METHOD)}', 1) AS m1
      FROM (SELECT path, {strip_comments_sql('code', "'java'")} AS clean FROM {V.code_files_sql(['java'])} c) s) m,
     range(1, len(m0) + 1) t(i)""")
def q_b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.code_files(spark, sf_dir, ["java"]).select("path", T.strip_comments("code", F.lit("java")).alias("clean"))
    m = c.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("clean", F.lit(B.JVM_FORM[B.JAVA_METHOD]), F.lit(0)).alias("raw"),
                                                F.regexp_extract_all("clean", F.lit(B.JVM_FORM[B.JAVA_METHOD]), F.lit(1)).alias("name")))
                 .alias("z"))
    return m.select("path", F.col("z.name").alias("name"),
                    B.java_boilerplate(F.col("z.name"), F.col("z.raw")).alias("boilerplate"))


@register("b11_csharp_boilerplate", f"""
SELECT path, m1 AS name, regexp_matches(m1, '{C.CSHARP_BOILERPLATE_NAME}') AS boilerplate
FROM (SELECT path, unnest(regexp_extract_all(code, '{_q(B.CSHARP_METHOD)}', 1)) AS m1 FROM {V.code_files_sql(['java'])} c) s""")
def q_b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.code_files(spark, sf_dir, ["java"])
    m = c.select("path", F.explode(F.regexp_extract_all("code", F.lit(B.JVM_FORM[B.CSHARP_METHOD]), F.lit(1))).alias("name"))
    return m.select("path", "name", B.csharp_boilerplate("name").alias("boilerplate"))


@register("b12_complexity", f"SELECT path, CAST({complexity_sql('code')} AS INTEGER) AS complexity FROM {V.code_files_sql()} c")
def q_b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.code_files(spark, sf_dir).select("path", T.complexity("code").alias("complexity"))


@register("b13_rank_blocks", f"SELECT path, block_id, block_rank FROM ({blocks_sql()}) x")
def q_b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_blocks(spark, sf_dir).select("path", "block_id", "block_rank")


def summary_sql() -> str:
    return f"""
WITH b AS ({blocks_sql()}), f AS (SELECT path FROM {V.code_files_sql(REGEX_LANGS)} c),
g AS (SELECT path, count(*) AS n, sum({nl_sql('code')} + 1) AS lines, sum(complexity) AS cx,
             array_to_string(list_sort(list_distinct(list(block_type))), ',') AS types FROM b GROUP BY path)
SELECT f.path, CAST(coalesce(n, 0) AS BIGINT) AS total_blocks, CAST(coalesce(lines, 0) AS BIGINT) AS total_core_lines,
       coalesce(cx, 0) / greatest(coalesce(n, 0), 1) AS average_complexity, coalesce(types, '') AS block_types
FROM f LEFT JOIN g USING (path)"""


@register("b14_extraction_summary", summary_sql())
def q_b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.code_files(spark, sf_dir, REGEX_LANGS)
    return B.extraction_summary(f, B.block_rows(f, ["path"]), ["path"])


@register("b15_noise_reduction", f"""
WITH s AS ({summary_sql()}), f AS (SELECT path, language, len(string_split(code, chr(10))) AS total_lines FROM {V.code_files_sql(REGEX_LANGS)} c)
SELECT coalesce(language, 'overall') AS scope, CAST(sum(total_core_lines) AS BIGINT) AS core_lines,
       CAST(sum(total_lines) AS BIGINT) AS total_lines, 1 - sum(total_core_lines) / sum(total_lines) AS noise_reduction
FROM s JOIN f USING (path) GROUP BY ROLLUP (language)""")
def q_b15(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.code_files(spark, sf_dir, REGEX_LANGS)
    s = B.extraction_summary(f, B.block_rows(f, ["path"]), ["path"])
    t = f.select("path", "language", F.size(F.split("code", "\n")).alias("total_lines"))
    g = s.join(shuffled(t), "path").rollup("language").agg(F.sum("total_core_lines").cast("long").alias("core_lines"),
                                                 F.sum("total_lines").cast("long").alias("total_lines"))
    return g.select(F.coalesce("language", F.lit("overall")).alias("scope"), "core_lines", "total_lines",
                    (1 - F.col("core_lines") / F.col("total_lines")).alias("noise_reduction"))


def key_lines_sql(x: str) -> str:
    cond = " OR ".join(f"starts_with(s, '{p}')" for p in C.SUMMARY_SKIP_PREFIXES)
    return (f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip_sql('l')}), "
            f"lambda s: s <> '' AND NOT ({cond}))")


def core_summary_sql(files: str | None = None) -> str:
    return f"""
WITH b AS ({blocks_sql(files=files)}),
t AS (SELECT path, block_rank, {key_lines_sql('code')}[1:{C.SUMMARY_LINES_PER_BLOCK}] AS kl FROM b WHERE block_rank <= {C.SUMMARY_BLOCKS})
SELECT path, array_to_string(flatten(list(kl ORDER BY block_rank))[1:{C.SUMMARY_MAX_LINES}], chr(10)) AS summary FROM t GROUP BY path"""


@register("b16_core_summary", core_summary_sql())
def q_b16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.core_summary(spark_blocks(spark, sf_dir), ["path"])


@register("p9_blocks_analyzed", f"""
WITH b AS ({blocks_sql()})
SELECT path, CAST(count(*) AS BIGINT) AS total_blocks_analyzed,
       CAST(count(*) FILTER (WHERE block_rank <= {C.MAX_BLOCKS_PER_FILE}) AS BIGINT) AS blocks_processed,
       CAST(sum({nl_sql('code')} + 1) AS BIGINT) AS core_lines FROM b GROUP BY path""")
def q_p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark_blocks(spark, sf_dir)
    return b.groupBy("path").agg(
        F.count(F.lit(1)).cast("long").alias("total_blocks_analyzed"),
        F.count(F.when(F.col("block_rank") <= C.MAX_BLOCKS_PER_FILE, 1)).cast("long").alias("blocks_processed"),
        F.sum(B.newlines("code") + 1).cast("long").alias("core_lines"))
