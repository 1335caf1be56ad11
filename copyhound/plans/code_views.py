"""Code views: source files printed from `part` rows with plain SQL expressions that
Spark and DuckDB evaluate identically. The test tables hold prose only, so every
code operator is exercised on these views (one file per part row and language)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound.sources.tables import read_table, spread

NL = "chr(10)"
ID = "replace(p_name, ' ', '_')"

VIEW_SQL = {
    "python": (
        f"concat('# part ', p_partkey, {NL}, 'import math', {NL}, 'class C', p_partkey % 9, ':', {NL}, "
        f"'    def ', {ID}, '(self, a):', {NL}, '        total = a + ', p_size, '  # add', {NL}, "
        f"'        if total > ', p_partkey % 7, ':', {NL}, '            return total', {NL}, "
        f"'        return a', {NL}, 'def use_', {ID}, '(x):', {NL}, '    for i in range(x):', {NL}, "
        f"'        x = x * ', p_size, {NL}, '    return x', {NL})"
    ),
    "javascript": (
        f"concat('// part ', p_partkey, {NL}, 'function ', {ID}, '(a, b) {{', {NL}, "
        f"'  if (a > ', p_size, ') {{ return b; }}', {NL}, '  return a;', {NL}, '}}', {NL}, "
        f"'const arrow_', {ID}, ' = (x) => x + ', p_size, ';', {NL}, 'class K', p_partkey % 5, ' extends Base {{', {NL}, "
        f"'  run(n) {{ return n; }}', {NL}, '}}', {NL}, '/* end', {NL}, ' of file */', {NL})"
    ),
    "java": (
        f"concat('/* part ', p_partkey, ' */', {NL}, 'public class ', "
        f"CASE WHEN p_size % 4 = 0 THEN 'Main' ELSE 'Box' END, ' {{', {NL}, "
        f"'  public int ', {ID}, '(int a) {{', {NL}, '    int t = a;', {NL}, '    t = t + ', p_size, ';', {NL}, "
        f"'    t = t * 2;', {NL}, '    helper.call(t);', {NL}, '  }}', {NL}, "
        f"'  public int getSize() {{ return ', p_size, '; }}', {NL}, '}}', {NL})"
    ),
    "c": (
        f"concat('#include <stdio.h>', {NL}, 'static int ', {ID}, '(int a) {{', {NL}, "
        f"'  while (a > ', p_size, ') {{ a--; }}', {NL}, '  return a;', {NL}, '}}', {NL}, "
        f"'int main() {{ return 0; }}', {NL})"
    ),
    "go": (
        f"concat('package p', {NL}, {NL}, 'func ', {ID}, '(a int) int {{', {NL}, '  if a > ', p_size, ' {{', {NL}, "
        f"'    return a', {NL}, '  }}', {NL}, '  return ', p_partkey % 7, {NL}, '}}', {NL}, {NL}, "
        f"'// tail', {NL}, 'x := 1', {NL}, 'y := 2', {NL}, 'z := 3')"
    ),
}

EXT = {"python": ".py", "javascript": ".js", "java": ".java", "c": ".c", "go": ".go"}
LANGS = list(VIEW_SQL)

# Files view for admission (F1-F5, F10, S2, S7, P7): submission, path, size, text, and whether its bytes are UTF-8.
# Every rule has rows that trigger it: sizes on both sides of the limit, over-long lines, tagged calls, bytes that aren't
# text, unknown and dot names, and archives.
FILES_PATH_SQL = (
    f"concat('dir/', CASE WHEN p_partkey % 11 = 0 THEN '.' ELSE '' END, {ID}, '_', p_partkey, "
    "CASE p_partkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.JS' WHEN 2 THEN '.java' WHEN 3 THEN '.h' "
    "WHEN 4 THEN '.txt' WHEN 5 THEN '' WHEN 6 THEN '.zip' ELSE '.cpp' END)"
)
FILES_SUB_SQL = "concat('sub', p_partkey % 50)"
FILES_LEN_SQL = "CAST(p_size * 63500 AS BIGINT)"
LONG_LINE = 100001
FILES_TEXT_SQL = (
    "CASE WHEN p_partkey % 97 = 3 THEN repeat('x', " + str(LONG_LINE) + ") WHEN p_partkey % 13 = 0 THEN concat({python}, 'eval (x)') ELSE "
    "CASE p_partkey % 8 WHEN 1 THEN {javascript} WHEN 2 THEN {java} WHEN 3 THEN {c} WHEN 7 THEN {c} ELSE {python} END END"
).format(**VIEW_SQL)
FILES_IS_TEXT_SQL = "p_partkey % 29 <> 1"
# The members of an archive of the files view: (suffix of the path, is text).
MEMBERS = [("/src/", True), ("/.hidden.py", True), ("/m.py", True), ("/readme.md", True), ("/raw.py", False)]


def code_files(spark: SparkSession, sf_dir: str, langs=None) -> DataFrame:
    """One row per (part, language): file_id, path, language, code."""
    p = spread(read_table(spark, sf_dir, "part"), "p_partkey", always=True)
    frames = []
    for lang in (langs or LANGS):
        frames.append(p.selectExpr(
            f"concat('{lang}/', p_partkey, '{EXT[lang]}') AS path",
            f"'{lang}' AS language",
            f"{VIEW_SQL[lang]} AS code",
            "p_partkey",
        ))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def code_files_sql(langs=None) -> str:
    parts = []
    for lang in (langs or LANGS):
        parts.append(
            f"SELECT concat('{lang}/', p_partkey, '{EXT[lang]}') AS path, '{lang}' AS language, "
            f"{VIEW_SQL[lang]} AS code, p_partkey FROM part")
    return "(" + " UNION ALL ".join(parts) + ")"


NOT_TEXT = "caf\u00e9"  # its Latin-1 bytes aren't UTF-8


def _bytes(is_text: str, text: str):
    """The bytes of a file: UTF-8 text, or Latin-1 bytes that aren't."""
    return F.when(F.expr(is_text), F.encode(F.expr(text), "UTF-8")).otherwise(F.encode(F.lit(NOT_TEXT), "ISO-8859-1"))


def upload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files view: submission_id, path, length, text, content (its bytes)."""
    p = spread(read_table(spark, sf_dir, "part"), "p_partkey", always=True).withColumn("content", _bytes(FILES_IS_TEXT_SQL, FILES_TEXT_SQL))
    return p.selectExpr(f"{FILES_SUB_SQL} AS submission_id", f"{FILES_PATH_SQL} AS path",
                        f"{FILES_LEN_SQL} AS length", f"{FILES_TEXT_SQL} AS text", "content")


def upload_files_sql() -> str:
    return (f"(SELECT {FILES_SUB_SQL} AS submission_id, {FILES_PATH_SQL} AS path, "
            f"{FILES_LEN_SQL} AS length, {FILES_TEXT_SQL} AS text, {FILES_IS_TEXT_SQL} AS is_text FROM part)")


def archive_members(spark: SparkSession, sf_dir: str, uploads: DataFrame | None = None) -> DataFrame:
    """What the archives of the files view (or of ``uploads``, the view as it was stored) hold, already unpacked:
    submission_id, archive, path, length, text, content."""
    files = upload_files(spark, sf_dir) if uploads is None else uploads
    z = files.where("path LIKE '%.zip'").withColumnRenamed("path", "archive")
    member = F.explode(F.array(*[F.struct(F.lit(x).alias("suffix"), F.lit(t).alias("is_text")) for x, t in MEMBERS])).alias("m")
    z = z.select("submission_id", "archive", "length", "text", member)
    return z.select("submission_id", "archive", F.concat("archive", "m.suffix").alias("path"), "length", "text",
                    _bytes("m.is_text", "text").alias("content"))


def archive_members_sql() -> str:
    rows = ", ".join(f"('{x}', {str(t).lower()})" for x, t in MEMBERS)
    return (f"(SELECT submission_id, path AS archive, concat(path, suffix) AS path, length, text, m.is_text FROM {upload_files_sql()} f, "
            f"(VALUES {rows}) m(suffix, is_text) WHERE path LIKE '%.zip')")
