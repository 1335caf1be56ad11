"""Admission: extension allow-list, language, size guard, content checks."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.functions.text import _c


# --- helpers ----------------------------------------------------------------
def basename(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def last_ext(path) -> Column:
    """'.' + lower-cased text after the last '.' of the whole name ('' without a dot)."""
    p = _c(path)
    return F.when(p.contains("."), F.concat(F.lit("."), F.lower(F.regexp_extract(p, r"\.([^.]*)$", 1)))) \
        .otherwise(F.lit(""))


def split_ext(path) -> Column:
    """Extension as ``os.path.splitext`` gives it: last dot of the base name that
    comes after its first non-dot character; lower-cased."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def _first_wins():
    seen = {}
    for ext, lang, prio, searchable in C.language_rows():
        seen.setdefault(ext, (lang, prio, searchable))
    return seen


def language_map() -> Column:
    """ext -> language literal map (first registry entry wins: '.h' is c)."""
    m = _first_wins()
    return F.create_map(*chain.from_iterable((F.lit(e), F.lit(v[0])) for e, v in m.items()))


# --- F1 ---------------------------------------------------------------------
def allowed_ext(path) -> Column:
    return last_ext(path).isin(C.allowed_extensions())


# --- F2 ---------------------------------------------------------------------
def detect_language(path) -> Column:
    p = _c(path)
    return F.when(p.contains("."), F.element_at(language_map(), split_ext(p)))


def searchable(language) -> Column:
    return _c(language).isin(C.SEARCHABLE_LANGUAGES)


# --- F3 ---------------------------------------------------------------------
def oversize_submissions(files: DataFrame, group_col: str = "submission_id",
                         size_col: str = "length", max_bytes: int = C.MAX_UPLOAD_BYTES) -> DataFrame:
    """Submissions holding any file strictly larger than ``max_bytes`` (one row each;
    a map-side partial max keeps a hot submission cheap)."""
    return (files.groupBy(group_col).agg(F.max(size_col).alias("_max"))
            .where(F.col("_max") > max_bytes).select(group_col))


def size_guard(files: DataFrame, group_col: str = "submission_id", size_col: str = "length",
               max_bytes: int = C.MAX_UPLOAD_BYTES) -> DataFrame:
    """Adds ``blocked``: true for every file of a submission with an oversize file."""
    bad = oversize_submissions(files, group_col, size_col, max_bytes).withColumn("blocked", F.lit(True))
    return (files.join(bad, group_col, "left")
            .withColumn("blocked", F.coalesce(F.col("blocked"), F.lit(False))))


# --- F4 ---------------------------------------------------------------------
def long_line(text, max_line: int = C.MAX_LINE_CHARS) -> Column:
    return F.exists(F.split(_c(text), "\n"), lambda l: F.length(l) > max_line)


def valid_content(text, max_line: int = C.MAX_LINE_CHARS, max_chars: int = C.MAX_CONTENT_CHARS) -> Column:
    t = _c(text)
    return ~long_line(t, max_line) & (F.length(t) <= max_chars)


# --- F5 ---------------------------------------------------------------------
def suspicious_tags(text) -> Column:
    """Comma-joined names of the informational patterns found (case-insensitive)."""
    t = _c(text)
    return F.concat_ws(",", *[F.when(t.rlike("(?i)" + p), F.lit(name)) for name, p in C.SUSPICIOUS_PATTERNS])


# --- F8 ---------------------------------------------------------------------
def url_allowed(url) -> Column:
    u = F.lower(_c(url))
    bad = None
    for x in C.URL_BLOCKLIST:
        c = u.contains(x)
        bad = c if bad is None else (bad | c)
    return ~bad


# --- S1 ---------------------------------------------------------------------
def decode_text(content) -> Column:
    """UTF-8 when valid, else Latin-1 (every byte sequence decodes)."""
    b = _c(content)
    return F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")) \
        .otherwise(F.decode(b, "ISO-8859-1"))


def encoding(content) -> Column:
    return F.when(F.is_valid_utf8(_c(content).cast("string")), F.lit("utf-8")).otherwise(F.lit("latin-1"))


#: Spark lists directories in up to so many tasks; its default of 10,000 makes nearly each of a wide tree's a task of its own.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def listed(spark: SparkSession, load: Callable[[], DataFrame]) -> DataFrame:
    """``load()``, which lists a tree, with four listing tasks for each core; the session's setting holds again after it."""
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return load()
    finally:
        spark.conf.set(LISTING_TASKS, before)


def read_files(spark: SparkSession, root: str, pattern: str | None = None, strict_utf8: bool = False) -> DataFrame:
    """Path (below root), length, encoding, text of the files of a tree, all levels; ``pattern`` is a glob over base names.

    ``strict_utf8`` leaves out files that aren't UTF-8, as archive members are; else they are read as Latin-1. A query that
    doesn't ask for text or encoding never opens the files. Empty files aren't listed: Spark's reader leaves them out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader if pattern is None else reader.option("pathGlobFilter", pattern)
    files = listed(spark, lambda: reader.load(root))
    files = files.where(is_utf8("content")) if strict_utf8 else files
    inside = "/" + root.rstrip("/").split(":", 1)[-1].strip("/") + "/"  # without a scheme, which a path may have or not
    below = F.substr("path", F.instr("path", F.lit(inside)) + len(inside), F.length("path"))
    return files.select(below.alias("path"), "length", encoding("content").alias("encoding"), decode_text("content").alias("text"))


# --- S2 ---------------------------------------------------------------------
def read_members(members: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Archive members that are read at all: no directories, no hidden base names, UTF-8 bytes only."""
    p = F.col(path_col)
    keep = (~p.endswith("/")) & (~basename(p).startswith(".")) & is_utf8(content_col)
    return members.where(keep)


def is_utf8(content) -> Column:
    return F.is_valid_utf8(_c(content).cast("string"))


# --- F10 --------------------------------------------------------------------
def admit(files: DataFrame, members: DataFrame | None = None, group_col: str = "submission_id", path_col: str = "path",
          size_col: str = "length", text_col: str = "text", content_col: str = "content") -> DataFrame:
    """Every file with ``language`` and ``reason`` (null when admitted), checks in the route's order: a submission with
    an oversize file, extension, bytes that aren't text, language, content. ``archive`` is null for a file of its own.

    An archive isn't checked as code: its members (``archive`` = its path), read by S2's rules, take its place, and only
    an archive of which nothing is read stays as a row (empty_archive). Members aren't size-checked on their own."""
    bad = oversize_submissions(files, group_col, size_col)
    ext, lang = last_ext(path_col), detect_language(path_col)
    is_archive = ext == C.ARCHIVE_EXTENSION
    own = files.where(~is_archive | F.lit(members is None)).withColumn("archive", F.lit(None).cast("string"))
    rows = own.withColumn("empty", F.lit(False))
    if members is not None:
        read = read_members(members, path_col, content_col)
        empty = files.where(is_archive).join(read.select(group_col, F.col("archive").alias(path_col)).distinct(), [group_col, path_col], "left_anti")
        rows = rows.unionByName(empty.withColumn("archive", F.lit(None).cast("string")).withColumn("empty", F.lit(True)))
        rows = rows.unionByName(read.withColumn("empty", F.lit(False)))
    rows = rows.join(bad.withColumn("blocked", F.lit(True)), group_col, "left")
    reason = (F.when(F.col("blocked"), F.lit("oversize_submission"))
              .when(F.col("empty"), F.lit("empty_archive"))
              .when(~allowed_ext(path_col), F.lit("unsupported_type"))
              .when(F.col("archive").isNull() & ~is_utf8(content_col), F.lit("not_text"))
              .when(lang.isNull(), F.lit("no_language"))
              .when(~valid_content(text_col), F.lit("bad_content")))
    return rows.select(group_col, "archive", path_col, size_col, text_col, lang.alias("language"), reason.alias("reason"),
                       suspicious_tags(text_col).alias("tags"))
