"""Search terms (T1-T6): native regex extraction per language, then selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.functions import text as T
from copyhound.session import shuffled

_ID = r"[a-zA-Z_][a-zA-Z0-9_]*"
_JSID = r"[a-zA-Z_$][a-zA-Z0-9_$]*"

# FIXED VALUES: term patterns per language
PY_DEF = rf"def\s+({_ID})"
PY_CLASS = rf"class\s+({_ID})"
PY_IMPORT = r"(?:from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+)?import\s+([a-zA-Z_][a-zA-Z0-9_.,\s]*)"
CALL = r"(\w+)\.(\w+)\s*\("
PY_ASSIGN = rf"({_ID})\s*="
PY_STRING = r"['\"]([a-zA-Z_][a-zA-Z0-9_\s]{3,20})['\"]"
WORD4 = r"\b[a-zA-Z]{4,}\b"
JS_FUNC = rf"function\s+({_JSID})"
JS_CLASS = rf"class\s+({_JSID})"
JS_ARROW = rf"(?:const|let|var)\s+({_JSID})\s*=\s*(?:\([^)]*\)|{_JSID})\s*=>"
JAVA_CLASS = rf"class\s+({_ID})"
JAVA_METHOD = rf"(?:public|private|protected)?\s*(?:static)?\s*(?:\w+\s+)?({_ID})\s*\("


def _all(code: Column, pattern: str, g: int = 1) -> Column:
    return F.regexp_extract_all(code, F.lit(pattern), F.lit(g))


def _calls(code: Column) -> Column:
    objs, meths = _all(code, CALL, 1), _all(code, CALL, 2)
    pairs = F.filter(F.arrays_zip(objs.alias("o"), meths.alias("m")),
                     lambda z: (F.length(z["o"]) > 2) & (F.length(z["m"]) > 2))
    return F.flatten(F.transform(pairs, lambda z: F.array(z["o"], z["m"])))


def terms_python(code) -> Column:
    c = T._c(code)
    froms = F.filter(_all(c, PY_IMPORT, 1), lambda x: x != "")
    imports = F.filter(F.transform(F.flatten(F.transform(_all(c, PY_IMPORT, 2), lambda x: F.split(x, ","))),
                                   lambda x: T.py_strip(x)), lambda x: x != "")
    assigns = F.filter(_all(c, PY_ASSIGN), lambda x: F.length(x) > 2)
    words = F.flatten(F.transform(_all(c, PY_STRING), lambda s: F.regexp_extract_all(s, F.lit(WORD4), F.lit(0))))
    return F.concat(_all(c, PY_DEF), _all(c, PY_CLASS), froms, imports, _calls(c), assigns, words)


def terms_js(code) -> Column:
    c = T._c(code)
    return F.concat(_all(c, JS_FUNC), _all(c, JS_CLASS), _all(c, JS_ARROW), _calls(c))


def terms_java(code) -> Column:
    c = T._c(code)
    return F.concat(_all(c, JAVA_CLASS), _all(c, JAVA_METHOD), _calls(c))


def terms_generic(code) -> Column:
    c = T._c(code)
    parts = [F.filter(_all(c, p), lambda x: x != "") for p in C.GENERIC_TERM_PATTERNS]
    return F.concat(*parts, _calls(c))


def raw_terms(code, language) -> Column:
    lang = T._c(language)
    return (F.when(lang == "python", terms_python(code))
            .when(lang.isin("javascript", "typescript"), terms_js(code))
            .when(lang == "java", terms_java(code))
            .otherwise(terms_generic(code)))


def candidate_terms(code, language) -> Column:
    """T5 before ranking: distinct terms, stop words and terms of <= 2 chars dropped."""
    return F.array_distinct(F.filter(raw_terms(code, language),
                                     lambda t: ~t.isin(C.COMMON_WORDS) & (F.length(t) > 2)))


def select_terms(units: DataFrame, key_cols, code_col: str, lang_col: str, term_df: DataFrame | None = None,
                 n: int | None = None) -> DataFrame:
    """T5: one row per (unit, term) with term_rank 1..n (default: all), rarest in the corpus
    first (terms absent from the corpus last), then alphabetical (deterministic)."""
    t = units.select(*key_cols, lang_col, F.explode(candidate_terms(code_col, lang_col)).alias("term"))
    if term_df is not None:
        t = t.join(shuffled(term_df.select("term", F.col(lang_col), "df")), ["term", lang_col], "left")
        order = [F.coalesce(F.col("df"), F.lit(2 ** 62)).asc(), F.col("term").asc()]
    else:
        order = [F.col("term").asc()]
    w = Window.partitionBy(*key_cols).orderBy(*order)
    out = t.withColumn("term_rank", F.row_number().over(w).cast("int"))
    if n is not None:
        out = out.where(F.col("term_rank") <= n)
    return out.select(*key_cols, lang_col, "term", "term_rank")


# --- T6 ---------------------------------------------------------------------
def query_lines(text, n: int | None = None, n_fallback: int | None = None) -> Column:
    """Lines worth looking up: stripped lines >20 chars not starting with a skip prefix, that carry a keyword or are
    >30 chars, longest first (stable); without any, stripped lines >15 chars in order. ``n`` and ``n_fallback`` keep the
    first ones (the reference's budgets: C.LINE_QUERIES_PER_TEXT, C.FALLBACK_LINE_QUERIES; default: all)."""
    lines = F.transform(F.split(T._c(text), "\n"), lambda l: T.py_strip(l))

    def cand(l):
        skip = None
        for p in C.QUERY_SKIP_PREFIXES:
            c = l.startswith(p)
            skip = c if skip is None else (skip | c)
        kw = None
        for k in C.QUERY_KEYWORDS:
            c = l.contains(k)
            kw = c if kw is None else (kw | c)
        return (F.length(l) > 20) & ~skip & (kw | (F.length(l) > 30))

    cut = lambda a, m: a if m is None else F.slice(a, 1, m)
    idx = F.transform(lines, lambda l, i: F.struct((-F.length(l)).alias("minus"), i.alias("pos"), l.alias("line")))
    ordered = F.sort_array(F.filter(idx, lambda x: cand(x["line"])))
    top = F.transform(cut(ordered, n), lambda x: x["line"])
    fallback = cut(F.filter(lines, lambda l: F.length(l) > 15), n_fallback)
    return F.when(F.size(top) > 0, top).otherwise(fallback)


def line_queries(text, language, n: int | None = None, n_fallback: int | None = None) -> Column:
    """Web line queries: the lines with the language after them."""
    return F.transform(query_lines(text, n, n_fallback), lambda q: F.concat(q, F.lit(" "), T._c(language)))
