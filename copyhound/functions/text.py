"""Scalar column expressions over code and text.

All are native Spark expressions (Java regex), so they run inside whole-stage
codegen on the executors. Patterns use ``(?d)`` so only ``\\n`` ends a line, as
in Python; ``\\A``/``\\z`` anchor the whole string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyhound import config as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rx_replace(col, pattern: str, repl: str = "") -> Column:
    return F.regexp_replace(_c(col), F.lit(pattern), F.lit(repl))


# White space and word characters of Unicode, spelled out: the JVM's and RE2's own \\s and \\w know ASCII only.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
# The characters of WHITE, for functions that take them one by one.
WHITE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")


def unicode_classes(pattern: str) -> str:
    """A pattern with its \\s and \\w (outside brackets) meant as Unicode."""
    return pattern.replace(r"\s", WHITE).replace(r"\w", WORD)


def py_strip(col) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace."""
    return F.btrim(_c(col), F.lit(WHITE_CHARS))


# --- N4 ---------------------------------------------------------------------
def normalize_generic(code) -> Column:
    """One pass over ``//…`` (to line end) and ``/*…*/``, all whitespace to one space, trim."""
    x = rx_replace(code, r"(?dms)//.*?$|/\*.*?\*/", "")
    x = rx_replace(x, WHITE + "+", " ")
    return F.trim(x)


# --- N3 ---------------------------------------------------------------------
def normalize_curly(code) -> Column:
    x = rx_replace(code, r"(?dm)//.*?$", "")
    x = rx_replace(x, r"(?s)/\*.*?\*/", "")
    x = rx_replace(x, r"[ \t]+", " ")
    x = rx_replace(x, rf"\n{WHITE}*\n", "\n")
    return py_strip(x)


# --- N2 ---------------------------------------------------------------------
# A line's prefix made of plain characters, escaped quotes and complete quoted
# strings, followed by an unquoted '#': the comment starts there.
# A quote counts unless a backslash stands right before it. Every repetition is possessive: it runs in a loop, where a
# lazy or greedy group would take a stack frame for each character.
_PY_COMMENT = (
    r"(?d)\A((?:[^'\"#]++|(?<=\\)['\"]"
    r"|(?<!\\)\"[^\"]*+(?:(?<=\\)\"[^\"]*+)*+\""
    r"|(?<!\\)'[^']*+(?:(?<=\\)'[^']*+)*+')*+)#.*\z"
)


def cut_comment(line) -> Column:
    """A line without its ``#`` comment; only lines that have one lose trailing white space."""
    return F.when(line.rlike(_PY_COMMENT), rx_replace(F.regexp_extract(line, _PY_COMMENT, 1), WHITE + r"+\z", "")).otherwise(line)


def normalize_python(code) -> Column:
    x = F.array_join(F.transform(F.split(_c(code), "\n"), cut_comment), "\n")
    x = rx_replace(x, r'(?s)""".*?"""', "")
    x = rx_replace(x, r"(?s)'''.*?'''", "")
    x = rx_replace(x, r"[ \t]+", " ")
    x = rx_replace(x, rf"\n{WHITE}*\n", "\n")
    return py_strip(x)


CURLY_LANGUAGES = ["javascript", "java", "c", "cpp", "csharp"]


# --- N1 ---------------------------------------------------------------------
def normalize(code, language) -> Column:
    lang = _c(language)
    return (
        F.when(lang == "python", normalize_python(code))
        .when(lang.isin(CURLY_LANGUAGES), normalize_curly(code))
        .otherwise(normalize_generic(code))
    )


# --- N5 ---------------------------------------------------------------------
def strip_comments(code, language) -> Column:
    """Comment removal applied before block extraction."""
    lang = _c(language)
    line = rx_replace(code, r"(?dm)//.*?$", "")
    curly = rx_replace(line, r"(?s)/\*.*?\*/", "")
    csharp = rx_replace(curly, r"(?dm)///.*?$", "")
    generic = rx_replace(rx_replace(rx_replace(code, r"(?dm)#.*?$", ""), r"(?dm)//.*?$", ""),
                         r"(?s)/\*.*?\*/", "")
    return (
        F.when(lang.isin("javascript", "typescript", "java", "c", "cpp"), curly)
        .when(lang == "csharp", csharp)
        .when(lang == "python", _c(code))
        .otherwise(generic)
    )


# --- N6 / N8 ----------------------------------------------------------------
def fingerprint(normalized) -> Column:
    return F.sha2(_c(normalized), 256)


def lookup_key(query, language) -> Column:
    return F.md5(F.concat(_c(query), F.lit("_"), F.coalesce(_c(language), F.lit(""))))


# --- N9 / N10 ---------------------------------------------------------------
def clip(text, n: int = C.CLIP_CHARS) -> Column:
    return F.concat(F.substring(_c(text), 1, n), F.lit("..."))


def percent_text(score) -> Column:
    """Score as 'xx.x%', half a tenth rounded up."""
    tenths = F.floor(_c(score).cast("double") * 1000 + 0.5).cast("long")
    return F.when(tenths.isNotNull(), F.format_string("%d.%d%%", F.floor(tenths / 10).cast("long"), tenths % 10))


def percent_sql(score: str) -> str:
    """The same text in DuckDB."""
    tenths = f"CAST(floor(({score}) * 1000 + 0.5) AS BIGINT)"
    return f"concat({tenths} // 10, '.', {tenths} % 10, '%')"


# --- B12 --------------------------------------------------------------------
def complexity(code) -> Column:
    total = F.lit(1)
    for w in C.COMPLEXITY_WORDS:
        total = total + F.regexp_count(_c(code), F.lit(rf"(?i)\b{w}\b"))
    return total.cast("int")


# --- tokens and k-grams -----------------------------------------------------
def let(value, fn) -> Column:
    """Bind ``value`` once and use it many times inside ``fn``.

    Catalyst may inline a projected column into every place it is used (and
    into pushed-down filters); a lambda argument is evaluated exactly once."""
    return F.element_at(F.transform(F.array(_c(value)), fn), 1)


#: So many values are folded in one go: blocks of a few cost more than the copies they save.
FEW_VALUES = 16


def running(values, combine, first) -> Column:
    """array: combine(combine(first, v1), v2) and so on, one for each value (sums, maxima).

    An accumulator that appends copies its array for every value. So the values are taken in blocks of the root of
    their number, and each block's results are combined with the result of all blocks before it."""

    def folded(xs: Column) -> Column:
        kind = "array<bigint>"
        start = F.struct(F.lit(first).cast("long").alias("at"), F.array().cast(kind).alias("out"))

        def add(acc: Column, x: Column) -> Column:
            at = combine(acc["at"], x.cast("long")).cast("long")
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(xs, start, add, lambda acc: acc["out"])

    def in_blocks(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: folded(F.slice(v, k * size + 1, size)))
        return let(blocks, lambda b: let(
            folded(F.transform(b, lambda x: F.element_at(x, -1))),
            lambda ends: F.flatten(F.transform(b, lambda x, k: F.when(k == 0, x).otherwise(
                F.transform(x, lambda y: combine(F.get(ends, k - 1), y).cast("long")))))))

    return let(values, lambda v: F.when(F.size(v) > FEW_VALUES, in_blocks(v)).when(F.size(v) > 0, folded(v))
               .otherwise(F.array().cast("array<bigint>")))


def words(normalized) -> Column:
    """Space-separated tokens of an already whitespace-collapsed text."""
    return let(normalized, lambda t: F.when(t == "", F.array().cast("array<string>"))
               .otherwise(F.split(t, " ")))


def word_grams(tokens, k: int) -> Column:
    """All contiguous k-token grams, joined by one space; empty when fewer than k tokens.

    The lambda reads only its own arguments (a repeated reference to the token
    array), so the token expression is evaluated once per row, not once per gram."""
    return let(tokens, lambda w: F.transform(
        F.array_repeat(w, F.greatest(F.size(w) - k + 1, F.lit(0))),
        lambda x, i: F.array_join(F.slice(x, i + 1, k), " ")))


def char_grams(text, k: int) -> Column:
    return let(text, lambda t: F.transform(
        F.array_repeat(t, F.greatest(F.length(t) - k + 1, F.lit(0))),
        lambda x, i: x.substr(i + 1, F.lit(k))))


# FIXED VALUE: a code token is an identifier/number or one other non-space character
CODE_TOKEN = r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"


def code_tokens(normalized) -> Column:
    return F.regexp_extract_all(_c(normalized), F.lit(CODE_TOKEN), F.lit(0))


def gram_count(n_units, k: int) -> Column:
    return F.greatest(_c(n_units) - k + 1, F.lit(0))
