"""Block extraction: file row -> block rows (B1-B8, B10-B16), all native expressions.

Regex-based languages use ``regexp_extract_all`` for the matches and ``split`` on
the same pattern for the text between them, so the line of every match is a sum
of newline counts (no per-character work). Python blocks come from indentation: one
row for each line and indentation level, and windows over a file's lines.

Brace blocks follow the reference patterns, whose ``[^}]*`` makes every block end
at the first ``}`` (the nested-looking form is equivalent to ``\\{[^}]*\\}``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.functions import text as T
from copyhound.session import shuffled

_ID = r"[a-zA-Z_][a-zA-Z0-9_]*"
_JSID = r"[a-zA-Z_$][a-zA-Z0-9_$]*"
_BODY = r"\{[^}]*\}"

# FIXED VALUES: extraction patterns (brace bodies in their equivalent short form)
JS_FUNCTION = rf"function\s+({_JSID})\s*\([^)]*\)\s*{_BODY}"
JS_ARROW = rf"(?:const|let|var)\s+({_JSID})\s*=\s*(?:\([^)]*\)|{_JSID})\s*=>\s*(?:{_BODY}|[^;,\n]+)"
JAVA_METHOD = (r"(?:public|private|protected)?\s*(?:static)?\s*(?:final)?\s*(?:[a-zA-Z_][a-zA-Z0-9_<>\[\]]*\s+)?"
               rf"({_ID})\s*\([^)]*\)\s*(?:throws\s+[a-zA-Z0-9_,\s]+)?\s*{_BODY}")
JAVA_CLASS = (rf"(?:public|private|protected)?\s*(?:static)?\s*class\s+({_ID})\s*(?:extends\s+{_ID}\s*)?"
              rf"(?:implements\s+[a-zA-Z0-9_,\s]+\s*)?\{{([^}}]*)\}}")
# C head. The pattern is a run of type and modifier words, then name(...) {...}. The JVM
# finds only the name and its body; the words before it are taken from the end of the
# text piece in front, read backwards, so no long run of words is ever backtracked.
C_NAME = rf"([a-zA-Z_][a-zA-Z0-9_]*+)\s*\([^)]*\)\s*{_BODY}"
C_FUNCTION_RE2 = rf"(?:[a-zA-Z_][a-zA-Z0-9_]*\s+)*([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*{_BODY}"
WORDS_BACKWARDS = r"\A(?:\s+[a-zA-Z0-9_]*[a-zA-Z_])*+"
CPP_CLASS = rf"class\s+({_ID})\s*(?::\s*(?:public|private|protected)\s+{_ID}\s*)?{_BODY}"
CSHARP_METHOD = (r"(?:public|private|protected|internal)?\s*(?:static)?\s*(?:virtual|override)?\s*"
                 r"(?:[a-zA-Z_][a-zA-Z0-9_<>\[\]]*\s+)?"
                 rf"({_ID})\s*\([^)]*\)\s*{_BODY}")

# The same matches for the JVM, which backtracks: white space and names are taken whole wherever what follows can't begin with
# a part of them, and no match is tried in the middle of white space or of a word, where the one before would have begun
# (but at a modifier, which may end a word). The long forms above try every split of an indentation: its length to the fourth.
_NEW_SPACE = r"(?!(?<=\s)\s)"
_ONE_HEAD = rf"(?:[a-zA-Z_][a-zA-Z0-9_<>\[\]]*+\s++)?({_ID}+)\s*+\([^)]*+\)\s*+"
_ONE_BODY = r"\{[^}]*+\}"


def _new_word(modifiers: str) -> str:
    return rf"{_NEW_SPACE}(?:(?!(?<=[a-zA-Z_])[a-zA-Z_])|(?={modifiers}))"


JVM_FORM = {
    JS_FUNCTION: rf"function\s++({_JSID}+)\s*+\([^)]*+\)\s*+{_ONE_BODY}",
    JAVA_METHOD: (_new_word("public|private|protected|static|final") + r"(?:public|private|protected)?\s*+(?:static)?\s*+(?:final)?\s*+"
                  rf"{_ONE_HEAD}(?:throws\s[a-zA-Z0-9_,\s]++)?\s*+{_ONE_BODY}"),
    JAVA_CLASS: (rf"{_NEW_SPACE}(?:public|private|protected)?\s*+(?:static)?\s*+class\s++({_ID})\s*(?:extends\s+{_ID}\s*)?"
                 rf"(?:implements\s+[a-zA-Z0-9_,\s]+\s*)?\{{([^}}]*)\}}"),
    CSHARP_METHOD: (_new_word("public|private|protected|internal|static|virtual|override") + r"(?:public|private|protected|internal)?\s*+(?:static)?\s*+"
                    rf"(?:virtual|override)?\s*+{_ONE_HEAD}{_ONE_BODY}"),
}

BLOCKS = "array<struct<ord:struct<a:int,b:int,c:int>,block_type:string,name:string,code:string,line_start:int>>"

BLOCKS_RAW = "array<struct<ord:struct<a:int,b:int,c:int>,name:string,raw:string,line_start:int>>"


def order(a, b, c=0) -> Column:
    """The place of a block in its file; compared field by field."""
    as_int = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return F.struct(as_int(a).alias("a"), as_int(b).alias("b"), as_int(c).alias("c"))


def newlines(s) -> Column:
    s = T._c(s)
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def words_before(piece: Column) -> Column:
    """The run of words, each with white space after it, that ends a text piece."""
    return F.reverse(F.regexp_extract(F.reverse(piece), WORDS_BACKWARDS, 0))


def regex_blocks(clean, pattern: str, block_type: str, name_group: int = 1, place: int = 0,
                 keep=None, lead=None) -> Column:
    """Array of (ord, block_type, name, code, line_start) for every match of ``pattern`` in
    ``clean``; ord = (place, match number). ``keep(name, raw_code)`` filters (boilerplate
    rules); ``lead(piece)`` gives text before the match that belongs to it."""
    pattern = JVM_FORM.get(pattern, pattern)
    pat = F.lit(pattern)
    lead = lead or (lambda piece: F.lit(""))

    def build(t):
        m0 = F.regexp_extract_all(t, pat, F.lit(0))
        m1 = F.regexp_extract_all(t, pat, F.lit(name_group))
        pieces = F.slice(F.split(t, pattern, -1), F.lit(1), F.size(m0))
        return T.let(F.struct(m0.alias("m0"), m1.alias("m1"), F.transform(pieces, lead).alias("lead"),
                              F.transform(pieces, newlines).alias("pn"), F.transform(m0, newlines).alias("mn")),
                     lambda s: F.transform(F.sequence(F.lit(1), F.size(s["m0"])), lambda k: F.struct(
                         order(place, k).alias("ord"), F.get(s["m1"], k - 1).alias("name"),
                         F.concat(F.get(s["lead"], k - 1), F.get(s["m0"], k - 1)).alias("raw"),
                         (F.get(s["pn"], k - 1) - newlines(F.get(s["lead"], k - 1))).alias("before"),
                         F.get(s["mn"], k - 1).alias("inside"), newlines(F.get(s["lead"], k - 1)).alias("led"))))

    def numbered(found):
        # a match starts after all pieces and matches before it, less its own lead
        lines = T.running(F.transform(found, lambda x: x["before"] + x["led"] + x["inside"]), lambda a, x: a + x, 0)
        return F.zip_with(found, lines, lambda x, end: F.struct(
            x["ord"].alias("ord"), x["name"].alias("name"), x["raw"].alias("raw"), (1 + end - x["led"] - x["inside"]).cast("int").alias("line_start")))

    none = F.array().cast(BLOCKS_RAW)
    arr = T.let(clean, lambda t: F.when(t.rlike(pattern), T.let(build(t), numbered)).otherwise(none))
    if keep is not None:
        arr = F.filter(arr, lambda b: keep(b["name"], b["raw"]))
    return F.transform(arr, lambda b: F.struct(
        b["ord"].alias("ord"), F.lit(block_type).alias("block_type"), b["name"].alias("name"),
        T.py_strip(b["raw"]).alias("code"), b["line_start"].alias("line_start")))


# --- B10 / B11 --------------------------------------------------------------
def java_boilerplate(name, raw) -> Column:
    n, c = T._c(name), T._c(raw)
    short = F.size(F.split(c, "\n")) < 5
    return (n.rlike(C.JAVA_BOILERPLATE_NAME) | (c.contains("return") & short)
            | (c.contains("this.") & c.contains("=") & short))


def csharp_boilerplate(name, raw=None) -> Column:
    return T._c(name).rlike(C.CSHARP_BOILERPLATE_NAME)


# --- B3-B6 ------------------------------------------------------------------
def blocks_js(clean) -> Column:
    return F.concat(regex_blocks(clean, JS_FUNCTION, "function"),
                    regex_blocks(clean, JS_ARROW, "arrow_function", place=1))


def blocks_java(clean) -> Column:
    return F.concat(
        regex_blocks(clean, JAVA_METHOD, "method", keep=lambda n, c: ~java_boilerplate(n, c)),
        regex_blocks(clean, JAVA_CLASS, "class", place=1,
                     keep=lambda n, c: ~n.isin(C.JAVA_BOILERPLATE_CLASSES)))


def blocks_c(clean) -> Column:
    return F.concat(
        regex_blocks(clean, C_NAME, "function", lead=words_before,
                     keep=lambda n, c: ~n.isin(C.C_SKIP_NAMES) & ~n.startswith("_")),
        regex_blocks(clean, CPP_CLASS, "class", place=1))


def blocks_csharp(clean) -> Column:
    return regex_blocks(clean, CSHARP_METHOD, "method", keep=lambda n, c: ~csharp_boilerplate(n))


# --- B7 ---------------------------------------------------------------------
def blocks_generic(clean) -> Column:
    """Runs of non-blank stripped lines closed by a blank line, more than 2 lines;
    an unterminated last run is dropped. name block_{n}, line_start n+1."""
    lines = F.transform(F.split(T._c(clean), "\n"), lambda l: F.concat(T.py_strip(l), F.lit("\n")))
    pieces = F.split(F.array_join(lines, ""), "\n\n+", -1)
    closed = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    runs = F.transform(closed, lambda p: T.rx_replace(p, r"\A\n+", ""))
    kept = F.filter(runs, lambda r: (r != "") & (F.size(F.split(r, "\n")) > 2))
    return F.transform(kept, lambda r, i: F.struct(
        order(0, i).alias("ord"), F.lit("code_block").alias("block_type"), F.concat(F.lit("block_"), i.cast("string")).alias("name"),
        r.alias("code"), (i + 1).cast("int").alias("line_start")))


def generic_clean(code) -> Column:
    return T.strip_comments(code, F.lit("generic"))


# --- B2 ---------------------------------------------------------------------
# FIXED VALUES: the lines that open Python blocks
PY_DEF = r"^[ \t]*def\s+([a-zA-Z_][a-zA-Z0-9_]*)"
PY_CLASS = r"^[ \t]*class\s+([a-zA-Z_][a-zA-Z0-9_]*)"
PY_LOGIC = r"^[ \t]*(for|while|if|elif)\b"
PY_ELSE = r"^[ \t]*else\s*:"
PY_EXCEPT = r"^[ \t]*except\b"


def python_lines(files: DataFrame, key_cols, code_col: str = "code") -> DataFrame:
    """One row for each non-blank line: keys, i, ind, def, cls, logic, part (elif or else), exc."""
    rows = files.select(*key_cols, F.posexplode(F.split(code_col, "\n")).alias("i", "text")).where(T.py_strip("text") != "")
    word = F.regexp_extract("text", PY_LOGIC, 1)
    return rows.select(
        *key_cols, "i", F.length(F.regexp_extract("text", r"^[ \t]*", 0)).alias("ind"),
        F.regexp_extract("text", PY_DEF, 1).alias("def"), F.regexp_extract("text", PY_CLASS, 1).alias("cls"), word.alias("logic"),
        ((word == "elif") | F.col("text").rlike(PY_ELSE)).alias("part"), F.col("text").rlike(PY_EXCEPT).cast("int").alias("exc"))


def python_heads(files: DataFrame, key_cols, code_col: str = "code") -> DataFrame:
    """One row for each def, class and logic line: keys, i, ind, def, cls, logic, end, depth and, for a def that stands
    in a class body, owner (name), owner_i and owner_depth.

    A line meets each indentation level of its file once, so a file costs lines x levels rows, and every answer is a
    running value within (file, level). depth counts the statements around a line as a syntax tree does: an elif
    hangs from the if before it, and an except clause is a step of its own. end is the next line that is indented
    no deeper, but a later elif or else at its own level belongs to a logic line."""
    keys = list(key_cols)
    lines = python_lines(files, keys, code_col)
    levels = lines.select(*keys, F.col("ind").alias("level")).distinct()
    head = (F.col("def") != "") | (F.col("cls") != "") | (F.col("logic") != "")
    at = lines.join(shuffled(levels), keys).where((F.col("ind") <= F.col("level")) | head)
    at = at.withColumn("near", F.col("ind") <= F.col("level")).withColumn("same", F.col("ind") == F.col("level"))
    down = Window.partitionBy(*keys, "level").orderBy("i")
    upto, before = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys, "level").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("near") & ~(F.col("same") & F.col("part"))
    elifs = F.sum(F.when(F.col("same") & (F.col("logic") == "elif"), 1).otherwise(0)).over(upto)
    at = at.withColumn("elifs", elifs)
    at = at.withColumn("chain", F.col("elifs") - F.coalesce(F.last(F.when(start, F.col("elifs")), ignorenulls=True).over(upto), F.lit(0)))
    anchor = F.last(F.when(F.col("near"), F.struct("ind", (F.when(F.col("part"), F.col("chain")).otherwise(0) + F.col("exc")).alias("more"))),
                    ignorenulls=True).over(before)
    parent = F.last(F.when(F.col("ind") < F.col("level"), F.struct("cls", F.col("i").alias("line"))), ignorenulls=True).over(before)
    at = at.select(*keys, "level", "i", "ind", "def", "cls", "logic", "same", "chain", anchor.alias("anchor"), parent.alias("parent"),
                   F.min(F.when(F.col("near"), F.col("i"))).over(after).alias("next_any"),
                   F.min(F.when(start, F.col("i"))).over(after).alias("next_start")).where(head)
    step = (F.when(F.col("same"), F.when(F.col("logic") == "elif", F.col("chain")).otherwise(0))
            .when((F.col("ind") > F.col("level")) & (F.col("anchor.ind") == F.col("level")), 1 + F.col("anchor.more")).otherwise(0))
    own = lambda c: F.max(F.when(F.col("same"), c))
    heads = at.groupBy(*keys, "i").agg(
        F.max("ind").alias("ind"), F.max("def").alias("def"), F.max("cls").alias("cls"), F.max("logic").alias("logic"),
        F.sum(step).cast("int").alias("depth"), own(F.when(F.col("logic") != "", F.col("next_start")).otherwise(F.col("next_any"))).alias("end"),
        own(F.col("parent.cls")).alias("owner"), own(F.col("parent.line")).alias("owner_i"))
    classes = heads.where("cls <> ''").select(*keys, F.col("i").alias("owner_i"), F.col("depth").alias("owner_depth"))
    return heads.join(shuffled(classes), [*keys, "owner_i"], "left")


def python_blocks(files: DataFrame, key_cols, code_col: str = "code") -> DataFrame:
    """keys, blocks: function (every def), method (``Class.f`` for defs directly in a class body) and logic (every
    for/while/if/elif) blocks. ord is breadth-first (depth, line); methods take their class's place."""
    keys = list(key_cols)
    heads = python_heads(files, keys, code_col).groupBy(*keys).agg(F.collect_list(F.struct(
        "i", "ind", "def", "logic", "depth", "end", "owner", "owner_i", "owner_depth")).alias("heads"))

    def body(lines, h):
        part = F.slice(lines, h["i"] + 1, F.coalesce(h["end"], F.size(lines)) - h["i"])
        cut = F.transform(part, lambda l: F.when(F.length(l) >= h["ind"], l.substr(h["ind"] + 1, F.lit(1 << 30))).otherwise(F.ltrim(l)))
        return T.rx_replace(F.array_join(cut, "\n"), r"\s+\z", "")

    def block(lines, h, ord_, kind, name):
        return F.struct(ord_.alias("ord"), kind.alias("block_type"), name.alias("name"), body(lines, h).alias("code"), (h["i"] + 1).cast("int").alias("line_start"))

    def build(lines):
        is_def = lambda h: h["def"] != ""
        plain = F.transform(F.filter("heads", lambda h: is_def(h) | (h["logic"] != "")), lambda h: block(
            lines, h, order(h["depth"], h["i"]), F.when(is_def(h), "function").otherwise("logic"),
            F.when(is_def(h), h["def"]).otherwise(F.concat(F.lit("logic_block_"), (h["i"] + 1).cast("string")))))
        methods = F.transform(F.filter("heads", lambda h: is_def(h) & (h["owner"] != "")), lambda h: block(
            lines, h, order(h["owner_depth"], h["owner_i"], h["i"] + 1), F.lit("method"), F.concat(h["owner"], F.lit("."), h["def"])))
        return F.concat(methods, plain).cast(BLOCKS)

    return files.join(shuffled(heads), keys).select(*keys, T.let(F.split(code_col, "\n"), build).alias("blocks"))


# --- B9 ---------------------------------------------------------------------
# FIXED VALUES (ours): block heads up to their opening brace, by language: (type, pattern), the name in group 1
BALANCED_HEADS = {
    "javascript": [("function", rf"function\s+({_JSID})\s*\([^)]*\)\s*\{{"),
                   ("arrow_function", rf"(?:const|let|var)\s+({_JSID})\s*=\s*(?:\([^)]*\)|{_JSID})\s*=>\s*\{{"),
                   ("class", rf"class\s+({_JSID})\s*(?:extends\s+{_JSID}\s*)?\{{"),
                   ("method", rf"({_JSID})\s*\([^)]*\)\s*\{{")],
    "java": [("class", rf"class\s+({_ID})\s*(?:extends\s+{_ID}\s*)?(?:implements\s+[a-zA-Z0-9_,\s]+)?\{{"),
             ("method", rf"({_ID})\s*\([^)]*\)\s*(?:throws\s+[a-zA-Z0-9_,\s]+)?\{{")],
    "c": [("function", rf"({_ID})\s*\([^)]*\)\s*\{{")],
}
#: A place and a count go through one running sum, each in half of a number.
HALF = 1 << 32
CONTROL_WORDS = ["if", "for", "while", "switch", "catch", "function", "return"]


def balanced_blocks(files: DataFrame, key_cols, code_col: str = "clean", lang_col: str = "language",
                    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Blocks from their head to the brace that closes it: keys, block_type, name, code, line_start.

    Braces are rows with a running depth, and an open brace at a depth is closed by the next close brace that leads out
    of it. Heads are matched up to their open brace, so blocks inside blocks are found too. A method is a head whose
    enclosing brace opens a class, named Class.method; a function stands in no class. An unclosed block isn't one.
    ``keep`` stores a table that is read more than once."""
    keys = list(key_cols)

    def placed(pattern: str, count, more) -> Column:
        """array of structs for the matches of a pattern: more(match, its start (0-based), its end, the count up to its end, its
        number (0-based)). count(text) is for a match or the text before it, and is summed in the lower half of the places."""
        found = F.regexp_extract_all(code_col, F.lit(pattern), F.lit(0))
        gaps = F.slice(F.split(code_col, pattern, -1), F.lit(1), F.size(found))
        both = lambda x: F.length(x).cast("long") * HALF + count(x)
        ends = lambda s: F.arrays_zip(s["m"].alias("m"), T.running(F.zip_with(s["g"], s["m"], lambda g, m: both(g) + both(m)), lambda x, y: x + y, 0).alias("end"))
        zipped = T.let(F.struct(gaps.alias("g"), found.alias("m")), ends)
        stop = lambda z: F.shiftright(z["end"], 32)
        return F.transform(zipped, lambda z, k: more(z["m"], stop(z) - F.length(z["m"]), stop(z), z["end"].bitwiseAND(F.lit(HALF - 1)), k))

    # of k + 1 marks with n open ones, the others close
    marks = placed(r"[{}]", lambda x: (x == "{").cast("long"), lambda m, start, stop, opened, k: F.struct(
        F.struct(m.alias("m"), start.alias("start")).alias("at"), (2 * opened - k - 1).alias("depth")))
    braces = files.select(*keys, F.posexplode(marks).alias("k", "z")).select(*keys, "k", "z.at.m", "z.at.start", "z.depth")
    braces = braces.withColumn("level", F.when(F.col("m") == "{", F.col("depth")).otherwise(F.col("depth") + 1))
    braces = braces.withColumn("closed", F.lead("start").over(Window.partitionBy(*keys, "level").orderBy("k")))
    blocks = braces.where("m = '{'").select(*keys, F.col("start").alias("brace"), "closed", "level")

    def of(kind: str, pattern: str) -> Column:
        return placed(pattern, newlines, lambda m, start, stop, lines, k: F.struct(
            F.lit(kind).alias("block_type"), F.regexp_extract(m, pattern, 1).alias("name"), start.alias("start"), (stop - 1).alias("brace"),
            (1 + lines - newlines(m)).cast("int").alias("line_start")))

    heads = F.coalesce(*[F.when(F.col(lang_col) == language, F.concat(*[of(*kind) for kind in kinds])) for language, kinds in BALANCED_HEADS.items()])
    heads = files.select(*keys, F.explode(heads).alias("h")).select(*keys, "h.*")
    found = keep(heads.where(~F.col("name").isin(CONTROL_WORDS)).join(shuffled(blocks), [*keys, "brace"]).where("closed is not null"), "balanced")
    classes = found.where("block_type = 'class'").select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("name").alias("owner"), F.col("brace").alias("from"),
                                                         F.col("closed").alias("to"), (F.col("level") + 1).alias("under"))
    within = (F.col("level") == F.col("under")) & (F.col("brace") > F.col("from")) & (F.col("brace") < F.col("to"))
    both = found.join(shuffled(classes), reduce(and_, [F.col(k) == F.col(f"of_{k}") for k in keys], within), "left")
    own = both.where((F.col("block_type") != "method") | F.col("owner").isNotNull()).where((F.col("block_type") != "function") | F.col("owner").isNull())
    named = F.when(F.col("block_type") == "method", F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))
    text = files.select(*keys, F.col(code_col).alias("whole"))
    return own.join(shuffled(text), keys).select(*keys, "block_type", named.alias("name"), "line_start",
                                       F.substr("whole", (F.col("start") + 1).cast("int"), (F.col("closed") - F.col("start") + 1).cast("int")).alias("code"))


# --- B8 ---------------------------------------------------------------------
def fallback_block(code) -> Column:
    """Lines that are not blank, comments or imports, kept unstripped."""
    lines = F.split(T._c(code), "\n")

    def keep(l):
        def wanted(s):
            bad = None
            for p in C.FALLBACK_SKIP_PREFIXES:
                c = s.startswith(p)
                bad = c if bad is None else (bad | c)
            return (s != "") & ~bad
        return T.let(T.py_strip(l), wanted)
    return F.array_join(F.filter(lines, keep), "\n")


# --- B1 ---------------------------------------------------------------------
def extract_blocks(code, language) -> Column:
    """Dispatcher for all languages but Python: the array of a file's blocks."""
    lang = T._c(language)
    clean = T.strip_comments(code, lang)
    return (F.when(lang.isin("javascript", "typescript"), blocks_js(clean))
            .when(lang == "java", blocks_java(clean))
            .when(lang.isin("c", "cpp"), blocks_c(clean))
            .when(lang == "csharp", blocks_csharp(clean))
            .otherwise(blocks_generic(clean)))


def block_rows(files: DataFrame, key_cols, code_col: str = "code", lang_col: str = "language") -> DataFrame:
    """One row per block: keys, language, block_id (extraction order), block_type,
    name, code, line_start, complexity (B12), block_rank (B13).

    Blocks are numbered and ranked inside their file's array, so their text isn't shuffled."""
    keys = list(key_cols)
    is_python = F.coalesce(F.col(lang_col) == "python", F.lit(False))
    python = files.where(is_python)
    found = python_blocks(python, keys, code_col).select(*keys, F.lit("python").alias(lang_col), "blocks")
    other = files.where(~is_python).select(*keys, lang_col, extract_blocks(code_col, lang_col).cast(BLOCKS).alias("blocks"))
    ids = F.transform(F.sort_array("blocks"), lambda b, i: F.struct(
        (-T.complexity(b["code"])).alias("minus"), i.alias("block_id"), b["block_type"].alias("block_type"),
        b["name"].alias("name"), b["code"].alias("code"), b["line_start"].alias("line_start")))
    rows = other.unionByName(found).select(*keys, lang_col, F.posexplode(F.sort_array(ids)).alias("place", "b"))
    return rows.select(*keys, lang_col, "b.block_type", "b.name", "b.code", "b.line_start", F.col("b.block_id").cast("int").alias("block_id"),
                       (-F.col("b.minus")).cast("int").alias("complexity"), (F.col("place") + 1).cast("int").alias("block_rank"))


# --- B14 / B15 / P9 ---------------------------------------------------------
def extraction_summary(files: DataFrame, blocks: DataFrame, key_cols) -> DataFrame:
    """Per file: total_blocks, total_core_lines, complexity_sum, average_complexity
    (sum / max(n, 1)), sorted distinct block types; files without blocks give 0."""
    g = blocks.groupBy(*key_cols).agg(
        F.count(F.lit(1)).cast("long").alias("total_blocks"),
        F.sum(newlines("code") + 1).cast("long").alias("total_core_lines"),
        F.sum("complexity").cast("long").alias("complexity_sum"),
        F.array_join(F.array_sort(F.collect_set("block_type")), ",").alias("block_types"))
    out = files.select(*key_cols).join(shuffled(g), list(key_cols), "left")
    return out.select(
        *key_cols,
        F.coalesce("total_blocks", F.lit(0)).cast("long").alias("total_blocks"),
        F.coalesce("total_core_lines", F.lit(0)).cast("long").alias("total_core_lines"),
        (F.coalesce("complexity_sum", F.lit(0)) / F.greatest(F.coalesce("total_blocks", F.lit(0)), F.lit(1)))
        .alias("average_complexity"),
        F.coalesce("block_types", F.lit("")).alias("block_types"))


# --- B16 --------------------------------------------------------------------
def key_lines(code) -> Column:
    """Stripped lines that are not blank and do not start with a summary-skip prefix."""
    def keep(s):
        bad = None
        for p in C.SUMMARY_SKIP_PREFIXES:
            c = s.startswith(p)
            bad = c if bad is None else (bad | c)
        return (s != "") & ~bad
    return F.filter(F.transform(F.split(T._c(code), "\n"), lambda l: T.py_strip(l)), keep)


def core_summary(blocks: DataFrame, key_cols) -> DataFrame:
    """First 3 key lines of each of the top 3 ranked blocks, at most 10 lines.
    Only the ≤3 top blocks of a file are ever gathered."""
    top = blocks.where(F.col("block_rank") <= C.SUMMARY_BLOCKS).select(
        *key_cols, "block_rank", F.slice(key_lines("code"), 1, C.SUMMARY_LINES_PER_BLOCK).alias("kl"))
    g = top.groupBy(*key_cols).agg(F.array_sort(F.collect_list(F.struct("block_rank", "kl"))).alias("parts"))
    return g.select(*key_cols, F.array_join(F.slice(F.flatten(F.transform("parts", lambda p: p["kl"])), 1,
                                                    C.SUMMARY_MAX_LINES), "\n").alias("summary"))
