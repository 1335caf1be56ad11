"""Quality rules as a short-circuit cascade: cost and rejection rate of each rule are estimated on a bounded sample,
and rules run in order of rejection per cost. All of it is DataFrame functions.

What only a rule needs (letters by case, lines, different words) is computed inside its condition, so a text that an earlier
rule rejects, or that fails the base rules, never pays for it. A rule is a condition that rejects a text. The order changes what is computed, never the verdict: a text is kept if no
rule rejects it. `rejected_by` names the first rule, in the order chosen, that does.
"""

from __future__ import annotations

import time
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound.llm.shared import documents

SAMPLE = 512
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A rule runs MOST times over the sample, or until it takes CLEAR seconds more than an idle one, RUNS times each.
CLEAR, MOST, RUNS = 0.2, 512, 3
_WHITE = " \t\n\x0b\x0c\r"
_BREAK = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; an empty array for a null or wordless one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BREAK))


def _pairwise(h: Column, by: int) -> Column:
    """One hash for each place and the one `by` further on; a place without one is hashed alone."""
    return F.zip_with(h, F.slice(h, F.lit(by + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))


def _let(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(ws: Column) -> Column:
    """How many words lie in a window of WINDOW words found twice or more.

    Windows are compared by 64-bit hashes, doubled in width three times. A text whose windows of half the width all
    differ has no equal ones; only a text with equal whole windows sorts them. (The places near the end hold shorter
    windows, each of a width of its own, so none of them equals another.)"""

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            at = lambda i: F.get(s, i)["h"]
            return F.filter(s, lambda x, i: F.coalesce(at(i - 1) == x["h"], F.lit(False)) | F.coalesce(at(i + 1) == x["h"], F.lit(False)))

        places = _let(placed, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        sizes = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return _let(places, lambda p: F.aggregate(sizes(p), F.lit(0).cast("long"), lambda a, x: a + x))

    none = F.lit(0).cast("long")
    differ = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    whole = lambda h: F.when(differ(h), none).otherwise(covered(h))
    half = lambda h: F.when(differ(h), none).otherwise(_let(_pairwise(h, 4), whole))
    repeated = lambda h: F.when(F.size(h) > WINDOW, _let(_pairwise(_let(h, lambda x: _pairwise(x, 1)), 2), half)).otherwise(none)
    return _let(F.transform(ws, lambda w: F.xxhash64(w)), repeated)


def _count(text: Column, class_: str) -> Column:
    """The number of characters of a class; those of other classes are copied in runs."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{class_}]+", ""))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), and the base measures of every whole text: n_words, word_chars, n_symbols,
    n_dup_lines and n_repeat_words. An empty text has 0 everywhere; repeated rows and null doc_ids
    stay rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_WHITE)) != "")
    counted = _let(words(F.col("text")), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeated_words(ws).alias("repeated")))
    return docs.select("doc_id", text.alias("text")).withColumn("c", counted).select(
        "doc_id", "text", F.col("c.n").alias("n_words"),
        (F.char_length("text") - _count(F.col("text"), _BREAK[1:-2])).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col("c.repeated").alias("n_repeat_words"))


def rules() -> dict[str, Column]:
    """Name to condition that rejects, over the columns of `measures`. All comparisons are between integers."""
    text, n = F.col("text"), F.col("n_words")
    upper, lower = _count(text, "A-ZÀ-ÖØ-Þ"), _count(text, "a-zß-öø-ÿ")
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_WHITE)) != ""))
    return {
        "symbols": 10 * F.col("n_symbols") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "upper_case": upper > lower,
        "duplicate_lines": (F.col("n_dup_lines") > 0) & (2 * F.col("n_dup_lines") > lines),
        "few_words": (n >= 100) & (20 * F.size(F.array_distinct(words(text))) < n),
    }


def order_rules(sample: DataFrame, conditions: dict[str, Column]) -> list[str]:
    """Rule names by rejections per second on the sample, most first; ties by name. The sample is bounded.

    A rule's cost is the median of RUNS runs less that of an idle rule over as many rows. The sample's rows are repeated
    until the rule stands out by CLEAR seconds; rules that don't within MOST times count as equally cheap."""
    rows = sample.persist()
    total = max(1, rows.count())

    def run(condition: Column, times: int) -> tuple[float, int]:
        repeated = rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(times))))
        began = time.perf_counter()
        hits = repeated.agg(F.coalesce(F.sum(condition.cast("long")), F.lit(0))).first()[0]
        return time.perf_counter() - began, hits // times

    def seconds(condition: Column, times: int) -> float:
        return median(run(condition, times)[0] for _ in range(RUNS))

    idle: dict[int, float] = {}
    worth = {}
    for name, condition in conditions.items():
        _, hits = run(condition, 1)
        times, over = 1, 0.0
        while times < MOST and over < CLEAR:
            times *= 8
            if times not in idle:
                run(F.lit(False), times)
                idle[times] = seconds(F.lit(False), times)
            over = run(condition, times)[0] - idle[times]
        cost = max(seconds(condition, times) - idle[times], CLEAR / 4 if times >= MOST else CLEAR / 2) / times
        worth[name] = (hits + 1) / total / cost
    rows.unpersist()
    return sorted(worth, key=lambda name: (-worth[name], name))


def cascade(df: DataFrame, conditions: dict[str, Column], order: list[str]) -> Column:
    """The first rule in the order that rejects a row, else null. Later ones aren't evaluated for that row."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(F.coalesce(conditions[name], F.lit(False)), F.lit(name)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def filtered(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The measures of every row of docs (doc_id, text) with base_failed, rejected_by and kept."""
    conditions = rules()
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "sampled")
    some = docs.join(F.broadcast(ids.distinct()), F.col("doc_id").eqNullSafe(F.col("sampled")), "left_semi").limit(sample)
    order = order_rules(measures(some), conditions)
    out = measures(docs).withColumn("base_failed", base_failed())
    out = out.withColumn("rejected_by", F.when(~F.col("base_failed"), cascade(out, conditions, order)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("text")


def op4_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY 1),
m AS (
  SELECT d.doc_id, text, ws, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(rep.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS upper_n, length(regexp_replace(text, '[^a-zß-öø-ÿ]', '', 'g')) AS lower_n
  FROM d LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR upper_n > lower_n
    OR 2 * n_dup_lines > len(ls) OR (n_words >= 100 AND 20 * len(list_distinct(ws)) < n_words)) AS kept
FROM r
"""
