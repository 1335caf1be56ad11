"""Pair scoring (X1, X3, X4, X5) and the size-checked broadcast used by the joins.

X1 is the Dice form ``2*M/(t1+t2)`` of the reference text ratio over k-gram
multisets: M = sum over shared grams of min(count_left, count_right). It is
computed with one explode, one equi-join on a 64-bit gram hash and two
aggregations that Spark combines map-side, so only grams that occur on both
sides ever reach a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.functions import text as T
from copyhound.session import shuffled


def checked_broadcast(df: DataFrame, max_rows: int = C.CheckConfig().broadcast_max_rows) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven below ``max_rows``.

    For rows of a few numbers each, as a gram profile has, a row bound is a byte bound.
    The count is one job over the small side; beyond the bound the plain frame is
    returned and the join shuffles (AQE may still split skew)."""
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df


def gram_array(text: Column, k: int, unit: str) -> Column:
    if unit == "word":
        return T.word_grams(T.words(text), k)
    if unit == "char":
        return T.char_grams(text, k)
    if unit == "token":
        return T.word_grams(T.code_tokens(text), k)
    raise ValueError(unit)


def gram_hashes(text: Column, k: int, unit: str) -> Column:
    """struct(n = number of grams, hs = array of xxhash64 of each gram), built from
    one evaluation of ``text``."""
    return T.let(gram_array(text, k, unit), lambda g: F.struct(
        F.size(g).cast("long").alias("n"), F.transform(g, lambda x: F.xxhash64(x)).alias("hs")))


def gram_occurrences(df: DataFrame, id_col: str, text_col: str, k: int, unit: str,
                     total_name: str = "total") -> DataFrame:
    """One row per gram occurrence: (id, total, h) with h = xxhash64(gram)."""
    s = df.select(id_col, gram_hashes(F.col(text_col), k, unit).alias("_g"))
    return s.select(id_col, F.col("_g.n").alias(total_name), F.explode("_g.hs").alias("h"))


def gram_profile(df: DataFrame, id_col: str, text_col: str, k: int, unit: str,
                 count_name: str = "c", total_name: str = "total") -> DataFrame:
    """(id, h, count, total) — the k-gram multiset of each text and its size."""
    return (gram_occurrences(df, id_col, text_col, k, unit, total_name)
            .groupBy(id_col, "h").agg(F.count(F.lit(1)).alias(count_name),
                                      F.first(total_name).alias(total_name)))


def gram_similarity(left: DataFrame, right: DataFrame | None, left_id: str, right_id: str,
                    left_text: str = "norm", right_text: str = "norm", k: int = 5,
                    unit: str = "word", broadcast_right: bool | None = None,
                    max_broadcast_rows: int = C.CheckConfig().broadcast_max_rows,
                    right_profile: DataFrame | None = None) -> DataFrame:
    """X1 over every (left, right) pair that shares at least one k-gram.

    Returns left_id, right_id, shared, left_grams, right_grams, similarity,
    containment (= shared / right_grams). ``broadcast_right=None`` broadcasts
    the right profile when its row count is within ``max_broadcast_rows``:
    then the left side is exploded and filtered in place and only grams that
    also occur on the right reach the shuffle. With two large sides both
    profiles are pre-aggregated and shuffled on the gram hash (AQE splits hot
    hashes). Gram totals travel with the rows, so no side is scanned twice.
    ``right_profile`` is a profile kept from before (right_id, h, c2, right_grams).
    """
    rprof = right_profile if right_profile is not None else gram_profile(right, right_id, right_text, k, unit, "c2", "right_grams")
    if broadcast_right is None:
        rprof_j = checked_broadcast(rprof, max_broadcast_rows)
        small = rprof_j is not rprof
    else:
        small = broadcast_right
        rprof_j = F.broadcast(rprof) if small else rprof

    if small:
        occ = gram_occurrences(left, left_id, left_text, k, unit, "left_grams")
        hits = (occ.join(rprof_j, "h")
                .groupBy(left_id, right_id, "h")
                .agg(F.count(F.lit(1)).alias("c1"), F.first("c2").alias("c2"),
                     F.first("left_grams").alias("left_grams"),
                     F.first("right_grams").alias("right_grams")))
    else:
        lprof = gram_profile(left, left_id, left_text, k, unit, "c1", "left_grams")
        hits = lprof.join(rprof_j, "h")

    out = hits.groupBy(left_id, right_id).agg(
        F.sum(F.least("c1", "c2")).cast("long").alias("shared"),
        F.first("left_grams").alias("left_grams"),
        F.first("right_grams").alias("right_grams"))
    return out.select(
        left_id, right_id, "shared", "left_grams", "right_grams",
        (2 * F.col("shared") / (F.col("left_grams") + F.col("right_grams"))).alias("similarity"),
        (F.col("shared") / F.col("right_grams")).alias("containment"),
    )


# --- X3 / X4 ----------------------------------------------------------------
def _pattern_set(code: Column, patterns) -> Column:
    # A leftmost match of a pattern that begins with a word begins where the word does. Saying so keeps the search
    # linear in a very long word, where it would try every letter as a beginning.
    whole = lambda p: f"(?<!{T.WORD})" * p.startswith(r"\w+") + T.unicode_classes(p)
    parts = [F.regexp_extract_all(code, F.lit(whole(p)), F.lit(0)) for p in patterns]
    return F.array_distinct(F.concat(*parts))


def structure_patterns(code, language) -> Column:
    c = T._c(code)
    lang = T._c(language)
    return F.when(lang == "python", _pattern_set(c, C.STRUCTURE_PATTERNS_PYTHON)).otherwise(
        _pattern_set(c, C.STRUCTURE_PATTERNS_OTHER))


def structure_similarity(a, b, language) -> Column:
    """|A ∩ B| / max(|A|, |B|) over the distinct matched strings; 0 if either is empty."""
    pa = structure_patterns(a, language)
    pb = structure_patterns(b, language)
    na, nb = F.size(pa), F.size(pb)
    return F.when((na > 0) & (nb > 0),
                  F.size(F.array_intersect(pa, pb)) / F.greatest(na, nb)).otherwise(F.lit(0.0))


def hybrid_score(text_sim, struct_sim) -> Column:
    return T._c(text_sim) * C.TEXT_WEIGHT + T._c(struct_sim) * C.STRUCTURE_WEIGHT


def pair_similarity(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                    left_text: str = "norm", right_text: str = "norm", k: int = 3, unit: str = "char") -> DataFrame:
    """X1 for given candidate pairs (R9 output): the left k-gram profile is joined to
    the pairs by key, then to the right profile on (right key, gram). Pairs without a
    shared gram get 0. Returns pairs + shared, left_grams, right_grams, similarity."""
    lp = gram_profile(left, left_key, left_text, k, unit, "c1", "left_grams")
    rp = gram_profile(right, right_key, right_text, k, unit, "c2", "right_grams")
    keys = pairs.select(left_key, right_key).dropDuplicates()
    shared = (keys.join(shuffled(lp), left_key).join(shuffled(rp), [right_key, "h"])
              .groupBy(left_key, right_key).agg(F.sum(F.least("c1", "c2")).cast("long").alias("shared")))
    lt = left.select(left_key, gram_hashes(F.col(left_text), k, unit)["n"].alias("left_grams"))
    rt = right.select(right_key, gram_hashes(F.col(right_text), k, unit)["n"].alias("right_grams"))
    out = (pairs.join(shuffled(shared), [left_key, right_key], "left").join(shuffled(lt), left_key).join(shuffled(rt), right_key)
           .withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long")))
    tot = F.col("left_grams") + F.col("right_grams")
    return out.withColumn("similarity", F.when(tot > 0, 2 * F.col("shared") / tot).otherwise(F.lit(0.0)))


def best_block_match(scored: DataFrame, key_cols, score: str = "similarity", tiebreak: str = "cblock_rank") -> DataFrame:
    """Per (query block, candidate file) the best candidate block; the first in
    candidate rank order wins ties."""
    from pyspark.sql import Window
    w = Window.partitionBy(*key_cols).orderBy(F.col(score).desc(), F.col(tiebreak).asc())
    return scored.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
