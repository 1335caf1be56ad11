"""Dedup, ranking, roll-ups and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.functions.text import _c


# --- F9 ---------------------------------------------------------------------
def match_floor(df: DataFrame, kind: str = "code", score: str = "similarity",
                floor: float | None = None) -> DataFrame:
    """code: score >= floor; web: score > floor."""
    if kind == "code":
        return df.where(F.col(score) >= (C.CODE_MATCH_FLOOR if floor is None else floor))
    if kind == "web":
        return df.where(F.col(score) > (C.WEB_MATCH_FLOOR if floor is None else floor))
    raise ValueError(kind)


# --- P1 ---------------------------------------------------------------------
def dedup_url(df: DataFrame, file_cols, url_col: str = "url", score: str = "similarity",
              tiebreak=None) -> DataFrame:
    """Keep the best match per (file, url); ties go to the smaller tiebreak columns."""
    order = [F.col(score).desc()] + [F.col(c).asc() for c in (tiebreak or [])]
    w = Window.partitionBy(*file_cols, url_col).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# --- P2 ---------------------------------------------------------------------
def top_matches(df: DataFrame, file_cols, n: int, score: str = "similarity", tiebreak=None,
                rank_name: str = "match_rank") -> DataFrame:
    """Top ``n`` per file by score desc (ties by ``tiebreak`` asc); planned as a
    per-partition WindowGroupLimit before the sort."""
    order = [F.col(score).desc()] + [F.col(c).asc() for c in (tiebreak or [])]
    w = Window.partitionBy(*file_cols).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).where(F.col(rank_name) <= n)


# --- P5 ---------------------------------------------------------------------
def risk_label(code_max, web_max, n_matches, threshold: float = C.RISK_THRESHOLD) -> Column:
    cm, wm, n = _c(code_max), _c(web_max), _c(n_matches)
    return (F.when((cm >= threshold) | (wm >= threshold), F.lit("potential_issues"))
            .when(n > 0, F.lit("minor"))
            .otherwise(F.lit("original")))


# --- P6 ---------------------------------------------------------------------
def gauge_band(score) -> Column:
    """Overall gauge: percentage rounded to 0.1, <30 low, <70 medium, else high."""
    pct = F.round(_c(score) * 100, 1)
    return F.when(pct < 30, "low").when(pct < 70, "medium").otherwise("high")


def file_badge(score) -> Column:
    pct = _c(score) * 100
    return F.when(pct > 50, "high").when(pct > 30, "medium").otherwise("low")


def match_badge(score) -> Column:
    s = _c(score)
    return F.when(s > 0.8, "high").when(s > 0.6, "medium").otherwise("low")


# --- P3 ---------------------------------------------------------------------
def file_report(files: DataFrame, key_cols, code_matches: DataFrame | None = None,
                web_matches: DataFrame | None = None, code_score: str = "similarity",
                web_score: str = "similarity") -> DataFrame:
    """Per file: max code / web similarity (0 when none), match counts, label.
    Matches are aggregated per file first, then left-joined to every admitted file."""
    out = files.select(*key_cols)
    for name, m, sc in (("code", code_matches, code_score), ("web", web_matches, web_score)):
        if m is None:
            out = out.withColumn(f"{name}_max", F.lit(0.0)).withColumn(f"n_{name}", F.lit(0).cast("long"))
            continue
        agg = m.groupBy(*key_cols).agg(F.max(sc).alias(f"{name}_max"),
                                       F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(agg, list(key_cols), "left")
        out = out.withColumn(f"{name}_max", F.coalesce(F.col(f"{name}_max").cast("double"), F.lit(0.0)))
        out = out.withColumn(f"n_{name}", F.coalesce(F.col(f"n_{name}"), F.lit(0)).cast("long"))
    return out.withColumn("label", risk_label("code_max", "web_max", F.col("n_code") + F.col("n_web")))


# --- P4 ---------------------------------------------------------------------
def overall_report(report: DataFrame, group_col: str, file_col: str) -> DataFrame:
    """One pass with ROLLUP: file rows, per-submission rows and the overall row.
    level = 'file' | 'submission' | 'overall'."""
    g = report.rollup(group_col, file_col).agg(
        F.max("code_max").alias("code_max"),
        F.max("web_max").alias("web_max"),
        F.sum(F.col("n_code") + F.col("n_web")).cast("long").alias("total_matches"),
        F.count(F.lit(1)).cast("long").alias("n_files"),
        F.grouping_id().alias("_gid"),
    )
    level = F.when(F.col("_gid") == 0, "file").when(F.col("_gid") == 1, "submission").otherwise("overall")
    return g.select(
        level.alias("level"), group_col, file_col, "code_max", "web_max",
        F.greatest("code_max", "web_max").alias("max_overall"), "total_matches", "n_files",
        risk_label("code_max", "web_max", "total_matches").alias("label"),
        gauge_band(F.greatest("code_max", "web_max")).alias("band"),
    )


# --- P7 ---------------------------------------------------------------------
def upload_summary(files: DataFrame, group_col: str, path_col: str, size_col: str,
                   accepted_col: str, preview: int = 8) -> DataFrame:
    """Per submission: number of files, total size, skipped count and a preview of
    the first ``preview`` skipped names (sorted) with '...' when more.

    The preview is cut with a per-group top-k window before anything is
    collected, so a huge submission never gathers its names in one task."""
    totals = files.groupBy(group_col).agg(
        F.count(F.lit(1)).cast("long").alias("n_files"),
        F.sum(size_col).cast("long").alias("total_bytes"),
        F.count(F.when(~F.col(accepted_col), F.lit(1))).cast("long").alias("n_skipped"),
    )
    w = Window.partitionBy(group_col).orderBy(path_col)
    first = (files.where(~F.col(accepted_col)).select(group_col, path_col)
             .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= preview)
             .groupBy(group_col).agg(F.array_sort(F.collect_list(path_col)).alias("_sk")))
    g = totals.join(first, group_col, "left")
    pv = F.array_join(F.transform(F.coalesce(F.col("_sk"), F.array().cast("array<string>")),
                                  lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return g.select(group_col, "n_files", "total_bytes", "n_skipped",
                    F.when(F.col("n_skipped") > preview, F.concat(pv, F.lit("..."))).otherwise(pv)
                    .alias("skipped_preview"))
