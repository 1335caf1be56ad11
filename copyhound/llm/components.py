"""Connected components of links, by hash-to-minimum with pointer jumping. Nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyhound.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of edges (a, b): label is the smallest vertex that it can reach.

    Each round gives every vertex the least label around it, then that label's own label. Sums and minima are taken
    before rows move, so a vertex of very high degree is no hot spot. Every round is written to the shared folder."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        least = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
        step = stored(least.join(jump, "label", "left").select("v", "old", F.coalesce("next", "label").alias("label")), "labels")
        if step.where("old <> label").isEmpty():
            return step.select("v", "label")
        labels = step.select("v", "label")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (v, label) after further links (a, b): the links are contracted to the present labels first."""
    if labels is None:
        return components(links)
    of = lambda c: labels.select(F.col("v").alias(c), F.col("label").alias(f"{c}_label"))
    seen = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    seen = seen.select("a", "b", F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y"))
    classes = components(seen.select(F.col("x").alias("a"), F.col("y").alias("b")))
    known = labels.union(seen.select("a", "x").union(seen.select("b", "y"))).distinct()
    moved = known.join(classes.select(F.col("v").alias("label"), F.col("label").alias("new")), "label", "left")
    return stored(moved.select("v", F.coalesce("new", "label").alias("label")), "labels")
