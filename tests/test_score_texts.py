"""score_texts reads its candidate pairs once: the search behind them is long."""

from copyhound.plans import code_check as CC


def test_pairs_are_read_once(spark, tmp_path):
    path = str(tmp_path / "asked")
    spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 10)], "a long, b long").write.parquet(path)
    left = spark.createDataFrame([(1, "x y z w"), (2, "x y z w"), (3, "q")], "a long, norm string")
    right = spark.createDataFrame([(10, "x y z v"), (11, "x y z w")], "b long, norm string")
    scored = CC.score_texts(spark.read.parquet(path), left, right, ["a"], ["b"], 3)
    assert sorted((r.a, r.b, r.similarity) for r in scored.collect()) == [(1, 10, 0.5), (1, 11, 1.0), (2, 10, 0.5), (3, 10, 0.0)]
    assert not any(path in f for f in scored.inputFiles())
