from pyspark.sql import functions as F

from copyhound.plans.passages import copied_passages
from copyhound.streaming.check_stream import check_stream


def test_an_arrival_is_read_by_all_cores_and_micro_batches_change_no_row(spark, tmp_path, monkeypatch):
    from copyhound.streaming import check_stream as Z3

    home = str(tmp_path / "tables")
    item = " ".join(f"word{i}" for i in range(40))
    spark.createDataFrame([(i, "s", f"{item} tail{i}" if i % 3 else "short") for i in range(300)], "doc_id long, source string, text string").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([("a", item), ("b", "other " * 20)], "item_id string, text string").write.parquet(f"{home}/benchmark.parquet")
    seen = []
    plain = Z3.copied_from
    monkeypatch.setattr(Z3, "copied_from", lambda d, *more: seen.append(d) or plain(d, *more))
    files = {}
    monkeypatch.setattr(Z3, "scratch_path", lambda s, name: files.setdefault("home", str(tmp_path / "stream")))
    got = check_stream(spark, home, 2)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(got) == rows(copied_passages(spark, home).select(*got.columns)) and got.count() == 200
    assert spark.read.parquet(f"{files['home']}/landed").select(F.input_file_name()).distinct().count() == 2 * spark.sparkContext.defaultParallelism
    assert len(seen) == 3  # two arrivals, and an empty one for the schema
