"""Admission fixtures: Q12-Q15, F4, F5, S1 decoding."""

from pyspark.sql import functions as F

from copyhound.operators import admit as A


def test_language_and_extension(spark):
    rows = [("a.PY",), ("x/.py",), ("x/.hidden.py",), ("lib.h",), ("noext",), ("a.tar.ZIP",), ("a.txt",)]
    df = spark.createDataFrame(rows, "path string")
    got = {r.path: (r.allowed, r.lang) for r in df.select(
        "path", A.allowed_ext("path").alias("allowed"), A.detect_language("path").alias("lang")).collect()}
    assert got["a.PY"] == (True, "python")
    assert got["x/.py"] == (True, None)          # dot-file passes the list, has no language
    assert got["x/.hidden.py"] == (True, "python")
    assert got["lib.h"] == (True, "c")           # first registry entry wins
    assert got["noext"] == (False, None)
    assert got["a.tar.ZIP"][0] is True
    assert got["a.txt"] == (False, None)


def test_size_guard_blocks_whole_submission(spark):
    rows = [("s1", "a.py", 3145728), ("s1", "b.py", 10), ("s2", "c.py", 3145729), ("s2", "d.py", 1)]
    df = spark.createDataFrame(rows, "submission_id string, path string, length long")
    got = {r.path: r.blocked for r in A.size_guard(df).collect()}
    assert got == {"a.py": False, "b.py": False, "c.py": True, "d.py": True}


def test_content_and_tags(spark):
    rows = [("ok", "x" * 100000), ("long", "y" * 100001 + "\nz"), ("ev", "eval (x)\nos.popen('ls')")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.valid, r.tags) for r in df.select(
        "path", A.valid_content("text").alias("valid"), A.suspicious_tags("text").alias("tags")).collect()}
    assert got["ok"] == (True, "")
    assert got["long"][0] is False
    assert got["ev"] == (True, "eval,os_popen")


def test_decode_utf8_else_latin1(spark):
    df = spark.createDataFrame([(bytearray("café".encode()),), (bytearray(b"caf\xe9"),)], "content binary")
    got = [tuple(r) for r in df.select(A.decode_text("content"), A.encoding("content")).collect()]
    assert got == [("café", "utf-8"), ("café", "latin-1")]


def test_a_wide_tree_is_listed_in_few_tasks(spark, tmp_path):
    for j in range(150):
        (tmp_path / f"a={j % 2}" / f"b={j}").mkdir(parents=True)
        (tmp_path / f"a={j % 2}" / f"b={j}" / "f.txt").write_text(f"text {j}")
    group = "listing-test"
    before = spark.conf.get(A.LISTING_TASKS)
    spark.sparkContext.setJobGroup(group, "listing")
    files = A.read_files(spark, str(tmp_path), "*.txt")  # loading lists the tree
    tracker = spark.sparkContext.statusTracker()
    sizes = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("other", "")
    assert sizes and max(sizes) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(A.LISTING_TASKS) == before
    assert sorted(r.text for r in files.collect()) == sorted(f"text {j}" for j in range(150))
