"""The stored index under changes against a rebuilt one; scans that read stored results; files of a tree."""

import re
import uuid

from pyspark.sql import functions as F

from copyhound.operators import admit as A
from copyhound.operators import lookup as L
from copyhound.operators.index_store import StoredIndex
from copyhound.operators.rescan import rescan
from copyhound.session import scratch_path

SCHEMA = "corpus_id string, language string, content string, indexed_at long"


def rows(spark, *files):
    return spark.createDataFrame([(i, "python", text, at) for i, text, at in files], SCHEMA)


def postings(df):
    return sorted(map(tuple, df.select("term", "language", "corpus_id", "indexed_at").collect()))


def test_changes_give_what_a_rebuilt_index_has(spark):
    index = StoredIndex(spark, buckets=4)
    index.change(rows(spark, ("a", "x.y z", 1), ("b", "x b", 2), ("c", "x c", 3)))
    index.change(rows(spark, ("d", "x d", 4), ("b", "y b2", 5)), spark.createDataFrame([("c",)], "corpus_id string"))
    want = rows(spark, ("a", "x.y z", 1), ("b", "y b2", 5), ("d", "x d", 4))
    assert postings(index.live()) == postings(L.build_term_index(want))
    index = index.compacted()
    assert postings(index.live()) == postings(L.build_term_index(want))
    index.change(rows(spark, ("c", "again", 6), ("a", "a3", 7)), spark.createDataFrame([("d",), ("unknown",)], "corpus_id string"))
    index.change(rows(spark, ("a", "a4", 8)))
    assert postings(index.live()) == postings(L.build_term_index(rows(spark, ("a", "a4", 8), ("b", "y b2", 5), ("c", "again", 6))))


def test_parts_of_names_are_searched_for_only_in_texts_that_have_any(spark):
    texts = ["plain x1 1abc", "a.b.c x..y .d e. 1.f2", "$ $a b$1c d$$e", "m.n$o.p q", "", None]
    df = spark.createDataFrame([(str(i), "python", t, i) for i, t in enumerate(texts)], SCHEMA)
    want = sorted({(term, "python", str(i), i) for i, t in enumerate(texts) for p in (L.TOKEN, *L.PARTS) for term in re.findall(p, t or "")})
    got = L.build_term_index(df)
    assert postings(got) == want
    assert "contains" in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_lookup_does_not_move_the_postings(spark):
    index = StoredIndex(spark, buckets=4)
    index.change(rows(spark, *[(f"f{i}", f"common t{i % 7}", i) for i in range(200)]))
    terms = spark.createDataFrame([("p", 1, "common", "python"), ("p", 1, "t3", "python")], "path string, block_id int, term string, language string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = L.lookup_terms(terms, index.live(), ["path", "block_id"], 3)
        plan = hits._jdf.queryExecution().sparkPlan().toString() + hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.term, r.corpus_id) for r in hits.collect()) == [("common", "f197"), ("common", "f198"), ("common", "f199"), ("t3", "f185"), ("t3", "f192"), ("t3", "f199")]
    lines = plan[plan.index("AdaptiveSparkPlan"):].split("\n")
    depth = lambda line: re.search(r"[A-Z]", line).start()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    above, level = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if line.strip() and depth(line) < level:
            level = depth(line)
            above.append(line)
        if "SortMergeJoin" in line:
            break
    assert not any("Exchange" in line for line in above)


def test_a_scan_checks_only_what_is_not_stored(spark):
    files = spark.createDataFrame([(f"p{i}", "python", f"x = {i}  # c") for i in range(6)], "path string, language string, code string")
    store, checked = scratch_path(spark, f"store/test_{uuid.uuid4().hex[:8]}"), []

    def check(missing):
        checked.append(sorted(r.path for r in missing.collect()))
        found = missing.where("path <> 'p1'")  # p1 has no match
        return found.select("path", F.concat(F.lit("u/"), "path").alias("url"), F.lit(0.5).alias("similarity"), F.lit(1).alias("match_rank"))

    def scan(df, version, name):
        return sorted((r.path, r.url, r.from_store) for r in rescan(df, store, version, check, name).collect())

    assert scan(files.where("path < 'p3'"), "v1", "a") == [("p0", "u/p0", False), ("p2", "u/p2", False)]
    assert [r[2] for r in scan(files, "v1", "b")] == [True, True, False, False, False]
    comment = files.withColumn("code", F.regexp_replace("code", "# c", "# other"))  # the same normalized code
    assert all(r[2] for r in scan(comment, "v1", "c"))
    changed = files.withColumn("code", F.when(F.col("path") == "p4", "y").otherwise(F.col("code")))
    assert [r[0] for r in scan(changed, "v1", "d") if not r[2]] == ["p4"]
    assert not any(r[2] for r in scan(files, "v2", "e"))
    assert checked == [["p0", "p1", "p2"], ["p3", "p4", "p5"], [], ["p4"], [f"p{i}" for i in range(6)]]


def test_files_of_a_tree(spark, tmp_path):
    for name, data in {"a.py": b"x = 1", "sub/deep/b.py": "é".encode(), "sub/c.py": b"caf\xe9", "sub/d.txt": b"no", "e.js": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = sorted(map(tuple, A.read_files(spark, str(tmp_path), "*.py").collect()))
    assert got == [("a.py", 5, "utf-8", "x = 1"), ("sub/c.py", 4, "latin-1", "café"), ("sub/deep/b.py", 2, "utf-8", "é")]
    assert sorted(r.path for r in A.read_files(spark, f"file://{tmp_path}/", strict_utf8=True).collect()) == ["a.py", "sub/d.txt", "sub/deep/b.py"]


def test_a_frequent_term_is_dealt_to_several_tasks(spark, tmp_path):
    """M4: the postings of a word that all files hold aren't one task's."""
    from copyhound.plans import catalog

    catalog.load_all()
    spark.range(400).selectExpr("id AS p_partkey", "'red ring' AS p_name", "cast(id AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "X")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    merged = "spark.sql.adaptive.coalescePartitions.enabled"  # so small a table would be put together again
    spark.conf.set(merged, "false")
    try:
        rows = catalog.QUERIES["m4_inverted_index"](spark, str(tmp_path)).where("term = 'return' and language = 'python'")
    finally:
        spark.conf.set(merged, "true")
    assert rows.count() == 400
    assert rows.select(F.input_file_name().alias("f")).distinct().count() > 1
