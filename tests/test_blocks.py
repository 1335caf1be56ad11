"""Block extraction fixtures: expected blocks written out by hand (B2, brace quirks, C heads, B7)."""

import random
import time

from pyspark.sql import functions as F

from copyhound.operators import blocks as B

# (code, blocks in extraction order: type, name, line)
PYTHON = [
    ("import os\nclass A:\n    def f(self, x):\n        for i in x:\n            if i:\n                return i\n"
     "        return 0\n    async def g(self):\n        pass\n\ndef h(y):\n    while y:\n        y -= 1\n"
     "    if y > 2:\n        y = 1\n    elif y < 0:\n        y = 2\n    else:\n        y = 3\n    return y\n",
     [("method", "A.f", 3), ("function", "h", 11), ("function", "f", 3), ("logic", "logic_block_12", 12),
      ("logic", "logic_block_14", 14), ("logic", "logic_block_4", 4), ("logic", "logic_block_16", 16),
      ("logic", "logic_block_5", 5)]),
    ("x = 1\nif x:\n    print(x)\nfor k in range(3):\n    def inner(z):\n        return z\n",
     [("logic", "logic_block_2", 2), ("logic", "logic_block_4", 4), ("function", "inner", 5)]),
    # elif chains nest, an except clause is a step, an else of try is not
    ("def a(n):\n    if n:\n        while n:\n            n -= 1\n    elif n > 1:\n        for i in n:\n            pass\n"
     "    elif n > 2:\n        if i:\n            pass\n    else:\n        while i:\n            pass\n    for q in n:\n"
     "        pass\ntry:\n    if a:\n        pass\nexcept E:\n    for z in a:\n        pass\nelse:\n    while 1:\n        pass\n"
     "class B:\n    x = 1\n    def m(self):\n        def k():\n            pass\n        return k\n    class C:\n"
     "        def d(self):\n            pass\n",
     [("function", "a", 1), ("method", "B.m", 27), ("logic", "logic_block_2", 2), ("logic", "logic_block_14", 14),
      ("logic", "logic_block_17", 17), ("logic", "logic_block_23", 23), ("function", "m", 27), ("method", "C.d", 32),
      ("logic", "logic_block_3", 3), ("logic", "logic_block_5", 5), ("logic", "logic_block_20", 20), ("function", "k", 28),
      ("function", "d", 32), ("logic", "logic_block_6", 6), ("logic", "logic_block_8", 8), ("logic", "logic_block_9", 9),
      ("logic", "logic_block_12", 12)]),
]


def test_python_blocks(spark):
    df = spark.createDataFrame([(i, s, "python") for i, (s, _) in enumerate(PYTHON)], "id int, code string, language string")
    rows = B.block_rows(df, ["id"]).orderBy("id", "block_id").collect()
    for i, (_, want) in enumerate(PYTHON):
        assert [(r.block_type, r.name, r.line_start) for r in rows if r.id == i] == want
    text = {(r.id, r.name): r.code for r in rows}
    assert text[0, "f"] == "def f(self, x):\n    for i in x:\n        if i:\n            return i\n    return 0"
    assert text[0, "logic_block_14"] == "if y > 2:\n    y = 1\nelif y < 0:\n    y = 2\nelse:\n    y = 3"
    assert text[0, "logic_block_16"] == "elif y < 0:\n    y = 2\nelse:\n    y = 3"


def test_python_blocks_of_a_long_file(spark):
    one = "def f{0}(x):\n    if x:\n        for i in x:\n            pass\n    return x\n"
    df = spark.createDataFrame([(1, "".join(one.format(k) for k in range(4000)), "python"), (2, None, "python"), (3, "", "python")],
                               "id int, code string, language string")
    began = time.time()
    assert B.block_rows(df, ["id"]).count() == 12000
    assert time.time() - began < 60


def test_c_head_keeps_every_word(spark):
    head = "a static inline const unsigned long long int foo(int a) { return a; }"
    prose = "word " * 36000 + "bar(int b)\n{ return b; }"
    df = spark.createDataFrame([(1, "c", "x = 1;\n\n" + head + "\n" + head.replace("foo", "two")), (2, "c", "y;\n" + prose)], "id int, language string, code string")
    rows = B.block_rows(df, ["id"]).orderBy("id", "block_id").collect()
    assert [(r.name, r.line_start) for r in rows] == [("foo", 3), ("two", 4), ("bar", 2)]
    assert rows[0].code == head and rows[2].code == prose.strip()


def test_brace_quirks(spark):
    js = "function foo(a,b){ if(a){return b;} return a; }\nclass K { run(n) { return n; } }"
    java = "class Main {\n  public int getX() { return x; }\n  int work(int a) {\n  if (a) {\n a++;\n a++;\n a++;\n }\n}\n}"
    c = "static int _hid(int a) { return a; }\nint main() { return 0; }\nint keep(int a) { return a; }"
    df = spark.createDataFrame([("javascript", js), ("java", java), ("c", c)], "language string, code string")
    got = {}
    for r in B.block_rows(df.withColumn("id", F.col("language")), ["id"]).collect():
        got.setdefault(r.language, []).append((r.block_type, r.name, r.code))
    # Q1: the block ends at the first '}'; Q2: class methods never appear in 'first' mode
    assert got["javascript"] == [("function", "foo", "function foo(a,b){ if(a){return b;}")]
    # getX dropped by name, class Main dropped, 'work' kept, cut at the first '}' (Q1)
    names = [n for _, n, _ in got["java"]]
    assert "getX" not in names and "Main" not in names and "work" in names
    assert [n for _, n, _ in got["c"]] == ["keep"]


def test_generic_paragraphs(spark):
    marked = "a\u0001\nb\nc\n\n"          # control characters are ordinary text
    row = B.block_rows(spark.createDataFrame([(1, "go", marked)], "id int, language string, code string"), ["id"]).collect()
    assert [r.code for r in row] == ["a\u0001\nb\nc"]
    go = "a\nb\nc\n\nd\ne\n\nf\ng\nh"      # 3-line block kept, 2-line dropped, tail unterminated dropped
    df = spark.createDataFrame([(1, "go", go)], "id int, language string, code string")
    rows = B.block_rows(df, ["id"]).collect()
    assert [(r.name, r.code, r.line_start) for r in rows] == [("block_0", "a\nb\nc", 1)]


def test_balanced_blocks(spark):
    js = ("function foo(a) {\n  if (a) { return {x: 1}; }\n  function bar(b) { return b; }\n}\n"
          "class K extends L {\n  run(n) { return { n }; }\n  stop() {}\n}\nconst f = (x) => { return x; };\nfunction open(z) {")
    c = "static int one(int a) { while (a) { a--; } return a; }\nint two(void) {\n}"
    df = spark.createDataFrame([(1, "javascript", js), (2, "c", c)], "id int, language string, clean string")
    got = {(r.block_type, r.name): (r.line_start, r.code) for r in B.balanced_blocks(df, ["id"]).collect()}
    assert got == {
        ("function", "foo"): (1, "function foo(a) {\n  if (a) { return {x: 1}; }\n  function bar(b) { return b; }\n}"),
        ("class", "K"): (5, "class K extends L {\n  run(n) { return { n }; }\n  stop() {}\n}"),
        ("method", "K.run"): (6, "run(n) { return { n }; }"),
        ("method", "K.stop"): (7, "stop() {}"),
        ("arrow_function", "f"): (9, "const f = (x) => { return x; }"),
        ("function", "one"): (1, "one(int a) { while (a) { a--; } return a; }"),
        ("function", "two"): (2, "two(void) {\n}"),
        ("function", "bar"): (3, "function bar(b) { return b; }"),
    }


def test_running_results_and_a_file_of_very_many_blocks(spark):
    from pyspark.sql import functions as F

    from copyhound.functions import text as T
    from copyhound.operators import blocks as B

    sums = T.running(F.sequence(F.lit(1), F.lit(1000)), lambda a, x: a + x, 0)
    most = T.running(F.array(*[F.lit(x) for x in (3, 1, 4, 1, 5)]), F.greatest, 0)
    r = spark.range(1).select(sums.alias("s"), most.alias("m"), T.running(F.array().cast("array<int>"), lambda a, x: a + x, 0).alias("e")).first()
    assert r.s == [k * (k + 1) // 2 for k in range(1, 1001)] and r.m == [3, 3, 4, 4, 5] and r.e == []
    code = "\n\n".join(f"function f{i}(a) {{\n return a; }}" for i in range(200_000))
    b = spark.createDataFrame([(code,)], "c string").select(F.explode(B.blocks_js(F.col("c"))).alias("b"))
    assert tuple(b.agg(F.count("*"), F.max("b.line_start"), F.sum(F.expr("b.line_start % 3")).cast("int")).first()) == (200_000, 599_998, 200_000)


def test_jvm_forms_find_the_same_matches(spark):
    """Random texts of the patterns' own pieces: the matches and names of the backtracking forms."""
    draw = random.Random(3)
    pieces = ["public", "private", "internal", "static", "final", "virtual", "override", "class", "function", "throws", "extends", "implements", "A", "foo", "x9", "9", "_b",
              "List<T>", "[]", " ", " ", "  ", "\n", "\n\t", "(", ")", "(a)", "() {", "{", "}", "{ return; }", "(int a) { b(); }", ",", ";", "="]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 25))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, form in B.JVM_FORM.items():
        found = lambda p: F.struct(*[F.regexp_extract_all("t", F.lit(p), F.lit(g)).alias(f"g{g}") for g in (0, 1)], F.split("t", p, -1).alias("gaps"))
        rows = df.select("t", found(pattern).alias("plain"), found(form).alias("form"))
        assert rows.where("plain <> form").limit(3).collect() == []
        assert rows.where("size(form.g0) > 0").count() > 5


def test_long_indentation_is_no_work(spark):
    """The backtracking forms take the fourth power of an indentation's length: years for this one."""
    code = " " * 20000 + "x = 1\n" + " " * 3000 + "int f(int a) {\n g(); h(); i();\n j();\n k(); }\n" + "w" * 20000
    row = spark.createDataFrame([(code,)], "t string").select(B.blocks_csharp(F.col("t")).alias("c"), B.blocks_java(F.col("t")).alias("j")).first()
    assert [b["name"] for b in row["c"]] == [b["name"] for b in row["j"]] == ["f"]


def test_python_blocks_broadcast_nothing(spark, tmp_path):
    """Rows made of a small file may be many: none of them pass through the driver."""
    spark.range(50).selectExpr("id AS path", "concat('class A:', chr(10), '  def f', id, '(self):', chr(10), '    return 1') AS code", "'python' AS language").write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    blocks = B.block_rows(files, ["path"])
    for made in (blocks, B.extraction_summary(files, blocks, ["path"])):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert blocks.count() == 100


def test_balanced_blocks_look_for_the_enclosing_class_in_one_join(spark):
    js = "class A {\n  run(n) { return n; }\n}\nclass B {\n  class C {\n    go(n) { return n; }\n  }\n}\nfunction f(a) {}\n"
    df = spark.createDataFrame([(1, "javascript", js), (2, "javascript", "} function g() {} } class D { stop() {} }")], "id int, language string, clean string")
    found = B.balanced_blocks(df, ["id"])
    assert sorted((r.id, r.block_type, r.name, r.line_start) for r in found.collect()) == [
        (1, "class", "A", 1), (1, "class", "B", 4), (1, "class", "C", 5), (1, "function", "f", 9), (1, "method", "A.run", 2), (1, "method", "C.go", 6),
        (2, "class", "D", 1), (2, "function", "g", 1), (2, "method", "D.stop", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join LeftOuter") == 1
