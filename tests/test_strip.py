"""py_strip takes the characters of WHITE off both ends, without a regex."""

import re

from pyspark.sql import functions as F

from copyhound.functions import text as T

TEXTS = ["", " ", "a", "  a b\t", "\u3000\u2003x\u00a0y\u2028\n", "\x1c\x1f\x85z\x85\x0b\x0c\r", "\u200bkept\u200b", "\ufeff b", "\u1680\u205f\u202f", "é ", "\u2000😀\u200a", "\x00 a \x00"]


def test_white_chars():
    pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", T.WHITE).replace(r"\s", r" \t\n\x0b\f\r")
    assert sorted(T.WHITE_CHARS) == [chr(c) for c in range(0x10000) if re.fullmatch(pattern, chr(c))]


def test_py_strip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "id int, t string")
    got = {r.id: (r.a, r.b) for r in df.select("id", T.py_strip("t").alias("a"), T.rx_replace("t", rf"\A{T.WHITE}+|{T.WHITE}+\z", "").alias("b")).collect()}
    assert all(a == b for a, b in got.values()) and got.pop(99) == (None, None)
    assert [got[i][0] for i in range(len(TEXTS))] == [t.strip(T.WHITE_CHARS) for t in TEXTS]
    assert "regexp" not in df.select(T.py_strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
