"""op5: what a worker holds at a time follows its block of text, not the batch that Spark sends."""

import tracemalloc

import numpy as np
import pyarrow as pa

from copyhound.llm import blocks as B
from copyhound.llm import op5_language as O

WORDS = "the quick brown fox jumps over a lazy dog and über café Ελλάδα мир".split()


def texts(n):
    rng = np.random.default_rng(5)
    return pa.array([" ".join(rng.choice(WORDS, 700)) for _ in range(n)])


class Taken:
    def __init__(self):
        self.sizes, self.plain = [], B.text_blocks

    def __call__(self, column, *limit):
        for i, j, data, off in self.plain(column, *limit):
            self.sizes.append(len(data))
            yield i, j, data, off


def test_blocks_are_small(spark, monkeypatch):
    column = texts(1000)  # 4 MB
    taken, tasks = Taken(), []
    monkeypatch.setattr(B, "text_blocks", taken)
    docs = spark.createDataFrame([(0, "a b", "en")], "doc_id int, text string, lang string")
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: tasks.append(f) or plain(self, f, schema))
    model = O.LanguageModel(["en"], np.zeros(1), np.zeros((len(O.ORDERS) << O.BUCKET_BITS, 1), np.float32))
    O.predict(docs.select("doc_id", "text"), model)
    O.letter_table()
    tracemalloc.start()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(column))), column], names=["doc_id", "text"])
    got = [b for b in tasks[0](iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in got) == len(column)
    assert max(taken.sizes) <= O.BLOCK_BYTES and peak < 80 << 20
