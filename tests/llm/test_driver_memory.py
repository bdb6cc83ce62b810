"""What the driver keeps of finished work."""

import re
import sys
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import quality, toxicity
from tracewright.llm.common import give_back


@pytest.mark.skipif(sys.platform != "linux", reason="malloc's memory is handed back by a command of the JVM on Linux only")
def test_native_memory_is_given_back(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    anonymous = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024
    # 270 KB of malloc each; those that stay keep the others' from being handed back by free.
    held = [jvm.java.util.zip.Deflater() for _ in range(400)]
    for i, d in enumerate(held):
        if i % 10:
            d.end()
    for _ in range(3):
        jvm.System.gc()
    before = anonymous()
    give_back(spark)
    assert anonymous() < before - 40
    for d in held:
        d.end()


def test_training_rows_stay_out_of_lists(spark, monkeypatch):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 3000), x -> concat('w', (x * 7919 + id) % 200000)))").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3).alias("grade"), (F.col("doc_id") % 2).alias("toxic"))
    got = []

    def fitted(*args, **more):
        got.append((tracemalloc.get_traced_memory()[1], args))

    for module, features, most in ((quality, lambda a: len(a[0].idx), 45), (toxicity, lambda a: sum(map(len, [*a[0], *a[1]])), 10)):
        monkeypatch.setattr(module, "fit_rows", fitted)
        tracemalloc.start()
        module.train(docs, labels)
        tracemalloc.stop()
        peak, args = got.pop()
        assert features(args) > 400_000
        assert peak < most * features(args)  # bytes


def test_lists_of_a_column():
    from tracewright.llm.hashed import lists

    column = pa.chunked_array([pa.array([[9], [1, 2], []], pa.list_(pa.int32())).slice(1), pa.array([[3]], pa.list_(pa.int32()))])
    for c, expected in ((column, [[1, 2], [], [3]]), (column.slice(0, 2), [[1, 2], []]), (pa.chunked_array([], pa.list_(pa.float32())), [])):
        assert [x.tolist() for x in lists(c)] == expected
