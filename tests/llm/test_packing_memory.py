"""What packing holds at once: few documents within a task, and one shuffle of the pieces for their numbers."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from loamgrid.llm import packing
from loamgrid.llm.ranks import numbered


def test_few_documents_are_tokenized_at_once():
    seen = []

    def read():
        for k in (700, 0, 300):
            seen.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), pa.array(["a b " * (i % 3) for i in range(k)])], names=["doc_id", "text"])

    out = packing._cut(packing.default_tokenizer(), 4, packing.END_ID, True)(read())
    first = next(out)
    assert seen == [700] and len(set(first["doc_id"].to_pylist())) == packing.SOME
    rest = list(out)
    assert all(len(set(b["doc_id"].to_pylist())) <= packing.SOME for b in rest)
    assert [i for b in [first, *rest] for i, p in zip(b["doc_id"].to_pylist(), b["piece"].to_pylist(), strict=True) if p == 0] == [*range(700), *range(300)]


def test_pieces_are_dealt_out_once(spark, docs):
    packed = packing.pack(packing.stash(packing.pieces(docs(["a b c", "d", None] * 50), packing.default_tokenizer(), with_ids=False)))
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(length#\d+L, __salt#\d+, ", plan)) <= 2  # the pieces, and the counts of parts
    assert "coalesce(length" not in plan and "isnull(length" not in plan
    assert sorted(r["offset"] for r in packed.where("sequence_id = 0").collect())[0] == 0


def test_numbers_without_null_keys(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("k"))
    got = numbered(rows, ["k"], [F.col("id")], "n", nulls=False).groupBy("k").agg(F.sort_array(F.collect_list("n")).alias("n"), F.count("*").alias("c")).collect()
    assert len(got) == 7
    assert all(r["n"] == list(range(r["c"])) for r in got)
