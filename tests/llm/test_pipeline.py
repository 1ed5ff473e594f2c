"""The pipeline against a brute-force version, on documents whose lines are known to recur or not."""

import math
import random

import pytest

import corpus_pipeline
from loamgrid.llm import packing, quality_rules
from tests.llm.test_ngram_join import brute

R = random.Random(21)
WORDS = [a + b + c for a in "bdfgklmnpr" for b in "aeiou" for c in "lmnrst"]
PROSE = [" ".join(R.choice(WORDS) for _ in range(60)) for _ in range(30)]
RECURRING = "printed by the house of records for all"
ITEM = " ".join(R.choice(WORDS) for _ in range(20))


def changed(text, n):
    words = text.split()
    for i in range(n):
        words[7 * i + 3] = f"new{i}"
    return " ".join(words)


def texts():
    out = [f"{p}\n{RECURRING}" for p in PROSE]
    out += [PROSE[0], changed(PROSE[1], 1), changed(PROSE[2], 6)]  # a copy, a near copy, another text
    out += [f"{PROSE[3]} {ITEM} {PROSE[4]}", "too short", None, "", " \n", f"{PROSE[5]}\nclick here to read more of this", "# $ % " * 30]
    return out


def plain():
    """Brute force: (doc_id, text) that the first four stages keep."""
    rows = []
    for i, t in enumerate(texts()):
        verdict = quality_rules.judge((t or "").encode())
        if verdict[-2]:
            rows.append((i, "\n".join(line for line in verdict[-1].decode().split("\n") if line != RECURRING)))
    labels = brute([t for _, t in rows], 5, 80)
    rows = [row for k, (row, (_, top)) in enumerate(zip(rows, labels, strict=True)) if top == k]
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    return [(i, t) for i, t in rows if len(grams(t) & grams(ITEM)) < math.ceil(0.8 * len(grams(ITEM)))]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs(texts()).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_matches_brute_force(spark, folder):
    ids_of = packing.token_ids(packing.default_tokenizer())
    want = {i: len(ids_of.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in plain()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["length"] for r in got} == want
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert {30, 31, 33, 34, 35, 36, 37, 39}.isdisjoint(want) and 32 in want


def test_stages_keep_columns(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, table, folder).columns == table.columns
    assert corpus_pipeline.STAGES[3][1](spark, table, folder).columns == table.columns
