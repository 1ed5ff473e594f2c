"""Null and repeated ids, empty and very long texts, clashing columns, through the operators; each row must come out as told."""

import random
import zlib

import pytest

from loamgrid.llm import decontamination, html_extraction, line_dedup, lm_scoring, packing, pii, quality_rules, sharding, toxicity

R = random.Random(4)
LONG = " ".join(R.choice(["river", "stone", "you", "over", "under", "the"]) + R.choice(["", ".", ","]) for _ in range(60_000))
TEXT = "The quick brown fox, as they say, jumps over the lazy dog near the river bank while you watch it from the old stone bridge."
ROWS = [(None, TEXT), (None, TEXT), (None, None), (7, TEXT), (7, TEXT), (7, "other words"), (8, ""), (9, LONG), (10, None), (10, "\n \n")]
MORE = "lang string, source string, n_chars long, n_dropped_lines string, size string, score string, lines string, length string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "en", "s", 1, "x", "y", "z", "w", "v") for r in ROWS], f"doc_id long, text string, {MORE}")


def ids(rows, column="doc_id"):
    return sorted((r[column] for r in rows), key=str)


EVERY = sorted((i for i, _ in ROWS), key=str)


def test_quality_and_pii(spark, odd):
    rows = quality_rules.quality_verdicts(odd).collect()
    assert ids(rows) == EVERY and {r["n_words"] for r in rows if r["doc_id"] == 9} == {60_000}
    assert sorted(r["n_words"] for r in rows if r["doc_id"] is None) == [0, 25, 25]
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert ids(pii.find_pii(odd).collect()) == EVERY and quality_rules.quality_verdicts(odd.limit(0)).count() == pii.find_pii(odd.limit(0)).count() == 0
    spans = pii.find_pii(spark.createDataFrame([(None, "a@b.co " * 20_000), (3, "mail a@b.co"), (3, "mail a@b.co")], "doc_id long, text string"))
    assert spans.count() == 3


def test_packing(spark, odd):
    rows = packing.pack(packing.pieces(odd, packing.default_tokenizer(), with_ids=False)).collect()
    assert ids([r for r in rows if r["piece"] == 0]) == EVERY
    assert {r["length"] for r in rows if r["doc_id"] == 8} == {1} and sum(r["length"] for r in rows if r["doc_id"] == 9) > 60_000


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(1, "jumps over the lazy dog near the river bank while you watch it from the old stone bridge"), (1, LONG), (None, "fox as they say jumps over the lazy dog near the river bank"), (2, None), (3, "")], "item_id long, text string")
    found = [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(odd, bench).select("doc_id", "item_id").collect()]
    assert sorted(found, key=str) == sorted([(i, j) for i in (None, None, 7, 7) for j in (1, None)] + [(9, 1)], key=str)
    assert ids(decontamination.drop_contaminated(odd, bench).collect()) == sorted([None, 7, 8, 10, 10], key=str)
    assert decontamination.contaminated(odd, bench.limit(0)).count() == 0


def test_line_dedup_and_scores(spark, odd):
    rows = line_dedup.drop_recurring_lines(odd, counted=True).collect()
    assert ids(rows) == EVERY and {r["n_dropped_lines"] for r in rows} == {0}
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in rows) == sorted((str(i), str(t)) for i, t in ROWS)
    told = lm_scoring.scores(odd).collect()
    assert ids(told) == EVERY and {r["n_tokens"] for r in told if r["doc_id"] == 9} == {60_001} and not any(r["held_out"] for r in told if r["doc_id"] is None)


def test_recurring_lines_go_from_rows_of_any_id(spark):
    body = lambda i: " ".join("".join(R.choice("abcdefghij") for _ in range(6)) for _ in range(12))
    long = "Subscribe to our letter " + "today " * 40_000
    rows = [(i if i % 5 else None, f"{body(i)}\n{long}\n\n{body(i + 900)}") for i in range(24)]
    rows += rows[1:2]
    got = line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), counted=True).collect()
    assert len(got) == 25 and all(r["n_dropped_lines"] == 1 and "Subscribe" not in r["text"] and "\n\n" in r["text"] for r in got)


def test_toxicity(spark, odd):
    texts = [(100 + i, f"you are a {R.choice(['nice', 'kind'])} person {i} of words" if i % 2 else f"you stupid idiot, you are an idiot {i}") for i in range(400)]
    docs = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(*t, "s") for t in texts], "doc_id long, text string, score string"))
    labels = spark.createDataFrame([(100 + i, int(i % 2 == 0)) for i in range(400)] + [(None, 1), (100, 0), (7, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS) + 400 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    own = [(r["doc_id"], r["score"]) for r in rows if r["held_out"] and r["doc_id"] >= 100]
    assert sum(a > b for i, a in own for j, b in own if i % 2 == 0 and j % 2) > 0.95 * sum(1 for i, _ in own for j, _ in own if i % 2 == 0 and j % 2)
    nulls = [r["score"] for r in rows if r["doc_id"] is None]
    assert len(nulls) == 3 and len({round(s, 9) for s in nulls}) <= 2  # equal texts, equal scores


def test_sharding(spark, odd):
    big = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, "a text of many copies") for i in range(60)], "doc_id long, text string"))
    rows = sharding.shards(big, n_shards=5).collect()
    assert len(rows) == 70 and sorted(r["slot"] for r in rows) == sorted(list(range(14)) * 5)  # 60 copies are more than a shard holds
    assert sharding.shards(big.limit(0), n_shards=5).count() == 0


def test_pages(spark):
    lines = "".join(f"<p>line {i} of a long page</p>" for i in range(20_000))
    rows = [(None, None, "<p>a</p>", "x"), (1, "http://h.org/a/1", f"<article>{lines}</article>", "x"), (1, "http://h.org/a/1", f"<article>{lines}</article>", "x"), (2, "http://h.org/a/2", "<article><p>line 3 of a long page</p></article><p>end</p>", "x")]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, lines string")).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got)[0][0] == "1" and len(got) == 4
    assert {len(r["text"].split("\n\n")) for r in got if r["page_id"] == 1} == {20_000}
