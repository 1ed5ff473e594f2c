import random
import re
import zlib

import corpus_pipeline
from loamgrid.llm import packing, quality_rules

R = random.Random(4)
VOCABULARY = [a + b + c for a in "bdfgklmnpr" for b in "aeiou" for c in "lmnrst"]
FAILING = ("Home | About | Contact", "please enable javascript to go on", "PRINTED IN CAPITALS ONLY HERE")


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def brute(texts, item):
    """Texts of the fixture that are left, by id: failing lines, the recurring template, repeated, contaminated and short texts go."""
    left, seen = {}, set()
    for i, text in enumerate(texts):
        lines = (text or "").split("\n")
        good = [x for x in lines if x not in FAILING]
        lost = sum(len(x.split()) for x in lines) - sum(len(x.split()) for x in good)
        if len((text or "").split()) < 20 or 2 * lost > len(text.split()):
            continue
        clean = "\n".join(x for x in good if not re.fullmatch(r"issued on day [0-9]+ by the office of records", x))
        if clean not in seen and item not in clean:
            left[i] = clean
        seen.add(clean)
    return left


def test_failing_lines_are_removed(spark):
    own = prose(30)
    rows = spark.createDataFrame([(1, f"{FAILING[0]}\n{own}\n\n{FAILING[1]}"), (2, None), (3, own)], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["text"], r["n_failed_lines"]) for r in quality_rules.quality_verdicts(rows).collect()}
    assert got == {1: (True, f"{own}\n", 2), 2: (False, None, 0), 3: (True, own, 0)}


def test_pipeline_matches_brute_force(spark, tmp_path):
    item, first = prose(25), prose(40)
    texts = [f"{FAILING[0]}\n{first}\n{FAILING[1]}", first, f"{prose(30)}\n{item}", "too short", None, f"{prose(12)}\n{chr(10).join(FAILING * 2)}"]
    texts += [f"{prose(30)}\nissued on day {i * 7} by the office of records\n{FAILING[i % 3]}\n{prose(9)}" for i in range(14)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tokenizer = packing.token_ids(packing.default_tokenizer()).tokenizer
    ids = lambda t: [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID]
    want = {i: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids(t))) for i, t in brute(texts, item).items()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) == len(want) == 15
    assert {r["doc_id"]: r["ids_crc32"] for r in rows} == want
