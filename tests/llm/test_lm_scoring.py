import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from loamgrid.llm import lm_scoring


def brute(texts):
    docs = [(t or "").encode().lower().split() for t in texts]
    tokens = [[*d, "end"] for d in docs]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    c = Counter(w for t, y in zip(tokens, train, strict=True) if y for w in t)
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    pairs, total = Counter(), Counter()
    for t, y in zip(tokens, train, strict=True):
        if y:
            for h, w in zip(["start", *t], t, strict=False):
                pairs[h, w] += 1
                total[h] += 1
    d = lm_scoring.good_turing([sum(x == r for x in pairs.values()) for r in range(lm_scoring.DISCOUNTED + 2)])
    star = lambda x: x * d[x] if x <= lm_scoring.DISCOUNTED else x
    after = defaultdict(list)
    for (h, w), x in pairs.items():
        if x >= 2:
            after[h].append(w)
    below, a = {}, {}
    for h, ws in after.items():
        s = sum(star(pairs[h, w]) for w in ws)
        below[h] = total[h] if total[h] - s >= 0.5 else s + 0.5
        a[h] = (1 - s / below[h]) / (1 - sum(p1(w) for w in ws))

    def p(h, w):
        return star(pairs[h, w]) / below[h] if pairs[h, w] >= 2 else a.get(h, 1.0) * p1(w)

    for h in [*list(total)[:20], "never"]:  # sums to 1: all known words and one unknown
        assert abs(sum(p(h, w) for w in c) + a.get(h, 1.0) * p1("?") - 1) < 1e-9
    return [(not y, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), sum(math.log10(p(h, w)) for h, w in zip(["start", *t], t, strict=False))) for t, y in zip(tokens, train, strict=True)]


@pytest.mark.parametrize(("hot", "chunk"), [(100_000, 1_000_000), (12, 300)])
def test_scores_match_brute_force(spark, docs, hot, chunk):
    r = random.Random(7)
    words = [f"Wort{int(r.paretovariate(0.7))}" for _ in range(2000)]
    texts = [None, "", "  \n", "unknownword", "é É", *[" ".join(r.choice(words) for _ in range(r.choice([1, 5, 60]))) for _ in range(150)]]
    got = {x["doc_id"]: x for x in lm_scoring.scores(docs(texts), hot, chunk).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts)):
        assert [got[i][k] for k in ("held_out", "n_tokens", "n_known", "train_tokens")] == list(want[:4])
        assert got[i]["base_score"] == pytest.approx(want[4], abs=1e-9)
        assert got[i]["score"] == pytest.approx(want[5], abs=1e-9)


def test_rare_words_are_predicted_in_a_large_table(spark, docs):
    r = random.Random(8)
    texts = [" ".join(f"Wort{int(r.paretovariate(0.7))}" for _ in range(3000)) for _ in range(200)]
    got = {x["doc_id"]: x for x in lm_scoring.scores(docs(texts)).collect()}
    assert got[0]["train_tokens"] > 400_000
    for i, want in enumerate(brute(texts)):
        assert got[i]["base_score"] == pytest.approx(want[4], rel=1e-9)
        assert got[i]["score"] == pytest.approx(want[5], rel=1e-9)


def test_empty_table_and_no_training_rows(spark, docs):
    assert lm_scoring.scores(docs(["x"]).limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm_scoring.scores(docs(["a b"], held)).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (True, 3, 0, 0)
    assert row["base_score"] == row["score"] == 0.0


def test_rows_without_id_and_repeated_rows(spark):
    rows = lm_scoring.scores(spark.createDataFrame([(None, "a b"), (2, "a b"), (2, "a b")], "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["2", "2", "None"]
    assert len({r["base_score"] for r in rows}) == 1
