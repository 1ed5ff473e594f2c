"""Katz backoff with every bigram of the training texts, those seen once among them, against a plain version."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from loamgrid.llm import lm_scoring


def katz(texts):
    """Scores, the numbers of bigrams seen 0, 1, ... times, and the discounts of counts up to 5."""
    tokens = [[*(t or "").encode().lower().split(), "end"] for t in texts]
    train = [t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    p1 = lambda w: (c[w] + 0.5) / (sum(c.values()) + 0.5 * (len(c) + 1))
    pairs = Counter((h, w) for t in train for h, w in zip(["start", *t], t, strict=False))
    n_of = [sum(x == r for x in pairs.values()) for r in range(7)]
    tail = 6 * n_of[6] / n_of[1]
    d = {r: ((r + 1) * n_of[r + 1] / (r * n_of[r]) - tail) / (1 - tail) for r in range(1, 6)}
    d = {r: x if 0 < x < 1 else (r - 0.5) / r for r, x in d.items()}
    after = defaultdict(dict)
    for (h, w), x in pairs.items():
        after[h][w] = x * d.get(x, 1.0)
    below, a = {}, {}
    for h, star in after.items():
        total = sum(pairs[h, w] for w in star)
        below[h] = total if total - sum(star.values()) >= 0.5 else sum(star.values()) + 0.5
        a[h] = (1 - sum(star.values()) / below[h]) / (1 - sum(map(p1, star)))
    p = lambda h, w: after[h][w] / below[h] if w in after.get(h, ()) else a.get(h, 1.0) * p1(w)
    for h in [*list(after)[:20], "never"]:  # sums to 1: all known words and one unknown
        assert abs(sum(p(h, w) for w in c) + a.get(h, 1.0) * p1("?") - 1) < 1e-9
    return [sum(math.log10(p(h, w)) for h, w in zip(["start", *t], t, strict=False)) for t in tokens], n_of, d


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    return [None, "", " \n", "unknownword", *[" ".join(f"Wort{int(r.paretovariate(0.7))}" for _ in range(r.choice([1, 5, 60]))) for _ in range(200)]]


@pytest.mark.parametrize(("hot", "chunk"), [(100_000, 1_000_000), (12, 300)])
def test_bigrams_seen_once_are_in_the_model(docs, texts, hot, chunk):
    want, n_of, d = katz(texts)
    assert n_of[1] > 300 and 0 < d[1] < 1
    got = {x["doc_id"]: x["score"] for x in lm_scoring.scores(docs(texts), hot, chunk, lm_scoring.EVERY).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-9)


def test_query_has_every_bigram(spark, docs, texts, tmp_path):
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["score"] for x in lm_scoring.op7_katz_backoff(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(katz(texts)[0], abs=1e-9)


def test_empty_table_and_no_training_rows(docs):
    assert lm_scoring.scores(docs(["x"]).limit(0), least=lm_scoring.EVERY).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm_scoring.scores(docs(["a b"], held), least=lm_scoring.EVERY).first()
    assert (row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (0, 0, 0.0, 0.0)
