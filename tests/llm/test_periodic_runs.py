"""Periodic runs against a search of all stretches at all lags, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from loamgrid.llm import periodic_runs

R = random.Random(5)


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, q, n) for (s, n), q in found.items())


def row(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and words:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda x: (-x[2] / x[1], x[0], x[1]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, q, n in runs)]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    told = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha(lines.encode()), sha(b" ".join(kept)))


def texts():
    word = lambda: R.choice("abcdefgh")
    out = [None, "", " \n\t", "x " * 23, "x " * 24, "x " * 700, "a b " * 11 + "a", "a b " * 12, "É é " * 40, "a\x0bb\x0ca\rb " * 30]
    for _ in range(60):
        parts = []
        for _ in range(R.randrange(1, 8)):
            q = R.choice([1, 2, 3, 5, 8, 9, 13, 40])
            unit = [word() for _ in range(q)]
            parts += [word() for _ in range(R.randrange(12))] + (unit * 9)[: R.randrange(1, 9 * q)]
        out.append(" ".join(parts))
    return out + out[-3:]


def test_scan_finds_the_runs_of_every_range_of_lags():
    for _ in range(300):
        n = R.randrange(20, 260)
        unit = [R.randrange(3) for _ in range(R.randrange(1, 30))]
        words = np.array([unit[i % len(unit)] if R.random() > 0.01 else 9 for i in range(n)], np.int32)
        want = brute(words.tolist())
        assert sorted((s, q, m) for s, m, q in periodic_runs.scan(words, 1, n)) == want
        cut = R.randrange(1, n // 3 + 2)
        merged = {}
        for s, m, q in periodic_runs.scan(words, 1, cut) + periodic_runs.scan(words, cut, n):
            merged[s, m] = min(q, merged.get((s, m), q))
        assert sorted((s, q, m) for (s, m), q in merged.items()) == want


@pytest.mark.parametrize("lags", [periodic_runs.LAGS, 7])
def test_rows_against_brute_force(spark, docs, lags):
    """With few lags to a range most texts are dealt by ranges, joined with their runs, and come out the same."""
    given = texts()
    table = docs(given, 100).unionByName(docs(given[-2:], 100)).unionByName(spark.createDataFrame([(None, given[20]), (None, given[20]), (None, None)], "doc_id long, text string"), allowMissingColumns=True)
    key = lambda r: (r[0] is None, r)
    got = sorted((tuple(r) for r in periodic_runs.periodic_runs(table, periodic_runs.planted, lags).collect()), key=lambda r: str(key(r)))
    want = [row(100 + i, t) for i, t in enumerate(given)] + [row(100 + i, t) for i, t in enumerate(given[-2:])] + [row(None, given[20])] * 2 + [row(None, None)]
    assert got == sorted(want, key=lambda r: str(key(r)))
    assert periodic_runs.periodic_runs(table.limit(0)).count() == 0


def test_equal_words_of_a_long_text_cost_no_scan_of_every_multiple():
    words = np.zeros(200_000, np.int32)
    assert periodic_runs.scan(words, 1, len(words)) == [(0, 200_000, 1)]
    assert periodic_runs.scan(words, 30_000, 60_000) == []
