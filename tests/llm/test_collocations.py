"""Phrases against plain counting of all word sequences."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from loamgrid.llm import collocations

R = random.Random(11)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, depth, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, depth + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: c for p, c in counts.items() if c >= least}
        inside = {p for q, c in frequent.items() for k in range(2, len(q)) for p in (q[i : i + k] for i in range(len(q) - k + 1)) if 100 * c >= 100 * frequent[p]}
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and p not in inside:
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus():
    words = ["a", "b", "C", "é", "É", "new", "york", "in", "of", "x-1", "$", "ZZ"]
    phrases = ["new york", "in New York", "a b c", "of of", "É é é é é é", "x-1 $ zz a b", "a\tb  C"]
    out = [("en", None), ("en", ""), ("en", " ,.\n"), (None, "a b a b a b"), ("und", "A B. a b"), ("fr", "new york" * 3)]
    for _ in range(160):
        text = "".join(R.choice(phrases if R.random() < 0.3 else words) + R.choice([" ", " ", " ", "  ", "\t", ".", ", ", "\n", "\x0b", "\r", "! "]) for _ in range(R.randrange(60)))
        out.append((R.choice(["en", "en", "fr", None]), text))
    out.append(("en", "lorem Ipsum " * 2000))
    return out + out[-4:]


def test_phrases_against_plain_counting(spark):
    rows = corpus()
    table = spark.createDataFrame([(lang, t, 1, 2, "s") for lang, t in rows], "lang string, text string, n long, key long, phrase string").repartition(5)
    for depth, least, top, size in ((5, 6, 2000, 1 << 24), (5, 3, 9, 300), (3, 20, 50, 2000)):
        got = sorted(tuple(r) for r in collocations.collocations(table, depth, least, top, size).collect())
        assert got == brute(rows, depth, least, top)
    assert collocations.collocations(table.limit(0)).count() == 0
    assert collocations.collocations(table.where("text is null")).count() == 0


def test_states_are_the_classes_of_equal_end_places():
    for _ in range(60):
        words = np.array([R.randrange(4) for _ in range(R.randrange(1, 80))], np.uint64)
        follows = np.array([R.random() < 0.9 for _ in words])
        follows[-1] = False
        ends = defaultdict(set)
        for i in range(len(words)):
            for k in range(1, 6):
                if i + k <= len(words) and words[i : i + k].all() and follows[i : i + k - 1].all():
                    ends[tuple(words[i : i + k].tolist())].add(i + k - 1)
        classes = defaultdict(list)
        for phrase, places in ends.items():
            classes[frozenset(places)].append(phrase)
        want = sorted((max(c, key=len), min(map(len, c)), len(places)) for places, c in classes.items())
        got = sorted((tuple(words[i : i + k].tolist()), m, n) for k, at, short, count in collocations.automaton(words, follows, 5) for i, m, n in zip(at.tolist(), short.tolist(), count.tolist(), strict=True))
        assert got == want
