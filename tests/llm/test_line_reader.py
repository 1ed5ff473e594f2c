"""The reader of lines against plain Python, on random texts."""

import random
import re

import pytest

from loamgrid.llm import common, line_dedup


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_lines_match_plain_splitting(monkeypatch, block):
    monkeypatch.setattr(common, "BLOCK", block)
    common._byte_tables.cache_clear()
    r = random.Random(1)
    for _ in range(100):
        texts = ["".join(r.choice("ab1 \n\t\r\x0bé") for _ in range(r.choice([0, 1, 5, 60, 300]))).encode() for _ in range(r.choice([1, 2, 7]))]
        got = line_dedup.Lines(texts)
        want = []
        for doc, text in enumerate(texts):
            for nth, line in enumerate(text.split(b"\n")):
                if words := tuple(b"<*>" if re.search(rb"[0-9]", w) else w for w in line.split()):
                    want.append((doc, nth, words))
        assert list(zip(got.doc.tolist(), got.nth.tolist(), strict=True)) == [x[:2] for x in want]
        assert got.size.tolist() == [len(x[2]) for x in want]
        tokens, leaves = [w for x in want for w in x[2]], [(len(x[2]), x[2][: line_dedup.DEPTH]) for x in want]
        for keys, hashes in (([x[2] for x in want], got.line), (leaves, got.leaf), (tokens, got.tokens)):
            pairs = set(zip(keys, hashes.tolist(), strict=True))
            assert len(pairs) == len(set(keys)) == len({h for _, h in pairs})
        seen = set()
        for (doc, _, words), first in zip(want, line_dedup.first_of(got.doc, got.line).tolist(), strict=True):
            assert first == ((doc, words) not in seen)
            seen.add((doc, words))
    common._byte_tables.cache_clear()


def test_no_texts():
    assert line_dedup.Lines([]).line.tolist() == line_dedup.Lines([b"", b"\n "]).line.tolist() == []
