"""Mixture packing: a round trip of all ids, gapless sequences without padding, and rounds as a plain deficit round-robin deals them."""

import random
import zlib
from collections import defaultdict

import pytest

from loamgrid.llm import mixture, packing

R = random.Random(2)
TEXTS = [None, "", " ", "é $ x", "word " * 900, *[" ".join(R.choice(["alpha", "beta", "of", "Gamma-ray", "9"]) for _ in range(R.randrange(1, 120))) for _ in range(120)]]
TEXTS += TEXTS[-2:]
SOURCES = [R.choice(["hot", "hot", "hot", "b", "c", None]) for _ in TEXTS]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(None if i == 7 else i % 124, t, s, 5, "q") for i, (t, s) in enumerate(zip(TEXTS, SOURCES, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, length long, round string").repartition(3)


def ids_of(text):
    return [*packing.token_ids(packing.default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("capacity, window, shares", [(64, 400, None), (16, 160, {"hot": 1, "b": 2, "c": 3, None: 2}), (2048, 131_072, None)])
def test_every_id_once_without_padding(spark, table, capacity, window, shares):
    rows = mixture.mix(table, shares=shares, capacity=capacity, window=window).collect()
    want = sorted(((None if i == 7 else i % 124, ids_of(t)) for i, t in enumerate(TEXTS)), key=repr)
    total = sum(len(x) for _, x in want)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    by_key = defaultdict(list)
    for doc_id, ids in want:
        by_key[doc_id, len(ids)].append(ids)
    assert set(pieces) == set(by_key)
    for key, own in pieces.items():
        crc = lambda ids, s, n: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s : s + n]))
        copies = len(by_key[key])
        assert sum(n for _, n, _ in own) == copies * key[1]
        cover = sorted(s for s, n, _ in own for s in range(s, s + n))
        assert cover == sorted(list(range(key[1])) * copies)
        assert all(any(crc(ids, s, n) == c for ids in by_key[key]) for s, n, c in own)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(x == capacity or x & (x - 1) == 0 for x in sizes) and sum(sizes) == total
    assert sorted(sizes)[-(total // capacity) :] == [capacity] * (total // capacity) if total >= capacity else True


def test_rounds_are_those_of_a_plain_deficit_round_robin(spark, table):
    capacity, window, shares = 16, 160, {"hot": 3, "b": 1, "c": 1, None: 3}
    cut = mixture.stash(mixture.packets(table, packing.default_tokenizer(), capacity))
    queued = mixture.stash(mixture.in_queues(cut))
    quanta = mixture.quanta(queued, window, shares)
    placed = {(r["row"], r["start"]): (r["round"], r["at"]) for r in mixture.in_stream(queued, quanta, 3).collect()}
    queues = defaultdict(list)
    for r in queued.collect():
        queues[r["source"]].append((r["end"], r["length"], (r["row"], r["start"])))
    quantum = {r["source"]: r["quantum"] for r in quanta.collect()}
    waiting = {s: sorted(q) for s, q in queues.items()}
    deficit, turn, at = dict.fromkeys(waiting, 0.0), 0, 0
    spans = defaultdict(list)
    while any(waiting.values()):
        size = 0
        for s, queue in waiting.items():
            deficit[s] += quantum[s]
            while queue and queue[0][1] <= deficit[s]:
                _, length, key = queue.pop(0)
                deficit[s] -= length
                size += length
                assert placed[key][0] == turn
                spans[turn].append((placed[key][1], length))
            assert not queue or deficit[s] < capacity
        for place, length in sorted(spans[turn]):
            assert place == at
            at += length
        turn += 1
    assert at == sum(x[1] for q in queues.values() for x in q)


def test_shares_must_fit_the_sources(spark, table):
    with pytest.raises(ValueError):
        mixture.mix(table, shares={"hot": 1.0})
    with pytest.raises(ValueError):
        mixture.mix(table, shares={"hot": 1.0, "b": 0.0, "c": 1.0, None: 1.0})
    assert mixture.mix(table.limit(0)).count() == 0
