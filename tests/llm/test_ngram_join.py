import random

import pytest

from loamgrid.llm import ngram_join
from loamgrid.llm.components import components


def sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute(texts, n, percent):
    own = sets(texts, n)
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [(len(s), top(i)) for i, s in enumerate(own)]


def corpus(seed, n_docs=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(40)]
    texts = [None, "", " \n\t", "one", "ONE", "one two", "One  two", "é One", "a b c", "a b c a b c"]
    while len(texts) < n_docs:
        own = [r.choice(words) for _ in range(r.choice([2, 5, 30, 120, 400]))]
        if r.random() < 0.5:
            own[r.randrange(len(own)) :] += passage
        for _ in range(r.choice([1, 1, 2, 12])):
            copy = list(own)
            for _ in range(r.choice([0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, docs, n, percent):
    texts = corpus(n)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(texts), n, percent).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, n, percent)


def test_large_sets_match_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 50)
    texts = corpus(11, 100)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs(texts)).collect()}
    assert [found[i] for i in range(len(texts))] == [c for _, c in brute(texts, 3, 90)]


def test_repeated_rows_and_ids(spark):
    a, b = "x y z u v w", "p q r s t u"
    rows = [(5, a), (5, b), (3, b), (7, a), (7, a), (None, a), (None, "other words here"), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(5, 4, 5), (5, 4, 3), (3, 4, 3), (7, 4, 5), (7, 4, 5), (-1, 4, None), (-1, 1, None), (9, 0, 9), (9, 0, 9)], key=str)
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in ngram_join.keep_one_of_each(docs, 3, 90).collect())
    assert kept == sorted((str(x), str(y)) for x, y in [(5, a), (3, b), (None, a), (None, "other words here"), (9, None), (9, None)])


def test_one_of_each_component_stays(spark, docs):
    texts = corpus(5, 90)
    table = docs(texts)
    kept = {r["doc_id"] for r in ngram_join.keep_one_of_each(table, 5, 80).collect()}
    assert kept == {i for i, (n, c) in enumerate(brute(texts, 5, 80)) if c == i or not n}
    assert ngram_join.keep_one_of_each(table, 5, 80).columns == table.columns


def test_empty_table(spark, docs):
    assert ngram_join.jaccard_components(docs(["x"]).limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(30)}


def test_pairs_of_near_copies_grow_with_their_number(spark):
    """Texts of 300 words, one of them changed, nearly all link. The pairs of all rounds must grow with the copies, not with their square."""
    r = random.Random(6)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]

    def pairs(n):
        rows = []
        for i in range(n):
            copy = list(base)
            copy[r.randrange(300)] = f"x{i}"
            rows.append((i, " ".join(copy)))
        join = ngram_join.Join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
        assert {x["component_id"] for x in join.run().collect()} == {0}
        return sum(join.proposed)

    for n in (500, 4000):
        assert pairs(n) < 20 * n  # four hubs on average, whatever n
