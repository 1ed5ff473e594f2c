"""Brute-force versions of the operators on small tables, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import os
import random
import re
import zlib

import pytest

from loamgrid.llm import decontamination, html_extraction, line_dedup, packing, quality_rules, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(3)
VOCABULARY = [a + b + c for a in "bdfgklmnpr" for b in "aeiou" for c in "lmnrst"]
PROSE = [" ".join(R.choice(VOCABULARY) for _ in range(R.choice([3, 25, 90]))) for _ in range(40)]
TEXTS = [None, "", " \n", "é É # $ a|b", "one\none\n two\n\n two", "x " * 5000, "A B C D E F G H " * 6 + "end of it all now", *PROSE, PROSE[0], PROSE[0]]


def words(text):
    return WORD.findall(text or "")


def test_quality_base_counts(spark, docs):
    rows = {r["doc_id"]: r for r in quality_rules.quality_verdicts(docs(TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        w = words(text)
        eights = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {k + j for k, x in enumerate(eights) if eights.count(x) > 1 for j in range(8)} if len(eights) < 200 else set(range(len(w)))
        lines = [line for line in (text or "").split("\n") if words(line)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        got = rows[i]
        assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (got["kept"] and got["base_failed"])
    kept = quality_rules.keep_good(docs(TEXTS))
    assert kept.columns == docs(TEXTS).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["kept"]}


def test_packing_covers_every_token_without_gaps(spark, docs):
    rows = packing.pack(packing.pieces(docs(TEXTS), packing.default_tokenizer(), capacity=64, with_ids=False), 64).collect()
    ids_of = packing.token_ids(packing.default_tokenizer())
    for i, text in enumerate(TEXTS):
        ids = [*ids_of.tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(k, s, min(64, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 64))]
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s : s + 64])) for s in range(0, len(ids), 64)]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= 1.15 * -(-total // 64) + 1


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_each_piece_once(seed):
    r = random.Random(seed)
    counts = {n: r.choice([1, 2, 3, 50]) for n in r.sample(range(1, 101), 40)}
    used, seen = {}, {}
    for length, first, end, sequence, offset in packing.plan(counts, 100).tolist():
        for k in range(end - first):
            seen.setdefault(length, []).append(first + k)
            used.setdefault(sequence + k, []).append((offset, length))
    assert {n: sorted(x) for n, x in seen.items()} == {n: list(range(c)) for n, c in counts.items()}
    for places in used.values():
        assert sorted(places)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:], strict=False))
        assert sum(n for _, n in places) <= 100


def test_decontamination_finds_items_in_long_texts(spark, docs):
    items = [" ".join(R.choice(VOCABULARY) for _ in range(n)) for n in (3, 12, 40)]
    long = " ".join(R.choice(VOCABULARY) for _ in range(20_000))
    changed = items[2].split()
    changed[20] = "other"
    texts = [*TEXTS, f"{long} {items[0]}", f"{long}, ({items[1].upper()})! {long}", f"a b {' '.join(changed)} c d", items[2][:60]]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate([*items, None, ""])], "item_id long, text string")
    split = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").lower()).split()
    shingles = lambda t, n: {tuple(w[i : i + n]) for w in [split(t)] for i in range(len(w) - n + 1)}
    of = lambda item: min(5, len(split(item)))
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if len(shingles(item, of(item)) & shingles(t, of(item))) >= 0.8 * len(shingles(item, of(item)))}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs(texts), bench).collect()}
    assert got == want and len(want) >= 2
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs(texts), bench, block=10).collect()}  # an item a block
    assert got == want
    left = decontamination.drop_contaminated(docs(texts), bench)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_line_dedup_drops_recurring_templates_only(spark, docs):
    texts = [f"{PROSE[i]}\nThe page {i} was printed on day {i * 3} by the office\n\nline of {VOCABULARY[i]} {VOCABULARY[-i]}" for i in range(25)]
    rows = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(docs([*texts, None, "", "alone"]), counted=True).collect()}
    assert all("printed on day" not in rows[i]["text"] and PROSE[i] in rows[i]["text"] and rows[i]["n_dropped_lines"] >= 1 for i in range(25))
    assert (rows[25]["text"], rows[26]["text"], rows[27]["text"]) == (None, "", "alone")
    copies = docs([PROSE[1] + "\n" + PROSE[2]] * 30)
    assert all(r["text"] == PROSE[1] + "\n" + PROSE[2] for r in line_dedup.drop_recurring_lines(copies).collect())


def test_line_dedup_counts_surroundings_absolutely(spark, docs):
    own = [" ".join(R.choice(VOCABULARY) for _ in range(8)) for _ in range(60)]
    line, passage = "all rights in this text are held by the house", [" ".join(R.choice(VOCABULARY) for _ in range(30)) for _ in range(3)]
    changed = [" ".join(R.choice(VOCABULARY) for _ in range(40)).split() for _ in range(3)]

    def near(i):  # copies with one word changed in one line
        new = [list(x) for x in changed]
        new[i % 3][7 + i % 30] = f"w{VOCABULARY[i]}"
        return "\n".join(" ".join(x) for x in new)

    copies = [f"{PROSE[1]}\n{PROSE[2]}\n{line}"] * 40
    different = [f"{x}\n{line}" for x in own[:20]]
    together = ["\n".join([x, *passage]) for x in own[20:40]]
    texts = [*copies, *different, *together, *map(near, range(40)), line]
    rows = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(docs(texts)).collect()}
    want = [*[f"{PROSE[1]}\n{PROSE[2]}"] * 40, *own[:40], *texts[80:120], ""]
    assert [rows[i] for i in range(len(texts))] == want


def test_sharding_balances_and_keeps_copies_together(spark, docs):
    texts = [*TEXTS, *["same text"] * 6]
    rows = sharding.shards(docs(texts), n_shards=5).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(5)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(x) for x in slots.values()]
    assert max(counts) - min(counts) <= 1
    assert len({r["shard"] for r in rows if texts[r["doc_id"]] == "same text"}) == 1


def test_html_extraction_keeps_the_article_alone(spark):
    page = lambda title, body: f"<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>Accept</div><article><h1>{title}</h1><p>{body} &amp; more\n text</p></article><div id='comments'><p>Nice</p></div><footer>About</footer></body></html>"
    rows = [(1, "http://a.org/x/1", page("One", "first")), (2, "http://a.org/x/2", page("Two", "second")), (3, None, None), (4, "http://b.org/", ""), (5, "http://c.org", "<p>only <b>bold</b>"), (5, "http://c.org", "<p>only <b>bold</b>")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [(1, "One\n\nfirst & more text", 22), (2, "Two\n\nsecond & more text", 23), (3, "", 0), (4, "", 0), (5, "only bold", 9), (5, "only bold", 9)]


def test_html_differencing_matches_brute_force(spark):
    """Pages without an article: each loses the lines of a longest common subsequence with its nearest different page, whatever the ranges."""
    r = random.Random(5)
    menu, rows = [f"menu {i}" for i in range(6)], []
    for i in range(40):
        lines = [*menu[: r.randrange(3, 7)], *[f"text {i} {k}" for k in range(r.randrange(4))], r.choice(["shared end", "other end"])]
        rows.append((i, f"http://h{i % 2}.org/d{i % 3}/p{i:02d}", "".join(f"<p>{x}</p>" for x in lines)))
    rows += [(100 + k, f"http://h0.org/d0/p06-{k}", rows[6][2]) for k in range(15)]  # copies that stand together
    rows.append((None, "http://h0.org/d0/p06", rows[6][2]))
    ordered = sorted(rows, key=lambda x: (*html_extraction.split_url(x[1]), -1 if x[0] is None else x[0]))
    want = {}
    for k, (i, url, page) in enumerate(ordered):
        host, path = html_extraction.split_url(url)
        before = next((x for x in ordered[k::-1] if x[2] != page), None)
        after = next((x for x in ordered[k:] if x[2] != page), None)
        others = [x for x in (before, after) if x and html_extraction.split_url(x[1])[0] == host]
        alike = lambda x: len(os.path.commonprefix([path, html_extraction.split_url(x[1])[1]]))  # noqa: B023, E731
        best = max(others, key=alike, default=None)
        own, other = (re.findall(r"<p>(.*?)</p>", x) for x in (page, best[2] if best else ""))
        gone = html_extraction.common_lines(own, other) if best and own != other else set()
        want[i] = "\n\n".join(x for n, x in enumerate(own) if n not in gone)
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for ranges in (1, 5, 23):
        got = {x["page_id"]: x["text"] for x in html_extraction.extract(table.withColumn("path", table["url"]), ranges).collect()}
        assert got == want
    assert html_extraction.extract(table.limit(0)).count() == 0


def test_common_lines_are_a_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        kept, rest = sorted(html_extraction.common_lines(a, b)), iter(b)
        assert len(kept) == size[-1][-1] and all(any(y == a[i] for y in rest) for i in kept)


def test_decontamination_of_short_and_repeated_items(spark, docs):
    items = spark.createDataFrame([(1, "Very Short"), (2, PROSE[3]), (2, PROSE[3]), (3, None), (4, " . ")], "item_id long, text string")
    table = docs(["it is, very short indeed", "very long", PROSE[3] + " end", None, "", "very short"])
    got = sorted((r["doc_id"], r["item_id"], r["containment"]) for r in decontamination.contaminated(table, items).collect())
    whole = [(2, 2, 1.0)] * 2
    assert got == [(0, 1, 1.0), *whole, (5, 1, 1.0)]
    assert {r["doc_id"] for r in decontamination.drop_contaminated(table, items).collect()} == {1, 3, 4}
    assert decontamination.contaminated(table.limit(0), items).count() == decontamination.contaminated(table, items.limit(0)).count() == 0


def test_toxicity_separates_held_out_rows(spark, docs):
    r = random.Random(9)
    toxic = [r.random() < 0.4 for _ in range(240)]
    texts = [" ".join([*(r.choice(VOCABULARY) for _ in range(30)), *(["you", "idiot", "scum"] if t else ["you", "see"])]) for t in toxic]
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)] + [(1000, 0, None)], "doc_id long, quality int, toxic int")
    rows = {x["doc_id"]: x for x in toxicity.toxicity(docs([*texts, None, ""]), labels).collect()}
    assert len(rows) == 242 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in rows.values())
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in rows.items())
    held = [i for i in range(240) if rows[i]["held_out"]]
    assert sum(rows[i]["predicted"] == toxic[i] for i in held) >= 0.9 * len(held)
    none = toxicity.toxicity(docs(["a", None]), labels.limit(0)).collect()
    assert [x["score"] for x in none] == [0.0, 0.0]


def test_toxicity_is_calibrated_to_all_training_rows(spark, docs, monkeypatch):
    for name, n in (("TRAIN_TOXIC", 60), ("TRAIN_CLEAN", 30), ("CALIBRATE", 30)):
        monkeypatch.setattr(toxicity, name, n)
    r = random.Random(11)
    texts = [" ".join(r.choice(VOCABULARY) for _ in range(30)) for _ in range(600)]  # labels do not depend on them
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    scores = [x["score"] for x in toxicity.toxicity(docs(texts), labels).collect()]
    assert sum(scores) / len(scores) < 0.2


@pytest.mark.parametrize("run", [quality_rules.quality_verdicts, lambda d: packing.pack(packing.pieces(d, packing.default_tokenizer(), with_ids=False)), line_dedup.drop_recurring_lines, sharding.shards])
def test_empty_tables(spark, docs, run):
    assert run(docs(["x"]).limit(0)).count() == 0


def test_sharding_moves_near_texts_together(spark, docs):
    """Families of near texts: the links are those of a brute-force comparison of sketches' shingles, and moves cut fewer of them."""
    r = random.Random(11)
    families = [[r.choice(VOCABULARY) for _ in range(200)] for _ in range(12)]
    texts = [" ".join([*f[:k], "changed", *f[k + 1 :]]) for f in families for k in (3, 90, 150, 197)] + [" ".join(r.choice(VOCABULARY) for _ in range(60)) for _ in range(80)]
    table = docs(texts)
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    key = {row["cluster"]: row["doc_id"] for row in sharding.linked(table).select("doc_id", sharding._cluster(sharding.F.lit(0)).alias("cluster")).collect()}
    links = [(key[row["a"]], key[row["b"]]) for row in sharding.near_links(table).collect()]
    assert all(len(shingles[a] & shingles[b]) > 0.7 * len(shingles[a] | shingles[b]) for a, b in links)
    assert len({x for link in links for x in link}) >= 44  # of 48
    result, cuts = sharding.shards_and_cuts(table, n_shards=4)
    counts = [row["count"] for row in result.groupBy("shard").count().collect()]
    assert sum(counts) == len(texts) and max(counts) - min(counts) <= 1
    assert min(cuts) < 0.3 * cuts[0]
    where = {row["doc_id"]: row["shard"] for row in result.collect()}
    assert sum(where[a] != where[b] for a, b in links) <= min(cuts)


def test_recall_of_near_links(spark, docs):
    """Of all pairs of texts as similar as 0.8, by brute force, nine in ten at least are joined by links."""
    r = random.Random(21)
    texts = []
    for _ in range(25):
        own = [r.choice(VOCABULARY) for _ in range(220)]
        for _ in range(5):
            copy = list(own)
            for at in r.sample(range(220), r.randrange(5)):
                copy[at] = r.choice(VOCABULARY)
            texts.append(" ".join(copy))
    table = docs(texts)
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    key = {row["cluster"]: row["doc_id"] for row in sharding.linked(table).select("doc_id", sharding._cluster(sharding.F.lit(0)).alias("cluster")).collect()}
    top = [texts.index(t) for t in texts]  # equal texts are one cluster

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for row in sharding.near_links(table).collect():
        top[root(key[row["a"]])] = root(key[row["b"]])
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    assert len(pairs) > 100 and sum(root(i) == root(j) for i, j in pairs) >= 0.9 * len(pairs)
