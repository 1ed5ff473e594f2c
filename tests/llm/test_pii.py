import hashlib
import re

from loamgrid.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d)) % 10 == 0


def good(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if good(k, m.group())]


TEXTS = [
    None, "", "no data", "mail a.b@x.org,c@d.e and é𝄞 q@w.er%t@y.zz.", "call +1 (017) 555-7713 or +12 or +123456789012345678",
    "ip 10.0.0.1 256.1.1.1 1.2.3 1.2.3.4.5.6.7.8 0000255.1.1.1 99999999999.1.1.1", "card 4111 1111 1111 1111, 4111-1111-1111-1112 4952935900253052!!",
    "a@b.c" * 50, "1 2 3 4 " * 3000, "9" * 20000, "x" * 50000 + "@" + "y" * 50000, "+1" + " " * 5000, "a@b..c @ a@b a@b.c.d-", "0 0000000000000", "1.1.1.1" * 200,
    "IBAN GB82 WEST 1234 5698 7654 32 bank, DE89370400440532013000; GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789 and " + "z" * 60 + " order 123-45-6789 000-12-3456", "00:1A:2b:3c:4D:5e",
]


def test_base_spans_match_brute_force(spark, docs):
    rows = {r["doc_id"]: r for r in pii.find_pii(docs(TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert [(x["kind"], x["start"], x["end"]) for k in pii.BASE for x in rows[i][k]] == brute(text), text and text[:60]


def test_further_kinds_need_checksum_and_context(spark, docs):
    rows = {r["doc_id"]: r for r in pii.find_pii(docs(TEXTS)).collect()}
    assert [(x["start"], x["end"]) for x in rows[15]["iban"]] == [(5, 32), (39, 61)]
    assert [(x["start"], x["end"]) for x in rows[16]["ssn"]] == [(4, 15)]
    assert [(x["start"], x["end"]) for x in rows[17]["mac"]] == [(0, 17)]
    assert all(0 <= x["score"] <= 1 for r in rows.values() for k in pii.PATTERNS for x in r[k])


def test_query_digest(spark, tmp_path, docs):
    docs(TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op3_pii(spark, str(tmp_path)).collect():
        spans = brute(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]


def test_empty_table(spark, docs):
    assert pii.find_pii(docs(["x"]).limit(0)).count() == 0
