import hashlib
import random
import re

from asklens.llm import personal, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
W = personal.Weights()


def _plain(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(personal.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_base_spans_in_hard_texts():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@x", ".", "-", "1", "255", "256.", "1.2.3.4", "4111 1111 1111 1111", "4111-1111", "+", "+1 (555) 123-4567", " ", "é",
             "0000", "x@y.z", "@@", "😀", "\n", "00000000001.2.3.4"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [(k, a, b) for k, a, b, _ in personal.find_spans(text, W) if k in personal.BASE] == _plain(text), text


def test_query_against_brute_force(spark, documents):
    want = {}
    for r in documents.collect():
        spans = _plain(r["text"])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[r["doc_id"]] = (*(sum(s[0] == k for s in spans) for k in personal.BASE), hashlib.sha256(listed.encode()).hexdigest())
    found = queries.op9(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found} == want


def test_added_kinds_and_context():
    spans = personal.find_spans("iban DE89 3704 0044 0532 0130 00, wrong GB82WEST12345698765433", W)
    assert [(k, a, b) for k, a, b, _ in spans if k == "iban"] == [("iban", 5, 32)]
    # Words around an account number are no part of it, and its case does not matter.
    for text, start, end in (
            ("IBAN DE89 3704 0044 0532 0130 00 EUR 50", 5, 32), ("IBAN DE89 3704 0044 0532 0130 00 PLEASE", 5, 32),
            ("DE89370400440532013000 BIC COBADEFF", 0, 22), ("konto de89370400440532013000.", 6, 28), ("NO9386011117947", 0, 15),
            ("GB82 WEST 1234 5698 7654 32 DE89370400440532013000", 0, 27)):
        found = [(a, b) for k, a, b, _ in personal.find_spans(text, W) if k == "iban"]
        assert found[0] == (start, end) and len(found) == 1 + ("GB82" in text), text
    assert personal.find_spans("DE893704004405320130001", W) == [] == personal.find_spans("QQ89370400440532013000", W)
    assert [k for k, *_ in personal.find_spans("ssn 078-05-1120", W)] == ["ssn"]
    assert personal.find_spans("code 078-05-1120", W) == []
    near, far = (personal.find_spans(t, W)[0][3] for t in ("host 10.0.0.1", "version 10.0.0.1"))
    assert near > far and 0 <= far <= near <= 1


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "1 " * 200_000, "@" * 200_000, "+1" * 200_000, "a.b@" * 100_000):
        personal.find_spans(text, W)


def test_awkward_rows(awkward, nothing, spark):
    found = personal.redacted(personal.personal_data(awkward))
    assert found.count() == 10 and found.where("size(pii) > 0").count() == 0
    assert personal.personal_data(nothing).count() == 0
    docs = spark.createDataFrame([(1, "mail a@b.de or +49 30 1234567", 3)], "doc_id long, text string, pii int")
    row = personal.redacted(personal.personal_data(docs)).first()
    assert row["text_redacted"] == "mail <email> or <phone>" and len(row["pii"]) == 2
