import hashlib
import random
import re

import pytest

from panelcast.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(s):
    total = 0
    for k, c in enumerate(reversed(s)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = {"email": [m.span() for m in re.finditer(EMAIL, text)]}
    out["ip"] = [m.span() for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    out["card"] = [m.span() for m in re.finditer(CARD, text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out["phone"] = [m.span() for m in re.finditer(PHONE, text) if 9 <= len(digits(m.group())) <= 15]
    return out


CASES = [
    None, "", "no data at all", "mail a@b.co, c.d@e-f.g.h. x@y", "a@b..c@d.e", "a@b.c.%x@y.z", "a@b.c@d.e.f..g", "%@-.-", "é@b.c ü.x@y.z",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0255.1.1.001 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1111", "4111  1111 1111 1111",
    "1 - 4111111111111111", "41111111111111112", "4111 1111 1111 1111 1", "+1 (555) 010-9999 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +1.5",
    "++1 555 010 9999x", "5555555555554444", "a" * 3000 + "@" + "b." * 300 + "c", "1" * 5000, "1 " * 5000, "1  " * 3000, "1." * 3000,
    "@." * 2000, "x.y+z%" * 800, "\x01\x02 a@b.c \U0001f600 4111111111111111 \U0001f600 1.1.1.1",
]


def random_texts(n=150):
    rnd = random.Random(4)
    parts = ["a", "1", "4111111111111111", "4", "@", ".", " ", "-", "+", "%", "b.c", "2.3", "(", ")", "\n", "é", "00", "411111111111", "1111 "]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(n)]


def test_base_spans_match_the_definitions(make_docs):
    texts = CASES + random_texts()
    got = {r["doc_id"]: r for r in pii.span_digest(pii.find_spans(make_docs(texts))).collect()}
    for i, t in enumerate(texts):
        expected = brute(t)
        base = ",".join(f"{k}:{s}:{e}" for k in pii.BASE_KINDS for s, e in expected[k])
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [len(expected[k]) for k in pii.BASE_KINDS], t
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t


@pytest.mark.parametrize(("text", "spans", "scores"), [
    ("pay GB82WEST12345698765432 now", "iban:4:26", "80"),
    ("my bank: GB82WEST12345698765432", "iban:9:31", "100"),
    ("pay GB82WEST12345698765433 now", "", ""),  # fails mod 97
    ("number 123-45-6789", "", ""), ("her SSN 123-45-6789", "national:8:19", "60"),
    ("call +15550109999 or card 4111111111111111", "card:26:42,phone:5:17", "100,70"),
])
def test_checksums_and_context(make_docs, text, spans, scores):
    row = pii.span_digest(pii.find_spans(make_docs([text]))).first()
    assert (row["spans"], row["scores"]) == (spans, scores)


def test_empty_and_clashing_columns(make_docs):
    docs = make_docs(["a@b.c"]).withColumnRenamed("lang", "email").withColumnRenamed("source", "spans")
    assert pii.span_digest(pii.find_spans(docs)).first()["n_email"] == 1
    assert pii.span_digest(pii.find_spans(docs.limit(0))).count() == 0
    two = make_docs([(None, "a@b.c"), (None, "a@b.c")])
    assert [r["spans"] for r in pii.span_digest(pii.find_spans(two)).collect()] == ["email:0:5"] * 2
