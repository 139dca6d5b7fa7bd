import random
from pathlib import Path

import pytest

from panelcast.llm import tokencount as t

RANKS = Path(t.VOCABULARY).read_bytes()
ALPHABET = ["a", "word", " ", "  ", "\n", "\r\n", "'ll", "'s", "12", "345", "!", "é", "　", "\x1c", "\t", "_", "中", "\U0001f600", ". The"]


@pytest.fixture(scope="module")
def count():
    return t.counter(RANKS)


def messy(rnd, n):
    return "".join(rnd.choice(ALPHABET) for _ in range(n))


@pytest.fixture
def small_segments(monkeypatch):
    monkeypatch.setattr(t, "SEGMENT", 5)


def test_segments_add_up(count, small_segments):
    rnd = random.Random(1)
    for _ in range(300):
        text = messy(rnd, rnd.randint(0, 60))
        parts = t.segments(text)
        assert "".join(parts) == text
        assert sum(map(count, parts)) == count(text)


def edited(text, edits):
    for s, e, new in sorted(edits, key=lambda x: (x[0], x[1]))[::-1]:
        text = text[:s] + new + text[e:]
    return text


def random_edits(rnd, n):
    out, at = [], 0
    while at <= n and len(out) < 6:
        s = at + rnd.randint(0, 8)
        e = s + rnd.randint(0, 12)
        if e > n:
            break
        out.append((s, e, messy(rnd, rnd.randint(0, 4))))
        at = e + 1
    return out


def test_edits_equal_a_full_recount(count, small_segments):
    rnd = random.Random(2)
    for _ in range(400):
        text = messy(rnd, rnd.randint(0, 80))
        edits = random_edits(rnd, len(text))
        tree = t.build(text, count)
        t.apply_edits(tree, edits)
        new = edited(text, edits)
        assert "".join(tree.parts) == new
        assert (tree.total, tree.chars[1]) == (count(new), len(new))


def test_an_edit_touches_little(count):
    text = "some plain words of a text " * 4_000
    tree = t.build(text, count)
    t.apply_edits(tree, [(50_000, 50_004, "other")])
    assert tree.total == count(edited(text, [(50_000, 50_004, "other")]))
    assert 0 < tree.reencoded < 3 * t.SEGMENT


def test_documents_match_brute_force(spark, make_docs, count, words):
    texts = [None, "", " ", "x\nx\nx y@z.co", words(900, 3) + "\n" + words(30, 4) + "\n" + words(30, 4), "a" * 20_000, "\n" * 500]
    rows = {r["doc_id"]: r for r in t.count_tokens(make_docs(texts)).collect()}
    for i, x in enumerate(texts):
        x = x or ""
        new = edited(x, t.cleaning_edits(x))
        assert (rows[i]["n_tokens"], rows[i]["n_tokens_after"], rows[i]["n_chars_after"]) == (count(x), count(new), len(new))
        assert sum(rows[i]["seg_chars"]) == len(new) and sum(rows[i]["seg_tokens"]) == count(new)
    assert rows[3]["n_edits"] == 2
    assert t.count_tokens(make_docs(["a"]).limit(0)).count() == 0


def test_stored_state_takes_further_edits(spark, count, words):
    texts = [words(800, k) for k in range(5)]
    kind = "doc_id long, text string, seg_chars string, edits array<struct<start:int,end:int,new:string>>"
    docs = spark.createDataFrame([(i, x, "clash", []) for i, x in enumerate(texts)], kind).drop("seg_chars")
    state = t.count_tokens(docs, edits_col="edits").select("doc_id", "seg_chars", "seg_tokens")
    edits = [(100, 120, "changed words"), (3000, 3000, " inserted"), (10 ** 6, 10 ** 6 + 5, "!")]
    again = spark.createDataFrame([(i, x, edits) for i, x in enumerate(texts)], "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>") \
        .join(state, "doc_id")
    for r in t.recount(again, "doc_id", "text", "edits").collect():
        x = texts[r["doc_id"]]
        n = len(x)
        new = edited(x, [(min(s, n), min(e, n), v) for s, e, v in edits])
        assert (r["n_tokens"], r["n_tokens_after"]) == (count(x), count(new))
        assert r["n_reencoded"] < len(x) / 2
