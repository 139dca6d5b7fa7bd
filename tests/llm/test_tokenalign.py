import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from panelcast.llm import queries as q
from panelcast.llm import tokenalign as t

A, B = f"{q.TOKENIZERS}/byte_bpe_50k.json", f"{q.TOKENIZERS}/piece_bpe_32k.model"
PARTS = ["word", " ", "  ", "\n", "the house", " don't", "12", "345", "!", "é", "中文字", "\U0001f600", " \n ", "\t", "<|endoftext|>", "<s>", "<0x41>", "xyzzyq", " a"]


@pytest.fixture(scope="module")
def both():
    return t.sides(Path(A).read_bytes(), Path(B).read_bytes())


def messy(rnd, n):
    return "".join(rnd.choice(PARTS) for _ in range(n))


def brute(s, texts):
    """The query's row of every text, from the end offsets alone; no windows, no memory."""
    links, out = [], []
    for text in texts:
        a, b = s.encode([text or ""])
        a, b = a[0], b[0]
        want = b" " + (text or "").encode()
        if not text or b"".join(s.a_bytes[i] for i in a) != want or b"".join(s.b_bytes[i] for i in b) != want:
            links.append([])
            out.append([0, 0, 0, ""])
            continue
        ends = []
        for ids, names in ((a, s.a_bytes), (b, s.b_bytes)):
            at, e = 0, {}
            for k, i in enumerate(ids):
                at += len(names[i])
                e[at] = k
            ends.append(e)
        groups, i0, j0, mine = [], 0, 0, []
        for at in sorted(ends[0].keys() & ends[1].keys()):
            i, j = ends[0][at], ends[1][at]
            groups.append(",".join(map(str, a[i0:i + 1])) + "|" + ",".join(map(str, b[j0:j + 1])))
            mine.append((a[i], b[j]))
            i0, j0 = i + 1, j + 1
        links.append(mine)
        out.append([len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    counts = Counter(p for mine in links for p in mine)
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(highest.get(j, 0), n)
    return [(na, nb, ng, len(m), sum(counts[p] == highest[p[1]] for p in m), sum(counts[p] for p in m), sha)
            for (na, nb, ng, sha), m in zip(out, links, strict=True)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_token_bytes_are_those_of_the_texts(both):
    rnd = random.Random(1)
    for _ in range(300):
        text = messy(rnd, rnd.randint(1, 20))
        (a,), (b,) = both.encode([text])
        assert both.whole(text, a, b), text
    for text in ["a▁b", "▁"]:
        (a,), (b,) = both.encode([text])
        assert not both.whole(text, a, b)


def test_windows_align_like_the_whole(both):
    rnd = random.Random(2)
    for _ in range(300):
        text = messy(rnd, rnd.randint(1, 30))
        (a,), (b,) = both.encode([text])
        ((groups, n, links),) = t.Aligner(both).documents([a], [b])
        (whole,) = t.align(np.array(a), np.array([len(a)]), np.array(b), np.array([len(b)]), both)
        assert (groups, n, links.tolist()) == whole


def test_windows_with_equal_fingerprints_stay_apart(both, monkeypatch):
    texts = ["the house of the old don't 345", "other words é"]
    a, b = both.encode(texts)
    want = [x[:2] + (x[2].tolist(),) for x in t.Aligner(both).documents(a, b)]
    plain = t.fingerprints
    monkeypatch.setattr(t, "fingerprints", lambda *x: plain(*x) % 3 if x[-1] == 1 else plain(*x))
    assert [x[:2] + (x[2].tolist(),) for x in t.Aligner(both).documents(a, b)] == want


def test_memory_goes_by_both_fingerprints(both, monkeypatch):
    """Later documents find earlier windows, also where the first fingerprints of different windows are equal."""
    plain = t.fingerprints
    calls = [both.encode([x]) for x in ("the house of the old", "don't the house 345", "the house of the old é")]
    want = [[y[:2] + (y[2].tolist(),) for y in t.Aligner(both).documents(*c)] for c in calls]
    for some in (2**64 - 1, 1):
        monkeypatch.setattr(t, "fingerprints", lambda *x, some=some: plain(*x) & np.uint64(some) if x[-1] == 1 else plain(*x))
        aligner = t.Aligner(both)
        assert [[y[:2] + (y[2].tolist(),) for y in aligner.documents(*c)] for c in calls] == want
        assert all(type(mark) is int and type(check) is int for mark, (check, _) in aligner.memo.items())
        assert len(aligner.memo) <= 2 or some > 1


def test_documents_match_brute_force(spark, both, make_docs, monkeypatch):
    monkeypatch.setattr(t, "MEMO", 50)
    monkeypatch.setattr(t, "TOGETHER", 100)
    rnd = random.Random(3)
    texts = [None, "", " ", "a▁b", "x" * 5_000, "the house " * 4_000, "the house", "the house"] + [messy(rnd, rnd.randint(1, 40)) for _ in range(60)]
    docs = make_docs(texts).selectExpr("*", "'clash' AS row", "1 AS pair", "'x' AS id")
    rows = {r["id"]: tuple(r[c] for c in COLUMNS) for r in t.alignment(docs, A, B).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(both, texts)
    assert rows[0] == rows[1] == rows[3] == (0, 0, 0, 0, 0, 0, "")


def test_repeated_ids_and_empty_table(spark, both, make_docs):
    pairs = [(1, "the house"), (1, "the house"), (1, "other"), (None, "the")]
    got = sorted(((r["id"], *(r[c] for c in COLUMNS)) for r in t.alignment(make_docs(pairs), A, B).collect()), key=repr)
    assert got == sorted(((i, *r) for (i, _), r in zip(pairs, brute(both, [x for _, x in pairs]), strict=True)), key=repr)
    assert t.alignment(make_docs(["a"]).limit(0), A, B).count() == 0


def test_alignment_itself_and_bound_of_pairs(spark, both, make_docs):
    r = t.aligned(make_docs(["the house"]), A, B, with_tokens=True).collect()[0]
    assert r["groups"] == t.Aligner(both).documents(*both.encode(["the house"]))[0][0]
    bound = t.possible_pairs(both.a_bytes, both.b_bytes)
    assert bound <= sum(map(len, both.a_bytes)) + sum(map(len, both.b_bytes))


def test_registered_query(spark, both):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in q.QUERIES["op13_token_align"](spark, sf).collect()}
    assert [rows[i] for i, _ in docs] == brute(both, [x for _, x in docs])


def test_both_libraries_split_alike(both):
    assert both.fast is not None
    plain = lambda x: both.a.encode(" " + x, add_special_tokens=False).ids
    for k in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]:
        c = chr(k)
        for x in (c, f"a{c}b", f"{c}{c} {c}", f"1{c}'s", f"\n{c} \n", f"  {c}1"):
            assert t.ALIKE.fullmatch(x) and both.encode([x])[0][0] == plain(x), (k, x)
    rnd = random.Random(7)
    for _ in range(500):
        x = messy(rnd, rnd.randint(0, 30))
        assert both.encode([x])[0][0] == plain(x)
    assert not t.ALIKE.fullmatch("中") and not t.ALIKE.fullmatch("a\U0001f600")
