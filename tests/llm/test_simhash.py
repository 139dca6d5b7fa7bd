import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from panelcast.llm import simhash
from panelcast.llm.components import components


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values))


def brute_components(fps, radius=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_definition(words):
    texts = ["", "  \n", "One", "one TWO", "one two three", words(300, 1), "É È one two three four one two three", "a b c\x1cd e f"]
    for t in texts:
        assert simhash.fingerprint(t) & (2 ** 64 - 1) == brute_fingerprint(t)
    assert simhash.fingerprint(None) == 0


def test_spark_hash_is_the_same_xxh64(spark):
    row = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert row & (2 ** 64 - 1) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_covering_masks_miss_no_pair():
    masks = [m & (2 ** 64 - 1) for m in simhash.covering_masks()]
    assert len(masks) == 15
    rnd = random.Random(2)
    for _ in range(5000):
        diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3)))
        assert any(diff & m == 0 for m in masks)


def near(rnd, center, bits):
    for b in rnd.sample(range(64), bits):
        center ^= 1 << b
    return center


def fixture(seed=3):
    rnd = random.Random(seed)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    fps += [near(rnd, fps[k % 5], rnd.randint(1, 4)) for k in range(120)]
    return list(dict.fromkeys(fps))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def linked(spark, fps, block):
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "__fp long")
    edges = simhash.links(nodes, block=block)
    assert all(bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 3 for a, b in edges.collect())
    root = dict(components(edges).collect())
    groups = {}
    for i, x in enumerate(fps):
        groups.setdefault(root.get(signed(x), signed(x)), set()).add(i)
    return sorted(map(sorted, groups.values()))


def test_links_connect_like_all_pairs_in_blocks_and_by_midpoints(spark):
    fps = fixture()
    roots = brute_components(fps)
    expected = sorted(sorted(i for i, r in enumerate(roots) if r == k) for k in set(roots))
    assert linked(spark, fps, block=4096) == expected
    assert linked(spark, fps, block=3) == expected  # larger buckets go by midpoints


def test_star_links_cover_a_chain():
    chain = np.array([(1 << (3 * k)) - 1 for k in range(20)], dtype=np.uint64)  # each 3 bits from the next
    a, b = simhash._star_links(chain, 3)
    assert len(a) == len(b) == 19


def test_components_of_long_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (7, 6)]
    out = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {out[k] for k in range(61)} == {0} and {out[k] for k in range(1000, 1200)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_end_to_end(make_docs, words):
    base = words(200, 5)
    texts = [words(60, 9), base, base, base.replace("an ", "AN ", 1), None, "", " \n", "two words"]
    docs = make_docs([(10 + i, t) for i, t in enumerate(texts)] + [(13, base), (None, base)])
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 2
    fps = [brute_fingerprint(t) for t in texts]
    roots = brute_components(fps)
    expected = {10 + i: 10 + min(j for j, r in enumerate(roots) if r == roots[i]) for i in range(len(texts))}
    for r in rows:
        assert r["__component"] == expected[11 if r["__id"] is None else r["__id"]]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_clashing_columns_pass_through(spark, make_docs, words):
    text = words(60, 1)
    names = ["__key", "__keep_id", "__keep_key", "__fp", "__id"]
    docs = make_docs([text, text, words(60, 2), None]).selectExpr("*", *[f"{k} AS {n}" for k, n in enumerate(names)])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows) == [0, 2, 3]
    assert all([r[n] for n in names] == list(range(len(names))) for r in rows)
