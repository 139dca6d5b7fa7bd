import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelcast.llm import mixing


def poisson(rate, doc_id, seed=mixing.SEED):
    pieces = max(1, math.ceil(rate / mixing.PIECE_MEAN))
    mean, total = rate / pieces, 0
    for j in range(1, pieces + 1):
        u = int(hashlib.md5(f"{seed}:{doc_id}:{j}".encode()).hexdigest()[:13], 16) / 2 ** 52
        p = c = math.exp(-mean)
        n = 0
        while c < u and n <= mixing.TERMS:
            n += 1
            p *= mean / n
            c += p
        total += n
    return total


def corpus(spark, n=3000):
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").otherwise(None).alias("source"))


def test_counts_match_brute_force_and_targets(spark):
    docs = corpus(spark)
    weights = spark.createDataFrame([("hot", 1.0), ("b", 3.0), (None, 4.0)], "group string, weight double")
    out = mixing.mix(docs, weights=weights, epochs=8.0).collect()
    rows = docs.collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len(r["text"])
    total = sum(size.values())
    share = {"hot": 1 / 8, "b": 3 / 8, None: 4 / 8}
    rate = {s: 8 * total * share[s] / size[s] for s in size}
    copies = Counter(r["doc_id"] for r in out)
    assert copies == Counter({r["doc_id"]: n for r in rows if (n := poisson(rate[r["source"]], r["doc_id"]))})
    chars = Counter()
    for r in out:
        chars[r["source"]] += len(r["text"])
    for s in size:
        assert chars[s] / sum(chars.values()) == pytest.approx(share[s], abs=0.02)
    assert all(sorted(k for i, k in ((r["doc_id"], r["__copy"]) for r in out) if i == d) == list(range(1, copies[d] + 1))
               for d in list(copies)[:20])


def test_large_rates_are_sums_of_pieces(spark):
    docs = spark.createDataFrame([(k, "x", "a") for k in range(30)], "doc_id long, text string, source string")
    out = Counter(r["doc_id"] for r in mixing.mix(docs, epochs=1000.0).collect())
    assert out == Counter({k: poisson(1000.0, k) for k in range(30)})


def test_order_is_a_global_shuffle(spark):
    out = mixing.mix(corpus(spark)).select("__order", F.spark_partition_id().alias("p"), "doc_id").collect()
    by = {}
    for r in out:
        by.setdefault(r["p"], []).append(r)
    for rows in by.values():
        assert [r["__order"] for r in rows] == sorted(r["__order"] for r in rows)
    first = [r["doc_id"] for r in sorted(out, key=lambda r: r["__order"])]
    assert first != sorted(first)


def test_odd_input(spark):
    rows = [(1, None, "e"), (2, "", "e"), (None, "abc", "a"), (3, "abc", "none"), (3, "abc", "none"), (4, "x" * 100_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__rate2", F.lit(1))
    weights = spark.createDataFrame([("a", 1.0), ("e", 1.0)], "group string, weight double")
    out = mixing.mix(docs, weights=weights, epochs=1.0)
    assert set(out.columns) == {*docs.columns, "__copy", "__order"}
    got = Counter((r["doc_id"], r["source"]) for r in out.collect())
    assert not any(s == "none" for _, s in got)  # no weight: not in the mix
    assert got.get((1, "e"), 0) == poisson(1.0, 1) and got.get((2, "e"), 0) == poisson(1.0, 2)
    same = Counter(r["doc_id"] for r in mixing.mix(docs).where("doc_id = 3").collect())
    assert same.get(3, 0) % 2 == 0  # equal ids draw equal counts
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rows_without_id_and_clashing_columns(spark, make_docs):
    names = ["__n", "__rate", "__group", "__cdf", "__copy", "__order"]
    docs = make_docs([(None, f"text number {k}") for k in range(400)]).selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    out = mixing.mix(docs).collect()
    counts = {}
    for r in out:
        counts[r["text"]] = counts.get(r["text"], 0) + 1
        assert [r[n] for n in names[:4]] == names[:4] and isinstance(r["__copy"], int)
    assert len(set(counts.values())) > 1 and len({r["__order"] for r in out}) == len(out)
