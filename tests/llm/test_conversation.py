import hashlib
import random
import sys
import zlib
from functools import lru_cache
from itertools import product

import pytest
import xxhash
from pyspark.sql import functions as F

from panelcast.llm import conversation as c
from panelcast.llm import queries as q

sys.setrecursionlimit(20_000)
ROWS = "conv_id long, turn long, role string, text string"
GAP = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """Least (cost, audit) by trying every edit of every row, up to two insertions at every place."""
    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        out = []
        if i == len(rows) and state in c.ACCEPT:
            out.append((0, ""))
        if inserted < 2:
            for r in "ua":
                if (state, r) in c.STEP and (rest := best(i, c.STEP[state, r], inserted + 1)):
                    out.append((3 + rest[0], "I" + rest[1]))
        if i < len(rows):
            role, fault = rows[i]
            if rest := best(i + 1, state, 0):
                out.append((4 + rest[0], "D" + rest[1]))
            if fault < 2:
                for r, cost, edit in [(role, 0, "K"), ("u", 3, "R"), ("a", 3, "R")]:
                    if (state, r) in c.STEP and (rest := best(i + 1, c.STEP[state, r], 0)):
                        out.append((cost + 3 * fault + rest[0], edit + rest[1]))
        return min(out) if out else None

    return best(0, c.START, 0)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_agenda_finds_the_least_derivation(n):
    kinds = [("s", 0), ("u", 0), ("a", 0), ("a", 1), ("u", 1), ("", 0), ("u", 2)]
    for rows in product(kinds, repeat=n):
        assert c.lightest_repair(rows) == plain_repair(rows) == c.goal(c.block_cells(rows))


@pytest.mark.parametrize("block", [1, 2, 3])
def test_joined_blocks_equal_one_run(block):
    rnd = random.Random(block)
    for _ in range(400):
        rows = tuple((rnd.choice("suua"), rnd.choice([0, 0, 0, 1, 2])) for _ in range(rnd.randint(1, 11)))
        parts = [c.block_cells(rows[k:k + block]) for k in range(0, len(rows), block)]
        assert c.goal(c.join_cells(parts)) == plain_repair(rows)


def text_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - 2 ** 64 if h >= 2 ** 63 else h


def brute(table):
    """The query's result per conversation, row by row."""
    out = {}
    space = lambda v: " " if v is None else str(v)
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            what = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            role, text = space(role), space(text)
            if what == 0:
                continue
            text = "" if what == 1 else "".join(x for x in text if x not in ".!?") if what == 2 else text
            rows += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], text_hash(r[2])))
        seen, faults, shapes = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in rows:
            fault = 0
            if not text.strip(GAP):
                faults["blank"] += 1
                fault = 2
            elif (role, text) in seen:
                faults["duplicate"] += 1
                fault = 2
            elif text.strip(GAP)[-1] not in ".!?":
                faults["truncated"] += 1
                fault = 1
            seen.add((role, text))
            shapes.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault))
        turns = {r[0] for r in rows if r[0] is not None}
        cost, audit = plain_repair(tuple(shapes))
        todo, kept = iter(rows), []
        for e in audit:
            row = None if e == "I" else next(todo)
            if e != "D":
                kept.append((e, row))
        odd = len(kept) % 2
        lines = []
        for k, (e, row) in enumerate(kept):
            new = ["user", "assistant"][(k - odd) % 2]
            lines.append(f"{row[1] if e == 'K' else new}:{'' if e == 'I' else row[2]}")
        out[conv] = {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **faults,
                     "illegal": sum(a[1][:1] + b[1][:1] not in c.LEGAL_PAIRS for a, b in zip(rows, rows[1:])),
                     "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def check(spark, table, parts):
    df = spark.createDataFrame(table, ROWS).repartition(parts) \
        .withColumn("__conv", F.lit("clash")).withColumn("audit", F.lit(1)).withColumn("__part", F.lit(2))
    rows = c.repair(c.damaged(df)).collect()
    assert len(rows) == len({r["__conv"] for r in rows})
    found = {r["__conv"]: {k: v for k, v in r.asDict().items() if k != "__conv"} for r in rows}
    assert found == brute(table)


def messy(rnd, convs, longest):
    texts = ["Yes.", "No", "Why? ", " \t", "", None, "Ja!\n", "a ", " ", "x" * 3_000 + ".", "Yes.", "more."]
    return [(conv, rnd.choice([t, t, t, None, t + 3]), rnd.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"]),
             rnd.choice(texts)) for conv in convs for t in range(rnd.randint(1, longest))]


def test_query_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 3)
    rnd = random.Random(4)
    table = messy(rnd, [*range(300), None], 9)
    check(spark, table + rnd.sample(table, 60), 5)


def test_one_conversation_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rnd = random.Random(5)
        hot = [(7, t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice([f"line {t}.", f"line {t}", "same."]))
               for t in range(250)]
        check(spark, hot + messy(rnd, range(100, 120), 6), 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_rows_and_empty_table(spark):
    table = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Yes."), (2, 5, "assistant", "Only")]
    df = spark.createDataFrame(table, ROWS)
    rows = c.undamaged(df)
    found = c.deduced(rows)
    assert {r["__conv"]: (r["cost"], r["audit"]) for r in found.collect()} == {1: (3, "KIKK"), 2: (4, "D")}
    got = sorted((r["__conv"], r["__place"], r["__edit"], r["__role"], r["__text"]) for r in c.repaired_rows(rows, found).collect())
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "Hello."), (1, 3, "K", "assistant", "Yes.")]
    empty = c.repair(c.damaged(df.limit(0)))
    assert empty.count() == 0 and "repaired_sha256" in empty.columns


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = q.QUERIES["op11_conversation"](spark, sf).collect()
    assert {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in rows} == brute(table)
