import random
import re

from pyspark.sql import functions as F

from panelcast.llm import decontaminate as d

ITEM = "A farmer named Robert sold 12 apples and Robert kept 7 kg of pears while Maria bought 12 plums from the old market near town"
ITEMS = [(1, ITEM), (2, "short item here"), (3, None), (4, ITEM)]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def found(spark, make_docs, texts):
    out = d.contained_items(make_docs(texts), items(spark)).collect()
    return {(r["__id"], r["__item"]): r["__changed"] for r in out}


def test_template_words(spark):
    df = spark.createDataFrame([("Then Anna paid 3.50 USD, and 20km later Bob's dog ran. Then 7\x01 x",)], "t string")
    out = df.select(d.template_words("t")).first()[0]
    assert out == ["then", "\x01anna", "paid", "\x023\x0450", "\x03usd", "and", "\x0220", "\x03km", "later", "\x01bob", "s", "dog", "ran",
                   "then", "\x027", "x"]


def test_exact_changed_and_inconsistent_copies(spark, make_docs, words):
    filler = words(80, 1)
    changed = ITEM.replace("Robert", "Walter").replace("12", "55").replace("Maria", "Greta").replace("7 kg", "9 lb")
    broken = ITEM.replace("Robert sold", "Walter sold").replace("12 plums", "31 plums")  # 12 -> 12 and 31, Robert -> two names
    wrong_words = re.sub(r"(apples|kept|pears|bought|plums|market)", "zzz", ITEM)
    out = found(spark, make_docs, [filler + " " + ITEM + " " + filler, f"{filler}. {changed}.", broken, wrong_words, filler,
                                   ITEM.upper(), changed + ". " + ITEM, None, "", "a b c d"])
    # in one alignment 12 meets 12 and 31, so no consistent alignment is left
    assert out == {(0, 1): False, (0, 4): False, (1, 1): True, (1, 4): True, (6, 1): True, (6, 4): True} | (
        {(5, 1): out[5, 1], (5, 4): out[5, 4]} if (5, 1) in out else {})


def test_matches_brute_force_on_plain_prose(spark, make_docs, words):
    texts = [words(120, k) for k in range(30)]
    bench = [(k, " ".join(texts[k].split()[20:60])) for k in range(0, 10)] + [(100, words(40, 999))]
    df = spark.createDataFrame(bench, "item_id long, text string")
    texts[25] = texts[25] + " " + " ".join(bench[0][1].split()[:34])  # 30 of 36 windows
    texts[26] = texts[26] + " " + " ".join(bench[0][1].split()[:30])  # 26 of 36 windows: below 0.8
    got = {(r["__id"], r["__item"]) for r in d.contained_items(make_docs(texts), df).collect()}
    expected = set()
    for i, t in enumerate(texts):
        ws = t.lower().split()
        wins = {tuple(ws[k:k + 5]) for k in range(len(ws) - 4)}
        for j, b in bench:
            bs = b.lower().split()
            mine = [tuple(bs[k:k + 5]) for k in range(len(bs) - 4)]
            if sum(w in wins for w in mine) >= 0.8 * len(mine):
                expected.add((i, j))
    assert got == expected and (25, 0) in got and (26, 0) not in got


def test_placeholder_windows_need_their_values(spark, make_docs):
    bench = spark.createDataFrame([(1, "1 2 3 4 5 6 7 8")], "item_id long, text string")
    out = d.contained_items(make_docs(["9 8 7 6 5 4 3 2", "x 1 2 3 4 5 6 7 8 y"]), bench)
    assert [r["__id"] for r in out.collect()] == [1]


def test_large_benchmarks_join_by_shuffle(spark, make_docs, monkeypatch):
    monkeypatch.setattr(d, "small_side", lambda df, limit=0: df)
    assert found(spark, make_docs, [ITEM, "else"]) == {(0, 1): False, (0, 4): False}


def test_drop_keeps_rows_and_columns(spark, make_docs):
    docs = make_docs([(None, "clean text of five words"), (1, ITEM), (1, ITEM), (None, ITEM), (2, None)]).withColumn("__hash", F.lit(1))
    kept = d.drop_contaminated(docs, items(spark))
    assert kept.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == [(2, None), (None, "clean text of five words")]
    assert d.drop_contaminated(docs, items(spark).limit(0)).count() == 5
    assert d.drop_contaminated(docs.limit(0), items(spark)).count() == 0


TOM = "Tom has 3 apples. Tom buys 5 more apples. How many apples does Tom have now?"


def test_names_at_sentence_starts(spark, make_docs):
    df = spark.createDataFrame([(1, TOM)], "item_id long, text string")
    anna = TOM.replace("Tom", "Anna").replace("3", "4").replace("5", "7")
    mixed = anna.replace("Anna buys", "Greta buys")  # one name of the item meets two
    texts = [f"Old text here.\n{anna} And more.", mixed, TOM, f"How we met in The Hague. {anna} The end, How nice.", TOM.replace("Tom", "Has")]
    out = {r["__id"]: (r["__changed"], r["__matched"], r["__windows"]) for r in d.contained_items(make_docs(texts), df).collect()}
    assert out[0] == (True, 12, 12) and out[2] == (False, 12, 12)
    assert 1 not in out and 3 in out and 4 in out


def test_case_changes_lose_no_verbatim_copy(spark, make_docs, words):
    filler = words(40, 2)
    cases = [ITEM.upper(), ITEM.lower(), ITEM.title(), f"{filler} {ITEM.upper()} {filler}", ITEM.swapcase()]
    out = d.contained_items(make_docs(cases), items(spark)).collect()
    assert {(r["__id"], r["__item"]) for r in out} == {(k, i) for k in range(len(cases)) for i in (1, 4)}
    assert all(r["__matched"] == r["__windows"] for r in out)
    # items in capitals meet documents in mixed case as well
    loud = spark.createDataFrame([(1, ITEM.upper()), (2, TOM.title())], "item_id long, text string")
    assert {(r["__id"], r["__item"]) for r in d.contained_items(make_docs([ITEM, TOM, ITEM.title(), TOM.upper()]), loud).collect()} == {
        (0, 1), (1, 2), (2, 1), (3, 2)}


def without_probe(docs, items):
    """Every document's templates against every item's, as the definition says."""
    named = items.select(F.col("item_id").alias("__item"), F.col("text").alias("__text"))
    bench = d.template_windows(named, ["__item"], "__text")
    total = bench.groupBy("__item").agg(F.count_distinct("__at").alias("__windows"))
    needles = bench.join(total, "__item").selectExpr("__hash", "__item", "__windows", "__at AS __item_at", "__t AS __item_t", "__v AS __item_v")
    rows = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key"), F.col("text").alias("__text"))
    return d._consistent(d.template_windows(rows, ["__id", "__key"], "__text").join(needles, "__hash"), d.MIN_COVERAGE)


def question(rnd):
    """A short text with names, numbers, units, odd characters and common words."""
    some = ["the", "of", "has", "Tom", "Anna", "Bob", "3", "12", "4.5", "kg", "min", "apples", "How", "x²", "Σας", "7kg", "m", "to", "is", "old"]
    return "".join(rnd.choice(some) + rnd.choice([" ", " ", " ", ". ", ", ", "\n"]) for _ in range(rnd.randint(3, 25)))


def asked_again(rnd, text):
    """The text with other names, numbers or case, or with words lost."""
    for a, b in rnd.choice([[("Tom", "Bob"), ("Anna", "Tom")], [("3", "9"), ("12", "9")], [("kg", "lb")], [("Tom", "Anna")], []]):
        text = text.replace(a, b)
    change = rnd.choice([str, str, str.upper, str.lower, lambda x: x.replace("the", "a", 1), lambda x: x[:int(len(x) * 0.9)]])
    return change(text)


def test_probe_loses_nothing(spark, make_docs, monkeypatch):
    rnd = random.Random(8)
    questions = [question(rnd) for _ in range(120)] + ["1 2 3 4 5 6 7 8", "Tom Anna Bob Tom Anna Bob"]
    bench = spark.createDataFrame([*enumerate(questions), (None, "not looked for at all here")], "item_id long, text string")
    texts = [f"{question(rnd)} {asked_again(rnd, rnd.choice(questions))} {question(rnd)}" for _ in range(250)]
    docs = make_docs(texts)
    key = lambda df: sorted((r["__id"], r["__item"], r["__windows"], r["__matched"], r["__changed"]) for r in df.collect())
    want = key(without_probe(docs, bench))
    assert len(want) > 100 and key(d.contained_items(docs, bench)) == want
    monkeypatch.setattr(d, "small_side", lambda df, limit=0: df)
    assert key(d.contained_items(docs, bench)) == want


WORD = re.compile(r"\d+(?:[.,]\d+)*|[A-Za-z]+")


def plain_template(text):
    """Template and value of every word for texts of ASCII words: names inside sentences and at starts, numbers, units."""
    found = [(m[0], m.start()) for m in WORD.finditer(text)]
    names = {w.lower() for w, at in found if w[0].isupper() and w[1:].islower() and at > 1 and text[at - 1] == " "
             and (text[at - 2].islower() or text[at - 2].isdigit() or text[at - 2] in ",;:)")}
    out = []
    for k, (w, at) in enumerate(found):
        if w[0].isdigit():
            out.append(("number", w))
        elif k and found[k - 1][0][0].isdigit() and w.lower() in d.UNITS and at - found[k - 1][1] - len(found[k - 1][0]) <= 1 \
                and text[at - 1] in " 0123456789":
            out.append(("unit", w.lower()))
        elif w[0].isupper() and w[1:].islower() and w.lower() in names:
            out.append(("name", w.lower()))
        else:
            out.append((w.lower(), w.lower()))
    return out


def test_names_numbers_and_units_match_brute_force(spark, make_docs):
    rnd = random.Random(9)
    people, things = ["Tom", "Anna", "Bob", "Carla"], ["apples", "pears", "old books", "red hats"]

    def ask():
        a, b = rnd.choice(people), rnd.choice(people)
        return f"Once {a} gave {rnd.randint(2, 5)} {rnd.choice(things)} to {b} and then {b} sold {rnd.randint(2, 5)} {rnd.choice(['kg', 'lb'])} " \
               f"of {rnd.choice(things)} so how much is left for {rnd.choice([a, b])} today"

    bench = [(k, ask()) for k in range(40)]
    texts = [ask() for _ in range(120)]
    got = {(r["__id"], r["__item"]) for r in d.contained_items(make_docs(texts), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = set()
    for j, b in bench:
        item = plain_template(b)
        n = len(item) - 4
        for i, x in enumerate(texts):
            doc = plain_template(x)
            covered = set()
            for shift in range(-len(item), len(doc)):
                met = [k for k in range(n) if 0 <= k + shift <= len(doc) - 5 and all(item[k + e][0] == doc[k + e + shift][0] for e in range(5))]
                slots = {(item[k + e], doc[k + e + shift]) for k in met for e in range(5) if item[k + e][0] in ("name", "number", "unit")}
                named = {s for s in slots if s[0][0] != "number"}
                if len({a for a, _ in slots}) == len(slots) and len({v for _, v in named}) == len(named):
                    covered |= set(met)
            if len(covered) >= d.MIN_COVERAGE * n:
                want.add((i, j))
    assert got == want and len(got) > 20


def test_two_names_never_become_one(spark, make_docs):
    bench = spark.createDataFrame([(1, "Here is what Tom gave to Anna before Tom and Anna went home to eat 3 or 5 plums")], "item_id long, text string")
    swap = lambda a, b, n, m: f"Here is what {a} gave to {b} before {a} and {b} went home to eat {n} or {m} plums"
    texts = [swap("Bob", "Bob", 3, 5), swap("Bob", "Tom", 3, 5), swap("Anna", "Tom", 4, 4)]
    assert {r["__id"] for r in d.contained_items(make_docs(texts), bench).collect()} == {1, 2}


def test_two_hundred_thousand_item_windows(spark, make_docs, words):
    bench = [(k, words(104, 10_000 + k)) for k in range(2_000)]
    df = spark.createDataFrame(bench, "item_id long, text string").repartition(8)
    texts = [words(50, k) for k in range(40)] + [f"{words(30, k)} {bench[k * 37][1].upper()} end" for k in range(40, 50)]
    out = d.contained_items(make_docs(texts), df).collect()
    assert {(r["__id"], r["__item"]) for r in out} == {(k, k * 37) for k in range(40, 50)}
    assert sum(r["__windows"] for r in out) == 1_000


def test_clashing_names_and_empty_tables(spark, make_docs):
    docs = make_docs([ITEM, "other words", None]).selectExpr("*", "7 AS __key", "8 AS __found_id", "9 AS __item")
    kept = d.drop_contaminated(docs, items(spark))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.select("doc_id", "__key", "__found_id", "__item").collect())) == [(1, 7, 8, 9), (2, 7, 8, 9)]
    assert d.contained_items(docs.limit(0), items(spark)).count() == 0
    assert d.contained_items(docs, items(spark).limit(0)).count() == 0
