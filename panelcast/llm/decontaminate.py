"""Benchmark decontamination by template windows [DataFrame functions only].

A text becomes a template: numbers, names and units give way to typed
placeholders, other words are lower-cased.  Windows of five template words of
the corpus meet the windows of the benchmark items by hash.  Along one
alignment of a document with an item (the same shift for all windows) the
values that stand in the placeholders must be consistent: every value of the
item always meets the same value of the document, and two names or units of the
item never meet the same one.  (Two numbers may: 3 and 5 asked again as 4 and 4
is the same question, while two persons who become one make another.)  An item is contained when
consistent alignments cover at least 0.8 of its windows, so that a question
asked again with other names and numbers is found, and a text that merely has
the same shape is not.

Only documents that can hold an item are made templates of.  A probe finds them
by plain words alone.  An item that is contained loses at most a fifth of its
windows, so of any ``loss + 1`` windows at least one is matched; in a matched
window the plain words are the same, whatever its form.  So every item names
``loss + 1`` windows, those with the longest stretches of plain words and, among
these, the rarest in the benchmark; the stretches' hashes meet the word
sequences of the corpus; and only (document, item) pairs that share one go on.
No contained item is lost.  An item of which too few windows hold a plain word
(a table of numbers) meets the templates of all documents.

A name is a capitalised word inside a sentence, and the same word at the start
of a sentence or line of the same text.  Windows are taken in up to three
forms, and an item's window may be met in any of them: names inside sentences
alone as placeholders; names at starts as well; all names as the lower-case
words they are, so that a copy in capitals, lower case or title case is found.
A name that stands at starts only is a plain word.

Results for odd input:
* null and empty texts, and texts and items of fewer than five words, have no
  windows and never match;
* a window with fewer than two plain words would match almost anything; its
  actual values are hashed instead of its placeholders;
* items without id are not looked for;
* equal items (ties) are all reported; repeated rows (equal id and text) are
  one document; null ids are told apart by their texts;
* very long texts are read whole; with an empty table of documents or items
  nothing is found, and ``drop_contaminated`` returns the documents;
* only the named columns are read, and ``drop_contaminated`` returns all others
  unchanged, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import fresh, same, small_side, text_key, text_or_empty
from panelcast.session import cut_lineage

WINDOW = 5
MIN_COVERAGE = 0.8
MIN_PLAIN = 2
# Rows (a hash and an item) of the probe that are broadcast: at most about 50 MB; beyond, the words' hashes are shuffled.
PROBE_ROWS = 500_000
# Units of measure that follow a number (fixed values).
UNITS = ("kg g mg lb lbs oz km m cm mm mi ft in l ml gal s sec secs seconds min mins minutes h hr hrs hours days "
         "weeks months years dollars euros cents usd eur percent degrees mph kph watts volts bytes kb mb gb tb").split()
# Marks put before a word of each type; they never occur in a text, which is cleaned of them first.
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
POINT = "\x04"  # a point or comma inside a number, which does not end the word
START = "\x05"  # a name of the text at the start of a sentence or line
# Hashes of the placeholders.
PLACEHOLDER = {NAME: 1, NUMBER: 2, UNIT: 3}


def marked_words(column: str) -> Column:
    """Lower-case words of a text, each name, number, unit and capitalised word elsewhere with its mark before it."""
    text = F.translate(text_or_empty(column), NAME + NUMBER + UNIT + POINT + START, "     ")
    text = F.regexp_replace(text, r"[.,](?<=\p{Nd}.)(?=\p{Nd})", POINT)
    # a capitalised word inside a sentence
    named = F.regexp_replace(text, r"(\p{Lu}(?<=[\p{Ll}\p{Nd},;:)] .)\p{Ll}+)", f"{NAME}$1")
    # capitalised words elsewhere, which are names if they are names inside a sentence
    started = F.regexp_replace(named, rf"(?<![\p{{L}}\p{{N}}{NAME}])(\p{{Lu}}\p{{Ll}}+)", f"{START}$1")
    counted = F.regexp_replace(
        started, rf"(\p{{Nd}}[\p{{Nd}}{POINT}]*)(?: ?{NAME}?((?i:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r"))(?![\p{L}\p{N}]))?",
        f" {NUMBER}$1 {UNIT}$2 ")
    words = F.split(F.lower(counted), rf"[^\p{{L}}\p{{N}}{NAME}{NUMBER}{UNIT}{POINT}{START}]+")
    return F.array_remove(F.array_remove(words, ""), UNIT)


def known_starts(words: Column) -> Column:
    """``words`` with the mark START left only before words that are names inside a sentence of the text."""
    names = F.filter(words, lambda w: F.startswith(w, F.lit(NAME)))
    starts = F.array_intersect(F.transform(names, lambda w: F.concat(F.lit(START), F.substring(w, 2, 1 << 30))), words)
    # the list is an element of an array of one, so that it is built once and not for every word
    return F.transform(F.array(starts), lambda known: F.transform(
        words, lambda w: F.when(F.array_contains(known, w), w).otherwise(F.ltrim(w, F.lit(START)))))[0]


def template_words(column: str) -> Column:
    """Lower-case words of a text, each name, number and unit with its mark before it; START before a name at a start."""
    return known_starts(marked_words(column))


def _hash_template(word: Column) -> Column:
    kind = F.substring(word, 1, 1)
    out = F.xxhash64(word)
    for mark, value in PLACEHOLDER.items():
        out = F.when(kind == mark, F.lit(value).cast("long")).otherwise(out)
    return out


def _form(words: Column, change) -> Column:
    changed = F.transform(words, change)
    return F.struct(F.transform(changed, _hash_template).alias("t"), F.transform(changed, lambda w: F.xxhash64(w)).alias("v"))


def template_windows(df: DataFrame, ids: list[str], text_col: str, width: int = WINDOW) -> DataFrame:
    """One row per window and form in which it differs: ids, __at, __hash, the template hashes __t and value hashes __v of its words."""
    raw = df.select(*ids, marked_words(text_col).alias("__raw"))
    words = raw.select(*ids, known_starts(F.col("__raw")).alias("__words"))
    kinds = words.withColumn("__kinds", F.transform("__words", lambda w: F.substring(w, 1, 1)))
    w, has = F.col("__words"), lambda mark: F.array_contains("__kinds", F.lit(mark))
    # each form with the kind of word that a window must hold to differ from the forms before it
    forms = F.array(
        F.struct(F.lit("").alias("m"), _form(w, lambda x: F.ltrim(x, F.lit(START))).alias("f")),
        F.when(has(START), F.struct(F.lit(START).alias("m"), _form(w, lambda x: F.translate(x, START, NAME)).alias("f"))),
        F.when(has(NAME), F.struct(F.lit(NAME).alias("m"), _form(w, lambda x: F.ltrim(x, F.lit(START + NAME))).alias("f"))))
    # no filter before explode, which would build the words again
    hashed = kinds.select(*ids, "__kinds", F.explode(forms).alias("__form")).select(
        *ids, "__kinds", F.col("__form.m").alias("__mark"), F.col("__form.f.t").alias("__ts"), F.col("__form.f.v").alias("__vs"))
    every = F.when(F.size("__ts") >= width, F.sequence(F.lit(0), F.size("__ts") - width))
    starts = F.when(F.col("__mark") == "", every).otherwise(F.filter(
        every, lambda at: reduce(lambda a, b: a | b, [F.col("__kinds")[at + k] == F.col("__mark") for k in range(width)])))
    at = hashed.select(*ids, "__ts", "__vs", F.explode(starts).alias("__at"))
    ts = [F.col("__ts")[F.col("__at") + k] for k in range(width)]
    vs = [F.col("__vs")[F.col("__at") + k] for k in range(width)]
    plain = reduce(lambda a, b: a + b, [F.when(t.between(1, 3), 0).otherwise(1) for t in ts])
    return at.select(*ids, "__at",
                     F.when(plain >= MIN_PLAIN, F.xxhash64(*ts)).otherwise(F.xxhash64(F.lit(0), *vs)).alias("__hash"),
                     F.array(*ts).alias("__t"), F.array(*vs).alias("__v"))


def _grams(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, at + k) for k in range(length)])


def probes(items: DataFrame, windows: DataFrame, width: int, min_coverage: float) -> DataFrame:
    """(__item, __gram, __len): stretches of plain words of which a document that contains the item has at least one.

    Null for an item with too few windows that hold a plain word.  ``windows`` has (__item, __windows).
    """
    words = items.select("__item", template_words("__text").alias("__w"))
    at = words.where(F.size("__w") >= width).select(
        "__item", "__w", F.explode(F.sequence(F.lit(0), F.size("__w") - width)).alias("__at"))
    w = F.col("__w")
    plain = [F.get(w, F.col("__at") + k).rlike(r"\A\p{L}+\z") for k in range(width)]
    # the longest stretch of plain words of the window
    longest = F.coalesce(*[
        F.when(reduce(lambda a, b: a & b, plain[k:k + n]), F.struct(F.lit(n).alias("n"), _grams(w, F.col("__at") + k, n).alias("g")))
        for n in range(width, 0, -1) for k in range(width - n + 1)])
    some = at.select("__item", "__at", longest.alias("__s")).where(F.col("__s").isNotNull()) \
        .select("__item", "__at", F.col("__s.n").alias("__len"), F.col("__s.g").alias("__gram"))
    shared = some.groupBy("__gram").agg(F.count_distinct("__item").alias("__items"))
    loss = F.col("__windows") - F.ceil(F.lit(min_coverage) * F.col("__windows"))
    best = Window.partitionBy("__item").orderBy(F.desc("__len"), "__items", "__at")
    ranked = some.join(shared, "__gram").select("__item", "__gram", "__len", F.row_number().over(best).alias("__r")).join(windows, "__item") \
        .where(F.col("__r") <= loss + 1)
    enough = ranked.groupBy("__item").agg(F.max("__r").alias("__most"))
    too_few = windows.join(enough, "__item", "left").where(F.coalesce("__most", F.lit(0)) < loss + 1)
    return ranked.join(too_few, "__item", "left_anti").select("__item", "__gram", "__len").distinct() \
        .unionByName(too_few.select("__item"), allowMissingColumns=True)


def candidates(docs: DataFrame, probe: DataFrame, lengths: list[int]) -> DataFrame:
    """(__id, __key, __item): documents (__id, __key, __text) with an item of which they share a probe."""
    words = docs.select("__id", "__key", F.split(F.lower(text_or_empty("__text")), r"[^\p{L}]+").alias("__w"))
    at = words.select("__id", "__key", "__w", F.explode(F.sequence(F.lit(0), F.size("__w") - 1)).alias("__at"))
    grams = [_grams(F.col("__w"), F.col("__at"), n) for n in lengths]
    one = at.select("__id", "__key", (grams[0] if len(grams) == 1 else F.explode(F.array(*grams))).alias("__gram"))
    return one.join(probe.select("__gram", "__item"), "__gram").select("__id", "__key", "__item").distinct()


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW,
                    min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(__id, __key, __item, __windows, __matched, __changed): one row per document and item it contains.

    The item windows are written once and counted; they are broadcast only up to the counted bound.
    ``__changed`` tells that names, numbers or units differ from the item's.
    """
    named = items.select(F.col(item_col).alias("__item"), F.col(item_text_col).cast("string").alias("__text")) \
        .where(F.col("__item").isNotNull())
    bench = template_windows(named, ["__item"], "__text", width)
    totals = cut_lineage(bench.groupBy("__item").agg(F.count_distinct("__at").alias("__windows")))
    needles = small_side(bench.join(totals, "__item").select(
        F.col("__hash"), "__item", "__windows", F.col("__at").alias("__item_at"), F.col("__t").alias("__item_t"),
        F.col("__v").alias("__item_v")))
    probe = cut_lineage(probes(named, totals, width, min_coverage))
    lengths = [r[0] for r in probe.select("__len").distinct().collect()]  # at most ``width`` and null
    rows = docs.select(F.col(id_col).alias("__id"), text_key(text_col).alias("__key"), F.col(text_col).cast("string").alias("__text"))
    hits = []
    if found := sorted(n for n in lengths if n is not None):
        pairs = small_side(candidates(rows, small_side(probe.where("__len is not null"), PROBE_ROWS), found), PROBE_ROWS)
        mine = pairs.withColumnsRenamed({"__id": "__pair_id", "__key": "__pair_key", "__item": "__pair_item"})
        both = lambda df: same(df, mine, [("__id", "__pair_id"), ("__key", "__pair_key")])
        likely = template_windows(rows.join(mine, both(rows), "left_semi"), ["__id", "__key"], "__text", width)
        paired = likely.join(mine, both(likely)).drop("__pair_id", "__pair_key")
        hits.append(paired.join(needles, (paired["__pair_item"] == needles["__item"]) & (paired["__hash"] == needles["__hash"]))
                    .drop("__pair_item", "__hash"))
    if None in lengths:
        bare = probe.where("__len is null").select("__item")
        hits.append(template_windows(rows, ["__id", "__key"], "__text", width)
                    .join(needles.join(bare, "__item", "left_semi"), "__hash").drop("__hash"))
    if not hits:  # no item has a window
        hits.append(template_windows(rows.limit(0), ["__id", "__key"], "__text", width).join(needles, "__hash").drop("__hash"))
    return _consistent(reduce(lambda a, b: a.unionByName(b), hits), min_coverage)


def _consistent(hits: DataFrame, min_coverage: float) -> DataFrame:
    """Items that matched windows of one shift and consistent values cover."""
    # values in placeholders: (item's value, document's value)
    slots = F.filter(
        F.zip_with(F.arrays_zip("__item_t", "__item_v"), F.col("__v"), lambda i, v: F.when(
            i["__item_t"].between(1, 3), F.struct(i["__item_t"].alias("kind"), i["__item_v"].alias("item"), v.alias("doc")))),
        lambda s: s.isNotNull())
    matched = hits.select(
        "__id", "__key", "__item", "__windows", "__item_at", (F.col("__at") - F.col("__item_at")).alias("__shift"),
        slots.alias("__slots"))
    aligned = matched.groupBy("__id", "__key", "__item", "__windows", "__shift").agg(
        F.collect_set("__item_at").alias("__ats"),
        F.array_distinct(F.flatten(F.collect_set("__slots"))).alias("__slots"))
    different = lambda side, among: F.size(F.array_distinct(F.transform(among, lambda s: s[side])))
    named = F.filter("__slots", lambda s: s["kind"] != PLACEHOLDER[NUMBER])
    consistent = (F.size("__slots") == different("item", "__slots")) & (F.size(named) == different("doc", named))
    changed = F.exists("__slots", lambda s: s["item"] != s["doc"])
    covered = aligned.where(consistent).select(
        "__id", "__key", "__item", "__windows", changed.alias("__changed"), F.explode("__ats").alias("__item_at"))
    return covered.groupBy("__id", "__key", "__item", "__windows").agg(
        F.count_distinct("__item_at").alias("__matched"), F.max("__changed").alias("__changed")) \
        .where(F.col("__matched") >= F.lit(min_coverage) * F.col("__windows"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that contain an item."""
    key, found_id, found_key = (fresh(n, docs) for n in ("__key", "__found_id", "__found_key"))
    found = contained_items(docs, items, id_col, text_col).select(
        F.col("__id").alias(found_id), F.col("__key").alias(found_key)).distinct()
    keyed = docs.withColumn(key, text_key(text_col))
    return keyed.join(
        found, keyed[id_col].eqNullSafe(found[found_id]) & (keyed[key] == found[found_key]), "left_anti") \
        .select(*[F.col(f"`{c}`") for c in docs.columns])
