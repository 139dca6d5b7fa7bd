"""Secret scans: a random forest removes false positives [DataFrame functions and Spark ML only].

Candidates are runs of 16 or more key characters that hold a letter and a
digit, and any 8 or more characters without white space or quotes that a name
which announces a secret is given (``password = p@ss!word``).  Each is described
by its length, the changes between character classes, how likely its letters
follow one another in words of the corpus, how much of them are such words,
signs of a path, and the words next to it.  A random forest, trained from
labelled findings, gives each candidate a probability.

The dictionary is taken from the whole corpus: letter runs of candidates that
also stand in texts as words of their own, at least ``MIN_WORD_COUNT`` times.
The forest is fitted on at most ``MAX_TRAINING`` findings of each label, those
with the smallest hash (a documented, bounded sample).

Results for odd input: null and empty texts have no candidates; whole texts
are searched; equal candidates in one text are separate rows; without findings
of both labels there is nothing to learn, and every candidate gets the only
label seen (probability 0 without any); findings with equal hashes are chosen in
the order of their features; an empty table has no candidates; very long texts
are searched whole; only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import json
from math import log2

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import BROADCAST_ROWS, text_or_empty
from panelcast.session import cut_lineage

RUN = r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}={0,2}"
MIN_WORD_COUNT = 5
MAX_TRAINING = 5_000
TREES, DEPTH, SEED = 40, 8, 42
BEFORE, AFTER = 40, 20  # code points of context kept on either side
LETTERS = 26
# Words that announce a secret (fixed values).
KEY_WORDS = "token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer"
# What stands between such a word and its value, and the value.
GIVEN = rf"(?i:{KEY_WORDS})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"'`]?"
KEYED = rf"(?<={GIVEN})[^\s\"'`,;<>]{{8,}}"
# Words beside digests and numbers, and beside files and addresses (fixed values).
DIGEST_WORDS = "commit|sha|sha1|sha256|md5|checksum|digest|revision|uuid|guid|etag|hash|build|version|id|number|isbn|order"
FILE_WORDS = "import|include|from|file|path|folder|dir|directory|module|package|class|see|url|href|link|http|https|www"
# Formats of well-known keys, and signs of an example in place of a key (fixed values).
FORMATS = (r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[0-9A-Za-z]{24,}|AIza[0-9A-Za-z_-]{35}"
           r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})$")
EXAMPLES = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|x{6,}|0{8,}|12345678"
FEATURES = ["length", "classes", "transitions", "digit_share", "upper_share", "distinct_share", "hex", "dictionary_share", "symbols",
            "slashes", "dots", "digest_word", "file_word", "prose_before", "file_end", "key_word", "assigned", "quoted", "at_sign"]
# What rule_labels decides by: a forest on its labels must not see it.
RULED = ["key_word", "assigned", "quoted", "at_sign", "file_end"]
# A value that starts like a path, or holds a slash and a point.
PATH = r"^(?:\.{0,2}/.*/|\.{1,2}/)|/.*\.|\..*/"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __start, __end, __value, __before, __after): one row per candidate; code points, end exclusive."""
    text = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    digits, given = F.col("__text").rlike("[0-9]"), F.col("__text").rlike(GIVEN)
    cases = [(given, f"{KEYED}|{RUN}"), (digits, RUN)]  # the longer pattern only where a name announces something

    def either(work) -> Column:
        return F.when(cases[0][0], work(cases[0][1])).when(cases[1][0], work(cases[1][1]))

    raw = text.select("__id", either(lambda p: F.regexp_extract_all(F.col("__text"), F.lit(p), F.lit(0))).alias("__found"),
                      either(lambda p: F.split(F.col("__text"), p, -1)).alias("__gaps"))
    spans = "array<struct<s:int,e:int,v:string,b:string,a:string>>"
    parts = F.transform("__found", lambda v, i: F.struct(
        F.char_length(F.col("__gaps")[i]).alias("g"), F.char_length(v).alias("n"), v.alias("v"),
        F.right(F.col("__gaps")[i], F.lit(BEFORE)).alias("b"), F.left(F.col("__gaps")[i + 1], F.lit(AFTER)).alias("a")))
    walked = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["n"]).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["n"]).alias("e"), x["v"].alias("v"),
                x["b"].alias("b"), x["a"].alias("a")))).alias("out")),
        lambda a: F.filter(a["out"], lambda x: (x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]") & x["v"].rlike("^[A-Za-z0-9+/_.-]{16}"))
                           | x["b"].rlike(GIVEN + "$")))
    rows = raw.select("__id", F.explode(F.when(F.size("__found") > 0, walked)).alias("__x"))
    return rows.select("__id", *[F.col("__x")[k].alias(n) for k, n in (
        ("s", "__start"), ("e", "__end"), ("v", "__value"), ("b", "__before"), ("a", "__after"))])


def _share(value: Column, kind: str) -> Column:
    other = f"[{kind[1:]}]" if kind.startswith("^") else f"[^{kind}]"
    return F.char_length(F.regexp_replace(value, other, "")) / F.char_length(value)


def _runs(found: DataFrame) -> DataFrame:
    """(__value, __run): letter runs of the distinct candidates."""
    return cut_lineage(found.select("__value").distinct().select(
        "__value", F.explode(F.regexp_extract_all(F.lower("__value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("__run")))


def known_words(runs: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(__word, __n): letter runs of candidates that stand in the corpus as words of their own, often enough; written."""
    wanted = cut_lineage(runs.select(F.col("__run").alias("__word")).distinct())
    words = docs.select(F.explode(F.split(F.lower(text_or_empty(text_col)), r"[\x20\x09-\x0D]+")).alias("__raw")) \
        .select(F.btrim("__raw", F.lit(".,;:!?\"'()")).alias("__word"))
    counted = lambda w: w.groupBy("__word").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= MIN_WORD_COUNT)
    # the same counts either way; a list too long to broadcast meets words that are counted already, not every occurrence
    if wanted.count() <= BROADCAST_ROWS:
        known = counted(words.join(F.broadcast(wanted), "__word", "left_semi"))
    else:
        known = counted(words).join(wanted, "__word", "left_semi")
    return cut_lineage(known)


def _shares(runs: DataFrame, known: DataFrame) -> DataFrame:
    covered = runs.join(known, runs["__run"] == known["__word"])
    return covered.groupBy("__value").agg(F.sum(F.char_length("__run")).alias("__letters")).select(
        "__value", (F.col("__letters") / F.char_length("__value")).alias("dictionary_share"))


def dictionary_share(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(__value, dictionary_share): letters of each distinct candidate that belong to words of the corpus."""
    runs = _runs(found)
    return _shares(runs, known_words(runs, docs, text_col))


def transition_score(value: Column, known: DataFrame) -> Column:
    """Mean log2 of the probability of a value's letters, each after the one before, in the known words."""
    pairs = known.select(F.explode(F.when(F.char_length("__word") > 1, F.sequence(F.lit(1), F.char_length("__word") - 1))).alias("i"), "__word", "__n") \
        .groupBy(F.substring("__word", F.col("i"), F.lit(2)).alias("ab")).agg(F.sum("__n").alias("n"))
    found = {r["ab"]: r["n"] for r in pairs.collect()}  # at most 26 x 26
    after: dict[str, int] = {}
    for ab, n in found.items():
        after[ab[0]] = after.get(ab[0], 0) + n
    table = json.dumps({ab: log2((n + 1) / (after[ab[0]] + LETTERS)) for ab, n in found.items()})
    unseen = json.dumps({a: log2(1 / (n + LETTERS)) for a, n in after.items()})
    seen, rare = (F.from_json(F.lit(t), "map<string,double>") for t in (table, unseen))
    flat = -log2(LETTERS)
    letters = F.regexp_replace(F.lower(value), "[^a-z]", "")
    steps = F.transform(F.sequence(F.lit(1), F.char_length(letters) - 1), lambda i: F.coalesce(
        F.try_element_at(seen, F.substring(letters, i, F.lit(2))), F.try_element_at(rare, F.substring(letters, i, F.lit(1))), F.lit(flat)))
    return F.when(F.char_length(letters) > 1, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.size(steps)).otherwise(F.lit(flat))


def described(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``found`` with the columns of FEATURES."""
    v, before, after = F.col("__value"), F.col("__before"), F.col("__after")
    runs = _runs(found)
    known = known_words(runs, docs, text_col)
    share = _shares(runs, known).withColumnRenamed("__value", "__known")
    beside = lambda words: F.lower(before).rlike(rf"\b(?:{words})\b[\s:=#/\"'`(-]*$")
    number = lambda c: c.cast("double")
    return found.join(share, v == F.col("__known"), "left").drop("__known").withColumns({
        "length": number(F.char_length(v)),
        "classes": F.size(F.regexp_extract_all(v, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))) / F.char_length(v),
        "transitions": transition_score(v, known),
        "symbols": _share(v, r"^A-Za-z0-9"),
        "digest_word": number(beside(DIGEST_WORDS)),
        "file_word": number(beside(FILE_WORDS)),
        "prose_before": number(before.rlike(r"\p{L}{2,} $")),
        "digit_share": _share(v, "0-9"),
        "upper_share": _share(v, "A-Z"),
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / F.char_length(v),
        "hex": number(v.rlike("^[0-9a-fA-F]+$")),
        "dictionary_share": F.coalesce("dictionary_share", F.lit(0.0)),
        "slashes": number(F.char_length(F.regexp_replace(v, "[^/]", ""))),
        "dots": number(F.char_length(F.regexp_replace(v, "[^.]", ""))),
        "file_end": number(v.rlike(r"\.[a-z]{2,5}$")),
        "key_word": number(F.lower(before).rlike(rf"\b(?:{KEY_WORDS})\b")),
        "assigned": number(before.rlike(r"[:=]\s*[\"'`]?$")),
        "quoted": number(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "at_sign": number(before.rlike("@$")),
    })


def rule_labels(rows: DataFrame) -> DataFrame:
    """Labels where no human findings are at hand (column ``label``).

    1: a value of 20 or more characters, given to a name that announces a
    secret, or of the format of a well-known key.  0: an example in place of a
    key, part of an address, a path or file name, or a hexadecimal number that
    the word before calls a digest.  NULL: neither is sure, also a value that
    nothing announces; such rows train nothing and are left to the forest.  The
    labels rest on RULED and on formats; the forest sees neither.
    """
    example = F.col("__value").rlike(EXAMPLES)
    secret = ((F.col("key_word") == 1) & (F.col("assigned") == 1) & (F.col("length") >= 20)) | F.col("__value").rlike(FORMATS)
    harmless = example | (F.col("at_sign") == 1) | (F.col("file_end") == 1) | F.col("__value").rlike(PATH) \
        | ((F.col("digest_word") == 1) & (F.col("hex") == 1))
    return rows.withColumn("label", F.when(secret & ~example, 1.0).when(harmless, 0.0))


def training_sample(rows: DataFrame, limit: int = MAX_TRAINING) -> DataFrame:
    """At most ``limit`` labelled rows of either label, by smallest hash; written once, in one partition."""
    order = F.xxhash64("__id", "__start", "__value")
    picked = [rows.where(F.col("label") == k).select("label", *FEATURES, order.alias("__o")).orderBy("__o", *FEATURES).limit(limit)
              for k in (0.0, 1.0)]
    return cut_lineage(picked[0].union(picked[1]).coalesce(1))


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate with FEATURES, ``probability`` and ``is_secret``.

    ``findings`` (id, start, label) are labelled candidates; without them ``rule_labels`` stands in, and
    the forest does not see what they were taken by (RULED).
    """
    rows = described(cut_lineage(candidates(docs, id_col, text_col)), docs, text_col)
    features = FEATURES if findings is not None else [f for f in FEATURES if f not in RULED]
    if findings is None:
        rows = rule_labels(rows)
    else:
        given = findings.select(F.col("id").alias("__fid"), F.col("start").alias("__fstart"), F.col("label").cast("double").alias("label"))
        rows = rows.join(given, rows["__id"].eqNullSafe(given["__fid"]) & (rows["__start"] == given["__fstart"]), "left").drop("__fid", "__fstart")
    rows = cut_lineage(rows)
    sample = training_sample(rows)
    seen = [r["label"] for r in sample.select("label").distinct().collect()]  # two rows at most
    if len(seen) < 2:
        scored = rows.withColumn("probability", F.lit(seen[0] if seen else 0.0))
    else:
        assembler = VectorAssembler(inputCols=features, outputCol="__features")
        forest = RandomForestClassifier(
            featuresCol="__features", labelCol="label", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y",
            numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        model = forest.fit(assembler.transform(sample))
        scored = model.transform(assembler.transform(rows)).withColumn("probability", vector_to_array("__p")[1]) \
            .drop("__features", "__p", "__r", "__y")
    return scored.withColumn("is_secret", F.col("probability") >= 0.5)
