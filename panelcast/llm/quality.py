"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose measure exceeds a cutoff.  Cutoffs are
chosen per stratum from labelled documents (a holdout: neither measures nor
candidate cutoffs are fitted to them).  All rules go together along one path of
joint cutoffs, from lenient to strict.  A joint cutoff is valid when an exact
binomial test rejects "more than ``alpha`` of the good documents are lost": the
chance of so few false rejections at that rate is at most ``delta`` divided by
the number of strata.  The steps are tried in order and the first failure ends
the search (fixed-sequence testing), so all chosen cutoffs hold together with
confidence ``1 - delta``.  Among the valid steps the one with the largest
difference between lost bad and lost good documents wins, ties going to the
most lenient.

The path is fixed before any good document is looked at: a rule is in it up to
the most lenient cutoff that loses all bad labelled documents it can lose, and
a rule that loses none is left out.  So no rule that is not needed can end the
path; the test counts good documents only, and they are independent of the bad.

Results for odd input:
* null and empty texts have no words and fail the base rules;
* a stratum without enough labels (with 4 strata, 108 good ones that pass the
  base rules) has no valid cutoff and only base rules;
* NULL in the stratum column is a stratum of its own;
* labels with NULL quality are left out; of several labels of one document
  each counts; labels of unknown documents do not count;
* repeated rows get equal verdicts; an empty table gives an empty table;
* very long texts are measured whole;
* further columns pass through ``keep_good`` unchanged, whatever their names, and
  through ``judge`` but for the names that it adds.
"""

from __future__ import annotations

from collections import Counter
from math import lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import small_side
from panelcast.session import cut_lineage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
ALPHA = 0.04  # share of good documents that all rules together may lose in a stratum
DELTA = 0.05  # chance that any promise fails

MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in
                         ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_caps_words", "n_marks")])
# Candidate cutoffs of each rule, from lenient to strict (fixed in advance, not fitted).
GRIDS = {
    "symbols_per_word": [3.0, 2.5, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeat_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3],
    "caps_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "marks_per_word": [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2],
    "long_words": [30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0],
}


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text; words are runs of anything but the six ASCII white-space characters."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    gaps = sum(map(text.count, " \t\n\v\f\r"))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, until = Counter(windows), 0
        for k, w in enumerate(windows):
            if counts[w] > 1:
                repeated += k + 3 - max(k, until)
                until = k + 3
    lines, seen = 0, set()
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            lines += line in seen
            seen.add(line)
    caps = sum(w.isupper() and len(w) > 1 for w in words)
    return (len(words), len(text) - gaps, sum(map(text.count, SYMBOLS)), lines, repeated, caps,
            sum(map(text.count, "!?")))


@F.pandas_udf(MEASURES)
def measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=MEASURES.names, dtype="int64")


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def rule_values(m: Column) -> dict[str, Column]:
    words = F.greatest(m["n_words"], F.lit(1))
    return {"symbols_per_word": m["n_symbols"] / words, "repeat_share": m["n_repeat_words"] / words,
            "caps_share": m["n_caps_words"] / words, "marks_per_word": m["n_marks"] / words,
            "long_words": m["word_chars"] / words}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exact up to rounding."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.array([lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) for j in i]) + i * log(p) + (n - i) * np.log1p(-p)
    return float(np.exp(logs).sum())


def choose_cutoff(grid: list[float], lost_good: list[int], good: int, lost_bad: list[int], bad: int,
                  alpha: float, level: float) -> float | None:
    """The best valid entry of ``grid``, which goes from lenient to strict, or None."""
    best, gain = None, 0.0
    for cutoff, fg, fb in zip(grid, lost_good, lost_bad, strict=True):
        if not good or binomial_tail(fg, good, alpha) > level:
            break
        this = fb / max(bad, 1) - fg / good
        if this > gain:
            best, gain = cutoff, this
    return best


def joint_cutoffs(counts: pd.DataFrame, alpha: float, level: float) -> dict[str, float]:
    """Cutoffs of the rules of one stratum.

    ``counts``: __good, one column per rule with the first place in its grid that
    a document exceeds (the grid's length: none), __n documents.
    """
    is_good, n = (counts["__good"] == 1).to_numpy(), counts["__n"].to_numpy()
    last, step = {}, np.full(len(counts), max(map(len, GRIDS.values())))
    for name, grid in GRIDS.items():
        first = counts[name].to_numpy()
        lost = first[~is_good & (first < len(grid))]
        if len(lost):
            last[name] = int(lost.max())
            # the first step of the path that loses the document
            step = np.where(first <= last[name], np.minimum(step, first), step)
    path = list(range(max(last.values(), default=-1) + 1))
    best = choose_cutoff(path, [int(n[is_good & (step <= k)].sum()) for k in path], int(n[is_good].sum()),
                         [int(n[~is_good & (step <= k)].sum()) for k in path], int(n[~is_good].sum()), alpha, level)
    return {} if best is None else {name: GRIDS[name][min(best, k)] for name, k in last.items()}


def learn_cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang",
                  label_id: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA,
                  delta: float = DELTA) -> DataFrame:
    """(__stratum, __rule, __cutoff) from documents with column ``__m`` (measures) and their labels.

    Documents that the base rules reject are lost already and take no part.
    """
    # cutoffs fall along a grid: the first one exceeded has as many before it as are not exceeded
    slim = measured.where(~base_failed(F.col("__m"))).select(
        F.col(id_col).alias("__id"), F.col(stratum_col).cast("string").alias("__stratum"),
        *[sum((F.when(v > c, 0).otherwise(1) for c in GRIDS[n]), F.lit(0)).alias(n) for n, v in rule_values(F.col("__m")).items()])
    given = labels.select(F.col(label_id).alias("__label_id"), F.col(label_col).cast("int").alias("__good")) \
        .where(F.col("__good").isNotNull())
    held = slim.join(given, F.col("__id") == F.col("__label_id"))
    # a stratum has a bounded number of rows here (grid places of five rules), however many labels there are
    counts = cut_lineage(held.groupBy("__stratum", (F.col("__good") == 1).cast("int").alias("__good"), *GRIDS)
                         .agg(F.count(F.lit(1)).alias("__n")))
    level = delta / max(1, counts.select("__stratum").distinct().count())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = [(frame["__stratum"].iloc[0], name, cutoff) for name, cutoff in joint_cutoffs(frame, alpha, level).items()]
        return pd.DataFrame(found, columns=["__stratum", "__rule", "__cutoff"])

    return counts.groupBy("__stratum").applyInPandas(run, "__stratum string, __rule string, __cutoff double")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """Adds ``__base_failed`` and ``__kept`` to documents with column ``__m``.

    There is one row of cutoffs per stratum, broadcast up to a counted bound.
    """
    wide = small_side(cutoffs.groupBy(F.col("__stratum").alias("__cut_stratum")).agg(
        *[F.max(F.when(F.col("__rule") == name, F.col("__cutoff"))).alias(f"__cut_{name}") for name in GRIDS]))
    joined = measured.join(wide, F.col(stratum_col).cast("string").eqNullSafe(F.col("__cut_stratum")), "left")
    over = F.lit(False)
    for name, value in rule_values(F.col("__m")).items():
        over = over | F.coalesce(value > F.col(f"__cut_{name}"), F.lit(False))
    failed = base_failed(F.col("__m"))
    return joined.select(*[F.col(f"`{c}`") for c in measured.columns], failed.alias("__base_failed"),
                         (~failed & ~over).alias("__kept"))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("__m", measures(F.col(text_col).cast("string")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stratum_col: str = "lang") -> DataFrame:
    """``docs`` without those that the base rules or the learnt cutoffs reject.

    Measures are taken twice, once to learn and once to judge, so that no text moves between machines.
    """
    slim = measured(docs.select(id_col, text_col, stratum_col), text_col).select(id_col, stratum_col, "__m")
    cutoffs = learn_cutoffs(slim, labels, id_col, stratum_col)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")  # columns of any name go through unchanged
    held = docs.select(F.col(text_col).alias("__text"), F.col(stratum_col).alias("__stratum"), whole)
    return judge(measured(held, "__text"), cutoffs, "__stratum").where("__kept").select("__row.*")
