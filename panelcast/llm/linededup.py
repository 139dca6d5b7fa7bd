"""Line dedup by overlapping three-line windows [DataFrame functions only].

Every window of three consecutive non-blank lines is hashed.  A window found
more than once in the whole corpus keeps its first occurrence, by document id
and then position; the lines covered by any later occurrence are removed,
overlapping windows being merged into one set of positions.

Results for odd input:
* null and empty texts, and texts with fewer than three non-blank lines, have
  no window and stay as they are;
* blank lines belong to no window and are never removed;
* lines are compared after trimming spaces, tabs and carriage returns;
* a window that repeats inside one document counts like any other repeat;
* rows with the same id and the same text are one document: none of them is a
  later occurrence of the other;
* rows without id come last among equal windows;
* very long texts are taken whole; an empty table stays empty;
* further columns pass through unchanged, whatever their names; only columns that
  are called ``__n_lines`` or ``__n_removed`` give way to the two that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import fresh, text_key

WINDOW = 3


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def window_rows(docs: DataFrame, id_col: str, text_col: str, width: int = WINDOW) -> DataFrame:
    """One slim row per window: document key, index of its first non-blank line, two hashes.

    Two independent 64-bit hashes make a 128-bit key, so that 10^12 windows have no chance repeats.
    """
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n", -1), _trimmed), lambda x: x != "")
    hashed = docs.select(
        F.col(id_col).alias("__id"),
        text_key(text_col).alias("__key"),
        F.transform(lines, lambda x: F.struct(
            F.xxhash64(x).alias("a"), F.xxhash64(F.lit("2"), x).alias("b"))).alias("__h"))
    # no row for a text with fewer lines: explode drops NULL, and a filter would hash every text twice
    starts = F.when(F.size("__h") >= width, F.sequence(F.lit(0), F.size("__h") - width))
    parts = lambda side: [F.col("__h")[F.col("__at") + k][side] for k in range(width)]
    return hashed.select("__id", "__key", "__h", F.explode(starts).alias("__at")).select(
        "__id", "__key", "__at", F.xxhash64(*parts("a")).alias("__wa"), F.xxhash64(*parts("b")).alias("__wb"))


def covered_lines(docs: DataFrame, id_col: str, text_col: str, width: int = WINDOW) -> DataFrame:
    """(__id, __key, __cut): for each document with later occurrences, the covered non-blank line indices."""
    windows = window_rows(docs, id_col, text_col, width)
    place = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__key").alias("k"),
                     F.col("__at").alias("p"))
    repeated = windows.groupBy("__wa", "__wb").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n")) \
        .where(F.col("__n") > 1).drop("__n")
    later = windows.join(repeated, ["__wa", "__wb"]).where(place > F.col("__first"))
    return later.groupBy("__id", "__key").agg(F.collect_set("__at").alias("__starts")).select(
        F.col("__id").alias("__cut_id"), F.col("__key").alias("__cut_key"),
        F.array_distinct(F.flatten(F.transform(
            "__starts", lambda s: F.sequence(s, s + (width - 1))))).alias("__cut"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``docs`` with repeated lines removed, and ``__n_lines`` and ``__n_removed`` (non-blank lines) added.

    Slim window rows meet by hash; a text moves only once, for the join with its covered positions.
    """
    key, cut, lines, solid, kept = (fresh(n, docs) for n in ("__key", "__cut", "__lines", "__solid", "__kept"))
    cut_id, cut_key = fresh("__cut_id", docs), fresh("__cut_key", docs)
    cuts = covered_lines(docs, id_col, text_col, width) \
        .withColumnsRenamed({"__cut_id": cut_id, "__cut_key": cut_key, "__cut": cut})
    joined = docs.withColumn(key, text_key(text_col)).join(
        cuts, F.col(id_col).eqNullSafe(F.col(cut_id)) & (F.col(key) == F.col(cut_key)), "left")
    split = joined.withColumn(lines, F.split(F.col(text_col), "\n", -1))
    ready = split.withColumn(solid, F.filter(
        F.transform(lines, lambda x, i: F.when(_trimmed(x) != "", i)), lambda i: i.isNotNull()))
    # covered indices count non-blank lines; what is not covered keeps its order
    rest = F.array_except(
        F.sequence(F.lit(0), F.size(lines) - 1), F.transform(cut, lambda k: F.col(solid)[k]))
    ready = ready.withColumn(kept, F.when(F.col(cut).isNotNull(), rest))
    cleaned = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.col(lines)[i]), "\n"))
    counts = {"__n_lines": F.coalesce(F.size(solid), F.lit(0)),
              "__n_removed": F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut))}
    return ready.select(
        *[F.col(f"`{c}`") if c != text_col else cleaned.alias(text_col) for c in docs.columns if c not in counts],
        *[n.cast("long").alias(c) for c, n in counts.items()])
