"""Mixing sources to target weights by Poisson replication [DataFrame functions only].

A group (a source) with size ``s`` and target share ``w`` of a total ``T`` gets
the mean repetition rate ``w T / s``.  Each document draws its number of copies
by inverting the Poisson distribution at a uniform number made from a hash of
seed and id, is exploded by it, and all copies are shuffled globally by a
hash: every row lands in a random partition and at a random place in it.

Results for odd input:
* the group of NULL is a group of its own; a group without a target weight
  has weight 0 and leaves the mix;
* size is in code points; a group whose texts are all empty has no defined
  rate and gets 1;
* rows with equal ids draw equal counts, so repeated rows stay repeated;
  rows without id draw by their text;
* texts of any length are measured and moved whole;
* an empty table gives an empty table;
* further columns pass through, whatever their names; only columns that are
  called ``__copy`` or ``__order`` give way to the two that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import fresh, small_side, text_or_empty

SEED = 20
# A Poisson variable with a larger mean is drawn as a sum of pieces of at most this mean (exact, and exp() stays in range).
PIECE_MEAN = 16.0
# Terms of one piece's distribution: beyond them lies less than 1e-40.
TERMS = 120


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def target_rates(docs: DataFrame, group_col: str, text_col: str, weights: DataFrame | None = None,
                 temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(__group, __size, __rate, __pieces, __cdf): one row per group.

    ``weights`` has columns (group, weight).  Without it a group's weight is
    its share of the text to the power ``temperature``.
    """
    sizes = docs.groupBy(F.col(group_col).cast("string").alias("__group")).agg(
        F.sum(F.char_length(text_or_empty(text_col))).alias("__size"))
    if weights is None:
        sized = sizes.withColumn("__weight", F.pow(F.col("__size").cast("double"), F.lit(float(temperature))))
    else:
        given = weights.select(F.col("group").cast("string").alias("__wg"), F.col("weight").cast("double").alias("__weight"))
        sized = sizes.join(given, F.col("__group").eqNullSafe(F.col("__wg")), "left").drop("__wg") \
            .withColumn("__weight", F.coalesce("__weight", F.lit(0.0)))
    sized = small_side(sized)
    total, weight = sized.agg(F.sum("__size"), F.sum("__weight")).first()  # one row: two totals
    rate = F.when(F.col("__size") == 0, F.lit(1.0)).otherwise(
        F.col("__weight") * F.lit(float(epochs) * float(total or 0) / float(weight or 1)) / F.col("__size"))
    rated = sized.withColumn("__rate", rate) \
        .withColumn("__pieces", F.greatest(F.lit(1), F.ceil(F.col("__rate") / PIECE_MEAN)).cast("int")) \
        .withColumn("__mean", F.col("__rate") / F.col("__pieces"))
    first = F.exp(-F.col("__mean"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")),
        lambda a, k: F.struct(
            (a["p"] * F.col("__mean") / k).alias("p"),
            (a["c"] + a["p"] * F.col("__mean") / k).alias("c"),
            F.concat(a["all"], F.array(a["c"] + a["p"] * F.col("__mean") / k)).alias("all")),
        lambda a: a["all"])
    return rated.withColumn("__cdf", cdf).select("__group", "__size", "__rate", "__pieces", "__cdf")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source",
        weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0,
        seed: int = SEED) -> DataFrame:
    """``docs`` replicated to the target mix and shuffled; adds ``__copy`` (1, 2, ...) and ``__order``."""
    rate, n = fresh("__rate", docs), fresh("__n", docs)
    rates = small_side(target_rates(docs, group_col, text_col, weights, temperature, epochs)
                       .select(F.struct("__group", "__pieces", "__cdf").alias(rate)))
    # rows without id are told apart by their text
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(text_or_empty(text_col))))
    joined = docs.drop("__copy", "__order").join(rates, F.col(group_col).cast("string").eqNullSafe(F.col(f"{rate}.__group")))
    draws = F.transform(F.sequence(F.lit(1), F.col(f"{rate}.__pieces")),
                        lambda j: uniform(F.lit(str(seed)), ident, j.cast("string")))
    # the inverse: how many steps of the distribution lie below the uniform number
    copies = F.aggregate(
        draws, F.lit(0), lambda k, u: k + F.size(F.filter(f"{rate}.__cdf", lambda c: c < u)))
    counted = joined.withColumn(n, copies).drop(rate)
    spread = counted.withColumn("__copy", F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(1), F.col(n))))).drop(n)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), ident, F.col("__copy").cast("string"), F.lit("order")))
    return spread.withColumn("__order", order).repartition("__order").sortWithinPartitions("__order")
