"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

# Rows of a side table up to which it is broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 100_000
# The white space that separates words: space and \t \n \v \f \r (fixed values).
WORD_GAP = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str) -> Column:
    """64-bit key of a text; with the row's id it names a row without moving its text."""
    return F.xxhash64(F.col(column))


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of the frames is called so (names differ by more than case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Write ``df`` once, count it, and mark it for broadcast only up to ``limit`` rows."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= limit else df


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of column pairs, usable as an equi-join condition."""
    cond = None
    for a, b in pairs:
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return cond
