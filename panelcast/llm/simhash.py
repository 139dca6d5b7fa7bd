"""SimHash near-dedup by covering locality-sensitive hashing.

A text's fingerprint takes, for each of 64 bits, the majority over the XXH64
values of its word shingles.  Two fingerprints are linked when they differ in
at most ``radius`` bits.

Covering tables: every bit gets one of the 2^(r+1) - 1 nonzero vectors of
r + 1 bits, in turn; table ``v`` keeps the bits whose vector has an odd inner
product with ``v``.  The vectors of at most r differing bits span at most r
dimensions, so some nonzero ``v`` is orthogonal to all of them, and in its
table both fingerprints agree: no pair within the radius is missed.

Only distinct fingerprints meet, so exact copies cost nothing.  Buckets are
counted first.  One of two fingerprints is a pair at once; one of up to
``BLOCK`` is searched in one vectorised task row; a larger one, of any size,
is linked through midpoints (see ``midpoint_links``).  None emits all pairs of
a bucket: links within a bucket are thinned to stars that connect the same
fingerprints.

Results for odd input: null and blank texts have fingerprint 0, linked like
any other; texts shorter than a shingle have one shingle, the whole sequence;
repeated shingles count each time; a bit that is set in exactly half the
values is 0; rows with equal ids are separate rows of the result; a component
without any id has a NULL component id; very long texts are hashed whole, in
chunks; an empty table gives an empty result; only the named columns are read,
and ``keep_first`` returns all others unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import fresh, text_key
from panelcast.llm.components import components
from panelcast.session import cut_lineage

SHINGLE, RADIUS, SEED, BITS = 3, 3, 42, 64
BLOCK = 4096  # fingerprints of a bucket that one vectorised search takes; larger buckets go by midpoints
HASH_CHUNK = 1 << 16  # hash values whose bits are counted at once


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    # bytes.lower() and bytes.split() touch A-Z and the six ASCII white-space characters only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(s, seed) for s in shingles), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(values), HASH_CHUNK):
        part = values[at:at + HASH_CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """(__id, __key, __fp): one slim row per document; the text leaves Spark's memory batch by batch."""
    slim = docs.select(F.col(id_col).alias("__id"), text_key(text_col).alias("__key"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), width, seed) for t in b.column("__text")]
            yield pa.record_batch([b.column("__id"), b.column("__key"), pa.array(fps, pa.int64())], ["__id", "__key", "__fp"])

    kind = slim.schema["__id"].dataType.simpleString()
    return slim.mapInArrow(run, f"__id {kind}, __key long, __fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask per nonzero vector of radius + 1 bits (signed 64-bit integers)."""
    last = (1 << (radius + 1)) - 1
    vectors = [1 + i % last for i in range(bits)]
    masks = [sum(1 << i for i, u in enumerate(vectors) if bin(u & v).count("1") % 2) for v in range(1, last + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distances(x: np.uint64, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(others, x))


def _star_links(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that connect the same fingerprints as all links of one bucket do.

    Grows one cluster at a time: whatever lies within the radius of a member
    joins it and is never looked at again, so a dense bucket takes few rounds.
    """
    rest = np.array(fps, dtype=np.uint64)
    a, b = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _distances(x, rest) <= radius
            found = rest[near]
            rest = rest[~near]
            a += [int(x)] * len(found)
            b += found.tolist()
            queue += list(found)
    return a, b


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def block_links(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b) from rows with an array ``__fps`` of at most BLOCK distinct fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in batch.column("__fps"):
                p, q = _star_links(np.array(row.as_py(), dtype=np.int64).view(np.uint64), radius)
                a += p
                b += q
            yield pa.record_batch([_signed(a), _signed(b)], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def midpoint_links(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """(a, b) for buckets of any size, from rows (__table, __fp), without pairs.

    Two fingerprints at distance d <= r have a point between them: at most
    ``near`` = r // 2 bits from one, at most r - near from the other.  In its
    bucket's free bits each fingerprint visits all points up to r - near bits
    away (a fixed number, whatever the bucket's size).  At a point, any visitor
    from at most ``near`` bits away is linked to all others there: each such
    link is within the radius, and every pair within it is connected.  A point
    has no more visitors than a fingerprint has points.
    """
    near = radius // 2
    far = radius - near
    steps: list[np.ndarray] = []
    close: list[int] = []
    for m in masks:
        free = [i for i in range(BITS) if not (m >> i) & 1]
        levels = [[0]]
        for _ in range(far):
            levels.append(sorted({x ^ (1 << i) for x in levels[-1] for i in free if not (x >> i) & 1}))
        close.append(sum(len(x) for x in levels[:near + 1]))
        steps.append(np.array([x for level in levels for x in level], dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = batch.column("__table").to_numpy(zero_copy_only=False)
            fps = batch.column("__fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for t, x in zip(tables, fps, strict=True):
                points = np.bitwise_xor(steps[t], x)
                yield pa.record_batch([
                    pa.array(np.full(len(points), t, dtype=np.int32)), _signed(points), _signed(np.full(len(points), x)),
                    pa.array(np.arange(len(points)) < close[t])], ["__table", "__point", "__fp", "__near"])

    visits = rows.select("__table", "__fp").mapInArrow(run, "__table int, __point long, __fp long, __near boolean")
    met = visits.groupBy("__table", "__point").agg(
        F.min(F.when(F.col("__near"), F.col("__fp"))).alias("a"), F.collect_set("__fp").alias("__all")) \
        .where(F.col("a").isNotNull() & (F.size("__all") > 1))
    return met.select("a", F.explode("__all").alias("b")).where(F.col("a") != F.col("b"))


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b) links among the distinct fingerprints of ``nodes`` (column __fp)."""
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("__fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
    rows = nodes.select("__fp", F.explode(tables).alias("__b")).select(
        "__fp", F.col("__b")["t"].alias("__table"), F.col("__b")["k"].alias("__bucket"))
    sizes = rows.groupBy("__table", "__bucket").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__fp").alias("a"), F.max("__fp").alias("b")).where(F.col("__n") > 1)
    sizes = cut_lineage(sizes)
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = sizes.where((F.col("__n") == 2) & within).select("a", "b")
    several = rows.join(sizes.where(F.col("__n") > 2).select("__table", "__bucket", "__n"), ["__table", "__bucket"])
    blocks = several.where(F.col("__n") <= block).groupBy("__table", "__bucket").agg(F.collect_list("__fp").alias("__fps"))
    crowded = several.where(F.col("__n") > block)
    return pairs.union(block_links(blocks.select("__fps"), radius)).union(midpoint_links(crowded, masks, radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                    radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(__id, __key, __fp, __component, __first): ``__first`` names the component's first row as (id, key).

    ``__component`` is the smallest id that is reachable over links, the row's own included.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, width))
    place = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__key").alias("key"))
    nodes = cut_lineage(rows.groupBy("__fp").agg(F.min(place).alias("__place")))
    found = components(links(nodes.select("__fp"), radius, block))
    rooted = cut_lineage(nodes.join(found, nodes["__fp"] == found["node"], "left")
                         .select("__fp", "__place", F.coalesce("root", "__fp").alias("__root")))
    # written before the join, whose partitions can then be split where one component is large
    firsts = cut_lineage(rooted.groupBy("__root").agg(F.min("__place").alias("__first")))
    named = rooted.select("__fp", "__root").join(firsts, "__root").select(F.col("__fp").alias("__node"), "__first")
    return rows.join(named, F.col("__fp") == F.col("__node")).select(
        "__id", "__key", "__fp", F.col("__first")["id"].alias("__component"), "__first")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
               radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id."""
    key, keep_id, keep_key = (fresh(n, docs) for n in ("__key", "__keep_id", "__keep_key"))
    chosen = near_duplicates(docs, id_col, text_col, width, radius).select(
        F.col("__first")["id"].alias(keep_id), F.col("__first")["key"].alias(keep_key)).distinct()
    keyed = docs.withColumn(key, text_key(text_col))
    kept = keyed.join(chosen, keyed[id_col].eqNullSafe(chosen[keep_id]) & (keyed[key] == chosen[keep_key]), "left_semi")
    # rows that repeat id and text are copies of each other
    return kept.dropDuplicates([id_col, key]).select(*[F.col(f"`{c}`") for c in docs.columns])
