"""Conversation structure repair by Knuth's lightest-derivation agenda.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``.
Repairing is deduction in a weighted hypergraph.  The items are

* ``(i, j, p, q)``: rows i to j - 1, edited, lead the role automaton from state
  p to state q.  Inside a block of rows an item grows on the right, by an
  insertion or by an edit of the next row; blocks are joined in pairs, two
  items with a common state deducing the item of both blocks;
* the goal: all rows, from the start to an accepting state.

A value is (cost, audit), the audit being the initials of the edits (Delete,
Insert, Keep, Rerole).  An agenda pops items by (cost, rows covered, audit).
Every deduction adds to the cost or to the rows covered, so it is superior to
each of its antecedents.  It is monotone, too: the audits of one item have one
letter other than I for each of its rows, and the letters fix the cost, hence
of two audits of equal cost neither begins with the other and a common
continuation keeps their order.  So the first value popped for an item is its
least one, and the run ends when the goal is popped.

How it scales: faults and order need slim rows (a hash instead of the text).
Equal rows are counted before they move.  The slim rows are sorted globally by
conversation and turn, so a conversation of any length lies in neighbouring
partitions; every partition deduces the items of its part, block by block, and
only the parts of conversations at partition ends meet again, as one row of at
most 16 items each.  Texts move once, sorted by conversation, and are hashed as
they stream by: a digest needs its conversation's text in order, but no
conversation's text is held whole.

Results for odd input:
* null ids, turns, roles and texts: a null turn comes first; null roles and
  texts, and null ids and turns in the damage key, stand for one space; null
  ids form one conversation;
* rows of one turn are ordered by role and text hash; repeated rows of one
  turn stay together, the second and later ones being duplicates;
* empty texts are blank; texts of any length are judged whole;
* a role is judged by its first character, case and all; an empty role has no
  initial, so it is deleted or given a new role;
* a conversation without rows has an empty repair; an empty table gives an
  empty result;
* further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

BLOCK = 64  # rows deduced one by one before blocks are joined
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs (fixed values)
BLANK = r"\A[\x20\x09-\x0D]*\z"
CUT_OFF = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ACCEPT = (START, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")

Value = tuple[int, str]
Item = tuple[int, int, int, int]
Row = tuple[str, int]  # role initial; 0 sound, 1 truncated, 2 to be deleted
Cells = tuple[tuple[int, int, int, str], ...]  # (state before, state after, cost, audit)


def lightest(axioms: Iterable[tuple[Value, Item]],
             deduce: Callable[[Item, Value, dict[Item, Value]], Iterable[tuple[Value, Item]]],
             done: Callable[[dict[Item, Value]], bool]) -> dict[Item, Value]:
    """Knuth's algorithm: the least value of each item, popped in order, until ``done`` says so of the chart."""
    order = lambda value, item: (value[0], item[1] - item[0], value[1], item)
    agenda = [order(v, i) for v, i in axioms]
    heapq.heapify(agenda)
    chart: dict[Item, Value] = {}
    while agenda:
        cost, _, audit, item = heapq.heappop(agenda)
        if item in chart:
            continue
        chart[item] = (cost, audit)
        if done(chart):
            break
        for v, i in deduce(item, chart[item], chart):
            if i not in chart:
                heapq.heappush(agenda, order(v, i))
    return chart


def _edits(rows: tuple[Row, ...]) -> Callable[[Item, Value, dict[Item, Value]], Iterator[tuple[Value, Item]]]:
    """The deductions inside a block: an insertion, or an edit of the next row."""
    def deduce(item: Item, value: Value, chart: dict[Item, Value]) -> Iterator[tuple[Value, Item]]:
        _, i, p, q = item
        cost, audit = value
        for r in "ua":
            if (q, r) in STEP:
                yield (cost + INSERT, audit + "I"), (0, i, p, STEP[q, r])
        if i == len(rows):
            return
        role, fault = rows[i]
        yield (cost + DELETE, audit + "D"), (0, i + 1, p, q)
        if fault < 2:
            extra = TRUNCATED * fault
            if (q, role) in STEP:
                yield (cost + KEEP + extra, audit + "K"), (0, i + 1, p, STEP[q, role])
            for r in "ua":
                if (q, r) in STEP:
                    yield (cost + REROLE + extra, audit + "R"), (0, i + 1, p, STEP[q, r])

    return deduce


@lru_cache(maxsize=200_000)
def lightest_repair(rows: tuple[Row, ...]) -> Value:
    """The value of the goal; the run ends when the first accepting item of all rows is popped."""
    ends = [(0, len(rows), START, q) for q in ACCEPT]
    chart = lightest([((0, ""), (0, 0, START, START))], _edits(rows), lambda c: any(e in c for e in ends))
    return next(chart[e] for e in ends if e in chart)


@lru_cache(maxsize=20_000)
def block_cells(rows: tuple[Row, ...]) -> Cells:
    """The least way through a block of rows from every state to every state that can be reached."""
    n = len(rows)
    # by insertions USER and ASSISTANT are reached from everywhere; SYSTEM only by keeping a system row at the start
    wanted = {(0, n, p, q) for p, q in product(range(4), repeat=2) if p == q or q in (USER, ASSISTANT)}
    if any(role == "s" and fault < 2 for role, fault in rows):
        wanted.add((0, n, START, SYSTEM))
    chart = lightest([((0, ""), (0, 0, p, p)) for p in range(4)], _edits(rows), lambda c: wanted <= c.keys())
    return tuple((p, q, *chart[0, n, p, q]) for p, q in product(range(4), repeat=2) if (0, n, p, q) in wanted)


def join_cells(parts: list[Cells]) -> Cells:
    """Join neighbouring parts in pairs: two items with a common state deduce the item of both."""
    if not parts:
        return tuple((p, p, 0, "") for p in range(4))
    n = 1
    while n < len(parts):
        n *= 2

    def deduce(item: Item, value: Value, chart: dict[Item, Value]) -> Iterator[tuple[Value, Item]]:
        i, j, p, q = item
        width = j - i
        if width == n:
            return
        left = (i // width) % 2 == 0
        if left and j >= len(parts):  # no part on the right
            yield value, (i, i + 2 * width, p, q)
            return
        for m in range(4):
            if left:
                other = (j, j + width, q, m)
                if other in chart:
                    yield (value[0] + chart[other][0], value[1] + chart[other][1]), (i, j + width, p, m)
            else:
                other = (i - width, i, m, p)
                if other in chart:
                    yield (value[0] + chart[other][0], chart[other][1] + value[1]), (i - width, j, m, q)

    axioms = [((cost, audit), (k, k + 1, p, q)) for k, part in enumerate(parts) for p, q, cost, audit in part]
    chart = lightest(axioms, deduce, lambda c: False)
    return tuple((p, q, *chart[0, n, p, q]) for p, q in product(range(4), repeat=2) if (0, n, p, q) in chart)


def goal(cells: Cells) -> Value:
    """The goal item: all rows from START to an accepting state."""
    return min((cost, audit) for p, q, cost, audit in cells if p == START and q in ACCEPT)


def edited_rows(audit: str) -> Iterator[tuple[str, str | None]]:
    """(edit, new role) along an audit: the number of rows that stay says whether the first one is the system's."""
    stay = len(audit) - audit.count("D")
    roles = ["user", "assistant"]
    k = 1 if stay % 2 else 0  # with a system row first, users stand at odd places
    at = 0
    for edit in audit:
        if edit == "D":
            yield edit, None
            continue
        yield edit, roles[(at - k) % 2] if edit in "RI" else None
        at += 1


# -- the table side ---------------------------------------------------------------------------------------------


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(__conv, __turn, __role, __text, __n) after the damage; a dropped row stays as a mark with ``__n`` 0.

    crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its full stops, 3 repeats it,
    4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    d = rows.select(F.col(conv_col).alias("__conv"), F.col(turn_col).alias("__turn"), space(role_col).alias("__role"),
                    space(text_col).alias("__text"), what.alias("__what"))
    gone = F.col("__what") == 0
    return d.select(
        "__conv", F.when(~gone, F.col("__turn")).alias("__turn"),
        F.when(~gone, F.when(F.col("__what") == 4, F.lit("user")).otherwise(F.col("__role"))).alias("__role"),
        F.when(F.col("__what") == 1, F.lit("")).when(F.col("__what") == 2, F.regexp_replace("__text", "[.!?]", ""))
        .when(~gone, F.col("__text")).alias("__text"),
        F.when(gone, 0).when(F.col("__what") == 3, 2).otherwise(1).alias("__n"))


def undamaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """The same columns for rows that are repaired as they are."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("__conv"), F.col(turn_col).alias("__turn"), space(role_col).alias("__role"),
                       space(text_col).alias("__text"), F.lit(1).alias("__n"))


def _hash() -> list[Column]:
    """128 bits in place of a text."""
    return [F.xxhash64("__text").alias("__h"), F.xxhash64(F.lit("2"), F.col("__text")).alias("__g")]


def _slim(rows: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and text, with its number, fault and whether role and text came earlier."""
    fault = F.when(F.col("__text").rlike(BLANK), 2).when(F.col("__text").rlike(CUT_OFF), 1).otherwise(0)
    key = ["__conv", "__turn", "__role", "__h", "__g"]
    some = rows.select("__conv", "__turn", "__role", *_hash(), fault.alias("__fault"), "__n") \
        .groupBy(*key).agg(F.sum("__n").alias("__n"), F.max("__fault").alias("__fault"))
    place = F.struct(F.col("__turn").isNotNull(), F.col("__turn"))
    # only what occurs in several turns has an earlier place
    again = some.where("__n > 0").groupBy("__conv", "__role", "__h", "__g") \
        .agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__turns")).where("__turns > 1") \
        .select(*[F.col(c).alias(f"{c}_f") for c in ("__conv", "__role", "__h", "__g")], "__first")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_f")) if c == "__conv" else F.col(c) == F.col(f"{c}_f")
            for c in ("__conv", "__role", "__h", "__g")]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return some.join(again, cond, "left").select(
        *key, "__n", "__fault", (F.col("__first").isNotNull() & (place != F.col("__first"))).alias("__again"))


PART = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]
LONGS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_turn", "last_turn"]
PART_TYPE = ("struct<part:int,whole:boolean," + "".join(f"{n}:bigint," for n in LONGS)
             + "first:string,last:string,cells:array<struct<p:int,q:int,cost:bigint,audit:string>>>")
PART_ARROW = pa.struct([("part", pa.int32()), ("whole", pa.bool_()), *[(n, pa.int64()) for n in LONGS],
                        ("first", pa.string()), ("last", pa.string()),
                        ("cells", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])


class _Part:
    """What a stretch of a conversation's rows comes to."""

    def __init__(self) -> None:
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = self.first_turn = self.last_turn = None
        self.block: list[Row] = []
        self.blocks: list[Cells] = []

    def add(self, turn: int | None, role: str, n: int, fault: int, again: bool) -> None:
        for k in range(n):
            initial = role[:1]
            if self.rows:
                self.illegal += self.last + initial not in LEGAL_PAIRS
            else:
                self.first, self.first_turn = initial, turn
            if turn is not None and turn != self.last_turn:
                self.turns += 1
                self.low = turn if self.low is None else self.low
                self.high = turn
            self.last, self.last_turn = initial, turn
            self.rows += 1
            copy = again or k > 0
            if fault == 2:
                self.blank += 1
            elif copy:
                self.duplicate += 1
            elif fault:
                self.truncated += 1
            self.block.append((initial if initial in "sua" else "", 2 if fault == 2 or copy else fault))
            if len(self.block) == BLOCK:
                self._close()

    def _close(self) -> None:
        if self.block:
            self.blocks.append(block_cells(tuple(self.block)))
            self.block = []

    def cells(self) -> Cells:
        self._close()
        return self.blocks[0] if len(self.blocks) == 1 else join_cells(self.blocks)

    def row(self, part: int, whole: bool) -> dict:
        if whole:
            cost, audit = goal(self.cells()) if self.blocks else lightest_repair(tuple(self.block))
            cells = ((START, START, cost, audit),)
        else:
            cells = self.cells()
        return {"part": part, "whole": whole, **{n: getattr(self, n) for n in PART}, "low": self.low, "high": self.high,
                "first": self.first, "last": self.last, "first_turn": self.first_turn, "last_turn": self.last_turn,
                "cells": [dict(zip("p q cost audit".split(), c, strict=True)) for c in cells]}


def _deduce_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted slim rows to one row per conversation and partition; the first and the last may go on elsewhere."""
    part = TaskContext.get().partitionId()
    out, held, current, seen, kind = [], None, None, 0, None
    for b in batches:
        kind = b.schema.field(0).type
        cols = [b.column(k).to_pylist() for k in range(b.num_columns)]
        for conv, turn, role, n, fault, again in zip(*cols, strict=True):
            if held is None or conv != current:
                if held is not None:
                    out.append((current, held.row(part, seen > 0)))
                    seen += 1
                held, current = _Part(), conv
            held.add(turn, role or "", n, fault, again)
        if len(out) > 2_000:
            yield _batch(out, kind)
            out = []
    if held is not None:
        out.append((current, held.row(part, False)))
        yield _batch(out, kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], PART_ARROW)], ["__conv", "__part"])


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by conversation and partition to one row per conversation."""
    def joined(parts: list[dict]) -> dict:
        kept = [p for p in parts if p["rows"]]
        if not kept:
            return parts[0]
        out = {n: sum(p[n] for p in kept) for n in PART}
        for a, b in zip(kept, kept[1:], strict=False):
            out["illegal"] += a["last"] + b["first"] not in LEGAL_PAIRS
            out["turns"] -= b["first_turn"] is not None and a["last_turn"] == b["first_turn"]
        cost, audit = goal(join_cells([tuple((c["p"], c["q"], c["cost"], c["audit"]) for c in p["cells"]) for p in kept]))
        low = [p["low"] for p in kept if p["low"] is not None]
        high = [p["high"] for p in kept if p["high"] is not None]
        return kept[0] | out | {"low": min(low, default=None), "high": max(high, default=None),
                                "cells": [{"p": START, "q": START, "cost": cost, "audit": audit}]}

    parts: list[dict] = []
    current, out, kind = None, [], None
    for b in batches:
        kind = b.schema.field(0).type
        for conv, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if parts and conv != current:
                out.append((current, joined(parts)))
                parts = []
            current = conv
            parts.append(p)
        if len(out) > 2_000:
            yield _batch(out, kind)
            out = []
    if parts:
        out.append((current, joined(parts)))
        yield _batch(out, kind)


def deduced(rows: DataFrame) -> DataFrame:
    """(__conv, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation of ``damaged`` rows."""
    slim = _slim(rows).select("__conv", F.col("__turn").cast("long").alias("__turn"), "__role", "__h", "__g", "__n", "__fault", "__again")
    order = [F.asc_nulls_first(c) for c in ("__conv", "__turn", "__role", "__h", "__g")]
    sorted_rows = slim.repartitionByRange(*order).sortWithinPartitions(*order) \
        .select("__conv", "__turn", "__role", "__n", "__fault", "__again")
    conv = slim.schema["__conv"].dataType.simpleString()
    shape = f"__conv {conv}, __part {PART_TYPE}"
    parts = cut_lineage(sorted_rows.mapInArrow(_deduce_parts, shape))  # partition ends must stay as they were cut
    ends = parts.where("not __part.whole").repartition("__conv").sortWithinPartitions("__conv", "__part.part") \
        .mapInArrow(_join_parts, shape)
    p = lambda n: F.col(f"__part.{n}")
    return parts.where("__part.whole").unionByName(ends).select(
        "__conv", F.coalesce(p("high") - p("low") + 1 - p("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[p(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")],
        p("cells")[0]["cost"].alias("cost"), p("cells")[0]["audit"].alias("audit"))


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A conversation's result, followed by its rows in order; texts move once."""
    n = rows.where("__n > 0").select(
        "__conv", F.col("__turn").cast("long").alias("__turn"), "__role", *_hash(), "__text",
        F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy"))
    head = found.select("__conv", F.lit(0).alias("__copy"), F.struct(*[c for c in found.columns if c != "__conv"]).alias("__found"))
    both = head.unionByName(n, allowMissingColumns=True)
    return both.repartition("__conv").sortWithinPartitions(
        "__conv", (F.col("__copy") > 0), F.asc_nulls_first("__turn"), "__role", "__h", "__g")


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(__conv, __place, __edit, __role, __text): the repaired conversations, row by row, without what is deleted."""
    s = _stream(rows, found).select("__conv", "__role", "__text", F.col("__found.audit").alias("__audit"))
    conv = s.schema["__conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for b in batches:
            out: list[tuple] = []
            for conv_id, edit, role, text, place in _walk(b, walk := walk or _Walk()):
                out.append((conv_id, place, edit, role, text))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(
                [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()])],
                ["__conv", "__place", "__edit", "__role", "__text"])

    return s.mapInArrow(run, f"__conv {conv}, __place long, __edit string, __role string, __text string")


class _Walk:
    """Where the stream stands in an audit."""

    def __init__(self) -> None:
        self.edits: Iterator[tuple[str, str | None]] = iter(())
        self.ahead: tuple[str, str | None] | None = None
        self.place = 0

    def start(self, audit: str) -> None:
        self.edits = edited_rows(audit)
        self.place = 0

    def inserts(self) -> Iterator[tuple[str, str]]:
        """Rows to insert before the next row of the input, whose edit is then ``ahead``."""
        self.ahead = None
        for edit, role in self.edits:
            if edit != "I":
                self.ahead = (edit, role)
                return
            yield edit, role


def _walk(b: pa.RecordBatch, walk: _Walk) -> Iterator[tuple]:
    """(conversation, edit, role, text, place) of every row that stays, for heads and rows in stream order."""
    for conv, role, text, audit in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
        if audit is not None:
            walk.start(audit)
            for edit, new in walk.inserts():
                yield conv, edit, new, "", walk.place
                walk.place += 1
            continue
        edit, new = walk.ahead
        if edit != "D":
            yield conv, edit, new or role, text, walk.place
            walk.place += 1
        for e, r in walk.inserts():
            yield conv, e, r, "", walk.place
            walk.place += 1


def repair(rows: DataFrame) -> DataFrame:
    """``deduced`` with ``repaired_sha256``: the digest of the repaired ``role:text`` lines."""
    found = cut_lineage(deduced(rows))
    s = _stream(rows, found).select("__conv", "__role", "__text", F.col("__found.audit").alias("__audit"),
                                    F.col("__found").alias("__found"))
    conv = s.schema["__conv"].dataType.simpleString()
    kind = s.schema["__found"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, digest, head, fields = _Walk(), None, None, None
        for b in batches:
            fields = (b.schema.field(0), b.schema.field(4))
            out = []
            found_at = b.column(4).is_valid().to_pylist()
            # stream: a head closes the conversation before it
            at = 0
            for k in [*[k for k, f in enumerate(found_at) if f], b.num_rows]:
                if k > at:
                    for _, _, role, text, place in _walk(b.slice(at, k - at), walk):
                        digest.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
                if k < b.num_rows:
                    if head is not None:
                        out.append((*head, digest.hexdigest()))
                    head = (b.column(0)[k].as_py(), b.column(4)[k].as_py())
                    digest = hashlib.sha256()
                at = k
            yield _repaired_batch(out, fields)
        if head is not None:
            yield _repaired_batch([(*head, digest.hexdigest())], fields)

    out = s.mapInArrow(run, f"__conv {conv}, __found {kind}, repaired_sha256 string")
    return out.select("__conv", "__found.*", "repaired_sha256")


def _repaired_batch(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], fields[0].type), pa.array([r[1] for r in rows], fields[1].type),
                            pa.array([r[2] for r in rows], pa.string())], ["__conv", "__found", "repaired_sha256"])
