"""Edit-aware token counts with segment trees of pre-tokens.

A text is cut into segments of whole pre-tokens.  A place between a word
character and a space or line end always parts two pre-tokens of the pattern,
since none of its alternatives goes from a visible character on to white
space, and the lookahead sees forwards only.  So segments can be encoded on
their own, and a text's count is the sum over its segments.

A tree over the segments holds sums of characters and tokens.  An edit finds
its segments by walking down the tree, joins them with a neighbour wherever
the cut beside them is no longer of that kind (the boundary context), encodes
only the joined text, and updates the sums on the paths upwards.

The stored state of a document is two short arrays (characters and tokens per
segment); with the text it is enough to apply further edits later.

Results for odd input: null and empty texts count 0; a text without a place to
cut is one segment; whole texts are counted; edits are given in code points of
the text before any edit, end exclusive, must not overlap, and are clipped to
the text; edits at one place apply in their order; rows without edits keep
their count; repeated rows give repeated results; an empty table gives an empty
result; only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The pattern that goes with the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEGMENT = 512  # least characters of a segment
CUT = re.compile(r"(?<=\w)(?=[ \n])")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

Edit = tuple[int, int, str]


@lru_cache(maxsize=2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    """The encoding of a rank file's content; built once per Python worker."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def counter(ranks: bytes) -> Callable[[str], int]:
    encode = encoding(ranks).encode_ordinary
    return lambda text: len(encode(text))


def segments(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        cut = CUT.search(text, at + SEGMENT)
        end = cut.start() if cut else len(text)
        out.append(text[at:end])
        at = end
    return out


class SegmentTree:
    """Sums of characters and tokens over segments; leaves stand at size, size + 1, ..."""

    def __init__(self, parts: list[str], tokens: list[int], count: Callable[[str], int]) -> None:
        self.count = count
        self.parts = parts or [""]
        self.size = len(self.parts)
        self.chars = [0] * self.size + [len(p) for p in self.parts]
        self.tokens = [0] * self.size + (list(tokens) or [0])
        for k in range(self.size - 1, 0, -1):
            self._sum(k)
        self.reencoded = 0  # characters that edits had encoded again

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _before(self, leaf: int) -> int:
        """Characters before a leaf."""
        out, low, high = 0, self.size, self.size + leaf
        while low < high:
            if low & 1:
                out += self.chars[low]
                low += 1
            if high & 1:
                high -= 1
                out += self.chars[high]
            low >>= 1
            high >>= 1
        return out

    def _leaf_at(self, place: int) -> int:
        """The first leaf that ends after ``place``, or the last one, by halving the leaves."""
        low, high = 0, self.size - 1
        while low < high:
            mid = (low + high) // 2
            if self._before(mid + 1) > place:
                high = mid
            else:
                low = mid + 1
        return low

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.parts[leaf] = text
        k = self.size + leaf
        self.chars[k], self.tokens[k] = len(text), tokens
        k >>= 1
        while k:
            if 2 * k + 1 < 2 * self.size:
                self._sum(k)
            k >>= 1

    def _neighbour(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < self.size and not self.parts[leaf]:
            leaf += step
        return leaf if 0 <= leaf < self.size else None

    def edit(self, start: int, end: int, new: str) -> None:
        first = self._leaf_at(start)
        last = self._leaf_at(max(start, end - 1))
        offset = self._before(first)
        old = "".join(self.parts[first:last + 1])
        text = old[:start - offset] + new + old[end - offset:]
        for leaf in range(first, last + 1):
            if self.parts[leaf]:
                self._put(leaf, "", 0)
        # the cuts on both sides must still part pre-tokens
        while (left := self._neighbour(first, -1)) is not None and not CUT.match(self.parts[left][-1] + text[:1], 1):
            text = self.parts[left] + text
            self._put(left, "", 0)
            first = left
        while text and (right := self._neighbour(last, 1)) is not None and not CUT.match(text[-1] + self.parts[right][:1], 1):
            text += self.parts[right]
            self._put(right, "", 0)
            last = right
        self._put(first, text, self.count(text))
        self.reencoded += len(text)


def build(text: str, count: Callable[[str], int]) -> SegmentTree:
    parts = segments(text)
    return SegmentTree(parts, [count(p) for p in parts], count)


def apply_edits(tree: SegmentTree, edits: list[Edit]) -> None:
    """From the last to the first, so that places before an edit stay true."""
    n = tree.chars[1]
    for start, end, new in sorted(edits, key=lambda x: (x[0], x[1]))[::-1]:
        start, end = min(max(start, 0), n), min(max(end, 0), n)
        tree.edit(start, max(start, end), new)


def cleaning_edits(text: str) -> list[Edit]:
    """What a light cleaning changes: lines that repeat an earlier line go, e-mail addresses are masked."""
    out: list[Edit] = []
    seen: set[str] = set()
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        if line and line in seen:
            out.append((max(at - 1, 0), end, ""))
        else:
            seen.add(line)
            if "@" in line:
                out += [(at + m.start(), at + m.end(), "<email>") for m in EMAIL.finditer(line)]
        at = end + 1
    return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None,
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, n_segments, n_edits, n_tokens_after, n_chars_after, n_reencoded, seg_chars, seg_tokens).

    ``edits_col`` is an array of (start, end, new); without it ``cleaning_edits`` are applied.  The two
    arrays are the state after the edits, for ``recount``.  The rank file is read once, by the driver.
    """
    return _counted(docs, id_col, text_col, edits_col, None, vocabulary)


def recount(state: DataFrame, id_col: str, text_col: str, edits_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Like ``count_tokens`` for rows that hold the stored arrays ``seg_chars`` and ``seg_tokens`` of their text:
    nothing but the edited segments is encoded."""
    return _counted(state, id_col, text_col, edits_col, ("seg_chars", "seg_tokens"), vocabulary)


def _counted(docs: DataFrame, id_col: str, text_col: str, edits_col: str | None, state: tuple[str, str] | None,
             vocabulary: str) -> DataFrame:
    ranks = Path(vocabulary).read_bytes()
    slim = docs.select(
        F.col(id_col), F.col(text_col).cast("string").alias("__text"),
        (F.col(edits_col) if edits_col else F.lit(None).cast("array<struct<start:int,end:int,new:string>>")).alias("__edits"),
        *[F.col(c).alias(f"__{c}") for c in state or ()])

    def one(text: str, edits: list[Edit], parts: tuple[list[int], list[int]] | None, count) -> tuple:
        if parts is None:
            tree = build(text, count)
        else:
            pieces, at = [], 0
            for n in parts[0]:
                pieces.append(text[at:at + n])
                at += n
            tree = SegmentTree(pieces, parts[1], count)
        before = tree.total
        apply_edits(tree, edits)
        used = [k for k in range(tree.size) if tree.parts[k]]
        return (before, tree.size if tree.parts != [""] else 0, len(edits), tree.total, tree.chars[1], tree.reencoded,
                [len(tree.parts[k]) for k in used], [tree.tokens[tree.size + k] for k in used])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks)
        for b in batches:
            out = []
            for k in range(b.num_rows):
                text = b.column("__text")[k].as_py() or ""
                if edits_col:
                    edits = [(x["start"], x["end"], x["new"] or "") for x in b.column("__edits")[k].as_py() or []]
                else:
                    edits = cleaning_edits(text)
                parts = tuple(b.column(f"__{c}")[k].as_py() or [] for c in state) if state else None
                out.append(one(text, edits, parts, count))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())] * 2
            yield pa.record_batch([b.column(0), *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]], names)

    names = [id_col, "n_tokens", "n_segments", "n_edits", "n_tokens_after", "n_chars_after", "n_reencoded", "seg_chars", "seg_tokens"]
    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names[1:7])
                           + ", seg_chars array<int>, seg_tokens array<int>")
