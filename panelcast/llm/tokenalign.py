"""Alignment of two tokenizers' tokens by their bytes, window by window between white-space anchors.

Tokenizer A is a byte-level BPE (a ``tokenizers`` JSON file), B a piece model
with byte fallback (a ``sentencepiece`` file).  Every whole text is tokenised by
both, A reading a space before the text, which B adds itself.  Tokens whose
bytes do not join to exactly that are not aligned.  Where a text has only
characters that all libraries class alike, and A's ids are in the order of its
merges, A's vocabulary and merges are run by ``tiktoken``, which takes a quarter of
the time and gives the same ids; other texts are run by ``tokenizers``.

Where a token of A and a token of B both begin with a space at the same byte,
both have a token that ends there: an anchor, verified on the two end lists.
Anchors cut a document into windows of a few ids of each side.  What a window
aligns to depends on its ids alone, so it is worked out once per pair of id
tuples, known by two 64-bit fingerprints, and kept: its groups (cut where tokens of both end), and its links (the
pair of tokens that end together).  A corpus repeats its words, so nearly every
window is found by a look-up.

How it scales: texts are tokenised where they lie and never move.  A document
leaves its distinct linked id pairs with their numbers, written as Parquet.
Two linked tokens end in the same bytes, so one is a suffix of the other: a
vocabulary has at most the sum of its tokens' lengths of such pairs
(``possible_pairs``; 345,667 at most of the two public vocabularies), however large the
corpus is.  So the counts per pair are a bounded table: counted by a partial
aggregation, judged per id of B, and broadcast back.

Results for odd input: null and empty texts, and texts with characters that a
tokenizer changes (such as U+2581, which B writes for a space), have no tokens:
zeros, an empty digest, no link; special tokens' strings are plain text; very
long texts are tokenised whole; repeated rows count as often as they occur and
rows with the same id stay rows of their own; a null id stays null; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcast.session import checkpoint_dir

MEMO = 300_000  # windows kept per task; beyond, the memory begins anew
MEMO_IDS = 64  # longer windows seldom come again and are aligned each time
TOGETHER = 1_600_000  # characters tokenised and aligned in one call
# Byte-level BPE's pattern, and characters that all libraries class alike (fixed values): Latin, general punctuation, euro.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ALIKE = re.compile("[\x00-\u024f\u2010-\u2027\u20ac]*")
SPACE = "▁"  # B's sign for a space (fixed value)

COMMA, BAR, SEMICOLON, LINE = range(4)  # what stands before a token's id

Window = tuple[str, int, list[int]]  # groups as text, their number, links as pair codes


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level BPE writes for the bytes: printable Latin-1 as it is, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Sides:
    """Both tokenizers and their tokens' bytes."""

    def __init__(self, a_file: bytes, b_file: bytes) -> None:
        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.fast = ranked(a_file)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.a_bytes, self.b_bytes = a_tokens(a_file), b_tokens(self.b)
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.signed = [f"{sign}{i}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for sign in (",", "|", ";", "\n")]
        self.a_space, self.b_space = (np.array([x[:1] == b" " for x in t]) for t in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        rest = [k for k, t in enumerate(texts) if self.fast is None or not ALIKE.fullmatch(t)]
        found = dict(zip(rest, self.a.encode_batch_fast([" " + texts[k] for k in rest], add_special_tokens=False), strict=True))
        a = [found[k].ids if k in found else self.fast.encode_ordinary(" " + t) for k, t in enumerate(texts)]
        return a, self.b.encode(texts, num_threads=1)

    def whole(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether both sides' tokens join to the text with a space before it."""
        want = b" " + text.encode()
        return b"".join([self.a_bytes[i] for i in a]) == want and b"".join([self.b_bytes[i] for i in b]) == want


def ranked(a_file: bytes) -> tiktoken.Encoding | None:
    """A's own vocabulary and merges for the faster library, if its ids are in the order of the merges and it splits by PATTERN alone."""
    spec = json.loads(a_file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer") \
        and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    merged = [model["vocab"][m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in model["merges"]]
    if not plain or any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
        return None
    alphabet = byte_alphabet()
    added = {t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if i not in added}
    return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def a_tokens(a_file: bytes) -> list[bytes]:
    spec = json.loads(a_file)
    alphabet = byte_alphabet()
    # an added token is its own text
    names = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
    names |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return [names.get(i, b"") for i in range(max(names) + 1)]


def b_tokens(b: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    return [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]


@lru_cache(maxsize=2)
def sides(a_file: bytes, b_file: bytes) -> Sides:
    """Built once per Python worker."""
    return Sides(a_file, b_file)


def possible_pairs(a: list[bytes], b: list[bytes]) -> int:
    """An upper bound of the pairs that can be linked: one token must be a suffix of the other."""
    def suffixes(tokens: list[bytes], others: Counter) -> int:
        return sum(others[t[k:]] for t in tokens for k in range(len(t)))
    return suffixes(a, Counter(b)) + suffixes(b, Counter(a))


def align(a: np.ndarray, len_a: np.ndarray, b: np.ndarray, len_b: np.ndarray, s: Sides) -> list[Window]:
    """Groups and links of windows of so many ids.  They stand behind each other as one text, whose common ends close the groups."""
    if not len(len_a):
        return []
    last_a, last_b = np.cumsum(len_a), np.cumsum(len_b)
    _, ka, kb = np.intersect1d(np.cumsum(s.a_size[a]), np.cumsum(s.b_size[b]), assume_unique=True, return_indices=True)
    new_a, new_b = np.append(0, ka[:-1] + 1), np.append(0, kb[:-1] + 1)  # first token of every group
    # a group's text: its tokens of A, then those of B; every token behind its sign
    codes = np.zeros(len(a) + len(b), dtype=np.int64)
    ga, gb = np.repeat(np.arange(len(ka)), ka - new_a + 1), np.repeat(np.arange(len(kb)), kb - new_b + 1)
    place_a, place_b = np.arange(len(a)) + new_b[ga], np.arange(len(b)) + ka[gb] + 1
    codes[place_a], codes[place_b] = a, b
    signs = np.full(len(codes), COMMA)
    signs[place_a[new_a]], signs[place_b[new_b]] = SEMICOLON, BAR
    signs[np.append(0, (last_a + last_b)[:-1])] = LINE  # the first token of a window
    texts = "".join([s.signed[k] for k in (codes * 4 + signs).tolist()]).split("\n")[1:]
    links = pair_code(a[ka], b[kb]).tolist()
    ends = np.searchsorted(ka, last_a).tolist()
    return [(text, g1 - g0, links[g0:g1]) for text, g0, g1 in zip(texts, [0, *ends], ends, strict=False)]


def pair_code(a, b):
    return a << 32 | b


def cuts(a: np.ndarray, b: np.ndarray, s: Sides) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of the windows on both sides, for two id lists of the same bytes that begin with a space."""
    a_start, b_start = (np.cumsum(size) - size for size in (s.a_size[a], s.b_size[b]))
    ia, ib = np.flatnonzero(s.a_space[a]), np.flatnonzero(s.b_space[b])
    _, ka, kb = np.intersect1d(a_start[ia], b_start[ib], assume_unique=True, return_indices=True)
    return ia[ka], ib[kb]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (the finaliser of SplitMix64; its constants are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(a: np.ndarray, cut_a: np.ndarray, b: np.ndarray, cut_b: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of every window's two id tuples."""
    out = np.zeros(len(cut_a), dtype=np.uint64)
    for side, (ids, cut) in enumerate(((a, cut_a), (b, cut_b))):
        place = np.arange(len(ids)) - np.repeat(cut, np.diff(np.append(cut, len(ids))))
        key = ids.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64) << np.uint64(1) | np.uint64(side)
        out += np.add.reduceat(_mixed(key + np.uint64(salt)), cut)
    return out


class Aligner:
    """Aligns documents, window by window, with a memory of windows."""

    def __init__(self, s: Sides) -> None:
        self.s = s
        self.memo: dict[int, tuple[int, Window]] = {}  # by the first fingerprint, with the second

    def windows(self, marks: list[int], checks: list[int], a: np.ndarray, cut_a: np.ndarray, end_a: np.ndarray,
                b: np.ndarray, cut_b: np.ndarray, end_b: np.ndarray) -> list[Window]:
        """The windows between the given places, from the memory (both fingerprints must agree) or aligned together."""
        kept = list(map(self.memo.get, marks))
        found = [k[1] if k is not None and k[0] == c else None for k, c in zip(kept, checks, strict=True)]
        missing = np.array([k for k, f in enumerate(found) if f is None], dtype=np.int64)
        if len(self.memo) + len(missing) > MEMO:
            self.memo.clear()
        sides = []
        for ids, cut, end in ((a, cut_a[missing], end_a[missing]), (b, cut_b[missing], end_b[missing])):
            size = end - cut
            sides += [ids[np.repeat(cut - np.cumsum(size) + size, size) + np.arange(int(size.sum()))], size]
        short = (sides[1] + sides[3] <= MEMO_IDS).tolist()
        for k, window, keep in zip(missing.tolist(), align(*sides, self.s), short, strict=True):
            found[k] = window
            if keep:
                self.memo[marks[k]] = checks[k], window
        return found

    def documents(self, a: list[list[int]], b: list[list[int]]) -> list[tuple[str, int, np.ndarray]]:
        """(groups, their number, links as pair codes) of documents whose tokens on both sides join to the same bytes.

        The documents stand behind each other as one text; each begins with a space, so with an anchor.
        """
        if not a:
            return []
        ids_a, ids_b = (np.concatenate([np.asarray(x, dtype=np.int64) for x in side]) for side in (a, b))
        cut_a, cut_b = cuts(ids_a, ids_b, self.s)
        mark = fingerprints(ids_a, cut_a, ids_b, cut_b, 1)
        _, first, which = np.unique(mark, return_index=True, return_inverse=True)
        check = fingerprints(ids_a, cut_a, ids_b, cut_b, 2)
        if (check[first[which]] != check).any():  # two windows share 64 bits: every window stands for itself
            first = which = np.arange(len(mark))
        end_a, end_b = np.append(cut_a[1:], len(ids_a)), np.append(cut_b[1:], len(ids_b))
        found = self.windows(mark[first].tolist(), check[first].tolist(), ids_a, cut_a[first], end_a[first], ids_b, cut_b[first], end_b[first])
        texts = [f[0] for f in found]
        sizes = np.array([f[1] for f in found])
        codes = np.fromiter(chain.from_iterable([f[2] for f in found]), dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        # links of all windows in order
        each = sizes[which]
        at = np.cumsum(each) - each
        links = codes[np.repeat(starts[which] - at, each) + np.arange(int(each.sum()))]
        doc_ends = np.searchsorted(cut_a, np.cumsum([len(x) for x in a]))
        out, w0 = [], 0
        order = which.tolist()
        for w1 in doc_ends.tolist():
            l0, l1 = int(at[w0]), int(at[w1 - 1] + each[w1 - 1])
            out.append((";".join([texts[w] for w in order[w0:w1]]), l1 - l0, links[l0:l1]))
            w0 = w1
        return out


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts that are tokenised together; a long text is a run of its own."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield start, k
            start, size = k, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
            with_tokens: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pair, times) of every document, the last two being its distinct
    links (id of A in the upper 32 bits) and their numbers; with ``groups``, the alignment itself, where ``with_tokens``.  The files are read by the driver."""
    files = [docs.sparkSession.sparkContext.broadcast(Path(p).read_bytes()) for p in (a_path, b_path)]
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def rows(aligner: Aligner, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        a, b = aligner.s.encode(texts)
        whole = [k for k, t in enumerate(texts) if t and aligner.s.whole(t, a[k], b[k])]
        done = dict(zip(whole, aligner.documents([a[k] for k in whole], [b[k] for k in whole]), strict=True))
        none = ("", 0, np.zeros(0, np.int64))
        found = [done.get(k, none) for k in range(len(texts))]
        pairs = [np.unique(links, return_counts=True) for _, _, links in found]
        ends = pa.array(np.cumsum([0, *[len(p) for p, _ in pairs]]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], pa.int64())) for x in zip(*pairs, strict=True)]
        size = lambda side: pa.array([len(side[k]) if k in done else 0 for k in range(len(texts))], pa.int64())
        columns = [ids, size(a), size(b), *[pa.array([n for _, n, _ in found], pa.int64())] * 2,
                   pa.array([hashlib.sha256(g.encode()).hexdigest() if k in done else "" for k, (g, _, _) in enumerate(found)], pa.string()), *lists]
        if with_tokens:
            columns.append(pa.array([g for g, _, _ in found], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        aligner = Aligner(sides(files[0].value, files[1].value))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for start, end in _pieces(texts):
                yield rows(aligner, b.column(0).slice(start, end - start), texts[start:end])

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times", *["groups"] * with_tokens]
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, "
                           "groups_sha256 string, pair array<bigint>, times array<bigint>" + ", groups string" * with_tokens)


def pair_counts(documents: DataFrame) -> DataFrame:
    """(pair, count, best): links per id pair over all documents, and whether its id of B has no higher one."""
    each = documents.select(F.inline(F.arrays_zip("pair", "times")))
    counts = each.groupBy("pair").agg(F.sum("times").alias("count"))
    to = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(to.alias("b")).agg(F.max("count").alias("highest"))
    return counts.join(highest, to == highest["b"]).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): ``aligned`` with the corpus-wide counts."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tokenalign-{uuid.uuid4().hex}"
    aligned(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    documents = spark.read.parquet(path)
    # bounded by the two vocabularies, whatever the corpus: see possible_pairs
    counts = F.broadcast(pair_counts(documents))
    met = documents.select("row", F.inline(F.arrays_zip("pair", "times"))).join(counts, "pair")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                  F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return documents.join(sums, "row", "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
