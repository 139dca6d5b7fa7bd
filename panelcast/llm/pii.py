"""Personal data: patterns, checksums, context words [DataFrame functions only].

Regular expressions propose spans; Luhn (cards) and mod-97 (IBAN) confirm
them; words near a span raise its score.  The four base kinds (email, ip,
card, phone) follow fixed definitions and are kept whatever their score; two
more kinds are kept by score: ``iban`` (mod-97 must hold) and ``national``
(nnn-nn-nnnn; only a context word lifts it over the least score).

A span's start and end come from the gaps between matches: ``split`` and
``regexp_extract_all`` with one pattern give gaps and matches, and running
sums of their lengths give code-point positions.

The patterns hold no repeated groups, which Java matches by recursion (a long
run of digits would overflow a task's stack), and start only where a run of
their characters starts, which keeps long runs linear.  Where a base pattern
has a repeated group, an equal form is used; see the comments.

Results for odd input: null and empty texts have no spans; whole texts are
searched, however long; equal rows give equal results; only the named columns
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "national")
# Words that speak for a kind when they stand before a span (fixed values).
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address",
    "card": "card|visa|mastercard|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "national": "ssn|social|security|national|insurance|identity",
}
CONTEXT_CHARS = 60  # code points before a span that are searched for context words
# Scores in hundredths: what a pattern alone is worth, what a checksum and a context word add.
PATTERN_SCORE = {"email": 80, "ip": 50, "card": 40, "phone": 50, "iban": 40, "national": 40}
CHECKSUM_SCORE, CONTEXT_SCORE = 40, 20
MIN_SCORE = 60  # of the further kinds

# Equal to [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : a match exists as soon as one label follows a dot, and
# goes on to the first place where no label character, nor a dot with a label character after it, follows.  All starts
# within one run of local-part characters succeed or fail alike, so only its first one (or the end of a match) is tried.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]"
         r"[A-Za-z0-9.-]*?(?=\z|[^A-Za-z0-9.-]|\.(?![A-Za-z0-9-]))")
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
# Runs of digits, spaces and hyphens that are long enough to hold 13 digits; two separators in a row end a match of
# [0-9]([\x20-]?[0-9])+, so each run is cut there.
CARD_RUN = r"[0-9][\x20\-0-9]{11,}[0-9]"
CARD_CUT = r"[\x20\-]{2,}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


SPAN = "array<struct<s:int,e:int,v:string,near:boolean>>"
# What a text must hold for a pattern to be tried at all.
PATTERNS = {"email": (EMAIL, "@"), "ip": (IP, "[0-9]"), "card": (CARD_RUN, "[0-9]"), "phone": (PHONE, "+"),
            "iban": (IBAN, "[0-9]"), "national": (NATIONAL, "[0-9]")}


def _walk(gaps: Column, found: Column, kind: str, first: Column, near: Column | None = None) -> Column:
    """Spans of ``found``, each preceded by its gap; ``first`` is the place of the first gap."""
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(
        F.char_length(g).alias("g"), F.char_length(v).alias("n"), v.alias("v"),
        (F.lower(F.right(g, F.lit(CONTEXT_CHARS))).rlike(CONTEXT[kind]) if near is None else near).alias("near")))
    return F.aggregate(
        pairs, F.struct(first.alias("at"), F.array().cast(SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["n"]).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["n"]).alias("e"), x["v"].alias("v"),
                x["near"].alias("near")))).alias("out")),
        lambda a: a["out"])


def _pieces(run: Column) -> Column:
    """The parts of a card run between two or more separators, as spans."""
    gaps = F.concat(F.array(F.lit("")), F.regexp_extract_all(run["v"], F.lit(CARD_CUT), F.lit(0)))
    return _walk(gaps, F.split(run["v"], CARD_CUT, -1), "card", run["s"], run["near"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda a, k: a + F.when(
            k % 2 == 0,
            F.element_at(F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)]),
                         F.substr(digits, F.length(digits) - k + 1, F.lit(1)).cast("int") + 1),
        ).otherwise(F.substr(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")))
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(F.lit(False))


def _mod97(value: Column) -> Column:
    """IBAN check: first four characters to the end, letters as 10 to 35, remainder 1."""
    turned = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))
    left = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0),
        lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return left == 1


def _ip_ok(value: Column) -> Column:
    def part(p: Column) -> Column:
        short = F.ltrim(p, F.lit("0"))
        return F.when(F.length(short) > 3, False).otherwise(F.coalesce(F.when(short == "", 0).otherwise(short.cast("int")), F.lit(0)) <= 255)
    return F.forall(F.split(value, r"\."), part)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, email, ip, card, phone, iban, national): arrays of (s, e, v, near, score) in text order."""
    text = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    # matches and gaps stand in columns of their own, so that each pattern runs over a text once for either
    raw = text.select("__id", *[
        F.when(F.col("__text").rlike(sign) if len(sign) > 1 else F.contains(F.col("__text"), F.lit(sign)), out).alias(name)
        for kind, (pattern, sign) in PATTERNS.items()
        for name, out in ((f"{kind}_found", F.regexp_extract_all(F.col("__text"), F.lit(pattern), F.lit(0))),
                          (f"{kind}_gaps", F.split(F.col("__text"), pattern, -1)))])
    walked = raw.select("__id", *[
        F.when(F.size(f"{kind}_found") > 0, _walk(F.col(f"{kind}_gaps"), F.col(f"{kind}_found"), kind, F.lit(0)))
        .otherwise(F.array().cast(SPAN)).alias(kind) for kind in PATTERNS])
    checked = {
        "email": F.col("email"),
        "ip": F.filter("ip", lambda x: _ip_ok(x["v"])),
        "card": F.filter(F.flatten(F.transform("card", _pieces)), lambda x: F.length(_digits(x["v"])).between(13, 19) & _luhn(_digits(x["v"]))),
        "phone": F.filter("phone", lambda x: F.length(_digits(x["v"])).between(9, 15)),
        "iban": F.filter("iban", lambda x: _mod97(x["v"])),
        "national": F.col("national"),
    }
    return walked.select("__id", *[_scored(kind, spans).alias(kind) for kind, spans in checked.items()])


def _scored(kind: str, spans: Column) -> Column:
    sure = PATTERN_SCORE[kind] + (CHECKSUM_SCORE if kind in ("card", "iban") else 0)
    scored = F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["near"].alias("near"),
        (F.lit(sure) + F.when(x["near"], CONTEXT_SCORE).otherwise(0)).alias("score")))
    return scored if kind in BASE_KINDS else F.filter(scored, lambda x: x["score"] >= MIN_SCORE)


def span_digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts, the digest of the base spans, all spans and their scores as strings."""
    def told(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    def joined(kinds) -> Column:
        return F.array_join(F.concat(*[told(k) for k in kinds]), ",")

    kinds = (*BASE_KINDS, *MORE_KINDS)
    return spans.select(
        F.col("__id").alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(BASE_KINDS), 256).alias("base_sha256"),
        joined(kinds).alias("spans"),
        F.array_join(F.concat(*[F.transform(k, lambda x: x["score"].cast("string")) for k in kinds]), ",").alias("scores"))
