"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression over host, path and rest of a URL together with the
literal tokens that every matching URL must hold.  The rule stands in an index
under the one of its tokens that the URLs at hand hold least often (ties: the
alphabetically first).  The tokens of a URL fetch candidate rules by an
equi-join, and only those run their regular expression.

Base rules name a host (with all subdomains) and a path prefix; the longest
one that fits decides.  Otherwise a URL is blocked when a pattern rule that
blocks fits and none that allows does.

Results for odd input: a NULL URL, or one without ``://``, has empty host and
path, fits no rule and is allowed; ties cannot occur among base rules, as one
URL fits at most one rule of a given length; URLs of any length are judged
whole; repeated rows give repeated results; an empty table gives an empty table;
only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import small_side
from panelcast.session import cut_lineage

TOKEN = r"[a-z0-9]+"


class Rule(NamedTuple):
    name: str
    action: str  # block or allow
    regex: str  # over host, path and rest, found anywhere
    tokens: tuple[str, ...]  # literal tokens of every URL that fits
    base: bool = False


def base_rule(action: str, name: str) -> Rule:
    """``example.net/en/``: the host and all subdomains, where the path starts with /en/."""
    host, _, path = name.partition("/")
    # the last part of a path prefix may be the start of a longer token, unless a slash ends it
    whole = re.findall(TOKEN, path if path.endswith("/") else path.rpartition("/")[0])
    return Rule(name, action, rf"^(?:[^/?#]*\.)?{re.escape(host)}/{re.escape(path)}", (*re.findall(TOKEN, host), *whole), True)


# The base rules of the contract, then pattern rules for common kinds of unwanted pages (fixed values).
RULES = (
    base_rule("block", "net/"),
    base_rule("allow", "example.net/en/"),
    base_rule("block", "example.com/de/"),
    base_rule("allow", "org/fr/"),
    Rule("casino", "block", r"^[^/?#]*\bcasino\b", ("casino",)),
    Rule("pills", "block", r"^[^/?#]*\b(?:cheap|free|buy)-pills\b", ("pills",)),
    Rule("bets", "block", r"^[^/?#]*\bfree-bets\b", ("free", "bets")),
    Rule("ads", "block", r"^[^/?#]*\bads?-(?:track|server)\b|/(?:ads|banner)/", ()),
    Rule("spam", "block", r"^[^/?#]*\bspam-farm\b", ("spam", "farm")),
    Rule("tracked", "block", r"[?&]utm_source=ads?\b", ("utm", "source")),
    Rule("education", "allow", r"^[^/?#]*\.edu/", ("edu",)),
)


def _ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """host, path and the rest (query and fragment) of a URL; empty strings without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return _ascii_lower(part(1)), part(2), part(3)


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_ascii_lower(c), F.lit(f"({TOKEN})"), F.lit(1)))


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rules as a table (rule, action, regex, base, tokens); a longer list is read from files with these columns."""
    return spark.createDataFrame([(r.name, r.action, r.regex, r.base, list(r.tokens)) for r in rules],
                                 "rule string, action string, regex string, base boolean, tokens array<string>")


def rule_index(spark: SparkSession, urls: DataFrame, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """(token, rule columns): each rule under its rarest token, counted over all ``urls`` (column __tokens).

    A rule without a literal token stands under the empty token, which every URL holds.
    """
    table = rules if isinstance(rules, DataFrame) else rules_table(spark, rules)
    tokens = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))
    spread = cut_lineage(table.select("rule", "action", "regex", "base", F.explode(tokens).alias("token")))
    wanted = small_side(spread.where("token <> ''").select("token").distinct())
    counts = urls.select(F.explode("__tokens").alias("token")).join(wanted, "token").groupBy("token").count()
    return spread.join(counts, "token", "left").groupBy("rule", "action", "regex", "base").agg(
        F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), F.col("token"))).alias("token"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] | DataFrame = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, n_candidates): one row per row of ``pages``.

    ``rules`` may be a table as of ``rules_table``, of any length; each base rule and each pattern has a name of its own.
    """
    spark = pages.sparkSession
    # rows that repeat a URL are judged once: equal URLs have equal verdicts
    host, path, rest = split_url(F.col("__url"))
    urls = pages.select(F.col(url_col).alias("__url")).distinct().select(
        "__url", host.alias("__host"), path.alias("__path"), rest.alias("__rest")) \
        .withColumn("__target", F.concat("__host", "__path", "__rest")) \
        .withColumn("__tokens", F.when(F.col("__host") != "", F.array_append(_tokens(F.col("__target")), "")).otherwise(F.array()))
    index = small_side(rule_index(spark, urls, rules))
    candidates = urls.select("__url", "__target", F.explode("__tokens").alias("token")).join(index, "token")
    fits = candidates.withColumn("__fits", F.expr("rlike(__target, regex)"))
    judged = fits.groupBy("__url").agg(
        F.count(F.lit(1)).alias("__n"),
        F.max_by(F.struct("rule", "action"), F.when(F.col("__fits") & F.col("base"), F.length("rule"))).alias("__base"),
        F.max(F.col("__fits") & ~F.col("base") & (F.col("action") == "block")).alias("__block"),
        F.max(F.col("__fits") & ~F.col("base") & (F.col("action") == "allow")).alias("__allow"))
    host, path, _ = split_url(F.col(url_col))
    joined = pages.select(F.col(id_col), F.col(url_col).alias("__page_url"), host.alias("host"), path.alias("path")).join(
        judged, F.col("__page_url") == F.col("__url"), "left")
    by_pattern = F.when(F.coalesce("__block", F.lit(False)) & ~F.coalesce("__allow", F.lit(False)), "block").otherwise("allow")
    return joined.select(
        id_col, "host", "path", F.col("__base")["rule"].alias("rule"),
        F.coalesce(F.col("__base")["action"], by_pattern).alias("verdict"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_candidates"))
