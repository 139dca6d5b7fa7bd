"""Registered queries of the training-data operators, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import conversation, decontaminate, htmltext, linededup, mixing, pii, quality, secrets, simhash, tokenalign, tokencount, urlfilter, warc
from panelcast.llm.common import read_table
from panelcast.session import checkpoint_dir, cut_lineage

TOKENIZERS = "/opt/tokenizers"  # where the queries find the public vocabularies


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed by source (target share: square root of a source's text), replicated and shuffled."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mixing.mix(docs).withColumnsRenamed({"__copy": "copy", "__order": "shuffle_key"})


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return pii.span_digest(pii.find_spans(read_table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; cutoffs learnt per language from ``labels``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    slim = cut_lineage(quality.measured(docs).select("doc_id", "lang", "__m"))
    cutoffs = quality.learn_cutoffs(slim, read_table(spark, sf_dir, "labels"))
    return quality.judge(slim, cutoffs).select(
        "doc_id", *[F.col("__m")[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret candidate in every whole text, with the forest's verdict."""
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), F.col("__start").alias("start"), F.col("__end").alias("end"),
                        F.sha2("__value", 256).alias("value_sha256"), "probability", "is_secret")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each benchmark item it contains, also with other names, numbers and units."""
    found = decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("__id").alias("doc_id"), F.col("__item").alias("item_id"),
                        F.col("__windows").alias("n_windows"), F.col("__matched").alias("n_matched"),
                        F.col("__changed").alias("reparameterised"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of windows that occur earlier in the corpus."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).withColumnsRenamed({"__n_lines": "n_lines", "__n_removed": "n_removed"})


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for every page's URL."""
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"),
                        F.col("__component").alias("component_id"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(read_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after a light cleaning, with the characters encoded again."""
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents")).drop("seg_chars", "seg_tokens")


def op11_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    rows = conversation.damaged(read_table(spark, sf_dir, "conversations"))
    return conversation.repair(rows).withColumnRenamed("__conv", "conv_id")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into WARC archives, normalised record by record, and read back by the index."""
    pages = read_table(spark, sf_dir, "pages")
    archives = warc.archive_pages(pages, f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    found = warc.read_archives(archives, pages.schema["page_id"].dataType.simpleString(), with_payload=False)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two public tokenizers aligned in every whole text, with corpus-wide counts of the linked ids."""
    docs = read_table(spark, sf_dir, "documents")
    return tokenalign.alignment(docs, f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model") \
        .withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_simhash": op8_simhash,
    "op9_html_text": op9_html_text,
    "op10_token_counts": op10_token_counts,
    "op11_conversation": op11_conversation,
    "op12_warc": op12_warc,
    "op13_token_align": op13_token_align,
}


def _rows_sql() -> str:
    """Mixing: the same md5 draws, the distribution of each source as a recursive table."""
    seed, piece, terms = mixing.SEED, mixing.PIECE_MEAN, mixing.TERMS
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, text, coalesce(length(text), 0) AS n FROM documents),
sz AS (SELECT source, sum(n) AS size FROM d GROUP BY source),
tot AS (SELECT CAST(sum(size) AS DOUBLE) / sum(pow(CAST(size AS DOUBLE), 0.5)) AS f FROM sz),
rt AS (SELECT source, CASE WHEN size = 0 THEN 1.0 ELSE pow(CAST(size AS DOUBLE), 0.5) * f / size END AS rate FROM sz, tot),
pc AS (SELECT source, CAST(greatest(1, ceil(rate / {piece})) AS INTEGER) AS pieces, rate / greatest(1, ceil(rate / {piece})) AS mean FROM rt),
c AS (SELECT source, pieces, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM pc
      UNION ALL SELECT source, pieces, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM c WHERE k < {terms}),
cdf AS (SELECT source, min(pieces) AS pieces, list(c ORDER BY k) AS cs FROM c GROUP BY source),
u AS (SELECT d.*, cs, unnest(range(1, pieces + 1)) AS j FROM d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
n AS (SELECT doc_id, source, lang, text, CAST(sum(len(list_filter(cs, lambda x: x <
             CAST(CAST('0x' || substr(md5(concat_ws(':', '{seed}', CAST(doc_id AS VARCHAR), CAST(j AS VARCHAR))), 1, 13) AS BIGINT) AS DOUBLE)
             / 4503599627370496.0))) AS INTEGER) AS copies
      FROM u GROUP BY doc_id, source, lang, text),
x AS (SELECT doc_id, source, lang, text, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM n)
SELECT doc_id, source, lang, text, copy,
       md5(concat_ws(':', '{seed}', CAST(doc_id AS VARCHAR), CAST(copy AS VARCHAR), 'order')) AS shuffle_key
FROM x"""


def _lines_sql() -> str:
    return r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents),
s AS (SELECT doc_id, i, trim(line, E' \t\r') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
      FROM l WHERE trim(line, E' \t\r') <> ''),
w AS (SELECT doc_id, p, i AS i0, lead(i) OVER v AS i1, lead(i, 2) OVER v AS i2, t AS a, lead(t) OVER v AS b, lead(t, 2) OVER v AS c
      FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS r FROM w WHERE i2 IS NOT NULL),
cut AS (SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM f WHERE r > 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM cut GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text
         FROM l LEFT JOIN cut ON cut.doc_id = l.doc_id AND cut.i = l.i WHERE cut.i IS NULL GROUP BY l.doc_id),
m AS (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n.n_removed IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text,
       coalesce(m.n_lines, 0) AS n_lines, coalesce(n.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _urls_sql() -> str:
    """Every rule against every URL, without an index."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    base = [r for r in urlfilter.RULES if r.base]
    hit = lambda r: f"regexp_matches(t, {quote(r.regex)})"
    by_length = sorted(base, key=lambda r: -len(r.name))
    pick = lambda value: "CASE " + " ".join(f"WHEN {hit(r)} THEN {quote(value(r))}" for r in by_length) + " END"
    some = lambda action: " OR ".join(f"(t <> '' AND {hit(r)})" for r in urlfilter.RULES if not r.base and r.action == action)
    part = lambda k: f"coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)(.*)$', {k}, 's'), '')"
    rare = urlfilter.TOKEN
    tokens = f"list_distinct(regexp_extract_all(lower(t), '{rare}'))"
    # candidates: rules whose rarest token the URL holds
    spread = ", ".join(f"({quote(r.name)}, {quote(t)})" for r in urlfilter.RULES for t in (r.tokens or ("",)))
    return f"""
WITH u AS (SELECT page_id, url, translate({part(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  {part(2)} AS path, {part(3)} AS rest FROM pages),
v AS (SELECT *, host || path || rest AS t FROM u),
tk AS (SELECT DISTINCT url, unnest({tokens}) AS token FROM v WHERE host <> '' UNION SELECT DISTINCT url, '' FROM v WHERE host <> ''),
rt(name, token) AS (VALUES {spread}),
nt AS (SELECT token, count(*) AS n FROM tk WHERE token <> '' GROUP BY token),
ix AS (SELECT rt.name, min_by(rt.token, struct_pack(n := coalesce(nt.n, 0), t := rt.token)) AS token FROM rt LEFT JOIN nt USING (token) GROUP BY rt.name),
cn AS (SELECT tk.url, count(*) AS n FROM tk JOIN ix USING (token) GROUP BY tk.url)
SELECT page_id, host, path, {pick(lambda r: r.name)} AS rule,
       coalesce({pick(lambda r: r.action)}, CASE WHEN ({some('block')}) AND NOT ({some('allow')}) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(cn.n, 0) AS n_candidates
FROM v LEFT JOIN cn ON cn.url = v.url"""


def _warc_sql() -> str:
    """Base 32 from the hexadecimal SHA-1: ten digits are eight letters."""
    return """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + CAST((CAST('0x' || substr(x, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '') AS digest FROM p),
r AS (SELECT *, row_number() OVER v AS k, first_value(page_id) OVER v AS first FROM d
      WINDOW v AS (PARTITION BY digest, n ORDER BY page_id NULLS LAST))
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN first END AS refers_to
FROM r"""


ORACLE_SQL: dict[str, str] = {
    "op1_mixing": _rows_sql(),
    "op6_line_dedup": _lines_sql(),
    "op7_url_filter": _urls_sql(),
    "op12_warc": _warc_sql(),
}
