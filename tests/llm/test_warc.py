import base64
import gzip
import hashlib
import random
import zlib

import pytest

from panelcast.llm import queries as q
from panelcast.llm import warc as w

PAGES = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(table):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page."""
    last = float("inf")
    out, groups = [], {}
    for i, _, html in table:
        groups.setdefault(html or "", []).append(i)
    for html, ids in groups.items():
        ids.sort(key=lambda i: last if i is None else i)
        for k, i in enumerate(ids):
            out.append((i, len(html.encode()), digest(html), "revisit" if k else "response", ids[0] if k else None))
    return sorted(out, key=repr)


def archived(df, tmp_path, **options):
    folder = f"file:{tmp_path}/archives"
    archives = w.archive_pages(df, folder, **options)
    return archives, w.read_archives(archives, "long")


def test_pages_match_brute_force_and_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    texts = ["", None, "same", "é中\U0001f600\r\n\r\nx", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "long " * 300_000]
    table = [(i, rnd.choice([None, f"http://a.b/{i}?x=%41", "http://a.b/\r\nX: y", "http://é.fr/ü"]), rnd.choice(texts + [f"t{i}"])) for i in range(60)]
    table += [(None, None, "same"), (None, "u", "only"), (None, "u", "only"), (7, "z", "same"), table[5], table[5]]
    df = spark.createDataFrame([(*r, 1, "x") for r in table], PAGES + ", archive int, seq string").repartition(4)
    archives, found = archived(df, tmp_path, roll=1 << 20)
    rows = found.collect()
    assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr) == brute(table)
    held = {r["payload_digest"]: r["payload"] for r in rows if r["record_type"] == "response"}
    assert sorted(((r["id"], held[r["payload_digest"]].decode()) for r in rows), key=repr) == sorted(((i, x or "") for i, _, x in table), key=repr)
    assert len(held) == len({x or "" for _, _, x in table}) and all(r["payload"] is None for r in rows if r["record_type"] == "revisit")
    urls = {i: u for i, u, _ in table}
    for r in rows:
        if r["id"] in urls and r["id"] != 7 and r["id"] is not None:
            u = urls[r["id"]]
            assert r["url"] == (u if u is None else u.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20"))
    assert sum(r["records"] for r in archives.collect()) == len(table) + len({r["archive"] for r in rows})


def test_every_member_stands_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", f"page {i % 3}") for i in range(9)], PAGES).coalesce(1)
    archives, found = archived(df, tmp_path)
    rows = found.collect()
    (archive,) = [r["archive"] for r in archives.collect()]
    path = w.filesystem(archive)[1]
    raw = open(path, "rb").read()
    whole = list(w.records(w.Inflated(lambda n, it=iter([raw]): next(it, b""), "whole")))
    assert len(whole) == 10
    for e, (headers, block) in zip(w.index_entries(archive), whole, strict=True):
        member = gzip.decompress(raw[e["offset"]:e["offset"] + e["length"]])
        assert member.startswith(b"WARC/1.1\r\n") and member.count(b"WARC-Record-ID") == 1
        assert w.fetch(archive, e["offset"], e["length"]) == (headers, block)
    ids = {dict(h)["WARC-Record-ID"] for h, _ in whole}
    assert len(ids) == 10 and all(dict(h).get("WARC-Refers-To") in ids | {None} for h, _ in whole)
    assert {r["record_type"] for r in rows} == {"response", "revisit"}


def test_small_payloads_are_all_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "xxx"), (4, "d", "xxx")], PAGES)
    _, found = archived(df, tmp_path, least=3)
    assert sorted((r["id"], r["record_type"], r["refers_to"]) for r in found.collect()) == [
        (1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_normaliser_reads_any_layout(tmp_path):
    rnd = random.Random(2)
    some = [([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x:{k}>")], rnd.randbytes(rnd.choice([0, 10, 3_000_000]))) for k in range(6)]
    plain = [w.encode(h, b) for h, b in some]
    for name, raw in {"mono": gzip.compress(b"".join(plain)), "members": b"".join(map(gzip.compress, plain)),
                      "cut anywhere": b"".join(gzip.compress(b"".join(plain)[k:k + 777_777]) for k in range(0, sum(map(len, plain)), 777_777))}.items():
        source, target = f"{tmp_path}/{name}.gz", f"{tmp_path}/{name}-new.gz"
        open(source, "wb").write(raw)
        assert w.normalise(source, target, lambda h, b: (h, b)) == 6
        assert [w.fetch(target, e["offset"], e["length"]) for e in w.index_entries(target)] == some


def test_damaged_archives_are_named(tmp_path):
    good = gzip.compress(w.encode([("WARC-Type", "response")], b"x" * 1000))
    body = zlib.compress(b"")
    for k, raw in enumerate([good[:-9], good[:20], b"plain", gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"),
                             gzip.compress(b"WARC/1.1\r\n\r\n"), gzip.compress(b"HTTP/1.1 200\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nA: b"), body]):
        source = f"{tmp_path}/bad{k}.gz"
        open(source, "wb").write(raw)
        with pytest.raises(ValueError, match=f"bad{k}"):
            w.normalise(source, source + ".out", lambda h, b: (h, b))


def test_empty_table(spark, tmp_path):
    archives, found = archived(spark.createDataFrame([], PAGES), tmp_path)
    assert archives.count() == 0 and found.count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = q.QUERIES["op12_warc"](spark, sf)
    assert dict(got.dtypes) == {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string",
                                "record_type": "string", "refers_to": "bigint"}
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute(table)
