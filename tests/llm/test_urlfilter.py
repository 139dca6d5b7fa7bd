import re

from panelcast.llm import urlfilter as u

BASE = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    tail = rest[len(host) + len(path):]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), a, h + p) for a, h, p in BASE if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, action, rule = max(fits)
        return host, path, rule, action
    hits = {r.action for r in u.RULES if not r.base and host and re.search(r.regex, host + path + tail)}
    return host, path, None, "block" if hits == {"block"} else "allow"


URLS = [
    None, "", "nothing", "http://", "http:///x", "https://A.net/x", "https://net", "https://net/", "https://net?x", "https://xnet/",
    "http://EXAMPLE.net/en/1", "http://example.net/en", "http://a.b.example.net/en/?q", "http://example.com/de/x#y", "http://example.com/De/x",
    "http://example.com/dev/", "http://example.org/fr/1", "http://x.org/frx/", "http://É.net/a", "http://a.com/x://b.net/",
    "http://www.cheap-pills.example.com/en/1", "http://m.casino-win.example.com/", "https://ads-track.example.com", "http://a.com/ads/x",
    "http://a.com/x?utm_source=ads", "http://a.com/x?utm_source=adserver", "http://casino.edu/x", "http://free-bets.example.com/en/\nx",
    "http://a.com/" + "x/" * 20_000, "ftp://spam-farm.example.org/x", "http://spam-farm.example.org/fr/x",
]


def test_verdicts_match_brute_force(spark):
    urls = URLS + ["https://A.net/x", None]
    pages = spark.createDataFrame([(i, x, "<p>", "z") for i, x in enumerate(urls)], "page_id long, url string, html string, rule string")
    rows = {r["page_id"]: r for r in u.judge_urls(pages).collect()}
    assert len(rows) == len(urls)
    for i, x in enumerate(urls):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == brute(x), x
    assert u.judge_urls(pages.limit(0)).count() == 0


def test_rules_stand_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(["free", "a"],), (["free", "bets"],), (["free"],)], "__tokens array<string>")
    index = {r["rule"]: r["token"] for r in u.rule_index(spark, urls, u.RULES).collect()}
    assert index["bets"] == "bets" and index["ads"] == "" and index["example.net/en/"] == "en"


def test_many_rules_come_as_a_table(spark, monkeypatch):
    many = [u.base_rule("block", f"site{k}.example/p{k}/") for k in range(3_000)] + [u.Rule("odd", "block", r"/odd-path/", ("odd", "path"))]
    urls = ["http://site7.example/p7/x", "http://a.site2999.example/p2999/", "http://site8.example/p7/", "http://x.y/odd-path/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for wide in (True, False):
        if not wide:
            monkeypatch.setattr(u, "small_side", lambda df, limit=0: df)
        rows = {r["page_id"]: r for r in u.judge_urls(pages, rules=u.rules_table(spark, tuple(many))).collect()}
        assert [(rows[k]["rule"], rows[k]["verdict"]) for k in range(5)] == [
            ("site7.example/p7/", "block"), ("site2999.example/p2999/", "block"), (None, "allow"), (None, "block"), (None, "allow")]
        assert rows[0]["n_candidates"] < 5
