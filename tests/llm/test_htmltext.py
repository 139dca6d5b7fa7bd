import math
import random

import pytest

from panelcast.llm import htmltext as h

LONG = "Some words of the article that go on for quite a while, so that the block is dense. " * 3
PARAS = [f"Paragraph {k}. {LONG.strip()}" for k in range(4)]


def page(body, lang="en"):
    return f'<!DOCTYPE html><html lang="{lang}"><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
ARTICLE = "<article><h1>A title</h1>" + "".join(f"<p>{p}</p>" for p in PARAS) + "</article>"
EXPECTED = "\n".join(["A title", *PARAS])


@pytest.mark.parametrize("html", [
    page(NAV + ARTICLE + "<footer>&copy; 2020</footer>"),
    page(NAV + '<div class="ad">Buy now, the best of all things!</div>' + ARTICLE),
    page('<header><h2>Site name</h2></header>' + ARTICLE + '<aside><p>' + LONG + "</p></aside>"),
    page(ARTICLE + '<div class="comments"><p>' + LONG + "</p><p>" + LONG + "</p></div>"),
    page(ARTICLE + '<section id="comments"><article class="comment"><p>' + LONG * 4 + "</p></article></section>"),
    page('<div class="cookie-notice"><p>' + LONG + "</p></div>" + ARTICLE + "<form><p>Name <input></p><button>Send</button></form>"),
    page("<nav><ul><li><a href=x>open menu" + ARTICLE),  # a menu that is never closed
    page("<div><div><div>" + ARTICLE + "</div></div></div>" + "<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div>"),
    page(ARTICLE.replace("<article>", "<main>").replace("</article>", "</main>")),
    page(ARTICLE.replace("<article>", '<div class="content">').replace("</article>", "</div>") + NAV),
])
def test_article_without_boilerplate(html):
    assert h.main_text(html) == EXPECTED


def test_blocks_references_and_white_space():
    html = page("<article><h1>A &amp; B &copy; &#233; &lt;x&gt;</h1><p>one\n  two\t<b>three</b><i> four</i><br>five</p>"
                f"<p><b>open bold<br><p>{LONG}</p><ul><li>x y z</ul><table><tr><td>c1<td>c2</table></article>")
    assert h.main_text(html).split("\n") == ["A & B © é <x>", "one two three four five", "open bold", LONG.strip(), "x y z", "c1", "c2"]


def test_short_heading_beside_a_dense_paragraph_stays():
    for tag in ("article", "div"):
        html = page(f"<{tag}><h1>Hi</h1><p><b>{LONG}<br><p>{LONG}</p><h2>End</h2></{tag}>" + NAV)
        assert h.main_text(html).split("\n") == ["Hi", LONG.strip(), LONG.strip(), "End"]


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<p>", ""), ("   ", ""), ("plain  text", "plain text"), ("<!-- only -->", ""),
    ("<p>one<p>two", "one\ntwo"), ("<script>x</script>", ""), ("</div></p>x", "x"), ("<nav><a href=x>menu</a></nav>", ""),
])
def test_odd_pages(html, text):
    assert h.main_text(html) == text


def test_deep_and_long_pages_are_linear():
    deep = "<div>" * 20_000 + "<p>" + LONG + "</p>" + "</div>" * 20_000
    assert h.main_text(deep) == LONG.strip()
    assert h.main_text("<b>" * 20_000 + LONG) == LONG.strip()
    many = "".join(f"<p>{LONG}</p>" for _ in range(5_000))
    assert h.main_text(page(f"<article>{many}</article>")).count("\n") == 4_999
    assert h.main_text("<" * 20_000) is not None


def test_pages_table(spark):
    rows = [(1, "u", page(NAV + ARTICLE), "x"), (1, "u", page(NAV + ARTICLE), "x"), (2, None, None, "y"), (None, "v", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(map(tuple, h.extract(pages).collect()), key=str)
    assert out == sorted([(1, "u", EXPECTED, len(EXPECTED))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert h.extract(pages.limit(0)).count() == 0


BODY = ARTICLE.removeprefix("<article>").removesuffix("</article>")
SIDEBAR = f'<div class="{{}}"><p>{LONG}</p></div>'


@pytest.mark.parametrize("html", [
    page(NAV + f'<main class="content no-sidebar">{BODY}</main>'),
    page(NAV + f'<main class="content no-sidebar">{ARTICLE}</main>'),
    page(NAV + f'<article class="post has-comments">{BODY}</article>'),
    page(NAV + f'<article id="cookie-recipes">{BODY}</article>'),
    page(NAV + f'<div class="entry with-sidebar">{BODY}</div>'),
    page(NAV + f'<section id="search-results">{BODY}</section>'),
    page(NAV + f'<section id="search-results">{ARTICLE}</section>'),
    page(f'<div class="layout left-sidebar">{ARTICLE}' + SIDEBAR.format("sidebar") + "</div>"),
    *[page(ARTICLE + SIDEBAR.format(name)) for name in ("site-footer", "sidebar-left", "post-comments", "related posts", "ad_300")],
    page(ARTICLE + '<div class="comments"><p>' + LONG * 30 + "</p></div>"),
    page(f"<div>{BODY}</div>" + '<div class="comments"><p>' + LONG * 30 + "</p></div>"),
])
def test_names_of_containers(html):
    assert h.main_text(html) == EXPECTED


SHORT = "A short closing part."


@pytest.mark.parametrize(("body", "lines"), [
    (f"<div><section><p>{LONG}</p><p>{LONG}</p></section><section><h2>More</h2><p>{SHORT}</p></section></div>", [LONG.strip(), LONG.strip(), "More", SHORT]),
    (f"<article><p>{LONG}</p><p>{LONG}</p></article><article><p>{SHORT}</p></article>", [LONG.strip(), LONG.strip(), SHORT]),
    (f'<div class="content"><header><h1>A title</h1></header><p>{LONG}</p><p>{LONG}</p></div>', ["A title", LONG.strip(), LONG.strip()]),
    (f"<article><p>{LONG}</p><form><p>Write your name here please <input></p></form><p>{LONG}</p></article>", [LONG.strip(), LONG.strip()]),
    (f"<form id=aspnet><div><p>{LONG}</p><p>{LONG}</p></div></form>", [LONG.strip(), LONG.strip()]),
    (f"<div><div><a href=1>Home page</a> | <a href=2>All the news</a></div><p>{LONG}</p><p>{LONG}</p></div>", [LONG.strip(), LONG.strip()]),
    (f"<article><p>{LONG}</p><p><a href=1>One source</a></p><p>See <a href=2>this</a> and <a href=3>that</a></p></article>",
     [LONG.strip(), "One source", "See this and that"]),
])
def test_parts_of_the_article(body, lines):
    assert h.main_text(page(body)).split("\n") == lines


@pytest.mark.parametrize("name", ["commentlist", "post-comments-area", "userComments", "eu-cookie-law", "left-sidebar-wrapper", "CommentThread",
                                  "ad-box", "adBox", "site_sidebar_left", "newsletterForm"])
def test_compound_names_of_boilerplate(name):
    for attr in ("class", "id"):
        assert h.main_text(page(f'{ARTICLE}<div {attr}="{name}"><p>{LONG}</p></div>')) == EXPECTED
        assert h.main_text(page(f'<div {attr}="{name}"><p>{LONG}</p></div><div class="text">{ARTICLE}</div>')) == EXPECTED


@pytest.mark.parametrize("name", ["no-sidebar", "has-comments", "with-sidebar", "commentary", "market-share-report", "badge", "loading", "shadow-box"])
def test_other_names_stay(name):
    inner = ARTICLE.replace("<article>", "").replace("</article>", "")
    assert h.main_text(page(f'<div class="{name}">{inner}</div>')) == EXPECTED


def recursive_densities(node, share):
    """(density, sum over children, chars, link chars, tags, link tags) of a random tree (tag, parts), by recursion; page order."""
    out = []

    def walk(node, linked):
        place = len(out)
        out.append(None)
        tag, parts = node
        linked = linked or tag == "a"
        c = lc = t = lt = 0
        total = 0.0
        for part in parts:
            if isinstance(part, str):
                n = len("".join(part.split()))
                c += n
                lc += n * linked
            else:
                d, _, *below = walk(part, linked)
                total += d
                c, lc, t, lt = c + below[0], lc + below[1], t + below[2] + 1, lt + below[3] + (part[0] == "a")
        density = 0.0
        if c:
            base = max(math.log(c / max(c - lc, 1) * lc + share * c + math.e), 1.5)
            density = c / max(t, 1) * max(math.log(c * max(t, 1) / (max(lc, 1) * max(lt, 1))), 0.0 if lc else 0.1) / math.log(base)
        out[place] = (density, total, c, lc, t, lt)
        return out[place]

    walk(node, False)
    return out


def test_densities_match_a_recursive_version():
    rnd = random.Random(3)

    def tree(depth):
        tag = rnd.choice(["div", "section", "p", "b", "a", "ul"] if depth else ["div"])
        parts = [rnd.choice(["some words ", "x", LONG]) if depth == 4 or rnd.random() < 0.5 else tree(depth + 1) for _ in range(rnd.randint(1, 4))]
        return tag, [p for p in parts if isinstance(p, str) or tag not in ("p", "a") or p[0] == "b"]

    def html(node):
        return f"<{node[0]}>" + "".join(p if isinstance(p, str) else html(p) for p in node[1]) + f"</{node[0]}>"

    def flat(node, up=-1, out=None):
        out = [] if out is None else out
        place = len(out)
        out.append((node[0], up))
        for part in node[1]:
            if not isinstance(part, str):
                flat(part, place, out)
        return out

    checked = 0
    for _ in range(300):
        root = ("#root", [tree(0)])
        parsed = h._Page()
        parsed.feed(html(root[1][0]))
        parsed.close()
        parsed.finish()
        if list(zip(parsed.tag, parsed.parent, strict=True)) != flat(root):  # the parser closed a paragraph or link that holds a block
            continue
        whole = recursive_densities(root, 0.0)[0]
        want = recursive_densities(root, whole[3] / max(whole[2], 1))
        density, total = h._densities(parsed)
        assert density == pytest.approx([w[0] for w in want]) and total == pytest.approx([w[1] for w in want])
        checked += 1
    assert checked > 100
