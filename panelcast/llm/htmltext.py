"""Main text of a page by composite text density.

Every node of the page gets a link-adjusted number of characters per tag; a
node's density sum adds those of its children.  The node with the largest sum
is the core of the article; the least density on the path from the body to it
is the threshold.  Every node that reaches the threshold contributes the
subtree with the largest sum inside it.  A core that is a paragraph or part of
one stands for the article or block around it, whose short headings would miss
the threshold on their own.  Elements that are never article text
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
comments of readers) are left out by tag and name before densities are taken.
A class, id or role counts when its first or last word is one of boilerplate
(``cookie-notice``, ``site-footer``), or any word that speaks of nothing else
(``post-comments-area``, ``userComments``, ``commentlist``), unless it speaks of
the absence or presence of a part (``no-sidebar``, ``has-comments``).  ``article``
and ``main`` are never left out by name, and another element, like a form, not
if it holds more than half of the page's text outside links and no article or
main with text stands beside it; the densities decide there.  Comments of
readers stay out as long as other text is left.

Three rules complete the taken region: sections and articles beside the core's
own, under one parent, belong to it unless most of their text is links; a header
inside it that holds a heading is the article's, not the site's; and a block of
two links or more without any other word is a menu.

Spark spreads the pages; a page is parsed by the standard library's parser
into flat lists, without recursion, in time linear in its length.

Results for odd input: null or empty HTML gives an empty text; plain text
without tags is one block; unclosed and crossed tags are closed as browsers
do; ties go to the node that comes first; pages of any length are taken whole;
repeated rows give repeated results; an empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by role (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
            "td tfoot th thead title tr ul".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
             "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# A start tag on the left ends an open element on the right, unless one of the bounds lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
P_BOUNDS = {"td", "th", "table", "button", "object", "caption"}
NEVER = set("head script style noscript template nav footer aside button select textarea input label iframe object svg canvas "
            "dialog menu audio video".split())
# Words of class and id names of boilerplate.
SIDE = set("ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay "
           "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond replies share "
           "sharing social related recommended newsletter subscribe signup login search toolbar widget pagination pager skip".split())
# Those of them that mark boilerplate wherever they stand in a name.
STRONG = set("advert advertisement sponsored cookie cookies consent gdpr popup modal sidebar navbar navigation breadcrumb breadcrumbs "
             "comment comments disqus newsletter".split())
# Words that a word of boilerplate is written together with.
PARTS = "list area box section wrapper wrap container block body form thread bar panel".split()
TOGETHER = re.compile(f"({'|'.join(sorted(SIDE, key=len, reverse=True))})({'|'.join(PARTS)})")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
COMMENTS = set("comment comments disqus respond replies".split())
# Words of names that speak of a part elsewhere.
ABOUT = set("no not non without hide has have with".split())
# An article inside one of these is no part of it: they were left open.
LEFT_OPEN = set("nav header footer ul li a div form".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _side_words(attrs: list) -> set[str]:
    """The words of boilerplate that name an element."""
    found = set()
    for key, value in attrs:
        if key in ("class", "id", "role"):
            for name in (value or "").split():
                words = [w.lower() for w in WORD.findall(name)]
                words = [m[1] if (m := TOGETHER.fullmatch(w)) else w for w in words]
                if words and not ABOUT.intersection(words):
                    found.update(SIDE.intersection((words[0], words[-1])), STRONG.intersection(words))
    return found


class _Page(HTMLParser):
    """Flat lists of the page's nodes, in page order; index 0 is the root."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.out, self.linked = ["#root"], [-1], [False], [False]
        self.never, self.side = [False], [set()]  # left out by tag; words of boilerplate in its names, or "form"
        self.header, self.named = [False], [False]  # a header outside articles; left out by name
        self.text: list[tuple[int, str]] = []  # (node, text); a block's edges carry None
        self.open = [0]
        self.count = Counter(["#root"])

    def _close(self, names: set[str], bounds: set[str]) -> None:
        if not any(self.count[n] for n in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[k]]
            if name in names:
                while len(self.open) > k:
                    self._pop()
                return
            if name in bounds:
                return

    def _pop(self) -> None:
        node = self.open.pop()
        self.count[self.tag[node]] -= 1
        if self.tag[node] in BLOCK:
            self.text.append((node, None))

    def _leave_out(self, by_name: list[bool]) -> None:
        """Sets ``out``, given the nodes that their names leave out."""
        n = len(self.tag)
        held = [False] * n  # inside a left out element that was not merely left open
        self.out = [False] * n
        for k in range(1, n):
            up = self.parent[k]
            inside = self.out[up]
            if self.tag[k] in ("article", "main"):
                # an article is no part of a menu that was left open
                self.out[k] = inside and held[up]
            else:
                self.out[k] = inside or by_name[k] or self.never[k] or self.header[k]
            held[k] = held[up] or (self.out[k] and self.tag[k] not in LEFT_OPEN)

    def finish(self) -> None:
        """Closes what is open and decides which nodes are left out."""
        while len(self.open) > 1:
            self._pop()
        n = len(self.tag)
        named = [bool(w) for w in self.side]
        self.named = named
        if not any(named):
            self._leave_out(named)
            return
        self._leave_out([False] * n)
        size = [0] * n  # characters outside links
        for node, data in self.text:
            if data and not self.out[node] and not self.linked[node]:
                size[node] += sum(map(len, data.split()))
        for k in range(n - 1, 0, -1):
            size[self.parent[k]] += size[k]
        # articles with text: in the subtree of a node, above it, and on the page; those inside named elements apart
        below, above, under = [0] * n, [0] * n, [False] * n
        for k in range(1, n):
            up = self.parent[k]
            under[k] = under[up] or named[k]
            own = self.tag[k] in ("article", "main") and size[k] > 0 and not self.out[k] and not under[k]
            below[k] = int(own)
            above[k] = above[up] + own
        for k in range(n - 1, 0, -1):
            below[self.parent[k]] += below[k]
        for k in range(1, n):
            if named[k] and 2 * size[k] > size[0] and below[0] == below[k] + above[self.parent[k]]:
                named[k] = bool(COMMENTS & self.side[k]) and size[k] < size[0]
        self._leave_out(named)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P:
            self._close({"p"}, P_BOUNDS)
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag in BLOCK:
            self.text.append((self.open[-1], None))
        elif tag == "br":
            self.text.append((self.open[-1], " "))
        node = len(self.tag)
        self.never.append(tag in NEVER)
        self.header.append(tag == "header" and not (self.count["article"] or self.count["main"]))
        words = set() if tag in ("body", "html", "article", "main") else _side_words(attrs)
        self.side.append(words | {"form"} if tag == "form" else words)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.linked.append(tag == "a" or self.linked[self.open[-1]])
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML but void elements, which never open

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.count["p"]:
            self.text.append((self.open[-1], None))
        self._close({tag}, set() if tag in BLOCK else P_BOUNDS)

    def handle_data(self, data: str) -> None:
        self.text.append((self.open[-1], data))


def _densities(page: _Page) -> tuple[list[float], list[float]]:
    """Composite density of each node, and the sum over its children."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, data in page.text:
        if data and not page.out[node]:
            size = sum(map(len, data.split()))
            chars[node] += size
            link_chars[node] += size * page.linked[node]
    for k in range(n - 1, 0, -1):  # children come after their parents
        if not page.out[k]:
            up = page.parent[k]
            chars[up] += chars[k]
            link_chars[up] += link_chars[k]
            tags[up] += tags[k] + 1
            link_tags[up] += link_tags[k] + (page.tag[k] == "a")
    share = link_chars[0] / max(chars[0], 1)
    density, total = [0.0] * n, [0.0] * n
    for k in range(n):
        if chars[k] and not page.out[k]:
            c, t, lc, lt = chars[k], max(tags[k], 1), max(link_chars[k], 1), max(link_tags[k], 1)
            # the base of the logarithm grows with links; a page without links would make it 1, so it is held above
            base = max(log(c / max(c - link_chars[k], 1) * link_chars[k] + share * c + e), 1.5)
            # text without any link keeps some weight, however short it is
            density[k] = c / t * max(log(c * t / (lc * lt)), 0.0 if link_chars[k] else 0.1) / log(base)
            if k:
                total[page.parent[k]] += density[k]
    return density, total


def _around(page: _Page, core: int) -> int:
    """The article that holds the core, or else the nearest block around it that is no paragraph, below the body."""
    block, k = core, core
    while k > 0 and page.tag[k] not in ("body", "html"):
        if page.tag[k] in ("article", "main"):
            return k
        if page.tag[block] not in BLOCK or page.tag[block] == "p":
            block = k
        k = page.parent[k]
    return block


def _sizes(page: _Page) -> list[tuple[int, int]]:
    """Characters outside and inside links of every subtree."""
    n = len(page.tag)
    free, linked = [0] * n, [0] * n
    for node, data in page.text:
        if data and not page.out[node]:
            size = sum(map(len, data.split()))
            if page.linked[node]:
                linked[node] += size
            else:
                free[node] += size
    for k in range(n - 1, 0, -1):
        free[page.parent[k]] += free[k]
        linked[page.parent[k]] += linked[k]
    return list(zip(free, linked, strict=True))


def _beside(page: _Page, block: int, taken: list[bool], sizes: list[tuple[int, int]]) -> None:
    """Take the sections and articles beside the core's own, on every level up to the body, unless links outweigh their text."""
    path = {}
    k = block
    while k > 0 and page.tag[k] not in ("body", "html"):
        if page.tag[k] in ("section", "article"):
            path[page.parent[k]] = page.tag[k]
        k = page.parent[k]
    for k in range(1, len(page.tag)):
        if not page.out[k] and path.get(page.parent[k]) == page.tag[k] and sizes[k][0] > sizes[k][1]:
            taken[k] = True


def _own_headers(page: _Page, taken: list[bool]) -> None:
    """Headers with a heading inside the taken region are no longer left out."""
    heads, inside = set(), [0] * len(page.tag)
    for k in range(1, len(page.tag)):
        up = page.parent[k]
        inside[k] = k if page.header[k] and not page.never[k] and not page.named[k] and taken[up] and not page.out[up] else \
            inside[up] if inside[up] and not (page.never[k] or page.named[k]) else 0
        if page.tag[k] in HEADINGS:
            heads.add(inside[k])
    for k in range(1, len(page.tag)):
        if inside[k] in heads - {0}:
            page.out[k], taken[k] = False, True


def _menus(page: _Page, taken: list[bool]) -> None:
    """Blocks of two links or more without another word are taken back."""
    n = len(page.tag)
    words, linked, links = [0] * n, [0] * n, [0] * n
    for node, data in page.text:
        if data and not page.out[node]:
            size = sum(c.isalnum() for c in data)
            if page.linked[node]:
                linked[node] += size
            else:
                words[node] += size
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        words[up] += words[k]
        linked[up] += linked[k]
        links[up] += links[k] + (page.tag[k] == "a" and linked[k] > 0)
    gone = [False] * n
    for k in range(1, n):
        gone[k] = gone[page.parent[k]] or (page.tag[k] in BLOCK and page.tag[k] not in HEADINGS and links[k] > 1 and not words[k])
        if gone[k]:
            taken[k] = False


def main_text(html: str | None) -> str:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.finish()
    density, total = _densities(page)
    n = len(page.tag)
    alive = [k for k in range(n) if not page.out[k]]
    core = max(alive, key=lambda k: (total[k] or density[k], -k))
    least, k = density[core], core
    while k > 0 and page.tag[k] != "body":
        least = min(least, density[k])
        k = page.parent[k]
    # best[k]: the node with the largest sum in the subtree of k
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        if not page.out[k] and total[best[k]] >= total[best[up]] and (total[best[k]] > total[best[up]] or best[up] != up):
            best[up] = best[k]
    taken = [False] * n
    for k in alive:
        if density[k] >= least and density[k] > 0:
            taken[best[k]] = True
    block = _around(page, core)
    taken[block] = True
    _beside(page, block, taken, _sizes(page))
    for k in range(1, n):
        taken[k] = taken[k] or taken[page.parent[k]]
    _own_headers(page, taken)
    _menus(page, taken)
    blocks: list[str] = []
    now: list[str] = []
    for node, data in [*page.text, (0, None)]:
        if data is None:
            block = " ".join("".join(now).split())
            if block:
                blocks.append(block)
            now = []
        elif taken[node] and not page.out[node]:
            now.append(data)
    return "\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): one row per page."""
    slim = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column("__html")]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                  [id_col, url_col, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    return slim.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
