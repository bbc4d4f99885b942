"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by their place, tags score negative, and
the contiguous region of the greatest sum is the content, found in one linear scan. A word's
place is the block it stands in: its kind (heading, paragraph, list item, other), its length,
its share of links, and whether it is inside the page's article (the largest article or main element
that is no teaser). All these weights come from labelled pages: a token's
share inside the labelled content, with one scale between words and tags chosen for the best token F1.

Elements that call themselves boilerplate (by tag, class, id or role) score negative too; what a name
weighs comes from labelled pages where ``MIN_PAGES`` pages of ``MIN_SITES`` sites show it, else from ``PRIOR``.
Nothing is dropped for its name outside the scan: before and after the content such an element is left
out because the region does not reach it. Inside the region a box (an element whose name says so strongly)
counts as little as a few words, however long it is, so that it cuts neither the lead before it nor the end
after it, and is then left out of the text. An element that holds the article, or nearly all running text, is no box.

``MAX_LABELLED`` bounds the labelled pages of a fit. The query fits to pages made by a rule (many layouts, none with telling
names) and to at most ``MAX_LABELLED`` pages of its own table, of at most ``MAX_HTML`` code points, that label themselves with one article element.

Defined cases: null html gives an empty text; pages without content words give an empty
text; cut-off tags at the end are dropped; unknown or badly nested tags are tags; repeated
rows are extracted each; other columns are ignored; an empty table gives none. Work is
linear in a page's length, however deep its elements are.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus

MAX_LABELLED = 500
MAX_HTML = 1 << 16
#: Pages and sites that must show a name before they decide what it weighs.
MIN_PAGES, MIN_SITES = 20, 5
SCALES = (0.25, 0.5, 1.0, 2.0, 4.0)
#: A name of less weight marks a box; an element with so much of a page's running text is none.
TELLING = -0.5
WRAPPER_SHARE = 0.9
#: An article element is a teaser if the rest of the page has more running text than this, and than three times its words.
TEASER_WORDS = 50
#: What a box costs at most, in words: inside the article, and elsewhere.
BOX_COST = (0.5, 3.0)

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^A-Za-z0-9_-]+")

RAW = frozenset({"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset({"br", "td", "th", "option", "img"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
CONTENT = frozenset({"article", "main"})
CLOSES_P = BLOCKS - {"html", "body"}
#: Fixed values, not fitted: what HTML and page authors call what is no content, before any page is seen. A word of weight 0 may stand beside them.
PRIOR = {
    **dict.fromkeys("tag:nav tag:aside tag:footer tag:header tag:form tag:menu tag:button tag:select tag:dialog tag:fieldset tag:label".split(), -1.0),
    **dict.fromkeys(
        "ad ads adv advert advertisement advertisements adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager paywall popup promo promoted promotion promotions rail related respond responses share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar complementary contentinfo".split(),
        -1.0,
    ),
    **dict.fromkeys("area bar block blocks bottom box btn button buttons column container desktop fixed form global group icon icons inner item items left link links list main mobile outer page panel post posts primary right row secondary section site slot top unit widget widgets wrap wrapper".split(), 0.0),
}


@lru_cache(maxsize=1 << 16)
def telling(token: str) -> tuple[str, float]:
    """A class, id or role as a name without numbers and single letters, and its prior weight: that of boilerplate only if every word of it is known."""
    words = [w.lower() for w in _WORDS.findall(token)]
    words = [w for w in words if len(w) > 1 and not w.isdigit()]
    weights = [PRIOR.get(w, 1.0) for w in words]
    return "-".join(words), -1.0 if weights and min(weights) < 0 and max(weights) <= 0 else 0.0


@lru_cache(maxsize=None)
def _raw_end(tag: str) -> re.Pattern:
    """The start of a raw element's end tag; tags are those of RAW."""
    return re.compile(f"</{tag}(?=[\\s/>])", re.I)


class Page:
    """A page's items, in order: (text or tag, value, element, block), and its elements in order of opening, from 0 for the page."""

    def __init__(self, page: str):
        self.items: list[tuple[str, str, int, int]] = []
        self.tags, self.parent, self.names, self.hidden = [""], [-1], [()], [False]
        self.words, self.block_kind, self.block_words, self.block_links = [0], ["none"], [0], [0]
        self._parse(page)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        found: list[str] = []
        hidden = False
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                found += value.split()
            elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
                hidden = True
        self.tags.append(tag)
        self.parent.append(parent)
        self.names.append(tuple(found))
        self.hidden.append(hidden)
        self.words.append(0)
        return len(self.tags) - 1

    def _parse(self, page: str) -> None:
        stack, opened, blocks = [0], Counter(), []
        links = 0
        last_end = page.rfind(">")

        def pop() -> str:
            nonlocal links
            name = self.tags[stack.pop()]
            opened[name] -= 1
            links -= name == "a"
            if name in BLOCKS:
                blocks.pop()
            return name

        def close_block() -> None:
            self.block_kind.append(blocks[-1] if blocks else "none")
            self.block_words.append(0)
            self.block_links.append(0)

        def text(a: int, b: int) -> None:
            if a < b:
                value = page[a:b]
                n = len(value.split())
                self.words[stack[-1]] += n
                self.block_words[-1] += n
                self.block_links[-1] += n * (links > 0)
                self.items.append(("text", value, stack[-1], len(self.block_kind) - 1))

        def tag_item(value: str) -> None:
            if value.lstrip("/") in BLOCKS:
                close_block()
            self.items.append(("tag", value, stack[-1], len(self.block_kind) - 1))

        at = start = 0
        while True:
            lt = page.find("<", at)
            if lt < 0:
                text(start, len(page))
                return
            after = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                text(start, lt)
                end = page.find("-->", lt + 4)
                at = start = len(page) if end < 0 else end + 3
                continue
            if after in ("!", "?"):
                text(start, lt)
                end = page.find(">", lt)
                at = start = len(page) if end < 0 else end + 1
                continue
            m = _TAG.match(page, lt) if lt < last_end else None
            if not m:
                if after.isalpha() and after.isascii() or after == "/" or not after:
                    text(start, lt)
                    end = page.find(">", lt) if lt < last_end else -1
                    at = start = len(page) if end < 0 else end + 1  # quotes that never close, or cut off
                    continue
                at = lt + 1
                continue
            text(start, lt)
            at = start = m.end()
            closing, tag, attributes = m[1], m[2].lower(), m[3]
            if closing:
                if opened[tag]:
                    while pop() != tag:
                        pass
                tag_item("/" + tag)
                continue
            if tag in RAW and not attributes.endswith("/"):
                end = _raw_end(tag).search(page, at)
                end = page.find(">", end.end()) if end else -1
                tag_item(tag)
                at = start = len(page) if end < 0 else end + 1
                continue
            if tag in CLOSES_P and blocks and blocks[-1] == "p":
                while pop() != "p":  # a block ends an open paragraph, unless another block stands between
                    pass
            if tag == "li" and self.tags[stack[-1]] == "li":
                pop()
            if tag not in VOID and not attributes.endswith("/"):
                parent = stack[-1]
                stack.append(self._open(tag, attributes, parent))
                opened[tag] += 1
                links += tag == "a"
                if tag in BLOCKS:
                    blocks.append(tag)
            tag_item(tag)

    def total_words(self) -> list[int]:
        """Words of each element with all that it holds."""
        out = list(self.words)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def named(self, e: int) -> list[str]:
        """What an element calls itself: its tag, and its names where it is no heading."""
        tag = self.tags[e]
        return [f"tag:{tag}"] + ([] if tag in HEADINGS or tag in ("html", "body") else list(self.names[e]))

    def weighed(self, names: dict[str, float]) -> list[float]:
        """The weight of each element's tag and names, the lowest of them; not above 0."""
        out = []
        for e in range(len(self.tags)):
            lowest = 0.0
            for x in self.named(e):
                name, prior = (x, PRIOR.get(x, 0.0)) if x.startswith("tag:") else telling(x)
                lowest = min(lowest, names.get(name, prior))
            out.append(lowest)
        return out

    def running(self, shut: list[bool]) -> list[int]:
        """Words of each element in blocks of ten words or more that are mostly no links, outside shut elements."""
        out = [0] * len(self.tags)
        for kind, value, e, b in self.items:
            if kind == "text" and not shut[e] and self.block_words[b] >= 10 and 2 * self.block_links[b] < self.block_words[b]:
                out[e] += len(value.split())
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def placed(self, names: dict[str, float]) -> list[tuple[str, int, float]]:
        """Of each item its place, the box it is in (0 for none) and the lowest weight of a name around it. Items that are hidden have the place ``hidden``."""
        n = len(self.tags)
        down = lambda own: [own[0]] + [False] * (n - 1)
        hidden = down([False])
        for e in range(1, n):
            hidden[e] = hidden[self.parent[e]] or self.hidden[e] or self.tags[e] == "head"
        own = self.weighed(names)
        # a header inside an article is part of it, unless its names say otherwise
        within = [False] * n
        for e in range(1, n):
            within[e] = within[self.parent[e]] or self.tags[e] in CONTENT
            if self.tags[e] == "header" and within[self.parent[e]]:
                own[e] = min([0.0, *(names.get(*telling(x)) if telling(x)[0] in names else telling(x)[1] for x in self.names[e])])
        shut = list(hidden)
        for e in range(1, n):
            shut[e] = hidden[e] or shut[self.parent[e]] or own[e] < TELLING
        # an article inside what calls itself boilerplate may be the article: names of wrappers mislead
        every, outside = self.running(hidden), self.running(shut)
        visible = every[0]
        total = self.total_words()
        articles = [e for e in range(1, n) if self.tags[e] in CONTENT and not hidden[e] and total[e] and outside[0] - outside[e] <= max(TEASER_WORDS, 3 * total[e])]
        beside = [False] * n  # inside an aside, nav or footer
        for e in range(1, n):
            beside[e] = beside[self.parent[e]] or self.tags[self.parent[e]] in ("aside", "nav", "footer")
        article = max((e for e in articles if not beside[e]), key=lambda e: (total[e], -e), default=0)
        holds = {article, *self._around(article)} if article else set()
        fixed = ("nav", "aside", "footer", "menu", "button", "select", "dialog", "header")
        lowest, box, inside = [0.0] * n, [0] * n, [False] * n
        for e in range(1, n):
            p = self.parent[e]
            wraps = e in holds or self.tags[e] not in fixed and visible and every[e] >= WRAPPER_SHARE * visible
            mine = 0.0 if wraps else own[e]
            lowest[e] = min(lowest[p], mine)
            box[e] = box[p] or (e if mine < TELLING else 0)
            inside[e] = inside[p] or e == article
        out = []
        for kind, _, e, b in self.items:
            if hidden[e]:
                out.append(("hidden", 0, 0.0))
                continue
            side = "in" if inside[e] else "out" if article else "page"
            place = side
            if kind == "text":
                block = self.block_kind[b]
                block = "heading" if block in HEADINGS else block if block in ("p", "li", "none") else "block"
                size, link = self.block_words[b], self.block_links[b]
                length = 0 if size <= 3 else 1 if size <= 10 else 2 if size <= 25 else 3
                place = f"{side}:{block}:{length}:{0 if not link else 1 if 2 * link < size else 2}"
            out.append((place, box[e], lowest[e]))
        return out

    def _around(self, e: int) -> list[int]:
        out = []
        while (e := self.parent[e]) > 0:
            out.append(e)
        return out


class Event(NamedTuple):
    """A run of text or a tag of a page: its place, its box (0 for none) and the lowest weight of a name around it."""

    kind: str
    place: str
    value: str
    box: int = 0
    named: float = 0.0


def events(page: str, names: dict[str, float] | None = None) -> list[Event]:
    """A page's text runs and tags with where they stand. Raw elements are one tag."""
    parsed = Page(page)
    placed = parsed.placed(default_weights()["names"] if names is None else names)
    return [Event(kind, place, value, box, named) for (kind, value, _, _), (place, box, named) in zip(parsed.items, placed, strict=True)]


def scores(sequence: list[Event], weights: dict) -> list[float]:
    """What each event adds to a region that holds it; a box's cost stands at the first of its events in a row."""
    words, tags = weights["words"], weights["tags"]
    out: list[float] = []
    first, cost = -1, 0.0
    for i, (kind, place, value, box, named) in enumerate(sequence):
        if place == "hidden":
            out.append(0.0)
            continue
        if kind == "text":
            w = words.get(place)
            w = words.get(place.split(":", 1)[0], 0.5) if w is None else w
            x = len(value.split()) * max(-1.0, w + 2 * named)
        else:
            x = tags.get(value, weights["unknown"])
        if box:
            if first < 0 or sequence[first].box != box:
                first, cost = i, 0.0
            cost += min(0.0, x)
            out.append(0.0)
            out[first] = -min(-cost, BOX_COST[not place.startswith("in")])
        else:
            out.append(x)
    return out


def region(sequence: list[Event], weights: dict) -> tuple[int, int]:
    """The contiguous events of the greatest sum, as [start, end); empty where no sum is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores(sequence, weights)):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best and sequence[i].kind == "text":
            best, span = total, (start, i + 1)
    return span


def render(sequence: list[Event], boxes: bool = False) -> str:
    """Blocks of the text outside boxes (or with them), white space as one space, joined by newlines."""
    blocks, parts = [], []

    def flush() -> None:
        if parts:
            if s := " ".join(_html.unescape("".join(parts)).split()):
                blocks.append(s)
            parts.clear()

    for kind, place, value, box, _ in sequence:
        if kind == "text":
            if place != "hidden" and (boxes or not box):
                parts.append(value)
        else:
            tag = value.lstrip("/")
            if tag in BLOCKS:
                flush()
            elif tag in SPACED:
                parts.append(" ")
    flush()
    return "\n".join(blocks)


def extract(page: str | None, weights: dict | None = None) -> str:
    if not page:
        return ""
    weights = weights or default_weights()
    sequence = events(page, weights["names"])
    a, b = region(sequence, weights)
    return render(sequence[a:b])


def _content_items(page: Page, content: Counter) -> list[bool]:
    """Whether each item is a text run of the labelled content."""
    return [kind == "text" and bool(w := value.split()) and sum(x in content for x in w) * 2 > len(w) for kind, value, _, _ in page.items]


def _learnt_names(pages: list[Page], marks: list[list[bool]], sites: list[str | None]) -> dict[str, float]:
    """Weights of the names that enough pages of enough sites show; pages without a site tell nothing of names."""
    inside, every, shown, where = Counter(), Counter(), Counter(), {}
    for page, mark, site in zip(pages, marks, sites, strict=True):
        if site is None:
            continue
        own, good = [0] * len(page.tags), [0] * len(page.tags)
        for (kind, value, e, _), ok in zip(page.items, mark, strict=True):
            if kind == "text":
                n = len(value.split())
                own[e] += n
                good[e] += n * ok
        here = set()
        for e in range(len(own) - 1, 0, -1):
            own[page.parent[e]] += own[e]
            good[page.parent[e]] += good[e]
            for name in {telling(x)[0] for x in page.named(e)[1:]} - {""}:
                every[name] += own[e]
                inside[name] += good[e]
                here.add(name)
        shown.update(here)
        for name in here:
            where.setdefault(name, set()).add(site)
    return {x: _share(inside[x], n) for x, n in every.items() if shown[x] >= MIN_PAGES and len(where[x]) >= MIN_SITES}


def _share(some: float, every: float) -> float:
    return 2 * (some + 0.2) / (every + 0.4) - 1


def fit(labelled: list[tuple], scales: tuple[float, ...] = SCALES) -> dict:
    """Weights from (html, content text) or (html, content text, site) tuples."""
    pages = [Page(x[0]) for x in labelled]
    contents = [Counter(x[1].split()) for x in labelled]
    marks = [_content_items(page, content) for page, content in zip(pages, contents, strict=True)]
    names = _learnt_names(pages, marks, [x[2] if len(x) > 2 else None for x in labelled])
    word_in, word_all, tag_in, tag_all = Counter(), Counter(), Counter(), Counter()
    sequences = []
    for page, content, inside in zip(pages, contents, marks, strict=True):
        placed = page.placed(names)
        sequence = [Event(kind, place, value, box, named) for (kind, value, _, _), (place, box, named) in zip(page.items, placed, strict=True)]
        sequences.append((sequence, content))
        marked = [i for i, x in enumerate(inside) if x and not sequence[i].box]
        lo, hi = (marked[0], marked[-1]) if marked else (1, 0)
        for i, (kind, place, value, box, _) in enumerate(sequence):
            if place == "hidden" or box:
                continue
            if kind == "text":
                n = len(value.split())
                for p in (place, place.split(":", 1)[0]):
                    word_all[p] += n
                    word_in[p] += n * inside[i]
            else:
                tag_all[value] += 1
                tag_in[value] += lo <= i <= hi
    words = {p: _share(word_in[p], n) for p, n in word_all.items()}
    best = (-1.0, None)
    for scale in scales:
        tags = {t: -scale * (n - tag_in[t] + 0.1) / (n + 0.2) for t, n in tag_all.items()}
        weights = {"names": names, "words": words, "tags": tags, "unknown": -scale / 2}
        f = 0.0
        for sequence, content in sequences:
            a, b = region(sequence, weights)
            got = Counter(render(sequence[a:b]).split())
            common = sum((got & content).values())
            f += 2 * common / max(1, sum(got.values()) + sum(content.values()))
        if f > best[0]:
            best = (f, weights)
    return best[1]


def self_labelled(page: str) -> str | None:
    """The content of a page with one article element and no main element: that article without boxes known beforehand; None for other pages."""
    parsed = Page(page)
    found = [e for e, tag in enumerate(parsed.tags) if tag in CONTENT]
    if len(found) != 1 or parsed.hidden[found[0]] or any(parsed.weighed({})[e] < TELLING for e in parsed._around(found[0])):
        return None
    placed = parsed.placed({})
    return " ".join(_html.unescape(value) for (kind, value, _, _), (place, box, _) in zip(parsed.items, placed, strict=True) if kind == "text" and place.startswith("in") and not box)


def sampled(pages: DataFrame, most: int = MAX_LABELLED) -> list[tuple[str, str, str]]:
    """(html, content, site) of at most ``most`` pages that label themselves, the same ones at every run."""
    some = pages.where((F.char_length("html") <= MAX_HTML) & F.lower("html").contains("<article")).select("html", F.coalesce(F.regexp_extract("url", "//([^/?#:]+)", 1), F.lit("")).alias("site"))
    # a slice of the hashes that holds about twice as many, so that what tasks send does not follow their number
    share = min(1.0, 2 * most / max(1, pages.count()))
    some = some.withColumn("_h", F.xxhash64("html")).where(F.col("_h") <= min(2**63 - 1, int(share * 2**64) - 2**63))
    rows = some.orderBy("_h", "html").limit(most).collect()
    return [(r["html"], told, r["site"]) for r in rows if (told := self_labelled(r["html"])) is not None]


def labelled_pages(count: int = 240) -> list[tuple[str, str]]:
    """Pages made by a rule, with their content: layouts with and without an article element, boilerplate that its tag tells and that nothing tells."""
    syllables = ["ka", "lo", "mi", "ter", "sun", "ve", "dra", "pol", "ne", "shi"]
    wraps = ["<p>{}</p>", "<p>{}</p>", "<ul><li>{}</li></ul>", "<p>{}</p>", "<blockquote>{}</blockquote>", "<p>{}<br></p>", '<p>{} <a href="/x">see</a></p>', "<div>{}</div>", "<table><tr><td>{}</td></tr></table>"]
    out = []
    for k in range(count):
        word = lambda i: syllables[(i * 7 + k) % 10] + syllables[(i * 3 + k * 5) % 10] + syllables[i // 10 % 10]  # noqa: B023, E731
        line = lambda a, n: " ".join(word(a + i) for i in range(n))
        other = lambda a, n: " ".join("x" + word(a + i) for i in range(n))
        links = lambda n: "".join(f'<li><a href="/{i}">{other(i, 1 + (i + k) % 3)}</a></li>' for i in range(n))  # noqa: B023, E731
        paragraphs = [line(100 * j + 7, 2 + (j * 17 + k * 5) % 60) for j in range(2 + k % 6)]
        title = line(3, 2 + k % 7)
        body = f"<h1>{title}</h1>" + "".join((f"<h2>{line(j, 2)}</h2>" if j == 3 else "") + wraps[(k + j) % 9].format(p).replace(">see<", f">{line(j + 1, 1)}<") for j, p in enumerate(paragraphs))
        told = "\n".join([title, *[x for j, p in enumerate(paragraphs) for x in ([line(j, 2)] if j == 3 else []) + [p, line(j + 1, 1)]]])
        shell = ("<article>{}</article>", "<main>{}</main>", '<div><div>{}</div></div>', "<div>{}</div>", "<section>{}</section>", "<td>{}</td>")[k % 6]
        tag = ("nav", "aside", "footer", "header", "form", "menu")[k % 6]
        if k % 2:  # tags tell
            top = f"<nav><ul>{links(4 + k % 6)}</ul></nav><{tag}><p>{other(900, 9)}</p></{tag}>"
            side = f"<aside><p>{other(950, 6 + k % 30)}</p></aside>"
            inner = f"<aside>{other(960, 12)}</aside>" if k % 4 == 1 else ""
            body = body.replace("</h1>", f"</h1>{inner}", 1)
            end = f"<aside><p>{other(800, 14 + k % 40)}</p></aside><footer><p>{other(700, 8)}</p></footer>"
        else:  # none: lists of links, short blocks, rows of links
            top = f'<div><a href="/">{other(1, 2)}</a></div><div><ul>{links(5 + k % 8)}</ul></div><div>{other(20, 1 + k % 3)}</div>'
            side = f'<div><h3>{other(30, 2)}</h3><ul>{links(4 + k % 5)}</ul></div>' if k % 3 else ""
            row = " | ".join(f'<a href="/{i}">{other(40 + i, 1)}</a>' for i in range(4 + k % 4))
            end = f'<div><ul>{links(6)}</ul></div><div>{row}</div><div>{other(60, 2 + k % 6)}</div>'
        if shell.startswith("<main") and k % 4 == 1:  # a main element that holds more than the content
            body, side, end = f"<div><ul>{links(5)}</ul></div>{body}<div><ul>{links(4 + k % 9)}</ul></div>", "", ""
        page = f"<html><head><title>{title}</title></head><body>{top}{side}{shell.format(body)}{end}</body></html>"
        out.append((page, told))
    return out


@lru_cache(maxsize=1)
def default_weights() -> dict:
    return fit(labelled_pages())


def extract_pages(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """page_id, url, text of every page."""
    chosen = weights or default_weights()

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py(), chosen) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    corpus.small_batches(pages.sparkSession)
    source = pages.select("page_id", "url", "html")
    return source.mapInArrow(corpus.trimmed(run), f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = extract_pages(pages, fit(labelled_pages() + sampled(pages)))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
