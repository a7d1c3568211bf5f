"""Main-text extraction with a tree-structured graphical model.

A page is parsed into a tree of elements. Every element has one of three states: wrapper, content, boilerplate. Potentials
of parent and child tie states along the tree; potentials of an element's features (tag, tag under its parent's tag,
words of class, id and role, text length, share of link text, sentence marks) tie states to the page. Sum-product message
passing, upward from the leaves and downward from the root, gives every element's exact marginals. A piece of text is
kept if its element is content with a probability of at least KEEP.

Both kinds of potentials are fitted in closed form (smoothed relative frequencies) on labelled pages. A labelled page is
HTML whose elements carry data-label="w", "c" or "b"; elements without one take their parent's (wrapper passes on to
content for text elements only if marked). labelled_pages() makes them from a seed, in many layouts; other labelled pages
can be given to fit().

Nulls and edges: a null or empty page gives the empty text; broken markup (unclosed, crossed or cut tags, cut character
references) is read as browsers do, roughly; very deep or long pages need no recursion; rows are judged alone, so repeated rows need
nothing; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame

from .common import with_computed

STATES = "wcb"  # wrapper, content, boilerplate
KEEP = 0.5
#: Power of the features' potentials: features of one element repeat one another, so each counts for less than a whole.
FEATURE_POWER = 0.35
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|([^<]+|<)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-label|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select option button object audio video canvas".split())
#: Of RAW, those that go on to the end of the page without an end tag, as in browsers.
TO_END = frozenset("script style textarea title noscript template iframe".split())
#: What ends the skip of a RAW element; an option's end tag is optional, a button ends where another begins. Searched in the page itself, since lower case can be longer.
RAW_END = {t: re.compile({"option": r"<[a-zA-Z/!?]", "button": r"<(?:(/)|)button"}.get(t, "<(/)" + t), re.I | re.A) for t in RAW}
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("dd dt li td th tr tbody thead tfoot caption legend summary body html".split()) | {"hr"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th")}
STOPS = frozenset("ul ol dl table body html div section article".split())


class Page:
    """Elements in document order (parents first) and runs: pieces of text (element, text) that form one block."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names, self.label = ["#root"], [-1], [()], [None]
        self.text, self.link, self.marks = [0], [0], [0]
        self.runs: list[list[tuple[int, str]]] = [[]]
        self._read(source)

    def _element(self, tag: str, parent: int, attributes: str) -> int:
        names, label = (), None
        if attributes and "=" in attributes or "hidden" in attributes:
            found = []
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), a or b or c
                if key == "data-label":
                    label = value
                elif key == "style":
                    if re.search(r"display\s*:\s*none", value):
                        found.append("hidden")
                elif key == "hidden":
                    found.append("hidden")
                else:
                    found += NAME_PART.findall(CAMEL.sub(" ", value).lower())
            names = tuple(dict.fromkeys(found))
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(names)
        self.label.append(label)
        self.text.append(0)
        self.link.append(0)
        self.marks.append(0)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, at, links, n = [(0, "#root")], 0, 0, len(source)
        unended: set[str] = set()
        while at < n:
            m = TOKEN.match(source, at)
            if m is None:  # an unfinished quote in a tag: the rest of the tag goes
                stop = source.find(">", at)
                at = n if stop < 0 else stop + 1
                continue
            at = m.end()
            closing, tag, attributes, text = m.groups()
            if text is not None:
                if "&" in text:
                    text = html.unescape(text)
                element = stack[-1][0]
                self.runs[-1].append((element, text))
                words = len(text.split())
                self.text[element] += words
                self.marks[element] += text.count(".") + text.count(",")
                if links:
                    self.link[element] += words
                continue
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                if tag in BLOCK or tag == "a" or any(tag == t for _, t in stack[-8:]):
                    self._close(stack, tag)
                    if tag in BLOCK and self.runs[-1]:
                        self.runs.append([])
                if tag == "a" and links:
                    links -= 1
                continue
            if tag in RAW:
                if attributes.endswith("/") and tag != "script":
                    continue
                end = None if tag in unended else RAW_END[tag].search(source, at)
                if tag == "option":
                    at = end.start() if end else n
                elif end and end[1]:
                    at = source.find(">", end.start()) + 1 or n
                elif tag in TO_END:
                    at = n
                elif not end:
                    unended.add(tag)  # only the tag goes
                continue
            if tag == "br" or tag == "hr" or tag in VOID:
                if tag == "hr" and self.runs[-1]:
                    self.runs.append([])
                elif tag == "br":
                    self.runs[-1].append((stack[-1][0], " "))
                continue
            if tag in CLOSES_P and any(t == "p" for _, t in stack):
                self._close(stack, "p")
            for other in SIBLINGS.get(tag, ()):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] == other:
                        del stack[k:]
                        break
                    if stack[k][1] in STOPS:
                        break
            if tag in BLOCK:
                if self.runs[-1]:
                    self.runs.append([])
                stack.append((self._element(tag, stack[-1][0], attributes), tag))
            elif attributes and re.search(r"\b(?:class|id|role|hidden|style|data-label)\b", attributes):
                stack.append((self._element(tag, stack[-1][0], attributes), tag))
            elif tag not in ("head", "meta"):
                stack.append((stack[-1][0], tag))
            if tag == "a":
                links += 1

    @staticmethod
    def _close(stack: list[tuple[int, str]], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][1] == tag:
                del stack[k:]
                return
            if stack[k][1] in ("table", "body") and tag not in ("html", "body"):
                return

    def features(self) -> list[list[str]]:
        """Of each element; text counts what lies anywhere below."""
        text, link, marks = self.text[:], self.link[:], self.marks[:]
        for i in range(len(text) - 1, 0, -1):
            p = self.parent[i]
            text[p] += text[i]
            link[p] += link[i]
            marks[p] += marks[i]
        out = []
        for i, tag in enumerate(self.tag):
            n = text[i]
            own = [f"t:{tag}", f"p:{self.tag[self.parent[i]] if i else ''}>{tag}"]
            own += [f"n:{x}" for x in self.names[i]]
            own.append(f"l:{min(6, n.bit_length())}")
            if n:
                own += [f"a:{4 * link[i] // n}", f"m:{min(3, 12 * marks[i] // n)}"]
            out.append(own)
        return out


class Potentials:
    """Log potentials: start by state, edge[parent][child], and by feature the three states'."""

    def __init__(self, start: list[float], edge: list[list[float]], feature: dict[str, tuple[float, float, float]]):
        self.start, self.edge, self.feature = start, edge, feature
        self.edge_p = [[math.exp(x) for x in row] for row in edge]

    def content(self, page: Page) -> list[float]:
        """The marginal probability of content of every element."""
        n, parent, known, e = len(page.tag), page.parent, self.feature, self.edge_p
        local = []
        for own in page.features():
            a = b = c = 0.0
            for f in own:
                if (x := known.get(f)) is not None:
                    a, b, c = a + x[0], b + x[1], c + x[2]
            top = max(a, b, c)
            local.append([math.exp(a - top), math.exp(b - top), math.exp(c - top)])
        up: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * n  # message of each element to its parent
        belief = [x[:] for x in local]
        for i in range(n - 1, 0, -1):  # upward: children come after their parents
            a, b, c = belief[i]
            m = [r[0] * a + r[1] * b + r[2] * c for r in e]
            s = m[0] + m[1] + m[2]
            up[i] = (m[0] / s, m[1] / s, m[2] / s)
            to = belief[parent[i]]
            to[0] *= up[i][0]
            to[1] *= up[i][1]
            to[2] *= up[i][2]
            s = to[0] + to[1] + to[2]
            if s < 1e-200:
                s = s or 1e-300
                to[0], to[1], to[2] = to[0] / s, to[1] / s, to[2] / s
        belief[0] = [x * math.exp(y) for x, y in zip(belief[0], self.start)]
        out = [0.0] * n
        s = sum(belief[0])
        belief[0] = [x / s for x in belief[0]]
        out[0] = belief[0][1]
        for i in range(1, n):  # downward: the parent's belief without this element's own message
            to, mine = belief[parent[i]], up[i]
            a, b, c = (to[k] / max(mine[k], 1e-300) for k in range(3))
            own = belief[i]
            x = [own[k] * (a * e[0][k] + b * e[1][k] + c * e[2][k]) for k in range(3)]
            s = x[0] + x[1] + x[2] or 1e-300
            belief[i] = [x[0] / s, x[1] / s, x[2] / s]
            out[i] = belief[i][1]
        return out


def fit(pages: Iterable[str], smooth: float = 0.3, power: float = FEATURE_POWER) -> Potentials:
    """From labelled pages."""
    states, edges, counts = Counter(), Counter(), Counter()
    for source in pages:
        page = Page(source)
        label: list[int] = []
        for i, own in enumerate(page.features()):
            mark = page.label[i]
            label.append(STATES.index(mark) if mark else (label[page.parent[i]] if i else 0))
            states[label[i]] += 1
            if i:
                edges[label[page.parent[i]], label[i]] += 1
            for f in set(own):
                counts[f, label[i]] += 1
    total = sum(states.values())
    start = [math.log((states[s] + smooth) / (total + 3 * smooth)) for s in range(3)]
    edge = [[math.log((edges[p, c] + smooth) / (sum(edges[p, x] for x in range(3)) + 3 * smooth)) for c in range(3)] for p in range(3)]
    feature = {f: tuple(power * math.log((counts[f, s] + smooth) / (states[s] + 6 * smooth)) for s in range(3)) for f in {f for f, _ in counts}}
    return Potentials(start, edge, feature)


#: Names of class and id by what they mark, for the labelled pages.
CONTENT_NAMES = ("content", "main", "article", "post", "entry", "entry-content", "post-body", "article-body", "story", "text", "page-content", "blog-post", "main-content", "article__body")
BOILER_NAMES = {
    "nav": ("nav", "menu", "main-menu", "navbar", "navigation", "breadcrumbs", "breadcrumb", "pagination", "pager", "toc-links", "topnav", "site-nav"),
    "header": ("header", "site-header", "masthead", "top-bar", "banner", "branding", "page-head"),
    "footer": ("footer", "site-footer", "copyright", "colophon", "bottom", "legal"),
    "side": ("sidebar", "side", "widget", "widget-area", "related", "related-posts", "recommended", "popular", "tags", "tag-list", "trending", "more-stories", "author-bio"),
    "ad": ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner-ad", "adbox", "sponsor"),
    "notice": ("cookie", "cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "paywall", "disclaimer"),
    "social": ("share", "social", "sharing", "share-buttons", "follow-us", "social-links"),
    "comments": ("comments", "comment", "comment-list", "disqus", "replies", "discussion", "reader-comments", "comment-body", "responses", "commentlist"),
    "form": ("search-form", "login", "contact-form", "search", "search-box", "form"),
}


def labelled_pages(n: int = 1500, seed: int = 7) -> list[str]:
    """Pages in random layouts with the label of every part."""
    rng = random.Random(seed)
    vowels, others = "aeiou", "bcdfghjklmnprstvw"

    def words(a: int, b: int) -> str:
        out = []
        for _ in range(rng.randint(a, b)):
            w = "".join(rng.choice(others) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
            out.append(w + rng.choices(["", ",", "."], [16, 1, 2])[0])
        return " ".join(out)

    def attr(names: Iterable[str], p: float = 0.8) -> str:
        if rng.random() > p:
            return ""
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(tuple(names))}"'

    def paragraph(short: bool = False) -> str:
        body = words(1, 12) if short or rng.random() < 0.2 else words(15, 120)
        if rng.random() < 0.15:
            body += f' <a href="/x">{words(1, 4)}</a> ' + words(3, 20)
        if rng.random() < 0.15:
            body = f"<b>{body}" + rng.choice(["</b>", "<br>", ""])
        return f"<p>{body}" + ("</p>" if rng.random() < 0.8 else "")

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    def content() -> str:
        parts = [f"<h1>{words(3, 12)}</h1>"] if rng.random() < 0.85 else []
        if parts and rng.random() < 0.2:
            parts = [f'<header>{parts[0]}</header>']
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.72:
                parts.append(paragraph())
            elif kind < 0.80:
                parts.append(f"<h{(k := rng.randint(2, 4))}>{words(2, 8)}</h{k}>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{words(3, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.89:
                parts.append(f"<blockquote>{paragraph()}</blockquote>")
            elif kind < 0.92:
                parts.append(f"<table><tr><td>{words(1, 5)}<td>{words(1, 5)}</tr></table>")
            elif kind < 0.95:
                parts.append(f"<section>{paragraph()}{paragraph()}</section>" if rng.random() < 0.5 else f"<div>{words(10, 60)}</div>")
            elif kind < 0.97:
                parts.append(f"<figure><figcaption>{words(3, 12)}</figcaption></figure><pre>{words(5, 20)}</pre>")
            else:
                parts.append(boiler(rng.choice(("ad", "ad", "social", "side", "notice"))))
        return "".join(parts)

    def boiler(kind: str) -> str:
        names = BOILER_NAMES[kind]
        tag = {"nav": ("nav", "nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "footer", "div"), "side": ("aside", "aside", "div", "section"), "comments": ("section", "div", "ol"), "form": ("form", "form")}.get(kind, ("div", "aside", "section"))
        tag = rng.choice(tag)
        marked = tag in ("nav", "header", "footer", "aside", "form")
        if kind in ("nav", "social"):
            body = links(rng.randint(2, 9)) if tag == "ul" else f"<ul>{links(rng.randint(2, 9))}</ul>"
        elif kind == "header":
            body = f'<a href="/">{words(1, 4)}</a>' + rng.choice(["", f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>"])
        elif kind == "footer":
            body = rng.choice([f"&copy; {words(2, 15)}", f"<p>&copy; {words(2, 15)}</p><ul>{links(3)}</ul>", f"<p>{words(5, 40)}</p>"])
        elif kind == "comments":
            body = f"<h{(k := rng.randint(2, 4))}>{words(1, 3)}</h{k}>" + "".join(f'<div{attr(("comment", "reply", "comment-body"))}>{paragraph()}</div>' for _ in range(rng.randint(1, 5)))
            if tag == "ol":
                body = "".join(f'<li{attr(("comment", "reply"))}>{paragraph()}</li>' for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            body = f'<label>{words(1, 3)}</label><input name="q"><p>{words(2, 10)}</p>'
        elif kind == "side":
            body = f"<h3>{words(1, 4)}</h3><ul>{links(rng.randint(2, 6))}</ul>" if rng.random() < 0.6 else paragraph() + paragraph(True)
        else:
            body = rng.choice([words(3, 30), f"<p>{words(3, 40)}</p>", paragraph(), f'<a href="/ad">{words(2, 8)}</a>'])
        return f'<{tag}{attr(names, 0.6 if marked else 1.0)} data-label="b">{body}</{tag}>'

    out = []
    for _ in range(n):
        top = [boiler(k) for k in ("header", "nav", "ad", "notice", "form") if rng.random() < (0.7 if k == "nav" else 0.35)]
        rng.shuffle(top)
        end = [boiler(k) for k in ("side", "comments", "ad", "social", "notice", "nav", "form") if rng.random() < 0.3]
        rng.shuffle(end)
        end += [boiler("footer")] if rng.random() < 0.85 else []
        tag = rng.choice(("article", "article", "article", "main", "div", "div", "section", ""))
        if tag:
            body = f'<{tag}{attr(CONTENT_NAMES, 0.25 if tag in ("article", "main") else 0.95)} data-label="c">{content()}</{tag}>'
        else:  # paragraphs straight in their wrapper
            body = "".join(re.sub(r"^<(\w+)", r'<\1 data-label="c"', paragraph()) for _ in range(rng.randint(1, 8)))
        middle = body if rng.random() < 0.6 else f'<{(w := rng.choice(("div", "main", "section")))}{attr(("wrapper", "container", "page", "row", "layout", "site", "wrap"), 0.8)} data-label="w">{body}{"".join(end[:1])}</{w}>'
        close = "</body></html>" if rng.random() < 0.9 else ""
        out.append(f'<!DOCTYPE html><html data-label="w"><head><title>{words(2, 8)}</title><script>var t="</p>";</script></head><body data-label="w">{"".join(top)}{middle}{"".join(end)}{close}')
    return out


@functools.lru_cache(maxsize=1)
def default_potentials() -> Potentials:
    return fit(labelled_pages())


def extract_text(source: str | None, potentials: Potentials, keep: float = KEEP) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    content = potentials.content(page)
    blocks = (" ".join("".join(text for element, text in run if content[element] >= keep).split()) for run in page.runs)
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, potentials: Potentials | None = None, keep: float = KEEP) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, url, text, n_chars. The potentials are a few thousand numbers, whatever the input."""
    model = potentials or default_potentials()
    shared = pages.sparkSession.sparkContext.broadcast((model.start, model.edge, model.feature))

    def start():
        own = Potentials(*shared.value)

        def compute(sources: list[str | None]) -> tuple:
            texts = [extract_text(h, own, keep) for h in sources]
            return texts, list(map(len, texts))

        return compute

    rows = with_computed(pages.select("page_id", "url", "html"), ("html",), start, {"text": "string", "n_chars": "long"})
    return rows.select("page_id", "url", "text", "n_chars")
