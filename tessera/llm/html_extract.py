"""Main text of HTML pages by a tree-structured graphical model.

A page is read into a tree of elements.  Each element has a hidden label, content or
not.  Potentials: one for every element's features (tag, words of class, id and role,
share of its text in links, length), and one for each parent-child pair of labels.
Sum-product messages run from the leaves up and from the root down and give every element's
exact marginal, in which the labelling without any content weighs EMPTY of what it would; the text of elements whose marginal is CONTENT or more is kept.

The potentials are log ratios counted (with smoothing) over labelled pages: ``training_pages``
makes them, varied in layout and wording, with the label of every element.  Elements that hold no
prose by their kind (HARD: forms, scripts and the like) are evidence: they and all below them are not content.  A form
around most of a page's text is a wrapper, not a form.

Edge cases: a null or empty page has an empty text; a page without markup is its text; unclosed and stray tags,
comments, cut-off markup and references, scripts and styles are read as browsers do;
repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CONTENT = 0.5
#: What the labelling without any content weighs against what its parts say: few pages have no article.
EMPTY = 0.15
TRAINING_PAGES = 600
SMOOTHING = 0.5
SEED = 5

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg".split())
CLOSES_P = BLOCK - frozenset("html head body title li dd dt td th tr option optgroup legend summary".split())
HARD = frozenset("head title script style noscript template textarea select option optgroup button datalist iframe object svg math audio video canvas map dialog".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 br b i em strong a span u code small sup sub blockquote ul ol pre figure table dl".split())
P_FENCES = "td th table article section div li body main aside nav form button".split()
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*?)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("tag", "words", "heads", "parts", "parent", "children", "label", "chars", "linked", "own")

    def __init__(self, tag: str, words: tuple = (), heads: tuple = (), parent: Element | None = None):
        self.tag, self.words, self.heads, self.parent = tag, words, heads, parent
        self.parts: list = []  # text and elements, in page order
        self.children: list[Element] = []
        self.label = None
        if parent is not None:
            parent.parts.append(self)
            parent.children.append(self)


def _attributes(raw: str) -> tuple[tuple, tuple, str | None]:
    """Words of the naming attributes, the last word of each name in them, and the label of a training page."""
    words, heads, label = [], [], None
    if "=" in raw:
        for name, a, b, c in _ATTR.findall(raw):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                for part in value.split():
                    if found := _WORD.findall(_CAMEL.sub(" ", part).lower()):
                        words += found
                        heads.append(found[-1])
            elif name == "data-label":
                label = value
    if "hidden" in raw and _HIDDEN.search(raw):
        words.append("hidden")
    return tuple(dict.fromkeys(words)), tuple(dict.fromkeys(heads)), label


class _Open:
    """The open elements, with the depths of each tag and of blocks, so that no tag looks through all of them."""

    def __init__(self, root: Element):
        self.path, self.depths, self.blocks = [root], {}, []

    def push(self, e: Element) -> None:
        self.depths.setdefault(e.tag, []).append(len(self.path))
        if e.tag in BLOCK:
            self.blocks.append(len(self.path))
        self.path.append(e)

    def cut(self, depth: int) -> None:
        while len(self.path) > depth:
            e = self.path.pop()
            self.depths[e.tag].pop()
            if e.tag in BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        """Depth of the innermost open element of one of the tags, 0 if there is none."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def before(self, tag: str) -> None:
        """Close what a start tag closes."""
        if tag in CLOSES_P:
            if (p := self.last(("p",))) > self.last(P_FENCES):
                self.cut(p)
        elif tag in SIBLINGS:
            if (d := self.last(SIBLINGS[tag])) > self.last(FENCES[tag]):
                # a row also closes the row that an open cell is in
                self.cut(d - 1 if tag == "tr" and self.path[d].tag != "tr" and self.path[d - 1].tag == "tr" else d)

    def end(self, tag: str) -> None:
        # an inline end tag doesn't close blocks
        if (d := self.last((tag,))) and (tag in BLOCK or tag in HARD or not self.blocks or self.blocks[-1] < d):
            self.cut(d)


def parse(page: str) -> Element:
    """The tree of a page, in time linear in its length."""
    root = Element("#page")
    open_, at, lower = _Open(root), 0, None
    n = len(page)
    while at < n:
        now = open_.path[-1]
        lt = page.find("<", at)
        if lt < 0:
            now.parts.append(page[at:])
            break
        if lt > at:
            now.parts.append(page[at:lt])
        m = _MARKUP.match(page, lt)
        if not m:
            now.parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if tag := m["tag"]:
            tag = tag.lower()
            open_.before(tag)
            words, heads, label = _attributes(m["attrs"] or "")
            e = Element(tag, words, heads, open_.path[-1])
            e.label = label
            if tag in RAW:
                if lower is None:
                    lower = page.lower() if len(page.lower()) == n else page
                end = lower.find(f"</{tag}", at)
                close = page.find(">", end) if end >= 0 else -1
                at = n if close < 0 else close + 1
            elif tag not in VOID and not (m["attrs"] or "").endswith("/") or tag in BLOCK and tag not in VOID:
                open_.push(e)
        elif end := m["end"]:
            open_.end(end.lower())
    return root


# ------------------------------------------------------------------- the model


def elements(root: Element) -> list[Element]:
    """Parents before children."""
    out = [root]
    for e in out:
        out.extend(e.children)
    return out


def _features(order: list[Element]) -> list[list[str]]:
    for e in reversed(order):
        e.own = sum(len(p) - p.count(" ") - p.count("\n") for p in e.parts if type(p) is str)
        e.chars = e.own + sum(c.chars for c in e.children)
        e.linked = e.chars if e.tag == "a" else sum(c.linked for c in e.children)
    out = []
    for e in order:
        f = [f"tag {e.tag}"]
        f += [f"word {w}" for w in e.words]
        f += [f"head {w}" for w in e.heads]
        f.append(f"size {min(6, e.chars.bit_length() // 2)}")
        f.append(f"links {4 * e.linked // e.chars if e.chars else 5}")
        if e.tag in ("#page", "html", "body", "div", "main", "form"):
            # whether it is around one thing, or holds text and paragraphs itself
            prose = e.own + sum(c.chars for c in e.children if c.tag in PROSE)
            f.append(f"{'page' if e.tag in ('#page', 'html') else e.tag} prose {4 * prose // e.chars if e.chars else 5}")
        out.append(f)
    return out


def _hard(order: list[Element]) -> set[int]:
    """The elements that can't be content, by id: parents stand before children."""
    found: set[int] = set()
    whole = order[0].chars
    for e in order:
        if e.tag in HARD or (e.tag == "form" and 2 * e.chars < whole) or (e.parent is not None and id(e.parent) in found):
            found.add(id(e))
    return found


class Model:
    """Log potentials: of each feature for content against not, and of labels of parent and child."""

    def __init__(self, pages: list[tuple[str, bool]]):
        has: tuple[Counter, Counter] = (Counter(), Counter())
        number, pairs = [0, 0], [[0.0, 0.0], [0.0, 0.0]]
        for page, bare in pages:
            order = elements(parse(page))
            labels, found = {}, _features(order)
            hard = _hard(order)
            for e, features in zip(order, found, strict=True):
                if id(e) in hard:
                    y = 0
                elif e.label is None:
                    y = labels[id(e.parent)] if e.parent is not None else int(bare)
                else:
                    y = int(e.label == "1")
                labels[id(e)] = y
                number[y] += 1
                has[y].update(set(features))
                if e.parent is not None:
                    pairs[labels[id(e.parent)]][y] += 1
        self.feature = {f: math.log((has[1][f] + SMOOTHING) / (number[1] + 2 * SMOOTHING)) - math.log((has[0][f] + SMOOTHING) / (number[0] + 2 * SMOOTHING)) for f in {*has[0], *has[1]}}
        self.pair = [[(pairs[a][b] + SMOOTHING) / (sum(pairs[a]) + 2 * SMOOTHING) for b in (0, 1)] for a in (0, 1)]
        # a child's features are judged given its share of all labels
        self.prior = [n / sum(number) for n in number]

    def marginals(self, root: Element) -> tuple[list[Element], list[float]]:
        """Every element's probability of being content: one pass up, one down."""
        order = elements(root)
        place = {id(e): i for i, e in enumerate(order)}
        own, features = [], _features(order)
        hard = _hard(order)
        for e, fs in zip(order, features, strict=True):
            s = max(-30.0, min(30.0, sum(self.feature.get(f, 0.0) for f in fs)))
            own.append((1.0, 0.0 if id(e) in hard else math.exp(s)))
        up: list[tuple[float, float]] = [(1.0, 1.0)] * len(order)  # message to the parent
        belief = [list(x) for x in own]
        p, none = self.pair, 1.0  # none: the share of the labelling without content
        for i in range(len(order) - 1, 0, -1):
            b0, b1 = belief[i]
            none *= p[0][0] * b0 / (p[0][0] * b0 + p[0][1] * b1)
            m0, m1 = p[0][0] * b0 + p[0][1] * b1, p[1][0] * b0 + p[1][1] * b1
            z = m0 + m1
            up[i] = m0, m1 = m0 / z, m1 / z
            parent = belief[place[id(order[i].parent)]]
            parent[0] *= m0
            parent[1] *= m1
            z = parent[0] + parent[1]
            parent[0] /= z
            parent[1] /= z
        none *= belief[0][0] / (belief[0][0] + belief[0][1])
        for i in range(1, len(order)):
            q0, q1 = belief[place[id(order[i].parent)]]  # all of the tree, seen from the parent
            q0, q1 = q0 / max(up[i][0], 1e-300), q1 / max(up[i][1], 1e-300)
            z = q0 + q1
            q0, q1 = q0 / z, q1 / z
            b0, b1 = belief[i][0] * (q0 * p[0][0] + q1 * p[1][0]), belief[i][1] * (q0 * p[0][1] + q1 * p[1][1])
            z = b0 + b1
            belief[i][0], belief[i][1] = b0 / z, b1 / z
        return order, [b[1] / (b[0] + b[1]) / (1 - none + EMPTY * none) for b in belief]

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        root = parse(page)
        order, share = self.marginals(root)
        keep = {id(e): s >= CONTENT for e, s in zip(order, share, strict=True)}
        blocks, now = [], []

        def end():
            if line := " ".join(html.unescape("".join(now)).split()):
                blocks.append(line)
            now.clear()

        # a stack of parts still to be read, so that deep pages need no recursion
        stack = [iter(root.parts)]
        open_ = [root]
        while stack:
            part = next(stack[-1], None)
            if part is None:
                stack.pop()
                if open_.pop().tag in BLOCK:
                    end()
            elif type(part) is str:
                if keep[id(open_[-1])]:
                    now.append(part)
            else:
                if part.tag in BLOCK:
                    end()
                elif part.tag == "br":
                    now.append(" ")
                stack.append(iter(part.parts))
                open_.append(part)
        end()
        return "\n".join(blocks)


# -------------------------------------------------------------- labelled pages

# Words that sites use for the parts of a page.
_NOT = {
    "nav": ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "topnav", "nav-links", "pagination", "toc"],
    "header": ["header", "site-header", "masthead", "top-bar", "banner", "branding"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom"],
    "aside": ["sidebar", "aside", "widget", "related", "related-posts", "recommended", "side-col", "popular"],
    "div": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "share", "social", "share-buttons", "comments", "comment-list", "comment", "disqus", "replies", "overlay", "toolbar", "skip-link", "login", "search"],
    "form": ["search-form", "login-form", "subscribe-form", "contact-form", "comment-form"],
    "section": ["comments", "related", "reader-comments", "newsletter", "user-comments", "responses"],
}
_IS = ["article", "post", "entry", "content", "main-content", "article-body", "post-content", "story", "text", "entry-content", "body-text"]


def training_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, bool]]:
    """Pages with data-label 1 (content) or 0 on elements; an element without has its parent's, and the page itself 1 if it is bare."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioustrnlmdhc") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    name = lambda names: r.choice(["", f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)} {word()}"'])

    def links():
        tag = r.choice(["ul", "ol", "div"])
        inner = "".join(r.choice(['<li><a href="/">{}</a></li>', '<a href="/">{}</a> ']).format(words(1, 3)) for _ in range(r.randint(2, 8)))
        return f"<{tag}>{inner}</{tag}>"

    def away():
        tag = r.choices(["nav", "header", "footer", "aside", "div", "form", "section"], [3, 2, 3, 2, 5, 1, 1])[0]
        names = _NOT[tag]
        kind = r.choice(names)
        if r.random() < 0.4:  # such as story-comments
            kind = f"{r.choice(_IS)}-{kind}"
        mark = f' class="{kind}"' if tag in ("div", "section") else name([*names, kind])
        inner = {
            "nav": links,
            "header": lambda: f"<h1>{words(1, 4)}</h1>" * r.randint(0, 1) + links() * r.randint(0, 1) + f"<p>{words(2, 9)}</p>" * r.randint(0, 1),
            "footer": lambda: f"&copy; {words(1, 12)}" + links() * r.randint(0, 1) + f"<p>{words(3, 20)}</p>" * r.randint(0, 1),
            "form": lambda: f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button><p>{words(1, 8)}</p>" + "<select><option>a<option>b</select><textarea>x</textarea>" * r.randint(0, 1),
        }.get(tag, lambda: r.choice([links, lambda: words(3, 30), lambda: f"<p>{words(3, 60)}</p>" * r.randint(1, 3), lambda: f"<h3>{words(1, 4)}</h3><ul>" + "".join(f"<li><b>{word()}</b> <p>{words(3, 40)}</p></li>" for _ in range(r.randint(1, 5))) + "</ul>"])())
        return f'<{tag} data-label="0"{mark}>{inner()}</{tag}>'

    def inline():
        t = words(3, 60)
        if r.random() < 0.4:
            t += f" <{(x := r.choice(['b', 'i', 'em', 'strong', 'span', 'code', 'u', 'small', 'sup']))}>{words(1, 6)}</{x}> {words(1, 20)}"
        if r.random() < 0.3:
            t += f' <a href="/{word()}">{words(1, 4)}</a> {words(2, 20)}'
        return t + "<br>" * (r.random() < 0.1)

    def block():
        kind = r.random()
        if kind < 0.65:
            return f"<p>{inline()}</p>" if r.random() < 0.8 else f"<p><b>{inline()}<br>"
        if kind < 0.75:
            return f"<h{(x := r.randint(2, 4))}>{words(1, 8)}</h{x}>"
        if kind < 0.83:
            return "<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote>{inline()}</blockquote>"
        if kind < 0.92:
            return "<table><tr>" + "".join(f"<td>{words(1, 5)}</td>" for _ in range(3)) + "</table>"
        if kind < 0.96:
            return f'<figure><img src="x"><figcaption>{words(2, 12)}</figcaption></figure>'
        return f"<div>{inline()}</div>" if r.random() < 0.5 else f"<pre>{inline()}</pre>"

    def page():
        if r.random() < 0.25:  # no wrapper: text and paragraphs in the body, or no tags around them at all
            text = "".join(block() for _ in range(r.randint(1, 12))) if r.random() < 0.6 else f"<br>{' ' * r.randint(0, 1)}".join(inline() for _ in range(r.randint(1, 6)))
            text = f"<h1>{words(1, 10)}</h1>" * (r.random() < 0.5) + text
            text = "".join(away() for _ in range(r.randint(0, 2))) + text + "".join(away() for _ in range(r.randint(0, 2)))
            if r.random() < 0.4:
                return text, True
            if r.random() < 0.5:
                text = f'<div data-label="1">{text}</div>'
                return (text if r.random() < 0.5 else f"<html><body>{text}</body></html>"), False
            return f'<html><head><title>{words(2, 9)}</title></head><body data-label="1">{text}</body></html>', False
        tag = r.choices(["article", "main", "div", "section"], [6, 2, 3, 1])[0]
        mark = name(_IS) if tag in ("article", "main") else f' class="{r.choice(_IS)}"'
        title = f"<h1>{words(1, 10)}</h1>" if r.random() < 0.9 else f"<header><h1>{words(1, 10)}</h1></header>"
        inside = [block() for _ in range(r.randint(1, 12))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            inside.insert(r.randint(0, len(inside)), away())
        body = f'<{tag} data-label="1"{mark}>{title}{"".join(inside)}</{tag}>'
        for _ in range(r.choice([0, 0, 1])):
            body = f'<{r.choice(["div", "main"])} class="{r.choice(["wrapper", "container", "page", "layout", "row", "site", word()])}">{body}{away() * r.randint(0, 1)}</div>'
        before = "".join(away() for _ in range(r.randint(0, 4)))
        after = "".join(away() for _ in range(r.randint(0, 4)))
        bare = f"<p>{words(3, 25)}</p>" * (r.random() < 0.1) + f"<span>{words(1, 5)}</span>" * (r.random() < 0.1)
        return f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{before}{body}{bare}{after}</body></html>", False

    return [page() for _ in range(n)]


@functools.cache
def model() -> Model:
    """Trained once in each Python worker, from the same pages."""
    return Model(training_pages())


def _extract(batches):
    m = model()
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            some = batch.slice(at, 128)
            texts = [m.text(p) for p in some.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*some.schema.names[1:], "text", "n_chars"])


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """pages: html and the columns of keep.  Adds text and n_chars; no shuffle."""
    common.ship_package(pages.sparkSession)
    keep = [c for c in keep if c.lower() not in ("text", "n_chars")]  # columns of those names are replaced
    narrow = pages.select(F.col("html").cast("string").alias("_whole_html"), *keep)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[1:])
    return narrow.mapInArrow(_extract, f"{kept}text string, n_chars long")
