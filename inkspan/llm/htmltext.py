"""Main text of HTML pages by tag-path ratios.

A page becomes a sequence of text nodes, each with its root-to-leaf path of
tags and classes.  For every path the text length and the punctuation marks are
added up and divided by its number of nodes.  Both series are smoothed over the
page with a Gaussian window and fused into one score; nodes at or above a share
of the score's deviation are selected, and with them their paths.

The selected nodes say which parts of the page are content: all outermost
article elements that hold some, else all main elements that do, else the
innermost element that holds nearly all of their weight (a path with many nodes
weighs more, so one advert doesn't stretch the region).  Of these parts all text
is kept, short lines and lists of links too, but for boilerplate that its markup
declares: elements that are by tag or role a menu, footer, sidebar, form or
notice, and elements that a class or id names as a whole (`related`, or
`cookie-notice`, not `related-work` or `with-sidebar`; never headings).  A name
is only a tie-break: it doesn't count where the named element holds most of the
selected text of its part (all of it, on a page without article and main, for
adverts, reader comments and cookie notices), nor the name of an element around the part, and where names would
leave nothing of a page without article and main they don't count at all.

Why not the ratio alone: an advert, notice or comment inside an article has the
ratio of its paragraphs, and a heading or short line has less.

Everything is linear in the page's length: paths are numbers, sums over
elements are added up from the last element to the first, and no tag is looked
for twice.

Edge cases: a null or empty html, and a page without text, give an empty text
and 0; broken markup (unclosed elements, comments, quotes) is read as far as it
goes; repeated rows each give a row; an empty table gives no rows; only the
key, url and html columns are read, so other columns can have any names.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Nodes whose score reaches this share of the scores' deviation are selected.
DEVIATIONS = 0.5
#: Without article and main, the part holds at least this share of the selected nodes' weight.
REGION_SHARE = 0.8
#: A named element that holds this share of its part's selected text is content all the same.
MOST = 0.5

# Element and class names of HTML pages.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "button", "object", "canvas", "audio", "video"}
DROPPED_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
DROPPED_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "sponsor", "sponsored", "sponsors", "promo", "promotion",
    "sidebar", "aside", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "notification", "alert", "banner", "newsletter", "subscribe", "subscription", "signup", "social", "share", "sharing",
    "breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "pagination", "pager", "footer", "masthead", "related", "recommended",
    "recommendations", "widget", "widgets", "popup", "modal", "overlay", "toolbar", "login", "search", "disclaimer",
}
#: Names that hold however long the element is, as long as its part has other text: adverts and comments can be longer than an article.
FIRM_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "sponsor", "sponsored", "sponsors", "comment", "comments", "commentlist", "disqus", "cookie", "cookies", "consent", "gdpr"}
#: Words that may stand beside the names in a class.
PARTS = {"site", "page", "post", "area", "box", "bar", "block", "container", "wrapper", "wrap", "inner", "section", "list", "item", "items", "links", "link", "buttons", "button", "top", "bottom", "left", "right", "main", "primary", "secondary", "text", "content", "body", "title"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: An opening tag ends these open elements first, up to the nearest of their containers.
P_ENDERS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "tbody", "div", "section", "article", "body", "html", "td", "th", "main", "aside", "nav", "form"}
PUNCTUATION = re.compile("[.,;:!?…。，、！？؛،]")

_STOP = re.compile("[>\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<=\s)(hidden)(?=[\s>/])", re.I)
_PART = re.compile(r"[_\-]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _named(tokens: list[str], kind: str) -> set[str]:
    """The names in class or id tokens that say boilerplate as a whole."""
    found = set()
    for token in tokens:
        words = {w for w in _PART.split(token) if w and not w.isdigit()}
        if words & DROPPED_NAMES and words <= (DROPPED_NAMES | PARTS if kind == "class" else DROPPED_NAMES):
            found |= words & DROPPED_NAMES
    return found


def _tags(page: str):
    """(start, end, closing, name, attributes) of every tag; of comments and declarations without name; each character is looked at a few times."""
    at, end = 0, len(page)
    gone = {'"': False, "'": False}  # quotes that don't come again
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at = end if close < 0 else close + 3
            yield start, at, False, "", ""
            continue
        if page.startswith(("<!", "<?"), start):
            close = page.find(">", start)
            at = end if close < 0 else close + 1
            yield start, at, False, "", ""
            continue
        closing = page.startswith("</", start)
        m = _NAME.match(page, start + 1 + closing)
        if m is None:
            at = start + 1
            continue
        first = at = m.end()
        plain = page.find(">", at)
        if plain < 0:
            return  # an unfinished tag: the rest is text
        while True:  # the first > outside quotes
            stop = _STOP.search(page, at)
            if stop is None:
                close = plain  # a quote runs to the page's end
                break
            close, mark = stop.start(), stop[0]
            if mark == ">":
                break
            if not page[max(first, close - 40) : close].rstrip().endswith("="):  # no value starts here
                at = close + 1
                continue
            other = -1 if gone[mark] else page.find(mark, close + 1)
            if other < 0:
                gone[mark] = True
                close = plain
                break
            at = other + 1
        at = close + 1
        yield start, at, closing, m[0].lower(), page[first:close]


class _Page:
    """Elements (tag, parent, path, what their markup says) and text nodes (element, text, starts a block); a parent has a lower number."""

    def __init__(self, page: str):
        self.tags, self.parents, self.paths, self.hard, self.soft, self.firm, self.main = ["#"], [-1], [0], [False], [False], [False], [False]
        self.known: dict[tuple[int, str], int] = {}
        self.texts: list[tuple[int, str, bool]] = []
        self.stack, self.open = [0], {}
        #: For each place of the stack the nearest place up to there that isn't an inline element.
        self.solid = [0]
        block, at, skip, end = True, 0, 0, len(page)
        for start, stop, closing, tag, attributes in _tags(page):
            if start < skip:
                continue
            if start > at:
                self.texts.append((self.stack[-1], page[at:start], block))
                block = False
            at = stop
            if not tag:
                continue
            if tag not in INLINE:
                block = True
            if closing:
                if self.open.get(tag):
                    k = len(self.stack) - 1
                    while self.tags[self.stack[k]] != tag:
                        k -= 1
                    self._cut(k)
                continue
            alone = attributes.endswith("/")
            if tag in RAW:
                if not alone:
                    m = _closing(tag).search(page, stop)
                    at = skip = m.end() if m else end
                continue
            if tag in VOID:
                continue
            self._end_implied(tag)
            if tag in ("html", "body", "head") and self.open.get(tag):
                continue
            if tag == "body":
                while len(self.stack) > 1 and self.tags[self.stack[-1]] == "head":
                    self._cut(len(self.stack) - 1)
            self._push(tag, attributes)
            if alone and tag not in INLINE and tag not in P_ENDERS:
                self._cut(len(self.stack) - 1)
        if at < end:
            self.texts.append((self.stack[-1], page[at:], block))

    def _cut(self, k: int) -> None:
        for x in self.stack[k:]:
            self.open[self.tags[x]] -= 1
        del self.stack[k:], self.solid[k:]

    def _end_implied(self, tag: str) -> None:
        if tag in P_ENDERS and self.open.get("p"):
            k = self.solid[-1]
            if self.tags[self.stack[k]] == "p":
                self._cut(k)
        if tag in SIBLINGS and any(self.open.get(x) for x in SIBLINGS[tag]):
            k = self.solid[-1]
            while k > 0:
                name = self.tags[self.stack[k]]
                if name in SIBLINGS[tag]:
                    self._cut(k)
                    if tag != "tr" or name == "tr":
                        break
                elif name in SCOPES and not (tag == "tr" and name in ("td", "th")):
                    break
                k = self.solid[k - 1]

    def _push(self, tag: str, attributes: str) -> None:
        above = self.stack[-1]
        hard = tag in DROPPED_TAGS or (tag == "header" and not self.open.get("article") and not self.open.get("main"))
        soft, firm, main, shown = False, False, tag == "main", tag
        if len(attributes) > 1:
            for m in _ATTRIBUTE.finditer(attributes + " "):
                if m[5]:
                    hard = True
                    continue
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    if tag not in HEADINGS and (names := _named(value.lower().split(), name)):
                        soft = True
                        firm |= bool(names & FIRM_NAMES)
                    if name == "class" and value:
                        shown = f"{tag}.{'.'.join(sorted(value.lower().split()))}"
                elif name == "role":
                    soft |= value.lower() in DROPPED_ROLES
                    main |= value.lower() == "main"
                elif (name == "style" and _HIDDEN.search(value)) or (name == "aria-hidden" and value.lower() == "true"):
                    hard = True
        self.tags.append(tag)
        self.parents.append(above)
        self.paths.append(self.known.setdefault((self.paths[above], shown), len(self.known) + 1))
        self.hard.append(hard and tag not in ("html", "body"))
        self.soft.append(soft and tag not in ("html", "body"))
        self.firm.append(firm)
        self.main.append(main)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.solid.append(self.solid[-1] if tag in INLINE else len(self.stack))
        self.stack.append(len(self.tags) - 1)

    def within(self, marked: list[bool]) -> list[bool]:
        """Which elements are marked or inside a marked one."""
        out = list(marked)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parents[i]]
        return out

    def summed(self, own: np.ndarray) -> np.ndarray:
        """What each element holds, with all that is inside it."""
        out = own.tolist()
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return np.array(out)


@lru_cache(maxsize=None)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I)


def _smoothed(x: np.ndarray) -> np.ndarray:
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2)
    return np.convolve(np.pad(x, 2, mode="edge"), kernel / kernel.sum(), mode="valid")


def path_ratios(paths: np.ndarray, lengths: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The fused score of each text node: mean length and mean punctuation of its path, both smoothed over the page."""
    n = np.bincount(paths)
    ratio = [_smoothed((np.bincount(paths, x) / np.maximum(n, 1))[paths]) for x in (lengths, marks)]
    return ratio[0] * (1 + ratio[1])


def selected(score: np.ndarray) -> np.ndarray:
    """The nodes whose score reaches the threshold."""
    return score >= min(DEVIATIONS * score.std(), score.max())


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    p = _Page(page)
    hard = p.within(p.hard)
    nodes = [(e, entities.unescape(raw) if "&" in raw else raw, block) for e, raw, block in p.texts if not hard[e]]
    full = [(e, t) for e, t, _ in nodes if not t.isspace()]
    if not full:
        return ""
    elements = np.array([e for e, _ in full])
    lengths = np.array([len(t.strip()) for _, t in full], float)
    paths = np.array(p.paths)[elements]
    score = path_ratios(paths, lengths, np.array([len(PUNCTUATION.findall(t)) for _, t in full], float))
    chosen = selected(score)
    parts = _parts(p, elements, lengths, paths, score, chosen)
    inside = p.within(parts)
    named = p.within(_declared(p, parts, inside, elements, lengths, chosen))
    keep = [i and not n for i, n in zip(inside, named, strict=True)]
    if not any(keep[e] for e, _ in full) and not any(p.main) and "article" not in p.tags:
        keep = inside
    out, gap = [], False
    for e, raw, block in p.texts:
        if hard[e] or not keep[e]:
            gap = True  # what is left out parts words like a block
            continue
        t = entities.unescape(raw) if "&" in raw else raw
        out.append(" " + t if block or gap else t)
        gap = False
    return " ".join("".join(out).split())


def _parts(p: _Page, elements: np.ndarray, lengths: np.ndarray, paths: np.ndarray, score: np.ndarray, chosen: np.ndarray) -> list[bool]:
    """The elements that are content: outermost articles with selected nodes, else mains, else what holds nearly all of their weight."""
    size = len(p.tags)
    held = p.summed(np.bincount(elements, chosen.astype(float), size))
    for wanted in ([t == "article" for t in p.tags], p.main):
        # names count for whole parts: a reader comment or teaser may be an article of its own
        found = [bool(w and held[i]) for i, w in enumerate(wanted)]
        plain = [f and not s for f, s in zip(found, p.within(p.soft), strict=True)]
        if any(plain):
            return plain
        outer = p.within(found)
        if sum(held[i] for i, f in enumerate(found) if f and not outer[p.parents[i]]) >= MOST * max(held[0], 1):
            return found
    times = np.bincount(paths)[paths]
    weight = p.summed(np.bincount(elements, chosen * lengths * score * np.log2(1 + times), size))
    part = max((i for i in range(size) if weight[i] >= REGION_SHARE * weight[0] and p.tags[i] not in INLINE), default=0)
    if p.tags[part] in ("p", "li", "td", "pre", "blockquote", *HEADINGS) and p.parents[part] > 0:
        part = p.parents[part]
    if any(p.main) or "article" in p.tags:  # then an advert or comment isn't the content, even if nothing else is left
        up = part
        while up > 0:
            if p.firm[up]:
                part = p.parents[up]
            up = p.parents[up]
    return [i == part for i in range(size)]


def _declared(p: _Page, parts: list[bool], inside: list[bool], elements: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> list[bool]:
    """Named elements inside a part that don't hold most of its selected text."""
    if not any(p.soft):
        return [False] * len(p.tags)
    held = p.summed(np.bincount(elements, chosen * lengths, len(p.tags)))
    marked = any(p.main) or "article" in p.tags
    part = [0] * len(p.tags)
    out = [False] * len(p.tags)
    for i in range(1, len(p.tags)):
        above = p.parents[i]
        part[i] = part[above] if inside[above] else i
        out[i] = p.soft[i] and inside[i] and not parts[i] and (held[i] < MOST * held[part[i]] or (p.firm[i] and (marked or held[i] < held[part[i]])))
    return out


def extract_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, text and n_chars (code points) of every page."""
    schema = T.StructType([pages.schema[key], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, "url", "text", "n_chars"])

    return pages.select(key, "url", "html").mapInArrow(run, schema)
