"""Main text of web pages by deducing the template of same-host pages.

Pages are dealt by host; a host with more pages than a task should take is dealt in parts by a hash of the page, so
what meets in a task depends on the table alone. They are read in groups of a few same-host pages, a short rest
with the group before it. In a group, tokens (tags with their class and id, words of short texts) that occur equally
often in each page share an occurrence vector and form an equivalence class. A class is valid if its tokens keep one
order in every page. The class that occurs once a page is the root template; another valid class, such as the row of
a list, nests in the template if all it holds stands in one slot of the root. Each text has a slot: its place in the
root and, within it, in the nested classes around it. Text that says the same in one slot of every page, or of every
occurrence of a nested class, is template too; a nested class whose slots hold links only is a menu. The main element
is the innermost element of the root template that holds most of the remaining text; what is left in its slots, without
menus, notices and the like, is the text. Names of elements and their marks (class, id, role) decide only where
structure can't: comments and adverts vary from page to page as the article does. An element that holds the article or,
on pages without an article element, most of the text never goes by its marks, and paragraphs, headings and list items
of an article go by marks of adverts only. Pages without two fellows fall back on their own elements.

Defined results: a null or empty page gives an empty text; unclosed and stray tags are tolerated; line breaks count
as white space; repeated rows give one result each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

GROUP_PAGES = 32
#: A host with more pages than PART_PAGES, and than one in HOT_HOSTS of all, is dealt in parts of about that size.
PART_PAGES, HOT_HOSTS = 256, 1 << 16
LEAST_PAGES = 3
#: Share of the text that the main element must hold.
MAIN_SHARE = 0.6
SHORT_WORDS = 12

# Element names by their role in HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "title", "noscript", "script", "style", "template", "textarea", "svg", "iframe", "object", "canvas"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
CLOSES_P = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote", "section", "article", "main", "aside", "nav", "header", "footer", "form", "pre", "dl", "hr", "figure"}

_token = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_attr = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
# Words that mark adverts, words that mark other parts beside an article, and words that stand with them.
ADVERT = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "promo", "sponsor", "sponsored"}
BESIDE = ADVERT | {"alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "subscribe", "toolbar", "topbar", "widget"}
NEUTRAL = {"area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "cta", "default", "fixed", "footer", "form", "global", "google", "group", "header", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "message", "mobile", "outer", "page", "panel", "policy", "post", "posts", "primary", "right", "secondary", "section", "site", "slot", "sticky", "text", "thread", "to", "top", "unit", "user", "wrap", "wrapper"}
PARTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "blockquote", "figure", "figcaption", "pre"}
#: Share of links in the text of a nested class from which it is a menu.
LINK_SHARE = 0.8
_part = re.compile(r"[a-z]+")


def _marked(marks: str, words: set[str]) -> bool:
    """Whether a class, id or role consists of listed words (at least one) and neutral ones."""
    for mark in marks.lower().replace("=", " ").split():
        parts = set(_part.findall(mark))
        if parts & words and parts <= words | NEUTRAL:
            return True
    return False


_spaces = re.compile(r"\s+")


class Node:
    """A piece of text with the elements around it and its place among the tokens."""

    __slots__ = ("block", "path", "place", "text")

    def __init__(self, text, path, block, place):
        self.text, self.path, self.block, self.place = text, path, block, place


class Page:
    def __init__(self, source: str):
        self.tokens: list[str] = []  #: tags and words of short texts, in page order
        self.nodes: list[Node] = []
        self.elements: list[tuple[str, str, int]] = []  #: name, signature, parent
        self.opened: list[int] = []  #: token number of each element's tag
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[int] = []
        at, block, raw = 0, 0, None
        for m in _token.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(source[at : m.start()], stack, block)
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                hit = next((k for k in range(len(stack) - 1, -1, -1) if self.elements[stack[k]][0] == name), None)
                if hit is not None:
                    del stack[hit:]
                self.tokens.append(f"</{name}>")
            else:
                if name in CLOSES_P:
                    hit = next((k for k in range(len(stack) - 1, -1, -1) if self.elements[stack[k]][0] not in INLINE), None)
                    if hit is not None and self.elements[stack[hit]][0] == "p":
                        del stack[hit:]
                elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    hit = next((k for k in range(len(stack) - 1, -1, -1) if self.elements[stack[k]][0] in (name, "ul", "ol", "dl", "table", "tr")), None)
                    if hit is not None and self.elements[stack[hit]][0] == name:
                        del stack[hit:]
                marks = " ".join(sorted(f"{a.lower()}={b or c or d}" for a, b, c, d in _attr.findall(m[3]))) if m[3] else ""
                self.opened.append(len(self.tokens))
                self.tokens.append(f"<{name} {marks}>" if marks else f"<{name}>")
                self.elements.append((name, marks, stack[-1] if stack else -1))
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    self.tokens.append(f"</{name}>")
                elif name not in VOID and not m[3].endswith("/"):
                    stack.append(len(self.elements) - 1)
            if name not in INLINE:
                block += 1
            elif name == "br":
                self.nodes.append(Node(" ", tuple(stack), block, len(self.tokens)))
        if at < len(source):
            self._text(source[at:], stack, block)

    def _text(self, text: str, stack: list[int], block: int) -> None:
        text = entities.unescape(text)
        self.nodes.append(Node(text, tuple(stack), block, len(self.tokens)))
        words = text.split(None, SHORT_WORDS + 1)
        if len(words) <= SHORT_WORDS:
            self.tokens += words

    def aside(self, element: int, inside: bool) -> bool:
        """Whether an element is beside the article by its name or marks; inside says that it lies in an article."""
        name, marks, _ = self.elements[element]
        if name in ASIDE:
            return True
        if not marks or name in ("html", "body", "article", "main", "header"):
            return False
        return _marked(marks, ADVERT if inside and name in PARTS else BESIDE)


def classes(pages: list[Page]) -> list[list[str]]:
    """Valid equivalence classes of tokens, the root template first."""
    vectors: dict[str, list[int]] = {}
    for k, page in enumerate(pages):
        for token, n in Counter(page.tokens).items():
            vectors.setdefault(token, [0] * len(pages))[k] = n
    groups: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for token, vector in vectors.items():
        if sum(n > 0 for n in vector) >= LEAST_PAGES:
            groups[tuple(vector)].add(token)
    found = []
    for vector, members in sorted(groups.items(), key=lambda x: (set(x[0]) != {1}, -len(x[1]), x[0])):
        orders = [[t for t in page.tokens if t in members] for page, n in zip(pages, vector, strict=True) if n]
        first = orders[0][: len(members)]
        if set(vector) == {1}:  # tokens that stand elsewhere in some page aren't the template's
            common = first
            for other in orders[1:]:
                place = {t: k for k, t in enumerate(other)}
                common = _rising(common, place)
            if common:
                found.append(common)
        elif len(members) > 1 and all(order == first * (len(order) // len(first)) for order in orders):
            found.append(first)
    return found


def _rising(tokens: list[str], place: dict[str, int]) -> list[str]:
    """The tokens in the longest chain that another page has in the same order."""
    from bisect import bisect_left

    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(tokens)
    for k, t in enumerate(tokens):
        at = bisect_left(tails, place[t])
        before[k] = ends[at - 1] if at else -1
        tails[at : at + 1] = [place[t]]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(tokens[k])
        k = before[k]
    return out[::-1]


class Template:
    """The root template of a group of pages and the valid classes that nest in one of its slots."""

    def __init__(self, pages: list[Page]):
        found = classes(pages) if len(pages) >= LEAST_PAGES else []
        whole = bool(found) and all(set(found[0]) <= set(p.tokens) for p in pages)
        self.root = {t: k + 1 for k, t in enumerate(found[0])} if whole else {}
        self.nested = self._nested(pages, found[1:]) if whole else {}
        self.slots = [self._slots(page) for page in pages]
        self.constant = self._constant(pages) if whole else set()
        self.menus = self._menus(pages) if self.nested else set()

    def _nested(self, pages: list[Page], others: list[list[str]]) -> dict[str, tuple[int, int, int]]:
        """Class, place in it and its length for each token of the classes that keep to one slot of the root."""
        place = {t: (c, k, len(own)) for c, own in enumerate(others) for k, t in enumerate(own)}
        held: dict[int, set[int]] = defaultdict(set)
        for page in pages:
            slot = 0
            for token in page.tokens:
                if token in self.root:
                    slot = self.root[token]
                elif token in place:
                    held[place[token][0]].add(slot)
        return {t: x for t, x in place.items() if len(held[x[0]]) == 1}

    def _slots(self, page: Page) -> list[tuple]:
        """The slot of each node: in the root, and in the nested classes that are open there."""
        at, slot, out = 0, 0, []
        inner: tuple[tuple[int, int], ...] = ()
        for node in page.nodes:
            while at < node.place:
                token = page.tokens[at]
                at += 1
                if token in self.root:
                    slot, inner = self.root[token], ()
                elif token in self.nested:
                    c, k, n = self.nested[token]
                    around = next((inner[:d] for d, (open_, _) in enumerate(inner) if open_ == c), inner)
                    inner = around if k == n - 1 else (*around, (c, k))
            out.append((slot, inner))
        return out

    def _constant(self, pages: list[Page]) -> set[tuple]:
        """Slot and text of what every page or every occurrence of a class has there; none where that is most of the text, as in copies of one page."""
        seen: Counter = Counter()
        texts: dict[tuple, set[str]] = defaultdict(set)
        held_by: dict[tuple, set[int]] = defaultdict(set)
        for k, (page, slots) in enumerate(zip(pages, self.slots, strict=True)):
            here = [(slot, node.text.strip()) for slot, node in zip(slots, page.nodes, strict=True) if node.text.strip()]
            seen.update({(slot[0], text) for slot, text in here})
            for slot, text in here:
                if slot[1]:
                    texts[slot].add(text)
                    held_by[slot].add(k)
        held = {x for x, n in seen.items() if n == len(pages)}
        held |= {(slot, *own) for slot, own in texts.items() if len(own) == 1 and len(held_by[slot]) >= LEAST_PAGES}
        most = sum(len(n.text) for p in pages for n in p.nodes) / len(pages)
        return held if sum(len(t) for _, t in held) < most / 2 else set()

    def _menus(self, pages: list[Page]) -> set[int]:
        """Nested classes that hold links only and less than half of the text."""
        size, links, total = Counter(), Counter(), 0
        for page, slots in zip(pages, self.slots, strict=True):
            for (_, inner), node in zip(slots, page.nodes, strict=True):
                n = len(node.text.strip())
                total += n
                linked = n and any(page.elements[e][0] == "a" for e in node.path)
                for c, _ in inner:
                    size[c] += n
                    links[c] += n if linked else 0
        return {c for c, n in size.items() if n and links[c] >= LINK_SHARE * n and 2 * n < total}

    def holds(self, slot: tuple, text: str) -> bool:
        """Whether a text is the template's and not the page's."""
        return (slot[0], text) in self.constant or (slot, text) in self.constant or any(c in self.menus for c, _ in slot[1])


def extract(pages: list[Page]) -> list[str]:
    """The text of each of the group's pages."""
    template = Template(pages)
    return [_page_text(page, slots, template) for page, slots in zip(pages, template.slots, strict=True)]


def _beside(page: Page) -> list[bool]:
    """For each element whether it, or one around it, is beside the article."""
    names = [name for name, _, _ in page.elements]
    size, article = [0] * len(names), [name in ("article", "main") for name in names]
    hidden, inside = [False] * len(names), [False] * len(names)
    for e, (name, _, up) in enumerate(page.elements):
        hidden[e] = name in ASIDE or up >= 0 and hidden[up]
        inside[e] = up >= 0 and (inside[up] or article[up])
    total = 0
    for node in page.nodes:
        n = len(node.text.strip())
        if n and not any(hidden[e] for e in node.path):
            total += n
            for e in node.path:
                size[e] += n
    for e in range(len(names) - 1, -1, -1):  # what holds an article counts as one
        if article[e] and page.elements[e][2] >= 0 and not hidden[e]:
            article[page.elements[e][2]] = True
    most = 0 if any(a and not h for a, h in zip(article, hidden, strict=True)) else 2
    out = [False] * len(names)
    for e, (name, _, up) in enumerate(page.elements):
        kept = name not in ASIDE and (article[e] or most * size[e] > total)
        out[e] = up >= 0 and out[up] or not kept and page.aside(e, inside[e])
    return out


def _page_text(page: Page, slots: list[tuple], template: Template) -> str:
    weight: Counter = Counter()
    total = 0
    kept = []
    beside = _beside(page)
    for node, slot in zip(page.nodes, slots, strict=True):
        if any(beside[e] for e in node.path):
            continue
        if not any(page.elements[e][0] in ("article", "main") for e in node.path) and template.holds(slot, node.text.strip()):
            continue
        kept.append(node)
        size = len(node.text.strip())
        total += size
        for e in node.path:
            weight[e] += size
    if not total:
        return ""
    root = template.root
    once = [e for e in weight if weight[e] >= MAIN_SHARE * total and (not root or page.tokens[page.opened[e]] in root or page.elements[e][0] in ("article", "main")) and page.elements[e][0] not in INLINE and page.elements[e][0] not in ("p", "li", "td")]
    named = [e for e in once if page.elements[e][0] in ("article", "main")]
    main = max(named or once, key=lambda e: (len(_up(page, e)), e), default=-1)
    parts = [n for n in kept if main < 0 or main in n.path]
    if main >= 0:  # an article's own heading may stand in a header
        parts = [n for n in parts if not any(page.elements[e][0] == "header" for e in n.path[n.path.index(main) :]) or any(page.elements[e][0] in ("h1", "h2", "h3") for e in n.path)]
    blocks = [_spaces.sub(" ", "".join(n.text for n in own)).strip() for _, own in groupby(parts, key=lambda n: n.block)]
    return "\n\n".join(b for b in blocks if b)


def _up(page: Page, element: int) -> list[int]:
    out = []
    while element >= 0:
        out.append(element)
        element = page.elements[element][2]
    return out


def _dealt(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows with the part of their host, a host's part in one task, in order.

    At most HOT_HOSTS hosts have more than one in HOT_HOSTS of all pages, which bounds what is broadcast."""
    counts = hosts.groupBy(F.xxhash64("host").alias("host_key")).agg(F.count("*").alias("n"))
    limit = F.greatest(F.lit(PART_PAGES), F.ceil(F.col("pages") / HOT_HOSTS))
    every = hosts.agg(F.count("*").alias("pages"))
    hot = counts.join(F.broadcast(every), F.col("n") > limit).select("host_key", F.ceil(F.col("n") / limit).alias("parts"))
    marked = rows.withColumn("host_key", F.xxhash64("host")).join(F.broadcast(hot), "host_key", "left")
    # the remainder takes other bits of the hash than the order within a part
    marked = marked.withColumn("part", F.coalesce(F.pmod(F.xxhash64("draw"), F.col("parts")), F.lit(0)))
    return marked.drop("host_key", "parts").repartition("host", "part").sortWithinPartitions("host", "part", "draw")


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group_pages: int = GROUP_PAGES) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host.alias("host"), F.xxhash64(id_col, url_col, html_col).alias("draw"))
    dealt = _dealt(rows, pages.select(host.alias("host")))

    def read(batches):
        held: list[tuple] = []

        def out(held):
            texts = extract([Page(h) for _, _, h in held])
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in held], ids), pa.array([u for _, u, _ in held], pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

        ids, host = None, None
        for batch in slices(batches, 256):
            ids = batch.column("page_id").type
            for i, u, h, *own in zip(*(batch.column(x).to_pylist() for x in ("page_id", "url", "html", "host", "part")), strict=True):
                if held and own != host:
                    yield out(held)
                    held = []
                elif len(held) >= group_pages + LEAST_PAGES:
                    yield out(held[:group_pages])
                    held = held[group_pages:]
                host = own
                held.append((i, u, h))
        if held:
            yield out(held)

    found = dealt.mapInArrow(read, f"page_id {kind}, url string, text string")
    return found.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
