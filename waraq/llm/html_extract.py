"""Main text of web pages by equivalence-class template deduction.

Tokens are elements, told apart by their role (the names of the elements around, and the place among siblings of the
same name), and texts under a path of names. Over the pages of one host, tokens with the same occurrence vector form an
equivalence class. A class is valid if it covers at least half of the host's pages, if all places of a name under one
parent are in one class (else their number varies, and they are a set inside their parent's slot), and if the parents of its elements are
in valid classes too. So valid classes nest, from the root class down, into the host's template; the text under an
element of the template, outside the elements nested in it, is a slot. A text whose vector is that of a valid class
belongs to the template itself.

The article is found among the slots: from the root of the template the way goes to the nested element that holds most
of the prose, as long as one does. Prose is text outside links. Names of elements and classes are features of a slot:
text under names of menus, notices, forms and comments is no prose, and text under article or main counts more. A page
alone on its host, or without the host's article element, is its own template.

Occurrence vectors are never gathered: a vector is the sum of a hash of (page, count) over the pages, which partial
aggregation forms beside the data, so a host with a third of all pages is no larger a row than any other. What is
gathered of a host are its tokens on at least half of its pages, at most twice the tokens of a mean page.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.llm.textops import by_bytes, texts_of
from waraq.runtime import bound_batches, materialize
#: Elements whose content is raw text, up to their end tag.
RAW = ("script", "style", "iframe", "textarea", "title")
#: Elements whose content is no text of the page, but is made of elements. One without an end tag holds nothing.
HIDDEN = frozenset("noscript template svg object select button canvas math".split())
#: Of these, the ones that cannot stand inside one another.
UNNESTED = frozenset(["select", "button"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An element that ends an open element of the same family when it starts.
FAMILIES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = frozenset(["ul", "ol", "dl", "menu", "table"])
MAIN = frozenset(["article", "main"])
#: A block ends an open paragraph, if none of these stands between.
PARAGRAPH, AROUND, NONE = ("p",), MAIN | LISTS | frozenset(["div", "section", "td", "th", "li", "body"]), frozenset()
#: Elements that hold the article, so that no word of a class name makes them aside.
WHOLE = MAIN | {"html", "body"}
#: Element names, and words of class and id names, that mark what is not the article.
SIDE_ELEMENTS = frozenset("nav footer aside form dialog menu search head fieldset".split())
SIDE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside ad ads advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent notice notification gdpr popup modal overlay comment comments reply replies disqus share sharing social related recommended newsletter subscribe signup login form search widget toolbar pagination pager masthead topbar copyright legal".split()
)
HEAD_WORDS = frozenset(["header", "masthead"])
#: Inside an article a name makes an element aside only if all its words are those above or tell a shape, and never one of text.
SHAPE_WORDS = frozenset("area bar block box button buttons container content inner item items links list outer row section slot thread unit wrap wrapper".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Elements that can be the article's own, so that the way through the template may end in them.
CONTAINERS = frozenset("html body div section article main center form table tbody tr td".split())
HEADINGS = frozenset(["h1"])
#: What part of an element's prose a nested element must hold for the way to go on to it, and how much prose under
#: article or main counts.
MOST, MAIN_WEIGHT = 0.6, 4
#: Pages of a host from which on a text inside the article that is on all of them is the template's: of fewer pages it may as
#: well be one article that stands there more than once. Two are enough for a heading outside the article.
FIXED_PAGES = 5


@dataclass(slots=True)
class Element:
    """A block element of a page. Its token is its role, its group what all places of its name under its parent share."""

    token: int
    group: int
    parent: int  # index into the page's elements
    tag: str
    place: int
    names: int  # hash of the path of names
    main: bool = False
    children: dict[str, int] | None = None
    prose: int = 0  # characters of prose at or under it, those under article or main weighted
    chars: int = 0
    links: int = 0


@dataclass(slots=True)
class Block:
    """A block of text, the element around it, whether it is aside and whether in an article, and its link characters."""

    text: str
    at: int
    side: bool
    main: bool
    heading: bool
    links: int


def _label(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """An element's name in paths (with the words of its classes and id, without digits), whether it is aside, whether so
    inside an article too, and whether a page's head."""
    if not attrs or attrs.isspace():
        return _plain_label(tag)
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs))
    if not names:
        return _plain_label(tag)
    parts = [[w for w in _PARTS.split(_CAMEL.sub(" ", name).lower()) if w] for name in names.split()]
    words = [w for part in parts for w in part]
    label = ".".join([tag, *dict.fromkeys(words)])
    if tag in WHOLE:
        return label, False, False, False
    wholly = tag not in TEXTUAL and any(SIDE_WORDS.intersection(part) and SIDE_WORDS.union(SHAPE_WORDS).issuperset(part) for part in parts)
    return label, tag in SIDE_ELEMENTS or bool(SIDE_WORDS.intersection(words)), tag in SIDE_ELEMENTS or wholly, bool(HEAD_WORDS.intersection(words)) or tag == "header"


def _plain_label(tag: str) -> tuple[str, bool, bool, bool]:
    side = tag not in WHOLE and tag in SIDE_ELEMENTS
    return tag, side, side, tag == "header"


_EDGES = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in HIDDEN}
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def _hash(*parts: object) -> int:
    h = xxhash.xxh64_intdigest("\0".join(map(str, parts)))
    return h - (1 << 64) if h >> 63 else h


ROOT = _hash("root")


def _text_token(names: int, text: str) -> int:
    return _under(names, xxhash.xxh64_intdigest(text))


@lru_cache(1 << 16)
def _name_hash(label: str) -> int:
    return _hash("name", label)


def _under(above: int, name: int) -> int:
    """The hash of a name or place under a token."""
    h = ((above ^ name) * 0x9E3779B97F4A7C15 + name) & 0xFFFFFFFFFFFFFFFF
    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 32
    return h - (1 << 64) if h >> 63 else h


class Page:
    """A page read once: its block elements and its blocks of text, in order. Time and memory are linear in the page."""

    def __init__(self, page: str):
        self.elements = [Element(ROOT, ROOT, -1, "html", 1, ROOT)]
        self.blocks: list[Block] = []
        self.page = page
        # open elements: tag, index of the block element at or around it, aside, in an article
        self.stack: list[tuple[str, int, bool, bool]] = []
        self.open: dict[str, int] = {}
        self.hidden = 0
        self.held: list[str] = []
        self.links = 0
        # places of tags, found once for each name that needs them
        self.edges: dict[str, tuple[list[int], list[bool], int]] = {}
        self.raw_ends: dict[str, tuple[list[int], list[int]]] = {}
        self._read()

    def _flush(self) -> None:
        text = "".join(self.held)
        text = " ".join((html_lib.unescape(text) if "&" in text else text).split())
        if text:
            _, at, side, main = self.stack[-1] if self.stack else ("", 0, False, False)
            self.blocks.append(Block(text, at, side, main, self.elements[at].tag in HEADINGS, min(self.links, len(text))))
        self.held.clear()
        self.links = 0

    def _text(self, piece: str) -> None:
        if piece and self.hidden:
            self.held.append(" ")
        elif piece:
            self.held.append(piece)
            if self.open.get("a"):
                self.links += len(piece)

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag = self.stack.pop()[0]
            self.open[tag] -= 1
            self.hidden -= tag in HIDDEN

    def _close(self, names: Iterable[str], stop: frozenset[str]) -> None:
        for name in names:
            if self.open.get(name):
                break
        else:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in names:
                self._pop(i)
                return
            if tag in stop:
                return

    def _has_end(self, tag: str, start: int) -> bool:
        """Whether a hidden element that starts before ``start`` has an end tag: one that cannot nest, before it starts again."""
        if tag not in self.edges:
            found = [(m.start(), bool(m[1])) for m in _EDGES[tag].finditer(self.page)]
            self.edges[tag] = [x for x, _ in found], [end for _, end in found], max((x for x, end in found if end), default=-1)
        places, ends, last = self.edges[tag]
        if tag not in UNNESTED:
            return last >= start
        at = bisect_left(places, start)
        return at < len(places) and ends[at]

    def _raw_end(self, tag: str, start: int) -> int:
        """The place behind the end tag of a raw element whose content begins at ``start``; -1 where it has none."""
        if tag not in self.raw_ends:
            found = [m.span() for m in _RAW_ENDS[tag].finditer(self.page)]
            self.raw_ends[tag] = [a for a, _ in found], [b for _, b in found]
        starts, stops = self.raw_ends[tag]
        at = bisect_left(starts, start)
        return stops[at] if at < len(starts) else -1

    def _open(self, tag: str, attrs: str, is_block: bool) -> None:
        label, side, side_in_main, head = _label(tag, attrs)
        _, at, aside, main = self.stack[-1] if self.stack else ("", 0, False, False)
        aside = aside or (side_in_main if main else side) or tag in HIDDEN or (head and not main)
        main = main or tag in MAIN
        if is_block:
            above = self.elements[at]
            if above.children is None:
                above.children = {}
            place = above.children[label] = above.children.get(label, 0) + 1
            name = _name_hash(label)
            group = _under(above.token, name)
            self.elements.append(Element(_under(group, place), group, at, tag, place, _under(above.names, name), above.main or tag in MAIN))
            at = len(self.elements) - 1
        if is_block or not attrs.endswith("/"):
            self.stack.append((tag, at, aside, main))
            self.open[tag] = self.open.get(tag, 0) + 1
            self.hidden += tag in HIDDEN

    def _read(self) -> None:
        at = 0
        while m := _TOKEN.search(self.page, at):
            self._text(self.page[at : m.start()])
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            if tag in RAW and not m["end"] and not m["attrs"].endswith("/"):
                end = self._raw_end(tag, at)
                if end >= 0 or tag in ("script", "style"):  # without an end tag these two take the rest of the page
                    self.held.append(" ")
                    at = end if end >= 0 else len(self.page)
                    continue
            if tag in HIDDEN and not m["end"] and (m["attrs"].endswith("/") or not self._has_end(tag, at)):
                self.held.append(" ")
                continue
            if tag in VOID:
                self.held.append(" ")
                if tag == "hr":
                    self._flush()
                continue
            is_block = tag in BLOCK
            if is_block:
                self._flush()
            if m["end"]:
                self._close((tag,), NONE if is_block else BLOCK)
                continue
            if is_block:
                self._close(PARAGRAPH, AROUND)
            if tag in FAMILIES:
                self._close(FAMILIES[tag], LISTS)
            self._open(tag, m["attrs"], is_block)
        self._text(self.page[at:])
        self._flush()
        for b in self.blocks:
            e = self.elements[b.at]
            if not b.side:
                e.prose += (len(b.text) - b.links) * (MAIN_WEIGHT if b.main else 1)
            e.chars += len(b.text)
            e.links += b.links
        for e in reversed(self.elements[1:]):
            above = self.elements[e.parent]
            above.prose += e.prose
            above.chars += e.chars
            above.links += e.links


@dataclass(slots=True)
class Rules:
    """What a host's template says of a page: the element of the article, the elements that led to it, elements of links
    and texts that are no part of it, and texts that are no heading of it."""

    article: int = ROOT
    way: frozenset[int] = frozenset([ROOT])
    links: frozenset[int] = frozenset()
    fixed: frozenset[int] = frozenset()
    heads: frozenset[int] = frozenset()


def template_of(tokens: list[tuple], fixed_pages: int = FIXED_PAGES) -> Rules:
    """The rules of a host from its tokens on at least half of its pages.

    A token is (token, group, parent, is_text, container, main, pages, vector, uniform, prose, chars, links). uniform
    says whether all places of the element's name under its parent are in its class.
    """
    elements = [t for t in tokens if not t[3]]
    under: dict[int, list[tuple]] = {}
    for t in elements:
        under.setdefault(t[2], []).append(t)
    top = [t for t in elements if t[0] == ROOT]
    if not top:
        return Rules()
    host_pages = top[0][6]
    valid: list[tuple] = []
    todo = list(top)
    while todo:  # from the root class down: a class nests where its elements' parents are in valid classes
        t = todo.pop()
        valid.append(t)
        todo += [c for c in under.get(t[0], ()) if c[0] != ROOT and c[8]]
    vectors = {t[7] for t in valid}
    nested = {t[0] for t in valid}
    at, way = top[0], [ROOT]
    while not at[5]:  # an article or main is not looked into
        inside = [c for c in under.get(at[0], ()) if c[0] in nested and c[0] != ROOT and c[4]]
        best = max(inside, key=lambda c: (c[9], -c[0]), default=None)
        if best is None or not best[9] or best[9] < MOST * at[9]:
            break
        at = best
        way.append(at[0])
    links = frozenset(t[0] for t in valid if not t[5] and t[10] and t[11] * 2 > t[10])
    texts = {t[0]: t for t in tokens if t[3] and t[7] in vectors and t[6] == host_pages and host_pages >= 2}
    return Rules(at[0], frozenset(way), links, frozenset(texts) if host_pages >= fixed_pages else frozenset(), frozenset(texts))


def page_tokens(page: Page) -> list[tuple]:
    """(token, group, parent, is_text, container, main, n, prose, chars, links) of every element and of every text not aside."""
    at = page.elements
    rows = [(e.token, e.group, at[e.parent].token if e.parent >= 0 else 0, False, e.tag in CONTAINERS, e.main, 1, e.prose, e.chars, e.links) for e in at]
    texts = Counter(_text_token(at[b.at].names, b.text) for b in page.blocks if not b.side)
    return rows + [(h, h, 0, True, False, False, n, 0, 0, 0) for h, n in texts.items()]


def own_template(page: Page) -> Rules:
    """The rules of a page alone: all its elements are on all pages."""
    return template_of([(*r[:6], 1, 0, True, *r[7:]) for r in page_tokens(page)])


def main_text(html: str, rules: Rules | None = None) -> str:
    """The article's blocks, one per line, given the host's template."""
    page = Page(html)
    if rules is None or all(e.token != rules.article for e in page.elements):
        rules = own_template(page)
    text = _article(page, rules)
    if not text and rules.fixed:  # a copy of its host's other pages is all template
        text = _article(page, Rules(rules.article, rules.way, rules.links))
    return text or _article(page, own_template(page)) or _article(page, Rules())


def _article(page: Page, rules: Rules) -> str:
    inside, beside, dropped = (np.zeros(len(page.elements), bool) for _ in range(3))
    for i, e in enumerate(page.elements):  # parents come first
        inside[i] = e.token == rules.article or (e.parent >= 0 and inside[e.parent])
        beside[i] = e.token in rules.way
        dropped[i] = (e.token in rules.links and not e.main) or (e.parent >= 0 and dropped[e.parent])
    kept = []
    for b in page.blocks:
        if b.side or dropped[b.at]:
            continue
        e = page.elements[b.at]
        name = _text_token(e.names, b.text) if rules.heads else 0
        if inside[b.at]:
            keep = name not in rules.fixed
        else:  # the article's heading may stand beside its element
            keep = b.heading and b.links * 2 <= len(b.text) and name not in rules.heads and bool(beside[e.parent])
        if keep:
            kept.append(b)
    prose = [b for b in kept if b.main or b.links * 2 <= len(b.text) or page.elements[b.at].tag == "p"] or kept
    return "\n".join(b.text for b in prose)


TOKEN = "token long, group long, parent long, is_text boolean, container boolean, main boolean"


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per page and token: host, the token, n, prose, chars, links, page (a hash)."""
    names = ["host", "token", "group", "parent", "is_text", "container", "main", "n", "prose", "chars", "links", "page"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in by_bytes(batches, 1, 2 << 20):
        rows: list[tuple] = []
        for host, html in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            page = xxhash.xxh64_intdigest(html) >> 1
            rows += [(host, *r, page) for r in page_tokens(Page(html))]
        columns = list(zip(*rows)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


RULES = "host string, article long, way array<long>, links array<long>, fixed array<long>, heads array<long>"


def _rule_rows(fixed_pages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [template_of([tuple(t.values()) for t in tokens], fixed_pages) for tokens in batch.column(1).to_pylist()]
            sets = [[sorted(getattr(r, name)) for r in made] for name in ("way", "links", "fixed", "heads")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.article for r in made], pa.int64()), *(pa.array(s, pa.list_(pa.int64())) for s in sets)], ["host", "article", "way", "links", "fixed", "heads"])

    return run


def host_tokens(hosted: DataFrame, salt: int = 16) -> DataFrame:
    """The tokens on at least half of the pages of each host of two pages or more, with their vectors."""
    rows = hosted.select("host", "html").mapInArrow(_token_rows, f"host string, {TOKEN}, n long, prose long, chars long, links long, page long")
    merged = rows.groupBy("host", "token").agg(
        *(F.max(c).alias(c) for c in ("group", "parent", "is_text", "container", "main")),
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"),
        *(F.sum(c).alias(c) for c in ("prose", "chars", "links")),
    )
    merged = materialize(merged, "page-tokens")
    hosts = merged.filter(F.col("token") == ROOT).select("host", F.col("pages").alias("host_pages")).filter("host_pages > 1")
    # a large host has many tokens that are on few pages: they are dealt over its copies of the one row that counts its pages
    hosts = hosts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    known = merged.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(salt)).cast("int")).join(hosts, ["host", "part"])
    frequent = known.filter(F.col("pages") * 2 >= F.col("host_pages"))
    # places of a name beyond those on half of the pages have other vectors, so the first that is rarer tells
    groups = merged.filter("not is_text").groupBy("host", "group").agg((F.min("vector") == F.max("vector")).alias("uniform"))
    return frequent.join(groups, ["host", "group"], "left").select(
        "host", "token", "group", "parent", "is_text", "container", "main", "pages", F.xxhash64("vector").alias("vector"), F.coalesce("uniform", F.lit(False)).alias("uniform"), "prose", "chars", "links"
    )


def template_rules(hosted: DataFrame, fixed_pages: int = FIXED_PAGES) -> DataFrame:
    """One row of :data:`RULES` per host of two pages or more."""
    columns = ["token", "group", "parent", "is_text", "container", "main", "pages", "vector", "uniform", "prose", "chars", "links"]
    tokens = host_tokens(hosted).groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("tokens"))
    return tokens.mapInArrow(_rule_rows(fixed_pages), RULES)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 2):
        known = [
            None if article is None else Rules(article, *map(frozenset, sets))
            for article, *sets in zip(*(batch.column(c).to_pylist() for c in range(3, 8)))
        ]
        out = [main_text(t, r) for t, r in zip(texts_of(batch.column(2)), known)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, broadcast_bytes: int = 64 << 20, salt: int = 64, fixed_pages: int = FIXED_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``, from the whole html.

    Blocks are joined in page order by one newline; white space inside a block, decoded, becomes one space. Null html:
    empty text. Null url: the pages without a host share one template. Repeated rows: repeated in the result (copies
    of a page count as one more page of the template each). A text inside the article that is on every page of its host is
    the template's from ``fixed_pages`` pages of the host on. Pages alone on their host are their own template. Ties between nested elements:
    the one with the smaller hash. Very long and deeply nested pages: read whole, in time linear in them. Empty
    table: no rows. Other columns are not read. Templates are broadcast only if their bytes are at most
    ``broadcast_bytes``; otherwise they are joined by host and one of ``salt`` parts, so that no host is one task's.
    """
    bound_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", 1))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    rules = materialize(template_rules(hosted, fixed_pages), "templates")
    size = sum((F.size(c) for c in ("way", "links", "fixed", "heads")), F.lit(8)) * 8 + F.length("host")
    if (rules.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes:
        joined = hosted.join(F.broadcast(rules), "host", "left")
    else:
        parts = rules.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        joined = hosted.withColumn("part", F.pmod(F.xxhash64("url", "page_id"), F.lit(salt)).cast("int")).join(parts, ["host", "part"], "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = joined.select("page_id", "url", "html", "article", "way", "links", "fixed", "heads")
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
