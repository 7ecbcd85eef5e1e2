"""Main text of pages, by templates deduced from all pages of a host.

How it runs
-----------
1. Every page becomes tokens: each block element by its path of open elements,
   and each text block by path and text; menus, headers, footers and adverts
   too. A token's *occurrence vector* says how often each page of the host has
   it. Pages of one longest block are copies of an article and count as one.
2. Vectors are grouped sums over the whole host, however large: the number of
   pages and 128 bits of hash over (page, times). Tokens on at least
   ``MIN_SHARE`` of a host's pages are told apart by vector into equivalence
   classes; the order of a class is that of its first page. No task holds the
   pages of a host, but only such tokens, which one page could hold too.
3. Classes nest by their paths into the host's template. Its text tokens are
   what all pages say; between its elements lie slots. The *main slot* is the
   main element, article or content container of the template that holds half
   of the text in slots at least, else what is reached from the root by going
   to the one element that holds most of it.
4. Pages are read again beside their host's template. A page that has the
   tokens of the main slot's class in order gives the main slot's text without
   template texts. Others, and those of hosts with fewer than ``MIN_PAGES``
   different articles, choose by their own elements.

Inside the main text, elements that never are main text (menus, footers, side
bars, forms, scripts, and elements *named* as adverts, notices, comments and
the like) are left out. Names are compared whole inside a main region, and in
parts only where a page without a template has no region.

Defined results: a null or empty page has the empty text; a null url is a host
of its own; repeated rows each give a row, and a repeated page counts once in
the deduction; of regions that tie all are kept, in page order. Pages of any
length are read whole: paths are hashes, so memory grows with the page, not
with its depth. An empty table gives no row. Other columns are not read, so
their names can't clash. A block's white space becomes one space; ``<br>`` ends
a block.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .stash import Stash

#: Hosts up to which templates (a few KB each) are broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 20_000
#: A template needs so many pages with different articles, and its tokens this share of them.
MIN_PAGES, MIN_SHARE = 4, 0.9
#: Share of slot text that the main slot holds, and that leads on to an inner element.
MAIN_SHARE, INNER_SHARE = 0.5, 0.7

_RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
_SKIP = frozenset("head script style noscript template nav footer aside button select textarea iframe svg math menu dialog object audio video canvas map xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adslot sponsor sponsored promo promotion banner banners sidebar side-bar rail "
    "cookie cookies consent gdpr notice notices notification notifications alert popup popover modal overlay toast newsletter subscribe subscription signup "
    "comment comments respond disqus replies reviews nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc toolbar topbar masthead "
    "footer header share sharing social related recommended recommendations widget widgets search login paywall skip-link hidden "
    "cookie-notice cookie-banner ad-slot site-header site-footer site-nav comment-list".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar note".split())
_CONTENT = frozenset("content main article post entry story body-text article-body articlebody post-content entry-content main-content story-body".split())
_SPACE = re.compile(r"\s+")
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_ENDS_P = _BLOCK - {"br", "body", "html", "head", "title", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "option", "optgroup", "legend", "summary"}
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_READ = re.compile(r"class|id|role|hidden|itemprop", re.I)

#: What a block or element lies in: left out, a form, and regions by kind.
OUT, FORM, MAIN, ARTICLE, CONTENT, SLOT, HEADING, LOOSE = 1, 2, 4, 8, 16, 32, 64, 128


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), entities.unescape(value) if "&" in value else value)
    return out


class Page:
    """Blocks (path, flags, text) and block elements (path: parent, times, first place, kind) of a page."""

    def __init__(self, html: str, slots: frozenset[int] = frozenset()):
        self.blocks: list[tuple[int, int, str]] = []
        self.elements: dict[int, list] = {}
        self.slots = slots
        self._open: list[tuple] = []  # tag, is a block, flags, path, place of the nearest block here
        self._at: dict[str, list[int]] = {}
        self._text: list[str] = []
        self._known: dict[tuple[int, str], int] = {}
        self._place = 0
        self._read(html)
        self._flush()

    def _read(self, html: str) -> None:
        at, end, tag = 0, len(html), _TAG
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                self._say(html[at:])
                return
            if lt > at:
                self._say(html[at:lt])
            m = tag.match(html, lt)
            if m is None and tag is _TAG and html[lt + 1 : lt + 3].lstrip("/")[:1].isalpha():
                tag = _LOOSE  # a quote that never ends: quotes mean nothing from here on
                m = tag.match(html, lt)
            if m is not None:
                at, name = m.end(), m[2].lower()
                if m[1]:
                    self._end(name)
                    continue
                self._start(name, m[3])
                if name in _RAW:
                    close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                    at = close.start() if close else end
            elif html.startswith("<!--", lt):
                if html.startswith((">", "->"), lt + 4):
                    at = html.index(">", lt) + 1
                else:
                    close = html.find("-->", lt + 4)
                    at = close + 3 if close >= 0 else end
            elif html[lt + 1 : lt + 2] in ("!", "?", "/"):
                close = html.find(">", lt)
                at = close + 1 if close >= 0 else end
            else:
                self._say("<")
                at = lt + 1

    def _say(self, text: str) -> None:
        self._text.append(text)

    def _flush(self) -> None:
        if not self._text:
            return
        text = "".join(self._text)
        self._text = []
        if "&" in text:
            text = entities.unescape(text)
        text = _SPACE.sub(" ", text).strip()
        if text:
            flags, path = self._open[-1][2:4] if self._open else (0, 0)
            self._place += 1
            self.blocks.append((path, flags, text))

    def _close(self, at: int) -> None:
        if any(e[1] for e in self._open[at:]):
            self._flush()
        for tag, *_ in self._open[at:]:
            self._at[tag].pop()
        del self._open[at:]

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._flush()
        at = self._at.get(tag)
        # An inline element that ends inside a later block leaves the block open.
        if at and (tag in _BLOCK or tag in _SKIP or at[-1] > self._open[-1][4]):
            self._close(at[-1])

    def _start(self, tag: str, rest: str) -> None:
        block = tag in _BLOCK
        if block:
            self._flush()
        if tag in _VOID:
            return
        if self._open and (tag in _CLOSES or tag in _ENDS_P):
            # An open p, or a sibling of its kind, ends here; the inline elements in it too.
            near = self._open[-1][4]
            own = self._open[near][0] if near >= 0 else ""
            if own in _CLOSES.get(tag, ()) or own == "p" and tag in _ENDS_P:
                self._close(near)
        _, _, flags, path, near = self._open[-1] if self._open else ("", False, 0, 0, -1)
        attrs = _attributes(rest) if rest and _READ.search(rest) else {}
        names = set(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().replace("_", "-").split()) if attrs else set()
        role = attrs.get("role", "").lower()
        inside = flags & (MAIN | ARTICLE | CONTENT)
        kind = 0
        if tag == "main" or role == "main":
            kind = MAIN
        elif tag == "article":
            kind = ARTICLE
        elif attrs.get("itemprop") == "articleBody" or names & _CONTENT and tag in ("div", "section", "td"):
            kind = CONTENT
        if tag in _SKIP or tag == "header" and not inside or role in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            flags |= OUT
        if names and tag not in ("body", "html") and not names & _CONTENT:
            if names & _CHROME:
                flags |= OUT
            elif any(part in _CHROME for n in names for part in n.split("-")):
                flags |= LOOSE
        if tag == "form":
            flags |= FORM
        if flags & OUT:
            kind = 0
        elif kind:
            flags = (flags | kind) & ~(FORM | LOOSE)
        if tag in ("h1", "h2"):
            flags |= HEADING
        if block:
            step = tag + ("." + ".".join(sorted(names)) if names and tag not in ("body", "html") else "")
            key = (path, step)
            own = self._known.get(key)
            if own is None:
                own = self._known[key] = xxhash.xxh3_64_intdigest(step, path)
            self._place += 1
            found = self.elements.get(own)
            if found is None:
                self.elements[own] = [path, 1, self._place, kind]
            else:
                found[1] += 1
            path, near = own, len(self._open)
            if own in self.slots:
                flags = (flags | SLOT) & ~FORM
        self._open.append((tag, block, flags, path, near))
        self._at.setdefault(tag, []).append(len(self._open) - 1)


def text_token(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text, path ^ 1)


def body_of(page: Page) -> int:
    """What a page is told apart by in the deduction: its longest block, of those not left out if there are any."""
    return xxhash.xxh3_64_intdigest(max((t for _, flags, t in page.blocks if not flags & OUT), key=len, default="") or max((t for *_, t in page.blocks), key=len, default=""))


def tokens_of(page: Page) -> list[tuple[int, int, int, int, int, int]]:
    """(token, parent, times, first place, kind, characters) of a page; kind is -1 for texts.

    An element's characters are those of all blocks in it.
    """
    chars: Counter = Counter()
    texts: dict[int, list] = {}
    for at, (path, _, text) in enumerate(page.blocks):
        chars[path] += len(text)
        token = text_token(path, text)
        if token in texts:
            texts[token][1] += 1
        else:
            texts[token] = [path, 1, at, len(text)]
    for path in reversed(page.elements):  # inner elements are opened after outer ones
        chars[page.elements[path][0]] += chars[path]
    out = [(path, parent, times, place, kind, chars[path]) for path, (parent, times, place, kind) in page.elements.items()]
    return out + [(token, path, times, at, -1, n) for token, (path, times, at, n) in texts.items()]


class Template:
    """Of one host: text tokens, the main slot's path, and its class in order."""

    def __init__(self, texts: frozenset[int], slot: int, order: tuple[int, ...], heading: bool):
        self.texts, self.slot, self.order, self.heading = texts, slot, order, heading

    def to_bytes(self) -> bytes:
        return np.array([self.slot, int(self.heading), len(self.order), *self.order, *sorted(self.texts)], np.uint64).tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> Template:
        slot, heading, n, *rest = np.frombuffer(blob, np.uint64).tolist()
        return cls(frozenset(rest[n:]), slot, tuple(rest[:n]), bool(heading))


def template_of(tokens: list[dict]) -> Template | None:
    """Of a host's frequent tokens: dicts of token, parent, vector, once, first, kind, chars."""
    texts = [t for t in tokens if t["kind"] < 0]
    elements = {t["token"]: t for t in tokens if t["kind"] >= 0}
    mass = {p: e["chars"] for p, e in elements.items()}
    for t in texts:  # what all pages say is in no slot
        at, seen = t["parent"], 0
        while at in mass and seen <= len(mass):
            mass[at] -= t["chars"]
            at, seen = elements[at]["parent"], seen + 1
    inner: dict[int, list[int]] = {}
    for p, e in elements.items():
        inner.setdefault(e["parent"], []).append(p)
    roots = [p for p, e in elements.items() if e["parent"] not in elements]
    total = sum(mass[p] for p in roots)
    if total <= 0:
        return None
    slot, heading = 0, False
    for kind in (MAIN, ARTICLE, CONTENT):
        own = [p for p, e in elements.items() if e["kind"] == kind and mass[p] >= MAIN_SHARE * total]
        if own:
            slot = max(own, key=lambda p: (mass[p], -elements[p]["first"]))
            break
    else:
        at = max(roots, key=lambda p: (mass[p], p))
        while True:
            slot = at
            within = [p for p in inner.get(at, []) if elements[p]["once"]]
            at = max(within, key=lambda p: (mass[p], p), default=0)
            if not within or mass[at] < INNER_SHARE * mass[slot]:
                break
        heading = True
    vector = elements[slot]["vector"]
    order = sorted((t for t in elements.values() if t["vector"] == vector), key=lambda t: t["first"])
    return Template(frozenset(t["token"] for t in texts), slot, tuple(t["token"] for t in order), heading)


def fits(page: Page, template: Template) -> bool:
    """Whether a page has the main slot's class, in order."""
    at = [page.elements[p][2] if p in page.elements else 0 for p in template.order]
    return bool(at) and at[0] > 0 and all(a < b for a, b in zip(at, at[1:]))


def slot_text(page: Page, template: Template) -> str:
    keep = lambda flags: flags & SLOT or template.heading and flags & HEADING
    return "\n".join(t for p, flags, t in page.blocks if keep(flags) and not flags & (OUT | FORM) and text_token(p, t) not in template.texts)


def page_text(page: Page, texts: frozenset[int] = frozenset()) -> str:
    """Main text by the page's own elements."""
    said = [b for b in page.blocks if not b[1] & OUT and (not texts or text_token(b[0], b[2]) not in texts)]
    size = lambda kind: sum(len(t) for _, flags, t in said if flags & kind and not flags & FORM)
    main, article, content = size(MAIN), size(ARTICLE), size(CONTENT)
    kind = MAIN if 2 * main >= article and main else ARTICLE if 2 * article >= content and article else CONTENT if content else 0
    if kind:
        return "\n".join(t for _, flags, t in said if flags & kind and not flags & FORM)
    # No region: the container whose blocks hold most text.
    wrapped = all(flags & FORM for _, flags, _ in page.blocks)  # a form around the whole page is no form of it
    plain = [b for b in said if not b[1] & (LOOSE if wrapped else LOOSE | FORM)]
    parents: Counter = Counter()
    for path, _, text in plain:
        parents[page.elements[path][0] if path in page.elements else 0] += len(text)
    if not parents:
        return ""
    top = max(parents, key=lambda p: (parents[p], p))
    within = {top} if top else set()
    for path, (parent, *_) in page.elements.items():
        if not top or parent in within:
            within.add(path)
    return "\n".join(t for p, _, t in plain if p in within or not top)


_TOKENS = "host string, body long, token long, parent long, times long, place long, kind int, chars long"


def _tokens(batches):
    for batch in batches:
        columns: list[list] = [[] for _ in range(8)]
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
            page = Page(html.as_py() or "")
            if not page.blocks:
                continue
            body = body_of(page)
            own = tokens_of(page)
            for column, values in zip(columns, ([host] * len(own), [body] * len(own), *zip(*own))):
                column.extend(values)
        names = ["host", "body", "token", "parent", "times", "place", "kind", "chars"]
        longs = [pa.array(np.array(c, np.uint64).view(np.int64)) if n in ("body", "token", "parent") else pa.array(c, pa.int32() if n == "kind" else pa.int64()) for n, c in zip(names[1:], columns[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *longs], names)


def _templates(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = [{**r, "token": r["token"] & (1 << 64) - 1, "parent": r["parent"] & (1 << 64) - 1, "vector": (r["n"], r["v1"], r["v2"])} for r in table.to_pylist()]
    found = template_of(rows)
    return pa.table({"host": pa.array([key[0].as_py()] if found else [], pa.string()), "template": pa.array([found.to_bytes()] if found else [], pa.binary())})


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, stash: Stash) -> DataFrame:
    """(host, template) of pages(host, html); hosts with too few different articles have none."""
    tokens = pages.select("host", "html").mapInArrow(_tokens, _TOKENS)
    # Copies of an article are one place of the vectors.
    one = tokens.groupBy("host", "token", "body").agg(
        F.max("times").alias("times"), F.min("place").alias("place"), F.max("chars").alias("chars"), F.max("kind").alias("kind"), F.min("parent").alias("parent"))
    vectors = one.groupBy("host", "token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("body", "times")).alias("v1"), F.bit_xor(F.xxhash64("times", "body", F.lit(7))).alias("v2"),
        (F.max("times") == 1).alias("once"), F.min(F.struct("body", "place"))["place"].alias("first"), F.sum("chars").alias("chars"), F.max("kind").alias("kind"), F.min("parent").alias("parent"),
    )
    often = stash.keep(vectors.where(F.col("n") >= MIN_PAGES), "often")
    # The token that most pages have is on all of them, as html and body are.
    bodies = often.groupBy("host").agg(F.max("n").alias("bodies"))
    return often.join(bodies, "host").where(F.col("n") >= MIN_SHARE * F.col("bodies")).drop("bodies").groupBy("host").applyInArrow(_templates, "host string, template binary")


def _extract(batches):
    for batch in batches:
        texts, by = [], []
        seen: dict[bytes, Template] = {}
        for html, blob in zip(batch.column("html"), batch.column("template")):
            blob, text, own = blob.as_py(), html.as_py() or "", None
            if blob is not None:
                own = seen.get(blob) or seen.setdefault(blob, Template.from_bytes(blob))
            page = Page(text, frozenset([own.slot]) if own else frozenset())
            by.append(own is not None and fits(page, own))
            texts.append(slot_text(page, own) if by[-1] else page_text(page, own.texts if own else frozenset()))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(by, pa.bool_())], ["page_id", "url", "text", "by_template"])


def extract(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, url, text, by_template) of every page."""
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    own = own.withColumn("host", host_of(F.col("url")))
    stash = Stash(pages.sparkSession, "hosts")
    found = stash.keep(templates(own, stash), "templates")
    few = found.count() <= BROADCAST_HOSTS
    stash.drop("often")
    return own.join(F.broadcast(found) if few else found, "host", "left").select("page_id", "url", "html", "template").mapInArrow(
        _extract, "page_id long, url string, text string, by_template boolean")
