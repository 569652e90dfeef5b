"""HTML extraction with removal of site templates.

A page is read in one pass over its tags. Its text comes from the article elements, else from main, else from the body (from
main too where its articles hold less than half of it), without the parts that are never article text: menus, headers,
footers, sidebars, forms, scripts, styles, adverts, notices and reader comments, told by their elements, by a whole class,
id or role of one word, by the attribute hidden, or by a part of a compound name (cookie-banner) if they hold no more than
``NAMED_SHARE`` of the text. A name never drops html, body, main or an outer article, nor what surrounds main, nor what
surrounds the only articles of a page that has less other text.

What remains may still hold boxes that the site puts on many pages. So every element of the whole page but single text
elements is hashed with its subtree, Spark counts on how many different pages of a host, and of each section of it, a hash
occurs, and subtrees on at least ``MIN_PAGES`` pages and ``MIN_SHARE`` of all pages there are deleted, whatever part of a
page they are. Pages with the same article text count as one, so an article that is found under many addresses stays.
Plain text elements (p, h1, li, ...) are never deleted on their own: passages may repeat.

Blocks are cut at elements that are not inline. White space in a block becomes one space; blocks are joined by line feeds.

Null and empty pages give an empty text. Cut-off pages are read to their end, without a tag that is cut. A null url
belongs to the host ''.
"""
from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from roamlog.llm.common import chunks, query, table
from roamlog.session import stage

MIN_PAGES = 5

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg", "math")
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe svg math button select option "
                    "textarea title menu dialog object audio video canvas input".split())
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies "
                          "consent notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs header "
                          "footer masthead comment comments disqus replies share sharing social related recommended "
                          "popup modal newsletter subscribe pagination pager widget toolbar".split())
#: Elements that are not hashed: single texts, whose passages may repeat, and what holds the page or its article.
UNCOUNTED = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption summary legend "
                               "html head body main article".split())
#: Elements that no class, id or role drops.
NEVER_NAMED = frozenset("html body main article".split())
#: Elements that an opening tag of a block ends where they are open.
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6".split())

#: Start of a tag, a comment or a declaration.
OPEN = re.compile(r"<(?:!--|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)|[!?/])")
#: What may end a tag, or hide its end. Quotes count behind an equals sign only.
TAG_PART = re.compile(r">|=\s*[\"']")
NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?<![\w=\"'-])hidden(?=\s|=|/?$)", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Parts of a name that turn the rest of it around, as in has-sidebar.
TURNING = frozenset("has no with without not is hide show".split())
#: Parts of a name beside which a header is that of the text.
TITLED = frozenset("article body content entry main post section story text title".split())
#: Share of its zone's text above which a part is not dropped for a compound name.
NAMED_SHARE = 0.3
#: Share of the pages of a host or section that a subtree must be on, besides ``MIN_PAGES``.
MIN_SHARE = 0.05


def naming(attrs: str) -> int:
    """2 if a class, id or role of an element is one of the words, or it is hidden; 1 if one has such a part; else 0."""
    found = 0
    if "=" in attrs:
        for token in " ".join(a or b or c for a, b, c in NAMED.findall(attrs)).split():
            if token.lower() in DROPPED_WORDS:
                return 2
            parts = {w.lower() for w in PARTS.findall(token)}
            hit = parts & DROPPED_WORDS
            if len(parts) > 1 and hit and not parts & TURNING and not (hit == {"header"} and parts & TITLED):
                found = 1
    return 2 if "hidden" in attrs and HIDDEN.search(QUOTED.sub("", attrs)) else found


def self_closed(attrs: str) -> bool:
    """Whether a slash ends the tag, and not the value of an attribute without quotes."""
    return attrs.endswith("/") and (len(attrs) == 1 or attrs[-2] in " \t\n\f\r\"'" or "=" not in attrs.split()[-1])


class _Element:
    """An element: what held around it, the hashed element and the compound-named one next above, and its own hash."""

    __slots__ = ("name", "parent", "state", "soft", "above", "hasher", "hash", "place", "size", "gone")

    def __init__(self, name: str, parent, state: tuple, soft):
        self.name, self.parent, self.state, self.soft = name, parent, state, soft
        self.above, self.hasher, self.hash, self.place, self.size, self.gone = None, None, 0, -1, 0, False

    def hashed(self):
        """The element itself if it is hashed, else the next one above that is."""
        return self if self.place >= 0 else self.parent


class PageReader:
    """One pass over a page. Every character is looked at a bounded number of times, however tags nest or break off.

    The hash of an element is made of its tags, its own text and the hashes of the elements in it.
    """

    def __init__(self, page: str):
        self.page = page
        self.blocks: list[tuple[str, bool, bool, str, _Element | None]] = []
        self.elements: list[_Element] = []
        self.softs: list[_Element] = []
        self.stack: list[_Element] = []
        self.open: Counter = Counter()
        self.text: list[str] = []
        self.closers: dict[str, list[int]] = {}
        # Veiled: an article in an element that its name would drop. Inside: within main. Paragraph: place in the stack
        # of an open paragraph with nothing but inline elements in it.
        self.zone, self.veiled, self.inside, self.dropped, self.named, self.paragraph = "body", False, False, 0, 0, -1

    def shown(self) -> bool:
        return not (self.dropped or self.named)

    def feed(self, raw: str) -> None:
        """A piece of the page, for the hash of the element it stands in."""
        at = self.stack[-1].hashed() if self.stack else None
        if at is not None:
            at.hasher.update(raw.encode("utf-8", "surrogatepass"))

    def end_block(self) -> None:
        if self.text and self.shown():
            line = " ".join(entities.unescape("".join(self.text)).split())
            if line:
                self.blocks.append((self.zone, self.veiled, self.inside, line, self.stack[-1] if self.stack else None))
            self.text.clear()

    def pop(self) -> None:
        e = self.stack.pop()
        self.open[e.name] -= 1
        self.zone, self.veiled, self.inside, self.dropped, self.named, self.paragraph = e.state
        if e.hasher:
            e.hash = e.hasher.intdigest() >> 1
            if e.parent is not None:
                e.parent.hasher.update(e.hasher.digest())
            e.hasher = None

    def raw_end(self, name: str, start: int) -> int:
        """Where the content of a raw element ends: behind its closing tag, or at the end of the page."""
        if name not in self.closers:
            self.closers[name] = [m.end() for m in re.finditer(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", self.page, re.I)]
        k = bisect_right(self.closers[name], start)
        return self.closers[name][k] if k < len(self.closers[name]) else len(self.page)

    def tag_end(self, at: int) -> int:
        """Position of the > that ends a tag, -1 if it is cut off."""
        while (m := TAG_PART.search(self.page, at)) is not None:
            if m[0] == ">":
                return m.start()
            at = self.page.find(m[0][-1], m.end()) + 1
            if not at:  # A quote that is never closed is none.
                return self.page.find(">", m.end())
        return -1

    def read(self) -> None:
        page, at = self.page, 0
        while (m := OPEN.search(page, at)) is not None:
            if m.start() > at:
                if self.shown():
                    self.text.append(page[at : m.start()])
                self.feed(page[at : m.start()])
            name = m["name"]
            if name is None:
                comment = m[0] == "<!--"
                end = page.find("-->" if comment else ">", m.end())
                at = len(page) if end < 0 else end + (3 if comment else 1)
                continue
            end = self.tag_end(m.end())
            at = len(page) if end < 0 else end + 1
            if end < 0:
                break
            name, attrs, raw = name.lower(), page[m.end() : end], page[m.start() : at]
            if m["close"]:
                self.close(name, raw)
            elif name in RAW:
                start, at = at, at if self_closed(attrs) else self.raw_end(name, at)
                self.feed(raw + page[start:at])
            else:
                self.start(name, attrs, raw)
        if self.shown() and at < len(page):
            self.text.append(page[at:])
        self.end_block()
        while self.stack:
            self.pop()

    def close(self, name: str, raw: str) -> None:
        if self.open[name] > 0:
            if name not in INLINE:
                self.end_block()
            while self.stack[-1].name != name:
                self.pop()
            self.feed(raw)
            self.pop()
        elif name == "p":
            self.end_block()

    def start(self, name: str, attrs: str, raw: str) -> None:
        if name not in INLINE:
            self.end_block()
            # An open paragraph ends here, with the inline elements that were left open in it.
            if self.paragraph >= 0:
                stop = self.paragraph
                while len(self.stack) > stop:
                    self.pop()
        elif name == "br" and self.shown():
            self.text.append(" ")
        if name in VOID or self_closed(attrs):
            return self.feed(raw)
        above = self.stack[-1] if self.stack else None
        state = self.zone, self.veiled, self.inside, self.dropped, self.named, self.paragraph
        e = _Element(name, above.hashed() if above else None, state, above.soft if above else None)
        kind, nested = naming(attrs) if attrs else 0, name == "article" and self.zone == "article"
        if kind == 1 and name not in NEVER_NAMED:
            e.above, e.soft = e.soft, e
            self.softs.append(e)
        if name not in UNCOUNTED:
            e.hasher, e.place = xxhash.xxh64(), len(self.elements)
            self.elements.append(e)
        self.stack.append(e)
        self.open[name] += 1
        self.feed(raw)
        self.dropped += name in DROPPED
        self.named += kind == 2 and (name not in NEVER_NAMED or nested)
        if name == "article" and not nested:
            self.zone, self.veiled, self.named = name, self.veiled or self.named > 0, 0
        elif name == "main":
            self.zone, self.veiled, self.inside, self.named = self.zone if self.zone == "article" else name, False, True, 0
        if name in PARAGRAPH:
            self.paragraph = len(self.stack) - 1
        elif name not in INLINE:
            self.paragraph = -1


def read_page(page: str) -> tuple[list[tuple[str, int]], list[int], list[int]]:
    """Blocks of the page's zone in order, (text, place of the hashed element around it or -1), then hash and parent of
    every hashed element; a parent stands before its children."""
    r = PageReader(page)
    r.read()
    sizes: Counter = Counter()
    for zone, veiled, inside, line, _ in r.blocks:
        sizes[zone, veiled] += len(line)
        if inside and not veiled:
            sizes["in main"] += len(line)
            sizes["articles in main"] += len(line) if zone == "article" else 0
    best = next((k for k in (("article", False), ("main", False)) if k in sizes), ("body", False))
    if best[0] == "body" and sizes["article", True] > sizes[best]:
        best = ("article", True)
    if best == ("article", False) and 2 * sizes["articles in main"] < sizes["in main"]:
        # Its articles are no more than teasers in what main holds.
        chosen = [b for b in r.blocks if b[2] and not b[1]]
    else:
        chosen = [b for b in r.blocks if b[:2] == best]
    # Text in compound-named elements, added up from the innermost; what is a small part of the whole goes.
    for *_, line, e in chosen:
        if e is not None and e.soft is not None:
            e.soft.size += len(line)
    for s in reversed(r.softs):
        if s.above is not None:
            s.above.size += s.size
    most = NAMED_SHARE * sum(len(b[3]) for b in chosen)
    for s in r.softs:
        s.gone = s.size <= most or (s.above is not None and s.above.gone)
    lines = []
    for *_, line, e in chosen:
        if e is None or e.soft is None or not e.soft.gone:
            around = e.hashed() if e is not None else None
            lines.append((line, -1 if around is None else around.place))
    return lines, [e.hash for e in r.elements], [-1 if e.parent is None else e.parent.place for e in r.elements]


def _key(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) >> 1


def parsed(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The rows of ``pages`` (without the html) with host, section, digest of the lines, the lines and the place of each,
    and the hashes and parents of all elements. A section is a host with the first part of a path of several."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    address = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    section = F.regexp_extract(address, r"^(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*/([^/?#]+)/[^?#]", 1)
    rows = pages.select(F.struct(*keep).alias("page"), host.alias("host"), section.alias("section"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "html"):
            read = [read_page(x or "") for x in b.column("html").to_pylist()]
            lines = [[line for line, _ in r] for r, _, _ in read]
            yield pa.RecordBatch.from_arrays([
                b.column("page"), b.column("host"), b.column("section"), pa.array([_key("\n".join(x)) for x in lines], pa.int64()),
                pa.array(lines, pa.list_(pa.string())), pa.array([[at for _, at in r] for r, _, _ in read], pa.list_(pa.int32())),
                pa.array([h for _, h, _ in read], pa.list_(pa.int64())), pa.array([p for _, _, p in read], pa.list_(pa.int32()))],
                names=["page", "host", "section", "digest", "lines", "places", "hashes", "parents"])

    kind = rows.schema["page"].dataType.simpleString()
    return rows.mapInArrow(run, f"page {kind}, host string, section string, digest long, lines array<string>, places array<int>, "
                                "hashes array<long>, parents array<int>")


def templates(read: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of the subtrees that recur on a host or in one of its sections. ``read`` is a staged table."""
    parts = F.array(F.lit(""), F.col("section"))
    pages = read.select("host", F.explode(F.array_distinct(parts)).alias("part"), "digest").distinct()
    size = pages.groupBy("host", "part").agg(F.count("*").alias("pages"))
    found = read.select("host", F.array_distinct(parts).alias("parts"), "digest", F.explode(F.array_distinct("hashes")).alias("hash")).select(
        "host", F.explode("parts").alias("part"), "digest", "hash").distinct()
    often = found.groupBy("host", "part", "hash").agg(F.count("*").alias("on")).filter(F.col("on") >= min_pages)
    return often.join(size, ["host", "part"]).filter(F.col("on") >= min_share * F.col("pages")).select("host", "hash").distinct()


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages without the lines in elements whose hash, or that of one above, is gone."""
    for b in batches:
        texts, removed = [], []
        for lines, places, hashes, parents, gone in zip(*(b.column(c).to_pylist() for c in ("lines", "places", "hashes", "parents", "gone"))):
            gone, out = set(gone or ()), []
            for h, up in zip(hashes, parents):
                out.append(h in gone or (up >= 0 and out[up]))
            kept = [line for line, at in zip(lines, places) if at < 0 or not out[at]]
            texts.append("\n".join(kept))
            removed.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays([b.column("page"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["page", "text", "removed"])


def cleaned(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(page, text, removed): the text of each page and how many of its lines recurring subtrees took away."""
    read = stage(parsed(pages, html, url).withColumn("_row", F.monotonically_increasing_id()), "pages")
    around = F.exists("places", lambda at: at >= 0)
    plain = read.filter(~around).select("page", F.array_join("lines", "\n").alias("text"), F.lit(0).cast("long").alias("removed"))
    boxed = read.filter(around)
    known = stage(templates(read), "templates")
    gone = boxed.select("_row", "host", F.explode(F.array_distinct("hashes")).alias("hash")).join(known, ["host", "hash"]).groupBy("_row").agg(
        F.collect_set("hash").alias("gone"))
    kind = read.schema["page"].dataType.simpleString()
    return plain.unionByName(boxed.join(gone, "_row", "left").select("page", "lines", "places", "hashes", "parents", "gone").mapInArrow(
        _without, f"page {kind}, text string, removed long"))


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The columns of ``pages`` except the html, with ``text`` and ``n_chars`` (columns of these names are replaced)."""
    return cleaned(pages, html, url).select("page.*", "text", F.length("text").cast("long").alias("n_chars"))


@query("op2_html_templates")
def _(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
