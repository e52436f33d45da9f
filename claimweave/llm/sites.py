"""Main text of web pages with site templates removed.

Every page is parsed into elements, each with a hash of its subtree: tag, names, text and children. Spark counts on how many
different pages of a host a hash occurs, and subtrees that recur are deleted as the site's template, together with elements
whose tag, role or names say that they are no main text. Inside the page's main part (``main`` or ``article``) only small
blocks are deleted for recurring, and copies of an article count as one page, so copies and shared paragraphs stay whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Collection, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.session import cut_lineage

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+|[^>]*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")  # in order, so that no value is read as a name

# What the HTML standard calls these tags.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Tags that end an open element of the same group, and the tags that search does not pass.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NOT_P = BLOCKS - {"p"}
#: An end tag closes nothing beyond these, but for end tags of such large parts themselves.
CLOSE_BOUNDS = {"td", "th", "table", "article", "main", "body"}
CLOSE_NEAR = {"td": CLOSE_BOUNDS - {"td"}, "th": CLOSE_BOUNDS - {"th"}}
CLOSE_FAR = {"body", "html", "table", "article", "main", "tr", "tbody"}
MAIN = {"main", "article"}
NO_TEXT = {
    "head", "title", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "textarea",
    "iframe", "object", "svg", "canvas", "audio", "video", "dialog", "menu", "noembed", "noframes", "map", "datalist",
}
NO_TEXT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
#: Words of class and id names that mark other than main text anywhere, and those that do so only outside the main part.
NO_TEXT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr",
    "comment", "comments", "disqus", "replies", "reply", "respond", "sidebar", "newsletter", "subscribe", "subscription", "popup", "modal", "overlay",
    "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "nav", "navbar", "navigation", "menu",
    "login", "signup", "signin", "toolbar", "widget", "notice", "notification", "alert",
}
#: Whole class names that mark other than main text inside the main part, where words of names may be part of a subject.
NO_TEXT_CLASSES = NO_TEXT_WORDS - {"social", "promotion", "consent", "notice", "alert", "reply", "widget"} | {
    "ad-slot", "ad-banner", "ad-unit", "ad-container", "advert-box", "comment-list", "comments-area", "comment-section", "cookie-notice", "cookie-banner", "newsletter-signup",
    "related-posts", "related-articles", "related-links", "read-more", "share-buttons", "share-links", "social-share", "social-links", "sponsored-content", "site-notice", "subscribe-box",
}
#: Elements that hold blocks: inside the main part only these can be template, as articles may share paragraphs.
HOLDERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "details", "center", "fieldset"}
SMALL = 5  # and only if they have at most one part in so many of its text
NEVER_BY_NAME = {"html", "body", "main", "article"}
NO_TEXT_OUTSIDE = {"header", "masthead", "footer", "banner", "topbar", "copyright", "logo", "branding", "skip"}
ATTRIBUTE_CUE = re.compile("class|id|role|hidden", re.IGNORECASE)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element:
    __slots__ = ("tag", "parent", "hard", "named", "main", "wraps", "holds", "digest", "size")

    def __init__(self, tag: str, parent: int, hard: bool, named: bool, main: bool) -> None:
        self.tag, self.parent, self.main = tag, parent, main
        self.hard, self.named = hard, named  # no main text by tag, role or state; by a name, unless it holds the main part
        self.wraps, self.holds = False, False  # a main part lies below; the largest one does
        self.digest, self.size = 0, 0  # size: characters of text below

    @property
    def signed(self) -> int:
        return self.digest - (1 << 64) if self.digest >> 63 else self.digest


def host_of(url: str | None) -> str:
    """The lower-case host name without port; empty if there is none."""
    try:
        return (urlsplit((url or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


class Page:
    """The elements of a page in document order, and its texts with the element each stands in."""

    def __init__(self, source: str) -> None:
        self.elements = [Element("", -1, False, False, False)]
        self.texts: list[tuple[int, str, int]] = []  # element, text, number of the block break before it
        self.breaks = 0
        self._stack = [0]
        self._places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are
        self._hashes = [xxhash.xxh64()]
        self._read(source)
        while self._stack:
            self._close()
        at = max(self._tops(), key=lambda e: e.size, default=self.elements[0]).parent
        while at > 0:
            self.elements[at].holds = True
            at = self.elements[at].parent

    def _tops(self) -> list[Element]:
        """The main parts that lie in no other one."""
        return [e for e in self.elements[1:] if e.main and not self.elements[e.parent].main]

    def _open(self, tag: str, attrs: str) -> None:
        at = self._stack[-1]
        above = self.elements[at]
        names, classes, role, hidden, words = [], set(), "", False, ()
        if attrs and ATTRIBUTE_CUE.search(attrs):
            for m in ATTRIBUTE.finditer(attrs):
                name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
                if name == "role":
                    role = value.strip().lower()
                elif name in ("class", "id"):
                    names.append(value)
                    if name == "class":
                        classes.update(value.lower().split())
                elif name in ("hidden", "aria-hidden"):
                    hidden |= name == "hidden" or value.lower() == "true"
            words = {w.lower() for n in names for w in NAME_WORD.findall(n)}
        main = above.main or tag in MAIN or role == "main"
        hard = hidden or tag in NO_TEXT or role in NO_TEXT_ROLES or not main and tag == "header"
        if above.main:
            named = not NO_TEXT_CLASSES.isdisjoint(classes)
        else:
            named = not NO_TEXT_WORDS.isdisjoint(words) or not main and not NO_TEXT_OUTSIDE.isdisjoint(words)
            named &= tag not in NEVER_BY_NAME and role != "main"
        self._places.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.elements))
        self.elements.append(Element(tag, at, hard, named, main))
        self._hashes.append(xxhash.xxh64(f"<{tag} {' '.join(names)}>".encode()))

    def _close(self) -> None:
        at, state = self._stack.pop(), self._hashes.pop()
        element = self.elements[at]
        element.digest = state.intdigest()
        if self._hashes:
            self._places[element.tag].pop()
            self._hashes[-1].update(b"/" + state.digest())
            above = self.elements[element.parent]
            above.wraps |= element.wraps or element.main and not above.main
            above.size += element.size

    def _innermost(self, tags: Collection[str]) -> int:
        return max((places[-1] for t in tags if (places := self._places.get(t))), default=0)

    def _close_through(self, tags: Collection[str], within: Collection[str]) -> None:
        """Close up to the innermost open element of ``tags``, unless one of ``within`` stands before it."""
        k = self._innermost(tags)
        if k and self._innermost([t for t in within if t not in tags]) < k:
            while len(self._stack) > k:
                self._close()

    def _text(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            at = self._stack[-1]
            same = " ".join(text.split())
            self.elements[at].size += len(same)
            self._hashes[-1].update(same.encode("utf-8", "replace"))
            self.texts.append((at, text, self.breaks))

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = MARKUP.search(source, at)
            self._text(source[at : m.start()] if m else source[at:])
            if not m:
                return
            at = m.end()
            tag = (m.group("tag") or "").lower()
            if not tag:
                continue
            self.breaks += tag in BLOCKS
            if m.group("close"):
                if tag not in VOID:
                    self._close_through((tag,), () if tag in CLOSE_FAR else CLOSE_NEAR.get(tag, CLOSE_BOUNDS))
                continue
            if tag in ENDS:
                self._close_through(ENDS[tag], WITHIN[tag])
            elif tag in BLOCKS:  # a block ends an open paragraph
                self._close_through(("p",), NOT_P)
            if tag == "br":
                self.texts.append((self._stack[-1], " ", self.breaks))
            self._open(tag, m.group("attrs"))
            if tag in VOID:
                self._close()
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                at = end.end() if end else size
                self._close()

    def _templates(self) -> list[Element | None]:
        """For each element itself if it may be part of a template, else nothing.

        Outside the main part that is what does not hold it; inside, small elements that hold blocks.
        """
        most = sum(e.size for e in self._tops()) / SMALL
        return [
            e if (e.tag in HOLDERS and 0 < e.size <= most if e.main else not e.wraps and e.tag not in ("", "html", "body", "head", "br")) else None
            for e in self.elements
        ]

    def subtrees(self) -> tuple[set[int], int]:
        """Signed hashes of the subtrees that may be template, and what tells the page from copies of it: the hash of its
        main parts, or of all of it."""
        tops = [e.digest for e in self._tops()] or [self.elements[0].digest]
        own = xxhash.xxh64_intdigest(b"".join(d.to_bytes(8, "big") for d in tops))
        return {e.signed for e in self._templates() if e}, own - (1 << 64) if own >> 63 else own

    def main_text(self, template: Collection[int]) -> str:
        """Blocks in page order of all that is neither template nor other than main text by tag, role or name."""
        gone = [False]
        for e, own in zip(self.elements[1:], self._templates()[1:], strict=True):
            gone.append(gone[e.parent] or e.hard or e.named and not e.holds or own is not None and own.signed in template)
        kept = [(k, text, b) for k, text, b in self.texts if not gone[k]]
        blocks: list[str] = []
        last = None
        for _, text, block in kept:
            if block == last:
                blocks[-1] += text
            else:
                blocks.append(text)
                last = block
        return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def row_hash() -> Column:
    """Tells pages apart; equal pages are equal in all that matters."""
    return F.xxhash64("url", "html")


def subtree_hashes(rows: DataFrame) -> DataFrame:
    """(row, host, hash, own): the distinct subtrees of each page that may be template, and the hash of its main part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, hosts, found, owns = [], [], [], []
            for row, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, own = Page(source or "").subtrees()
                names += [row] * len(hashes)
                hosts += [host_of(url)] * len(hashes)
                found += hashes
                owns += [own] * len(hashes)
            columns = [pa.array(names, pa.int64()), pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(owns, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "host", "hash", "own"])

    return rows.select("row", "url", "html").mapInArrow(run, "row bigint, host string, hash bigint, own bigint")


def packed(rows: DataFrame) -> DataFrame:
    """(page, url, row, z): the pages, compressed for the one time they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            z = pa.array([squeeze((s.as_py() or "").encode()) for s in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], z], names=["page", "url", "row", "z"])

    return rows.select("page", "url", "row", "html").mapInArrow(run, f"page {rows.schema['page'].dataType.simpleString()}, url string, row bigint, z binary")


def main_texts(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", min_pages: int = 5) -> DataFrame:
    """(page, url, text) of every row: the main text without the site's template.

    A subtree is template if it occurs on at least ``min_pages`` different pages of a host; copies, pages with equal main
    parts, count once. Inside the main part only small elements that hold blocks can be template: paragraphs that
    articles share, and copied articles, stay. A null html has an empty text, pages without a host form a site of their
    own, repeated rows stay, other columns are not kept, an empty table gives no rows, and pages are read whole.
    """
    rows = pages.select(F.col(page).alias("page"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).withColumn("row", row_hash())
    parts = cut_lineage(subtree_hashes(rows), "subtrees")
    counts = parts.select("host", "hash", "own").distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    recurring = cut_lineage(counts.filter(F.col("n") >= min_pages).select("host", "hash"), "template")
    mine = parts.join(recurring, ["host", "hash"]).groupBy("row").agg(F.collect_set("hash").alias("template"))  # at most what the page has
    joined = packed(rows).join(mine, "row", "left").select("page", "url", "z", "template")
    kind = joined.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [Page(grow(z.as_buffer()).decode()).main_text(set(t.as_py() or ())) for z, t in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page", "url", "text"])

    return joined.mapInArrow(run, f"page {kind}, url string, text string").withColumnRenamed("page", page)
