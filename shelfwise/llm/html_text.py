"""Main text of web pages with a site style tree (operator 1).

Every page is parsed into blocks of text, each below a chain of style nodes (tag, class
and id of an element below its parent's style node). The pages of a host are merged into
one tree: for each style node, Spark counts how often each content (the texts of the
branch) and each presentation (its run of child styles) occurs on the host's distinct
pages. From the counts follow two entropies, normalised to 0..1; a node whose weighted
importance is low shows much the same on page after page, and its branch is taken out of
each page. The importances are pre-aggregated sums, so a host with most of the pages is
spread like any other; only nodes of low importance come back to the pages. All blocks
of a page are in the tree: navigation, footer, adverts, wrappers and the article alike.

What the tree leaves is then checked against what HTML itself names as outside the text
(navigation, header, footer, aside, form, script, hidden parts, roles, and whole names of
a class, or an id, that stand for adverts, comments, notices and the like; never the name of
the page's frame, of a heading or paragraph, nor of what an article or main part lies in). A page with an article is its
article; else its main part; else its body. The frame of a page (html, body, article, main),
headings, and paragraphs of an article or main part have an importance like any node, but
never go by it themselves; nor does anything on hosts of fewer than ``MIN_PAGES`` distinct pages.

Defined cases: null and empty html give an empty text; a null url or one without a host
belongs to host ''; cut-off and badly nested pages are read as far as they go; equal pages
count once in the tree; an empty table gives an empty result; other columns are kept by
``main_text`` unless they are named text or n_chars.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import checkpointed, table

#: Distinct pages a host needs; weight of content against presentation; nodes below this importance go.
MIN_PAGES, CONTENT_WEIGHT, LEAST = 8, 0.9, 0.1
#: Nodes deeper than this belong to the node at this depth.
DEPTH = 64
#: Hosts' noise lists that are broadcast at most (rows; a row lists the style nodes of one host).
MAX_BROADCAST = 20_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
             "table tbody tfoot thead tr caption ul title script style noscript template".split())
_SPACE = set("br td th img".split())
_OUT = set("script style noscript template nav footer aside form head title dialog menu button select option textarea input label "
           "fieldset iframe object embed svg canvas audio video map search xmp noembed noframes".split())
_OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar status".split())
#: Whole names of a class, or an id: those of a part that is never the text, and those that count outside articles and main parts.
_OUT_WORDS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments "
                 "commentlist disqus reply replies respond cookie cookies consent gdpr newsletter subscribe subscription popup modal overlay "
                 "share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager notice notices".split())
_WRAP_WORDS = set("sidebar menu nav navbar navigation header footer masthead banner widget widgets toolbar topbar aside".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Never taken out by their own importance: anywhere, and inside an article or main part.
_KEPT_TAGS = set("h1 h2 h3 h4 h5 h6 article main body html".split())
_KEPT_INSIDE = set("p blockquote pre".split())
#: Names of these say nothing about the text below them.
_NAMED_FREELY = set("html body main article p h1 h2 h3 h4 h5 h6".split())
_NUMBER = re.compile(r"[-_]*\d+$")
_DIGITS = re.compile(r"\d+")


class Page:
    """Blocks of a page: (text, chain of style nodes, outside the text, inside article, inside main)."""

    __slots__ = ("blocks", "children", "judged", "title", "links", "_begun")

    def __init__(self, source: str, whole: bool = False):
        """``whole`` keeps all visible text (only scripts and the like are left out)."""
        self.blocks: list[tuple[str, tuple[int, ...], bool, bool, bool]] = []
        self.children: dict[int, list[int]] = {}
        #: Style nodes that importance may take out: all but headings, the article's paragraphs and the frame of the page.
        self.judged: set[int] = set()
        self.title, self.links = "", []
        #: Whether an article has begun.
        self._begun = False
        self._parse(source, whole)

    def _parse(self, source: str, whole: bool) -> None:
        # An open element: tag, style node, chain, out by itself, out by a wrapper's word, in article, in main.
        stack = [("", 0, (), False, False, False, False)]
        parts: list[str] = []

        def flush() -> None:
            if parts:
                text = " ".join(_html.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    _, _, chain, out, wrapped, article, main = stack[-1]
                    self.blocks.append((text, chain, out or wrapped, article, main))

        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                parts.append(source[at:])
                break
            if m.start() > at:
                parts.append(source[at:m.start()])
            at = m.end()
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                continue
            if m["end"] or m["end2"]:
                if tag in _BLOCK:
                    flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        if tag not in _BLOCK and any(x[0] in _BLOCK for x in stack[k + 1:]):
                            break  # an inline end tag does not close blocks
                        del stack[k:]
                        break
                continue
            block = tag in _BLOCK
            if block:
                flush()
                if tag not in ("option", "optgroup"):
                    for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                        if stack[k][0] == "p":
                            del stack[k:]
                            break
                        if stack[k][0] in _BLOCK:
                            break
            if tag in _CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _CLOSES[tag]:
                        flush()
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                        break
            if tag in _SPACE:
                parts.append(" ")
            attrs = m["attrs"] or m["attrs2"] or ""
            _, node, chain, out, wrapped, article, main = stack[-1]
            if tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                inner = source[at:close.start() if close else end]
                if tag == "title" and not self.title:
                    self.title = " ".join(_html.unescape(inner).split())
                at = close.start() if close else end
                if close:
                    at = source.find(">", at) + 1 or end
                continue
            if tag in _VOID:
                continue
            name, own_out, own_wrap = tag, tag in _OUT, False
            if attrs:
                name, own_out, own_wrap = self._attributes(tag, attrs, own_out, article or main)
            if tag == "form" and not self._begun:
                own_out, own_wrap = False, True  # some sites put the whole page into a form
            if not block and not own_out and not own_wrap and not attrs:
                # Plain inline markup is no node of its own.
                stack.append((tag, node, chain, out, wrapped, article, main))
                continue
            child = hash_style(node, name) if len(chain) < DEPTH else node
            if child != node:
                if tag not in _KEPT_TAGS and not (tag in _KEPT_INSIDE and (article or main)):
                    self.judged.add(child)
                run = self.children.setdefault(node, [])
                if not run or run[-1] != child:
                    run.append(child)
            if own_out or own_wrap:
                flush()
            if tag in ("article", "main") and not own_out:
                wrapped = False  # only the name of some wrapper spoke against it
                self._begun |= tag == "article"
            if tag == "header" and not (article or main):
                own_wrap = True
            stack.append((tag, child, chain + (child,) if child != node else chain, out or own_out, wrapped or own_wrap,
                          article or tag == "article", main or tag == "main"))
        flush()

    def _attributes(self, tag: str, attrs: str, out: bool, inside: bool) -> tuple[str, bool, bool]:
        """Name of the style node, whether the element is out with all below it, whether it is up to an article in it.
        ``inside``: it lies in an article or main part."""
        got = {}
        for k, a, b, c in _ATTR.findall(attrs):
            got.setdefault(k.lower(), a or b or c)
        if tag == "a" and got.get("href"):
            self.links.append(_html.unescape(got["href"]))
        named = f"{got.get('class', '')} {got.get('id', '')}".strip()
        out = (out or "hidden" in got or got.get("aria-hidden") == "true" or got.get("role", "").lower() in _OUT_ROLES
               or bool(re.search(r"display\s*:\s*none", got.get("style", ""))))
        wrap = False
        if named and tag not in _NAMED_FREELY:
            # The id of a section is where links to it go.
            of = got.get("class", "") if tag == "section" else named
            names = {_NUMBER.sub("", w) for w in of.lower().split()}
            # Before any article the element may hold the article.
            wrap = not names.isdisjoint(_OUT_WORDS) or (not inside and not names.isdisjoint(_WRAP_WORDS))
            if wrap and self._begun:
                out = True
        return f"{tag}.{_DIGITS.sub('0', named)}" if named else tag, out, wrap

    def main(self, noise: frozenset[int] | set[int] = frozenset()) -> list[tuple[str, tuple[int, ...]]]:
        """What the tree leaves (no block below a node of ``noise``), and of that the blocks of the article, else of the
        main part, else of the body, without what is outside the text."""
        kept = [b for b in self.blocks if noise.isdisjoint(b[1]) and not b[2]]
        part = [b for b in kept if b[3]] or [b for b in kept if b[4]] or kept
        return [(b[0], b[1]) for b in part]


def hash_style(parent: int, name: str) -> int:
    """A style node's number: its name below its parent's."""
    import zlib

    raw = f"{parent}>{name}".encode()
    return (zlib.crc32(raw) << 31) ^ zlib.adler32(raw[::-1]) ^ zlib.crc32(raw[::-1])


def _hash(parts) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b("\n".join(map(str, parts)).encode(), digest_size=8).digest(), "little", signed=True)


def _nodes(batches):
    """Pages to all their style nodes: (host, page, node, judged, kind, shown): kind 0 content, 1 presentation."""
    for batch in batches:
        for k in range(0, batch.num_rows, 128):
            part = batch.slice(k, 128)
            rows = []
            for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                page = Page(source or "")
                # A text is hashed once, however deep it lies.
                below: dict[int, list[int]] = {}
                shown = []
                for text, chain, *_ in page.blocks:
                    shown.append(_hash((text,)))
                    for node in chain:
                        below.setdefault(node, []).append(shown[-1])
                if below:
                    whole = _hash(shown)
                    for node, texts in below.items():
                        judged = node in page.judged
                        rows.append((host, whole, node, judged, 0, _hash(texts)))
                        rows.append((host, whole, node, judged, 1, _hash(page.children.get(node, ()))))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()))],
                    names=["host", "page", "node", "judged", "kind", "shown"])


def _texts(names: list[str]):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                texts = []
                for source, noise in zip(part.column("html").to_pylist(), part.column("_noise").to_pylist()):
                    texts.append("\n".join(text for text, _ in Page(source or "").main(set(noise or ()))))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return run


def hosted(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))))


def node_importance(pages: DataFrame) -> DataFrame:
    """(host, node, judged, pages, importance) of all style nodes of every host; ``judged`` ones may go by it."""
    shown = hosted(pages).select("host", "html").mapInArrow(_nodes, "host string, page bigint, node bigint, judged boolean, kind int, shown bigint").distinct()
    counts = shown.groupBy("host", "node", "judged", "kind", "shown").agg(F.count(F.lit(1)).alias("c"))
    by_kind = (counts.groupBy("host", "node", "judged", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
               .withColumn("entropy", F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)))
    return by_kind.groupBy("host", "node", "judged").agg(
        F.max("m").alias("pages"),
        F.sum(F.when(F.col("kind") == 0, CONTENT_WEIGHT).otherwise(1 - CONTENT_WEIGHT) * F.col("entropy")).alias("importance"))


def main_text(pages: DataFrame, least: float = LEAST, min_pages: int = MIN_PAGES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``pages`` (page_id, url, html, ...) with text and n_chars in place of html."""
    names = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    noise = checkpointed(node_importance(pages).filter(F.col("judged") & (F.col("pages") >= min_pages) & (F.col("importance") < least))
                         # A host's style nodes: as many as its templates have.
                         .groupBy("host").agg(F.collect_set("node").alias("_noise")).withColumnRenamed("host", "_host"))
    if noise.count() <= max_broadcast:
        noise = F.broadcast(noise)
    joined = hosted(pages.withColumnRenamed("host", "_kept_host") if "host" in names else pages)
    joined = joined.join(noise, F.col("host") == F.col("_host"), "left").drop("host", "_host")
    if "host" in names:
        joined = joined.withColumnRenamed("_kept_host", "host")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema)
    return joined.select(*names, "html", "_noise").mapInArrow(_texts(names), f"{schema}, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
