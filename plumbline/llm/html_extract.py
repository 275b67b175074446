"""Main text of web pages by a site style tree.

The distinct pages of a host are merged into one tree.  An element node is a
path of tags and class names; the tree knows on how many pages it is, in which
sequences of children it is shown there (presentation), and which texts it
holds directly (content).  Entropy over the pages gives the importance of both:
what looks and reads the same everywhere is template, what differs is content.
The importance of a node is composed over its whole branch, from the leaves up,
and a branch that is unimportant together with everything in it is cut from
every page of the host.  A single text found on most pages of the host goes
too, outside lists, tables and headings, whose items repeat by nature.

Elements that are never part of an article (menus, forms, scripts, ...) go in
any case.  Pages of a host that have the same text left by these rules count as
one, so that copies of an article do not make it look like template.  Text
inside article or main elements is the page's text where there is any.

A node is judged when a tenth of its host's distinct pages (three at least)
have it.  A host has at most ten times as many such nodes as an average page,
however many pages there are: that bounds what is composed in one task and what
is looked up by the pages, which are parsed twice and never shuffled unless the
lookup table outgrows the bounds of a broadcast.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from html import unescape
from operator import xor

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize

#: Weight that each further presentation takes from the children of a node, and the importance under which it is template.
DAMPING = 0.9
LOW = 0.5
#: A node is judged from this share of the distinct pages of its host, and from so many pages.
JUDGED_SHARE, JUDGED_PAGES = 0.1, 3
#: Share of the pages on which one and the same text is template.
TEXT_SHARE = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes svg".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = frozenset("html body article main".split())
#: Never cut by themselves inside an article, only with the branch they belong to.
LABELS = HEADINGS | frozenset("th dt caption figcaption".split())
#: Their texts repeat over pages by nature.
ITEMS = LABELS | frozenset("li dd td".split())
#: Their ids are anchors of the text.
ANCHORS = ITEMS | frozenset("p pre blockquote a".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul xmp".split()
)
NEVER = frozenset("nav footer aside form button select option optgroup datalist label dialog menu head object embed audio video canvas map fieldset legend input".split()) | RAW
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption body html head li dd dt option optgroup summary figcaption legend".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("table ul ol dl menu article section main div body html".split())
#: Words in class, id and role names of what is not an article.
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adbox adslot banner banners promo promotion promoted sponsor sponsored sponsors sidebar sidebars menu menus navbar nav navigation "
    "breadcrumb breadcrumbs masthead topbar footer footers cookie cookies consent gdpr notice notices notification alert popup popups modal overlay newsletter subscribe subscription signup login signin search "
    "searchbox share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies widget widgets toolbar pagination pager skip copyright legal disclaimer "
    "contentinfo complementary dialog discussion form hidden tags tagcloud trending popular".split()
)
#: Closing tags that end everything opened inside their element.
CLOSED = frozenset("html body article main div section nav footer aside header form table ul ol".split())
HEADS = frozenset("header site-header page-header".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']*(?:\"[^\"]*\"|'[^']*'))*[^>\"']*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=\s|/|$))", re.I)
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
#: Numbers of items in class names, which differ from page to page.
_DIGITS = re.compile(r"(?<=[-_])\d+|\d{2,}")


class Node:
    """An open element: its key in the tree, the nearest block around its text, and what it inherits."""

    __slots__ = ("tag", "key", "home", "depth", "bad", "mute", "inside", "children")

    def __init__(self, tag: str, key: int, home: Node | None, depth: int, bad: bool, mute: bool, inside: bool):
        self.tag, self.key, self.home, self.depth, self.bad, self.mute, self.inside, self.children = tag, key, home or self, depth, bad, mute, inside, []


def _judge(tag: str, attrs: str, parent: Node) -> tuple[str, bool]:
    """The node's name in the style tree, and whether it can never hold article text."""
    bad = tag in NEVER or tag == "header" and not parent.inside
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return tag, bad
    name = tag
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role"):
            if key == "class":
                name = f"{tag}.{_DIGITS.sub('', value)}"
            if tag in HEADINGS or key == "id" and (tag in ANCHORS or tag == "section" and parent.inside):
                continue
            parts = {p.lower() for p in _PART.findall(value)}
            if tag not in ROOTS:
                bad = bad or not CUES.isdisjoint(parts) or not parent.inside and bool(parts & HEADS)
            elif "comment" in parts or "comments" in parts:
                bad = bad or tag == "article"
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            bad = True
    return name, bad


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text, seed)


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def parse(html: str, low: frozenset[int] = frozenset(), shown: list | None = None) -> list[tuple[Node, int, bool, str]]:
    """Blocks of text in page order: their element, their key among its texts, removed or not, text.

    A block is removed by its kind or because its branch or itself is in
    ``low``.  ``shown`` takes every block element with the hash of its sequence
    of children when it closes.  A muted inline element (a button, a hidden
    span) leaves its paragraph whole but for its own text.
    """
    root = Node("", 0, None, 0, False, False, False)
    stack, blocks, buffer = [root], [], []

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                node = stack[-1].home
                key = _hash(text, node.key)
                blocks.append((node, key, node.bad or key in low and node.tag not in ITEMS, text))

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if shown is not None and node.home is node:
                shown.append((node, stack[-1].home, _hash(",".join(dict.fromkeys(node.children)))))

    def pop(tags, scope) -> None:
        for d in range(len(stack) - 1, 0, -1):
            if stack[d].tag in tags:
                return close(d)
            if stack[d].tag in scope:
                return None

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1].mute:
            piece = html[at:stop]
            buffer.append(unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        slash, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag or not html.endswith(">", m.start(), at):
            continue
        tag = tag.lower()
        block = tag in BLOCK
        if slash:
            if block and not stack[-1].mute:
                flush()
            pop((tag,), () if tag in CLOSED else ("table",))
            continue
        if block:
            if not stack[-1].mute:
                flush()
            if tag in CLOSES_P:
                pop(("p",), ("table", "td", "th", "button", "object"))
            if tag in SAME:
                pop(SAME[tag], SCOPE)
        elif tag == "br" and not stack[-1].mute:
            buffer.append(" ")
        if tag in RAW or tag == "xmp":
            m = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            if tag == "xmp" and not stack[-1].mute:
                buffer.append(html[at : m.start() if m else end])
                flush()
            at = m.end() if m else end
            continue
        if tag in VOID or attrs.endswith("/") and not block:
            continue
        parent = stack[-1]
        name, bad = _judge(tag, attrs, parent)
        key = _hash(name, parent.key)
        bad = bad or key in low
        parent.home.children.append(name)
        inside = (parent.inside or tag in ("article", "main")) and not (parent.bad or bad)
        stack.append(Node(tag, key, None if block else parent.home, parent.depth + 1, parent.bad or bad, parent.mute or bad and not block, inside))
    flush()
    close(1)
    return blocks


def _article(blocks: list[tuple[Node, int, bool, str]]) -> list[tuple[Node, str]]:
    """The blocks that stay: those inside articles where there are any."""
    good = [(node, text) for node, _, removed, text in blocks if not removed]
    return [x for x in good if x[0].inside] or good


def main_text(html: str, low: frozenset[int] = frozenset()) -> str:
    """The article of a page without the branches and texts whose keys are in ``low``.

    Where that would leave nothing of an article that is marked as one, the tree has no say.
    """
    kept = _article(parse(html, low))
    if not kept and low:
        kept = [x for x in _article(parse(html)) if x[0].inside]
    return "\n\n".join(text for _, text in kept)


_PAGE = "page_id long, host long, same long, nodes array<struct<node:long,parent:long,depth:int,fixed:boolean,style:long>>, texts array<struct<node:long,text:long>>"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a page adds to the tree of its host, and a hash of the text it has without the tree."""
    node_type = pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("fixed", pa.bool_()), ("style", pa.int64())])
    text_type = pa.struct([("node", pa.int64()), ("text", pa.int64())])
    for batch in batches:
        same, nodes, texts = [], [], []
        for html in batch.column("html"):
            shown = []
            blocks = parse(html.as_py() or "", shown=shown)
            same.append(_signed(_hash("\n\n".join(text for _, text in _article(blocks)))))
            looks: dict[int, tuple[Node, Node, set[int]]] = {}
            for n, up, style in shown:
                looks.setdefault(n.key, (n, up, set()))[2].add(style)
            # A page shows a node in one presentation: all the sequences of children it has there.
            nodes.append([{"node": _signed(k), "parent": _signed(up.key), "depth": n.depth, "fixed": n.tag in ROOTS or n.inside and n.tag in LABELS, "style": _signed(reduce(xor, styles))} for k, (n, up, styles) in sorted(looks.items())])
            texts.append([{"node": _signed(k), "text": _signed(t)} for k, t in sorted({(node.key, key) for node, key, _, _ in blocks})])
        columns = [batch.column("page_id"), batch.column("host"), pa.array(same, pa.int64()), pa.array(nodes, pa.list_(node_type)), pa.array(texts, pa.list_(text_type))]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "same", "nodes", "texts"])


def noise(nodes: list[dict], low: float = LOW) -> list[int]:
    """Roots of the branches to cut, among the judged nodes of a host.

    A node with ``styles`` presentations of entropy ``presentation`` has the
    importance (1 - d^styles) * presentation + d^styles * (mean importance of
    its texts and children, by pages).  Children too rare to be judged count as
    important, with their pages ``loose``.  A branch is cut where its root and
    every judged node in it with text below is under ``low``.
    """
    total, weight, clean = defaultdict(float), defaultdict(float), defaultdict(bool)
    noisy = {}
    for n in sorted(nodes, key=lambda n: -n["depth"]):
        key, up = n["node"], n["parent"]
        w = weight[key] + n["loose"] + n["texts"]
        if not w:
            continue
        inner = (total[key] + n["loose"] + n["texts"] * n["content"]) / w
        share = DAMPING ** n["styles"]
        value = (1 - share) * n["presentation"] + share * inner
        important = clean[key] or value >= low
        clean[up] = clean[up] or important
        total[up] += value * n["pages"]
        weight[up] += n["pages"]
        if not important:
            noisy[key] = up, n["fixed"]
    return [key for key, (up, fixed) in noisy.items() if not fixed and (up not in noisy or noisy[up][1])]


def _noise(low: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [noise(nodes, low) for nodes in batch.column("nodes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.list_(pa.int64()))], ["host", "low"])

    return run


class StyleTree:
    """The merged tree of every host of ``pages`` (page_id, host, html): tables of hosts, nodes and texts."""

    def __init__(self, pages: DataFrame):
        facts = pages.mapInArrow(_facts, _PAGE).withColumn("row", F.monotonically_increasing_id()).withColumn("body", F.xxhash64("nodes", "texts"))
        facts = materialize(facts, "facts")
        # One page of each text, the same in every run; only the keys of pages are shuffled.
        copied = facts.groupBy("host", "same").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "body", "row")).alias("first")).filter("n > 1")
        pages = lookup(facts, copied.select("host", "same", F.col("first.row").alias("one")), ["host", "same"], F.col("row")).filter("one is null or one = row")
        self.hosts = pages.groupBy("host").agg(F.count("*").alias("host_pages")).filter(F.col("host_pages") >= JUDGED_PAGES)
        self.styles = pages.select("host", F.explode("nodes").alias("x")).select("host", "x.*").groupBy("host", "node", "parent", "depth", "fixed", "style").agg(F.count("*").alias("n"))
        self.texts = pages.select("host", F.explode("texts").alias("x")).select("host", "x.*").groupBy("host", "node", "text").agg(F.count("*").alias("n"))

    def nodes(self) -> DataFrame:
        """(host, node, parent, depth, fixed, pages, judged, styles, presentation, texts, content) of the hosts that can be judged.

        Entropies are to the base of the node's pages: presentation is that of
        its sequences of children; content is 1 less the mean entropy of a text
        over the pages, 0 where all pages have the same.
        """
        n = F.col("n").cast("double")
        rows = self.styles.groupBy("host", "node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.max("fixed").alias("fixed"), F.sum("n").alias("pages"), F.count("*").alias("styles"), F.sum(n * F.ln(n)).alias("same"))
        rows = lookup(rows, self.hosts, ["host"], F.col("node"), "inner")
        words = self.texts.groupBy("host", "node").agg(F.sum("n").alias("shows"), F.avg(F.ln(n)).alias("spread"))
        rows = rows.join(words, ["host", "node"], "left")
        pages = F.col("pages").cast("double")
        base = F.when(F.col("pages") > 1, F.ln(pages))
        return rows.select(
            *("host", "node", "parent", "depth", "fixed", "pages"),
            (F.col("pages") >= F.greatest(F.lit(float(JUDGED_PAGES)), JUDGED_SHARE * F.col("host_pages"))).alias("judged"),
            F.least("styles", F.lit(1000)).cast("int").alias("styles"),
            F.coalesce((F.ln(pages) - F.col("same") / pages) / base, F.lit(1.0)).alias("presentation"),
            F.least(F.coalesce("shows", F.lit(0)), "pages").alias("texts"),
            F.coalesce(1 - F.col("spread") / base, F.lit(1.0)).alias("content"),
        )

    def template(self, low: float = LOW) -> DataFrame:
        """(host, low): keys of the branches and texts to cut from the pages of a host."""
        nodes = materialize(self.nodes(), "nodes")
        loose = nodes.filter("NOT judged").groupBy("host", "parent").agg(F.sum("pages").alias("loose")).withColumnRenamed("parent", "node")
        judged = nodes.filter("judged").drop("judged").join(loose, ["host", "node"], "left").withColumn("loose", F.coalesce("loose", F.lit(0)))
        row = F.struct(*(c for c in judged.columns if c != "host"))
        branches = judged.groupBy("host").agg(F.collect_list(row).alias("nodes")).mapInArrow(_noise(low), "host long, low array<long>")
        often = lookup(self.texts.filter(F.col("n") >= JUDGED_PAGES), self.hosts, ["host"], F.col("text"), "inner")
        often = often.filter((F.col("n") >= TEXT_SHARE * F.col("host_pages")) & (1 - F.ln(F.col("n").cast("double")) / F.ln(F.col("host_pages").cast("double")) < low))
        rows = branches.select("host", F.explode("low").alias("key")).unionByName(often.select("host", F.col("text").alias("key")))
        return rows.groupBy("host").agg(F.array_sort(F.collect_set("key")).alias("low"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, keys = None, frozenset()
    for batch in batches:
        texts = []
        for html, low in zip(batch.column("html"), batch.column("low").to_pylist()):
            if low != last:
                last, keys = low, frozenset(k % (1 << 64) for k in low or ())
            texts.append(main_text(html.as_py() or "", keys))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, low: float = LOW) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null or empty html is an empty page with an empty text; a text of any
    length is parsed whole.  Pages without a host in their url (null urls too)
    belong to no site and are judged by their elements alone, as are pages of a
    host of fewer than three distinct pages.  Rows that repeat a page_id are
    pages like any other.  Other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.when(host != "", F.xxhash64(host)).alias("host"))
    template = StyleTree(rows.filter("host is not null").select("page_id", "host", "html")).template(low)
    rows = lookup(rows, template, ["host"], F.col("page_id")).select("page_id", "url", "html", "low")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
