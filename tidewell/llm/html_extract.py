"""Extract the main text of web pages with wrappers induced from pages of the same host.

1. Of each host, one page is the pivot of the alignment: of up to ``PIVOTS`` pages taken by hash, the first that has text.
2. Every page's DOM tree is aligned with its host's pivot by simple tree matching, in which consecutive
   siblings of one tag are one repeated slot. A text block in a slot that the pivot has too is reported as
   (host, slot, hash of its text), and every block, with or without such a slot, as (host, chain of its tags, hash of its text).
3. Over all pages of the host (exact copies of a page count once) these are counted. A text that at least ``SHARE`` of the host's
   pages, and no fewer than ``LEAST`` of them, have in the same slot is constant: it is template. What varies is content.
   Where the pivot lacks a text's slot on some page, or has it beyond ``DEPTH``, the chain of tags is its slot, so no text that is
   constant goes unseen for the choice of the pivot.
4. The wrapper is the host's set of constant (slot, hash) pairs, at most 1 / SHARE for each block of a page.

Elements that are boilerplate by their meaning (menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts: by tag or role, and divisions whose whole class or id names one of these) never are content, however they vary. A comment left open reaches
to the page's end. Matching keeps two rows of weights and two bits for each pair of siblings, and trees of equal structure are weighed once, so long lists stay cheap. Pages of a host that has too few pages for a wrapper are read by meaning
alone: only there, if a page marks its article, nothing else of it is content.

Null html counts as empty; an empty or markup-only page has empty text. Repeated rows are pages of their own. A null or
unparsable url has no host and so no wrapper.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import materialize, maybe_broadcast, tidied

#: A text is template if this share of the host's distinct pages, and so many of them, have it in one slot.
SHARE, LEAST = 0.6, 5
#: Pages of a host that are tried as its pivot; levels of a tree that are aligned.
PIVOTS, DEPTH = 8, 64

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style noscript template iframe object embed canvas svg math audio video head title nav footer aside form button input select textarea label fieldset menu dialog header".split())
CLOSES_P = BLOCKS - frozenset(["body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li"])
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
# Words that say of an element of no meaning that it is boilerplate, if its class or id is made of nothing else but words of place; and roles that do.
MARKS = frozenset("ad ads advert adverts advertisement banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header footer masthead sidebar widget widgets cookie cookies consent notice newsletter subscribe popup modal share sharing social related recommended comment comments disqus replies login signup search copyright legal hidden".split())
PLACES = frozenset("site page main top left right bottom global primary secondary bar box block wrapper container section inner list links area side".split())
ROLES = frozenset("banner complementary contentinfo navigation search".split())
PLAIN = frozenset("div section span ul ol dl table".split())
SPACES = re.compile(r"[\s\x1c-\x1f]+")


class Node:
    __slots__ = ("tag", "children", "texts", "drop", "article")

    def __init__(self, tag: str, drop: bool = False, article: bool = False):
        self.tag, self.children, self.drop, self.article = tag, [], drop, article  # children: nodes and strings, in order


def marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element's role, or a whole class or id of it, names boilerplate. One word of a longer name (related-work) does not, nor any on a paragraph or heading."""
    for key, value in attrs:
        if key == "role" and value and value.lower() in ROLES:
            return True
        if key in ("class", "id") and value and tag in PLAIN:
            for name in value.lower().split():
                parts = set(re.split(r"[-_]+", name)) - {""}
                if parts & MARKS and parts <= MARKS | PLACES:
                    return True
    return False


class Builder(HTMLParser):
    """A tree of block elements; inline elements leave their text in the block. Unclosed blocks are closed as HTML says."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.stack = [self.root]
        self.skipped: list[str] = []  # open inline elements whose text is no content

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") or self.skipped and tag not in BLOCKS:
            if self.skipped and tag not in VOID and tag not in ("html", "body"):
                self.skipped.append(tag)
            return
        if tag == "br":
            self.stack[-1].children.append(" ")
            return
        if tag not in BLOCKS and tag not in DROPPED:
            if tag not in VOID and marked(tag, attrs):
                self.skipped.append(tag)
            return
        self.skipped.clear()
        if tag in CLOSES_P:
            self._close(("p",), ("article", "section", "div", "td", "th", "li", "main", "blockquote", "table", "button"))
        if tag in SAME:
            self._close(SAME[tag], SCOPE[tag])
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs)
        own = tag in ("article", "main") or any(k == "role" and v in ("main", "article") for k, v in attrs)
        drop = tag in DROPPED and not (tag == "header" and self._inside("article", "main")) or hidden or (not own and marked(tag, attrs))
        node = Node(tag, drop, own or any(k == "itemprop" and v == "articleBody" for k, v in attrs))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def _inside(self, *tags) -> bool:
        return any(n.tag in tags for n in self.stack)

    def _close(self, tags, scope) -> None:
        """Close the innermost open one of tags, unless an element of scope stands between."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in scope:
                return

    def handle_endtag(self, tag):
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
            if tag not in BLOCKS:
                return
            self.skipped.clear()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def parse_html_declaration(self, i):
        """What begins with '<![' is a comment up to its '>', as HTML says; the base class fails on an unknown word there."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def parse_comment(self, i, report=1):
        """A comment that is never closed reaches to the page's end, as HTML says."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end

    def handle_data(self, data):
        if not self.skipped:
            self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def text_blocks(root: Node) -> list[tuple[str, Node, tuple, bool]]:
    """(text, node, path, inside) of the blocks that may be content, in page order. path: tags, each with its number among its parent's runs of that tag. inside: in a marked article."""
    found: list[tuple[str, Node, tuple, bool]] = []
    stack: list = [("open", root, (), False)]
    while stack:
        what, node, path, inside = stack.pop()
        if what == "text":
            found.append((node, *path, inside))
            continue
        if node.drop:
            continue
        inside = inside or node.article
        todo, run, part = [], [], 0
        last, runs = None, Counter()

        def end(node=node, path=path, inside=inside, todo=todo, run=run):
            text = SPACES.sub(" ", "".join(run)).strip()
            if text:
                todo.append(("text", text, (node, (*path, "#")), inside))
            run.clear()

        for child in node.children:
            if isinstance(child, str):
                run.append(child)
            else:
                end()
                if child.tag != last:
                    last = child.tag
                    runs[last] += 1
                todo.append(("open", child, (*path, f"{last}.{runs[last] - 1}"), inside))
        end()
        stack.extend(reversed(todo))
    return found


def runs(node: Node) -> list[tuple[str, list[Node]]]:
    """Children elements as repeated slots: consecutive ones of one tag together."""
    out: list[tuple[str, list[Node]]] = []
    for c in node.children:
        if not isinstance(c, str):
            if out and out[-1][0] == c.tag:
                out[-1][1].append(c)
            else:
                out.append((c.tag, [c]))
    return out


class Shape:
    """A tree in which each run of siblings of one tag is one node, with the union of their children's runs: equal are the n-th runs of a tag."""

    __slots__ = ("tag", "parts", "size", "slot", "key")

    def __init__(self, tag: str, nodes: list[Node], slot: str = "", depth: int = 0):
        self.tag, self.slot, self.parts = tag, slot, []
        if depth < DEPTH:
            merged: dict[tuple[str, int], list[Node]] = {}  # in the order in which runs are first met
            for n in nodes:
                number: Counter[str] = Counter()
                for t, own in runs(n):
                    merged.setdefault((t, number[t]), []).extend(own)
                    number[t] += 1
            self.parts = [Shape(t, own, f"{slot}/{t}.{i}", depth + 1) for (t, i), own in merged.items()]
        self.sum_up()

    def sum_up(self) -> None:
        """size, and key: equal for trees of equal structure."""
        self.size = 1 + sum(p.size for p in self.parts)
        self.key = xxhash.xxh64_intdigest(" ".join([self.tag, *(str(p.key) for p in self.parts)]))


def weight(a: Shape, b: Shape, known: dict[tuple[int, int], int]) -> int:
    """Simple tree matching: the largest number of nodes of a and b that match in order. known: weights of trees by their structure, of which a page repeats few."""
    if a.tag != b.tag:
        return 0
    if not a.parts or not b.parts:
        return 1
    if (a.key, b.key) not in known:
        known[a.key, b.key] = 1 + in_order(a.parts, b.parts, known)[0]
    return known[a.key, b.key]


def in_order(a: list[Shape], b: list[Shape], known: dict[tuple[int, int], int], paired: bool = False) -> tuple[int, list[tuple[int, int]]]:
    """Largest weight of pairs of a and b in order, and if asked these pairs. Two rows of weights and two bits for each cell are kept."""
    kinds = [{s.key: s for s in side} for side in (a, b)]
    each = np.array([[weight(x, y, known) for y in kinds[1].values()] for x in kinds[0].values()])
    own, other = (np.array([{k: i for i, k in enumerate(kind)}[s.key] for s in side]) for kind, side in zip(kinds, (a, b), strict=True))
    row, takes, ups = np.zeros(len(b) + 1, np.int64), [], []
    for i in own.tolist():
        w = each[i][other]
        across = row[:-1] + w
        new = np.zeros(len(b) + 1, np.int64)
        np.maximum.accumulate(np.maximum(row[1:], across), out=new[1:])
        if paired:
            takes.append(np.packbits((w > 0) & (new[1:] == across)))
            ups.append(np.packbits(new[1:] == row[1:]))
        row = new
    pairs, i, j = [], len(a), len(b)
    while paired and i and j:
        at, bit = (j - 1) >> 3, 0x80 >> ((j - 1) & 7)
        if takes[i - 1][at] & bit:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif ups[i - 1][at] & bit:
            i -= 1
        else:
            j -= 1
    return int(row[-1]), pairs


def match(a: Shape, b: Shape, pairs: dict[str, str], known: dict[tuple[int, int], int] | None = None) -> int:
    """`weight`; pairs gets a's slot: b's slot of a best matching."""
    known = {} if known is None else known
    if a.tag != b.tag:
        return 0
    pairs[a.slot] = b.slot
    if a.parts and b.parts:
        for i, j in in_order(a.parts, b.parts, known, True)[1]:
            match(a.parts[i], b.parts[j], pairs, known)
    return weight(a, b, known)


def aligned(root: Node, pivot: Shape | None) -> list[tuple[str, str | None, str, bool]]:
    """Text blocks of a page with the pivot's slot that each aligns with, if any, the chain of its tags, and whether an article holds it."""
    pairs: dict[str, str] = {}
    if pivot is not None:
        match(Shape("html", [root]), pivot, pairs)
    return [(t, pairs.get("".join(f"/{x}" for x in path[:-1])), "#" + "/".join(x.partition(".")[0] for x in path[:-1]), inside) for t, _, path, inside in text_blocks(root)]


def dump(shape: Shape) -> list:
    return [shape.tag, [dump(p) for p in shape.parts]]


def load(tree: list, slot: str = "") -> Shape:
    shape = Shape(tree[0], [], slot)
    shape.parts = [load(p, f"{slot}/{p[0]}{i}") for i, p in enumerate(tree[1])]
    shape.sum_up()
    return shape


def block_hash(slot: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{slot}\0{text}") - (1 << 63)


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html and a hash of the host, null if the url names none."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.when(host != "", F.xxhash64(host)).alias("host"))


def pivots(pages: DataFrame, least: int) -> DataFrame:
    """host, shape: the tree of one page with text of each host that has enough pages, as JSON."""
    place = F.xxhash64("page_id", "url", "html")
    own = pages.where("host IS NOT NULL").groupBy("host", F.pmod(place, F.lit(PIVOTS)).alias("part"))
    tried = materialize(own.agg(F.min(F.when(F.trim("html") != "", place)).alias("place"), F.count(F.lit(1)).alias("n")), "tried")
    hosts = tried.groupBy("host").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("host")
    tried = maybe_broadcast(materialize(tried.where("place IS NOT NULL").join(hosts, "host").select("host", "place"), "hosts"))
    chosen = pages.withColumn("place", place).join(tried, ["host", "place"]).select("host", "place", "html")

    def shapes(batches):
        for batch in batches:
            roots = [parse(h) for h in batch.column("html").to_pylist()]
            trees = [json.dumps(dump(Shape("html", [r]))) if text_blocks(r) else None for r in roots]
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "place": batch.column("place"), "shape": pa.array(trees, pa.string())})

    found = chosen.mapInArrow(tidied(shapes), "host long, place long, shape string").where("shape IS NOT NULL")
    return found.groupBy("host").agg(F.min(F.struct("place", "shape")).alias("first")).select("host", "first.shape")


class Shapes:
    """The pivots' shapes by their JSON, as a task meets them."""

    def __init__(self):
        self.known: dict[str, Shape] = {}

    def of(self, text: str | None) -> Shape | None:
        if text is None:
            return None
        if text not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[text] = load(json.loads(text))
        return self.known[text]


def blocks(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """page_id, url, host, page (a hash of the html) and blocks: the text blocks with the hashes of slot and text, null outside the pivot's slots, and of chain and text, and whether an article holds them."""
    fields = [pages.schema["page_id"], pages.schema["url"], T.StructField("host", T.LongType()), T.StructField("page", T.LongType())]
    schema = T.StructType([*fields, T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("block", T.LongType()), T.StructField("chain", T.LongType()), T.StructField("text", T.StringType()), T.StructField("inside", T.BooleanType())])))])

    def rows(batches):
        shapes = Shapes()
        for batch in batches:
            out = [[(None if slot is None else block_hash(slot, t), block_hash(chain, t), t, i) for t, slot, chain, i in aligned(parse(html), shapes.of(shape))] for html, shape in zip(batch.column("html").to_pylist(), batch.column("shape").to_pylist(), strict=True)]
            at = np.cumsum([0, *map(len, out)])
            inner = pa.StructArray.from_arrays([pa.array([b[i] for x in out for b in x], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.bool_()))], ["block", "chain", "text", "inside"])
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("page_id", "url", "host", "page")} | {"blocks": pa.ListArray.from_arrays(pa.array(at, pa.int32()), inner)})

    joined = pages.join(maybe_broadcast(chosen), "host", "left")
    return joined.select("page_id", "url", "host", F.xxhash64("html").alias("page"), "html", "shape").mapInArrow(tidied(rows), schema)


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """page_id, url, text, n_chars of each page. Each page is parsed once; what follows works on its blocks."""
    pages = with_host(pages)
    chosen = materialize(pivots(pages, least), "pivots")
    read = materialize(blocks(pages, chosen), "blocks")
    # exact copies of a page count once: rows are distinct by (block, page) before they are counted
    # lacks: whether the key may decide: a slot always, a chain if on some page its block is outside the pivot's slots
    slots = F.transform("blocks", lambda b: F.struct(b["block"].alias("block"), F.lit(True).alias("lacks")))
    chains = F.transform("blocks", lambda b: F.struct(b["chain"].alias("block"), b["block"].isNull().alias("lacks")))
    seen = read.where("host IS NOT NULL").select("host", "page", F.inline(F.array_distinct(F.concat(slots, chains)))).where("block IS NOT NULL")
    seen = seen.groupBy("host", "page", "block").agg(F.max("lacks").alias("lacks"))
    counted = seen.groupBy("host", "block").agg(F.count(F.lit(1)).alias("n"), F.max("lacks").alias("lacks")).where((F.col("n") >= least) & F.col("lacks"))
    number = read.where("host IS NOT NULL").select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    template = counted.join(number, "host").where(F.col("n") >= share * F.col("pages")).groupBy("host").agg(F.collect_list("block").alias("template"))
    wrappers = number.where(F.col("pages") >= least).join(template, "host", "left").select("host", F.coalesce("template", F.array().cast("array<long>")).alias("template"))
    wrappers = materialize(wrappers, "wrappers")
    alone = F.col("template").isNull() & F.exists("blocks", lambda b: b["inside"])
    content = F.filter("blocks", lambda b: ~(alone & ~b["inside"]) & ~(F.coalesce(F.array_contains("template", b["block"]), F.lit(False)) | F.coalesce(F.array_contains("template", b["chain"]), F.lit(False))))
    text = F.array_join(F.transform(content, lambda b: b["text"]), "\n")
    return read.join(maybe_broadcast(wrappers), "host", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
