"""Main text of web pages by site style trees.

All pages of a host are merged into one tree of element nodes; a node is named by the way to it, by its classes, and by its
place among its like if it has none. For each node the pages give two entropies: that of its presentation (how its
child sequences are spread over the pages) and that of its content (how far each text below it is spread over the pages; a
text that stands on every page has entropy 1). A node's importance is

    (1 - G^l) * presentation + G^l * mean over the texts below of (1 - entropy), weighted by their words

with l the number of presentations. Pages of a host that are alike count once, and a host of few pages leans on what the
same nodes are like elsewhere: its figures are shrunk towards those of all hosts.

The tree decides in two ways. A branch of low importance goes. And where nearly all that is new below a node lies in one
of its containers, that container holds the article, and containers beside it with little of their own (words a page times
importance) go: short advertisements and footers differ from page to page, but hold little. Words below an article or main
element count more there, and no branch inside such an element goes. Apart from that, elements go whose kind, role or
whole class name says that they are no article: menus, forms, scripts, comments and the like.

Pages are parsed in one pass whose time is linear in their length, however tags and quotes are nested.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm.common import forget, hash_texts, map_batches, small, table, written

G = 0.9
#: Pages that the figures of all hosts count for beside a host's own.
PRIOR_PAGES = 4.0
#: A branch goes below this importance, and a container below this share of the largest one beside it.
LOW, SHARE = 0.4, 0.2
#: A container holds the article if it has this share of what is new below its parent, and if so few new words a page
#: stand in the parent itself.
MOST, DIRECT = 0.5, 1.0
#: Words inside an article or main element count so many times.
MARKED = 4
#: Low branches up to this number are broadcast to the tasks (under 10 MB); beyond it they are joined by host.
BROADCAST_PATHS = 100_000
#: Every level of the first ones has its own nodes; further down those at twice the depth, and so on.
LEVELS = 24

# Element kinds.
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROP = RAW | frozenset("head nav footer aside form button select option object embed canvas svg math audio video dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar alertdialog".split())
# Whole class names and ids of what is no article, and those that are so outside an article only.
MARKS = frozenset("ad ads advert advertisement advertising breadcrumb breadcrumbs comment comments comment-list commentlist comments-area consent cookie cookies cookie-banner cookie-notice footer gdpr menu nav navbar navigation newsletter notice pagination popup promo related related-posts share sharing share-buttons sidebar site-footer site-header social social-share sponsored subscribe toolbar widget".split())
OUTER_MARKS = frozenset("header masthead banner page-header main-nav".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
STOPS = frozenset("ul ol dl table article section div body main td th".split())
#: Elements that hold text themselves rather than lay out others.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption dt dd li address hr caption legend summary".split())

OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
# What follows a tag's name. Quotes count after a = only, and no part can match in two ways, so it is linear.
REST = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)>""")
ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
END_OF_RAW = {tag: re.compile(rf"</{tag}(?![a-z0-9:-])", re.IGNORECASE) for tag in RAW}


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in ATTR.finditer(raw)} if raw and not raw.isspace() else {}


def is_boilerplate(tag: str, at: dict[str, str], inside: bool) -> bool:
    if tag in DROP or (tag == "header" and not inside):
        return True
    if not at:
        return False
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true":
        return True
    if at.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", at.get("style", "").lower()):
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    names = f"{at.get('class', '')} {at.get('id', '')}".lower().split()
    return any(n in MARKS or (not inside and n in OUTER_MARKS) for n in names)


@lru_cache(maxsize=1 << 16)
def node_id(parent: int, name: str) -> int:
    return int.from_bytes(blake2b(f"{parent}/{name}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Open:
    """An open block element."""

    __slots__ = ("tag", "node", "chain", "depth", "inside", "bad", "kids", "scope", "inline", "open_inline", "hidden", "names")

    def __init__(self, tag, node, chain, depth, inside, bad, scope):
        self.tag, self.node, self.chain, self.depth, self.inside, self.bad, self.scope = tag, node, chain, depth, inside, bad, scope
        self.kids: dict[str, int] = {}
        self.inline: list[tuple[str, bool]] = []  # open inline elements, and whether they are boilerplate
        self.open_inline: Counter = Counter()
        self.hidden = 0
        self.names: list[str] = []


class Page:
    """Blocks of a page outside boilerplate elements: (chain of nodes, inside an article or main element, text)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple[int, ...], bool, str]] = []
        self.styles: dict[int, list[str]] = {}
        #: node: (its parent, whether it is a container, whether it is inside an article, chain)
        self.nodes: dict[int, tuple[int, bool, bool, tuple[int, ...]]] = {}
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack = [Open("", 0, (0,), 0, False, False, Counter())]
        count: Counter = Counter()  # open blocks by tag
        text: list[str] = []
        quoted = True  # whether quotes are paired; not after a tag that they would never end

        def flush():
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    self.blocks.append((stack[-1].chain, stack[-1].inside, joined))
                text.clear()

        def pop():
            gone = stack.pop()
            count[gone.tag] -= 1
            gone.scope[gone.tag] -= 1

        def shown():
            return not (stack[-1].bad or stack[-1].hidden)

        at, size = 0, len(source)
        while at < size:
            m = OPEN.search(source, at)
            piece = source[at : m.start()] if m else source[at:]
            if piece and shown():
                text.append(entities.unescape(piece) if "&" in piece else piece)
            if not m:
                break
            at = m.end()
            if m[2] is None:
                ending = "-->" if m[0] == "<!--" else "]]>" if len(m[0]) > 4 else ">"
                end = source.find(ending, at)
                at = size if end < 0 else end + len(ending)
                continue
            tag = m[2].lower()
            rest = REST.match(source, at) if quoted else None
            if rest:
                raw, at = rest[1], rest.end()
            else:
                quoted = False
                end = source.find(">", at)
                if end < 0:  # no tag ends any more: this is text
                    if shown():
                        text.append(source[m.start() :])
                    break
                raw, at = source[at:end], end + 1
            if m[1]:
                if tag in INLINE:
                    self._close_inline(stack[-1], tag)
                else:
                    flush()
                    if count[tag] > 0:
                        while stack[-1].tag != tag:
                            pop()
                        pop()
                continue
            if tag in INLINE:
                if tag == "br" and shown():
                    text.append(" ")
                if tag not in VOID:
                    top = stack[-1]
                    bad = shown() and is_boilerplate(tag, attributes(raw), top.inside)
                    top.hidden += bad
                    top.inline.append((tag, bad))
                    top.open_inline[tag] += 1
                continue
            flush()
            if tag in CLOSES_P:
                self._close(stack, pop, ("p",))
            if tag in SAME_LEVEL:
                self._close(stack, pop, SAME_LEVEL[tag])
            top = stack[-1]
            bad = not shown()
            given = {} if bad else attributes(raw)
            inside = top.inside or tag in ("article", "main")
            bad = bad or is_boilerplate(tag, given, inside)
            if tag in VOID:
                continue
            node, chain = top.node, top.chain
            if not bad:
                classes = sorted(given.get("class", "").split())
                name = ".".join([tag, *classes])
                container = tag not in TEXTUAL
                if container and not classes:
                    nth = top.kids.get(tag, 0)
                    top.kids[tag] = nth + 1
                    name = f"{tag}#{nth}"
                top.names.append(name)
                node = node_id(top.node, name)
                depth = top.depth + 1
                if depth <= LEVELS or depth & (depth - 1) == 0:
                    chain = (*chain, node)
                    if node not in self.nodes:
                        self.nodes[node] = (chain[-2], container, inside, chain)
            if tag in RAW:
                end = END_OF_RAW[tag].search(source, at)
                at = end.start() if end else size
            scope = Counter() if tag in STOPS else top.scope
            scope[tag] += 1
            count[tag] += 1
            stack.append(Open(tag, node, chain, top.depth + 1, inside, bad, scope))
            if not bad:
                self.styles.setdefault(chain[-1], stack[-1].names)
        flush()

    @staticmethod
    def _close_inline(top: Open, tag: str) -> None:
        if top.open_inline[tag] > 0:
            gone = None
            while gone != tag:
                gone, bad = top.inline.pop()
                top.open_inline[gone] -= 1
                top.hidden -= bad

    @staticmethod
    def _close(stack, pop, tags) -> None:
        while any(stack[-1].scope[t] > 0 for t in tags):
            while stack[-1].tag not in tags:
                pop()
            pop()


def host_column(url: str = "url") -> Column:
    """The host of an address, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)", 1))


PAGE_ROW = "host string, page long, texts array<struct<node:long,hash:long,words:int>>, styles array<struct<node:long,hash:long>>, nodes array<struct<node:long,parent:long,container:boolean,inside:boolean,chain:array<long>>>"
#: Nodes that a task remembers, lest it tell of them again.
REMEMBERED = 100_000


def page_rows(pages: DataFrame) -> DataFrame:
    """What each page tells of its host's tree: its texts, child sequences and nodes, and a name that alike pages share.

    A task tells of a node once, as long as it remembers it.
    """

    def lists(counts: list[int], **columns) -> pa.Array:
        """One list of structs a page of flat columns."""
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    def run(batches):
        seen: set[tuple[str, int]] = set()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                hosts = part.column(0).to_pylist()
                parsed = [Page(s.as_py() or "") for s in part.column(1)]
                blocks = [x for p in parsed for x in p.blocks]
                text_hash, text_node = hash_texts([t for _, _, t in blocks]), np.array([c[-1] for c, _, _ in blocks], np.int64)
                words = np.array([len(t.split()) * (MARKED if i else 1) for _, i, t in blocks], np.int32)
                styles = [x for p in parsed for x in p.styles.items()]
                look, look_node = hash_texts([" ".join(names) for _, names in styles]), np.array([n for n, _ in styles], np.int64)
                n_texts, n_styles = [len(p.blocks) for p in parsed], [len(p.styles) for p in parsed]
                names, x, y = [], 0, 0
                for k, l in zip(n_texts, n_styles, strict=True):  # noqa: E741
                    raw = b"".join(v.tobytes() for v in (text_hash[x : x + k], text_node[x : x + k], look[y : y + l], look_node[y : y + l]))
                    names.append(int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True))
                    x, y = x + k, y + l
                if len(seen) > REMEMBERED:
                    seen.clear()
                new = []
                for host, p in zip(hosts, parsed, strict=True):
                    fresh = [(n, *v) for n, v in p.nodes.items() if (host, n) not in seen]
                    seen.update((host, f[0]) for f in fresh)
                    new.append(fresh)
                flat = [f for fresh in new for f in fresh]
                node, parent, container, inside, chain = (list(c) for c in zip(*flat, strict=True)) if flat else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hosts, pa.string()),
                        pa.array(names, pa.int64()),
                        lists(n_texts, node=pa.array(text_node), hash=pa.array(text_hash), words=pa.array(words)),
                        lists(n_styles, node=pa.array(look_node), hash=pa.array(look)),
                        lists([len(f) for f in new], node=pa.array(node, pa.int64()), parent=pa.array(parent, pa.int64()), container=pa.array(container, pa.bool_()), inside=pa.array(inside, pa.bool_()), chain=pa.array(chain, pa.list_(pa.int64()))),
                    ],
                    ["host", "page", "texts", "styles", "nodes"],
                )

    return map_batches(pages.select(host_column().alias("host"), "html"), run, PAGE_ROW)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, parent, container, inside, words, importance) of every node below a host's pages.

    words is the number a page, importance as described above; both lean on all hosts where a host has few pages. Texts are
    counted by (host, node, hash), so those of a large host are spread over all tasks.
    """
    raw = written(page_rows(pages), "page-rows")
    nodes = written(raw.select("host", F.inline("nodes")).dropDuplicates(["host", "node"]), "nodes")
    once = written(raw.select("host", "page", "texts", "styles").dropDuplicates(["host", "page"]), "pages-once")
    forget(raw)
    m = once.groupBy("host").agg(F.count("*").alias("m"))
    texts = once.select("host", "page", F.inline("texts")).distinct().groupBy("host", "node", "hash").agg(F.count("*").alias("n"), F.max("words").alias("w")).join(m, "host")
    entropy = F.when(F.col("m") > 1, F.least(F.lit(1.0), F.log("n") / F.log("m"))).otherwise(F.lit(0.0))
    mass = F.col("n") * F.col("w")
    leaves = texts.select("host", "node", mass.alias("mass"), (mass * (1 - entropy)).alias("new")).groupBy("host", "node").agg(F.sum("mass").alias("mass"), F.sum("new").alias("new"))
    below = leaves.join(nodes.select("host", "node", "chain"), ["host", "node"], "left").select("host", "mass", "new", F.explode(F.coalesce("chain", F.array(F.lit(0).cast("long")))).alias("node"))
    branches = below.groupBy("host", "node").agg(F.sum("mass").alias("mass"), F.sum("new").alias("new"))
    looks = once.select("host", F.inline("styles")).groupBy("host", "node", "hash").agg(F.count("*").alias("n"))
    looks = looks.groupBy("host", "node").agg(F.count("*").alias("l"), F.sum("n").alias("N"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"))
    own = branches.join(m, "host").join(looks, ["host", "node"], "left")
    g = F.pow(F.lit(G), F.coalesce("l", F.lit(0)))
    look = F.when(F.col("m") > 1, F.least(F.lit(1.0), F.coalesce((F.log("N") - F.col("n_log_n") / F.col("N")) / F.log("m"), F.lit(0.0)))).otherwise(F.lit(1.0))
    own = written(own.select("host", "node", "m", "mass", ((1 - g) * look + g * F.col("new") / F.greatest("mass", F.lit(1))).alias("importance")), "style-tree")
    everywhere = own.groupBy("node").agg((F.sum("mass") / F.sum("m")).alias("all_words"), (F.sum(F.col("importance") * F.col("m")) / F.sum("m")).alias("all_importance"))
    shrunk = lambda x, of_all: (F.col("m") * x + PRIOR_PAGES * F.col(of_all)) / (F.col("m") + PRIOR_PAGES)
    both = own.join(everywhere, "node").select("host", "node", shrunk(F.col("mass") / F.col("m"), "all_words").alias("words"), shrunk(F.col("importance"), "all_importance").alias("importance"))
    return both.join(nodes.select("host", "node", "parent", "container", "inside"), ["host", "node"])


def low_branches(tree: DataFrame) -> DataFrame:
    """(host, node) of the branches that the tree removes."""
    score = F.col("words") * F.col("importance")
    of_parent = Window.partitionBy("host", "parent")
    t = tree.withColumn("score", score)
    t = t.withColumns({
        "best": F.max(F.when(F.col("container"), F.col("score"))).over(of_parent),
        "total": F.sum("score").over(of_parent),
        "direct": F.sum(F.when(~F.col("container"), F.col("score")).otherwise(0.0)).over(of_parent),
    })
    laid_out = (F.col("best") >= MOST * F.col("total")) & (F.col("direct") < DIRECT)
    beside = F.col("container") & laid_out & (F.col("score") < SHARE * F.col("best"))
    # The way down to the article is no branch of its own.
    alone = F.col("container") & (F.col("score") == F.col("best")) & (F.col("best") >= MOST * F.col("total"))
    low = (F.col("importance") < LOW) & ~alone
    return t.where(~F.col("inside") & (low | beside)).select("host", "node")


def main_text(page: Page, low: frozenset) -> str:
    """The blocks in page order that the tree leaves; all blocks if it leaves none."""
    kept = [t for chain, inside, t in page.blocks if inside or low.isdisjoint(chain)]
    return "\n\n".join(kept or [t for _, _, t in page.blocks])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of pages (page_id, url, html; others are not read, whatever their names).

    A null or empty html gives an empty text; a null url belongs to the host without a name. Repeated rows have equal
    texts; an empty table gives no row; pages are read whole, however long.
    """
    low = written(low_branches(style_tree(pages)), "low-branches")
    names = "page_id long, url string, text string"
    rows = pages.select("page_id", "url", "html", host_column().alias("host"))

    def texts(b, low_of):
        found = [main_text(Page(s.as_py() or ""), low_of(i)) for i, s in enumerate(b.column(2))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t.encode("utf-8", "replace").decode() for t in found], pa.string())], ["page_id", "url", "text"])

    if small(low, BROADCAST_PATHS):
        by_host: dict[str, set] = {}
        for r in low.collect():
            by_host.setdefault(r.host, set()).add(r.node)
        held = pages.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in by_host.items()})

        def run(batches):
            for b in batches:
                hosts = b.column(3).to_pylist()
                yield texts(b, lambda i: held.value.get(hosts[i], frozenset()))

        return map_batches(rows, run, names)

    def run_joined(batches):
        for b in batches:
            lists = b.column(3).to_pylist()
            yield texts(b, lambda i: frozenset(lists[i] or ()))

    # A large host's pages are split by Spark's handling of skewed joins; its list is as long as its tree.
    per_host = low.groupBy("host").agg(F.collect_list("node").alias("low"))
    return map_batches(rows.join(per_host, "host", "left").select("page_id", "url", "html", "low"), run_joined, names)


def op8_site_style(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
