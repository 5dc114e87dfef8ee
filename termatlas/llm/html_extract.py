"""Main-text extraction by consensus paths.

Every page scores its containers by the running text they hold, less links and furniture, and votes for their
generalised tag-class paths. Links and furniture lower a score but never rule a container out, and a page without
a body element is its own container, so that text outside furniture is always found. Spark sums the votes for each host; pages are then read again with their host's
winning paths, and only a page on which none of them fits falls back to its own best container.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Workspace, map_arrow, slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Fixed values of HTML: elements without content, elements that start a block, elements an open p ends at.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article section main div td body blockquote dd".split())
FURNITURE = frozenset("nav footer aside form header menu button select option label input dialog head".split())
#: Class and id words of furniture and of main text.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus"
    " footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination"
    " popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored"
    " subscribe taboola toolbar widget".split()
)
WANTED = frozenset("article articles body content entry main post prose story text".split())


#: Roots are never furniture: their classes describe the page ("menu-open", "has-sidebar").
ROOTS = frozenset(("html", "body"))
#: Elements that an end tag of another kind does not reach beyond.
BARRIERS = frozenset(("article", "body", "main", "section", "table", "td"))
#: Steps of a path that are written out; what stands above them is a digest.
STEPS = 32


class Node:
    """An element; parents come before their children in a page's list of nodes."""

    __slots__ = ("tag", "names", "parent", "good", "links", "left_out", "unwanted", "bare", "depth", "path", "digest")

    def __init__(self, tag: str, names: tuple, parent):
        self.tag, self.names, self.parent = tag, names, parent
        self.good = self.links = self.left_out = 0
        self.unwanted = tag not in ROOTS and (tag in FURNITURE or bool(UNWANTED.intersection(names)))
        self.bare = self.unwanted or (parent is not None and parent.bare)
        self.depth = 0 if parent is None else parent.depth + 1
        self.path = self.digest = None

    def step(self) -> str:
        return ".".join((self.tag, *sorted(self.names))) if self.names else self.tag


def words_of(attributes: str) -> tuple:
    """Lower-case words of class, id and role; digits are dropped, which generalises the path."""
    out = []
    for _, value in ATTRIBUTE.findall(attributes):
        out += re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
    return tuple(dict.fromkeys(out))


def digest_of(node: Node) -> int:
    """Digest of the steps from the page's root to the node, kept at every node on the way."""
    way = []
    while node.digest is None and node.parent is not None:
        way.append(node)
        node = node.parent
    digest = node.digest or 0
    for n in reversed(way):
        digest = n.digest = xxhash.xxh64_intdigest(n.step(), digest)
    return digest


def path_of(node: Node) -> str:
    """The generalised tag-class path; deep ones have a digest in place of all but their last STEPS steps."""
    if node.path is None:
        if node.depth <= 1:
            node.path = node.step() if node.depth else ""
        elif node.depth <= STEPS:
            node.path = f"{path_of(node.parent)}>{node.step()}"
        else:
            steps, n = [], node
            while len(steps) < STEPS:
                steps.append(n.step())
                n = n.parent
            node.path = ">".join((f"#{digest_of(n):016x}", *reversed(steps)))
    return node.path


class Stack:
    """The open elements, with the places of each tag, so that an end tag finds its element at once."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tag: str) -> int:
        own = self.places.get(tag)
        return own[-1] if own else 0

    def end(self, tag: str, barriers: frozenset) -> None:
        """Close the innermost element of the tag, and what is open inside it, unless a barrier stands between."""
        at = self.last(tag)
        if at and not any(self.last(b) > at for b in barriers):
            for node in self.nodes[at:]:
                self.places[node.tag].pop()
            del self.nodes[at:]


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str | None]]]:
    """The page's root and elements, and its stream of (element, text), text None at a block boundary."""
    root = Node("", (), None)
    nodes, stream, at, open_ = [root], [], 0, Stack(root)
    for m in TOKEN.finditer(page):
        here = open_.nodes[-1]
        if m.start() > at:
            stream.append((here, page[at : m.start()]))
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            stream.append((here, None))
        elif tag == "br":
            stream.append((here, " "))
        if m[2]:
            open_.end(tag, BARRIERS - {tag} if tag not in ("body", "html", "article", "main") else frozenset())
        else:
            if tag in BLOCK:
                open_.end("p", CONTAINER)
            if tag == "li":
                open_.end("li", frozenset(("ul", "ol")))
            node = Node(tag, words_of(m[4]) if m[4] else (), open_.nodes[-1])
            nodes.append(node)
            if tag not in VOID and not m[4].endswith("/"):
                open_.push(node)
    if at < len(page):
        stream.append((open_.nodes[-1], page[at:]))
    return nodes, stream


def score(nodes: list[Node], stream: list) -> list[tuple[float, Node]]:
    """(score, container), best first: running text less furniture and links, weighed by what the element is called.

    Furniture inside a container takes away half of its score at most; a container with more links than running text
    keeps a hundredth of its length. Text outside a body element belongs to the page's root.
    """
    for node, text in stream:
        if text:
            size = len(text.strip())
            if node.bare:
                node.left_out += size
            else:
                node.good += size
    for n in reversed(nodes):  # children hand their sums to their parents
        if n.tag == "a":
            n.good, n.links = 0, n.good + n.links
        if (up := n.parent) is not None:
            up.good += n.good
            up.links += n.links
            up.left_out += n.left_out
    root, out = nodes[0], []
    whole = not any(n.tag == "body" and n.good + n.links for n in nodes)
    for n in nodes:
        if (n.tag in CONTAINER or n is root and whole) and not n.bare and n.good + n.links:
            weight = 1.3 if n.tag in ("article", "main") else 0.9 if n.tag == "body" or n is root else 1.0
            if WANTED.intersection(n.names):
                weight *= 1.2
            own = max(n.good - n.links, 0)
            out.append((weight * (max(own - n.left_out, own / 2) + (n.good + n.links) / 100), n))
    out.sort(key=lambda x: (-x[0], x[1] is root))
    return out


def votes(page: str) -> list[tuple[str, float]]:
    """Paths of the page's containers and their shares of its score, largest first."""
    ranked = score(*parse(page))
    total = sum(s for s, _ in ranked)
    shares: dict[str, float] = {}
    for s, n in ranked:
        p = path_of(n)
        shares[p] = shares.get(p, 0.0) + s / total
    return sorted(shares.items(), key=lambda x: -x[1])


def extract(page: str, paths: list[str]) -> str:
    """Text of the containers on the first path that holds a quarter or more of what the page's best container holds."""
    nodes, stream = parse(page)
    ranked = score(nodes, stream)
    if not ranked:
        return ""
    best, chosen = ranked[0][1].good + ranked[0][1].links, None
    own: dict[str, list[Node]] = {}
    for _, n in ranked if paths else ():
        own.setdefault(path_of(n), []).append(n)
    for p in paths:
        if p in own and sum(n.good + n.links for n in own[p]) >= 0.25 * best:
            chosen = own[p]
            break
    picked = set(map(id, chosen or [ranked[0][1]]))
    blocks, block = [], []

    def flush() -> None:
        line = " ".join(entities.unescape("".join(block)).split())
        if line:
            blocks.append(line)
        block.clear()

    # (in a picked element, other furniture than headers between it and the node, a heading between them)
    within: dict[int, tuple[bool, bool, bool]] = {}
    for n in nodes:
        found, spoiled, heading = within[id(n.parent)] if n.parent is not None else (False, False, False)
        if id(n) in picked:
            within[id(n)] = True, False, False
        else:
            within[id(n)] = found, spoiled or (n.tag != "header" and n.unwanted), heading or n.tag == "h1"
    for node, text in stream:
        found, spoiled, heading = within[id(node)]
        if text is None:
            flush()
        elif found and (not node.bare or heading and not spoiled):  # a heading in the container's own header is part of the article
            block.append(text)
    flush()
    return "\n".join(blocks)


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z0-9+.-]*:?//)?(?:[^/?#@]*@)?([^/?#:]+)", 1))


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", paths_per_host: int = 3
) -> DataFrame:
    """(id, url, text, n_chars) for each page.

    Null and empty pages have empty text, and so have pages whose text is all in furniture; pages without tags or
    without a body have what text they hold; the time is linear in a page, however deep its tags nest. Null and repeated
    ids are rows like others; pages with a null or odd url vote together under what host they have (the
    empty one for none); repeated pages are rows of their own; ties between paths go to the first in order; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "html")
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host_of(url_col).alias("host"),
    )

    def vote(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                sums: dict[tuple, list] = {}
                for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    for i, (p, share) in enumerate(votes(page)):
                        x = sums.setdefault((host, p), [0, 0.0])
                        x[0] += i == 0
                        x[1] += share
                yield {
                    "host": [h for h, _ in sums], "path": [p for _, p in sums],
                    "first": [x[0] for x in sums.values()], "share": [round(x[1] * 1e6) for x in sums.values()],
                }

    counted = map_arrow(rows.select("host", "html"), "host string, path string, first long, share long", vote)
    counted = counted.groupBy("host", "path").agg(F.sum("first").alias("first"), F.sum("share").alias("share"))
    best = W.partitionBy("host").orderBy(F.desc("first"), F.desc("share"), "path")
    winners = (
        counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= paths_per_host)
        .groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))
    )
    winners = ws.store(winners, "winners")  # read back with its true size, so that Spark broadcasts it only below its threshold

    def read(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [extract(page, paths or []) for page, paths in zip(part.column("html").to_pylist(), part.column("paths").to_pylist(), strict=True)]
                yield {"id": part.column("id"), "url": part.column("url"), "text": texts, "n_chars": pa.array(list(map(len, texts)), type=pa.int64())}

    joined = rows.join(winners, "host", "left").select("id", "url", "html", "paths")
    return map_arrow(joined, f"id {kind}, url string, text string, n_chars long", read).withColumnRenamed("id", id_col)
