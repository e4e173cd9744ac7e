"""Operator 4: main text of web pages by a site style tree.

The DOMs of a host are merged. An element node is a path of tags with their
classes and ids; content nodes are the texts that stand right under it. Over the
pages of the host that show a node,

* a content's entropy is log n / log m, n of the m pages showing it (1: on every
  page); a node's *content importance* is one minus the mean entropy of its
  different contents;
* a branch's *presentation importance* is the entropy of the sequences of child
  elements that it shows, to base m (0: always the same, as in a template).

A node's importance is ``CONTENT_SHARE`` of the first and the rest of the second
(of the branch it stands in). Few pages prove little, so it is drawn towards the importance
of the same path in a tree over all hosts, and that towards the path of bare
tags (``HOST_PAGES``, ``PATH_PAGES``: as many pages' worth). What elements say of
themselves (article, navigation, advert) counts as ``NAMED_PAGES`` pages of the
all-hosts node, so it decides on small corpora and fades as pages come in; it
never decides alone. A block's importance is its node's, less what its own text
loses by standing on many pages of the host, and blocks below ``KEEP`` go.

No tree is gathered in one place: nodes are rows, keyed by 64-bit hashes, so a
host may hold a third of all pages. Equal pages of a host count once. Pages are
parsed once for the tree (only hashes are stored) and once for the text. Low
nodes and contents are far fewer than blocks; up to ``SMALL_TREE`` of them are
sent to the tasks that read the pages, so no page moves; more are joined.
"""

from __future__ import annotations

import html as entities
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_per_key, saved, shared_folder, small_batches, table

#: Least importance of a block that stays.
KEEP = 0.72
#: The weight of content importance against presentation importance.
CONTENT_SHARE = 0.85
#: How many pages' worth the next wider tree, and an element's name, count.
HOST_PAGES, PATH_PAGES, NAMED_PAGES = 60, 10, 50
#: What a path of tags is thought to be before any page is seen, and how many pages' worth that counts.
UNSEEN_IMPORTANCE, UNSEEN_PAGES = 0.8, 2
#: The most low nodes and contents that are broadcast (8 bytes each).
SMALL_TREE = 1 << 20

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas and drawings stand inside a sentence, with all that they are made of.
_FIGURES = frozenset("math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle msup msub msubsup munder mover munderover mmultiscripts mpadded mphantom menclose mfenced mtable mtr mtd svg g text tspan textpath defs use path rect circle ellipse line polyline polygon".split())
_INLINE |= _FIGURES
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
_UNSEEN = frozenset("script style head title noscript template iframe object annotation annotation-xml canvas audio video textarea select option datalist".split())
_RAW = frozenset("script style title textarea iframe noscript".split())
_CHROME_TAGS = frozenset("nav footer aside form dialog menu button fieldset".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_CONTENT_TAGS = frozenset("article main".split())
_CONTENT_WORD = re.compile(r"^(?:(?:article|post|entry|story|page|main)[-_]?(?:body|content|text)|articlebody|h-entry)$")
_CHROME_PART = re.compile(
    r"^(?:ads?|adverts?|advertisement|advertising|adslot|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|footer|masthead|topbar|cookies?|consent|gdpr|notice|newsletter"
    r"|subscribe|subscription|signup|login|popup|modal|overlay|share|sharing|social|related|recommended|recommendations|comments?|disqus|replies|reply|respond|widget|toolbar|pagination|pager|copyright|search|skip)$"
)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: A start tag of the first closes an open element of the second.
_CLOSES = {"p": "p", "li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class Block(NamedTuple):
    """A text block: hashes of its element's path and of the path of bare tags, of its parent's, of its text; what names say (-1, 0, 1)."""

    path: int
    tags: int
    up_path: int
    up_tags: int
    content: int
    prior: int
    text: str


class _Element:
    __slots__ = ("children", "holds", "parent", "path", "prior", "seen", "tag", "tags")

    def __init__(self, tag: str, path: int, tags: int, prior: int, seen: bool, parent: _Element | None) -> None:
        self.tag, self.path, self.tags, self.prior, self.seen = tag, path, tags, prior, seen
        #: The nearest block element around this one; the tags of the block elements in it; whether one of them has text.
        self.parent, self.children, self.holds = parent, [], False


def _hash(x: str) -> int:
    h = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _element(tag: str, raw: str, outer: _Element) -> _Element:
    seen, prior, mark = outer.seen and tag not in _UNSEEN, outer.prior, tag
    if prior >= 0:
        if tag in _CONTENT_TAGS:
            prior = 1
        elif tag in _CHROME_TAGS or (tag == "header" and prior < 1):
            prior = -1
    if "=" in raw or "hidden" in raw:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
        names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
        mark = f"{tag}.{'.'.join(names)}" if names else tag
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
            seen = False
        if prior >= 0 and tag not in _INLINE:
            if found.get("role", "").lower() in _CHROME_ROLES or any(_CHROME_PART.match(part) for n in names for part in re.split(r"[-_]+", n)):
                prior = -1
            elif "header" in names and prior < 1:
                prior = -1
            elif found.get("role") == "main" or found.get("itemprop") == "articleBody" or any(map(_CONTENT_WORD.match, names)):
                prior = 1
    if tag in _INLINE:
        return _Element(tag, outer.path, outer.tags, prior, seen, outer.parent if outer.tag in _INLINE else outer)
    around = outer.parent if outer.tag in _INLINE else outer
    around.children.append(tag)
    return _Element(tag, _hash(f"{around.path}/{mark}"), _hash(f"{around.tags}/{tag}"), prior, seen, around)


def _features(text: str, host: str) -> str:
    """What a text says apart from the name of its host, so that a footer line is one content on all hosts."""
    return " ".join(w for w in text.split(" ") if host not in w.lower()) if host else text


def parse(page: str, host: str = "") -> tuple[list[Block], list[tuple[int, int, int]]]:
    """The text blocks of a page in order, and (path, tags, style) of every element with a text block in it.

    White space inside a block is one space; references are decoded. The time is linear in the page.
    """
    stack, out, styles, words, links, at, n = [_Element("", 0, 0, 0, True, None)], [], [], [], 0, 0, len(page)
    opened: Counter[str] = Counter()
    last_end = page.rfind(">")

    def flush(linked: int) -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            top = stack[-1].parent if stack[-1].tag in _INLINE else stack[-1]
            up = top.parent or top
            up.holds = True
            # short text that is mostly links, outside an article, looks like a menu's
            prior = -1 if top.prior == 0 and 2 * linked > len(text) and len(text) < 100 else top.prior
            out.append(Block(top.path, top.tags, up.path, up.tags, _hash(_features(text, host)), prior, text))

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
            if e.holds:
                styles.append((e.path, e.tags, _hash(" ".join(e.children))))
        del stack[k:]

    while at < n:
        begin = page.find("<", at)
        text = page[at:] if begin < 0 else page[at:begin]
        if text and stack[-1].seen:
            words.append(entities.unescape(text) if "&" in text else text)
            if any(e.tag == "a" for e in stack[-3:]):
                links += len(text)
        if begin < 0:
            break
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            at = n if end < 0 else end + 1
            continue
        m = (_TAG.match(page, begin) or _LOOSE_TAG.match(page, begin)) if begin < last_end else None
        if not m:
            if stack[-1].seen:
                words.append("<")
            at = begin + 1
            continue
        at, tag = m.end(), m[2].lower()
        if tag not in _INLINE:
            flush(links)
            links = 0
        elif tag == "br":
            words.append(" ")
        if m[1]:
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag in _INLINE and stack[k].tag not in _INLINE:
                        break
            continue
        closed = _CLOSES.get(tag, "p").split() if tag in _ENDS_P or tag in _CLOSES else []
        if any(opened[c] for c in closed):
            # an open paragraph ends before a block; list items and cells end before the next
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closed:
                    close(k)
                    break
                if stack[k].tag not in _INLINE and stack[k].tag != "p":
                    break
        if tag in _VOID or m[3].endswith("/"):
            continue
        stack.append(_element(tag, m[3], stack[-1]))
        opened[tag] += 1
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = n if not end else end.start()
    flush(links)
    close(0)
    return out, styles


def blocks_of(page: str, host: str = "") -> list[Block]:
    return parse(page, host)[0]


def _node(host: str, path: int) -> int:
    """The hash of a host's node."""
    return _hash(f"{host} {path}")


_LONGS = pa.list_(pa.int64())
_ARRAYS = ("node", "path", "tags", "up", "up_path", "up_tags", "content", "prior", "styled", "styled_path", "styled_tags", "style")


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest and arrays): a page's blocks and the styles of its branches as hashes."""
    for batch in batches:
        digests: list[int] = []
        arrays: list[list] = [[] for _ in _ARRAYS]
        for host, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            blocks, styles = parse(page, host)
            nodes = {p: _node(host, p) for p in {b.path for b in blocks} | {b.up_path for b in blocks} | {p for p, _, _ in styles}}
            rows = [(nodes[b.path], b.path, b.tags, nodes[b.up_path], b.up_path, b.up_tags, b.content, b.prior) for b in blocks]
            kept = [(nodes[p], p, t, h) for p, t, h in styles]
            for column, values in zip(arrays, [*([r[k] for r in rows] for k in range(8)), *([r[k] for r in kept] for k in range(4))], strict=True):
                column.append(values)
            digests.append(_hash(f"{host} {[b.text for b in blocks]}"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.int64()), *[pa.array(a, _LONGS) for a in arrays]], ["key", "digest", *_ARRAYS])


def parsed(pages: DataFrame) -> DataFrame:
    """Pages (key, host, html) as their nodes, stored in the shared folder (no text, so it is small)."""
    schema = ", ".join(["key long, digest long", *(f"{a} array<long>" for a in _ARRAYS)])
    out = f"{shared_folder(pages.sparkSession)}/pages-{uuid.uuid4().hex}"
    pages.select("key", "host", "html").mapInArrow(_tree_rows, schema).write.parquet(out)
    return pages.sparkSession.read.parquet(out)


def block_rows(pages: DataFrame) -> DataFrame:
    """A row for each block, with its ``place``."""
    zipped = F.arrays_zip("node", "path", "tags", "up", "up_path", "up_tags", "content", "prior")
    return pages.select("key", F.posexplode(zipped).alias("place", "b")).select("key", "place", "b.*")


def _presentation(styles: DataFrame, key: str) -> DataFrame:
    """(key, shown): the entropy of the styles (key, style, k) to the base of their number."""
    total = F.sum("k")
    return styles.groupBy(key).agg(total.alias("t"), F.sum(F.col("k") * F.log("k")).alias("l")).select(key, F.when(F.col("t") > 1, 1 - F.col("l") / (F.col("t") * F.log("t"))).otherwise(0.0).alias("shown"))


def _rated(nodes: DataFrame, contents: DataFrame, styles: DataFrame, key: str, up: str) -> DataFrame:
    """(key, pages, raw): the importance of a level's nodes by their own pages.

    ``nodes`` (key, up, m), ``contents`` (key, content, n) and ``styles`` (up, style, k) are counts of this level or a finer one.
    """
    m = nodes.groupBy(key, up).agg(F.sum("m").alias("pages"))
    logs = contents.groupBy(key, "content").agg(F.log(F.sum("n")).alias("l")).groupBy(key).agg(F.avg("l").alias("l"))
    own = F.when(F.col("pages") > 1, F.greatest(1 - F.col("l") / F.log("pages"), F.lit(0.0))).otherwise(1.0)
    shown = _presentation(styles.groupBy(up, "style").agg(F.sum("k").alias("k")), up)
    raw = CONTENT_SHARE * own + (1 - CONTENT_SHARE) * F.coalesce("shown", F.lit(0.0))
    return m.join(logs, key).join(shown, up, "left").select(key, "pages", raw.alias("raw"))


def importances(pages: DataFrame, *, names: bool = True) -> tuple[DataFrame, DataFrame]:
    """(node, m, importance) of every host's nodes, and (node, content, n) of their contents.

    ``names`` false leaves out what elements say of themselves.
    """
    one = pages.dropDuplicates(["digest"])
    contents = one.select("key", F.explode(F.arrays_zip("node", "path", "tags", "content")).alias("b")).select("key", "b.*").distinct().groupBy("node", "path", "tags", "content").agg(F.count(F.lit(1)).alias("n"))
    block_of = F.arrays_zip("node", "path", "tags", "up", "up_path", "up_tags", "prior")
    nodes = one.select("key", F.explode(block_of).alias("b")).select("key", "b.*").groupBy("node", "path", "tags", "up", "up_path", "up_tags").agg(F.count_distinct("key").alias("m"), F.sum("prior").alias("prior"), F.sum(F.abs("prior")).alias("named"), F.count(F.lit(1)).alias("blocks"))
    styles = one.select(F.explode(F.arrays_zip(F.col("styled").alias("up"), F.col("styled_path").alias("up_path"), F.col("styled_tags").alias("up_tags"), "style")).alias("s")).select("s.*").groupBy("up", "up_path", "up_tags", "style").agg(F.count(F.lit(1)).alias("k"))
    nodes, contents, styles = saved(nodes), saved(contents), saved(styles)
    bare = _rated(nodes, contents, styles, "tags", "up_tags")
    bare = bare.select("tags", ((F.col("pages") * F.col("raw") + UNSEEN_PAGES * UNSEEN_IMPORTANCE) / (F.col("pages") + UNSEEN_PAGES)).alias("bare"))
    per_path = nodes.groupBy("path", "tags").agg(F.sum("prior").alias("prior"), F.sum("named").alias("named"), F.sum("blocks").alias("blocks"), F.count(F.lit(1)).alias("hosts"))
    paths = saved(per_path.join(_rated(nodes, contents, styles, "path", "up_path"), "path"))
    # a path of tags may have any number of class names, and a path may stand on any number of hosts
    variants = paths.groupBy("tags").agg(F.count(F.lit(1)).alias("m")).join(bare, "tags")
    named = F.col("named") / F.col("blocks") * (NAMED_PAGES if names else 0)
    told = F.when(F.col("named") > 0, (F.col("prior") / F.col("named") + 1) / 2).otherwise(0.0)
    wide = (F.col("pages") * F.col("raw") + PATH_PAGES * F.col("bare") + named * told) / (F.col("pages") + PATH_PAGES + named)
    paths = saved(join_per_key(paths, variants, "tags", paths.count()).select("path", wide.alias("wide"), F.col("hosts").alias("m")))
    own = saved(nodes.select("node", "path").join(_rated(nodes, contents, styles, "node", "up"), "node"))
    importance = (F.col("pages") * F.col("raw") + HOST_PAGES * F.col("wide")) / (F.col("pages") + HOST_PAGES)
    found = join_per_key(own, paths, "path", own.count()).select("node", F.col("pages").alias("m"), importance.alias("importance"))
    return found, contents.select("node", "content", "n")


def low_places(pages: DataFrame, keep: float = KEEP, *, names: bool = True) -> tuple[DataFrame, DataFrame]:
    """(node, m) of the nodes below ``keep``, and (leaf, m) of contents below it in nodes that are not; m: how many pages show it.

    A content on n of its node's m pages loses (f H)^2 of the node's importance: f = (n - 1) / (m + 1), H = log n / log m.
    """
    nodes, contents = importances(pages, names=names)
    nodes = saved(nodes)
    n_contents = contents.count()
    high = nodes.where(F.col("importance") >= keep).join(contents.groupBy("node").agg(F.count(F.lit(1)).alias("rows")), "node").select("node", F.col("m").alias("pages"), "importance", F.col("rows").alias("m"))
    met = join_per_key(contents.where("n > 1"), high, "node", n_contents)
    share = (F.col("n") - 1) / (F.col("pages") + 1) * F.log("n") / F.log("pages")
    low = met.where(F.col("importance") * (1 - share * share) < keep).select(F.col("node").bitwiseXOR(F.col("content")).alias("leaf"), F.col("n").alias("m"))
    return saved(nodes.where(F.col("importance") < keep).select("node", "m")), saved(low.groupBy("leaf").agg(F.sum("m").alias("m")))


def _kept_text(blocks: list[Block], low_node: np.ndarray, low_leaf: np.ndarray) -> str:
    """The texts that stay. Where that is none: contents of elements that are not low, else of elements named as an article."""
    kept = [b.text for b, node, leaf in zip(blocks, low_node, low_leaf, strict=True) if not node and not leaf]
    return "\n".join(kept or [b.text for b, node in zip(blocks, low_node, strict=True) if not node] or [b.text for b in blocks if b.prior > 0])


def extract_main_text(pages: DataFrame, keep: float = KEEP, *, small_tree: int = SMALL_TREE) -> DataFrame:
    """Adds ``text`` and ``n_chars`` to pages (page_id, url, html); columns of those names are replaced, others stay.

    A null or empty page has an empty text. Pages without a host share the host ''. Repeated rows
    are read alike and count once in the tree. Very long pages are read whole. An
    empty table gives none. A page of which nothing would be left (a host of near
    copies, whose texts stand on most of its pages) keeps the texts whose
    element is not low, else those in an element named as an article.
    """
    small_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    html, host = F.coalesce("html", F.lit("")), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    # the input's columns travel as one struct, so that none can clash
    keyed = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.xxhash64(host, html).alias("key"), host.alias("host"), html.alias("html"))
    tree = parsed(keyed)
    low_nodes, low_leaves = low_places(tree, keep)
    if low_nodes.count() + low_leaves.count() <= small_tree:
        text = _reader(low_nodes, low_leaves)("host", "html")
        read = keyed.select("_row", text.alias("text"))
    else:
        read = _joined(keyed, tree, low_nodes, low_leaves)
    return read.select("_row.*", "text").withColumn("n_chars", F.length("text").cast("long"))


def _reader(low_nodes: DataFrame, low_leaves: DataFrame):
    """A function of (host, html) that holds the low nodes and contents (at most SMALL_TREE of both)."""
    sc = low_nodes.sparkSession.sparkContext
    column = lambda df, name: np.sort(np.array(df.select(name).toArrow().column(0).to_numpy(zero_copy_only=False), np.int64))
    held = sc.broadcast((column(low_nodes, "node"), column(low_leaves, "leaf")))

    def among(values: np.ndarray, xs: list[int]) -> np.ndarray:
        if not len(values):
            return np.zeros(len(xs), bool)
        x = np.array(xs, np.int64)
        return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x

    @F.arrow_udf("string")
    def read(host: pa.Array, html: pa.Array) -> pa.Array:
        nodes, leaves = held.value
        out = []
        for h, page in zip(host.to_pylist(), html.to_pylist(), strict=True):
            blocks = blocks_of(page, h)
            ids = {p: _node(h, p) for p in {b.path for b in blocks}}
            own = [ids[b.path] for b in blocks]
            out.append(_kept_text(blocks, among(nodes, own), among(leaves, [x ^ b.content for x, b in zip(own, blocks, strict=True)])))
        return pa.array(out, pa.string())

    return read.asNondeterministic()  # else a filter on the result would run it twice


def _joined(keyed: DataFrame, tree: DataFrame, low_nodes: DataFrame, low_leaves: DataFrame) -> DataFrame:
    """(_row, text): the places that go are joined with their blocks, then with the pages. Equal pages share a key."""
    blocks = block_rows(tree.dropDuplicates(["key"])).select("key", "place", "node", F.col("node").bitwiseXOR(F.col("content")).alias("leaf"))
    n = blocks.count()
    nodes = join_per_key(blocks, low_nodes, "node", n).select("key", F.col("place") * 2)
    leaves = join_per_key(blocks, low_leaves, "leaf", n).select("key", F.col("place") * 2 + 1)
    gone = nodes.union(leaves).toDF("key", "mark").groupBy("key").agg(F.collect_set("mark").alias("marks"))

    @F.arrow_udf("string")
    def read(host: pa.Array, html: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for h, page, places in zip(host.to_pylist(), html.to_pylist(), marks.to_pylist(), strict=True):
            blocks = blocks_of(page, h)
            marked = np.zeros(2 * len(blocks), bool)
            marked[places or []] = True
            out.append(_kept_text(blocks, marked[::2], marked[1::2]))
        return pa.array(out, pa.string())

    return keyed.join(gone, "key", "left").select("_row", read.asNondeterministic()("host", "html", "marks").alias("text"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
