"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a style node is a path of tags with their classes and ids from the body down.  Over the distinct
pages of the host that have a node (copies of a page count once), two entropies are taken:

* presentation: of the sequences of child styles seen under the node (varied layouts speak for content), and
* content: of each text in the branch over the pages; a text on c of m pages has entropy log_m(c).

importance = (1 - GAMMA) * presentation + GAMMA * (1 - mean content entropy).  Branches of low importance are removed from each page, whether it
has a main element or not.  Plain markup adds to the statistics:

* elements whose tag, role, class or id says that they are a menu, header, footer, sidebar, notice, advert, form or comment have importance 0, but a class, an id or `form` counts for
  nothing on a wrapper in which a main element opens, nor `form` where it holds more than half of the page's text;
* `article` and `main` are a prior: a node inside is removed below a lower bar, so that texts some pages share stay part of an article, and one
  beside it stays only above a higher bar (on a host with too few pages for a tree, the prior alone decides);
* inside `article` and `main` the words of a class or id are only evidence: the bar is higher there, and without repetition nothing goes.
  Only the whole name of an advert (class="ad") and the words for reader comments (class="comment-list") remove their branch at once.

Only hashes of nodes and texts are shuffled, and partial counts are taken before each shuffle, so a host with a third of all pages is
spread over its nodes and texts.

Rows meet their removed branches by a hash of address and html, so a second reading in another order gives the same texts.

Defined results: null html counts as empty and gives the empty text; a null url belongs to the host ''; unclosed elements end with their
parents; a tag that the page ends in is dropped, and a quote that never closes ends with its tag; tags are read in linear time; repeated rows each get their text; a column of the input named like an output column is replaced; an empty table gives an empty
result."""

from __future__ import annotations

import html as html_library
import re
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsweave.llm.common import slices
from newsweave.session import broadcast_if_small, checkpointed

GAMMA = 0.9
MIN_PAGES = 3  # fewer pages of a host say nothing about a node
MIN_IMPORTANCE = 0.2
PLAIN, INSIDE, BESIDE, NAMED = range(4)  # nodes: of a page without a main element or above one, inside one, beside one, inside one and named as boilerplate
PRIORS = {PLAIN: 0.0, INSIDE: 0.1, BESIDE: -0.4, NAMED: -0.3}  # added to the importance
SLICE = 4 << 20

# Element names of the markup language by what they do, and words in roles, classes and ids that tell boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
                   "hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul").split())
NO_CONTENT = frozenset("nav aside footer form button select input datalist dialog menu head svg math canvas audio video object map script style".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion banner sidebar sidebars aside nav navbar "
                               "navigation menu menus submenu breadcrumb breadcrumbs header footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
                               "subscription social share sharing related recommended comment comments disqus respond reply replies widget widgets login signup search pagination pager toolbar").split())
# Whole classes or ids that mean boilerplate inside a main element too, and words that mean none there.
OUTRIGHT = frozenset("ad ads advert adverts advertisement advertisements adsense comment comments disqus".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
KEPT_IN_MAIN = frozenset(["header"])
NONE = frozenset()
P_ENDS = BLOCK - frozenset("body head html li dd dt td th tr tbody thead tfoot option optgroup caption legend summary".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPES = frozenset("article aside body div footer form header main nav section table ul ol dl blockquote td th html".split())

# Tags are read in linear time, one part after the other: blanks, or a name and perhaps a value, quoted or bare; a quote that never closes holds what is left of its tag.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)", re.S)
_PART = re.compile(r"[\s/=]+|([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|[\"']([^>]*)|([^\s\"'>][^\s>]*))?)?")
_MODIFIED = re.compile(r"(?<![a-z])(?:has|no|not|with|without)[-_]+[a-z]+")  # "has-sidebar" says nothing about the element itself
_WORDS = re.compile(r"[a-z]+")


def _attributes(source: str, at: int = 0) -> tuple[dict[str, str], int]:
    """The attributes that begin at a place, and the place after the end of their tag."""
    found, n = {}, len(source)
    while at < n and source[at] != ">":
        m = _PART.match(source, at)
        at = m.end()
        if m[1]:
            found[m[1].lower()] = html_library.unescape(m[2] or m[3] or m[4] or m[5] or "")
    return found, at + 1


def _style(tag: str, attributes: dict[str, str]) -> str:
    return tag + "".join(f" {k}={attributes[k]}" for k in ("class", "id") if attributes.get(k))


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


class Element:
    __slots__ = ("tag", "style", "path", "parent", "names", "words", "hard", "claims", "buried", "opens_main", "size", "dropped", "main", "named", "holds_main", "children")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.style, self.parent = tag, _style(tag, attributes), parent
        self.path = _hash(parent.path if parent else 0, self.style)
        self.children: list[str] = []
        self.names, self.words = "", NONE
        self.hard, self.main = tag in NO_CONTENT and tag != "form", tag in ("article", "main")  # main so far: says that it is one
        if attributes:
            names, role = (attributes.get("class", "") + " " + attributes.get("id", "")).lower(), attributes.get("role", "").lower()
            self.names = _MODIFIED.sub(" ", names) if "-" in names or "_" in names else names
            self.words = BOILERPLATE_WORDS.intersection(_WORDS.findall(self.names)) if tag not in ("body", "html") else NONE
            self.main = self.main or role == "main"
            self.hard = self.hard or "hidden" in attributes or attributes.get("aria-hidden") == "true" or role in BOILERPLATE_ROLES or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        self.claims = self.main or parent is not None and parent.claims  # lies in what says that it is one
        self.buried = self.hard or parent is not None and parent.buried
        self.opens_main = self.holds_main = self.dropped = self.named = False
        self.size = 0

    def outright(self) -> bool:
        """Named as an advert or as comments, which goes inside a main element too."""
        if self.tag in ("main", "article"):
            return "comment" in self.words and not OUTRIGHT.isdisjoint(self.names.split())
        return bool(self.words) and not (OUTRIGHT.isdisjoint(self.names.split()) and COMMENT_WORDS.isdisjoint(self.words))

    def may_drop(self) -> bool:
        """Of an element inside a line: is its text told apart from that of the line?"""
        return self.hard or (self.outright() if self.parent.claims else bool(self.words))

    def decide(self, size_of_page: int) -> None:
        """What the element is, once its parent is decided and the whole page is known."""
        above, says_main = self.parent, self.main
        inside = above is not None and above.main
        container = self.tag in ("main", "article")
        drops = self.outright() if inside else (bool(self.words) or self.tag == "header") and not container and not self.opens_main
        if self.tag == "form":
            drops = drops or not (self.opens_main or 2 * self.size > size_of_page)
        self.dropped = above is not None and above.dropped or self.hard or drops
        self.main = inside or says_main and not self.dropped
        self.named = above is not None and above.named or inside and bool(self.words - KEPT_IN_MAIN) and not container


class Page:
    """Blocks of a page in order (text, the nodes above it), and its style nodes."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, tuple[Element, ...]]] = []
        self.nodes: list[Element] = []
        self._text: list[str] = []
        root = Element("html", {}, None)
        self.stack = [root]
        self.nodes.append(root)
        self._read(source)
        self._end_block()
        self._decide()

    def _decide(self) -> None:
        """Children come after their parents, so one way up gathers what an element holds, and one way down decides."""
        for text, above in self.blocks:
            if not above[-1].buried:
                above[-1].size += len(text)
        for e in reversed(self.nodes):
            if e.parent is not None and not e.hard:
                e.parent.opens_main |= e.main or e.opens_main
                e.parent.size += e.size
        for e in self.nodes:
            e.decide(self.nodes[0].size)
        for _, above in self.blocks:
            if above[-1].main and not above[-1].dropped:
                for e in above:
                    e.holds_main = True

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _MARKUP.search(source, at)
            if not m:
                self._characters(source[at:])
                return
            self._characters(source[at : m.start()])
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            attributes, at = _attributes(source, at)
            if m["end"]:
                self._close(tag)
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else n
            elif tag in ("html", "body", "head") and any(e.tag == tag for e in self.stack[1:]):
                pass
            else:
                self._open(tag, attributes)

    def _characters(self, text: str) -> None:
        if text:
            self._text.append(text)

    def _end_block(self) -> None:
        text = " ".join(html_library.unescape("".join(self._text)).split())
        self._text = []
        if text:
            self.blocks.append((text, tuple(self.stack)))

    def _open(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "br":
            self._text.append("\n")
        if tag in BLOCK or tag in NO_CONTENT:
            self._end_block()
        if tag in VOID:
            return
        if tag in P_ENDS:
            self._close_open(("p",))
        if tag in SIBLINGS:
            self._close_open(SIBLINGS[tag])
        if tag == "html":
            return
        if tag == "body":
            self._close_open(("head",))
        element = Element(tag, attributes, self.stack[-1])
        if tag in BLOCK or element.may_drop():
            self._end_block()
            self.stack[-1].children.append(element.style)
            self.stack.append(element)
            self.nodes.append(element)

    def _close_open(self, tags: tuple[str, ...]) -> None:
        """Close the innermost of these elements, unless a container stands between."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                self._end_block()
                del self.stack[k:]
                return
            if self.stack[k].tag in SCOPES:
                return

    def _close(self, tag: str) -> None:
        if tag in ("br", "p") and not any(e.tag == tag for e in self.stack):
            self._end_block() if tag == "p" else self._text.append("\n")
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self._end_block()
                del self.stack[k:]
                return
            if tag not in BLOCK and self.stack[k].tag in SCOPES:
                return

    def judged(self, markup: bool = True) -> tuple[list[tuple[int, int]], list[tuple[str, list[int]]]]:
        """The distinct nodes (path, kind) above the blocks that plain markup leaves, and these blocks (text, places of their nodes); without `markup`, above all blocks."""
        has_main, places, blocks = self.nodes[0].holds_main, {}, []
        for text, above in self.blocks:
            if not markup:
                keys = [(e.path, PLAIN) for e in above]
            elif above[-1].dropped:
                continue
            else:
                keys = [(e.path, (NAMED if e.named else INSIDE) if e.main else BESIDE if has_main and not e.holds_main else PLAIN) for e in above]
            blocks.append((text, [places.setdefault(k, len(places)) for k in keys]))
        return list(places), blocks

    def features(self) -> tuple[int, set[tuple[int, int, int]]]:
        """Hash of the page's texts, and (path, kind, feature) with kind 0 the node itself, 1 its child styles, 2 a text in its branch."""
        out = {(e.path, 0, 0) for e in self.nodes} | {(e.path, 1, _hash(*e.children)) for e in self.nodes}
        texts = [(_hash(text), above) for text, above in self.blocks]
        out |= {(e.path, 2, text) for text, above in texts for e in above}
        return _hash(*(t for t, _ in texts)), out


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.rpartition("@")[2].lower()
    except ValueError:
        return ""


def node_importance(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """The site style trees: per host and style node, `pages` (distinct ones that have it) and `importance`."""
    node = T.StructType([T.StructField("path", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("feature", T.LongType())])
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("page", T.LongType()), T.StructField("nodes", T.ArrayType(node))])
    arrow = to_arrow_schema(schema)

    def read(batches):
        for batch in slices(batches, SLICE):
            rows = []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                page, features = Page(source or "").features()
                rows.append({"host": host_of(url), "page": page, "nodes": [dict(zip(("path", "kind", "feature"), f)) for f in features]})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    seen = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(read, schema)
    distinct = seen.groupBy("host", "page").agg(F.first("nodes").alias("nodes"))
    counts = distinct.select("host", F.explode("nodes").alias("n")).groupBy("host", "n.path", "n.kind", "n.feature").agg(F.count(F.lit(1)).alias("c"))
    log = F.log(F.col("c").cast("double"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    sums = counts.groupBy("host", "path").agg(F.max(of(0, F.col("c"))).alias("pages"), F.sum(of(1, F.col("c"))).alias("styles"), F.sum(of(1, F.col("c") * log)).alias("style_logs"), F.avg(of(2, log)).alias("text_log"))
    base = F.log(F.col("pages").cast("double"))
    style = F.when(F.col("pages") > 1, (F.log("styles") - F.col("style_logs") / F.col("styles")) / base).otherwise(1.0)
    text = F.when(F.col("pages") > 1, 1 - F.coalesce(F.col("text_log"), F.lit(0.0)) / base).otherwise(1.0)
    return sums.select("host", "path", "pages", ((1 - GAMMA) * style + GAMMA * text).alias("importance"))


def extract_main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", out_col: str = "text", min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE, markup: bool = True) -> DataFrame:
    """The pages with `text` in place of the html: blocks of the branches that stay, one line each.  Without `markup`, the style trees alone decide."""
    names = [c for c in pages.columns if c not in (html_col, out_col)]
    rows = pages.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(names)), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("row", F.unhex(F.sha2(F.concat_ws("\n", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).cast("binary"), 256)))
    kept = [f"_{i}" for i in range(len(names))]
    node = T.StructType([T.StructField("path", T.LongType()), T.StructField("kind", T.IntegerType())])
    block = T.StructType([T.StructField("text", T.StringType()), T.StructField("above", T.ArrayType(T.IntegerType()))])

    def read(columns: list[str], fields: list[T.StructField], build) -> DataFrame:
        """The columns of each row and what `build` makes of its address and page."""
        schema = T.StructType([*(rows.schema[c] for c in columns), *fields])
        arrow = to_arrow_schema(schema)

        def run(batches):
            for batch in slices(batches, SLICE):
                found = [build(url, *Page(source or "").judged(markup)) for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array([f[k] for f in found], arrow.field(x.name).type) for k, x in enumerate(fields))], schema=arrow)

        return rows.mapInArrow(run, schema)

    texts = read([*kept, "row"], [T.StructField("blocks", T.ArrayType(block))], lambda _, nodes, blocks: ([{"text": t, "above": a} for t, a in blocks],))
    nodes = read(["row"], [T.StructField("host", T.StringType()), T.StructField("nodes", T.ArrayType(node))], lambda url, nodes, _: (host_of(url), [{"path": p, "kind": k} for p, k in nodes]))
    known = node_importance(pages, html_col, url_col).filter(F.col("pages") >= min_pages).select("host", "path", "importance")
    known, nodes = checkpointed(known, "style-tree"), checkpointed(nodes, "style-nodes")  # both are read twice
    places = nodes.select("row", "host", F.posexplode("nodes").alias("place", "node")).select("row", "host", "place", "node.path", "node.kind")
    prior = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in PRIORS.items()))
    low = known.filter(F.col("importance") < min_importance - min(PRIORS.values()))  # the others, such as the body of a large host, can go nowhere
    gone = places.filter(F.col("kind") != BESIDE).join(broadcast_if_small(low), ["host", "path"]).filter(F.col("importance") + prior < min_importance)
    alone = places.filter(F.col("kind") == BESIDE).join(known.filter(F.col("importance") + PRIORS[BESIDE] >= min_importance), ["host", "path"], "left_anti")
    removed = gone.select("row", "place").unionByName(alone.select("row", "place")).groupBy("row").agg(F.collect_set("place").alias("removed"))
    removed = checkpointed(removed, "removed")  # its size is known now: a small one leaves the texts where they are
    stays = F.filter("blocks", lambda b: ~F.arrays_overlap(b["above"], F.coalesce("removed", F.array().cast("array<int>"))))
    return texts.join(removed, "row", "left").select(*(F.col(k).alias(c) for k, c in zip(kept, names)), F.array_join(F.transform(stays, lambda b: b["text"]), "\n").alias(out_col))
