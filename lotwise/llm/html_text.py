"""Main text of web pages by site style trees."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lotwise.scale import settle

# Markup that is never text, boxes around the article, and elements that make blocks; fixed values of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
BOXES = {
    "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "head",
    "fieldset", "datalist", "map", "math",
}
BLOCKS = BOXES | {
    "html", "body", "header", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li",
    "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure",
    "figcaption", "address", "hr", "details", "summary", "center", "hgroup", "search", "colgroup", "legend", "optgroup",
    "option",
}
VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "source", "track", "area", "base", "col", "embed", "param"}
# An element that starts ends an open one of these before it.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"},
}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "select", "td", "th", "blockquote"}
# Classes, ids and roles of boxes that aren't the article; fixed values.
BOX_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|alert|popup|modal|nav|"
    r"navigation|navbar|menu|breadcrumbs?|sidebar|side|footer|masthead|topbar|comments?|replies|disqus|related|recommended|"
    r"share|sharing|social|newsletter|subscribe|signup|login|search|pagination|pager|contentinfo|complementary|toolbar|"
    r"skip|widget|site-header|page-header)(?:$|[\s_-])", re.IGNORECASE)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|head)(?:$|[\s_-])", re.IGNORECASE)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.DOTALL)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

# Elements below this importance are removed, if so many pages of the site have them.
THRESHOLD, LEAST_PAGES = 0.35, 8
# Inside the article only boxes with a name go, and only if they are next to nothing new.
THRESHOLD_INSIDE = 0.1
# Damping of the importance of a node's own styles against that of its children.
DAMPING = 0.9
# Deeper elements count as their ancestor at this depth.
DEPTH = 24


def site(url: Column) -> Column:
    """Host of a URL in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


class Element:
    """A block element. Its node in the site's tree is the path of labels from the root; below DEPTH it has that of its
    ancestor there. `box`: markup says that it isn't the article; `inside`: it is in an article element; `limit`: the
    importance below which it may be removed; `article`: the number of the outermost article element around it."""

    __slots__ = ("tag", "label", "number", "node", "parent", "box", "inside", "limit", "article", "children", "depth")

    def __init__(self, tag: str, label: str, parent: Element | None, box: bool):
        self.tag, self.label, self.parent, self.children = tag, label, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.node = self if self.depth <= DEPTH else parent.node
        self.number = xxhash.xxh64_intdigest(label, parent.number if parent else 0)
        self.box = box or bool(parent and parent.box)
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.article = parent.article if parent and parent.inside else self.number if self.inside else None
        self.limit = 0.0
        if tag not in ("", "html", "body", "article", "main"):
            self.limit = THRESHOLD if not self.inside else THRESHOLD_INSIDE if "." in label else 0.0


def blocks(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """Block elements of a page in order, and its texts by block in page order: character references decoded, white
    space made one space. Inline markup is dropped; br is white space; unclosed elements end where HTML ends them."""
    root = Element("", "", None, False)
    stack, elements, texts, buffer = [root], [root], [], []

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                texts.append((stack[-1], text))

    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            buffer.append(page[at:])
            break
        if mark > at:
            buffer.append(page[at:mark])
        found = TOKEN.match(page, mark)
        if not found:
            buffer.append("<")
            at = mark + 1
            continue
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if not tag:
            continue
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            buffer.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if stack[-1].tag == "p" or stack[-1].tag[:1] == "h" and stack[-1].tag[1:].isdigit() and tag[:1] == "h" and tag[1:].isdigit():
            stack.pop()
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in ENDS.get(tag, ()):
                del stack[depth:]
                break
            if stack[depth].tag in SCOPES:
                break
        names = " ".join(a or b or c for _, a, b, c in NAMES.findall(attributes)) if attributes else ""
        parent = stack[-1]
        box = tag in BOXES or bool(names and BOX_NAMES.search(names))
        if not parent.inside:
            box = box or tag == "header" or bool(names and tag not in ("article", "main") and HEADER_NAMES.search(names))
        # numbers in names differ from page to page
        label = f"{tag}.{re.sub('[0-9]+', '0', names)}" if names else tag
        element = Element(tag, label, parent, box)
        parent.children.append(label)
        elements.append(element)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(element)
    flush()
    return elements, texts


def main_text(page: str, removed: set[int]) -> str:
    """Texts of the blocks that are left: neither markup nor the site's tree removes them or an element around them, and
    the site doesn't repeat them in their place. If some are in an article element, only these."""
    kept = []
    for element, text in blocks(page)[1]:
        up = element.node
        while up is not None and signed(up.number) not in removed:
            up = up.parent
        if not element.box and up is None and signed(text_number(element, text)) not in removed:
            kept.append((element.inside, text))
    inside = any(x for x, _ in kept)
    return "\n\n".join(text for x, text in kept if x or not inside)


def text_number(element: Element, text: str) -> int:
    """The number of a text at its node."""
    return xxhash.xxh64_intdigest(text, element.node.number)


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


SEEN = pa.schema([
    ("site", pa.string()), ("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("limit", pa.float64()),
    ("article", pa.int64()), ("is_style", pa.bool_()), ("feature", pa.int64())])


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (site, html) -> for each page and node its style (the labels of its children) and its distinct texts."""
    def row(host: str, e: Element, is_style: bool, feature: int) -> tuple:
        parent = signed(e.parent.number) if e.parent else None
        article = None if e.article is None else signed(e.article)
        return host, signed(e.number), parent, e.depth, e.limit, article, is_style, signed(feature)

    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            elements, texts = blocks(page or "")
            # elements that repeat in a page are one node with all their children
            children: dict[int, tuple[Element, dict]] = {}
            for e in elements:
                if e.node is e:
                    children.setdefault(e.number, (e, {}))[1].update(dict.fromkeys(e.children))
            rows += [row(host, e, True, xxhash.xxh64_intdigest(" ".join(below))) for e, below in children.values()]
            rows += {row(host, e.node, False, text_number(e, text)) for e, text in texts}
        columns = list(zip(*rows, strict=True)) or [()] * len(SEEN)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SEEN, strict=True)], schema=SEEN)


def count_pages(pages: DataFrame) -> DataFrame:
    """How many of `pages` (site, html) have each style and each text of a node, as `k`. Counts are partial sums before they
    are shuffled."""
    kinds = "site string, node long, parent long, depth int, limit double, article long, is_style boolean, feature long"
    return pages.select("site", "html").mapInArrow(_seen, kinds).groupBy([f.name for f in SEEN]).agg(F.count("*").alias("k"))


def style_tree(pages: DataFrame) -> DataFrame:
    """The tree of `pages` (site, html), see `merged_tree`."""
    return merged_tree(count_pages(pages))


def merged_tree(counted: DataFrame) -> DataFrame:
    """Pages, as counted by `count_pages`, merged to a tree per site: (site, node, pages, limit, importance, top).

    A text that k of a node's m pages have has the entropy log_m k over them; a node's content importance is 1 less the
    mean over its distinct texts: 0 if all pages have the same, 1 if no two do. The presentation importance is the
    entropy, to the base m, of the styles of its children. With l styles, importance = (1 - d^l) * mean of its children
    and content, weighted by pages, + d^l * presentation importance; of a node without children it is that of its
    content. `top` is the highest importance in the branch. The tree is walked up one depth at a time.
    """
    ln = F.log
    style = F.when(F.col("is_style"), F.col("k"))
    nodes = counted.groupBy("site", "node", "parent", "depth", "limit").agg(
        F.sum(style).alias("pages"), F.count(style).alias("styles"), F.sum(style * ln(style)).alias("style_sum"),
        F.avg(F.when(~F.col("is_style"), ln("k"))).alias("text_mean"))
    m = F.col("pages")
    nodes = settle(nodes.select(
        "site", "node", "parent", "depth", "limit", "pages",
        F.pow(F.lit(DAMPING), F.col("styles")).alias("damping"),
        F.when(m > 1, 1 - F.col("style_sum") / (m * ln(m))).otherwise(1.0).alias("presentation"),
        F.when(m > 1, 1 - F.col("text_mean") / ln(m)).when(F.col("text_mean").isNotNull(), 1.0).alias("content")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    walked, below = [], None
    for depth in range(deepest, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumns({"sum": F.lit(0.0), "weight": F.lit(0.0), "highest": F.lit(0.0)})
        else:
            level = level.join(below, ["site", "node"], "left").fillna(0.0, ["sum", "weight", "highest"])
        own = F.when(F.col("content").isNotNull(), m).otherwise(0)
        mean = (F.col("sum") + own * F.coalesce("content", F.lit(0.0))) / (F.col("weight") + own)
        importance = F.when(F.col("weight") > 0, (1 - F.col("damping")) * mean + F.col("damping") * F.col("presentation")).otherwise(
            F.coalesce("content", F.lit(0.0)))
        level = level.withColumn("importance", importance).withColumn(
            "top", F.greatest("highest", "importance", F.coalesce("content", F.lit(0.0))))
        walked.append(level.select("site", "node", "pages", "limit", "importance", "top"))
        below = level.groupBy("site", F.col("parent").alias("node")).agg(
            F.sum(F.col("importance") * m).alias("sum"), F.sum(m.cast("double")).alias("weight"), F.max("top").alias("highest"))
    return reduce(DataFrame.unionByName, walked)


def repeated_texts(counted: DataFrame, tree: DataFrame) -> DataFrame:
    """(site, feature) of the texts that a site's pages repeat at a node, whatever else the node holds: siblings without
    names are one node, and a text that k of its m pages have has the importance 1 - log_m k.

    In an article element a text goes if it is next to nothing new and the articles differ otherwise, elsewhere if its
    node's other texts differ: pages that are copies as a whole lose nothing by it.
    """
    often = counted.where(~F.col("is_style") & (F.col("k") >= LEAST_PAGES)).select("site", "node", "article", "feature", "k")
    # the node whose branch has to differ
    varies = tree.select("site", F.col("node").alias("around"), F.col("top").alias("varied"))
    size = tree.select("site", "node", "pages")
    inside = F.col("article").isNotNull()
    return (
        often.withColumn("around", F.coalesce("article", "node")).join(size, ["site", "node"]).join(varies, ["site", "around"])
        .where(F.col("varied") >= THRESHOLD)
        .where(1 - F.log("k") / F.log("pages") < F.when(inside, THRESHOLD_INSIDE).otherwise(THRESHOLD))
        .select("site", "feature"))


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every row of `pages` (page_id, url, html): page_id, url, text, n_chars.

    1. The pages of each site are merged to a style tree (see `style_tree`).
    2. A node all of whose branch has a low importance is noise, if at least LEAST_PAGES pages have it. In an article
       element only named boxes go, and only if nearly all pages repeat them.
    3. So is a text that pages repeat at a node that otherwise differs, see `repeated_texts`.
    4. Noise, and boxes that are no article by their markup (navigation, footers, adverts, forms, comments ...), are
       removed from each page; the rest is its text, see `main_text`.

    A site's list holds its removed nodes and texts only; numbers are taken out of names, and a text is on more
    than m^0.65 of m pages, so it grows like m^0.35 at most. Null html is empty; pages without text have the text ''. Pages without a host are one site. Rows may repeat;
    other columns are left out; no rows give no rows.
    """
    pages = pages.select("page_id", "url", site(F.col("url")).alias("site"), "html")
    counted = settle(count_pages(pages))
    tree = settle(merged_tree(counted))
    noise = tree.where((F.col("pages") >= LEAST_PAGES) & (F.col("top") < F.col("limit"))).select("site", "node")
    noise = noise.union(repeated_texts(counted, tree))
    noise = settle(noise.groupBy("site").agg(F.collect_list("node").alias("removed")))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = (set(x or ()) for x in batch.column("removed").to_pylist())
            found = [main_text(page or "", r) for page, r in zip(batch.column("html").to_pylist(), removed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    joined = pages.join(noise, "site", "left").select("page_id", "url", "html", "removed")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined.mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
