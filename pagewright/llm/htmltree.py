"""Main text of web pages by a site style tree.

The pages of one host are merged into a tree: a node is an element's path of
tags with class and id; it counts in how many pages it occurs, with which
sequences of child elements (presentation) and with which texts (content).
Pages of equal content count once, so an article that a host shows under many
addresses is no template.  A node's importance is the larger of two entropies
over the pages, that of its layouts and that of its texts (those of the
elements below it included), each relative to the largest possible one: 1 where
every page differs, 0 where all are alike.

What HTML's own meaning, a telling class or id or a role says about an element
is the prior: menus, footers, adverts, forms and the like are noise, and of a
page that marks its article (or else a main part) the text inside it stands.
The tree decides about the rest.  A branch on at least ``MIN_PAGES`` pages of
too little importance, measured against the host's article, is removed, inside
the article too (a repeated notice).  A heading or paragraph outside the article
stays where it is as important as the article itself (a title or lead).

Statistics are (host, path, value) counts made by Spark; only the paths that
the tree decides about come back to the pages, as one row for each host.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import scratch_path, ship_package

from .textkernel import text_chunks

MIN_PAGES = 8
MIN_IMPORTANCE = 0.2  # of a branch, relative to the article's
LEAD_IMPORTANCE = 0.9  # of a heading or paragraph outside the article
MAX_DEPTH = 200  # deeper elements count as children of the last level

# HTML's own meaning of elements.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NOISE_TAGS = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg",
                    "object", "audio", "video", "canvas", "datalist", "fieldset", "label", "option", "optgroup",
                    "input"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog",
         "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table",
         "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
# A start tag that ends an open paragraph or an open element of its kind.
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "aside", "nav", "body", "html", "header",
         "footer", "form", "blockquote"}
NOISE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|header|"
    r"masthead|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|comments?|"
    r"comment-\w+|disqus|replies|related|recommend\w*|pagination|pager|widget|toolbar|skip|copyright)(?:$|[\s_-])", re.I)
NOISE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu",
              "menubar", "form"}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
                    r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|$)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_MARKED = r"/(article|main)(\.[^/]*)?$"
_FRAME = r"^(/(html|body|main|article)(\.[^/]*)?)*$"
_INSIDE = r"/article(\.[^/]*)?(/|$)"
_LEAD = r"/(h[1-3]|p)(\.[^/]*)?$"
_SPACE = re.compile(r"\s+")


class Block:
    """A piece of page text: its words and the paths of the elements above."""
    __slots__ = ("path", "text", "noise", "article")

    def __init__(self, path, text, noise, article):
        self.path, self.text, self.noise, self.article = path, text, noise, article


def parse(page: str) -> tuple[list[Block], dict[str, list[str]]]:
    """(blocks in page order, {path: children}) of one page.

    The open elements are a list, so depth costs no recursion; unclosed and
    stray tags are taken as browsers do in the common cases.
    """
    blocks: list[Block] = []
    children: dict[str, list[str]] = {}
    # open elements: (tag, path, noise, article: 2 inside an article, 1 inside main)
    stack = [("", "", False, 0)]
    words: list[str] = []

    def end_block():
        if words:
            text = _SPACE.sub(" ", entities.unescape("".join(words))).strip()
            words.clear()
            if text:
                _, path, noise, article = stack[-1]
                blocks.append(Block(path, text, noise, article))

    def close(at):
        if any(s[0] in BLOCK for s in stack[at:]) or stack[at][2] != stack[at - 1][2]:
            end_block()
        del stack[at:]

    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        if not m:
            words.append(page[pos:])
            break
        if m.start() > pos:
            words.append(page[pos:m.start()])
        pos = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            at = len(stack) - 1
            while at and stack[at][0] != tag and not (tag not in BLOCK and stack[at][0] in SCOPE):
                at -= 1
            if at and stack[at][0] == tag:
                close(at)
            elif tag in BLOCK:
                end_block()
            continue
        # elements that this one ends
        if tag in CLOSES_P or tag in CLOSES:
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            at = len(stack) - 1
            while at and stack[at][0] not in SCOPE:
                if stack[at][0] in ends:
                    close(at)
                at -= 1
        attrs = {a.group(1).lower(): a.group(2) or a.group(3) or a.group(4) or ""
                 for a in _ATTR.finditer(m.group(3))} if m.group(3).strip("/ ") else {}
        name = " ".join(attrs[k] for k in ("class", "id") if attrs.get(k))
        _, above, noise, article = stack[-1]
        own = (tag + ("." + ".".join(name.split()) if name else "")).replace("/", "_")
        path = f"{above}/{own}" if len(stack) < MAX_DEPTH else above
        bad = tag in NOISE_TAGS or (tag not in ("body", "html", "article", "main") and bool(
            (name and NOISE_NAME.search(name)) or attrs.get("role", "").lower() in NOISE_ROLE
            or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "")))
        # a heading block inside an article belongs to it
        if tag == "header" and article and not name:
            bad = False
        if tag in BLOCK or bad != noise:
            end_block()
        children.setdefault(above, []).append(own)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        if not m.group(3).rstrip().endswith("/") or tag not in ("path", "circle", "rect"):
            stack.append((tag, path, noise or bad, max(article, {"article": 2, "main": 1}.get(tag, 0))))
    end_block()
    return blocks, children


def host_of(url) -> Column:
    """Host without ``www.``, user and port; empty for a null or odd URL."""
    host = F.lower(F.regexp_extract(F.coalesce(F.trim(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def _prefixes(path: str):
    at = path.find("/", 1)
    while at > 0:
        yield path[:at]
        at = path.find("/", at + 1)
    yield path


def _page_nodes(page: str) -> tuple[int, list[tuple[str, str, int]]]:
    """(hash of the page's content, [(path, "p" or "c", hash of its layout or text)])."""
    blocks, children = parse(page)
    nodes = []
    for path, kids in children.items():
        runs = [k for i, k in enumerate(kids) if not i or kids[i - 1] != k]
        nodes.append((path, "p", hash_text("|".join(runs))))
    content: dict[str, list[str]] = {}
    for b in blocks:
        for p in _prefixes(b.path):
            content.setdefault(p, []).append(b.text)
    nodes += [(path, "c", hash_text("\n".join(parts))) for path, parts in content.items()]
    kept = [b for b in blocks if not b.noise]
    level = max((b.article for b in kept), default=0)
    return hash_text("\n".join(b.text for b in kept if b.article == level)), sorted(nodes)


def style_tree(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, path, pages, layouts, texts): how many pages of a host have the
    node, pages of equal content counting once, and the entropy of its layouts
    and of its texts relative to log(pages)."""
    def run(batches):
        for batch, texts in text_chunks(batches, "html"):
            found = [_page_nodes(t) for t in texts]
            ptr = [0]
            for _, nodes in found:
                ptr.append(ptr[-1] + len(nodes))
            paths, kinds, values = zip(*[n for _, nodes in found for n in nodes]) if ptr[-1] else ((), (), ())
            nodes = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.string()),
                                                pa.array(values, pa.int64())], names=["path", "kind", "value"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([p for p, _ in found], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), nodes)], names=["host", "page", "nodes"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    seen = rows.mapInArrow(run, "host string, page bigint, nodes array<struct<path: string, kind: string, value: bigint>>")
    once = seen.groupBy("host", "page").agg(F.min("nodes").alias("nodes"))
    nodes = once.select("host", F.explode("nodes").alias("node")).select("host", "node.*")
    each = nodes.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    # entropy of n / N is log N - sum(n log n) / N
    sums = each.groupBy("host", "path", "kind").agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.log("n")).alias("L"))
    share = F.when(F.col("N") > 1, (F.log("N") - F.col("L") / F.col("N")) / F.log("N")).otherwise(1.0)
    return sums.groupBy("host", "path").agg(
        F.max("N").alias("pages"), F.max(F.when(F.col("kind") == "p", share)).alias("layouts"),
        F.max(F.when(F.col("kind") == "c", share)).alias("texts"))


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def decisions(tree: DataFrame, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE,
              lead_importance: float = LEAD_IMPORTANCE) -> DataFrame:
    """(host, noise, lead): the paths that the tree decides about.

    ``noise``: branches on enough pages whose importance is below
    ``min_importance`` of that of the host's marked article (or main part; of 1
    where none is marked).  ``lead``: headings and paragraphs outside the article
    with at least ``lead_importance`` of it.
    """
    often = tree.filter(F.col("pages") >= min_pages).withColumn(
        "importance", F.greatest(F.coalesce("layouts", F.lit(0.0)), F.coalesce("texts", F.lit(0.0))))
    marked = often.filter(F.col("path").rlike(_MARKED)).groupBy("host").agg(F.max("importance").alias("article"))
    often = often.join(marked, "host", "left")
    low = (F.col("importance") < min_importance * F.coalesce("article", F.lit(1.0))) & ~F.col("path").rlike(_FRAME)
    lead = ((F.col("importance") >= lead_importance * F.col("article")) & F.col("path").rlike(_LEAD)
            & ~F.col("path").rlike(_INSIDE))
    kind = F.when(low, "noise").when(lead, "lead")
    paths = often.select("host", "path", kind.alias("kind")).filter("kind is not null")
    return paths.groupBy("host").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("path")))).alias(k) for k in ("noise", "lead")])


def main_text(blocks: list[Block], noise: set[str], lead: set[str] = frozenset()) -> str:
    """Blocks that stand under no noisy branch; of pages that mark an article
    or else a main part, those inside it and leads outside."""
    kept = [b for b in blocks if not b.noise]
    level = max((b.article for b in kept), default=0)
    kept = [b for b in kept if b.article == level or b.path in lead]
    return "\n".join(b.text for b in kept if not noise or not any(p in noise for p in _prefixes(b.path)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """(id, url, text, n_chars) of every page.

    A null or empty page and one without main text have an empty text.  A null
    url stands for a host of its own.  Repeated rows give repeated results, and
    count once in the tree, like all pages of equal content.
    """
    ship_package(pages.sparkSession)
    spark = pages.sparkSession
    path = scratch_path(spark, "style-tree")
    decisions(style_tree(pages, url_col, html_col), min_pages, min_importance).write.parquet(path)
    # the paths of a host's templates; read from a table of known size, they are
    # broadcast if that is small and else joined by host
    per_host = spark.read.parquet(path)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).join(per_host, "host", "left").drop("host")

    def run(batches):
        for batch, texts in text_chunks(batches, "html"):
            out = [main_text(parse(t)[0], set(n or ()), set(l or ())) for t, n, l in
                   zip(texts, batch.column("noise").to_pylist(), batch.column("lead").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(out, pa.string()),
                 pa.array([len(t) for t in out], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint")
    return found.toDF(id_col, url_col, "text", "n_chars")
