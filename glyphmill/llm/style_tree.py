"""Operator 1: the main text of web pages by site style trees.

The pages of a host are merged into one tree of style nodes: a style node is the
path of block elements (tag, id or class) from the body down. A node's importance
has two sides. Presentation: an element whose tag, role, class or id says that it
is a menu, header, footer, sidebar, notice, advert, form or reader comment has
none, and where a page marks its article, what stands outside has none either.
Content: the entropy of what the host's pages hold at the node, over the entropy
of all pages differing. A node with the same content on nearly every page tells
nothing about a page and scores near zero. Each page then loses the branches of
low importance, and what remains is its text.

Every page is parsed alone. The merge is two grouped counts, (host, path, content)
and then (host, path), so a host with a third of the pages is summed in parts;
only the low nodes, a few per site, go back to the pages by a join on the host.

Null or empty html gives an empty text. A page whose url is null or has no host
belongs to the host "". Repeated rows count as pages of their own and each gets
its text. Cut-off markup, unclosed and misplaced tags are read as far as they go.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import sliced
from glyphmill.session import materialise

RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|canvas"
#: The rest of a tag; a quote that is never closed runs to the end of the page.
IN_TAG = r"""(?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b{IN_TAG}(?:/>|>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    rf"|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{IN_TAG})(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: A block start ends an open paragraph; list items and cells end their open like.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table article section div body main html blockquote nav aside".split())
DROPPED = frozenset("head title nav header footer aside form button dialog menu fieldset".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation topnav "
    "breadcrumb breadcrumbs sidebar sidenav aside header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription share sharing social related recommended comment comments reply replies disqus respond login signup signin search searchform "
    "form pagination pager toolbar complementary contentinfo".split()
)
KEPT = frozenset("article main body html".split())
SPACES = re.compile(r"[\x20\x09-\x0D]+")
#: Content entropy under which a style node seen on at least ``LEAST_PAGES`` pages is a template.
LEAST_IMPORTANCE = 0.1
LEAST_PAGES = 8
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def style(tag: str, attrs: str) -> tuple[str, bool]:
    """The name of the style node, and whether its presentation alone rules it out."""
    if not attrs or "=" not in attrs:
        return tag, tag in DROPPED
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    label = " ".join(named.values()).lower()
    noise = tag not in KEPT and any(w in NOISE for w in re.split(r"[\s_-]+", label))
    return f"{tag}.{label}" if label else tag, noise or tag in DROPPED


def blocks(page: str) -> list[tuple[str, str]]:
    """The page's blocks of text in order, each with its style path, without those that presentation rules out."""
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, dropped, inside an article
    held: list[str] = []
    at = 0

    def text(upto: int) -> None:
        if at < upto and not (stack and stack[-1][2]):
            held.append(page[at:upto])

    def flush() -> None:
        if held:
            found = SPACES.sub(" ", html.unescape("".join(held))).strip(" ")
            held.clear()
            if found:
                path = next((s[1] for s in reversed(stack) if s[0] not in INLINE), "")
                out.append((path, found, any(s[3] for s in stack[-1:])))

    def close(tags: set[str]) -> None:
        """End the innermost open element of ``tags``, unless a container stands between."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                flush()
                del stack[i:]
                return
            if stack[i][0] in HOLDS:
                return

    for m in TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i]
                        break
                    if stack[i][0] not in INLINE:
                        break
            elif any(s[0] == tag for s in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag == "br":
            if not (stack and stack[-1][2]):
                held.append(" ")
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            flush()
            close({"p", "h1", "h2", "h3", "h4", "h5", "h6"} if tag[0] == "h" and tag[1:].isdigit() else {"p"})
            if tag in CLOSES:
                close(CLOSES[tag])
        if m["attrs"].endswith("/") and tag in INLINE:
            continue
        name, noise = style(tag, m["attrs"])
        above = stack[-1] if stack else ("", "", False, False)
        path = above[1] if tag in INLINE else f"{above[1]}/{name}"
        stack.append((tag, path, above[2] or noise, above[3] or tag in ("article", "main")))
    text(len(page))
    flush()
    marked = any(inside for _, _, inside in out)
    return [(path, found) for path, found, inside in out if inside or not marked]


def nodes(found: list[tuple[str, str]]) -> dict[str, str]:
    """What the page holds at each of its style nodes, the nodes above its blocks included."""
    held: dict[str, list[str]] = {}
    for path, text in found:
        parts = path.split("/")
        for depth in range(2, len(parts) + 1):
            held.setdefault("/".join(parts[:depth]), []).append(text)
    return {path: "\n".join(texts) for path, texts in held.items()}


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_host", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")))


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, path, content) of every style node of every page; content is a hash."""
    import pyarrow as pa
    import xxhash

    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("content", T.LongType())])

    def run(batches):
        for batch in sliced(batches, "html"):
            rows = []
            for host, page in zip(batch.column("_host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, text in nodes(blocks(page or "")).items():
                    rows.append((host, path, xxhash.xxh3_64_intdigest(text) - 2**63))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["host", "path", "content"])

    return with_host(pages).select("_host", "html").mapInArrow(run, schema)


def importances(found: DataFrame) -> DataFrame:
    """Per style node: pages, and the entropy of its contents over that of as many different contents.

    With m pages and c of them holding a content, that is (log m - sum(c log c) / m) / log m.
    """
    counted = found.groupBy("host", "path", "content").agg(F.count("*").alias("c"))
    summed = counted.groupBy("host", "path").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("s"))
    value = F.when(F.col("pages") > 1, 1 - F.col("s") / F.col("pages") / F.log("pages")).otherwise(F.lit(1.0))
    return summed.select("host", "path", "pages", value.alias("importance"))


def main_text(pages: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url and text."""
    import pyarrow as pa

    scored = importances(style_nodes(pages))
    low = scored.filter((F.col("pages") >= least_pages) & (F.col("importance") < least))
    low = materialise(low.groupBy(F.col("host").alias("_host")).agg(F.collect_list("path").alias("_low")), "low-nodes")
    joined = with_host(pages.select("page_id", "url", "html")).join(low, "_host", "left").select("page_id", "url", "html", "_low")
    schema = T.StructType([*(pages.schema[c] for c in ("page_id", "url")), T.StructField("text", T.StringType())])

    def kept(page: str | None, paths: list[str] | None) -> str:
        found = blocks(page or "")
        if paths:
            found = [(p, t) for p, t in found if not any(p == x or p.startswith(f"{x}/") for x in paths)]
        return "\n".join(t for _, t in found)

    def run(batches):
        for batch in sliced(batches, "html"):
            texts = [kept(p, x) for p, x in zip(batch.column("html").to_pylist(), batch.column("_low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(run, schema)
