"""HTML extraction: block text by structure, then nearest-URL page differencing.

1. A page is read into blocks (text between block tags; white space collapsed, references decoded), each with the mark
   whether it stands in the page's main content (article, main, or role=main). Scripts, styles, forms, navigation, footers and asides hold
   no blocks, nor do containers that name themselves as an advert, a menu, a notice, comments and so on.
2. Pages of a host with the same blocks are one page, at the first of their URLs: copies neither stand between a page and its neighbours nor
   get other results. They are ordered by URL path. Ranges of that order are tasks, and what stands at a range's ends is handed to
   the adjoining ranges, so the neighbours are the same at every size and a host with very many pages is many tasks.
3. The blocks of a page are aligned with those of its nearest neighbours by a longest common subsequence. What it shares with both of the two nearest
   is the site's template and is deleted. Where more than half of a page would go (copies of an article with other surroundings), the
   next two must share it too.
   Blocks in marked main content are protected: equal text there is a quotation or a copy and belongs to the article.

Neighbours are found on block hashes; page text does not cross the network for it. Positions to delete come back to the pages by
a join, where only pages with any take part on that side: broadcast where they are few, which is checked, else by a shuffle.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Elements without text of their own in a page's main content.
DROPPED = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "title", "button", "select", "option", "textarea", "iframe", "object", "svg", "math", "canvas", "audio", "video", "menu", "dialog"}
#: Read as raw text up to their end tag.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
#: Elements that may name themselves as something other than content; headings, paragraphs and what stands in them may not.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "center", "details", "header", "fieldset"}
#: Names of reader comments: of any container, and of an article within main content (a comment). A section's id otherwise is an anchor of the article.
COMMENTS = {"comment", "comments", "responses", "disqus"}
#: A container is named by a word of class, id or role whose parts (between - and _) are all among these, one of the first group at least.
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "newsletter", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "responses", "feedback", "disqus", "complementary", "contentinfo", "popup"}
PARTS = {"banner", "bar", "block", "bottom", "box", "container", "content", "form", "inner", "item", "left", "list", "main", "outer", "page", "panel", "reader", "readers", "right", "section", "signup", "site", "slot", "thread", "top", "unit", "user", "users", "widget", "wrap", "wrapper"}
ENDS_P = BLOCKS - {"html", "body"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Rows of positions to delete that may be broadcast.
SMALL = 200_000


def _names(tag: str, attributes: str, in_main: bool) -> bool:
    """Does the element name itself as something other than content?"""
    if tag in DROPPED or tag == "header" and not in_main:
        return True
    if not attributes:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if tag not in ("html", "body", "article", "main") and ("hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")):
        return True
    for key in ("class", "id", "role"):
        for word in found.get(key, "").lower().split():
            parts = {p.rstrip("0123456789") for p in re.split("[_-]+", word)} - {""}
            if tag == "article":
                if in_main and parts & COMMENTS and parts <= NAMES | PARTS:
                    return True
            elif tag in CONTAINERS and parts <= NAMES | PARTS | {"header"}:
                if tag == "section" and key == "id" and in_main and not parts & COMMENTS:
                    continue
                if parts & NAMES or "header" in parts and not in_main:
                    return True
    return False


def blocks(page: str | None) -> tuple[list[str], list[bool]]:
    """The blocks of a page outside dropped containers, and whether each is in main content."""
    page = page or ""
    lines: list[str] = []
    main: list[bool] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, is it dropped, is it main
    dropped = mains = 0

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                lines.append(line)
                main.append(mains > 0)
            text.clear()

    def close(down_to: int) -> None:
        nonlocal dropped, mains
        while len(stack) > down_to:
            _, drop, is_main = stack.pop()
            dropped -= drop
            mains -= is_main

    at = 0
    while True:
        token = TOKEN.search(page, at)
        piece = page[at : token.start() if token else len(page)]
        if piece and not dropped:
            text.append(piece)
        if not token:
            break
        at = token.end()
        if not token[2]:
            if token[0].startswith("<![CDATA[") and not dropped:
                text.append(html.escape(token[0][9:-3], quote=False))
            continue
        tag, closing = token[2].lower(), bool(token[1])
        if not dropped:
            if tag in BLOCKS:
                flush()
            elif tag in ("br", "td", "th"):
                text.append(" ")
        if closing:
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if open_at is not None:
                close(open_at)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            raw = page[at : end.start() if end else len(page)]
            if tag == "xmp" and not dropped:
                text.append(html.escape(raw, quote=False))
            at = end.end() if end else len(page)
            continue
        if tag in VOID or token[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in ENDS_P:  # a block ends an open paragraph, and with it what is open in that
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag == "li":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "li":
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "menu"):
                    break
        drop = _names(tag, token[3], mains > 0)
        is_main = tag in ("article", "main") or 'role="main"' in token[3]
        stack.append((tag, drop, is_main))
        dropped += drop
        mains += is_main
        if drop:
            flush()
    flush()
    return lines, main


def common_lines(a: Sequence[int], b: Sequence[int]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b (Hunt and Szymanski), after equal ends are matched."""
    n, m, start = len(a), len(b), 0
    while start < n and start < m and a[start] == b[start]:
        start += 1
    end = 0
    while end < n - start and end < m - start and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    found = {*range(start), *range(n - end, n)}
    where = defaultdict(list)
    for j in range(m - end - 1, start - 1, -1):
        where[b[j]].append(j)
    tops: list[int] = []
    links: list[tuple] = []
    for i in range(start, n - end):
        for j in where.get(a[i], ()):
            k = bisect_left(tops, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                links.append(link)
            else:
                tops[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def template(own: Sequence[int], others: Sequence[Sequence[int]], sizes: Sequence[int]) -> set[int]:
    """Positions of blocks that a page shares with its neighbours, given from the nearest on: with the two nearest, or with all if that is more than half of it. One that differs by marks only says nothing."""
    others = [o for o in others if list(o) != list(own)]
    if not others:
        return set()
    shared = set.intersection(*(common_lines(own, o) for o in others[:2]))
    if 2 * sum(sizes[i] for i in shared) > sum(sizes):
        shared = set.intersection(shared, *(common_lines(own, o) for o in others[2:]))
    return shared


def content(host: str, lines: Sequence[str], main: Sequence[bool]) -> bytes:
    """Digest of a page's blocks and marks within its host: what copies have in common."""
    return xxhash.xxh3_128_digest("\n".join([host, *(f"{x}{m:d}" for x, m in zip(lines, main))]).encode("utf-8", "surrogatepass"))


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [blocks(p) for p in batch["html"]]
        hashes = [[xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines] for lines, _ in rows]
        yield batch.drop(columns="html").assign(key=[content(h, *r) for h, r in zip(batch["host"], rows)], hashes=hashes, sizes=[[len(x) for x in lines] for lines, _ in rows], main=[r[1] for r in rows])


def _cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        cut = []
        for own, sizes, main, others in zip(batch["hashes"], batch["sizes"], batch["main"], batch["others"]):
            free = [] if all(main) else template(own.tolist(), [o.tolist() for o in others], sizes.tolist())
            cut.append([i for i in sorted(free) if not main[i]])
        found = pd.DataFrame({"key": batch["key"], "cut": cut})
        yield found[found["cut"].map(len) > 0]


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [blocks(p) for p in batch["html"]]
        yield batch.drop(columns=["html", "host"]).assign(key=[content(h, *r) for h, r in zip(batch["host"], rows)], lines=[r[0] for r in rows])


def _neighbours(read: DataFrame) -> DataFrame:
    """read (host, path, url, key, range, hashes ...) with others: hashes of the nearest pages of the host, two on either side at most, the next one first."""
    order = Window.partitionBy("host", "range").orderBy("path", "url", "key")
    inner = read.withColumns({"next1": F.lead("hashes", 1).over(order), "next2": F.lead("hashes", 2).over(order), "last1": F.lag("hashes", 1).over(order), "last2": F.lag("hashes", 2).over(order)})
    at = inner.withColumns({"is_first": F.col("last2").isNull(), "is_last": F.col("next2").isNull()}).where("is_first OR is_last")
    pick = lambda which, by: F.array_sort(F.collect_list(F.when(F.col(which), F.struct(*by, "hashes"))))["hashes"]
    by = ("path", "url", "key")
    ends = at.groupBy("host", "range").agg(pick("is_first", by).alias("first"), F.reverse(pick("is_last", by)).alias("last"))  # two rows of a range each
    by_range = Window.partitionBy("host").orderBy("range")  # one row a range
    near = lambda c, f: F.slice(F.concat(F.coalesce(f(c, 1).over(by_range), none), F.coalesce(f(c, 2).over(by_range), none)), 1, 2)
    none = F.array().cast("array<array<bigint>>")
    ends = ends.select("host", "range", near("first", F.lead).alias("after"), near("last", F.lag).alias("before"))
    side = lambda a, b, rest: F.slice(F.filter(F.concat(F.array(a, b), F.col(rest)), lambda x: x.isNotNull()), 1, 2)
    sides = inner.join(ends, ["host", "range"]).withColumns({"next": side("next1", "next2", "after"), "last": side("last1", "last2", "before")})
    others = F.filter(F.array(*[F.get(c, F.lit(i)) for i in (0, 1) for c in ("next", "last")]), lambda x: x.isNotNull())
    return sides.withColumn("others", others)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars (code points).

    A null or empty html has an empty text, and a page without any content block too. A null or unusual url is in a host of its own
    name (the empty one), ordered by the whole url. Different pages with one url are neighbours, in the order of
    a digest. A page alone in its host, or among copies of itself only, has no neighbour and loses no block to it. Pages of a host with
    the same blocks, repeated rows among them, have the same text and a row each; other columns are ignored. Whole pages are read, whatever their length.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    cut = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
    keyed = pages.select("page_id", "url", F.lower(F.regexp_extract(url, cut, 1)).alias("host"), F.when(url.rlike(cut), F.regexp_extract(url, cut, 2)).otherwise(url).alias("path"), "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    read = keyed.withColumn("url", url).drop("page_id").mapInPandas(_hashes, "url string, host string, path string, key binary, hashes array<bigint>, sizes array<int>, main array<boolean>")
    distinct = read.groupBy("host", "key").agg(F.min(F.struct("path", "url", "hashes", "sizes", "main")).alias("of")).select("host", "key", "of.*")
    ranges = durable(distinct, "contents").repartitionByRange("host", "path", "url", "key").withColumn("range", F.spark_partition_id())
    cuts = durable(_neighbours(durable(ranges, "blocks")).select("key", "hashes", "sizes", "main", "others").mapInPandas(_cuts, "key binary, cut array<int>"), "cuts")
    lines = keyed.select("page_id", "url", "host", "html").mapInPandas(_lines, f"page_id {kind}, url string, key binary, lines array<string>")
    both = lines.join(F.broadcast(cuts) if cuts.limit(SMALL + 1).count() <= SMALL else cuts, "key", "left")
    text = F.array_join(F.when(F.col("cut").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("cut", i))), "\n")
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
