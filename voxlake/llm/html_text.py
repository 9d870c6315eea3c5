"""Main text of web pages: blocks of the markup, and nearest-URL page differencing.

A page becomes blocks, its text runs between block-level tags, in page order. Each block has the role of the elements
around it: of the article (article, main), of the page's furniture (navigation, headers, footers, asides, forms, adverts,
notices, comments, by element or by the words of class, id and role), or open. Scripts, styles and what else isn't text
never become blocks.

Words alone are weak evidence. Inside an article headings and headers are its own whatever they are called, ids are
anchors unless they are one of the words as a whole, and only words that never name content (comments, adverts, sharing)
make furniture; elements with other such words are open there. Around the article a block that is furniture by its words
may still hold what is called main or content.

Furniture that changes from page to page can only be told by its element. Open blocks are told by differencing: the
pages of a host are sorted by URL path, each page is paired with its nearest neighbour, the block sequences of the two
are aligned by their longest common subsequence, and shared blocks are deleted, on either page. Blocks of the article
are kept though the neighbour has them (mirrored articles stay); a page of which nothing else would stay keeps the
shared blocks too. Pages without an article whose host has one page keep all open blocks.

The neighbour comes from one range-partitioned order over all pages, in which a host with a third of all rows is many
partitions; the first and the last row of a partition travel to the partitions beside it, as rows of the same table.
Only hashes of blocks travel, and come back as short lists of shared blocks.

Pages are read by one scan, linear in their length whatever they hold. A tag that never ends, a quoted value without
its end apart, swallows the rest of the page, as in browsers; so do comments and scripts. The alignment takes memory
linear in the blocks.

Null html is empty; empty pages give an empty text. A null or unparsable url is a host of its own, paired with nothing.
Repeated rows are pages like any other; of neighbours equally near, the earlier in the order counts. Columns other
than page_id, url and html are left out. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import dropped, in_small_batches, stored_bytes, written

ARTICLE, OPEN, FURNITURE, NAMED = 0, 1, 2, 3  # the last: furniture by its words alone
#: Lists of shared blocks of up to this size in all are sent to every executor; larger ones meet the pages in a shuffled join.
BROADCAST_BYTES = 4 << 20

_SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button", "datalist", "map"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
_FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
_ARTICLE = {"article", "main"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class, id and role that mark furniture, and those that mark the article.
_FURNITURE_WORD = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|banner|footer|sidebar|aside|ads?|advert|adverts|advertisement|sponsor(?:ed)?|promo|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|comments?|disqus|reply|replies|respond|widget|pagination|pager|toolbar|login|signup|search|skip|complementary|contentinfo)(?=$|[\s_-])",
    re.I,
)
#: Those that mark furniture even inside an article, as words of class or role, or as the whole id.
_NEVER_CONTENT = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|breadcrumbs?|footer|sidebar|ads?|advert|adverts|advertisement|sponsor(?:ed)?|promo|cookies?|consent|popup|modal|newsletter|subscribe|share|sharing|social|comments?|disqus|reply|replies|respond|pagination|pager|contentinfo|related(?=$|\s|[_-](?:posts|articles|links|stories|content))|recommended(?=$|\s|[_-](?:posts|articles|links|stories|content)))(?=$|[\s_-])",
    re.I,
)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup"}
#: Names of what holds a page's text.
_CONTENT_WORD = re.compile(r"(?:^|\s)(?:main|content|article|post|entry|story)(?:[_-](?:main|content|body|text|wrap|wrapper|inner|area))?(?=$|\s)", re.I)
#: What an article element of the page's own isn't called, and words that only say how a page is laid out.
_ASIDE_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|respond|related|recommended|promo|ads?|advert|sponsored|teaser)(?=$|[\s_-])", re.I)
_LAYOUT_WORD = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|hide|show)[_-][\w-]+", re.I)
#: A whole tag without quotes, the name of a tag, and what can end the scan of one.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)([^>\"'<]*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r"[>\"']")
#: Decimal character references that are too long for a character.
_ZEROS, _HUGE = re.compile(r"&#0{8,}(?=[0-9])"), re.compile(r"&#[0-9]{9,};?")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+>?", re.I) for tag in _RAW}
#: An open element of these ends when one of the listed starts.
_ENDS = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}


def _role(tag: str, attributes: str, inside: int) -> int:
    """The role of an element opened inside `inside`. A header inside an article is the article's own."""
    if (inside == FURNITURE and tag != "main") or tag in _FURNITURE or (tag == "header" and inside != ARTICLE):
        return FURNITURE
    marks = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    if "hidden" in marks or marks.get("aria-hidden", "").lower() == "true":
        return FURNITURE
    named, called = (_LAYOUT_WORD.sub("", " ".join(marks[k] for k in keys if k in marks)) for keys in (("class", "role"), ("class", "id", "role")))
    if tag in _ARTICLE or marks.get("role", "").lower() in ("main", "article"):
        return NAMED if tag == "article" and called and _ASIDE_ARTICLE.search(called) else ARTICLE
    if inside == NAMED:
        return OPEN if called and _CONTENT_WORD.search(called) else NAMED
    if tag in ("html", "body") or not called or not _FURNITURE_WORD.search(called):
        return inside
    if inside != ARTICLE:
        return NAMED
    if tag in _HEADINGS:
        return ARTICLE
    return FURNITURE if _NEVER_CONTENT.search(named) or _NEVER_CONTENT.fullmatch(marks.get("id", "").strip()) else OPEN


def _tag_end(page: str, at: int) -> int:
    """Place of the > that ends a tag whose name ends at `at`, -1 if none does. A quote without its end is a plain character."""
    i = at
    while m := _STOP.search(page, i):
        if m[0] == ">":
            return m.start()
        i = page.find(m[0], m.end()) + 1
        if not i:
            return page.find(">", at)
    return page.find(">", at)


def _plain(parts: list[str]) -> str:
    text = "".join(parts)
    if "&" in text:
        text = entities.unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#0", text)))
    return " ".join(_SPACE.split(text)).strip()


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(role, text) of the page's blocks; white space as single spaces, character references decoded, empty blocks left out."""
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # element, role, silent
    opened: Counter[str] = Counter()  # elements on the stack
    held: list[str] = []
    role, silent, at, text_from, n = OPEN, False, 0, 0, len(page)

    def flush() -> None:
        if held:
            text = _plain(held)
            held.clear()
            if text:
                out.append((role, text))

    def pop() -> str:
        nonlocal role, silent
        tag = stack.pop()[0]
        opened[tag] -= 1
        role, silent = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
        return tag

    while True:
        i = page.find("<", at)
        if i < 0:
            i = n
        elif not (m := _PLAIN_TAG.match(page, i)):
            after = page[i + 1 : i + 2]
            m = _NAME.match(page, i)
            if not m and after not in ("!", "?"):
                at = i + 1  # a character like any other
                continue
        if i > text_from and not silent:
            held.append(page[text_from:i])
        if i == n:
            break
        if not m:
            mark, close = ("<!--", "-->") if page.startswith("<!--", i) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", i) else ("<", ">")
            end = page.find(close, i + len(mark))
            if mark == "<![CDATA[" and not silent:
                held.append(entities.escape(page[i + len(mark) : end if end >= 0 else n]))
            at = text_from = end + len(close) if end >= 0 else n
            continue
        closing, tag = m[1], m[2].lower()
        if m.re is _PLAIN_TAG:
            attributes, at = m[3], m.end()
        else:
            end = _tag_end(page, m.end())
            if end < 0:
                break
            attributes, at = page[m.end() : end], end + 1
        text_from = at
        if closing:
            if opened[tag]:
                if tag in _BLOCK:
                    flush()
                while pop() != tag:
                    pass
            elif tag in _BLOCK:
                flush()
            continue
        if tag == "br":
            if not silent:
                held.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        while stack and tag in _ENDS.get(stack[-1][0], ()):
            pop()
        if tag in _BLOCK and opened["p"]:  # a block ends an open paragraph and what is open in it
            deep = len(stack) - 1
            while stack[deep][0] != "p" and stack[deep][0] not in _BLOCK:
                deep -= 1
            if stack[deep][0] == "p":
                while len(stack) > deep:
                    pop()
        if tag in _VOID or attributes.rstrip().endswith("/"):
            continue
        if tag in _RAW:  # up to its own end tag, whatever stands between
            close = _RAW_END[tag].search(page, at)
            at = text_from = close.end() if close else n
            continue
        inner = _role(tag, attributes, role)
        if inner != role:
            flush()
        silent = silent or tag in _SILENT
        role = inner
        stack.append((tag, role, silent))
        opened[tag] += 1
    flush()
    return out


def place(url: str | None) -> tuple[str | None, str]:
    """Host (without www.) and path of a URL; the host is null if there is none."""
    try:
        parts = urlsplit((url or "").strip())
    except ValueError:
        return None, ""
    host = (parts.hostname or "").removeprefix("www.")
    return host or None, parts.path.rstrip("/") or "/"


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of all of `a` with each beginning of `b`."""
    best = np.zeros(len(b) + 1, np.int32)
    for x in a:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], (best[:-1] + 1) * (b == x)))
    return best


def _aligned(a: np.ndarray, b: np.ndarray, at: int, out: list[int]) -> None:
    """Adds the places (from `at`) of `a` on a longest common subsequence with `b`: halves of `a` against the best cut of `b`, so that memory stays linear."""
    if not len(a) or not len(b):
        return
    if len(a) == 1:
        if (b == a[0]).any():
            out.append(at)
        return
    half = len(a) // 2
    cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
    _aligned(a[:half], b[:cut], at, out)
    _aligned(a[half:], b[cut:], at + half, out)


def _rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence of different values."""
    tops: list[int] = []  # the least last value of the sequences of each length, and its place
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        n = bisect_left(tops, v)
        before[i] = at[n - 1] if n else -1
        tops[n : n + 1], at[n : n + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def shared_blocks(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of `mine` are on a longest common subsequence with `other`."""
    out = np.zeros(len(mine), bool)
    short = min(len(mine), len(other))
    differ = np.flatnonzero(mine[:short] != other[:short])
    begin = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(mine[len(mine) - short + begin :][::-1] != other[len(other) - short + begin :][::-1])
    end = int(differ[0]) if len(differ) else short - begin
    out[:begin] = True
    out[len(mine) - end :] = True
    a, b = mine[begin : len(mine) - end], other[begin : len(other) - end]
    rows, b = np.flatnonzero(np.isin(a, b)), b[np.isin(b, a)]
    a = a[rows]
    places: list[int] = []
    if len(a) == len(b) == len(np.unique(a)):  # each block once on either side: the longest rising sequence of places
        places = _rising(np.argsort(b)[np.argsort(np.argsort(a))].tolist())
    else:
        _aligned(a, b, 0, places)
    out[begin + rows[places]] = True
    return out


def main_text(found: list[tuple[int, str]], shared: set[int]) -> str:
    """Article blocks, and open ones that the neighbour doesn't share; if none are left, the open ones it shares."""
    mine = [t for i, (role, t) in enumerate(found) if role == ARTICLE or (role == OPEN and i not in shared)]
    return "\n\n".join(mine or [t for role, t in found if role == OPEN])


def _hashed(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 1


def outlines(pages: DataFrame) -> DataFrame:
    """(host, path, page, lines): of each page with a host the hashes of its blocks outside the article, as int64 bytes, in order; page is a hash of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                host, path = place(url)
                if host:
                    rows.append((host, path, page, np.array([0 if r == ARTICLE else _hashed(t) for r, t in blocks(text.as_py())], np.int64).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["host", "path", "page", "lines"])

    return in_small_batches(pages.select(_page_key(), F.col("url").cast("string"), F.col("html").cast("string"))).mapInArrow(run, "host string, path string, page bigint, lines binary")


def _page_key():
    return F.xxhash64(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string")).alias("page")


def _masked(mine: bytes, other: bytes) -> list[int]:
    """Places of blocks outside the article that the two share."""
    a = np.frombuffer(mine, np.int64)
    hit = shared_blocks(a, np.frombuffer(other, np.int64)) & (a != 0)
    return np.flatnonzero(hit).tolist()


def shared_by_neighbours(pages: DataFrame) -> DataFrame:
    """(page, shared): places of the blocks of a page that its nearest page by URL path on its host has too; pages that share none are left out."""
    found = written(outlines(pages).dropDuplicates(["page"]), "outlines")
    parts = max(1, -(-stored_bytes(found) // (8 << 20)), found.sparkSession.sparkContext.defaultParallelism)
    ordered = written(found.repartitionByRange(parts, "host", "path", "page").sortWithinPartitions("host", "path", "page").withColumn("part", F.spark_partition_id()), "ordered")
    # each partition's first and last page travel to its neighbours; the driver sees the numbers of the filled partitions alone
    filled = sorted(r["part"] for r in ordered.select("part").distinct().collect())
    beside = found.sparkSession.createDataFrame([(p, q, side) for p, q, side in [*zip(filled[1:], filled, [-1] * len(filled)), *zip(filled, filled[1:], [1] * len(filled))]], "to int, part int, side int")
    keys = F.struct("host", "path", "page", "lines")
    ends = ordered.groupBy("part").agg(F.min(keys).alias("first"), F.max(keys).alias("last"))
    borders = ends.join(F.broadcast(beside), "part").withColumn("row", F.when(F.col("side") < 0, F.col("last")).otherwise(F.col("first")))
    rows = ordered.withColumn("side", F.lit(0)).unionByName(borders.select(F.col("to").alias("part"), "side", "row.*"))
    result = written(rows.groupBy("part").applyInArrow(_paired, "page bigint, shared array<int>"), "shared")
    dropped(found)
    dropped(ordered)
    return result


def _prefix(a: str, b: str) -> str:
    return commonprefix([a, b])


def _paired(group: pa.Table) -> pa.Table:
    """The shared blocks of a partition's pages (side 0), with the last page before it (-1) and the first one after it (1)."""
    group = group.sort_by([("side", "ascending"), ("host", "ascending"), ("path", "ascending"), ("page", "ascending")])
    rows = list(zip(*(group.column(c).to_pylist() for c in ("side", "host", "path", "page", "lines")), strict=True))
    out = []
    for i, (side, host, path, page, lines) in enumerate(rows):
        if side == 0:
            beside = [r for r in (*rows[max(0, i - 1) : i], *rows[i + 1 : i + 2]) if r[1] == host]
            near = max(beside, key=lambda r: len(_prefix(r[2], path)), default=None)  # on a tie the earlier one
            places = _masked(lines, near[4]) if near else []
            if places:
                out.append((page, places))
    return pa.table({"page": pa.array([p for p, _ in out], pa.int64()), "shared": pa.array([x for _, x in out], pa.list_(pa.int32()))})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of `pages` (page_id, url, html)."""
    shared = shared_by_neighbours(pages)
    if stored_bytes(shared) <= BROADCAST_BYTES:
        shared = F.broadcast(shared)
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"), _page_key()).join(shared, "page", "left").select("page_id", "url", "html", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(blocks(h.as_py()), set(s or ())) for h, s in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
