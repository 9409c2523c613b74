"""Main text of web pages by nearest-URL page differencing."""

from __future__ import annotations

import html
import itertools
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("nav header footer aside menu form dialog head button fieldset select datalist optgroup option".split())
CONTENT = frozenset("article main".split())
# Words of class or role that mark what is no part of an article, wherever they stand.
FOREIGN = r"ads?|advert|adverts|advertisement|advertisements|advertising|adsense|sponsor|sponsored|sponsors|promo|promos|promotion|promoted|nav|navbar|navigation|menu|breadcrumbs?|footer|sidebar|related|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|share|sharing|social|comments?|reply|replies|disqus|login|complementary|contentinfo|form"
# Those that mark it outside an article only.
OUTER = FOREIGN + r"|banner|header|masthead|widgets?|search"
# Those that mark it on the very elements that hold articles.
REMARKS = r"comments?|reply|replies|related|advert|advertisement|ads?|sponsored|promo"
# What stands before or behind such a word within one token.
_BEFORE, _BEHIND = r"(?:site|page|main|top|bottom|left|right|global|primary|secondary|post|entry|user|reader)", r"(?:area|bar|banner|block|body|box|bottom|buttons?|consent|container|content|form|icons?|inner|links?|list|menu|nav|notice|popup|posts?|section|signup|slot|thread|tools|top|unit|widget|wrap|wrapper)"


def _tokens(words: str) -> re.Pattern:
    """Whole tokens only: of ``share-buttons`` and ``share-price`` the second names a thing, not a part of the page."""
    return re.compile(rf"(?:{_BEFORE}[-_])?(?:{words})(?:[-_](?:{words}|{_BEHIND}))*", re.I)


_FOREIGN, _OUTER, _REMARKS = _tokens(FOREIGN), _tokens(OUTER), _tokens(REMARKS)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_HINT = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPACE = re.compile(r"\s+")

#: A line: its text, and whether it stands outside the article (2), in it (1) or nothing tells (0).
Line = tuple[str, int]


def marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's attributes say that it is no part of an article.

    Classes and roles count by whole tokens. So do ids outside articles,
    where they name parts of the page; inside, they name the article's own
    sections and count only where a block of comments or adverts is so named.
    Headings are never marked, nor is the whole page.
    """
    if name in ("html", "body") or name in _HEADINGS:
        return False
    words = _REMARKS if name in CONTENT else _FOREIGN if inside else _OUTER
    for kind, *values in _HINT.findall(attributes):
        own = words
        if kind.lower() == "id" and (inside or name in CONTENT):
            if name not in ("div", "ul", "ol", "dl"):
                continue
            own = _REMARKS
        if any(own.fullmatch(token) for token in "".join(values).split()):
            return True
    return False


def lines_of(source: str) -> list[Line]:
    """The text lines of a page in order, one for each block, markup and scripts left out."""
    out: list[Line] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    role = 0

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, role))

    def close_from(k: int) -> None:
        nonlocal role
        outer = stack[k - 1][1] if k else 0
        if outer != role:
            flush()
        del stack[k:]
        role = outer

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            held.append(source[at:])
            break
        held.append(source[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        if not m[1] and stack and stack[-1][0] == "option" and (name in BLOCK or name in ("option", "optgroup")):  # its end tag is optional
            close_from(len(stack) - 1)
        if m[1]:  # an end tag closes all that was opened since
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close_from(k)
                    break
        elif name in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else end
        elif name not in VOID and not m[3].endswith("/"):
            if name == "p":  # a paragraph ends the open one
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close_from(k)
                    if stack[k : k + 1] and stack[k][0] in BLOCK:
                        break
            inner = role
            if role != 2:
                top = name in OUTSIDE and not (name == "header" and role == 1)
                if top or m[3] and (_HIDDEN.search(m[3]) or marked(name, m[3], role == 1)):
                    flush()
                    inner = 2
                elif name in CONTENT:
                    flush()
                    inner = 1
            stack.append((name, inner))
            role = inner
    flush()
    return out


def shared_lines(mine: list[int], theirs: list[int]) -> set[int]:
    """Positions in ``mine`` on a longest common subsequence with ``theirs``.

    Equal ends are taken off first; between them only lines that both pages
    have are aligned, so a page's own long text costs nothing.
    """
    n, m = len(mine), len(theirs)
    head = 0
    while head < min(n, m) and mine[head] == theirs[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and mine[n - 1 - tail] == theirs[m - 1 - tail]:
        tail += 1
    found = set(range(head)) | set(range(n - tail, n))
    both = set(mine[head : n - tail]) & set(theirs[head : m - tail])
    a = [i for i in range(head, n - tail) if mine[i] in both]
    b = [x for x in theirs[head : m - tail] if x in both]
    if not a:
        return found
    # positions of each line in b, and the longest rising run of them (Hunt-Szymanski)
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends: list[int] = []
    links: list[tuple[int, int, object]] = []
    last: list[object] = []
    for i in a:
        for j in reversed(where[mine[i]]):
            k = bisect_left(ends, j)
            link = (i, j, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[k] = j
                last[k] = link
    link = last[-1] if last else None
    while link:
        found.add(link[0])
        link = link[2]
    return found


def _packed(lines: list[Line]) -> bytes:
    """Whether the page marks an article, and its lines, those that its marks rule out as places only."""
    article = any(role == 1 for _, role in lines)
    kept = [t if role == 1 or not article and role == 0 else None for t, role in lines]
    return zstandard.ZstdCompressor(level=9).compress(json.dumps([article, kept], ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"))


def _unpacked(blob: bytes) -> tuple[bool, list[str | None]]:
    return tuple(json.loads(zstandard.ZstdDecompressor().decompress(blob).decode("utf-8", "surrogatepass")))


def parsed(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, host, path, lines, hashes, digest`` of every page, whatever it marks.

    ``lines`` are packed, those that marks rule out without their text;
    ``hashes`` are eight bytes for each line, ``digest`` is their hash.
    """
    url = F.lower(F.coalesce(F.col(url_col), F.lit("")))
    host = F.regexp_replace(F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1), r"^www\.", "")
    path = F.regexp_extract(url, r"^(?:(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                blobs, prints = [], []
                for source in part.column(4):
                    lines = lines_of(source.as_py() or "")
                    blobs.append(_packed(lines))
                    prints.append(b"".join(xxhash.xxh3_64_digest(t.encode("utf-8", "surrogatepass")) for t, _ in lines))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(blobs, pa.binary()), pa.array(prints, pa.binary())], names=["page_id", "url", "host", "path", "lines", "hashes"])

    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    return read.mapInArrow(run, "page_id long, url string, host string, path string, lines binary, hashes binary").withColumn("digest", F.xxhash64("hashes"))


def shared_with_neighbours(lines: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """``host, digest, shared``: which lines of a page its nearest pages have too.

    ``lines`` holds ``host, path, digest, hashes``; pages of equal lines on
    one host are one, at the least of their paths. They are dealt by ranges
    of (host, path), so a large host spreads over many tasks; the last page
    of each range goes to the next one as well, and the first to the one
    before, so the ranges' edges do not show in the result. Every page is
    answered.
    """
    alone = lines.groupBy("host", "digest").agg(F.min("path").alias("path"), F.min("hashes").alias("hashes"))
    order = ["host", "path", "digest"]
    dealt = alone.repartitionByRange(partitions, *order) if partitions else alone.repartitionByRange(*order)
    dealt = stash(dealt.select("host", "path", "digest", "hashes", F.lit(True).alias("own"), F.spark_partition_id().alias("part")), "ranges")
    row = F.struct("host", "path", "digest", "hashes")
    # a row for each range: as many as tasks, whatever the table's size
    edges = dealt.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    by_part = Window.orderBy("part")
    edges = edges.select("part", F.array(F.lag("last").over(by_part), F.lead("first").over(by_part)).alias("x")).select("part", F.explode("x").alias("x")).where("x is not null")
    ghosts = edges.select("x.host", "x.path", "x.digest", "x.hashes", F.lit(False).alias("own"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (5, 0, 2, 3, 4))))
        found: list[tuple[str, int, list[int]]] = []
        before, page = None, None
        for after in itertools.chain(rows, [None]):
            if page and page[4]:
                mine, gone = np.frombuffer(page[3], ">u8").tolist(), set()
                for other in (before, after):
                    if other and other[:2] == page[:2]:
                        gone |= shared_lines(mine, np.frombuffer(other[3], ">u8").tolist())
                found.append((page[1], page[2], sorted(gone)))
            before, page = page, after
            if len(found) == 256 or found and after is None:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.list_(pa.int32())))], names=["host", "digest", "shared"])
                found = []

    return dealt.unionByName(ghosts).repartition("part").sortWithinPartitions("part", *order).mapInArrow(run, "host string, digest long, shared array<int>")


def extract(pages: DataFrame, *, partitions: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page.

    The lines of every page are aligned by longest common subsequence with
    those of the pages before and after it by path within the host;
    ``n_shared`` of its ``n_lines`` are shared with either and up for deletion.
    Pages of equal lines count as one there, so copies have equal texts and
    are no neighbours of each other; ``partitions``, the number of ranges,
    does not change the result. What the pages mark is held against that:
    if a page marks an article, its lines stay, shared or not, and no others;
    lines in marked menus, headers, footers, sidebars, notices, adverts, forms
    and comments go, shared or not.

    Null html is empty and gives an empty text. Null urls share the empty
    host and keep their null. Repeated rows each give a row. An empty table
    gives no rows; other columns are not read.
    """
    found = stash(parsed(pages, id_col=id_col, url_col=url_col, html_col=html_col), "pages")
    shared = shared_with_neighbours(found.select("host", "path", "digest", "hashes"), partitions=partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone_counts = [], [], []
            for blob, gone in zip(batch.column(2), batch.column(3)):
                (article, lines), drop = _unpacked(blob.as_py()), set(gone.as_py() or ())
                texts.append(" ".join(t for i, t in enumerate(lines) if t is not None and (article or i not in drop)))
                counts.append(len(lines))
                gone_counts.append(len(drop))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone_counts, pa.int64())], names=["page_id", "url", "text", "n_lines", "n_shared"])

    told = found.join(shared, ["host", "digest"], "left").select("page_id", "url", "lines", "shared")
    done = told.mapInArrow(run, "page_id long, url string, text string, n_lines long, n_shared long")
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")
