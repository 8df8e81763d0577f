"""HTML main-text extraction by nearest-URL page differencing.

A page is read into text blocks in page order, each with a zone: inside the marked article (``article``, ``main``), in a part whose
markup names it as no text (menus, site headers, footers, sidebars, notices, adverts, forms, comments), or neither. Pages
are sorted by URL path within their host, and each is paired with the neighbour whose path shares the longer beginning
(ties: the one before). The blocks of the two are aligned by a longest common subsequence, in which an article's block meets only blocks of
an article, and every shared block is up for deletion, whatever its zone.

Rules on top, in this order. A shared block goes, unless both pages have it in their marked article: that is a passage which the site
repeats (or a copy of the page), and a line of the site stands outside of articles on one of them. If nothing but what markup names
as no text would be left, the neighbour is a copy and its shared blocks outside such parts stay. Of what is left, markup then takes the
blocks that it names as no text and, where the page marks an article, those beside it.

Hosts with many pages are dealt into ranges of about ``shard`` pages in the order of (path, page_id, url), and pages stream through a task
in order, so a host that holds a third of all pages does not meet in one task. The edge pages of a range are also sent to the
ranges beside it, where they are neighbours only, so how pages are dealt changes no result. Null html is empty; a page without text gives an empty
string; null URLs are one host; repeated rows are pages of their own. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import os.path
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import map_rows, small

# Element and class names.
RAW = frozenset("script style noscript template iframe svg math object canvas textarea select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup colgroup".split())
DROPPED = frozenset("head nav footer aside form button menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer comment comments disqus respond replies reply share sharing social related recommended newsletter subscribe subscription login signup signin toolbar pagination pager "
    "skip widget masthead".split()
)
COMMENTS = frozenset("comment comments disqus respond replies reply".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][-\w:]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ARTICLE, OTHER, DROP = 0, 1, 2


def named(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """(dropped whatever it holds, dropped unless it holds the article, is the article)."""
    hard = tag in DROPPED or tag == "header" and not in_article
    article = tag in ("article", "main")
    soft = False
    if attributes.strip(" /"):
        at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        role = at.get("role", "").lower()
        names = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{at.get('class', '')} {at.get('id', '')}").lower()))
        article = article or role == "main" or "articlebody" in at.get("itemprop", "").lower()
        if names & COMMENTS:
            return True, False, False
        hidden = "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower()
        hard = hard or role in ROLES or hidden
        soft = bool(names & NAMES) or not in_article and "header" in names
        if article and tag in ("article", "main"):
            soft = False
    return hard, soft and not hard, article and not hard


def blocks(source: str | None) -> list[tuple[str, int]]:
    """(text, zone) of each block, in page order."""
    out: list[tuple[str, int]] = []
    if not source:
        return out
    held: list[str] = []
    #: name, then whether it and what stands around it are dropped hard, softly, and in the article
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            _, hard, soft, article = stack[-1]
            out.append((text, DROP if hard or soft else ARTICLE if article else OTHER))

    at, end = 0, len(source)
    while at < end:
        m = TAG.search(source, at)
        if m is None:
            held.append(source[at:])
            break
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    flush()
                    del stack[k:]
                    break
            continue
        if tag in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                held.append(" " if tag == "br" else "")
                continue
        else:
            flush()
            if tag in VOID:
                continue
        _, hard, soft, article = stack[-1]
        if tag in LOOSE and len(stack) > 1 and stack[-1][0] == tag:
            stack.pop()
            _, hard, soft, article = stack[-1]
        own_hard, own_soft, own_article = named(tag, m[3], article)
        now = (tag, hard or own_hard, (soft or own_soft) and not (own_article and not article), article or own_article)
        if tag not in INLINE and tag not in LOOSE or now[1:] != (hard, soft, article):
            if tag in INLINE:
                flush()
            if not m[3].endswith("/") or tag not in INLINE:
                stack.append(now)
    flush()
    return out


def common(a: list, b: list) -> tuple[list[int], list[int]]:
    """Places of a longest common subsequence in ``a`` and ``b``, by bit-parallel rows."""
    n = len(a)
    where: dict[object, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << n) - 1
    rows = [full]
    for y in b:
        v, match = rows[-1], where.get(y, 0)
        u = v & match
        rows.append(((v + u) | (v - u)) & full)
    left: list[int] = []
    right: list[int] = []
    i, j = n, len(b)
    length = lambda j, i: i - (rows[j] & (1 << i) - 1).bit_count()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            left.append(i)
            right.append(j)
        elif length(j - 1, i) >= length(j, i - 1):
            j -= 1
        else:
            i -= 1
    return left[::-1], right[::-1]


def align(page: list[tuple[str, int]], mate: list[tuple[str, int]]) -> set[int]:
    """Places in ``page`` of the blocks that it shares with ``mate``."""
    return set(common([(t, z == ARTICLE) for t, z in page], [(t, z == ARTICLE) for t, z in mate])[0])


@dataclass(frozen=True)
class Main:
    """A page's text, and how many blocks differencing deleted, the rule on repeated passages kept, and markup took afterwards."""

    text: str
    deleted: int
    repeated: int
    markup: int


def main_text(page: list[tuple[str, int]], shared: set[int]) -> Main:
    passages = {i for i in shared if page[i][1] == ARTICLE}
    left = [i for i in range(len(page)) if i not in shared or i in passages]
    if all(page[i][1] == DROP for i in left):
        left = [i for i in range(len(page)) if i not in shared or page[i][1] == OTHER]
    zone = min((page[i][1] for i in left), default=DROP)
    kept = [page[i][0] for i in left if page[i][1] == zone != DROP]
    return Main("\n".join(kept), len(page) - len(left), len(passages), len(left) - len(kept))


def place(path: str, page_id: int | None, url: str | None) -> tuple:
    """Sorts as the columns do in Spark: by code points, nulls first."""
    return path, page_id is not None, page_id or 0, url or ""


class Ranges:
    """The ranges of one host: where each but the first begins, and the first and last place that each holds."""

    def __init__(self, begins: list[tuple]):
        self.begins = sorted(begins)
        self.edges: dict[int, tuple[tuple, tuple]] = {}

    def of(self, at: tuple) -> int:
        return bisect_right(self.begins, at)

    def places(self, at: tuple) -> list[int]:
        """The range of a page, then those beside it that it is an edge page for."""
        k = self.of(at)
        first, last = self.edges[k]
        return [k] + [j for j, edge in ((k - 1, first), (k + 1, last)) if at == edge and j in self.edges]


def ranges(light: DataFrame, shard: int, n: int) -> dict[str, Ranges]:
    """Ranges of the hosts with many pages, by host, from host, path, page_id and url. A page begins a range by its hash, so ranges hold
    ``shard`` pages in the mean; fewer than 100,000 hosts can be so large and about as many pages begin a range, so what is sent is bounded."""
    spark, least = light.sparkSession, max(shard, n // 100_000)
    hosts = [(r["host"],) for r in light.groupBy("host").count().filter(F.col("count") > least).collect()]
    if not hosts:
        return {}
    light = light.join(F.broadcast(spark.createDataFrame(hosts, "host string")), "host").select("host", "path", "page_id", "url")
    begins: dict[str, list[tuple]] = {h: [] for (h,) in hosts}
    for h, *at in light.filter(F.pmod(F.xxhash64("path", "page_id", "url"), F.lit(least)) == 0).distinct().collect():
        begins[h].append(place(*at))
    out = {h: Ranges(x) for h, x in begins.items()}
    sent = spark.sparkContext.broadcast(out)

    def deal(batch: pa.RecordBatch) -> dict:
        rows = zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True)
        return {k: batch.column(c) for c, k in enumerate(("host", "path", "page_id", "url"))} | {"shard": [sent.value[h].of(place(*at)) for h, *at in rows]}

    arrow = pa.schema([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("shard", pa.int32())])
    held = map_rows(light, deal, "host string, path string, page_id long, url string, shard int", arrow)
    at = F.struct("path", "page_id", "url")
    for r in held.groupBy("host", "shard").agg(F.min(at).alias("first"), F.max(at).alias("last")).collect():
        out[r["host"]].edges[r["shard"]] = place(*r["first"]), place(*r["last"])
    return out


def extract(pages: DataFrame, *, shard: int = 128, task: int = 2048) -> DataFrame:
    """page_id, url, text, n_chars; n_shared (blocks that the paired page shares), and of these n_deleted and n_repeated (kept as passages of
    the article); n_markup (blocks that only markup took). About ``task`` pages meet in a task, however many there are (more where there are over 200 million)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#]*([^?#]*)", 1), F.lit(""))
    # pages that are alike in all else are in the order of their html
    hosted = pages.select("page_id", "url", host.alias("host"), path.alias("path"), "html", F.xxhash64("html").alias("mark"))
    spark, n = pages.sparkSession, pages.count()
    dealing = spark.sparkContext.broadcast(ranges(hosted.select("host", "path", "page_id", "url"), shard, n))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, n // task))

    def parse(batch: pa.RecordBatch) -> dict:
        got = [blocks(x) for x in batch.column(4).to_pylist()]
        at, to, own = [], [], []
        for k, (page, url, host, path) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True)):
            places = dealing.value[host].places(place(path, page, url)) if host in dealing.value else [0]
            at += [k] * len(places)
            to += places
            own += [True] + [False] * (len(places) - 1)
        taken = pa.array(at, pa.int64())
        kept = {k: batch.column(i).take(taken) for i, k in ((0, "page_id"), (1, "url"), (2, "host"), (3, "path"), (5, "mark"))}
        return kept | {"shard": to, "own": own, "lines": [[t for t, _ in got[k]] for k in at], "zones": [[z for _, z in got[k]] for k in at]}

    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("mark", pa.int64()), ("shard", pa.int32()), ("own", pa.bool_()), ("lines", pa.list_(pa.string())), ("zones", pa.list_(pa.int8()))])
    parsed = map_rows(hosted, parse, "page_id long, url string, host string, path string, mark long, shard int, own boolean, lines array<string>, zones array<byte>", arrow)
    dealt = parsed.repartition(parts, "host", "shard").sortWithinPartitions("host", "shard", "path", "page_id", "url", "mark").select("page_id", "url", "lines", "zones", "host", "shard", "path", "own")
    counts = ("n_chars", "n_shared", "n_deleted", "n_repeated", "n_markup")
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), *((n, pa.int64()) for n in counts)])

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(before: tuple | None, page: tuple, after: tuple | None) -> tuple:
            same = [len(os.path.commonprefix([x[6], page[6]])) if x and x[4:6] == page[4:6] else -1 for x in (before, after)]
            mate = None if max(same) < 0 else before if same[0] >= same[1] else after
            own = list(zip(page[2], page[3], strict=True))
            shared = align(own, list(zip(mate[2], mate[3], strict=True))) if mate else set()
            got = main_text(own, shared)
            return page[0], page[1], got.text, len(got.text), len(shared), got.deleted, got.repeated, got.markup

        before = page = None
        for batch in small(batches):
            rows = []
            for after in zip(*[batch.column(k).to_pylist() for k in range(8)], strict=True):
                if page is not None and page[7]:
                    rows.append(row(before, page, after))
                before, page = page, after
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(out.names, map(list, zip(*rows, strict=True)), strict=True)), schema=out)
        if page is not None and page[7]:
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(out.names, row(before, page, None), strict=True)}, schema=out)

    return dealt.mapInArrow(difference, "page_id long, url string, text string, " + ", ".join(f"{n} long" for n in counts))
