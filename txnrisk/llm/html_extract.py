"""Main text of web pages by differencing each page against the one with the nearest URL.

Pages of a host are put in order of their URL path. A page's partner is the neighbour whose path
shares the longer beginning with its own. The longest common subsequence of the two pages' lines
aligns them, and shared lines, the furniture of a site, are deleted. What the markup itself marks is
beyond the comparison: lines inside an article stay though another page quotes them, and furniture
of one page only (a menu, an advert drawn at random) goes by its element, role or class.

A line is the text of one block. Pages are read once; what is shuffled is their lines.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import Ranges, rows, spread, stage
from txnrisk.llm.url_filter import host_of, path_of

RANGE_BYTES = 16_000_000  # of HTML that one range of pages should hold

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select|math|object)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
NOTICE = re.compile(r"""\b(class|id|role|itemprop|style|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""", re.IGNORECASE)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset head".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification paywall popup promo "
    "promoted promotion related respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CLOSES = frozenset("p li dt dd tr td th option".split())  # an open one of the same kind ends where the next begins
FURNITURE_ZONE, BODY_ZONE, ARTICLE_ZONE = 0, 1, 2


def zone_of(tag: str, attributes: str) -> int | None:
    """What an element says about its content; None: nothing."""
    if tag in FURNITURE:
        return FURNITURE_ZONE
    article = tag in ("article", "main")
    if attributes:
        for name, value, hidden in NOTICE.findall(attributes):
            value = value.strip("\"'").lower()
            name = name.lower()
            if hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return FURNITURE_ZONE
            if name == "role":
                if value in FURNITURE_ROLES:
                    return FURNITURE_ZONE
                article = article or value in ("main", "article")
            elif name in ("class", "id") and tag not in ("html", "body"):
                words = value.split()
                if any(part in FURNITURE_WORDS for w in words for part in (w, *re.split(r"[-_]+", w)[:: max(1, len(re.split(r"[-_]+", w)) - 1)])):
                    return FURNITURE_ZONE
            elif name == "itemprop" and value == "articlebody":
                article = True
    return ARTICLE_ZONE if article else None


def _markup(page: str) -> Iterator[re.Match]:
    """The matches of MARKUP in order. Where no > follows, no tag can end, and none is looked for: a page of tags
    that are never closed is read once, not once a tag."""
    last, at = page.rfind(">"), page.find("<")
    while at >= 0 and (at < last or page.startswith("<!--", at)):
        found = MARKUP.match(page, at)
        if found:
            yield found
        at = page.find("<", found.end() if found else at + 1)


def lines_of(page: str | None) -> tuple[list[str], list[int]]:
    """The blocks of a page with text in them, in order, and the zone of each."""
    texts: list[str] = []
    zones: list[int] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone inside
    zone, held, at = BODY_ZONE, [], 0
    page = page or ""

    def end_block() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                texts.append(text)
                zones.append(zone)

    for found in _markup(page):
        if found.start() > at:
            held.append(page[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            end_block()
        if found["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            # an inline end tag never closes a block that is still open
            if depth is not None and (block or not any(t in BLOCKS for t, _ in stack[depth + 1 :])):
                del stack[depth:]
        else:
            says = zone_of(tag, found["rest"])
            if says is not None and not block:
                end_block()
            if tag in CLOSES:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag or stack[i][0] in ("ul", "ol", "dl", "table", "article", "main", "div", "section")), None)
                if depth is not None and stack[depth][0] == tag:
                    del stack[depth:]
            if says == ARTICLE_ZONE and any(t in ("nav", "header", "head") for t, _ in stack):
                # an article does not stand in a menu: its end tag is missing
                del stack[next(i for i, (t, _) in enumerate(stack) if t in ("nav", "header", "head")) :]
            outer = stack[-1][1] if stack else BODY_ZONE
            if tag not in EMPTY and not found["rest"].endswith("/"):
                stack.append((tag, outer if says is None or outer == FURNITURE_ZONE else says))
        inside = stack[-1][1] if stack else BODY_ZONE
        if inside != zone:
            end_block()
            zone = inside
    held.append(page[at:])
    end_block()
    return texts, zones


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Bit-parallel: row i has a bit for every line of ``b`` at which the length of the subsequence of the first i
    lines of ``a`` grows, so a row is a few operations on one number, however often lines recur.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = set(range(head)) | set(range(len(a) - tail, len(a)))
    one, other = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict[int, int] = {}
    wanted = set(one)
    for j, line in enumerate(other):
        if line in wanted:
            places[line] = places.get(line, 0) | 1 << j
    kept = [i for i, line in enumerate(one) if line in places]  # no other line takes part
    every = (1 << len(other)) - 1
    grows, rows_ = 0, [0]
    for i in kept:
        flat = every & ~grows
        hit = flat & places[one[i]]
        grows = every & ~((flat + hit) | (flat - hit))
        rows_.append(grows)
    n, j = len(kept), len(other)
    while n and j:
        j = (rows_[n] & ((1 << j) - 1)).bit_length()  # up to the last line at which row n grows
        if not j:
            break
        if (rows_[n - 1] & ((1 << j) - 1)).bit_count() == (rows_[n] & ((1 << j) - 1)).bit_count():
            n -= 1
        else:
            n, j = n - 1, j - 1
            found.add(head + kept[n])
    return found


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_text(texts: list[str | None], zones: list[int], hashes: list[int], partner: list[int] | None) -> str:
    """Lines not shared with the partner, and all lines of an article; where there is an article, only these."""
    outside = [i for i, z in enumerate(zones) if z != ARTICLE_ZONE]
    shared = {outside[i] for i in common_lines([hashes[i] for i in outside], partner)} if partner else set()
    kept = [i for i, z in enumerate(zones) if z != FURNITURE_ZONE and i not in shared]
    if len(outside) < len(zones):
        kept = [i for i in kept if zones[i] == ARTICLE_ZONE]
    return "\n".join(texts[i] for i in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars.

    A null html is an empty page with empty text; a null URL has an empty host and path and is compared
    with others of its kind. Of two neighbours alike near, the earlier is the partner; the only page of
    a host has none. A neighbour with the very lines of the page, a mirror or the same page again, tells nothing
    and is no partner. Pages with the same URL follow each other by id, repeated rows all come out, an
    empty table gives an empty one, other columns are not read. Hosts of any size are split: pages are
    dealt by ranges of (host, path, id), each with a copy of the page on either side.
    """
    columns = ["host", "path", "k"]
    url = F.coalesce(F.col(url_col), F.lit(""))
    kind = pages.schema[id_col].dataType.simpleString()
    keyed = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url).alias("host"), path_of(url).alias("path"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"), F.col(html_col).alias("html"),
    )
    keys = stage(keyed.select(*columns, F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint").alias("bytes")), "page-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    ranges = Ranges.of(keys, columns, max(1, -(-total // RANGE_BYTES)))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [lines_of(p) for p in part.column("html").to_pylist()]
                hashes = [[line_hash(t) for t in texts] for texts, _ in found]
                # furniture is needed for the comparison only
                shown = [[t if z != FURNITURE_ZONE else None for t, z in zip(*f, strict=True)] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("id", "url", "host", "path", "k")),
                        pa.array(shown, pa.list_(pa.string())),
                        pa.array([z for _, z in found], pa.list_(pa.int32())),
                        pa.array(hashes, pa.list_(pa.int64())),
                    ],
                    names=["id", "url", "host", "path", "k", "lines", "zones", "hashes"],
                )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict | None = None
        now: dict | None = None

        def judged(previous: dict | None, page: dict, following: dict | None) -> tuple:
            near = [p for p in (previous, following) if p and p["host"] == page["host"] and p["hashes"] != page["hashes"]]
            partner = max(near, key=lambda p: len(_common_start(p["path"], page["path"])), default=None)
            text = main_text(page["lines"], page["zones"], page["hashes"], partner and partner["hashes"])
            return page["id"], page["url"], text, len(text)

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if now is not None and now["range"] == row["range"]:
                    if now["halo"] == 0:
                        out.append(judged(before, now, row))
                    before, now = now, row
                else:
                    if now is not None and now["halo"] == 0:
                        out.append(judged(before, now, None))
                    before, now = None, row
            yield written(out)
        if now is not None and now["halo"] == 0:
            yield written([judged(before, now, None)])

    def written(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        types = [id_type, pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[id_col, "url", "text", "n_chars"])

    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    lines = keyed.mapInArrow(
        parsed, f"id {kind}, url string, host string, path string, k string, lines array<string>, zones array<int>, hashes array<bigint>"
    )
    return spread(lines, columns, ranges).mapInArrow(compared, f"{id_col} {kind}, url string, text string, n_chars long")


def _common_start(a: str, b: str) -> str:
    n = min(len(a), len(b))
    return a[: next((i for i in range(n) if a[i] != b[i]), n)]
