"""Document fingerprints from closed syncmers.

A k-mer of code points is taken when the smallest hash among its s-mers is that of its first or last
one. Whether it is taken depends on its own characters only, so the same passage gives the same
anchors wherever it stands. The fingerprint is the anchors' 24-bit hashes in text order; two
fingerprints are compared by the anchors that match in the same order, so a text whose parts have
changed places is not the same text.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import Ranges, code_points, rows, spread, stage

RANGE_BYTES = 16_000_000  # of text that one range of documents should hold
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    k: int = 16
    s: int = 6


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _rolled(points: np.ndarray, wanted: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Polynomial hashes of all substrings of the ``wanted`` lengths, put together from powers of two."""
    power = {1: points.astype(np.uint64)}
    length = 1
    while 2 * length <= max(wanted):
        h = power[length]
        power[2 * length] = h[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + h[length:]
        length *= 2
    out = {}
    for n in wanted:
        pieces = [length for length in sorted(power, reverse=True) if n & length]
        count, at, h = len(points) - n + 1, 0, np.uint64(0)
        for length in pieces:
            h = h * np.uint64(pow(_BASE, length, 1 << 64)) + power[length][at : at + count]
            at += length
        out[n] = h
    return out


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    count = len(values) - width + 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:count], values[width - span : width - span + count])


def syncmers(text: str, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers; an empty text has none.

    A text shorter than k is one anchor; one without a closed syncmer (below 2 k - s - 1 code points) has its k-mer of the
    smallest hash.
    """
    if not text:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    points = code_points(text)
    if len(points) < settings.k:
        return np.zeros(1, dtype=np.int64), _mixed(_rolled(points, (len(points),))[len(points)][:1])
    hashes = _rolled(points, (settings.s, settings.k))
    inner = _mixed(hashes[settings.s])
    width = settings.k - settings.s + 1
    least = _window_min(inner, width)
    taken = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    found = _mixed(hashes[settings.k])
    if not len(taken):
        taken = np.array([found.argmin()])
    return taken, found[taken]


def anchors(text: str, settings: Settings = Settings()) -> np.ndarray:
    return (syncmers(text, settings)[1] >> np.uint64(40)).astype(np.uint32)


def written(found: np.ndarray) -> str:
    """Three bytes an anchor, base64."""
    return base64.b64encode(found.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()).decode()


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """How many anchors of two fingerprints match in order.

    What both begin and end with matches. Between, anchors that occur once in either are placed against each
    other; the longest run of them that ascends in both is the chain, and from each of its anchors the match
    goes on in both directions as long as the anchors beside are equal, up to the next one of the chain.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    both = np.intersect1d(_once(a), _once(b), assume_unique=True)
    if not len(both):
        return head + tail
    at_a, at_b = (np.flatnonzero(np.isin(x, both)) for x in (a, b))
    by_value = at_b[np.argsort(b[at_b])]
    place = by_value[np.searchsorted(both, a[at_a])]
    # the longest ascending run of places, by the least end of every length
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(place)
    for i, p in enumerate(place.tolist()):
        size = bisect_left(ends, p)
        before[i] = last[size - 1] if size else -1
        if size == len(ends):
            ends.append(p)
            last.append(i)
        else:
            ends[size], last[size] = p, i
    chain, i = [], last[-1]
    while i >= 0:
        chain.append((int(at_a[i]), int(place[i])))
        i = before[i]
    chain.reverse()
    matched = head + tail + len(chain)
    x, y = a.tolist(), b.tolist()
    low = (0, 0)  # what is not matched yet
    for (i, j), (i_next, j_next) in zip(chain, [*chain[1:], (len(x), len(y))], strict=True):
        back = 1
        while i - back >= low[0] and j - back >= low[1] and x[i - back] == y[j - back]:
            back += 1
        on = 1
        while i + on < i_next and j + on < j_next and x[i + on] == y[j + on]:
            on += 1
        matched += back - 1 + on - 1
        low = (i + on, j + on)
    return matched


def _once(found: np.ndarray) -> np.ndarray:
    values, counts = np.unique(found, return_counts=True)
    return values[counts == 1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the anchors that match in order over all anchors; two empty fingerprints are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return 2 * aligned(a, b) / (len(a) + len(b))


def edited(text: str, following: str) -> str:
    """The last half, rounded down, replaced by as many first code points of the next text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def descending(docs: DataFrame, id_col: str) -> Column:
    """A key that ascends where ids descend: numbers negated, texts by the complement of their bytes."""
    if isinstance(docs.schema[id_col].dataType, T.StringType):
        inverse = F.translate(F.hex(F.col(id_col)), "0123456789ABCDEF", "FEDCBA9876543210")
        return F.coalesce(F.concat(inverse, F.lit("~")), F.lit(""))
    return -F.coalesce(F.col(id_col).cast("bigint"), F.lit(0))


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller id, of the last one the first. A null text counts as
    empty. A null id comes after all others; rows with the same id follow each other by the hash of
    their text. A single document is its own next one, an empty table gives an empty one, and other
    columns are not read. The texts are shuffled once: documents are dealt by ranges of ids whose ends
    come from a table of keys, and a range also gets a copy of the document after its last.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = ["k1", "k2", "k3"]
    keyed = docs.select(
        F.col(id_col).isNull().cast("int").alias("k1"),
        descending(docs, id_col).alias("k2"),
        F.xxhash64(text).alias("k3"),
        F.col(id_col).alias("id"),
        text.alias("text"),
    )
    keys = stage(keyed.select(*columns, F.octet_length("text").cast("bigint").alias("bytes")), "fingerprint-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    ranges = Ranges.of(keys, columns, max(1, -(-total // RANGE_BYTES)))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # range, id, text, anchors of the row before
        for ids, texts, places, halos in rows(batches):
            out = []
            for name, text, place, halo in zip(ids, texts, places, halos, strict=True):
                if halo < 0:
                    continue
                found = anchors(text, settings)
                if held is not None and held[0] == place:
                    out.append(judged(*held[1:], text, found))
                held = (place, name, text, found) if halo == 0 else None
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def judged(name, text: str, found: np.ndarray, following: str, found_next: np.ndarray) -> tuple:
        other = edited(text, following)
        found_other = anchors(other, settings)
        digest = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
        return name, len(text), digest, written(found), written(found_other), likeness(found, found_other), likeness(found, found_next)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    kind = docs.schema[id_col].dataType.simpleString()
    kinds[0] = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    dealt = spread(keyed, columns, ranges).select("id", "text", "range", "halo")
    return dealt.mapInArrow(
        compared,
        f"{id_col} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
