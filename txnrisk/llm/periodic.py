"""Runs: stretches of words that repeat with a period, found on the diagonals of equal words.

Word i lies on the diagonal of lag q if it equals word i - q. The match length there is one more than that
of word i - 1 on the same lag; a diagonal's length where it ends, at least ``max(12 - q, q)``, makes a run of
period q that began q words before the diagonal did. Of runs with the same ends only the one with the smallest
period counts: the others are its multiples.

Only diagonals with equal words exist at all, and only two cells of each are looked at: the one where it opens
(the words before differ) and the one where it closes (the words after differ); the lengths between them are
implied. Since a diagonal of lag q must hold q words to count, lags are taken by octaves: in the octave from
2^k to 2^(k+1) a word's earlier occurrences are those at which the same 2^k words begin. Such occurrences
within 2^(k+1) words are few unless the words themselves repeat, and then all but the first of them go on from
the word before and open nothing. The work is thus about n log n on any text, on one word a million times as
on prose; counting up every cell would be quadratic.

Texts are worked through by many at a time: a word is the same as another only within its document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import rows

# --- fixed values: the runs asked for ------------------------------------------------------
LEAST, TIMES = 12, 2  # a run has LEAST words and TIMES its period at least
# -------------------------------------------------------------------------------------------
BATCH_WORDS = 1 << 18  # words worked through together; a longer text is one batch of its own
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


@dataclass
class Runs:
    """Runs of a sequence, by start, then period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _classes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number per pair, equal for equal pairs only."""
    return np.unique(first * (second.max(initial=0) + 1) + second, return_inverse=True)[1].astype(np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts 2, 0, 3: the places 0 0 2 2 2 and the numbers 0 1 0 1 2."""
    place = np.repeat(np.arange(len(counts)), counts)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)


def _differing(at: np.ndarray, gram: np.ndarray, beside: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, lag) of all i and earlier j in ``at`` with gram[i] = gram[j], beside[i] != beside[j], least <= i - j < most.

    Occurrences of a gram are walked from the nearest to the farthest, past all that have the same
    ``beside`` at once; where most of them differ they are listed instead.
    """
    order = np.lexsort((at, gram))
    p, g, b = at[order], gram[order], beside[order]
    n, places = len(p), np.arange(len(p))
    scale = int(p.max(initial=0)) + 2 * most + 2
    keyed = g * scale + p  # ascending
    low = np.searchsorted(keyed, g * scale + np.maximum(p - most + 1, 0), "left")
    low = np.maximum(low, np.searchsorted(g, g, "left"))
    high = np.searchsorted(keyed, g * scale + p - least, "right")  # occurrences [low, high)
    high = np.where(p >= least, np.maximum(high, low), low)
    # how many of them have the same word beside
    pair = _classes(g, b)
    by_pair = np.lexsort((p, pair))
    pair_key = pair[by_pair] * (n + 1) + by_pair  # by_pair ascends within a pair, as places do with p
    same = np.searchsorted(pair_key, pair * (n + 1) + high, "left") - np.searchsorted(pair_key, pair * (n + 1) + low, "left")
    count = high - low
    differ = count - same
    lists = np.flatnonzero((differ > 0) & (2 * differ >= count))
    one, step = _spread(count[lists])
    i, j = lists[one], low[lists][one] + step
    keep = b[i] != b[j]
    found = [(p[i[keep]], p[i[keep]] - p[j[keep]])]
    # the others: from the last occurrence down; runs of one beside are passed over in one go
    change = np.concatenate(([True], (g[1:] != g[:-1]) | (b[1:] != b[:-1])))[:n]
    first = np.maximum.accumulate(np.where(change, places, 0))  # where the run of this beside began
    i = np.flatnonzero((differ > 0) & (2 * differ < count))
    j = high[i] - 1
    while len(i):
        equal = b[i] == b[j]
        found.append((p[i[~equal]], (p[i] - p[j])[~equal]))
        j = np.where(equal, first[j], j) - 1
        stay = j >= low[i]
        i, j = i[stay], j[stay]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs(words: np.ndarray, least: int = LEAST) -> Runs:
    """All runs of ``words``, numbers from 1 up that are equal for equal words."""
    n = len(words)
    padded = np.concatenate(([0], words, [0])).astype(np.int64)  # 0 is no word: nothing goes past the ends
    at, gram, size = np.arange(n), padded[1:-1], 1
    found = []
    while len(at) > 1 and 2 * size <= n:
        opened = _differing(at, gram, padded[at], size, 2 * size)
        closed = _differing(at, gram, padded[at + size + 1], size, 2 * size)
        # on a lag, openings and closings take turns
        a, z = (np.lexsort(x) for x in (opened, closed))
        begin, end, lag = opened[0][a], closed[0][z] + size, opened[1][a]
        enough = end - begin >= np.maximum(least - lag, (TIMES - 1) * lag)
        found.append((begin[enough] - lag[enough], end[enough], lag[enough]))
        # on to twice as many words: only where the words now looked at occur again
        follows = np.full(n + size, -1, dtype=np.int64)
        follows[at] = gram
        stay = follows[at + size] >= 0
        at, gram = at[stay], _classes(gram[stay], follows[at[stay] + size])
        again = np.bincount(gram, minlength=1)[gram] > 1
        at, gram, size = at[again], gram[again], 2 * size
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    multiple = np.concatenate(([False], (start[1:] == start[:-1]) & (end[1:] == end[:-1])))[: len(start)]
    start, end, period = start[~multiple], end[~multiple], period[~multiple]
    order = np.lexsort((period, start))
    return Runs(start[order], (end - start)[order], period[order])


def dropped(n: int, found: Runs) -> np.ndarray:
    """Whether each of ``n`` words lies in a run after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, found.start + found.period, 1)
    np.add.at(change, found.start + found.length, -1)
    return np.cumsum(change[:n]) > 0


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """One number per word of all texts, equal for equal words of one text only."""
    out, base = [], 1
    for words in texts:
        known: dict[bytes, int] = {}
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words)) + base)
        base += len(known)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _batch(texts: list[list[bytes]], least: int) -> list[tuple[Runs, str]]:
    """Runs and the words left, per text; no run reaches over the end of a text, as no word does."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    found = runs(_numbered(texts), least)
    out = dropped(int(lengths.sum()), found)
    owner = np.searchsorted(ends, found.start, "right")
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    result = []
    for i, words in enumerate(texts):
        own, offset = slice(cuts[i], cuts[i + 1]), ends[i] - lengths[i]
        gone = out[offset : ends[i]]
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
        result.append((Runs(found.start[own] - offset, found.length[own], found.period[own]), b" ".join(kept).decode("utf-8", "replace")))
    return result


def periodic_runs(
    docs: DataFrame,
    keys: list[str],
    text_col: str = "text",
    least: int = LEAST,
    prepare: Callable[[tuple, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """The ``keys`` columns with n_words, runs and collapsed, per row of ``docs``.

    Words are what white space (space and the five characters from tab to carriage return) separates.
    ``runs`` has (start, length, period) of every run, by start, then period: stretches whose smallest period
    is ``period``, of ``least`` words and twice the period at least, that cannot be made longer. ``collapsed``
    is the text's words without those that lie in a run after its first period, joined by single spaces.
    ``prepare`` may change the words of a row, given its keys, before runs are looked for.

    A null or empty text has no words, no run and an empty collapsed text. Equal rows all come out, an empty
    table gives an empty one, other columns are not read. Texts are not shuffled; a task holds the words of one
    batch or of one text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: list[tuple[tuple, list[bytes]]]) -> pa.RecordBatch:
            done = _batch([words for _, words in part], least)
            offsets = np.concatenate(([0], np.cumsum([len(r.start) for r, _ in done]))).astype(np.int32)
            fields = [np.concatenate([getattr(r, f) for r, _ in done]) for f in ("start", "length", "period")]
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], ["start", "length", "period"]))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*(k for k, _ in part), strict=True), key_fields, strict=True)]
            n_words = pa.array([len(words) for _, words in part], pa.int64())
            return pa.RecordBatch.from_arrays([*columns, n_words, listed, pa.array([t for _, t in done], pa.string())], names=[*keys, "n_words", "runs", "collapsed"])

        for batch in batches:
            key_fields = [batch.schema.field(i) for i in range(len(keys))]
            held, words = [], 0
            for row in chain.from_iterable(zip(*part, strict=True) for part in rows(iter([batch]))):
                text = (row[-1] or "").encode("utf-8", "surrogatepass").split()
                text = text if prepare is None else prepare(row[:-1], text)
                if held and words + len(text) > BATCH_WORDS:
                    yield out(held)
                    held, words = [], 0
                held.append((row[:-1], text))
                words += len(text)
            if held:
                yield out(held)

    fields = [*docs.select(*keys).schema.fields, T.StructField("n_words", T.LongType())]
    schema = T.StructType([*fields, T.StructField("runs", T._parse_datatype_string(RUN)), T.StructField("collapsed", T.StringType())])
    return docs.select(*keys, F.col(text_col).alias("_text")).mapInArrow(work, schema)
