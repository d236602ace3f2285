"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may be found with up to k = share * m edits. Cut into k + 1 pieces, at least
one piece stands unchanged in any such copy. One automaton finds the pieces of all items in a text;
a hit says where the item would have to begin, and Myers' bit-parallel algorithm, with an integer as
wide as the item, gives the least edit distance in the stretch around it.

Texts and items are compared lower-cased with white space as single spaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import rows

SHARE = 0.08  # edits an item may have, by its length
BLOCK_CHARS = 4_000_000  # of items searched for in one pass over the texts


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, share: float = SHARE) -> int:
    return int(length * share)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``item`` in k + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Least edit distance of a pattern to any stretch of a text."""

    def __init__(self, pattern: str):
        self.length = len(pattern)
        self.all = (1 << self.length) - 1
        self.top = 1 << (self.length - 1)
        self.places: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """(distance, end) of the best stretch, the first of equals; the empty stretch at 0 counts."""
        whole, top, places = self.all, self.top, self.places
        up, down, score = whole, 0, self.length  # vertical differences of +1 and -1
        best, end = score, 0
        for i, c in enumerate(text, 1):
            equal = places.get(c, 0)
            x = equal | down
            diagonal = (((equal & up) + up) ^ up) | equal
            right = down | ~(diagonal | up) & whole
            left = up & diagonal
            if right & top:
                score += 1
            elif left & top:
                score -= 1
                if score < best:
                    best, end = score, i
            right <<= 1
            up = (left << 1 | ~(x | right)) & whole
            down = right & x & whole
        return best, end


class Finder:
    """All items of a block in one automaton."""

    def __init__(self, items: list[tuple[object, str]], share: float):
        self.items = [(name, text, budget(len(text), share), Myers(text)) for name, text in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k, _) in enumerate(self.items):
            for at, piece in pieces(text, k):
                where.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, entries in where.items():
            self.automaton.add_word(piece, (len(piece), entries))
        if where:
            self.automaton.make_automaton()

    def leaks(self, text: str) -> Iterator[tuple[object, int, int, int, int]]:
        """(item, distance, allowed, end, item length) of every item within its budget, at its best place."""
        begins: dict[int, set[int]] = {}
        if len(self.automaton):
            for last, (length, entries) in self.automaton.iter(text):
                for n, at in entries:
                    begins.setdefault(n, set()).add(last + 1 - length - at)
        for n, found in sorted(begins.items()):
            name, item, k, myers = self.items[n]
            best, end = k + 1, 0
            for low, high in stretches(sorted(found), k, len(item), len(text)):
                distance, stop = myers.search(text[low:high])
                if distance < best:
                    best, end = distance, low + stop
                    if not best:
                        break
            if best <= k:
                yield name, best, k, end, len(item)


def stretches(begins: list[int], k: int, length: int, limit: int) -> Iterator[tuple[int, int]]:
    """Where to look: k characters around each begin and its end, overlapping stretches as one."""
    low, high = None, None
    for b in begins:
        start, stop = max(0, b - k), min(limit, b + length + k)
        if low is not None and start <= high:
            high = max(high, stop)
            continue
        if low is not None:
            yield low, high
        low, high = start, stop
    if low is not None:
        yield low, high


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: float = SHARE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """A row per document and item found in it: id, item id, distance, allowed, end, item_chars.

    ``end`` is where the best copy ends in the normalised text. The benchmark is the stated query set:
    it is searched for in blocks of about ``block_chars`` characters, each in a pass over all whole
    texts, so no more than one block is ever held. A null or empty text holds nothing, a null or empty
    item is looked for nowhere; an item too short for an edit is looked for exactly. Repeated documents
    each come out, items with the same id and text are one item, empty tables give an empty one, other
    columns are not read.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((docs, id_col), (benchmark, item_col))}
    types = {c: {"bigint": pa.int64(), "int": pa.int32()}.get(k, pa.string()) for c, k in kinds.items()}
    names = [id_col, item_col, "distance", "allowed", "end", "item_chars"]
    schema = f"{id_col} {kinds[id_col]}, {item_col} {kinds[item_col]}, distance int, allowed int, end long, item_chars int"

    def one_pass(block: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(block.value, share)
            for ids, texts in rows(batches):
                out = [(name, *found) for name, text in zip(ids, texts, strict=True) for found in finder.leaks(normal(text))]
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                kind = [types[id_col], types[item_col], pa.int32(), pa.int32(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind, strict=True)], names=names)

        return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(search, schema)

    return reduce(DataFrame.unionByName, map(one_pass, item_blocks(benchmark, item_col, item_text_col, block_chars)))


def item_blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_chars: int) -> Iterator[Broadcast]:
    """The items with text, normalised, in broadcasts of about ``block_chars`` characters, at least one."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    items = items.where(F.trim(F.coalesce("text", F.lit(""))) != "").distinct()
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for block in range(blocks):
        of_block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        named = sorted({(r["item"], normal(r["text"])) for r in of_block if normal(r["text"])}, key=str)
        yield benchmark.sparkSession.sparkContext.broadcast(named)


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: float = SHARE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they are: a filter, no join.

    One pass over what the passes before it kept for each block of items.
    """

    def filtered(kept: DataFrame, block: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(block.value, share)
            for batch in batches:
                texts = (t for part in rows(iter([batch.select([text_col])])) for t in part[0])
                yield batch.filter(pa.array([next(finder.leaks(normal(t)), None) is None for t in texts], pa.bool_()))

        return kept.mapInArrow(search, docs.schema)

    return reduce(filtered, item_blocks(benchmark, item_col, item_text_col, block_chars), docs)
