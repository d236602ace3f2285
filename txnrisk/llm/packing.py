"""Packing token sequences into as few bins as possible by linear grouping and best fit.

Everything the plan needs is the histogram of piece lengths, at most ``capacity`` numbers however
large the corpus. The plan comes back as runs: "pieces of length l with ranks a to b go to bins
p, p+1, ... at offset o", a few thousand rows at any size of the corpus, and each piece finds its
run from its length and its rank among pieces of its length. Texts are read once, in the pass that
tokenizes them; only narrow rows are shuffled.

The plan: long pieces are split by length into groups of equal size and rounded up to the longest
of their group; a linear programme over the ways to fill a bin with the few rounded lengths is
solved by column generation; its whole part is taken, actual pieces take the places of rounded
ones; then the rest and all short pieces go, longest first, to the fullest bin that holds them.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from txnrisk.llm.common import stage

CAPACITY = 2048
LARGE = (2, 3)  # pieces longer than capacity / LARGE are grouped; the plan of fewer bins is taken
GROUPS = 48
STRIP = 2_000_000  # bytes of text whose words are told apart at a time


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of whole texts, as little-endian 32-bit bytes, word by word.

    The tokenizer's normalizer and splitter never look across white space, so a text's ids are those
    of its words in order. Arrow splits the texts and tells the different words of them; only these are
    looked up, and those not met before encoded. A text holding characters on which white space is a
    matter of opinion, or which could spell a special token, goes to the tokenizer whole.
    """

    KNOWN_WORDS = 100_000  # words kept for lookup; further ones are encoded each time they are met
    AT_ONCE = 8192  # words encoded in one call
    LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f"  # letters with one way to lower case
    MARKS = "!-&(-/:-@\\[-`{-~"  # ASCII marks but the apostrophe, with which contractions begin

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.doubtful = ("<|", *"\x1c\x1d\x1e\x1f\x85\u180e\u200b\u2060\ufeff")
        self.latin = re.compile(f"[{self.LATIN}]+")
        # the same model for lower-case words of letters: nothing to normalize, nothing to split but spaces
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens with which a word ends
        self.last[[i for token, i in vocabulary.items() if token.endswith(self.tokenizer.model.end_of_word_suffix)]] = True

    def of(self, texts: list[str]) -> list[bytes]:
        whole = [any(x in t for x in self.doubtful) for t in texts]
        usual = pa.array(["" if w else t for w, t in zip(whole, texts, strict=True)], pa.large_string())
        split = pc.utf8_split_whitespace(usual)
        words = split.values.dictionary_encode()
        # a Latin word in capitals, or with marks behind it, goes by its plain form
        parts = pc.extract_regex(words.dictionary, f"^(?P<core>[{self.LATIN}]+)(?P<marks>[{self.MARKS}]*)$")
        core = pc.coalesce(pc.utf8_lower(pc.struct_field(parts, "core")), words.dictionary)
        marks = pc.fill_null(pc.struct_field(parts, "marks"), "")
        ids = pc.binary_join_element_wise(*self._looked_up([core, marks]), pa.scalar(b"", pa.large_binary())).take(words.indices)
        joined = pc.binary_join(pa.ListArray.from_arrays(split.offsets, ids), pa.scalar(b"", pa.large_binary())).to_pylist()
        return [self._whole(t) if w else j for w, t, j in zip(whole, texts, joined, strict=True)]

    def _looked_up(self, columns: list[pa.Array]) -> list[pa.Array]:
        """The ids of words; those not met before are encoded and, while there is room, kept."""
        known, out = self.known, []
        for column in columns:
            words = column.dictionary_encode()
            different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
            found = list(map(known.get, different))
            new = [w for w, ids in zip(different, found, strict=True) if ids is None]
            plain = [w for w in new if self.latin.fullmatch(w) and w == w.lower()]
            others = list(set(new).difference(plain))
            known.update(zip(plain, self._plain_words(plain), strict=True))
            known.update(zip(others, self._words(others), strict=True))
            found = [known[w] if ids is None else ids for w, ids in zip(different, found, strict=True)]
            out.append(pa.array(found, pa.large_binary()).take(words.indices))
            if len(known) > self.KNOWN_WORDS:
                for word in new:
                    del known[word]
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain_words(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), self.AT_ONCE):
            encoded = self.bare.encode_batch_fast([" ".join(words[at : at + self.AT_ONCE])], add_special_tokens=False)
            ids = np.array(encoded[0].ids, dtype="<u4")
            yield from _cut(ids, np.flatnonzero(self.last[ids]) + 1)

    def _words(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), self.AT_ONCE):
            some = words[at : at + self.AT_ONCE]
            encoded = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ends = np.searchsorted(np.array(encoded.word_ids, dtype=np.int64), np.arange(1, len(some) + 1))
            yield from _cut(np.array(encoded.ids, dtype="<u4"), ends)


def _cut(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data, stops = ids.tobytes(), (4 * ends).tolist()
    return [data[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One table per Python worker, kept from task to task."""
    return WordIds(path)


PIECES = "part int, local long, piece int, start long, length int, ids_crc32 long"


def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Consecutive rows of about STRIP bytes in their last column, as Python lists by column."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.columns[-1]).fill_null(0).to_numpy(), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // STRIP)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield [column.to_pylist() for column in batch.slice(start, end - start).columns]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int) -> DataFrame:
    """A row per piece; ``local`` is its rank among the pieces of its length in its partition."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for names, parts, texts in strips(batches):
            out: list[tuple] = []
            for name, part, ids in zip(names, parts, ids_of.of([t or "" for t in texts]), strict=True):
                data = ids + b"\0\0\0\0"
                n = len(data) // 4
                for j, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    out.append((name, part, int(seen[length]), j, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                    seen[length] += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names_out)

    wanted = docs.select(F.col(id_col), F.spark_partition_id().alias("part"), F.col(text_col).alias("text"))
    names_out = [id_col, "part", "local", "piece", "start", "length", "ids_crc32"]
    types = [to_arrow_type(docs.schema[id_col].dataType), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    return wanted.mapInArrow(cut, f"{id_col} {kind}, {PIECES}")


# --- the plan ---------------------------------------------------------------------------------


def best_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Ways to fill a bin and how often to use each, at the optimum of the fractional problem.

    Column generation: the simplex basis starts with one size per pattern; the pattern of the largest
    value under the current prices, found by dynamic programming over the capacity, enters until none
    is worth more than the bin it takes.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    amounts = demand / np.diag(basis)
    for _ in range(40 * k):
        inverse = np.linalg.inv(basis)
        amounts = inverse @ demand
        prices = inverse.sum(axis=0)
        value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(sizes.min()), capacity + 1):
            fitting = np.flatnonzero(sizes <= room)
            worth = value[room - sizes[fitting]] + prices[fitting]
            j = int(np.argmax(worth))
            value[room], choice[room] = worth[j], fitting[j]
            if value[room - 1] >= value[room]:
                value[room], choice[room] = value[room - 1], -2  # a token of room left over
        if value[capacity] <= 1 + 1e-7:
            break
        pattern, room = np.zeros(k), capacity
        while room > 0 and choice[room] != -1:
            if choice[room] == -2:
                room -= 1
            else:
                pattern[choice[room]] += 1
                room -= int(sizes[choice[room]])
        direction = inverse @ pattern
        usable = direction > 1e-9
        ratios = np.where(usable, np.maximum(amounts, 0) / np.where(usable, direction, 1), np.inf)
        basis[:, int(np.argmin(ratios))] = pattern
    return [(basis[:, j].astype(int), float(amounts[j])) for j in range(k) if amounts[j] > 1e-9]


class Bins:
    """Bins of equal room in runs (first bin, number of bins), by room."""

    def __init__(self, capacity: int):
        self.capacity, self.used = capacity, 0
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.placed: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, pieces, first bin, per bin, offset

    def put_back(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.runs:
                insort(self.rooms, room)
                self.runs[room] = []
            self.runs[room].append((first, n))

    def fresh(self, n: int) -> int:
        first, self.used = self.used, self.used + n
        return first

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """``count`` pieces of ``length`` from ``rank`` on, one by one into the fullest bin that holds them."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                per = self.capacity // length
                n = -(-count // per)
                first, room = self.fresh(n), self.capacity
            else:
                room = self.rooms[at]
                first, n = self.runs[room].pop()
                if not self.runs[room]:
                    del self.runs[room]
                    self.rooms.pop(at)
                per = room // length
            full, part = divmod(min(count, n * per), per)
            if full:
                self.placed.append((length, rank, full * per, first, per, self.capacity - room))
                self.put_back(room - per * length, first, full)
            if part:
                self.placed.append((length, rank + full * per, part, first + full, part, self.capacity - room))
                self.put_back(room - part * length, first + full, 1)
            rest = n - full - (part > 0)
            self.put_back(room, first + n - rest, rest)
            rank += full * per + part
            count -= full * per + part


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple], int]:
    """Runs (length, first rank, pieces, first bin, pieces per bin, offset) and the number of bins."""
    return min((_plan(histogram, capacity, groups, parts) for parts in LARGE), key=lambda p: p[1])


def _plan(histogram: dict[int, int], capacity: int, groups: int, parts: int) -> tuple[list[tuple], int]:
    bins = Bins(capacity)
    left = {length: n for length, n in histogram.items() if n}
    next_rank = dict.fromkeys(left, 0)
    large = sorted((length for length in left if length > capacity // parts), reverse=True)
    total = sum(left[length] for length in large)
    if total:
        # groups of equal size, the longest pieces first: runs of (length, count)
        per_group = -(-total // groups)
        members: list[list[list[int]]] = []
        room = 0
        for length in large:
            n = left[length]
            while n:
                if not room:
                    members.append([])
                    room = per_group
                took = min(n, room)
                members[-1].append([length, took])
                n, room = n - took, room - took
        sizes = np.array([g[0][0] for g in members])
        counts = np.array([sum(n for _, n in g) for g in members], dtype=float)
        merged, where = np.unique(sizes, return_inverse=True)  # a frequent length may fill several groups
        demand = np.bincount(where, weights=counts)
        queues = [[run for g, w in zip(members, where, strict=True) if w == i for run in g] for i in range(len(merged))]
        for pattern, amount in sorted(best_patterns(merged, demand, capacity), key=lambda p: -p[1]):
            slots = [i for i, n in enumerate(pattern) for _ in range(n)]
            available = [sum(n for _, n in queues[i]) // int(pattern[i]) for i in set(slots)]
            n = min(int(amount), *available)
            first = bins.fresh(n)
            # actual pieces take the slots: a list of runs per slot, cut where any slot's length changes
            taken = [_take(queues[i], n) for i in slots]
            done = 0
            while done < n:
                step = min(runs[0][1] for runs in taken)
                offset = 0
                for runs in taken:
                    length = runs[0][0]
                    bins.placed.append((length, next_rank[length], step, first + done, 1, offset))
                    next_rank[length] += step
                    left[length] -= step
                    offset += length
                    runs[0][1] -= step
                    if not runs[0][1]:
                        runs.pop(0)
                bins.put_back(capacity - offset, first + done, step)
                done += step
    for length in sorted(left, reverse=True):
        bins.best_fit(length, next_rank[length], left[length])
    return bins.placed, bins.used


def _take(queue: list[list[int]], n: int) -> list[list[int]]:
    out = []
    while n:
        took = min(n, queue[0][1])
        out.append([queue[0][0], took])
        queue[0][1] -= took
        n -= took
        if not queue[0][1]:
            queue.pop(0)
    return out


# --- the operator -----------------------------------------------------------------------------


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    groups: int = GROUPS,
) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and a 0; only documents longer than ``capacity`` are cut. A null or
    empty text is the 0 alone. Repeated rows are packed each for itself, an empty table gives an
    empty one, other columns are not read. The rank of a piece comes from its partition's own
    counts and the sums before it, so a length that a third of all pieces share is no single group.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    cut = stage(pieces(docs, id_col, text_col, tokenizer, capacity), "pieces")
    short = cut.where(F.col("length") < capacity)
    counted = stage(short.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, used = plan(histogram, capacity, groups)

    # pieces of the same length in earlier partitions: sums over blocks of partitions, then within a block
    block = F.floor(F.col("part") / 1024)
    within = Window.partitionBy("length", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("block", block)
    blocks = counted.groupBy("length", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("length", "block", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("earlier"))
    before = counted.join(blocks, ["length", "block"]).select(
        "length", "part", (F.col("earlier") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before")
    )

    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)  # by length, then rank
    keyed = table[:, 0].astype(np.float64) * 2.0**40 + table[:, 1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids.cache_clear()  # all texts are tokenized; a reused worker would hold the words on
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            part, local = (batch.column(c).to_numpy().astype(np.int64) for c in ("part", "local"))
            full = length == capacity
            rank = np.where(full, 0, batch.column("before").fill_null(0).to_numpy() + local)
            run = np.searchsorted(keyed, length * 2.0**40 + rank, side="right") - 1 if len(table) else np.zeros(len(length), dtype=int)
            chosen = table[np.maximum(run, 0)] if len(table) else np.zeros((len(length), 6), dtype=np.int64)
            done = rank - chosen[:, 1]
            per = np.maximum(chosen[:, 4], 1)
            sequence = np.where(full, used + (part << 36) + local, chosen[:, 3] + done // per)
            offset = np.where(full, 0, chosen[:, 5] + done % per * length)
            keep = [batch.column(c) for c in (id_col, "piece", "start")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(length), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)],
                names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    found = short.join(before, ["length", "part"]).unionByName(cut.where(F.col("length") == capacity).withColumn("before", F.lit(0).cast("bigint")))
    ordered = found.select(id_col, "part", "local", "piece", "start", "length", "ids_crc32", F.col("before").cast("bigint").alias("before"))
    return ordered.mapInArrow(
        placed, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
