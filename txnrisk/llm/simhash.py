"""Near-duplicates by 64-bit SimHash with the generalised pigeonhole principle.

The 64 bits are dealt into partitions, bits that vary together into the same one. Partition i gets
a threshold t_i, -1 for "not probed", with the sum of (t_i + 1) equal to the wanted distance + 1:
two fingerprints within that distance then agree within t_i in at least one partition. Thresholds
and the number of partitions come from a dynamic programme over estimated candidate counts. Every
distinct fingerprint is filed once per probed partition and probes the values within t_i of its
own; what meets in a bucket is verified on all 64 bits.

Copies are one fingerprint from the start. A bucket with very many fingerprints is filed again by
parts of its remaining bits, by the same principle, and a bucket's links come out as a forest, not
as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import rows, stage
from txnrisk.llm.components import components

# --- fixed values: the fingerprint asked for -----------------------------------------------
SHINGLE, SEED, DISTANCE = 4, 42, 4
# -------------------------------------------------------------------------------------------
SAMPLE = 3000  # fingerprints behind the cost estimate; they steer speed, never results
HOT = 2000  # fingerprints in a bucket before it is filed by its remaining bits as well
STRIP, BLOCK = 64, 32_768  # fingerprints of a large bucket compared at a time
PROBE_COST, PAIR_COST = 60.0, 1.0  # a probe's shuffled row against one comparison
PLAN_ROWS = 10_000  # a probed value is also a constant in the plan, which costs as much as so many rows


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of all word shingles, A-Z lower-cased, repeats included; fewer words: of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII rules: bytes
    if not words:
        return np.array([], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
    shingles = map(joined.__getitem__, map(slice, starts, (ends[width - 1 :] - 1).tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of ``hashes``; none: 0."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The ``keys`` columns and ``fp``, the fingerprint as a signed 64-bit number, per row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t) for part in rows(iter([batch.select([len(keys)])])) for t in part[0]]
            fp = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], names=[*keys, "fp"])

    schema = T.StructType([*docs.select(*keys).schema.fields, T.StructField("fp", T.LongType())])
    return docs.select(*keys, F.col(text_col).alias("_text")).mapInArrow(hashed, schema)


def hex_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- the filing plan --------------------------------------------------------------------------


def correlated_partitions(sample: np.ndarray, count: int) -> list[list[int]]:
    """The 64 bits in ``count`` lists of nearly equal length, each grown by the bit it correlates with most."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(float)
    centred = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, 64))
    spread = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    likeness = np.abs(centred.T @ centred / np.outer(spread, spread))
    np.fill_diagonal(likeness, 0)
    free, parts = list(range(64)), []
    for left in range(count, 0, -1):
        size = len(free) // left
        part = [max(free, key=lambda b: likeness[b, free].max())]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: likeness[b, part].sum()))
            free.remove(part[-1])
        parts.append(part)
    return parts


def mask_of(bits: list[int]) -> int:
    return sum(1 << (63 - b) for b in bits)


def filing_plan(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition."""
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    pairs = np.triu_indices(len(sample), 1)
    differing = sample[pairs[0]] ^ sample[pairs[1]]
    for count in range(1, distance + 2):
        parts = correlated_partitions(sample, count)
        costs = []
        for part in parts:
            apart = np.bitwise_count(differing & np.uint64(mask_of(part)))
            within = np.bincount(apart, minlength=distance + 1).cumsum() / max(1, len(apart))
            cost = [0.0]
            for t in range(distance + 1):
                probes = sum(comb(len(part), j) for j in range(t + 1))
                share = max(within[t], probes / 2.0 ** len(part))
                cost.append((total + PLAN_ROWS) * probes * PROBE_COST + total * total / 2 * share * PAIR_COST)
            costs.append(cost)
        # cheapest[s]: the first partitions with thresholds adding up to s, threshold + 1 each
        cheapest: list[tuple[float, list[int]]] = [(0.0, [])] + [(np.inf, [])] * (distance + 1)
        for cost in costs:
            cheapest = [
                min((cheapest[s - k][0] + cost[k], cheapest[s - k][1] + [k - 1]) for k in range(s + 1)) for s in range(distance + 2)
            ]
        price, thresholds = cheapest[distance + 1]
        if price < best[0]:
            best = (price, [(p, t) for p, t in zip(parts, thresholds, strict=True) if t >= 0])
    return best[1]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def filed(unique: DataFrame, plan: list[tuple[list[int], int]], distance: int = DISTANCE) -> DataFrame:
    """(bucket, fp, probe) rows: every fingerprint under its own value and those within the threshold.

    Of two fingerprints one probes for the other: the one whose first differing bit is 0. Further columns
    of ``unique`` go along.
    """
    everything = (1 << 64) - 1
    along = [c for c in unique.columns if c != "fp"]
    entries = []
    for i, (bits, threshold) in enumerate(plan):
        flips = [(mask_of(list(c)), mask_of(list(c[:1]))) for k in range(threshold + 1) for c in combinations(bits, k)]
        entries += [F.struct(F.lit(i).alias("part"), F.lit(signed(mask_of(bits))).alias("mask"), F.array(*[F.struct(F.lit(signed(f)).alias("flip"), F.lit(signed(z)).alias("zero")) for f, z in flips]).alias("flips"))]
    spread = unique.select("*", F.inline(F.array(*entries))).select("fp", *along, "part", "mask", F.inline("flips"))
    spread = spread.where(F.col("fp").bitwiseAND(F.col("zero")) == 0)
    keyed = spread.select("fp", *along, "part", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") != 0).alias("probe"))
    hot = keyed.where(~F.col("probe")).groupBy("part", "key").count().where(F.col("count") > HOT).select("part", "key", F.lit(True).alias("hot"))
    marked = keyed.join(hot, ["part", "key"], "left")
    # the remaining bits of a hot bucket in distance + 1 parts: at least one of them agrees
    rest = []
    for i, (bits, _) in enumerate(plan):
        others = [b for b in range(64) if b not in bits]
        cuts = [others[len(others) * j // (distance + 1) : len(others) * (j + 1) // (distance + 1)] for j in range(distance + 1)]
        rest.append(F.when(F.col("part") == i, F.array(*[F.lit(signed(mask_of(c) & everything)) for c in cuts])))
    masks = F.when(F.col("hot"), F.coalesce(*rest)).otherwise(F.array(F.lit(0).cast("bigint")))
    exploded = marked.select("fp", *along, "part", "key", "probe", F.posexplode(masks).alias("j", "sub"))
    return exploded.select(
        F.xxhash64("part", "key", "j", F.col("fp").bitwiseAND(F.col("sub"))).alias("bucket"), "fp", "probe", *along
    )


# --- verification -----------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, node) joining what the pairs (a, b) join, one per node that is not a root."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        before = label.copy()
        for side in (x, y):
            np.minimum.at(label, label[side], least)
            np.minimum.at(label, side, least)
        label = label[label]
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def close_pairs(bucket: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forests of the fingerprints within ``distance`` in the same bucket; rows are sorted by bucket."""
    start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    size = np.diff(np.concatenate((start, [len(bucket)])))
    end = np.repeat(start + size, size)
    small = np.repeat(size <= 64, size)
    left = np.flatnonzero(small)
    step, pairs = 1, []
    while len(left):
        left = left[left + step < end[left]]
        near = (np.bitwise_count(fp[left] ^ fp[left + step]) <= distance) & ~(probe[left] & probe[left + step])
        near &= fp[left] != fp[left + step]
        pairs.append((fp[left[near]], fp[left[near] + step]))
        step += 1
    if pairs:
        a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
        if len(a):
            yield forest(a, b)
    for g in np.flatnonzero(size > 64):
        inside = np.arange(start[g], start[g] + size[g])
        names, at = np.unique(fp[inside], return_inverse=True)
        tree = np.arange(len(names))  # what is joined already is not compared again
        filed_here = inside[~probe[inside]]
        for i in range(0, len(filed_here), STRIP):
            for j in range(0, len(inside), BLOCK):
                x, y = filed_here[i : i + STRIP], inside[j : j + BLOCK]
                joined = tree[at[x - start[g]]][:, None] == tree[at[y - start[g]]][None, :]
                near = (np.bitwise_count(fp[x][:, None] ^ fp[y][None, :]) <= distance) & ~joined
                one, other = np.nonzero(near)
                if len(one):
                    root, under = forest(tree[at[x[one] - start[g]]], tree[at[y[other] - start[g]]])
                    yield names[root], names[under]
                    moved = np.arange(len(names))
                    moved[under] = root
                    tree = moved[tree]


def links(filed_rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) links between fingerprints that join all those within ``distance``."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            bucket, probe, fp = columns
            for a, b in close_pairs(bucket, fp, probe, distance):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            probe = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            now = [batch.column(0).to_numpy(), probe, batch.column(2).to_numpy().view(np.uint64)]
            if held:
                now = [np.concatenate(p) for p in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on in the next batch
            held = [c[cut:] for c in now]
            if cut:
                yield from out([c[:cut] for c in now])
        if held:
            yield from out(held)

    dealt = filed_rows.select("bucket", "probe", "fp").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(verified, "a long, b long")


def rooted(marked: DataFrame, least: Column, distance: int = DISTANCE) -> DataFrame:
    """(node, root, least) for every distinct fingerprint: its component and its rows' smallest ``least``."""
    unique = stage(marked.groupBy("fp").agg(F.min(least).alias("least")), "distinct-fingerprints")
    total = unique.count()
    chosen = unique.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    plan = filing_plan(np.array([r[0] for r in chosen], dtype=np.int64).view(np.uint64), total, distance)
    found = components(links(filed(unique.select("fp"), plan, distance), distance))
    known = unique.select(F.col("fp").alias("node"), "least").join(found, "node", "left")
    return stage(known.select("node", F.coalesce("root", "node").alias("root"), "least"), "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: id, ``fp`` and ``component_id``, the smallest id reachable over links.

    A null or empty text, or one without words, has fingerprint 0 and is linked like any other.
    Repeated rows each come out; a null id is never the smallest unless there is no other, an empty
    table gives an empty one, and other columns are not read.
    """
    marked = stage(fingerprints(docs, [id_col], text_col), "fingerprints")
    known = rooted(marked, F.col(id_col), distance)
    component = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = known.join(component, "root").select(F.col("node").alias("fp"), "component_id")
    return marked.join(of_print, "fp").select(id_col, "fp", "component_id")
