"""Texts that share 0.8 or more of their five-word shingles, and one of each group of them.

Candidates meet in buckets, of which every text has a constant number. One is its SimHash group (``simhash``:
fingerprints linked at 4 differing bits by the generalised pigeonhole principle). That is too strict for a
likeness of 0.8, so there are 20 more, each the five smallest values of its shingles under five hash
functions; two texts at 0.8 share one of them with a chance of 0.9996, at 0.5 with one of 0.47. A bucket of
very many texts is filed again by the other 19 values, and its texts also go to the rest below.

Buckets are worked off in rounds. In a round every bucket proposes one text; the others in it that belong to
another group are compared with that one, exactly, on their whole sets of shingles; those that share 0.8 join
its group. So a round makes one row per member, never all pairs. First the text with the most company is
proposed, then others at random (by a hash), so that what the first does not reach is reached over the texts
it did. A bucket is done when it is in one group or when all its texts were proposed. One that three rounds in
a row did not change is left to the rest, with the texts it has not proposed.

The rest is joined exactly: in any fixed order of shingles, rarest first, two sets that share 0.8 have one of
their first shingles in common (a fifth of the set and one more; of the smaller set a ninth and one more). Texts of
different groups that meet so in a shingle of at most CROWD texts are paired and verified: that makes no more
than CROWD rows per first shingle. Those that meet in a shingle of more are compared in blocks, whose sets are
multiplied as matrices and leave a forest of links between groups, so no row is made per pair. The comparisons
themselves are still as many as pairs of texts in such a crowd, but for those inside its largest group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm import simhash as SH
from txnrisk.llm.common import rows, stage
from txnrisk.llm.components import components

SHINGLE = 5
SHARE = (4, 5)  # the likeness asked for, as a fraction
BANDS, WIDTH = 20, 5
IDLE = 3  # rounds without a change after which a bucket is left to the exact join
CROWD = 64  # nodes that meet in a shingle before they are compared in blocks
BLOCK = 512, 1 << 18  # nodes and shingles of a block at most
STEP = 1.26  # sizes of sets in one block; a little more than SHARE leaves room for
STRIP = 2048  # shingles hashed, and columns multiplied, at a time

_functions = np.random.default_rng(SH.SEED).integers(0, 2**64, (2, BANDS * WIDTH, 1), dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(SH.shingle_hashes(text, SHINGLE))


def bands(found: np.ndarray) -> np.ndarray:
    """One value per band, from the smallest values of a set under its functions; none for an empty set."""
    if not len(found):
        return np.zeros(0, dtype=np.uint64)
    turn, times = _functions[0], _functions[1] | np.uint64(1)
    least = np.full(BANDS * WIDTH, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(found), STRIP):
        np.minimum(least, ((found[None, at : at + STRIP] ^ turn) * times).min(axis=1), out=least)
    value = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, WIDTH).T:
        value = (value ^ column) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value


def prints(docs: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """The ``keys`` columns, node (128 bits of hash of the set of shingles), n (its size), fp and bands."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, fp, values = [], [], [], []
            for (texts,) in rows(iter([batch.select([len(keys)])])):
                for text in texts:
                    found = shingle_set(text)
                    node.append(xxhash.xxh3_128_digest(found.tobytes(), SH.SEED))
                    n.append(len(found))
                    fp.append(SH.fingerprint(text))
                    values.append(bands(found).view(np.int64))
            columns = [pa.array(node, pa.binary()), pa.array(n, pa.int32()), pa.array(np.array(fp, dtype=np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns, pa.array(values, pa.list_(pa.int64()))], names=[*keys, "node", "n", "fp", "bands"])

    more = T._parse_datatype_string("node binary, n int, fp long, bands array<long>")
    schema = T.StructType([*docs.select(*keys).schema.fields, *more.fields])
    return docs.select(*keys, F.col(text_col).alias("_text")).mapInArrow(hashed, schema)


# --- buckets ----------------------------------------------------------------------------------


def shared(filed: DataFrame) -> DataFrame:
    """The rows of buckets with two nodes or more, with ``size``, the number of them."""
    sizes = filed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return filed.join(sizes, "bucket")


def buckets(unique: DataFrame) -> DataFrame:
    """(bucket, node, n, weight, crowded) of all buckets in which nodes meet; ``weight`` is the node's company in all of
    them. Rows of buckets of very many nodes are ``crowded``: these meet in finer buckets, too."""
    by_band = unique.select("node", "n", F.posexplode("bands").alias("band", "value"))
    filed = by_band.select(F.xxhash64("band", "value").alias("bucket"), "node", "n", "band")
    root = SH.rooted(unique.where("n > 0"), F.col("node")).select(F.col("node").alias("fp"), "root")
    grouped = unique.where("n > 0").join(root, "fp").select(F.xxhash64(F.lit("simhash"), "root").alias("bucket"), "node", "n", F.lit(-1).alias("band"))
    met = stage(shared(filed.unionByName(grouped)), "buckets")
    hot = met.where(F.col("size") > SH.HOT)
    again = hot.join(unique.select("node", "bands"), "node").select("bucket", "node", "n", "band", F.posexplode("bands").alias("other", "value"))
    finer = again.where("band <> other").select(F.xxhash64("bucket", "other", "value").alias("bucket"), "node", "n", "band")
    every = met.where(F.col("size") <= SH.HOT).select("bucket", "node", "n", "size", F.lit(False).alias("crowded"))
    if not hot.isEmpty():
        every = every.unionByName(shared(finer).select("bucket", "node", "n", "size", F.lit(False).alias("crowded")))
        every = every.unionByName(hot.select("bucket", "node", "n", F.lit(0).alias("size"), F.lit(True).alias("crowded")))
    company = every.groupBy("node").agg(F.sum("size").alias("weight"))
    return every.select("bucket", "node", "n", "crowded").join(company, "node")


# --- verification -----------------------------------------------------------------------------


def shingles(docs: DataFrame, wanted: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(node, shingles) of the rows ``wanted`` (keys, node), one row each."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, texts in rows(iter([batch])):
                sets = [shingle_set(t).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(*keys, F.col(text_col).alias("_text")).join(wanted, keys).dropDuplicates(["node"]).select("node", "_text")
    return stage(texts.mapInArrow(hashed, "node binary, shingles array<long>"), "shingles")


def verified(found: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``found`` that share SHARE or more of their shingles."""
    one, other = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    beside = found.join(one, "a").join(other, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    either = F.size("sa") + F.size("sb") - F.col("both")
    return beside.where(F.col("both") * SHARE[1] >= either * SHARE[0]).select("a", "b")


def meetings(rest: DataFrame, sets: DataFrame, known: DataFrame | None) -> DataFrame:
    """(node, n, shingle, place, group, members): the first shingles of the nodes of ``rest`` (node, n) that nodes of two or
    more groups of ``known`` (node, root) have among their first; ``members`` is the number of such nodes. Two nodes that
    share SHARE of their shingles meet in one of them."""
    each = rest.join(sets, "node").select("node", "n", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    # a shingle that no other text of the rest holds comes first in the order and pairs nothing: it is only counted
    held = each.join(often, "shingle")
    place = F.row_number().over(Window.partitionBy("node").orderBy("times", "shingle"))
    alone = F.col("n") - F.count("*").over(Window.partitionBy("node"))
    first = F.col("n") - F.expr(f"(n * {SHARE[0]} + {SHARE[1] - 1}) div {SHARE[1]}") + 1
    marked = held.withColumns({"place": place, "alone": alone}).withColumn("place", F.col("place") + F.col("alone"))
    marked = marked.where(F.col("place") <= first).select("node", "n", "shingle", "place")
    if known is not None:
        marked = marked.join(known.select("node", "root"), "node", "left")
        marked = marked.select("node", "n", "shingle", "place", F.coalesce("root", "node").alias("group"))
    else:
        marked = marked.withColumn("group", F.col("node"))
    marked = stage(marked, "prefixes")
    sizes = marked.groupBy("shingle").agg(F.count("*").alias("members"), F.min("group").alias("low"), F.max("group").alias("high"))
    return stage(marked.join(sizes.where("low <> high").select("shingle", "members"), "shingle"), "meetings")


def prefix_pairs(met: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes of different groups that may share SHARE of their shingles and meet in a shingle of at most
    CROWD nodes; no pair that does share it and meets so is missing."""
    few = met.where(F.col("members") <= CROWD)
    fields = F.struct("n", "node", "place", "group")
    # of the smaller set a ninth may be without a match in the larger one, so its first shingles are fewer
    fewer = F.col("n") - F.expr(f"(n * {2 * SHARE[0]} + {sum(SHARE) - 1}) div {sum(SHARE)}") + 1
    one, other = few.where(F.col("place") <= fewer).select("shingle", fields.alias("x")), few.select("shingle", fields.alias("y"))
    once = F.struct("x.n", "x.node") < F.struct("y.n", "y.node")
    sizes = F.col("x.n") * SHARE[1] >= F.col("y.n") * SHARE[0]
    pairs = one.join(other, "shingle").where((F.col("x.group") != F.col("y.group")) & once & sizes)
    pairs = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    sides = pairs.agg(F.count("*").alias("both"), *[F.max(f"{side}.{c}").alias(f"{side}_{c}") for side in "xy" for c in ("n", "place")])
    # up to the last common first shingle all common ones are counted; after it no more can follow than are left
    most = F.col("both") + F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    return sides.where(most * sum(SHARE) >= (F.col("x_n") + F.col("y_n")) * SHARE[0]).select("a", "b")


# --- crowds: nodes that meet in shingles of very many -------------------------------------------


def crowds(crowded: DataFrame) -> DataFrame:
    """(node, crowd) of ``crowded`` (node, shingle): nodes with a shingle in common are in one crowd."""
    least = crowded.groupBy("node").agg(F.min("shingle").alias("least"))
    chained = crowded.join(least, "node").select(F.col("least").alias("a"), F.col("shingle").alias("b"))
    root = components(chained).withColumnRenamed("node", "least")
    return least.join(root, "least", "left").select("node", F.coalesce("root", "least").alias("crowd"))


def overlaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of values that each set of ``left`` shares with each of ``right``, both given as (values, sizes)."""
    names, at = np.unique(np.concatenate((left[0], right[0])), return_inverse=True)
    columns = at[: len(left[0])], at[len(left[0]) :]
    lines = [np.repeat(np.arange(len(sizes)), sizes) for _, sizes in (left, right)]
    times = [np.bincount(c, minlength=len(names)) for c in columns]
    shape = len(left[1]), len(right[1])
    both = np.zeros(shape, dtype=np.float32)
    # values that many sets hold: a matrix product; the others: row by row of those that hold them
    dense = times[0] * times[1] * 32 >= shape[0] * shape[1]
    number = np.where(dense, np.cumsum(dense) - 1, -1)
    for start in range(0, int(dense.sum()), STRIP):
        held = []
        for line, column, height in zip(lines, columns, shape, strict=True):
            inside = (number[column] >= start) & (number[column] < start + STRIP)
            held.append(np.zeros((height, STRIP), dtype=np.float32))
            held[-1][line[inside], number[column][inside] - start] = 1
        both += held[0] @ held[1].T
    thin = ~dense[columns[0]] & (times[1][columns[0]] > 0)
    line, column = lines[0][thin], columns[0][thin]
    sorted_right = lines[1][np.argsort(columns[1], kind="stable")]
    opens = np.cumsum(times[1]) - times[1]
    ends = np.cumsum(times[1][column])
    for start in range(0, int(ends[-1]) if len(ends) else 0, 1 << 20):
        part = np.arange(start, min(start + (1 << 20), int(ends[-1])))
        entry = np.searchsorted(ends, part, side="right")
        other = sorted_right[opens[column[entry]] + part - (ends[entry] - times[1][column[entry]])]
        both += np.bincount(line[entry] * shape[1] + other, minlength=both.size).reshape(shape)
    return both


def group_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links (a, b) between the groups of two blocks that hold texts which share SHARE, as a forest."""
    lists = [t["shingles"].combine_chunks() for t in (left, right)]
    sets = [(x.flatten().to_numpy(), x.value_lengths().to_numpy()) for x in lists]
    both = overlaps(*sets)
    n = sets[0][1][:, None] + sets[1][1][None, :]
    names, group = np.unique(np.array(left["group"].to_pylist() + right["group"].to_pylist(), dtype=object), return_inverse=True)
    one, other = group[: left.num_rows], group[left.num_rows :]
    x, y = np.nonzero((both * sum(SHARE) >= n * SHARE[0]) & (one[:, None] != other[None, :]))
    found = SH.forest(one[x], other[y])
    return pa.table([pa.array(names[f].tolist(), pa.binary()) for f in found], names=["a", "b"])


def crowd_links(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) links that join the groups of those nodes of ``crowded`` (node, n, group, shingle) that meet in a shingle and
    share SHARE of all.

    A crowd is cut into blocks of bounded size, of nodes of much the same number of shingles. Blocks that may hold a pair
    are compared with each other, whole sets with whole sets, and leave a forest. Blocks of the crowd's largest group are
    compared with all others, but not among themselves.
    """
    each = crowded.select("node", "n", "group").distinct().join(crowds(crowded.select("node", "shingle")), "node")
    sizes = each.groupBy("crowd", "group").agg(F.count("*").alias("members"))
    largest = sizes.groupBy("crowd").agg(F.max_by("group", F.struct("members", "group")).alias("largest"))
    step = F.floor(F.log(F.col("n")) / math.log(STEP)).cast("int")  # sets that share so much are at most one step apart
    placed = each.join(largest, "crowd").withColumns({"inner": F.col("group") == F.col("largest"), "step": step})
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK[0]), F.floor(F.lit(BLOCK[1]) / F.pow(F.lit(STEP), F.col("step") + 1))))
    name = ["crowd", "step", "inner"]
    parts = placed.groupBy(name).agg(F.count("*").alias("members")).select(*name, F.ceil(F.col("members") / room).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")
    dealt = stage(placed.join(parts, name).select(*name, part, "node", "group").join(sets, "node"), "crowds")
    blocks = stage(dealt.select(*name, "part").distinct(), "blocks")
    block = F.struct("step", "inner", "part")
    one = blocks.select("crowd", "step", block.alias("x"))
    other = blocks.select("crowd", block.alias("y"), F.explode(F.array("step", F.col("step") + 1)).alias("step"))
    pairs = one.join(other, ["crowd", "step"]).where((F.col("x") >= F.col("y")) & ~(F.col("x.inner") & F.col("y.inner")))
    pairs = stage(pairs.select("crowd", "x", "y", F.xxhash64("crowd", "x", "y").alias("pair")), "block-pairs")
    sides = []
    for side in "xy":
        wanted = pairs.select("crowd", f"{side}.*", "pair")
        columns = [F.col(c).alias(c) for c in ("pair", "group", "shingles")]  # else Spark takes both sides' for the same
        sides.append(dealt.join(wanted, [*name, "part"]).select(columns).groupBy("pair"))
    return sides[0].cogroup(sides[1]).applyInArrow(group_links, "a binary, b binary")


def roots(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of the nodes that belong to a group of two or more, by rounds over the buckets ``met`` and an
    exact join of what the rounds leave."""
    rest = [met.where("crowded").select("node", "n")]
    state = met.where("NOT crowded").select("bucket", "node", "n", "weight", F.col("node").alias("group"), F.lit(False).alias("done"), F.lit(0).alias("idle"))
    state = stage(state.withColumn("before", F.lit(None).cast("bigint")), "open")
    links, joined, turn = None, None, 0
    while not state.isEmpty():
        # the company a text has is compared first, then a hash that is another one in every round
        priority = F.col("weight") if turn == 0 else F.xxhash64("bucket", "node", F.lit(turn))
        proposed = F.max(F.when(~F.col("done"), F.struct(priority.alias("priority"), "node", "group", "n"))).alias("p")
        digest = F.sum(F.xxhash64("group") % 1_000_003).alias("now")
        heads = state.groupBy("bucket").agg(proposed, digest, F.min("group").alias("low"), F.max("group").alias("high"))
        heads = heads.where(F.col("p").isNotNull() & (F.col("low") != F.col("high"))).drop("low", "high")
        idle = F.when(F.col("now") == F.col("before"), F.col("idle") + 1).otherwise(0)
        state = stage(state.join(heads, "bucket").withColumn("idle", idle), "proposed")
        rest.append(state.where((F.col("idle") >= IDLE) & ~F.col("done")).select("node", "n"))
        state = state.where(F.col("idle") < IDLE)
        sizes = F.least("n", "p.n") * SHARE[1] >= F.greatest("n", "p.n") * SHARE[0]  # else they can't share so much
        apart = ~F.col("done") & (F.col("group") != F.col("p.group")) & sizes
        pairs = state.where(apart).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        good = stage(verified(pairs, sets), "alike")
        if not good.isEmpty():
            links = good if links is None else links.unionByName(good)
            joined = components(links)
        after = state.select("bucket", "node", "n", "weight", "group", (F.col("done") | (F.col("node") == F.col("p.node"))).alias("done"), "idle", F.col("now").alias("before"))
        if joined is not None:
            renamed = joined.withColumnRenamed("root", "to")
            after = after.join(renamed, "node", "left").withColumn("group", F.coalesce("to", "group")).drop("to")
        state, turn = stage(after, "open"), turn + 1
    left = stage(reduce(DataFrame.unionByName, rest).distinct(), "rest")
    if not left.isEmpty():
        meeting = meetings(left, sets, joined)
        good = verified(prefix_pairs(meeting), sets)
        crowded = meeting.where(F.col("members") > CROWD).select("node", "n", "group", "shingle")
        if not crowded.isEmpty():
            good = good.unionByName(crowd_links(crowded, sets))
        good = stage(good, "alike")
        if not good.isEmpty():
            joined = components(good if links is None else links.unionByName(good))
    return joined if joined is not None else met.select("node", F.col("node").alias("root")).limit(0)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id.

    Texts that share 0.8 or more of their five-word shingles are linked, and a group is what links join; a text
    of fewer words is one shingle, and texts without a word are alike. Every link is verified, so nothing goes
    without a text that shares 0.8 with it. Ids may be of any type. Rows with a null id come after all
    others; of rows with one id the one whose text has the smaller hash stays, of equal rows one. Columns
    stay as they are; an empty table gives an empty one.
    """
    none = F.lit("" if isinstance(docs.schema[id_col].dataType, T.StringType) else 0).cast(docs.schema[id_col].dataType)
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumns({"_none": F.col(id_col).isNull(), "_id": F.coalesce(F.col(id_col), none), "_hash": hashed})
    keys = ["_none", "_id", "_hash"]
    marked = stage(prints(keyed, keys, text_col), "prints")
    first = marked.groupBy("node").agg(F.min(F.struct(*keys, "n", "fp", "bands")).alias("first"))
    unique = stage(first.select("node", F.struct(*[f"first.{k}" for k in keys]).alias("least"), "first.n", "first.fp", "first.bands"), "distinct-sets")
    met = stage(buckets(unique), "met")
    wanted = met.select("node").distinct().join(unique.select("node", "least"), "node").select("node", "least.*")
    found = roots(met, shingles(keyed, wanted, keys, text_col))
    known = unique.select("node", "least").join(found, "node", "left")
    kept = known.groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("least")).select("least.*")
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
