"""Mixing sources to target weights by capped water-filling, with column expressions only.

Every source has a weight and may be repeated up to a number of epochs. The words wanted are shared by
weight; a source whose share exceeds its cap is clamped there, and what it cannot take is shared among the
others by weight, until no share exceeds its cap. Sources are never gathered: a round is one aggregation
over the table of sources, and only its totals come to the driver.

A source's target is then taken as whole repetitions of all its documents and a sampled part: documents in
the order of a seeded hash of their content, each once more, until the words are reached. The hash at which
they are reached is found by descending through sums per hash bucket, so no source is ever sorted or held in
one task; documents below it count once more, those above don't, and those at it (one document, or equal
rows) take what is left, in proportion.

All sums are whole numbers, so results do not depend on the layout of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.llm.common import stage
from txnrisk.llm.sharding import CONTENT_BITS, content_hash
from txnrisk.operators.ranks import ranked

# --- fixed values: the mix asked for -------------------------------------------------------
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)  # by rank of the source, repeating
SHARE = (3, 2)  # of all words, as a fraction
EPOCHS = 2  # times a source's words at most
# -------------------------------------------------------------------------------------------
SEED = 42
DEPTH = 12  # bits of the hash looked at in a round


def n_words(text: Column) -> Column:
    """Words of a text, whole; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """The source as a text that is never null: keys of other sources start with =."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


# --- targets ----------------------------------------------------------------------------------


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (key, size) with ``weight``: the weights in turn, sources by code point, null last."""
    place = ranked(sizes.withColumn("last", F.col("key") == ""), ["last", "key"])
    turn = F.array(*[F.lit(w).cast("bigint") for w in weights])
    return place.withColumn("weight", turn[(F.col("rank") % len(weights)).cast("int")]).drop("last", "rank")


def targets(sizes: DataFrame, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` (key, size, weight) with target and words: what is wanted of a source, exact and in whole words.

    ``share`` of all words is wanted, of a source no more than ``epochs`` times its size. Weights must be
    above 0. An empty source has target 0; where all caps together give less than wanted, all sources are at
    their caps. At least one source is clamped in a round but the last.
    """
    num, den = share
    wide = "decimal(38,0)"
    cap = F.col("size") * epochs
    sources, held = stage(sizes.withColumn("clamped", F.lit(False)), "mix-sources"), 0
    while True:
        totals = sources.agg(
            F.sum("size").alias("size"),
            F.sum(F.col("clamped").cast("bigint")).alias("held"),
            F.sum(F.when(F.col("clamped"), F.col("size"))).alias("held_size"),
            F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("weight"),
        ).first()
        # a source that is not clamped gets weight * left / by; both sides of a comparison are whole numbers
        left = num * (totals.size or 0) - den * epochs * (totals.held_size or 0)
        by = den * (totals.weight or 0)
        if by == 0 or totals.held == held > 0:
            break
        held = totals.held
        above = F.col("weight").cast(wide) * F.lit(left).cast(wide) > cap.cast(wide) * F.lit(by).cast(wide)
        again = sources.withColumn("clamped", F.col("clamped") | above)
        if held == 0 and again.where("clamped").isEmpty():
            break
        sources = stage(again, "mix-sources")
    part = F.col("weight").cast(wide) * F.lit(left).cast(wide)
    exact = F.when(F.col("clamped"), cap.cast("double")).otherwise(part.cast("double") / F.lit(float(max(by, 1))))
    rounded = F.expr(f"cast(((cast(weight as {wide}) * cast({left} as {wide})) * 2 + {by}) div cast({2 * max(by, 1)} as {wide}) as bigint)")
    return sources.select(*sizes.columns, exact.alias("target"), F.when(F.col("clamped"), cap).otherwise(rounded).alias("words"))


# --- samples ----------------------------------------------------------------------------------


def cut_points(rows: DataFrame, wanted: DataFrame, depth: int) -> DataFrame:
    """(key, cut, left, held): the hash at which the rows of a key, by hash, first exceed ``wanted``.

    ``rows`` has key, size and h, a hash of 60 bits; ``wanted`` has key and left, fewer words than the key's
    rows hold. Rows with a smaller hash fit in whole; ``left`` words are left for those at it, which hold
    ``held``. A round sums sizes per ``depth`` bits and goes on in the one bucket a key that is exceeded; it
    sees at most 2^depth sums a key. A key without words has no cut.
    """
    found, open_keys = None, wanted.select("key", "left")
    for start in range(0, CONTENT_BITS, depth):
        inside = rows
        if start:
            inside = rows.withColumn("prefix", F.shiftright("h", CONTENT_BITS - start)).join(open_keys, ["key", "prefix"], "left_semi")
        bucket = F.shiftright("h", max(0, CONTENT_BITS - start - depth)).alias("prefix")
        sums = inside.groupBy("key", bucket).agg(F.sum("size").alias("held"), F.min("h").alias("cut"), F.max("h").alias("last"))
        upto = F.sum("held").over(Window.partitionBy("key").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        at = sums.withColumn("upto", upto).join(open_keys.select("key", "left"), "key")
        at = at.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("held") <= F.col("left")))
        at = stage(at.select("key", "prefix", (F.col("left") - F.col("upto") + F.col("held")).alias("left"), "held", "cut", "last"), "mix-cuts")
        done = at.where("cut = last").select("key", "cut", "left", "held")
        found = done if found is None else found.unionByName(done)
        open_keys = at.where("cut < last").select("key", "prefix", "left")
        if open_keys.isEmpty():
            break
    return found


def _rows(docs: DataFrame, carried: Column, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(
        carried,
        source_key(F.col(source_col)).alias("key"),
        n_words(F.col(text_col)).alias("size"),
        content_hash(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
    )


def _taken(rows: DataFrame, weights: tuple[int, ...], share: tuple[int, int], epochs: int) -> DataFrame:
    """``rows`` with source_size, target and taken instead of key and h."""
    rows = stage(rows, "mix-rows")
    sizes = rows.groupBy("key").agg(F.sum("size").alias("size"))
    wanted = targets(cyclic_weights(sizes, weights), share, epochs).withColumnRenamed("size", "source_size")
    whole = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0)
    wanted = wanted.withColumn("whole", whole).withColumn("left", F.col("words") - F.col("whole") * F.col("source_size"))
    wanted = stage(wanted.select("key", "source_size", "target", "whole", "left"), "mix-targets")
    cuts = cut_points(rows.select("key", "size", "h"), wanted.select("key", "left"), DEPTH)
    plan = wanted.drop("left").join(cuts, "key", "left")
    once_more = (
        F.when(F.col("h") < F.col("cut"), F.col("size"))
        .when(F.col("h") == F.col("cut"), F.expr("cast(cast(size as decimal(38,0)) * left div held as bigint)"))
        .otherwise(0)
    )
    every = [c for c in rows.columns if c not in ("key", "h")]
    return rows.join(stage(plan, "mix-plan"), "key").select(
        *every, "source_size", "target", (F.col("whole") * F.col("size") + F.when(F.col("size") > 0, once_more).otherwise(0)).alias("taken")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Per row: id, size, source_size, target (its source's) and taken, the words the mix takes of it.

    Sizes are words of whole texts, 0 for a null. A null source is a source of its own, after all others; the
    empty text is another one. What is sampled depends on seed, id and text alone; repeated rows (equal in
    both) share what is left for them evenly, rounded down. ``taken`` is at most ``epochs`` times the size. An
    empty table gives an empty one; other columns are not read.
    """
    rows = _rows(docs, F.col(id_col).alias("id"), id_col, text_col, source_col, seed)
    return _taken(rows, weights, share, epochs).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, with all their columns.

    A repetition taken in part has the first words of the text, joined by single spaces; whole ones keep the
    text as it is. Rows of which nothing is taken, such as texts without words, are not in it.
    """
    rows = _rows(docs, F.struct(*docs.columns).alias("row"), id_col, text_col, source_col, seed)
    mixed = _taken(rows, weights, share, epochs).where("taken > 0")
    each = mixed.select("row", F.explode(F.expr("transform(sequence(0, (taken - 1) div size), i -> least(size, taken - i * size))")).alias("n"), "size")
    text = F.col(f"row.{text_col}")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    part = F.array_join(F.slice(words, F.lit(1), F.col("n").cast("int")), " ")
    return each.select("row.*", F.when(F.col("n") < F.col("size"), part).otherwise(text).alias("_mixed")).withColumn(text_col, F.col("_mixed")).drop("_mixed")
