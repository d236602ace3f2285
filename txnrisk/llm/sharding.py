"""Shards by extendible hashing, with column expressions only.

A shard is a prefix of the bits of a row's hash. The directory starts with one empty prefix; a prefix
whose rows exceed the byte limit splits on its next bit, all others stay. Byte counts per prefix of
``DEPTH`` more bits than the open prefixes have are taken in one aggregation, and the splits within
these bits follow from sums over its result; only rows of prefixes still too large take part in a
further round, so a round reads what the last one left open.

The bits are those of the content's hash and then of a row number, so that even any number of equal
rows can be told apart; a single row larger than the limit is a shard of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import stage

LIMIT = 8_000_000  # bytes of text in a shard
DEPTH = 12  # bits looked at in a round
CONTENT_BITS = 60


def content_hash(*columns: Column) -> Column:
    """The first 60 bits of the MD5 of the columns as text; null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("bigint")


def _bits(first: int, count: int) -> Column:
    """Bits ``first`` to ``first + count`` of (h, tie) as text."""
    every = F.concat(F.lpad(F.bin("h"), CONTENT_BITS, "0"), F.lpad(F.bin("tie"), CONTENT_BITS, "0"))
    return F.substring(every, first + 1, count)


def directory(sizes: DataFrame, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """(shard, bytes, docs) for the rows of ``sizes`` (h, tie, bytes): the leaves of the directory.

    ``shard`` is the prefix as text of 0 and 1. A leaf above the limit holds one single row.
    """
    leaves = []
    open_rows = sizes.withColumn("prefix", F.lit(""))
    for start in range(0, 2 * CONTENT_BITS, depth):
        cells = open_rows.groupBy("prefix", _bits(start, depth).alias("next")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("docs")
        )
        cells = stage(cells, "shard-cells")
        levels = F.sequence(F.lit(0), F.lit(min(depth, 2 * CONTENT_BITS - start)))
        nodes = cells.select("prefix", "next", "bytes", "docs", F.explode(levels).alias("level"))
        sums = nodes.groupBy("prefix", F.substring("next", 1, F.col("level").cast("int")).alias("path")).agg(
            F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")
        )
        fits = (F.col("bytes") <= limit) | (F.col("docs") == 1)
        # a node is reached if every node above it was too large: sums only grow towards the root, and
        # so does the number of rows, so it is enough that the node right above is
        above = sums.where(~fits).select(F.col("prefix").alias("open"), F.col("path").alias("parent"))
        below = (F.col("prefix") == F.col("open")) & (F.length("path") > 0) & (F.expr("left(path, length(path) - 1)") == F.col("parent"))
        reached = sums.join(above, below, "left").where((F.length("path") == 0) | F.col("parent").isNotNull())
        reached = reached.select(F.concat("prefix", "path").alias("shard"), "bytes", "docs", F.length("path").alias("level"))
        reached = stage(reached, "shard-nodes")
        leaves.append(reached.where(fits).select("shard", "bytes", "docs"))
        full = reached.where(~fits & (F.col("level") == depth)).select(F.col("shard").alias("prefix"))
        if full.isEmpty():
            break
        open_rows = sizes.withColumn("prefix", _bits(0, start + depth)).join(full, "prefix", "left_semi")
    return reduce(DataFrame.unionByName, leaves)


def _hashed(docs: DataFrame, id_col: str, text_col: str, *carried: Column) -> DataFrame:
    """``carried`` with h, tie and bytes, written down: that fixes the row numbers behind ``tie``."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint")
    content = content_hash(F.col(id_col), F.col(text_col))
    tie = F.bitwise_not(F.lit(-1 << CONTENT_BITS).cast("bigint")).bitwiseAND(F.xxhash64(F.monotonically_increasing_id()))
    return stage(docs.select(*carried, content.alias("h"), tie.alias("tie"), size.alias("bytes")), "shard-rows")


def _placed(rows: DataFrame, limit: int, depth: int) -> DataFrame:
    """``rows`` with shard, shard_bytes and shard_docs instead of h and tie."""
    leaves = stage(directory(rows.select("h", "tie", "bytes"), limit, depth), "shard-directory")
    depths = [r["depth"] for r in leaves.select(F.length("shard").alias("depth")).distinct().collect()]  # at most 121 numbers
    tries = F.array(*[_bits(0, d) for d in sorted(depths)]) if depths else F.array(F.lit(""))
    found = leaves.select("shard", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    # a row is in exactly one leaf: of its prefixes of the depths that occur, one is in the directory
    return rows.withColumn("shard", F.explode(tries)).drop("h", "tie").join(found, "shard")


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """Per row: id, shard, depth, bytes, shard_bytes, shard_docs, oversized.

    Bytes are those of the text in UTF-8, 0 for a null. ``oversized`` marks the shard of a single row
    above the limit. Equal rows are told apart by their place in the table, all other rows by id and
    text alone. An empty table gives an empty one, other columns are not read.
    """
    placed = _placed(_hashed(docs, id_col, text_col, F.col(id_col).alias("id")), limit, depth)
    return placed.select(
        F.col("id").alias(id_col), "shard", F.length("shard").alias("depth"), "bytes", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized")
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, depth: int = DEPTH) -> None:
    """Write every row as Parquet, a folder ``shard=b<bits>`` per shard; all columns of ``docs`` are kept."""
    row = F.struct(*docs.columns).alias("row")
    placed = _placed(_hashed(docs, id_col, text_col, row), limit, depth)
    named = placed.select("row.*", F.concat(F.lit("b"), "shard").alias("shard"))  # not a number to a reader
    named.repartition("shard").write.partitionBy("shard").parquet(path)
