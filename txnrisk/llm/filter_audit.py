"""How filters of a corpus interact: what each removes in every order, and its fair share of all removals.

Filters are applied one after the other; what a filter removes depends on those before it. All that can be
said about any order follows from the removals of the coalitions, the sets of filters: ``v(S)`` is the number
of rows failing a filter of S. The rows are read once, down to a mask of the filters they fail; masks are
counted per part, and the 2^n coalitions are tabulated from at most 2^n counts a part.

* A step's figures are differences of two coalitions: with and without its filter.
* A filter's Shapley value is the solution of a constrained least-squares problem: values that add up to
  v(all) and fit v(S) for all other S best, weighted by the Shapley kernel (n - 1) / (C(n, s) s (n - s)). Its
  normal equations do not depend on the data; they are solved once in rationals, for a unit vector per
  coalition, and the solution is applied to every part as whole numbers over n!.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import stage

# --- fixed values: the filters asked for ---------------------------------------------------
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = r"[#$%&*|]"
# -------------------------------------------------------------------------------------------
DUPLICATE = "E"
COUNTED = ("rows", "good", "toxic")


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of the text itself; ``text`` must not be null."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": n < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
        "C": capitals * 100 > F.char_length(text) * MOST_CAPITALS,
        "D": text.rlike(SYMBOLS),
    }


# --- rows to counts ---------------------------------------------------------------------------


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) per row; bit i of ``mask`` is set if the row fails the filter of the i-th letter.

    The last filter fails rows whose text equals that of any row with a smaller id. Such rows are told by
    the rows that do not fail: those with the smallest id of their text. The comparison is an equality on
    (text, id), so that copies of one text are spread over the cluster by their ids. A text goes by its
    SHA-256. A null text is empty, a null part too; a null id is neither smaller than others nor has
    smaller ones. Repeated rows (equal ids) do not fail each other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    failed = conditions(text)
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed.values())), F.lit(0))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("content"),
        mask.alias("mask"),
    )
    narrow = stage(narrow, "audit-rows")
    known, nameless = narrow.where(F.col("id").isNotNull()), narrow.where(F.col("id").isNull())
    first = known.groupBy("content").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = known.join(first, ["content", "id"], "left")
    later = F.when(F.col("first"), 0).otherwise(1 << len(failed))
    whole = marked.select("id", "part", (F.col("mask") + later).alias("mask"))
    return whole.unionByName(nameless.select("id", "part", "mask"))


def cells(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, rows, good, toxic): the rows of ``failed`` counted, at most 2^n cells a part.

    A row is good (toxic) if any label row of its id says quality (toxic) = 1; ids without labels are
    neither. Only labels that say so are joined, one row an id.
    """
    marks = labels.where((F.col("quality") == 1) | (F.col("toxic") == 1)).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    zero = F.lit(0)
    counts = failed.groupBy("part", "mask").agg(F.count("*").alias("rows")).select("part", "mask", "rows", zero.alias("good"), zero.alias("toxic"))
    marked = failed.join(marks, "id").select("part", "mask", zero.alias("rows"), F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    return counts.unionByName(marked).groupBy("part", "mask").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTED])


# --- counts to coalitions ---------------------------------------------------------------------


def coalitions(counted: DataFrame, n: int) -> DataFrame:
    """(part, total, removed): ``total`` the rows of the part and ``removed[S]`` what coalition S removes.

    ``removed`` is an array over all 2^n coalitions, by their mask, of the rows and the good and toxic ones
    among them. A part gathers at most 2^n cells.
    """
    cell = F.struct("mask", *COUNTED)
    gathered = counted.groupBy("part").agg(F.sum("rows").alias("total"), F.collect_list(cell).alias("cells"))
    nothing = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in COUNTED])

    def removed_by(s: Column) -> Column:
        def add(acc: Column, cell: Column) -> Column:
            hit = cell["mask"].bitwiseAND(s) != 0
            return F.struct(*[(acc[c] + F.when(hit, cell[c]).otherwise(0)).alias(c) for c in COUNTED])

        return F.aggregate("cells", nothing, add)

    return gathered.select("part", "total", F.transform(F.sequence(F.lit(0), F.lit(2**n - 1)), removed_by).alias("removed"))


def kernel_solution(n: int) -> list[list[Fraction]]:
    """For each of ``n`` players the weight of every coalition's value in its Shapley value.

    The values x minimise the sum over S, neither empty nor all, of kernel(|S|) (v(S) - sum of x in S)^2 under
    sum x = v(all). With a multiplier for the constraint these are n + 1 linear equations, solved by Gauss and
    Jordan in rationals with one right-hand side per coalition.
    """
    every, inner = 2**n - 1, range(1, 2**n - 1)
    kernel = {s: Fraction(n - 1, comb(n, s) * s * (n - s)) for s in range(1, n)}
    rows = []
    for i in range(n):
        left = [sum((kernel[s.bit_count()] for s in inner if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)]
        right = [kernel[s.bit_count()] if s in inner and s >> i & 1 else Fraction(0) for s in range(2**n)]
        rows.append([*left, Fraction(1), *right])
    rows.append([*[Fraction(1)] * n, Fraction(0), *[Fraction(s == every) for s in range(2**n)]])
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c], strict=True)]
    return [row[n + 1 :] for row in rows[:n]]


def shapley_sums(removed: Column, n: int) -> list[Column]:
    """n! times the Shapley value of each filter: its removals summed over all orders, a whole number."""
    sums = []
    for weights in kernel_solution(n):
        terms = [removed[s]["rows"] * F.lit(int(w * factorial(n))) for s, w in enumerate(weights) if w]
        assert all((w * factorial(n)).denominator == 1 for w in weights)
        sums.append(sum(terms[1:], terms[0]))
    return sums


def steps(table: DataFrame, letters: str) -> DataFrame:
    """Per part, order of ``letters`` and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``table`` holds :func:`coalitions`. The orders are a fixed list of n! n entries beside each part.
    """
    n, every = len(letters), 2 ** len(letters) - 1
    places = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            name = "".join(letters[j] for j in order)
            places.append(F.struct(F.lit(name).alias("filter_order"), F.lit(step).alias("step"), F.lit(i).alias("i"), F.lit(before).alias("s")))
            before |= 1 << i
    shares = F.array(*shapley_sums(F.col("removed"), n)).alias("shares")
    placed = table.select("part", "total", "removed", shares).select("*", F.inline(F.array(*places)))
    bit = F.expr("shiftleft(1, i)")

    def of(s: Column, what: str = "rows") -> Column:
        return F.col("removed")[s][what]

    before, after = F.col("s"), F.col("s").bitwiseOR(bit)
    removed = of(after) - of(before)
    return placed.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - of(after)).alias("kept"),
        removed.alias("removed"),
        (of(bit) - removed).alias("redundant"),
        (of(F.lit(every)) - of(F.lit(every).bitwiseXOR(bit))).alias("unique_fails"),
        (of(after, "good") - of(before, "good")).alias("good_lost"),
        (of(after, "toxic") - of(before, "toxic")).alias("toxic_lost"),
        F.col("shares")[F.col("i")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The five filters over ``docs`` in all 120 orders, per value of ``part_col``: see :func:`steps`.

    Reads whole texts once. A null text is empty, a null part is the empty string; how null ids, equal rows
    and repeated labels count is said at :func:`failures` and :func:`cells`. Without documents there are no
    rows. Other columns are not read.
    """
    letters = "ABCD" + DUPLICATE
    counted = cells(stage(failures(docs, id_col, text_col, part_col), "audit-masks"), labels, id_col)
    return steps(stage(coalitions(counted, len(letters)), "audit-coalitions"), letters)
