"""Secret scanning with column expressions only.

Patterns give the base spans. Beyond them, long strings of letters, digits and a few signs are
candidates: a window slides over each, its Shannon entropy kept up to date from the counts of the
one character that enters and the one that leaves, and a candidate whose best window reaches the
bound of its character class becomes a span, unless an allow-list pattern fits it.

Positions come from the lengths of matches and of the text between them (``regexp_extract_all``
and ``split`` by the same pattern), in code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the base patterns asked for ---------------------------------------------
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # runs of 24 or more, whole: the same as all runs, short ones dropped
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
# -------------------------------------------------------------------------------------------

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20


@dataclass(frozen=True)
class CharacterClass:
    """A candidate belongs to the first class whose pattern fits all of it."""

    pattern: str
    bits: float | None  # least entropy of its best window; None: never a secret


CLASSES = (
    CharacterClass(r"\A[A-Za-z_-]*\z|\A[0-9_+=/-]*\z", None),  # words, numbers
    CharacterClass(r"\A[0-9A-Fa-f]*\z", 3.0),
    CharacterClass(r"\A[0-9a-z]*\z|\A[0-9A-Z]*\z", 3.6),
    CharacterClass(r"\A[0-9A-Za-z+/_=-]*\z", 3.8),
)
ALLOWED = (
    r"\A[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\z",  # UUIDs
    r"(?i)example|placeholder|xxxx|changeme|dummy",
    r"(?i)abcdefgh|01234567|12345678",
    r"\A/?([A-Za-z]+[/_-])+[A-Za-z]*[0-9]{0,4}\z",  # paths and hyphened words
)
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
ORDER = ("assign", "access", "hex", "entropy")


def _spans(text: Column, pattern: str, kind: str, least: int, group: int = 0) -> Column:
    """Spans of the matches whose ``group`` has ``least`` characters."""
    found, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (0, group))
    lengths = F.transform(found, F.char_length)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    walk = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), lengths.alias("len"), F.transform(values, F.char_length).alias("val")),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"CAST(array() AS {SPAN})").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + F.coalesce(m["len"], F.lit(0))).cast("bigint").alias("at"),
            F.when(
                m["val"] >= least,
                F.array_append(
                    acc["spans"],
                    F.struct(
                        F.lit(kind).alias("kind"),
                        (acc["at"] + m["gap"]).cast("bigint").alias("start"),
                        (acc["at"] + m["gap"] + m["len"]).cast("bigint").alias("end"),
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    # most texts match nothing: they are read once, and never split
    return F.when(F.size(found) > 0, walk).otherwise(F.expr(f"CAST(array() AS {SPAN})"))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of a window over ASCII ``text`` of ``window`` characters or more.

    n log2 n summed over the characters' counts, s, changes by two terms per step; the entropy is
    log2(window) - s / window.
    """

    def term(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def code(i: Column) -> Column:
        return F.ascii(F.substr(text, i, F.lit(1)))

    def moved(acc: Column, place: Column, by: int) -> Column:
        count = F.element_at(acc["n"], place + 1)
        return F.struct(
            F.transform(acc["n"], lambda x, i: F.when(i == place, x + by).otherwise(x)).alias("n"),
            (acc["s"] + term(count + by) - term(count)).alias("s"),
            acc["best"].alias("best"),
        )

    def step(acc: Column, i: Column) -> Column:
        entered = moved(acc, code(i), 1)
        left = F.when(i > window, moved(entered, code(F.greatest(i - window, F.lit(1))), -1)).otherwise(entered)
        bits = F.log2(F.lit(float(window))) - left["s"] / window
        best = F.when(i >= window, F.greatest(left["best"], bits)).otherwise(left["best"])
        return F.struct(left["n"].alias("n"), left["s"].alias("s"), best.alias("best"))

    start = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(text)), start, step, lambda acc: acc["best"])


def _secret(candidate: Column, classes: tuple[CharacterClass, ...], allowed: tuple[str, ...]) -> Column:
    """Whether a candidate's entropy reaches the bound of its class and no allow-list pattern fits."""
    bound = F.lit(None).cast("double")
    for c in reversed(classes):
        bound = F.when(candidate.rlike(c.pattern), F.lit(c.bits).cast("double")).otherwise(bound)
    suppressed = F.lit(False)
    for pattern in allowed:
        suppressed = suppressed | candidate.rlike(pattern)
    # the window runs only over what is left
    return F.when(bound.isNull() | suppressed, False).otherwise(window_entropy(candidate) >= bound - 1e-9)


def _text_at(text: Column, span: Column) -> Column:
    return F.substr(text, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))


def _rank(kind: Column) -> Column:
    out = F.lit(len(ORDER))
    for i, name in enumerate(ORDER):
        out = F.when(kind == name, F.lit(i)).otherwise(out)
    return out


def _ordered(spans: Column) -> Column:
    """By start, then kind in the listed order."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), _rank(s["kind"]).alias("b"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_scan(
    docs: DataFrame,
    text_col: str = "text",
    classes: tuple[CharacterClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: arrays of (kind, start, end), by start, then kind.

    The whole text is read. A null text counts as empty and has no spans. Spans of one kind never
    overlap; an entropy span is left out where it overlaps a base span. Columns of ``docs`` stay,
    repeated rows too; columns named like the two results are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(
        _spans(text, ASSIGN, "assign", ASSIGN_LEAST, 2), _spans(text, ACCESS, "access", ACCESS_LEAST), _spans(text, HEX, "hex", HEX_LEAST)
    )
    found = docs.withColumns({"base_spans": _ordered(base), "all_spans": _spans(text, CANDIDATE, "entropy", WINDOW)})
    added = F.filter(
        F.col("all_spans"),
        lambda s: F.when(F.exists(F.col("base_spans"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), False).otherwise(
            _secret(_text_at(text, s), classes, allowed)
        ),
    )
    # few texts have candidates at all
    every = F.when(F.size("all_spans") > 0, _ordered(F.concat(F.col("base_spans"), added))).otherwise(F.col("base_spans"))
    return found.withColumn("all_spans", every)


def redact(scanned: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The scanned rows with every span replaced by ``mask``, overlapping spans by one; spans are dropped.

    A null text stays null; a text without spans stays as it is.
    """
    text = F.col(text_col)
    walk = F.aggregate(
        F.col("all_spans"),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("CAST(array() AS array<string>)").alias("parts")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["parts"],
                    F.array(F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)),
                ).alias("parts"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, (acc["at"] + 1).cast("int"), F.char_length(text))),
    )
    clean = F.when(F.coalesce(F.size("all_spans"), F.lit(0)) > 0, walk).otherwise(text)
    return scanned.withColumn(text_col, clean).drop("base_spans", "all_spans")
