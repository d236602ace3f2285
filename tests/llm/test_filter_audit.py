from __future__ import annotations

import random
from fractions import Fraction
from itertools import permutations
from math import factorial

from pyspark.sql import functions as F

from tests.llm.fixtures import awkward_docs
from txnrisk.llm import filter_audit as FA


def fails(text: str, duplicate: bool) -> set[str]:
    words = [w for w in text.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    checks = {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": duplicate,
    }
    return {k for k, v in checks.items() if v}


def walked(docs: list, labels: list) -> dict:
    """Every order applied row by row."""
    least: dict = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    judged = [(i, p or "", fails(t or "", i is not None and least[t or ""] < i)) for i, t, p in docs]
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    out, sums = {}, {}
    for part in {p for _, p, _ in judged}:
        rows = [(i, f) for i, p, f in judged if p == part]
        for order in permutations("ABCDE"):
            here = rows
            for step, letter in enumerate(order, 1):
                removed = [r for r in here if letter in r[1]]
                here = [r for r in here if letter not in r[1]]
                failing = [r for r in rows if letter in r[1]]
                out[part, "".join(order), step] = (
                    len(here), len(removed), len(failing) - len(removed), sum(f == {letter} for _, f in rows),
                    sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed),
                )
                sums[part, letter] = sums.get((part, letter), 0) + len(removed)
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check(spark, docs: list, labels: list, frame=None) -> None:
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string") if frame is None else frame
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = FA.audit(frame, marks).collect()
    want = walked(docs, [x[:3] for x in labels])
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want


def test_every_order_walked(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(130)] + ["A%", "CAPS", "B|C"]
    texts = [" ".join(rng.choices(words[: rng.choice([3, 60, 130, 133])], k=rng.choice([4, 99, 100, 140, 300]))) for _ in range(60)]
    texts += ["", None, " \t\v ", "\x1c".join(["one"] * 120), "ÄÖÜ É A bcdefghi"]
    docs = [(i, rng.choice(texts), rng.choice(["de", "en", "", None])) for i in range(300)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "other text") for i in rng.sample(range(320), 200)]
    check(spark, docs, labels + labels[:20] + [(None, 1, 1, None), (3, 1, 0, None), (3, 0, 1, None)])


def test_awkward_rows(spark):
    frame = awkward_docs(spark)
    docs = [(r.doc_id, r.text, r.lang) for r in frame.select("doc_id", "text", "lang").collect()]
    clash = frame.withColumns({c: F.lit("x") for c in ("part", "mask", "content", "first", "id", "rows")})
    check(spark, docs, [(2, 1, 1, "t"), (6, 1, None, "t"), (None, 1, 1, "t")], clash)
    check(spark, docs, [], frame)


def test_no_documents(spark):
    empty = awkward_docs(spark).limit(0)
    got = FA.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.columns[:3] == ["part", "filter_order", "step"] and got.isEmpty()


def test_solution_is_the_mean_over_orders():
    """For any values of the coalitions, with up to six players."""
    rng = random.Random(2)
    for n in (2, 3, 5, 6):
        v = [Fraction(0), *[Fraction(rng.randrange(1000)) for _ in range(2**n - 1)]]
        want = [Fraction(0)] * n
        for order in permutations(range(n)):
            s = 0
            for i in order:
                want[i] += v[s | 1 << i] - v[s]
                s |= 1 << i
        got = [sum(w * x for w, x in zip(weights, v, strict=True)) * factorial(n) for weights in FA.kernel_solution(n)]
        assert got == want


def test_copies_are_spread_by_their_ids(spark):
    """No exchange of the rows is dealt by the text alone: copies of one text are no group."""
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"))
    plan = FA.failures(docs)._jdf.queryExecution().sparkPlan().toString()
    assert "content" in plan and "Window" not in plan
    assert FA.failures(docs).where("mask >= 16").count() == 99
