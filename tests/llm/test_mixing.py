from __future__ import annotations

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import awkward_docs, prose
from txnrisk.llm import mixing as MX


def filled(sizes: dict, weights: dict, share: Fraction, epochs: int) -> dict:
    """Shares by weight, clamped source by source until none is above its cap."""
    total, held = share * sum(sizes.values()), {}
    while True:
        open_keys = [k for k in sizes if k not in held]
        free = total - sum(held.values())
        part = {k: free * weights[k] / sum(weights[o] for o in open_keys) for k in open_keys}
        above = [k for k in open_keys if part[k] > epochs * sizes[k]]
        if not above:
            return held | part
        held |= {k: Fraction(epochs * sizes[k]) for k in above}


@pytest.mark.parametrize(("share", "epochs"), [((3, 2), 2), ((1, 3), 1), ((29, 10), 3), ((9, 1), 2)])
def test_targets_against_rounds_in_fractions(spark, share, epochs):
    rng = random.Random(share[0])
    sizes = {f"={i:03d}": rng.choice([0, 1, 7, 10**i if i < 13 else 5, rng.randrange(10**6)]) for i in range(60)}
    weights = {k: rng.choice([1, 2, 3, 50]) for k in sizes}
    frame = spark.createDataFrame([(k, sizes[k], weights[k]) for k in sizes], "key string, size long, weight long")
    want = filled(sizes, weights, Fraction(*share), epochs)
    for row in MX.targets(frame, share, epochs).collect():
        assert row.target == float(want[row.key]) or abs(row.target - want[row.key]) <= 1e-15 * want[row.key]
        assert row.words == (2 * want[row.key] + 1) // 2


def test_weights_by_code_point_null_last(spark):
    keys = ["=", "=A", "=a", "=b", "=ä", "=￮", "=😀", ""]
    got = MX.cyclic_weights(spark.createDataFrame([(k, 1) for k in reversed(keys)], "key string, size long")).collect()
    assert {r.key: r.weight for r in got} == {k: (3, 1, 2)[i % 3] for i, k in enumerate(keys)}


def corpus(spark, rng: random.Random):
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["hot"] * 6 + ["b", "c", "", None, "tiny"][: 5 if i % 9 else 4])) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


@pytest.mark.parametrize("depth", [1, 7, 12])
def test_sources_come_to_their_targets(spark, depth, monkeypatch):
    monkeypatch.setattr(MX, "DEPTH", depth)
    docs, rows = corpus(spark, random.Random(5))
    source = {i: s for i, _, s in rows}
    sizes: Counter = Counter()
    for _, text, s in rows:
        sizes[s] += len(text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = filled(sizes, weights, Fraction(3, 2), 2)
    got = MX.mix(docs).collect()
    taken: Counter = Counter()
    partly = defaultdict(int)
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-9 and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        partly[source[r.doc_id]] += r.size > 0 and r.taken % r.size > 0
    assert {r.doc_id for r in got} == set(source) and len(got) == len(rows)
    assert all(taken[s] == (2 * want[s] + 1) // 2 for s in sizes)  # to the word: no two rows are equal
    assert max(partly.values()) <= 1


def test_reruns_agree_at_any_layout(spark):
    docs, _ = corpus(spark, random.Random(6))
    runs = [sorted(map(tuple, MX.mix(docs.repartition(n)).collect())) for n in (1, 9)]
    assert runs[0] == runs[1]
    assert runs[0] != sorted(map(tuple, MX.mix(docs, seed=43).collect()))


def test_equal_rows_share_what_is_left(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x")] * 10 + [(2, "a b", "y")], "doc_id long, text string, source string")
    got = MX.mix(docs).collect()
    x = [r.taken for r in got if r.doc_id == 1]
    want = filled({"x": 40, "y": 2}, {"x": 3, "y": 1}, Fraction(3, 2), 2)["x"]
    assert len(x) == 10 and len(set(x)) == 1 and want - 10 < sum(x) <= want


def test_mixed_texts_hold_what_is_taken(spark):
    docs, rows = corpus(spark, random.Random(7))
    docs = docs.withColumns({"size": F.lit("mine"), "key": F.lit(1), "n": F.lit(2.5), "taken": F.lit("x")})
    mixed = MX.mixed_texts(docs)
    assert mixed.columns[:1] == ["doc_id"] and set(mixed.columns) == set(docs.columns)
    words: Counter = Counter()
    for r in mixed.collect():
        assert (r.source, r["size"], r.key, r.n, r.taken) == (rows[r.doc_id][2], "mine", 1, 2.5, "x")
        assert r.text == rows[r.doc_id][1] or rows[r.doc_id][1].split()[: len(r.text.split())] == r.text.split()
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == {r.doc_id: r.taken for r in MX.mix(docs).collect() if r.taken}


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    got = MX.mix(docs.withColumns({"size": F.lit("x"), "h": F.lit("x"), "cut": F.lit(1)})).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r.doc_id == 6} == {12000} and {r["size"] for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert MX.mix(docs.limit(0)).isEmpty() and MX.mixed_texts(docs.limit(0)).isEmpty()
    silent = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in MX.mix(silent).collect()] == [(0.0, 0)] * 2


def test_no_python_and_no_window_over_a_source(spark):
    docs, _ = corpus(spark, random.Random(8))
    plan = MX.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Window" not in plan
