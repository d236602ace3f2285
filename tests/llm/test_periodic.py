from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import awkward_docs, prose
from txnrisk.llm import periodic as PR
from txnrisk.llm import queries as Q


def by_definition(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    """Every stretch that cannot be made longer, kept if no smaller period fits it."""
    found = set()
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            first = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            stretch = w[first - q : i]
            if len(stretch) >= max(least, 2 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                found.add((first - q, len(stretch), q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w: list, runs: list) -> list:
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def awkward_words(rng: random.Random) -> list:
    letters = rng.choice([1, 2, 2, 3, 5])
    w = [rng.randint(1, letters) for _ in range(rng.randint(0, 90))]
    if rng.random() < 0.6:
        part = [rng.randint(1, letters) for _ in range(rng.randint(1, 12))]
        w = w[: len(w) // 3] + part * rng.randint(1, 6) + w[len(w) // 2 :] + part[: rng.randint(0, 5)] + part * 2
    return w


@pytest.mark.parametrize("least", [4, 12])
def test_runs_against_the_definition(least):
    rng = random.Random(least)
    for _ in range(600):
        w = awkward_words(rng)
        r = PR.runs(np.array(w, dtype=np.int64), least)
        assert list(zip(r.start.tolist(), r.length.tolist(), r.period.tolist(), strict=True)) == by_definition(w, least)


def test_very_repetitive_texts_take_no_quadratic_time():
    rng = random.Random(3)
    n = 200_000
    zones = [w for i in range(500) for w in [1] * rng.randint(1, 800) + [i + 5]]
    a, fibonacci = [1], [1, 2]
    while len(fibonacci) < n:
        a, fibonacci = fibonacci, fibonacci + a
    start = time.process_time()
    for w in ([1] * n, [1] * n + [2] + [1] * n, [1, 1, 1, 1, 1, 1, 1, 2] * (n // 8), zones, fibonacci):
        PR.runs(np.array(w, dtype=np.int64))
    assert time.process_time() - start < 90
    assert PR.runs(np.array([1] * n)).length.tolist() == [n]


@pytest.mark.parametrize("batch", [1, 50, 1 << 18])
def test_table_against_the_definition(spark, batch, monkeypatch):
    monkeypatch.setattr(PR, "BATCH_WORDS", batch)
    rng = random.Random(9)
    texts = {i: " ".join(f"w{x}" for x in awkward_words(rng)) for i in range(120)}
    texts |= {200: None, 201: "", 202: " \t\n ", 203: "a\x0ba\x0c" * 10, 204: "a\x1ca " * 12, 205: "é 😀 " * 7, 206: prose(rng, 400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    for r in PR.periodic_runs(docs, ["doc_id"]).collect():
        words = [w.decode() for w in (texts[r.doc_id] or "").encode().split()]
        want = by_definition(words)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(words)
        assert r.collapsed == " ".join(collapsed(words, want))


def test_query_plants_and_digests(spark, folder):
    from hashlib import sha256
    from zlib import crc32

    rng = random.Random(10)
    rows = [(i, prose(rng, rng.choice([0, 1, 2, 5, 40, 120]))) for i in range(150)] + [(None, "a b " * 9), (77, None), (77, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    want, planted = [], 0
    for i, text in rows:
        w, h = (text or "").split(), crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            a, g, planted = h // 10 % len(w), h // 10, planted + 1
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else x for k, x in enumerate(w)]
        runs = by_definition(w)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digests = ["".join(f"{x},{y},{z}\n" for x, y, z in runs), " ".join(collapsed(w, runs))]
        want.append((i, len(runs), s, n, q, n and 1000 * n // q, *[sha256(d.encode()).hexdigest() for d in digests]))
    got = [tuple(r) for r in Q.op13_periodic_runs(spark, folder).collect()]
    assert planted > 8 and sorted(got, key=str) == sorted(want, key=str)


def test_awkward_rows(spark):
    docs = awkward_docs(spark).withColumns({"runs": F.lit(1), "collapsed": F.lit("x"), "n_words": F.lit("y")})
    got = PR.periodic_runs(docs, ["doc_id"]).collect()
    assert len(got) == docs.count()
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got if r.doc_id == 6] == [(12000, [(0, 12000, 3)], "lorem ipsum dolor")]
    assert all((r.n_words, r.runs, r.collapsed) == (0, [], "") for r in got if r.doc_id in (3, 4, 5))
    assert PR.periodic_runs(docs.limit(0), ["doc_id"]).isEmpty()
    keyed = PR.periodic_runs(docs.select(F.col("doc_id").cast("string").alias("name"), "text"), ["name"])
    assert dict(keyed.dtypes)["name"] == "string" and keyed.count() == docs.count()
