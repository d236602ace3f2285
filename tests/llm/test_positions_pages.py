from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from tests.llm.fixtures import awkward_docs, prose
from txnrisk.llm import fingerprints as FP
from txnrisk.llm import html_extract as HX


def alike(a: str, b: str) -> float:
    return FP.likeness(FP.anchors(a), FP.anchors(b))


def test_order_counts():
    rng = random.Random(12)
    paragraphs = [prose(rng, 60) for _ in range(20)]
    text = "\n".join(paragraphs)
    assert alike(text, text) == 1 and alike(text, "X" + text) > 0.99
    for _ in range(5):
        assert alike(text, "\n".join(rng.sample(paragraphs, 20))) < 0.5
    assert 0.4 < alike(text, FP.edited(text, prose(rng, 2000))) < 0.6
    assert alike(text, "\n".join([*paragraphs[:9], prose(rng, 50), *paragraphs[10:]])) > 0.9
    assert alike(text, prose(rng, 1200)) < 0.1
    assert alike("lorem ipsum dolor " * 4000, "lorem ipsum dolor " * 4000) == 1


def test_a_match_is_a_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(400):
        a, b = (rng.integers(0, rng.choice([3, 30, 300]), rng.integers(0, 30)) for _ in range(2))
        if rng.random() < 0.5:
            b = np.concatenate((b[:4], a[5:20], b[4:]))
        best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        got = FP.aligned(a, b)
        assert got <= best[-1, -1] and got == FP.aligned(b, a) or len(set(a)) < len(a) or len(set(b)) < len(b)
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert got == best[-1, -1]


def test_text_ids_descend(spark):
    names = ["a", "ab", "b", "B", "é", "10", "9"]
    docs = spark.createDataFrame([(n, f"text of {n} " * 9) for n in names] + [(None, "none " * 9)], "doc_id string, text string")
    got = {r.doc_id: r.edited_sha256 for r in FP.fingerprinted(docs).collect()}
    from hashlib import sha256

    order = [*sorted(names, key=lambda n: n.encode(), reverse=True), None]
    texts = [f"text of {n} " * 9 if n else "none " * 9 for n in order]
    for i, n in enumerate(order):
        assert got[n] == sha256(FP.edited(texts[i], texts[(i + 1) % len(order)]).encode()).hexdigest()


def test_hostile_pages_take_linear_time():
    for page in ("<a " * 300_000, "<!" * 300_000, "<a '" * 100_001 + ">", "<script " * 100_000, "x<" * 300_000 + ">"):
        start = time.process_time()
        HX.lines_of(page)
        assert time.process_time() - start < 2
    start = time.process_time()
    found = HX.common_lines([1, *[5] * 20_000, 2], [3, *[5] * 20_000, 4])
    assert len(found) == 20_000 and time.process_time() - start < 2


def test_a_mirror_is_no_partner(spark):
    page = "<div>Site</div><div>Own words</div><div>Foot</div>"
    other = "<div>Site</div><div>Other words</div><div>Foot</div>"
    rows = [(1, "http://h.org/a", page), (2, "http://h.org/a?x=1", page), (3, "http://h.org/b", other)]
    got = {r.page_id: r.text for r in HX.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Own words", 2: "Own words", 3: "Other words"}
    alone = spark.createDataFrame(rows[:2], "page_id long, url string, html string")
    assert {r.text for r in HX.extract(alone).collect()} == {"Site\nOwn words\nFoot"}


def test_null_ids_clashing_columns_and_long_pages(spark):
    long = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    rows = [(None, "http://h.org/a", "<p>x</p>"), (None, None, None), (1, "http://h.org/b", long), (1, "http://h.org/b", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("mine") for c in ("text", "host", "path", "k", "id", "range", "halo", "lines", "zones", "hashes", "n_chars")}
    )
    got = HX.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 1), (1, 149_999), (1, 149_999)]
    comments = '<article><p>t</p><section id="user-comments"><p>c</p></section></article>'
    assert HX.lines_of(comments) == (["t", "c"], [HX.ARTICLE_ZONE, HX.FURNITURE_ZONE])


def test_ranges_do_not_grow_with_the_data(spark):
    from txnrisk.llm import common as C

    keys = spark.range(5000).withColumnRenamed("id", "k")
    assert len(C.Ranges.of(keys, ["k"], 10**6)) <= C.ROUNDS * spark.sparkContext.defaultParallelism
    assert FP.fingerprinted(awkward_docs(spark)).count() == awkward_docs(spark).count()
