from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.fixtures import awkward_docs, components_of, edit_distance_inside, prose, shared_shingles
from tests.llm.test_texts import checked
from txnrisk.llm import decontaminate as DC
from txnrisk.llm import language_id as LI
from txnrisk.llm import queries as Q
from txnrisk.llm import toxicity as TX

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_toxicity_on_rows_it_has_not_seen(spark):
    larger = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    got = Q.op8_toxicity(spark, larger)
    assert got.count() == spark.read.parquet(f"{larger}/documents.parquet").count()
    rated = got.join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    right = sum(r.predicted == r.toxic for r in rated)
    assert right / len(rated) > 0.95
    toxic, clean = ([r.score for r in rated if r.toxic == y] for y in (1, 0))
    assert sum(a > b for a in toxic for b in clean) / (len(toxic) * len(clean)) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rated)


def test_language_on_rows_it_has_not_seen(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Q.op4_language_id(spark, SF)
    assert got.count() == docs.count()
    held = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert held.where("lang = lang_pred").count() / held.count() > 0.97
    assert held.where("score < 0 or score > 1").isEmpty()


def test_prediction_reads_the_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = LI.train(docs)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "doc_id": F.col("doc_id") + 10_000})
    a, b = (LI.language_id(d, model).select((F.col("doc_id") % 10_000).alias("i"), "lang_pred", "score") for d in (docs, other))
    assert a.exceptAll(b).isEmpty()


def test_model_edges(spark):
    docs = awkward_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    for chosen in (labels, labels.limit(0)):
        scored = TX.toxicity(docs, TX.train(docs, chosen)).collect()
        assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert TX.toxicity(docs.limit(0), TX.train(docs.limit(0), labels)).count() == 0
    named = LI.language_id(docs, LI.train(docs)).collect()
    assert len(named) == docs.count()
    assert {r.lang_pred for r in named if r.doc_id in (3, 4, 5, 7)} == {"und"}
    nothing = LI.language_id(docs, LI.train(docs.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_temperature_undoes_overconfidence():
    import numpy as np

    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    chance = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    answers = np.array([rng.choice(3, p=p) for p in chance])
    assert LI.temperature(5 * logits, answers) == pytest.approx(5, rel=0.15)


# --- the pipeline -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with toxic ones, copies, leaks and secrets, and the folder they are in."""
    import tempfile

    rng = random.Random(11)
    home = tempfile.mkdtemp(prefix="spark-")
    items = [(i, prose(rng, 16)) for i in range(2)]
    docs, labels = [], []
    for i in range(160):
        text = prose(rng, rng.choice([20, 50]))
        if i % 4 == 0:
            text = f"{text} idiot scum {prose(rng, 5)} worthless moron"
        elif i % 10 == 1:
            text = docs[i - 1][1] if i % 20 == 1 and (i - 1) % 4 else f"{text} {items[i % 2 ^ i // 20 % 2][1].upper()} {prose(rng, 9)}"
        elif i % 10 == 3:
            text = f"{text} token = '{rng.getrandbits(160):040x}' {prose(rng, 4)}"
        elif i % 10 == 7:
            text = docs[i - 1][1]
        docs.append((i, text, "en", "s", len(text)))
        if i % 3:
            labels.append((i, int(i % 4 == 0 or bool(re.search("idiot", text)))))
    docs += [(300, None, None, None, None), (301, "", "en", "s", 0)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return home, docs, items


def test_stages_against_brute_force(spark, corpus):
    home, docs, items = corpus
    kept = spark.read.parquet(f"{home}/documents.parquet")
    steps = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]

    def after(name, frame):
        out = C.stage(steps[name](spark, frame, home), "test")
        assert out.columns == C.COLUMNS
        return out, {r.doc_id: r for r in out.collect()}

    kept, rows = after("toxicity", kept)
    assert set(rows) == {i for i, t, *_ in docs if "idiot" not in (t or "")}
    names = sorted(rows)
    root = components_of([rows[i].text or "" for i in names], lambda a, b: shared_shingles(a, b) >= 0.8)
    kept, left = after("simhash_near_dedup", kept)
    assert set(left) == {names[r] for r in root} and len(left) < len(rows)
    kept, clean = after("benchmark_decontamination", kept)

    def leaked(text):
        return any(edit_distance_inside(DC.normal(item), DC.normal(text)) <= DC.budget(len(DC.normal(item))) for _, item in items)

    assert set(clean) == {i for i in left if not leaked(left[i].text)} and len(clean) < len(left)
    kept, masked = after("secret_scans", kept)
    assert set(masked) == set(clean)
    for i, r in masked.items():
        text = clean[i].text
        assert r.text == (text and re.sub(r"token = '[0-9a-f]{40}", "[secret]", text)) and r.n_chars == (None if text is None else len(r.text))
    packed = steps["best_fit_packing"](spark, kept, home).collect()
    assert {p.doc_id for p in packed} == set(masked)
    assert checked(packed, 2048) == len(C.run(spark, home).select("sequence_id").distinct().collect())


def test_pipeline_without_documents(spark, corpus, folder):
    home, *_ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{home}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert C.run(spark, folder).count() == 0


def test_stages_bear_awkward_rows(spark, corpus):
    home, *_ = corpus
    docs = awkward_docs(spark)
    for _, step in C.STAGES[:-1]:
        docs = C.stage(step(spark, docs, home), "test")
    assert C.STAGES[-1][1](spark, docs, home).count() >= docs.count()


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{i}" for i in range(1, 14)]
