from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnrisk import schemas as S
from txnrisk.operators import retrieval as R
from txnrisk.plans import dashboards as D
from txnrisk.plans import goldsql as GS


def metrics(spark):
    rows = [
        (date(2026, 3, 1), "5411", "ecommerce", 10, 3, 2, 1, 100.0, 20.0, 10.0, 9, 4, 10.0, 90.0, 20.0),
        (date(2026, 3, 1), "7995", "recurring", 30, 5, 2, 3, 300.0, 90.0, 10.0, 30, 2, 10.0, 100.0, 30.0),
        (date(2026, 3, 2), "5411", "ecommerce", 60, 9, 2, 0, 600.0, 0.0, 10.0, 60, 0, 0.0, 100.0, 0.0),
    ]
    return spark.createDataFrame(rows, S.DAILY_METRICS)


@pytest.fixture
def desk(spark, folder):
    metrics(spark).write.parquet(f"{folder}/m")
    return GS.GoldDesk(spark, {"fraud_metrics_daily": f"{folder}/m"}, "analyst", cap=2)


def test_desk_answers_and_caps(desk):
    assert desk.ask("SELECT * FROM fraud_metrics_daily").count() == 2
    top = desk.ask("WITH t AS (SELECT mcc, sum(transaction_count) n FROM fraud_metrics_daily GROUP BY mcc) SELECT mcc FROM t ORDER BY n DESC")
    assert [r["mcc"] for r in top.collect()] == ["5411", "7995"]
    assert desk.ask("SELECT mcc FROM fraud_metrics_daily UNION ALL SELECT channel FROM fraud_metrics_daily; ").count() == 2
    assert desk.ask("SELECT mcc FROM fraud_metrics_daily -- LIMIT 9").count() == 2


def test_desk_says_whether_rows_were_cut_and_in_what_order(desk):
    """The cap of the desk is 2."""
    cut = desk.answer("SELECT explode(sequence(1, 9)) AS n ORDER BY n DESC").collect()
    assert [tuple(r) for r in cut] == [(9, 1, True), (8, 2, True)]
    full = desk.answer("SELECT explode(sequence(1, 2)) AS n ORDER BY n DESC").collect()
    assert [tuple(r) for r in full] == [(2, 1, False), (1, 2, False)]
    assert desk.answer("SELECT mcc FROM fraud_metrics_daily WHERE mcc = 'none'").isEmpty()
    with pytest.raises(ValueError, match="truncated"):
        desk.answer("SELECT 1 AS truncated")


@pytest.mark.parametrize(
    "attack",
    [
        "DROP TABLE fraud_metrics_daily",
        "SELECT 1; SELECT 2",
        "SELECT 1) ; DROP VIEW fraud_metrics_daily ; SELECT * FROM (SELECT 1",
        "INSERT INTO fraud_metrics_daily SELECT * FROM fraud_metrics_daily",
        "SELECT * FROM outside",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
        "SELECT distinct_customer_count FROM fraud_metrics_daily",
        "SELECT total_fraud_signals FROM fraud_metrics_daily",
    ],
)
def test_desk_refuses(spark, desk, attack):
    spark.range(1).createOrReplaceTempView("outside")
    with pytest.raises(Exception):  # noqa: B017
        desk.ask(attack).collect()


def test_hidden_columns_survive_select_star_and_listing(desk):
    assert "total_fraud_signals" not in desk.ask("SELECT * FROM fraud_metrics_daily").columns
    assert "distinct_customer_count" not in desk.listing() and "fraud_rate_pct double" in desk.listing()
    with pytest.raises(ValueError):
        GS.GoldDesk(desk.session, {"bronze": "/x"})


def test_ops(spark):
    m = metrics(spark)
    assert tuple(D.ops_tiles(m).first()) == (100, 4, 4.0, 110.0, 2)
    assert tuple(D.ops_tiles(m.limit(0)).first()) == (0, 0, None, 0.0, 0)
    assert [r["fraud_rate_pct"] for r in D.daily(m).collect()] == [10.0, 0.0]
    assert [r["channel"] for r in D.by_channel(m).collect()] == ["recurring", "ecommerce"]
    assert [r["mcc"] for r in D.costliest_categories(m, 1).collect()] == ["7995"]


def test_model_views(spark):
    ddl = "model_name string, model_run_id string, trained_at string, training_rows long, holdout_roc_auc double, holdout_precision double, holdout_recall double, holdout_f1 double, feedback_labels_confirmed long, feedback_labels_changed long"
    rows = [(m, r, r, 100, auc, 0.5, 0.5, 0.5, 3, c) for r, c in (("r1", 0), ("r2", 2)) for m, auc in (("svm", 0.7), ("ensemble", 0.9))]
    mm = spark.createDataFrame(rows, ddl)
    assert [r["model"] for r in D.leaderboard(mm).collect()] == ["ensemble", "svm"]
    assert [tuple(p) for p in D.auc_trend(mm).where("model = 'svm'").first()["trend"]] == [("r1", 0.7), ("r2", 0.7)]
    assert [tuple(r) for r in D.feedback_per_run(mm).collect()] == [("r1", 100, 3, 0), ("r2", 100, 3, 2)]
    assert D.leaderboard(mm.limit(0)).count() == 0


def test_business_tiles(spark):
    row = (date(2026, 3, 1), 5, 1360.0, 3, 1300.0, 3, 2, 1100.0, 1, 200.0, 1, 50.0, 66.67, 84.62, 66.67)
    assert tuple(D.business_tiles(spark.createDataFrame([row], S.VALUE)).first()) == (1100.0, 200.0, 84.62, 66.67, 66.67, 1)
    assert tuple(D.business_tiles(spark.createDataFrame([], S.VALUE)).first()) == (0.0, 0.0, None, None, None, 0)


def test_chunks_overlap_and_cover(spark):
    df = spark.createDataFrame([(n, " ".join(str(i) for i in range(n))) for n in (0, 1, 300, 301, 900)], "n int, text string")
    out = R.chunk(df).collect()
    sizes = {n: [r["n_tokens"] for r in sorted(out, key=lambda r: r["chunk_no"]) if r["n"] == n] for n in (0, 1, 300, 301, 900)}
    assert sizes == {0: [], 1: [1], 300: [300], 301: [300, 61], 900: [300, 300, 300, 180]}
    words = [r["chunk"].split() for r in sorted(out, key=lambda r: r["chunk_no"]) if r["n"] == 900]
    assert words[1][0] == "240" and words[-1][-1] == "899"


def test_top_k_in_blocks_of_any_size(spark):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(-5, 6)], "item_id int, vector array<double>")
    queries = spark.createDataFrame([(f"q{j}", [float(j), 1.0]) for j in range(4)], "query_id string, vector array<double>")
    once = R.top_k_cosine(queries, corpus, 3)
    best = {r["query_id"]: r["item_id"] for r in once.where("rank = 1").collect()}
    assert best == {f"q{j}": j for j in range(4)} and once.count() == 12
    assert R.top_k_cosine(queries, corpus, 3, block=2).exceptAll(once).count() == 0
    cited = R.citations(once.withColumn("document", F.lit("p.md")), "document").where("query_id = 'q1' AND rank = 1").first()
    assert cited["citation"] == "[1] source: p.md (relevance 1.0)"


def test_blocked_products_against_every_pair(spark):
    """Many equal vectors, zeros, missing and short ones; names as ids."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (90, 4)).astype(float).tolist()
    rows = [(f"i{i:02d}", v) for i, v in enumerate(vectors)] + [("zero", [0.0] * 4), ("none", None), ("short", [1.0]), ("gap", [1.0, None, 0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "item_id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, len(rows), 3)], "query_id int, vector array<double>")

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in [*a, *b] or not any(a) or not any(b):
            return None
        dot = sum(x * y for x, y in zip(a, b, strict=True))
        return dot / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    want = set()
    for q in range(0, len(rows), 3):
        found = sorted(((cosine(rows[q][1], v), i) for i, v in rows), key=lambda f: (-3 if f[0] is None else -f[0] - 10, f[1]))
        want |= {(q, rank, i, None if s is None else round(s + 1e-12, 4)) for rank, (s, i) in enumerate(found[:5], 1)}
    for block in (1, 7, 512):
        assert {tuple(r) for r in R.top_k_cosine(asked, corpus, block=block).collect()} == want
    assert R.top_k_cosine(asked.limit(0), corpus).isEmpty() and R.top_k_cosine(asked, corpus.limit(0)).isEmpty()
