from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.fixtures import awkward_docs, components_of, prose, shared_shingles
from txnrisk.llm import alike as AL
from txnrisk.llm import simhash as SH


@pytest.mark.parametrize("hot", [2000, 5])
def test_block_edits_against_exact_overlap(spark, hot, monkeypatch):
    """Cut, appended, replaced and scattered edits about the limit, on texts of 9 words and more."""
    monkeypatch.setattr(SH, "HOT", hot)
    rng = random.Random(23)
    texts = []
    for _ in range(90):
        words = prose(rng, rng.choice([9, 14, 60, 300])).split()
        part = max(1, round(len(words) * rng.uniform(0.08, 0.22)))
        half = max(1, part // 2)
        scattered = list(words)
        for _ in range(max(1, len(words) // rng.randint(30, 70))):
            scattered[rng.randrange(len(words))] = "zz"
        edited = rng.choice([words[:-part], words[part:], words + prose(rng, part).split(), words[:-half] + prose(rng, half).split(), scattered])
        texts += [" ".join(words), " ".join(edited)]
    base = prose(rng, 200).split()
    for _ in range(80):  # a chain of near copies, not all of them alike
        copy = list(base)
        for _ in range(rng.choice([0, 1, 3, 5])):
            copy[rng.randrange(len(copy))] = "yy" + str(rng.randrange(99))
        texts.append(" ".join(copy))
    share = {(i, j): shared_shingles(texts[i], texts[j]) for i in range(len(texts)) for j in range(i)}
    assert sum(0.7 < s < 0.8 for s in share.values()) > 20 and sum(0.8 <= s < 0.9 for s in share.values()) > 20
    root = components_of(list(range(len(texts))), lambda i, j: share[max(i, j), min(i, j)] >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in AL.one_of_each(docs).collect()}
    assert not set(root) - got  # nothing goes without a text that shares 0.8 of its shingles
    assert len(got - set(root)) <= 1


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    kept = AL.one_of_each(docs).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 3, 6, 7, 8, 9]
    assert kept[0].asDict().keys() == set(docs.columns) and AL.one_of_each(docs.limit(0)).count() == 0


def test_ids_may_be_texts(spark):
    rows = [("b", "one two three four five six"), ("a", "One two three four five six"), (None, "one two three four five six"), ("c", "other")]
    kept = AL.one_of_each(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(r.doc_id for r in kept) == ["a", "c"]


def test_two_texts_at_the_limit_share_a_bucket():
    rng = random.Random(4)
    met = []
    for _ in range(400):
        both = [rng.getrandbits(64) for _ in range(80)]
        a, b = (np.array([*both, *[rng.getrandbits(64) for _ in range(10)]], dtype=np.uint64) for _ in range(2))
        met.append(bool((AL.bands(a) == AL.bands(b)).any()))
        assert not (AL.bands(a) == AL.bands(a + np.uint64(1))).any()
    assert sum(met) >= 396  # at 0.8
    assert len(AL.bands(np.zeros(0, dtype=np.uint64))) == 0


def test_a_round_makes_a_row_per_member(spark, monkeypatch):
    """A group of near copies is never paired off: pairs of a round are fewer than rows in buckets."""
    rng = random.Random(5)
    base = prose(rng, 200).split()
    texts = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(200)] = f"new{i}"
        texts.append(" ".join(copy))
    seen, judge = [], AL.verified
    monkeypatch.setattr(AL, "verified", lambda pairs, sets: seen.append(pairs.count()) or judge(pairs, sets))
    AL.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(seen) < 120 * AL.BANDS


@pytest.mark.parametrize("crowded", [False, True])
def test_what_rounds_leave_is_joined_exactly(spark, crowded):
    """One bucket of texts that are all unlike but for three late pairs: no round finds them before it idles."""
    rng = random.Random(6)
    texts = [prose(rng, 60) + f" only{i}" for i in range(300)]
    texts += [texts[i] + " one more" for i in (7, 77, 177)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = AL.prints(docs, ["doc_id"], "text").localCheckpoint()
    met = marked.selectExpr("1L AS bucket", "node", "n", "303L AS weight", f"{crowded} AS crowded")
    sets = AL.shingles(docs, marked.select("doc_id", "node"), ["doc_id"], "text")
    group = {r.node: r.root for r in AL.roots(met, sets).collect()}
    ids = {bytes(r.node): r.doc_id for r in marked.collect()}
    found = {}
    for node, root in group.items():
        found.setdefault(bytes(root), set()).add(ids[bytes(node)])
    assert sorted(map(sorted, found.values())) == [[7, 300], [77, 301], [177, 302]]


def crowd_of_copies(rng: random.Random, count: int) -> list[str]:
    """Copies of one text with edits of their own, any two of which share less than 0.8 of their shingles; every tenth once more, told twice."""
    base = prose(rng, 150).split()
    texts = []
    for i in range(count):
        copy = list(base)
        for j, at in enumerate(rng.sample(range(5, 145), 3)):
            copy[at] = f"new{i}x{j}"
        texts.append(" ".join(copy))
    return texts + [f"{t} told twice" for t in texts[::10]]


@pytest.mark.parametrize("block", [(512, 1 << 18), (8, 1 << 18), (512, 1 << 11)])
def test_crowds_are_compared_whole(spark, block, monkeypatch):
    """With any size of blocks the groups are those of all pairs, those in the largest group among them."""
    monkeypatch.setattr(AL, "CROWD", 10)
    monkeypatch.setattr(AL, "BLOCK", block)
    rng = random.Random(8)
    texts = crowd_of_copies(rng, 60)
    for _ in range(40):  # near the limit on either side, of different lengths
        words = rng.choice(texts).split()
        at = rng.randrange(len(words) - 30)
        texts.append(" ".join(words[: at + rng.randrange(20)] + words[at + rng.randrange(20) :] + prose(rng, rng.randint(1, 12)).split()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = AL.prints(docs, ["doc_id"], "text").localCheckpoint()
    sets = AL.shingles(docs, marked.select("doc_id", "node"), ["doc_id"], "text")
    ids = {bytes(r.node): r.doc_id for r in marked.collect()}
    share = {(i, j): shared_shingles(texts[i], texts[j]) for i in range(len(texts)) for j in range(i)}
    root = components_of(list(range(len(texts))), lambda i, j: share[max(i, j), min(i, j)] >= 0.8)
    crowded = marked.selectExpr("1L AS bucket", "node", "n", "303L AS weight", "true AS crowded")
    got = {ids[bytes(r.node)]: ids[bytes(r.root)] for r in AL.roots(crowded, sets).collect()}
    def groups(of: dict[int, int]) -> list[list[int]]:
        members = [sorted(i for i in of if of[i] == r) for r in set(of.values())]
        return sorted(m for m in members if len(m) > 1)

    assert groups(got) == groups(dict(enumerate(root))) and len(groups(got)) > 5


def rows_of_joins(spark, work) -> int:
    """The most rows that a join made while ``work`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    work()
    most = 0
    for at in range(before, store.executionsCount()):
        run = store.executionsList().apply(at).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            for m in range(node.metrics().size()) if "Join" in node.name() else ():
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def test_no_join_pairs_off_a_crowd(spark):
    """Twice the copies that are not alike: rows of the largest join grow with them, not with their pairs."""
    most = []
    for count in (200, 400):
        docs = spark.createDataFrame(list(enumerate(crowd_of_copies(random.Random(9), count))), "doc_id long, text string")
        marked = AL.prints(docs, ["doc_id"], "text").localCheckpoint()
        sets = AL.shingles(docs, marked.select("doc_id", "node"), ["doc_id"], "text")
        crowded = marked.selectExpr("1L AS bucket", "node", "n", "303L AS weight", "true AS crowded")
        most.append(rows_of_joins(spark, lambda c=crowded, s=sets: AL.roots(c, s).count()))
    assert 0 < most[1] < 3 * most[0]
