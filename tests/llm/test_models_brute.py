"""The two trained classifiers against slow versions in dictionaries and loops, from the text to the score."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import prose
from txnrisk.llm import language_id as LI
from txnrisk.llm import toxicity as TX

SMALL = "/root/testdata/sf0.001"


def slow_grams(text: str | None, orders, bits: int) -> list[int]:
    """One n-gram at a time, its characters taken in one by one."""
    if not text:
        return []
    points = [32 if chr(min(ord(c), 0x3000)).isspace() else ord(c) for c in f" {text.lower()} "]
    out = []
    for n in orders:
        for i in range(len(points) - n + 1):
            value = 0
            for p in points[i : i + n]:
                value = (value * 0x9E3779B97F4A7C15 + p) % 2**64
            out.append((value + n) * 0xD6E8FEB86659FD93 % 2**64 >> (64 - bits))
    return out


def keyed(spark, ids, as_text: bool) -> dict:
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    key = F.xxhash64(F.col("id").cast("string") if as_text else F.col("id"))
    return {r.id: r.key for r in frame.select("id", key.alias("key")).collect()}


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def softmax(values: list[float]) -> list[float]:
    top = max(values)
    e = [math.exp(v - top) for v in values]
    return [v / sum(e) for v in e]


def least(f, low: float, high: float) -> float:
    """Where a convex function is least, by thirds."""
    for _ in range(70):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if f(a) < f(b) else (a, high)
    return (low + high) / 2


def slow_language(rows: list, keys: dict, s: LI.Settings):
    """(language, score) of a text, from the (id, text, lang) rows it may learn from."""
    grams = {i: Counter(slow_grams(t, s.orders, s.bits)) for i, t, _ in rows}
    texts_with = Counter(g for found in grams.values() for g in found)
    idf = {g: math.log((1 + len(rows)) / (1 + n)) for g, n in texts_with.items()}
    languages = sorted({lang for _, _, lang in rows})
    every = sorted((keys[i], lang, i) for i, _, lang in rows)
    vectors = []
    for _, _, i in every:
        total = max(1, sum(grams[i].values()))
        vectors.append({g: s.scale * idf[g] * n / total for g, n in grams[i].items()} | {"bias": 1.0})
    answers = [languages.index(lang) for _, lang, _ in every]
    order = [int(x) for x in np.random.default_rng(7).permutation(len(every))]
    apart = order[:: s.calibration]
    taught = sorted(set(order) - set(apart))
    z, n = defaultdict(float), defaultdict(float)

    def weight(at, k: int) -> float:
        if abs(z[at, k]) <= s.l1:
            return 0.0
        return -math.copysign(abs(z[at, k]) - s.l1, z[at, k]) / ((s.beta + math.sqrt(n[at, k])) / s.alpha + s.l2)

    def logits(x: dict) -> list[float]:
        return [sum(v * weight(at, k) for at, v in x.items()) for k in range(len(languages))]

    for epoch in range(s.epochs):
        for i in np.random.default_rng(epoch).permutation(taught):
            x = vectors[i]
            chance = softmax(logits(x))
            for k in range(len(languages)):
                error = chance[k] - (k == answers[i])
                for at, v in x.items():
                    g, w = v * error, weight(at, k)
                    z[at, k] += g - (math.sqrt(n[at, k] + g * g) - math.sqrt(n[at, k])) / s.alpha * w
                    n[at, k] += g * g
    held = [(logits(vectors[i]), answers[i]) for i in apart]
    loss = lambda t: -sum(math.log(max(softmax([v / math.exp(t) for v in x])[a], 1e-300)) for x, a in held)
    warmth = math.exp(least(loss, math.log(0.05), math.log(20)))

    def predict(text):
        if not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        found = slow_grams(text, s.orders, s.bits)
        x = Counter(found)
        x = {g: s.scale * idf.get(g, 0.0) * c / len(found) for g, c in x.items()} | {"bias": 1.0}
        chance = softmax([v / warmth for v in logits(x)])
        best = max(range(len(languages)), key=lambda k: (chance[k], -k))
        return languages[best], chance[best]

    return predict


def test_language_id_against_dictionaries(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 1200")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    given = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    learnt = [r for r in given if r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(learnt) > 30 and len({lang for *_, lang in learnt}) > 1
    predict = slow_language(learnt, keyed(spark, [i for i, *_ in given], True), LI.Settings())
    got = {r.doc_id: r for r in LI.language_id(docs, LI.train(docs)).collect()}
    for i, text, _ in given:
        lang, score = predict(text)
        assert got[i].score == pytest.approx(score, abs=2e-4)
        assert got[i].lang_pred == lang


def slow_toxicity(rows: list, prior: float, s: TX.Settings):
    """Score of a text, from the (text, toxic) rows in the order they are learnt."""
    texts = [set(slow_grams(t, s.orders, s.bits)) for t, _ in rows]
    toxic = [y for _, y in rows]

    def learn(at: list[int]):
        count = {y: Counter(g for i in at if toxic[i] == y for g in texts[i]) for y in (0, 1)}
        of = {y: sum(toxic[i] == y for i in at) for y in (0, 1)}
        share = lambda g, y: (count[y][g] + s.smoothing) / (of[y] + 2 * s.smoothing)
        ratio = {}
        for g in count[0] | count[1]:
            r = math.log(share(g, 1) / share(g, 0))
            if count[0][g] + count[1][g] >= s.least_texts and abs(r) >= s.least_ratio:
                ratio[g] = r
        w, squares, bias, bias_squares = defaultdict(float), defaultdict(lambda: 1e-8), 0.0, 1e-8
        rng = np.random.default_rng(7)
        for _ in range(s.epochs):
            for j in rng.permutation(len(at)):
                i = at[j]
                x = unit(texts[i], ratio)
                error = sigmoid(sum(w[g] * v for g, v in x.items()) + bias) - toxic[i]
                error *= 0.5 * len(at) / of[toxic[i]]
                for g, v in x.items():
                    step = error * v + s.shrink * w[g]
                    squares[g] += step**2
                    w[g] -= s.rate * step / math.sqrt(squares[g])
                bias_squares += error**2
                bias -= s.rate * error / math.sqrt(bias_squares)
        return lambda found: sum(w[g] * v for g, v in unit(found, ratio).items()) + bias

    def unit(found: set, ratio: dict) -> dict:
        x = {g: ratio[g] for g in found if g in ratio}
        length = math.sqrt(sum(v * v for v in x.values())) or 1.0
        return {g: v / length for g, v in x.items()}

    margin = [0.0] * len(rows)
    for k in range(s.folds):
        judge = learn([i for i in range(len(rows)) if i % s.folds != k])
        for i in range(k, len(rows), s.folds):
            margin[i] = judge(texts[i])
    share = sum(toxic) / len(rows)
    weight = [prior / share if y else (1 - prior) / (1 - share) for y in toxic]

    def loss(slope: float, shift: float) -> float:
        fit = sum(c * math.log1p(math.exp((slope * m + shift) * (-1 if y else 1))) for c, m, y in zip(weight, margin, toxic, strict=True))
        return fit + 5e-4 * ((slope - 1) ** 2 + shift**2)

    shift_of = lambda slope: least(lambda b: loss(slope, b), -30, 30)
    slope = least(lambda a: loss(a, shift_of(a)), -5, 30)
    judge, shift = learn(list(range(len(rows)))), shift_of(slope)
    return lambda text: sigmoid(slope * judge(set(slow_grams(text, s.orders, s.bits))) + shift)


def test_toxicity_against_dictionaries(spark):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        toxic, words = int(i % 4 == 0), prose(rng, 12).split()
        bad = "zorgat" if toxic and rng.random() < 0.9 or rng.random() < 0.05 else "wuxile"
        rows.append((i, " ".join([*words[:6], bad, *words[6:]]), toxic))
    rows.append((90, "", 0))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(91, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    keys = keyed(spark, [r[0] for r in rows], False)
    usable = sorted((keys[i], y, t) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 != 0)
    score = slow_toxicity([(t, y) for _, y, t in usable], sum(y for _, y, _ in usable) / len(usable), TX.Settings())
    got = {r.doc_id: r.score for r in TX.toxicity(docs, TX.train(docs, labels)).collect()}
    assert len({round(v, 3) for v in got.values()}) > 10  # the model tells texts apart
    for i, text, _ in [*rows, (91, None, 0)]:
        assert got[i] == pytest.approx(score(text), abs=1e-3)
