from __future__ import annotations

import fnmatch
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import awkward_docs, prose
from txnrisk.llm import queries as Q
from txnrisk.llm import secret_scan as SS
from txnrisk.llm import sharding as SD
from txnrisk.llm import url_filter as UF

SF = "/root/testdata/sf0.001"


# --- URL filter -------------------------------------------------------------------------------


def test_globs_against_fnmatch():
    rng = random.Random(1)
    globs = ["".join(rng.choice("ab*?.") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["*" + "ab" * 60 + "*"]
    texts = ["".join(rng.choice("abc.") for _ in range(rng.randint(0, 14))) for _ in range(200)] + ["ab" * 70, ""]
    found = UF.Automaton(globs).matches(texts)
    for i, text in enumerate(texts):
        for j, glob in enumerate(globs):
            assert found[i, j] == fnmatch.fnmatchcase(text, glob), (text, glob)


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = host.translate({c: c + 32 for c in range(65, 91)})
    best = None
    for rule in UF.RULES:
        h, _, p = rule.rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule.rule) > len(best.rule)):
            best = rule
    return host, path, best and best.rule, best and best.verdict


URLS = [
    None, "", "no scheme/net/", "http://NET/", "http://net", "http://a.net?x=/", "https://x.example.net/en/1#t", "https://example.net/en/",
    "http://fooexample.net/en/1", "http://example.com/de/x", "http://a.org/fr/", "http://a.org/en/http://b.net/", "http://a#b.net/",
    "ftp://Ü.Example.COM/de/é?q", "http://x/" + "y" * 5000, "x://://a.net/", "http://a.net/\nb", "http://spam-farm.example.org/en/1",
]


def test_url_rules_and_edges(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*URLS, *URLS, None])], "page_id long, url string, html string, rule string")
    got = UF.url_filter(pages).collect()
    assert len(got) == 2 * len(URLS) + 1
    for row in got:
        url = [*URLS, *URLS, None][row.page_id]
        host, path, rule, verdict = judged(url)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (verdict or ("block" if "spam-" in host else "allow"))
        assert (row.glob is not None) == ("spam-" in host)
    assert UF.url_filter(pages.limit(0)).count() == 0


# --- secrets ----------------------------------------------------------------------------------


def base_spans(text):
    out = []
    for m in re.finditer(SS.ASSIGN, text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= 20:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if m.end() - m.start() >= 24:
            out.append((m.start(), 2, "hex", m.end()))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out)]


def entropy(s, window):
    best = 0.0
    for i in range(len(s) - window + 1):
        part = s[i : i + window]
        best = max(best, -sum(part.count(c) / window * math.log2(part.count(c) / window) for c in set(part)))
    return best


def test_base_spans_against_re(spark):
    rng = random.Random(2)
    bits = ["token=", "Secret: ", "api_key='", "apikey = ", "AKIA", "passwd:", "PASSWORD = \"", "é😀", " ", "abc123", "0123456789abcdef", "ZZ9", "x", "=", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", None, "a" * 30000 + "0" * 24 + "g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = SS.secret_scan(docs).select("doc_id", SS.spans_text(F.col("base_spans")).alias("b"), SS.spans_text(F.col("all_spans")).alias("a"))
    for row in scanned.collect():
        expected = base_spans(texts[row.doc_id] or "")
        assert row.b == ",".join(expected)
        assert set(expected) <= set(filter(None, row.a.split(",")))


def test_entropy_window_and_allow_list(spark):
    rng = random.Random(3)
    strings = ["".join(rng.choice("abcdefgh01234567XYZ+/") for _ in range(n)) for n in (20, 21, 40, 99) for _ in range(5)] + ["a" * 25]
    frame = spark.createDataFrame([(s,) for s in strings], "s string").select("s", SS.window_entropy(F.col("s")).alias("e"))
    for row in frame.collect():
        assert row.e == pytest.approx(entropy(row.s, SS.WINDOW), abs=1e-9)
    key = "Zk9xQ2vLp7Rt4WmB8nYs"
    texts = {
        f"see {key} there": [f"entropy:4:{4 + len(key)}"],
        "123e4567-e89b-12d3-a456-426614174000": [],  # a UUID
        "EXAMPLE" + key: [],
        "thisisoneverylongwordwithoutadigit": [],
        "12345678901234567890123": [],
        f"token={key}": [f"assign:0:{6 + len(key)}"],  # no second span on top of a base one
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in SS.secret_scan(docs).select("text", SS.spans_text(F.col("all_spans")).alias("s")).collect():
        assert row.s.split(",") == (texts[row.text] or [""]), row.text


def test_secret_edges_and_masking(spark):
    docs = awkward_docs(spark).withColumn("base_spans", F.lit("clash"))
    scanned = SS.secret_scan(docs)
    assert scanned.count() == docs.count() and SS.secret_scan(docs.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in SS.redact(scanned).collect()}
    assert texts[9] == '[secret]" \x1c [secret]' and texts[3] is None and texts[4] == ""
    assert texts[1].startswith("The quick")


def test_secret_query(spark):
    rows = Q.op3_secret_scan(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for row in rows:
        assert row.base_sha256 == hashlib.sha256(",".join(base_spans(texts[row.doc_id])).encode()).hexdigest()


# --- shards -----------------------------------------------------------------------------------


def split(rows, limit, prefix=""):
    """(h, bytes) rows to the shard of each, bit by bit."""
    if len(rows) <= 1 or sum(b for _, b in rows) <= limit:
        return dict.fromkeys((h for h, _ in rows), prefix)
    out = {}
    for bit in "01":
        out |= split([r for r in rows if format(r[0], "060b")[len(prefix)] == bit], limit, prefix + bit)
    return out


@pytest.mark.parametrize("depth", [3, 12])
def test_shards_against_splitting_by_hand(spark, depth):
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.choice([0, 3, 20, 300]))) for i in range(400)]
    hashes = {i: int(hashlib.md5(f"={i}\x1f={t}".encode()).hexdigest()[:15], 16) for i, t in docs}
    expected = split([(hashes[i], len(t)) for i, t in docs], 4000)
    got = SD.sharded(spark.createDataFrame(docs, "doc_id long, text string"), limit=4000, depth=depth).collect()
    assert {r.doc_id: r.shard for r in got} == {i: expected[h] for i, h in hashes.items()}


def test_equal_rows_and_edges_in_shards(spark):
    docs = awkward_docs(spark).select("doc_id", "text", "id", "score").unionByName(
        spark.createDataFrame([(None, "x" * 50, 1, 0.0)] * 100, "doc_id long, text string, id int, score double")
    )
    got = SD.sharded(docs, limit=300)
    assert got.count() == docs.count() and SD.sharded(docs.limit(0)).count() == 0
    shards = got.groupBy("shard", "shard_bytes", "shard_docs", "oversized").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    for s in shards:
        assert s.b == s.shard_bytes and s.n == s.shard_docs and (s.b <= 300 or s.oversized and s.n == 1)


def test_shards_on_disk(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(20))
    SD.write_shards(docs, f"{folder}/shards", limit=60_000)
    back = spark.read.parquet(f"{folder}/shards")
    assert back.drop("shard").exceptAll(docs).isEmpty() and back.count() == docs.count()
    worst = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).where("b > 60000 and n > 1")
    assert worst.isEmpty()
