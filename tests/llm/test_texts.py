from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import (
    awkward_docs,
    components_of,
    edit_distance_inside,
    prose,
    shared_shingles,
    within,
    word,
)
from txnrisk.llm import alike as AL
from txnrisk.llm import decontaminate as DC
from txnrisk.llm import fingerprints as FP
from txnrisk.llm import html_extract as HX
from txnrisk.llm import packing as PK
from txnrisk.llm import queries as Q
from txnrisk.llm import simhash as SH

SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- decontamination --------------------------------------------------------------------------


def test_myers_against_all_cells():
    rng = random.Random(1)
    for _ in range(150):
        pattern = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        assert DC.Myers(pattern).search(text)[0] == edit_distance_inside(pattern, text)


def damaged(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "q" + text[at + 1 :]])
    return text


@pytest.mark.parametrize("block_chars", [4_000_000, 300])
def test_leaks_against_brute_force(spark, block_chars):
    rng = random.Random(5)
    items = [(i, prose(rng, 25)) for i in range(8)]
    docs = [(0, None), (1, "")]
    for i in range(60):
        name, item = rng.choice(items)
        k = DC.budget(len(DC.normal(item)))
        inside = damaged(rng, item, rng.choice([0, k // 2, k, k + 6])).replace(" ", rng.choice([" ", "\n", "  "]))
        docs.append((i + 2, f"{prose(rng, 8)} {inside.upper() if i % 3 else inside} {prose(rng, 8)}" if i % 5 else prose(rng, 40)))
    expected = set()
    for d, text in docs:
        for name, item in items:
            distance = edit_distance_inside(DC.normal(item), DC.normal(text))
            if distance <= DC.budget(len(DC.normal(item))):
                expected.add((d, name, distance))
    assert len(expected) > 10
    bench = spark.createDataFrame([*items, (90, None), (91, ""), items[0]], "item_id long, text string")
    got = DC.leaks(table(spark, docs), bench, block_chars=block_chars).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == expected and len(got) == len(expected)
    clean = DC.without_leaks(table(spark, docs), bench, block_chars=block_chars).collect()
    assert {r.doc_id for r in clean} == {d for d, _ in docs} - {d for d, _, _ in expected}


def test_leak_edges(spark):
    docs = awkward_docs(spark)
    bench = spark.createDataFrame([(1, "quick brown fox jumps over"), (None, "a null id")], "item_id long, text string")
    got = DC.leaks(docs, bench)
    assert sorted((r.doc_id or -1, r.item_id or -1) for r in got.collect()) == [(-1, -1), (1, 1), (2, 1), (2, 1)]
    assert DC.leaks(docs.limit(0), bench).count() == 0 and DC.leaks(docs, bench.limit(0)).count() == 0
    assert DC.without_leaks(docs, bench).count() == docs.count() - 4


# --- packing ----------------------------------------------------------------------------------


def checked(pieces, capacity):
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_plan_places_every_piece_once():
    rng = random.Random(6)
    for sizes in ([1], [2047] * 50, list(range(1, 2048)), [700] * 300 + [650] * 300 + [30] * 9, [int(rng.lognormvariate(6, 1)) % 2047 + 1 for _ in range(5000)]):
        histogram = {}
        for s in sizes:
            histogram[s] = histogram.get(s, 0) + 1
        runs, used = PK.plan(histogram)
        seen, bins = dict.fromkeys(histogram, 0), {}
        for length, rank, n, first, per, offset in sorted(runs):
            assert seen[length] == rank
            seen[length] += n
            for i in range(n):
                bins.setdefault(first + i // per, []).append((offset + i % per * length, length))
        assert seen == histogram and len(bins) == used
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= PK.CAPACITY
        assert used <= 1.25 * -(-sum(sizes) // PK.CAPACITY) + len(set(sizes)) or max(sizes) > 1024


def test_packing_edges_and_round_trip(spark):
    from tokenizers import Tokenizer

    docs = awkward_docs(spark).withColumn("length", F.lit("clash"))
    got = PK.pack(docs, capacity=64).collect()
    assert checked(got, 64) <= sum(p.length for p in got) // 32 + 2
    assert PK.pack(docs.limit(0)).count() == 0
    tokenizer = Tokenizer.from_file(PK.default_tokenizer())
    long = next(r.text for r in docs.collect() if r.doc_id == 6)
    ids = np.array([*tokenizer.encode(long, add_special_tokens=False).ids, 0], dtype="<u4")
    pieces = sorted((p for p in got if p.doc_id == 6), key=lambda p: p.piece)
    import zlib

    assert [p.start for p in pieces] == list(range(0, len(ids), 64))
    assert [p.ids_crc32 for p in pieces] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces]
    assert [(p.length, p.ids_crc32) for p in got if p.doc_id in (3, 4)] == [(1, zlib.crc32(b"\0\0\0\0"))] * 2


def test_word_lookup_equals_the_tokenizer():
    words = PK.WordIds(PK.default_tokenizer())
    texts = ["it's A  b c　d e's 'll <|endoftext|> x", "éa ́ x, Éa.", "Σς ΑΣ Σ.", "a\x1cb", "​ a​b", "İstanbul ǅ", "123 4a5b,", " ", "", "..,, A.B. a,", "<|ENDOFTEXT|>"]
    for _ in range(2):
        for text, ids in zip(texts, words.of(texts), strict=True):
            assert ids == np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text
    words.KNOWN_WORDS = 3
    assert words.of(["qqa qqb qqc"]) == words.of(["qqa qqb qqc"])


def test_plain_words_are_kept_once_and_not_normalized():
    words = PK.WordIds(PK.default_tokenizer())
    whole, asked = words._words, []
    words._words = lambda some: asked.extend(some) or whole(some)
    texts = ["Haus haus, HAUS. größe GRÖSSE;\n haus?! don't 4a", "haus (Haus) größe***"]
    for text, ids in zip(texts, words.of(texts), strict=True):
        assert ids == np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text
    assert not {"haus", "größe", "grösse"} & set(asked)
    assert not {"haus,", "haus?!", "HAUS.", "Haus", "größe***"} & set(words.known)


def test_word_lookup_equals_the_tokenizer_on_mixed_characters():
    rng = random.Random(11)
    words = PK.WordIds(PK.default_tokenizer())
    words.KNOWN_WORDS, words.AT_ONCE = 40, 7
    some = "abzAZ'st.,;!_^`|</>w{}[]0123 \t\n\xa0\xad\xb5\xaa\xba\xdf\xd7\xf7\xc9\u0130\u0131\u012e\u0141\u0301\u00b2\u3000\u2028\u03a3\u01c5\U0001f600中"
    texts = ["".join(rng.choices(some, k=rng.choice([0, 1, 5, 60]))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], words.of(texts[at : at + 100]), strict=True):
            assert ids == np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_a_worker_keeps_few_of_many_invented_words():
    rng = np.random.default_rng(3)
    words = PK.WordIds(PK.default_tokenizer())
    for _ in range(8):
        letters = np.where(np.arange(220_000) % 9 == 8, 32, rng.integers(97, 123, 220_000))
        words.of(["".join(map(chr, text)) for text in letters.reshape(22, -1)])
    assert len(words.known) <= 100_000
    assert words.bare.model.tokenize("abc")[0].id == words.tokenizer.model.tokenize("abc")[0].id


def test_strips_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(PK, "STRIP", 10)
    texts = ["a" * n for n in (3, 25, 0, 9, 9, 1, 40)] + [None, "éé", ""]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(t, pa.string())], names=["id", "text"]) for t in (texts, [], texts[:1])]
    got = list(PK.strips(iter(batches)))
    assert [t for _, part in got for t in part] == texts + texts[:1] and max(len(p) for _, p in got) < 5


# --- SimHash ----------------------------------------------------------------------------------


def slow_print(text):
    import xxhash

    words = [w for w in text.encode().lower().split()]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot", [2000, 5])
def test_components_against_all_pairs(spark, hot, monkeypatch):
    monkeypatch.setattr(SH, "HOT", hot)
    rng = random.Random(7)
    docs = []
    for i in range(40):
        words = prose(rng, rng.choice([3, 30, 300])).split()
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 3])):
                copy[rng.randrange(len(copy))] = "zz"
            docs.append((len(docs), " ".join(copy)))
    prints = [SH.fingerprint(t) for _, t in docs]
    assert prints == [slow_print(t) for _, t in docs]
    got = {r.doc_id: r.component_id for r in SH.near_duplicates(table(spark, docs)).collect()}
    assert got == dict(enumerate(components_of(prints, within(SH.DISTANCE))))


@pytest.mark.parametrize("hot", [2000, 5])
def test_texts_alike_against_all_pairs(spark, hot, monkeypatch):
    monkeypatch.setattr(SH, "HOT", hot)
    rng = random.Random(17)
    docs = []
    for copies in [1] * 20 + [2] * 20 + [90]:
        words = prose(rng, rng.choice([60, 300, 900])).split()
        for _ in range(copies):
            edited = list(words)
            for _ in range(rng.choice([0, 1, 2, len(words) // 60, len(words) // 9])):
                edited[rng.randrange(len(edited))] = word(rng)
            docs.append((len(docs), " ".join(edited)))
    root = components_of([t for _, t in docs], lambda a, b: shared_shingles(a, b) >= 0.8)
    assert 41 < len(set(root)) < len(docs) - 20
    got = {r.doc_id for r in AL.one_of_each(table(spark, docs)).collect()}
    assert got == set(root)


def test_filing_plan_finds_every_close_pair():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for total in (10, 10**5, 10**10):
        plan = SH.filing_plan(base, total)
        assert sum(t + 1 for _, t in plan) == SH.DISTANCE + 1
        assert len({b for bits, _ in plan for b in bits}) == sum(len(bits) for bits, _ in plan)
        for _ in range(300):
            flips = sum(1 << int(b) for b in rng.choice(64, SH.DISTANCE, replace=False))
            assert any((flips & SH.mask_of(bits)).bit_count() <= t for bits, t in plan)


def test_simhash_edges(spark):
    docs = awkward_docs(spark)
    got = SH.near_duplicates(docs).collect()
    assert len(got) == docs.count() and SH.near_duplicates(docs.limit(0)).count() == 0
    empty = [r for r in got if r.fp == 0]
    assert len(empty) == 4 and {r.component_id for r in empty} == {3}


# --- fingerprints -----------------------------------------------------------------------------


def test_syncmers_against_the_definition():
    text = prose(random.Random(9), 120)
    s = FP.Settings()
    inner = [int(FP._mixed(FP._rolled(FP.code_points(text[i : i + s.s]), (s.s,))[s.s])[0]) for i in range(len(text) - s.s + 1)]
    width = s.k - s.s + 1
    expected = [i for i in range(len(text) - s.k + 1) if min(inner[i : i + width]) in (inner[i], inner[i + width - 1])]
    assert list(FP.syncmers(text)[0]) == expected
    moved = FP.syncmers("xyz " + text)[1]  # anchors of a passage do not depend on what stands around it
    assert set(FP.syncmers(text)[1]) <= set(moved)


@pytest.mark.parametrize("range_bytes", [16_000_000, 20_000])
def test_edited_texts_against_a_loop(spark, range_bytes, monkeypatch):
    monkeypatch.setattr(FP, "RANGE_BYTES", range_bytes)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in Q.op9_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    for n, (name, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        other = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r = got[name]
        assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest() and r.n_chars == len(text)
        assert r.fingerprint == FP.written(FP.anchors(text)) and r.edited_fingerprint == FP.written(FP.anchors(other))
        assert 0 <= r.near_next <= 1 and r.near_edited == FP.likeness(FP.anchors(text), FP.anchors(other))


def test_fingerprint_edges(spark):
    docs = awkward_docs(spark)
    got = FP.fingerprinted(docs).collect()
    assert len(got) == docs.count() and FP.fingerprinted(docs.limit(0)).count() == 0
    assert {r.fingerprint for r in got if r.doc_id in (3, 4)} == {""}
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    one = FP.fingerprinted(table(spark, [(1, "only one document here")])).first()
    assert one.near_next == 1.0


# --- HTML -------------------------------------------------------------------------------------

PAGES = {
    "<html><body><nav>Home</nav><article><h1>T</h1><p>a&amp;b &nbsp; c<br>d</p><p>e<b>f</b>g</article><footer>x</footer>": "T\na&b c d\nefg",
    "<div class='cookie-notice'>We use</div><main>z<aside>no</aside>w<div id=comments><p>me!</p></div></main>": "z\nw",
    "<script>var t='</p>';</script><style>p{}</style><article><p>1 &lt; 2</p><form><input>Send</form></article>": "1 < 2",
    "<nav>menu<article><p>t</p></article>": "t",
    "<!-- <article>no</article> --><article>yes</article>": "yes",
    "<article><div class='ad'>buy</div><p title='a>b'>x</p><ul><li>1<li>2</ul></article>": "x\n1\n2",
    "<article></article>": "",
    "": "",
}


def test_marked_pages(spark):
    rows = [(i, f"http://h{i}.org/a", h, "t") for i, h in enumerate([*PAGES, None])]
    got = HX.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    expected = [*PAGES.values(), ""]
    assert len(got) == len(rows)
    for r in got:
        assert r.text == expected[r.page_id] and r.n_chars == len(r.text) and r.url == rows[r.page_id][1]


@pytest.mark.parametrize("range_bytes", [16_000_000, 60])
def test_shared_lines_of_unmarked_pages_go(spark, range_bytes, monkeypatch):
    monkeypatch.setattr(HX, "RANGE_BYTES", range_bytes)
    page = "<div>Site name</div><div>Own {0}</div><div>Shared foot</div>"
    rows = [(i, f"http://h.org/s/{i}", page.format(i)) for i in range(20)]
    rows += [(20, "http://other.org/s/1", page.format(20)), (21, None, page.format(21)), (22, None, None), (22, "http://h.org/s/1", page.format(1))]
    got = HX.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 20:
            assert r.text == f"Own {r.page_id}" or r.page_id == 1 and r.text == ""  # page 22 is its copy
        elif r.page_id == 20:
            assert r.text == "Site name\nOwn 20\nShared foot"


def test_common_lines_is_a_longest_one():
    rng = random.Random(10)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = sorted(HX.common_lines(a, b))
        assert len(found) == best[-1][-1]
        left = iter(b)
        assert all(a[i] in left for i in found)


def test_page_query_and_empty_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert Q.op6_html_extract(spark, SF).count() == pages.count() and HX.extract(pages.limit(0)).count() == 0
