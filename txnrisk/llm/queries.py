"""The operators of this package applied to the given tables, each to the whole of its table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.llm import decontaminate as DC
from txnrisk.llm import filter_audit as FA
from txnrisk.llm import fingerprints as FP
from txnrisk.llm import html_extract as HX
from txnrisk.llm import language_id as LI
from txnrisk.llm import mixing as MX
from txnrisk.llm import oracle
from txnrisk.llm import packing as PK
from txnrisk.llm import periodic as PR
from txnrisk.llm import secret_scan as SS
from txnrisk.llm import sharding as SD
from txnrisk.llm import simhash as SH
from txnrisk.llm import toxicity as TX
from txnrisk.llm import url_filter as UF
from txnrisk.llm.common import given

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DC.leaks(given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return UF.url_filter(given(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = SS.secret_scan(given(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        *[number(kind) for kind in ("assign", "access", "hex")],
        F.sha2(SS.spans_text(F.col("base_spans")), 256).alias("base_sha256"),
        SS.spans_text(F.col("all_spans")).alias("spans"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    return LI.language_id(docs, LI.train(docs))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PK.pack(given(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HX.extract(given(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SD.sharded(given(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    return TX.toxicity(docs, TX.train(docs, given(spark, sf_dir, "labels")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FP.fingerprinted(given(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = SH.near_duplicates(given(spark, sf_dir, "documents"))
    return found.select("doc_id", SH.hex_text(F.col("fp")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.audit(given(spark, sf_dir, "documents"), given(spark, sf_dir, "labels"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MX.mix(given(spark, sf_dir, "documents"))


def planted(keys: tuple, words: list[bytes]) -> list[bytes]:
    """One document in ten, by its id, goes on with a period of its own words; a row without an id does not."""
    h = zlib.crc32(str(keys[0]).encode())
    if keys[0] is None or h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(len(words) - a)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = PR.periodic_runs(given(spark, sf_dir, "documents"), ["doc_id"], prepare=planted)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.select("*", longest.alias("best"), F.array_join(lines, "").alias("lines"))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_html_extract": op6_html_extract,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_fingerprints": op9_fingerprints,
    "op10_simhash": op10_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_mixing": op12_mixing,
    "op13_periodic_runs": op13_periodic_runs,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Only where SQL can express the rows; tests/llm has a brute-force version of the others."""
    return {
        "op2_url_filter": oracle.op2(),
        "op3_secret_scan": oracle.op3(),
        "op7_sharding": oracle.op7(),
        "op11_filter_audit": oracle.op11(),
        "op12_mixing": oracle.op12(),
        "op13_periodic_runs": oracle.op13(),
    }
