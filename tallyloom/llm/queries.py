"""The registered queries: each operator over its whole table, and the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import byte_bpe, oracles, quality_cnn, toxicity_zstd
from tallyloom.llm.common import table
from tallyloom.llm.filter_audit import audit
from tallyloom.llm.learning import remainder
from tallyloom.llm.license_join import find_licenses
from tallyloom.llm.mixing import mix
from tallyloom.llm.periodic_runs import digest_of_runs, periodic_runs, with_planted_runs
from tallyloom.llm.pii_disclosure import disclosures, listed
from tallyloom.llm.quality_rules import judge
from tallyloom.llm.simhash import near_duplicates
from tallyloom.llm.suffix_dedup import remove_repeats
from tallyloom.llm.warc_zip import through_packages
from tallyloom.llm.winnowing import contamination

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


@query()
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), cycle=(3, 1, 2), share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats", "extra")


@query()
def op2_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _scored(scores: DataFrame, held_out) -> DataFrame:
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int")
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))


@query()
def op3_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 5) == 0
    scores = quality_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return _scored(scores, held_out)


@query()
def op4_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 4) == 2
    scores = toxicity_zstd.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return _scored(scores, held_out)


@query(oracles.QUALITY)
def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), host="source").drop("host_rejected")


@query()
def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=400).drop("spans")


@query()
def op7_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(disclosures(table(spark, sf_dir, "documents")))


@query(oracles.LICENSES)
def op8_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents")).drop("matches")


@query(oracles.LEAKS)
def op9_winnowing_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10, gram=5)
    return found.drop("row", "items", "spans")


@query(oracles.RECORDS)
def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = through_packages(table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_of_runs(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), min_length=12))


@query()
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query(oracles.AUDIT)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
