"""One query per operator, over the whole of its table; ``oracle.py`` has the SQL where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    fingerprints,
    language_model,
    licences,
    mixing,
    near_dedup,
    packing,
    phrase_index,
    quality,
    ranked_search,
    repair,
    secret_scan,
    sharding,
    token_counts,
)
from .frames import crc_of_id, utf8

QUERIES = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query
def op1_licences(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return licences.scan(docs, licences.fit(docs))


@query
def op2_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    held_out = crc_of_id() % 7 == 2
    model = language_model.fit(docs.filter(~held_out))
    return language_model.score(docs, model, keep={"held_out": held_out})


@query
def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.find_secrets(_documents(spark, sf))

    def of(kind: str):
        return F.filter("spans", lambda s: s["kind"] == kind)

    def listed(spans):
        one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
        return F.array_join(one, ",")

    base = listed(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@query
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(crc_of_id() % 5 != 0)
    scored = quality.score(docs, quality.fit(docs, labels), keep={"held_out": crc_of_id() % 5 == 0})
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scored.withColumn("predicted", predicted)


@query
def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    text = utf8("text")
    rows = _documents(spark, sf).select(
        "doc_id",
        (F.length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return sharding.shard(rows)


@query
def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "source", "lang", "text")
    return mixing.mix_sources(docs).drop("text")


@query
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = phrase_index.contamination(_documents(spark, sf), items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    found = fingerprints.edited_fingerprints(_documents(spark, sf))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("entries")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_entries")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.section_tokens(_documents(spark, sf))


@query
def op10_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf))


@query
def op11_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_documents(spark, sf), digest=True)


@query
def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    return ranked_search.search(_documents(spark, sf), items)


@query
def op13_repair(spark: SparkSession, sf: str) -> DataFrame:
    original = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = repair.damaged(original)
    return repair.with_digest(rows, repair.report(rows, ids=original))
