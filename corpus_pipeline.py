"""From raw documents to shuffled training shards: five stages over one table.

``STAGES`` has the stages in order. Each takes the session, the rows that the stage before it kept and
the folder of the tables, and returns a table; ``run`` writes it and hands what it reads back to the
next. All stages but the last return the columns of ``documents`` and work on whole texts. Rows with
null ids, texts, languages or sources, repeated rows, empty tables and further columns of any name are
handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetlens.llm import mixing, near_dedup, phrase_index, quality, sharding
from packetlens.llm.frames import crc_of_id
from packetlens.sources.workspace import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject; a fifth of the labels is never learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_of_id() % 5 != 0)
    return quality.keep_good(docs, quality.fit(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least id."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no window of ten words with a benchmark item."""
    return phrase_index.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half of the tokens, raked to tempered shares of sources, languages and topics."""
    return mixing.sample(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it."""
    return sharding.shard(docs)


STAGES = [
    ("quality", good_quality),
    ("near-duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

# The classifier and the shuffle can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
