"""Attack labels for anomalous rows: Spark ML random forest, applied in the same pass as the scan.

Training is Spark ML's, or on large tables of few distinct binned rows that of ``cells``, which is saved
as Spark ML's model. For scoring, the fitted nodes are read from the saved model and walked per
Arrow batch for the flagged rows only. ``RandomForestClassificationModel.transform`` would either
predict every row or need the input split in two, and so read and scored twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import NORMAL
from ..sources.schemas import model_columns, require_columns, require_inputs
from ..sources.workspace import checkpoint_folder, materialize, new_folder
from .cells import count_cells, grow_forest
from .forest import Forest
from .iforest import new_version, read_meta, write_meta

TREES = 150
SEED = 42
# The deepest trees that Spark ML grows; it stops where a node is pure or too small anyway.
MAX_DEPTH = 30

# Every value of a feature with so many at most is a candidate split.
MAX_BINS = 64
# Statistics of the nodes that one pass over the rows splits.
PASS_MB = 1024
# Rows of a training partition at most, on average: some 2 KB each with 150 trees, read on every pass.
PARTITION_ROWS = 100_000
# Tables of more rows are fitted on counts of equal binned rows, if these are few. Spark ML takes candidate
# splits from a sample of so many rows.
CELL_ROWS = 10_000
# Levels of a tree between two checkpoints of the rows' nodes.
CHECKPOINT_LEVELS = 10

# A model of more bytes is not collected and broadcast: Spark ML then transforms the flagged rows.
BROADCAST_BYTES = 64_000_000


class Classifier(Protocol):
    """What ``predict_attack_types`` needs of a model."""

    features: list[str] | None

    def classify(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        """Add ``_label`` and ``_confidence``, which count only where ``is_anomaly`` is 1."""


@dataclass
class AttackClassifier:
    """A fitted random forest: the version of the model at ``path`` whose files are in ``data``."""

    path: str
    features: list[str]
    labels: list[str]
    node_count: int
    data: str
    _forest: Forest | None = field(default=None, repr=False)

    def forest(self, spark: SparkSession) -> Forest:
        if self._forest is None:
            node = F.col("nodeData")
            nodes = (
                spark.read.parquet(f"{self.path}/{self.data}/forest/data")
                .select(
                    F.col("treeID").alias("tree"),
                    node["id"].alias("node"),
                    node["leftChild"].alias("left"),
                    node["rightChild"].alias("right"),
                    node["split"]["featureIndex"].alias("feature"),
                    F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
                    node["impurityStats"].alias("stats"),
                )
                .toArrow()
                .to_pandas()
                .sort_values(["tree", "node"])
                .reset_index(drop=True)
            )
            start = nodes.index - nodes["node"]  # node ids of a tree run from 0 without gaps
            stats = np.stack(nodes["stats"].to_numpy())
            left = np.where(nodes["left"] < 0, -1, nodes["left"] + start).astype(np.int64)
            right = np.where(nodes["right"] < 0, -1, nodes["right"] + start).astype(np.int64)
            depth = np.zeros(len(nodes), dtype=np.int64)
            for at in np.flatnonzero(left >= 0):
                depth[left[at]] = depth[right[at]] = depth[at] + 1
            self._forest = Forest(
                roots=np.flatnonzero(nodes["node"] == 0),
                feature=nodes["feature"],
                threshold=nodes["threshold"].to_numpy(dtype=np.float64, na_value=np.nan),
                left=left,
                right=right,
                value=stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300),
                depth=depth,
            )
        return self._forest

    def classify(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        require_inputs(features, self.features)
        features = self.features
        # Six numbers and a share for each label to a node.
        if self.node_count * 8 * (6 + len(self.labels)) > BROADCAST_BYTES:
            return self.transform(df, features)
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast(self.forest(spark).parts)

        @F.pandas_udf("class int, confidence double")
        def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            forest = Forest(**shared.value)
            for flag, *columns in batches:
                chosen = flag.to_numpy(dtype=np.float64) == 1
                rows = np.column_stack([c.to_numpy(dtype=np.float64)[chosen] for c in columns])
                votes = forest.total(rows)
                best = votes.argmax(axis=1)
                label = np.zeros(len(flag), dtype=np.int32)
                confidence = np.zeros(len(flag))
                label[chosen] = best
                confidence[chosen] = votes[np.arange(len(best)), best] / votes.sum(axis=1)
                yield pd.DataFrame({"class": label, "confidence": confidence})

        columns = [F.col(f"`{c}`").cast("double") for c in features]
        labels = F.array(*[F.lit(label) for label in self.labels])
        return (
            df.withColumn("_prediction", predict(F.col("is_anomaly").cast("double"), *columns))
            .withColumn("_label", F.element_at(labels, F.col("_prediction.class") + 1))
            .withColumn("_confidence", F.col("_prediction.confidence"))
            .drop("_prediction")
        )

    def transform(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        """The same columns from Spark ML's own ``transform``, on the flagged rows only.

        Null and NaN inputs take the right branch of every split, as in ``classify``. A batch table is
        written once before it is split, so that its inputs are not read and scored twice.
        """
        from pyspark.ml.functions import vector_to_array

        spark = df.sparkSession
        model = RandomForestClassificationModel.load(f"{self.path}/{self.data}/forest")
        if not df.isStreaming:
            df = materialize(df, "scored")
        flagged = df.filter("is_anomaly = 1")
        names = [f"_f{i}" for i in range(len(features))]
        inputs = flagged.select(
            "*", *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(features, names)]
        )
        assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
        vectors = assembler.transform(inputs)
        best = F.col("prediction").cast("int") + 1
        labels = F.array(*[F.lit(label) for label in self.labels])
        predicted = model.transform(vectors).select(
            *df.columns,
            F.element_at(labels, best).alias("_label"),
            F.element_at(vector_to_array("probability"), best).alias("_confidence"),
        )
        others = df.filter("not (is_anomaly <=> 1)").withColumns(
            {"_label": F.lit(None).cast("string"), "_confidence": F.lit(None).cast("double")}
        )
        return predicted.unionByName(others)

    def save(self, spark: SparkSession, path: str) -> AttackClassifier:
        model = RandomForestClassificationModel.load(f"{self.path}/{self.data}/forest")
        return _saved(spark, model, self.features, self.labels, path)


def _saved(
    spark, model, features: list[str], labels: list[str], path: str, nodes: DataFrame | None = None
) -> AttackClassifier:
    """Save a version of ``model``, with the trees of ``nodes`` instead of its own if they are given."""
    data = new_version()
    model.write().save(f"{path}/{data}/forest")
    count = model.totalNumNodes
    if nodes is not None:
        count = _write_nodes(spark, nodes, f"{path}/{data}/forest/data")
    meta = {
        "data": data,
        "kind": "attack_classifier",
        "features": features,
        "labels": labels,
        "nodes": count,
    }
    write_meta(spark, meta, path)
    return AttackClassifier(path, features, labels, count, data)


def _write_nodes(spark: SparkSession, nodes: DataFrame, path: str) -> int:
    """Put ``nodes`` of ``cells`` in the place of those of a saved model, of as many trees."""
    schema = spark.read.parquet(path).schema
    split = F.struct(
        F.col("feature").alias("featureIndex"),
        F.col("threshold").alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    names = {
        "id": "id", "prediction": "prediction", "impurity": "impurity", "impurityStats": "stats", "rawCount": "n",
        "gain": "gain", "leftChild": "left", "rightChild": "right",
    }
    node = F.struct(*[F.col(c).alias(n) for n, c in names.items()], split.alias("split"))
    columns = {"treeID": F.col("tree"), "nodeData": node}
    nodes.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in schema]).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path).count()


def load_classifier(spark: SparkSession, path: str) -> AttackClassifier:
    meta = read_meta(spark, path, "attack_classifier")
    return AttackClassifier(path, meta["features"], meta["labels"], meta["nodes"], meta["data"])


def fit_classifier(
    df: DataFrame,
    features: Sequence[str],
    label: str = "attack_type",
    path: str | None = None,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    seed: int = SEED,
    max_bins: int = MAX_BINS,
    pass_mb: int = PASS_MB,
) -> AttackClassifier:
    """Fit on labelled rows and save under ``path``; classes are in alphabetical order.

    Each row keeps the node it has reached in every tree, so that deep trees are not sent with every
    task; these are checkpointed, as a lost executor would else repeat all levels. A task holds these
    of its partition, so partitions follow the number of rows.

    All this holds some 1.4 KB a row and walks every row through every tree. So tables of more than
    ``CELL_ROWS`` rows are fitted on counts of rows that are equal once binned (``cells``), unless even
    these are too many: then the same rows go the first way.
    """
    spark, features = df.sparkSession, list(features)
    checkpoint_folder(spark)
    require_columns(df, [*features, label])
    names = [f"_f{i}" for i in range(len(features))]
    inputs = df.select(
        F.col(label).alias("_label"),
        *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(features, names)],
    )
    # Training makes several passes: write its input once instead of computing it for each.
    inputs = materialize(inputs, "labelled")
    n = inputs.count()
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n / PARTITION_ROWS))
    indexer = StringIndexer(inputCol="_label", outputCol="label", stringOrderType="alphabetAsc")
    indexed = indexer.fit(inputs)
    labels = list(indexed.labels)
    path = path or new_folder(spark, "classifier")
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    classifier = RandomForestClassifier(
        numTrees=trees,
        maxDepth=max_depth,
        maxBins=max_bins,
        featureSubsetStrategy="sqrt",
        impurity="gini",
        seed=seed,
        cacheNodeIds=True,
        checkpointInterval=CHECKPOINT_LEVELS,
        maxMemoryInMB=pass_mb,
    )
    cells = None
    if n > CELL_ROWS and max_bins <= 256 and len(labels) <= 1 << 16:
        cells = count_cells(indexed.transform(inputs), names, "label", max_bins)
    if cells is None:
        vectors = assembler.transform(indexed.transform(inputs)).select("label", "features")
        return _saved(spark, classifier.fit(vectors.repartition(parts)), features, labels, path)
    # A model of the same settings and classes, without a split, holds the trees' place.
    blank = spark.createDataFrame([(x,) for x in labels], "_label string").withColumns({c: F.lit(0.0) for c in names})
    blank = assembler.transform(indexed.transform(blank)).select("label", "features")
    nodes = grow_forest(spark, cells, len(labels), trees, max_depth, seed)
    return _saved(spark, classifier.fit(blank), features, labels, path, nodes)


def predict_attack_types(
    df: DataFrame,
    model: Classifier,
    feature_columns: Sequence[str] | None = None,
    schema: Sequence[str] | None = None,
    strict_schema: bool = False,
) -> DataFrame:
    """Add ``attack_type`` and ``attack_confidence``; rows that are not flagged get normal, 1.0.

    Where ``df`` lacks model inputs the flagged rows get anomaly, 0.0, or an error when strict.
    """
    require_columns(df, ["is_anomaly"])
    wanted = model_columns(df, feature_columns, schema, model.features)
    missing = [c for c in wanted if c not in df.columns]
    if missing and strict_schema:
        raise ValueError(f"Missing feature columns for the classifier: {missing}")
    if missing:
        labelled, label, confidence = df, F.lit("anomaly"), F.lit(0.0)
    else:
        labelled = model.classify(df, wanted)
        label, confidence = F.col("_label"), F.col("_confidence")
    flagged = F.col("is_anomaly") == 1
    return labelled.select(
        *df.columns,
        F.when(flagged, label).otherwise(NORMAL).alias("attack_type"),
        F.when(flagged, confidence).otherwise(F.lit(1.0)).alias("attack_confidence"),
    )


def classify_attacks(df: DataFrame, path: str, schema: Sequence[str] | None = None) -> DataFrame:
    """Load a model and label."""
    return predict_attack_types(df, load_classifier(df.sparkSession, path), schema=schema)
