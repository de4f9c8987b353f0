"""Isolation forest (Liu, Ting and Zhou, ICDM 2008): one tree per group, scores by Arrow batch.

Each tree sees at most 256 rows. A hash per row and tree picks them while scanning, so only about
512 rows per tree are shuffled, and the trees grow in parallel. A fitted forest has at most
2 * 256 - 1 nodes per tree whatever the size of the data, which bounds what is broadcast.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import model_columns, path_exists, require_columns, require_inputs
from ..sources.workspace import materialize
from .forest import Forest
from .quantile import exact_quantile
from .sampling import sample_uniform

NODE_SCHEMA = (
    "tree int, node int, feature string, threshold double, left int, right int, n int, depth int"
)

TREES = 100
TREE_ROWS = 256
CONTAMINATION = 0.2
SEED = 42

_HASH_RANGE = 1 << 30
_EULER = 0.5772156649015329


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of ``n`` rows."""
    n = np.asarray(n, dtype=np.float64)
    big = np.maximum(n, 3)
    long = 2 * (np.log(big - 1) + _EULER) - 2 * (big - 1) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


@dataclass
class IsolationForestModel:
    nodes: pd.DataFrame
    features: list[str]
    sample_size: int
    offset: float

    def forest(self, features: Sequence[str]) -> Forest:
        nodes = self.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        place = {(t, n): i for i, (t, n) in enumerate(zip(nodes["tree"], nodes["node"]))}
        index = {name: i for i, name in enumerate(features)}

        def child(column: str) -> list[int]:
            return [
                -1 if pd.isna(c) or c < 0 else place[(t, int(c))]
                for t, c in zip(nodes["tree"], nodes[column])
            ]

        return Forest(
            roots=np.flatnonzero(nodes["node"] == 0),
            feature=[index.get(f, 0) for f in nodes["feature"]],
            threshold=nodes["threshold"].to_numpy(dtype=np.float64, na_value=np.nan),
            left=child("left"),
            right=child("right"),
            value=(nodes["depth"] + average_path(nodes["n"])).to_numpy().reshape(-1, 1),
            depth=nodes["depth"],
        )

    def score(self, spark: SparkSession, features: Sequence[str]) -> Column:
        """Score of each row: near -1 for rows that are easy to isolate, near 0 for the others.

        Only columns that some tree splits on are sent to Python.
        """
        used = set(self.nodes["feature"].dropna())
        require_inputs(features, sorted(used))
        features = [f for f in features if f in used] or list(features)[:1]
        shared = spark.sparkContext.broadcast(self.forest(features).parts)
        trees = int(self.nodes["tree"].nunique())
        norm = float(average_path(self.sample_size)) or 1.0

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            forest = Forest(**shared.value)
            for batch in batches:
                columns = batch if isinstance(batch, tuple) else (batch,)
                rows = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
                mean = forest.total(rows)[:, 0] / trees
                yield pd.Series(-np.power(2.0, -mean / norm))

        return score(*[F.col(f"`{c}`").cast("double") for c in features])

    def save(self, spark: SparkSession, path: str) -> str:
        meta = {
            "kind": "isolation_forest",
            "features": self.features,
            "sample_size": self.sample_size,
            "offset": self.offset,
        }
        nodes = spark.createDataFrame(_node_rows(self.nodes), NODE_SCHEMA)
        data = new_version()
        nodes.coalesce(1).write.parquet(f"{path}/{data}/nodes")
        write_meta(spark, meta | {"data": data}, path)
        return path


def _node_rows(nodes: pd.DataFrame) -> list[tuple]:
    whole = {"tree", "node", "left", "right", "n", "depth"}
    return [
        tuple(
            None if pd.isna(v) else int(v) if c in whole else v for c, v in zip(nodes.columns, row)
        )
        for row in nodes.itertuples(index=False)
    ]


def new_version() -> str:
    """A folder, below that of a model, for the data of one version of it."""
    return f"versions/{uuid.uuid4().hex}"


def write_meta(spark: SparkSession, meta: dict, path: str) -> None:
    """Publish a version whose data has been written: the last step, and one file that appears at once.

    Earlier versions stay as they are, so whoever reads meanwhile has the one before, whole.
    """
    known = _versions(spark, path)
    number = max([time.time_ns(), *(m["version"] + 1 for m in known)])
    row = spark.createDataFrame([(json.dumps(meta | {"version": number}),)], "value string")
    row.coalesce(1).write.mode("append").text(f"{path}/meta")


def _versions(spark: SparkSession, path: str) -> list[dict]:
    """What has been published: a short line for each time that the model was saved."""
    if not path_exists(spark, f"{path}/meta"):
        return []
    return [json.loads(r.value) for r in spark.read.text(f"{path}/meta").collect()]


def read_meta(spark: SparkSession, path: str, kind: str) -> dict:
    """The version published last."""
    if not path or not isinstance(path, str):
        raise ValueError("The model path must be a non-empty string.")
    published = _versions(spark, path)
    if not published:
        raise FileNotFoundError(f"Model not found: {path}")
    meta = max(published, key=lambda m: m["version"])
    if meta.get("kind") != kind:
        raise ValueError(f"Model in {path} is {meta.get('kind')!r}, expected {kind!r}.")
    return meta


def load_isolation_forest(spark: SparkSession, path: str) -> IsolationForestModel:
    meta = read_meta(spark, path, "isolation_forest")
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/{meta['data']}/nodes").toPandas()
    return IsolationForestModel(nodes, meta["features"], meta["sample_size"], meta["offset"])


def _grow(features: list[str], rows_per_tree: int, seed: int):
    columns = ["tree", "node", "feature", "threshold", "left", "right", "n", "depth"]

    def grow(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        # The order of hashes, not of arrival, decides which rows the tree sees.
        rows = rows.sort_values(["_hash", *features]).head(rows_per_tree)
        data = rows[features].to_numpy(dtype=np.float64)
        limit = math.ceil(math.log2(max(len(data), 2)))
        rng = np.random.default_rng([seed, int(key[0])])
        nodes: list[list] = []
        todo = [(data, 0, None, None)]
        while todo:
            part, depth, parent, side = todo.pop()
            node = len(nodes)
            nodes.append([int(key[0]), node, None, None, None, None, len(part), depth])
            if parent is not None:
                nodes[parent][side] = node
            if depth >= limit or len(part) <= 1:
                continue
            low, high = part.min(axis=0), part.max(axis=0)
            varied = np.flatnonzero(high > low)
            if not len(varied):
                continue
            feature = int(rng.choice(varied))
            threshold = float(rng.uniform(low[feature], high[feature]))
            if threshold >= high[feature]:
                threshold = float(low[feature])
            nodes[node][2:4] = [features[feature], threshold]
            left = part[:, feature] <= threshold
            todo.append((part[~left], depth + 1, node, 5))
            todo.append((part[left], depth + 1, node, 4))
        return pd.DataFrame(nodes, columns=columns)

    return grow


def fit_isolation_forest(
    df: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    trees: int = TREES,
    rows_per_tree: int = TREE_ROWS,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
    max_rows: int | None = None,
) -> IsolationForestModel:
    """Fit on all rows, or on ``max_rows`` of them; ``key`` names columns that identify a row.

    Each tree sees ``rows_per_tree`` rows whatever the size of the table; the offset is taken over all.

    ``offset`` is the score below which the ``contamination`` share of the training rows lies.
    """
    spark, features = df.sparkSession, list(features)
    require_columns(df, [*features, *key])
    names = [c for c in dict.fromkeys([*key, *features])]
    df = df.select(*[F.col(f"`{c}`") for c in names])
    n = df.count()
    if n == 0:
        raise ValueError("Input DataFrame is empty; cannot fit an isolation forest.")
    if max_rows is not None and n > max_rows:
        df, n = sample_uniform(df, max_rows, key, seed), max_rows
    # Read twice below: once for the trees, once for the scores.
    df = materialize(df.repartition(spark.sparkContext.defaultParallelism), "forest-rows")
    size = min(rows_per_tree, n)
    share = min(1.0, 2 * size / n)

    def row_hash(tree: Column) -> Column:
        return F.pmod(F.xxhash64(*key, tree, F.lit(seed)), F.lit(_HASH_RANGE))

    # A filter on exploded trees is compiled; one on an array of them would be interpreted for each row and tree.
    tried = df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    if share < 1:
        tried = tried.filter(row_hash(F.col("tree")) < int(share * _HASH_RANGE))
    drawn = tried.select(
        *[F.col(f"`{c}`").cast("double").alias(c) for c in features],
        "tree",
        row_hash(F.col("tree")).alias("_hash"),
    )
    grown = drawn.groupBy("tree").applyInPandas(_grow(features, size, seed), NODE_SCHEMA)
    nodes = grown.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)

    model = IsolationForestModel(nodes, features, size, 0.0)
    scores = materialize(df.select(model.score(spark, features).alias("score")), "forest-scores")
    model.offset = exact_quantile(scores, "score", contamination)
    return model


def score_packets(
    df: DataFrame,
    model: IsolationForestModel,
    feature_columns: Sequence[str] | None = None,
    schema: Sequence[str] | None = None,
    strict_schema: bool = False,
) -> DataFrame:
    """Add ``is_anomaly`` (score below the model's offset) and ``anomaly_score`` (score - offset).

    Where ``df`` lacks model inputs nothing is flagged: 0 and 0.0, or an error when strict.
    """
    wanted = model_columns(df, feature_columns, schema, model.features)
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        if strict_schema:
            raise ValueError(f"Missing feature columns for the anomaly model: {missing}")
        return df.withColumns({"is_anomaly": F.lit(0), "anomaly_score": F.lit(0.0)})
    scored = df.withColumn(
        "anomaly_score", model.score(df.sparkSession, wanted) - F.lit(model.offset)
    )
    flag = (F.col("anomaly_score") < 0).cast("int")
    return scored.select(*df.columns, flag.alias("is_anomaly"), "anomaly_score")


def filter_anomalies(df: DataFrame) -> DataFrame:
    require_columns(df, ["is_anomaly"])
    return df.filter(F.col("is_anomaly") == 1)


def detect_anomalies(df: DataFrame, path: str, schema: Sequence[str] | None = None) -> DataFrame:
    """Load a model and score."""
    return score_packets(df, load_isolation_forest(df.sparkSession, path), schema=schema)
