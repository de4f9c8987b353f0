"""Flow records: cleaning, labels, numeric features and union by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import flow_label
from ..sources.schemas import flow_columns, require_columns

# Columns that identify a flow and are never model inputs.
IDENTIFIERS = ["flow_id", "source_ip", "destination_ip", "timestamp"]


def normalize_columns(df: DataFrame) -> DataFrame:
    """Snake-case column names; two headers that fall together are an error."""
    return df.toDF(*flow_columns(df.columns))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def clean_flows(df: DataFrame, kept: Observation | None = None) -> DataFrame:
    """Require ``label``, make infinities null and drop every row that has any null or NaN.

    ``kept`` receives ``rows`` and ``kept`` counts from the pass that runs anyway.
    """
    require_columns(df, ["label"])
    checks = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        # Catalyst puts the column's expression in place of each mention; NaN is above infinity.
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            checks.append(F.abs(c) < float("inf"))
        else:
            checks.append(c.isNotNull())
    complete = reduce(lambda a, b: a & b, checks)
    if kept is not None:
        df = df.observe(
            kept, F.count(F.lit(1)).alias("rows"), F.count_if(complete).alias("kept")
        )
    return df.filter(complete)


def normalize_labels(df: DataFrame, column: str = "label") -> DataFrame:
    require_columns(df, [column])
    return df.withColumn(column, flow_label(F.col(column)))


def feature_names(df: DataFrame) -> list[str]:
    """Numeric columns other than identifiers and the label; none is an error."""
    left_out = {*IDENTIFIERS, "label"}
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in left_out
    ]
    if not names:
        raise ValueError("No numeric feature columns.")
    return names


def flow_features(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numeric features and the normalized label as ``attack_type``."""
    require_columns(df, ["label"])
    features = [n for n in feature_names(df) if n not in keep]
    return df.select(*keep, *features, flow_label(F.col("label")).alias("attack_type"))
