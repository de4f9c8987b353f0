"""Training job: flow CSV or a labelled feature table to a saved detector, classifier and schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, iforest
from ..operators.flows import clean_flows, feature_names, flow_features, normalize_columns
from ..operators.sampling import normal_rows, sample_stratified
from ..sources.flows import CSV_NAMES, read_flows
from ..sources.schemas import write_feature_schema
from ..sources.workspace import job_workspace, materialize
from .ledger import write_ledger

ROW_ID = "_row"


def load_flows(
    spark: SparkSession, folder: str, kept: Observation | None = None, pattern: str = CSV_NAMES
) -> DataFrame:
    """All flow CSV of a folder, typed, renamed and cleaned; ``kept`` counts what cleaning keeps."""
    return read_flows(spark, folder, pattern).transform(normalize_columns).transform(clean_flows, kept)


def load_flow_features(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric features and the label as ``attack_type``."""
    return load_flows(spark, folder).transform(flow_features)


def train(
    table: DataFrame,
    features: Sequence[str],
    model_base: str,
    max_normal: int | None = None,
    max_labelled: int | None = None,
    detector_rows: str = "normal",
    detector_trees: int = iforest.TREES,
    classifier_trees: int = classify.TREES,
    max_depth: int = classify.MAX_DEPTH,
) -> dict[str, str]:
    """Fit both models on ``features`` and ``attack_type`` of ``table`` and save them.

    The table is written once with row numbers, so that the several passes below read columns of a
    fixed table and draw the same rows whatever happens to executors meanwhile. The detector learns
    from all normal rows, or ``max_normal`` of them, or from all rows with ``detector_rows="all"``; the
    classifier learns from all rows, or from ``max_labelled`` of them in proportion to class size.
    Intermediate tables are deleted when the job ends, or fails.
    """
    paths = {
        "detector": f"{model_base}/isolation_forest",
        "classifier": f"{model_base}/attack_classifier",
        "schema": f"{model_base}/features",
    }
    with job_workspace(table.sparkSession):
        _fit_both(
            table, features, paths, max_normal, max_labelled, detector_rows, detector_trees,
            classifier_trees, max_depth,
        )
    return paths


def _fit_both(
    table: DataFrame,
    features: Sequence[str],
    paths: dict[str, str],
    max_normal: int | None,
    max_labelled: int | None,
    detector_rows: str,
    detector_trees: int,
    classifier_trees: int,
    max_depth: int,
) -> None:
    spark = table.sparkSession
    rows = materialize(
        table.select(*features, "attack_type").withColumn(ROW_ID, F.monotonically_increasing_id()),
        "training",
    )
    base = normal_rows(rows) if detector_rows == "normal" else rows
    total, n_base = rows.count(), base.count()
    if n_base == 0:
        raise ValueError("No 'normal' rows to train the detector on.")
    labelled = rows
    if max_labelled is not None and total > max_labelled:
        labelled = sample_stratified(rows, [ROW_ID], max_rows=max_labelled)

    most = max_normal if detector_rows == "normal" else None
    detector = iforest.fit_isolation_forest(
        base, features, [ROW_ID], trees=detector_trees, max_rows=most
    )
    detector.save(spark, paths["detector"])
    classify.fit_classifier(
        labelled,
        features,
        path=paths["classifier"],
        trees=classifier_trees,
        max_depth=max_depth,
    )
    write_feature_schema(spark, features, paths["schema"])


def train_from_flows(spark: SparkSession, folder: str, model_base: str, **options) -> dict[str, str]:
    """Train on all flow CSV of a folder.

    The table ``quality`` beside the models has the rows read, kept, and dropped for a null or an
    infinity, counted by the pass that writes the training table.
    """
    kept = Observation("flows")
    flows = load_flows(spark, folder, kept)
    paths = train(flow_features(flows), feature_names(flows), model_base, **options)
    seen = kept.get
    counts = {"read": seen["rows"], "kept": seen["kept"], "dropped": seen["rows"] - seen["kept"]}
    return paths | {"quality": write_ledger(spark, "train_from_flows", counts, f"{model_base}/quality")}
