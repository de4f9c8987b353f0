"""Batch job: capture text to scored, labelled packets and a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import Classifier, load_classifier, predict_attack_types
from ..operators.features import packet_features
from ..operators.iforest import IsolationForestModel, load_isolation_forest, score_packets
from ..sources.packets import capture_window, parse_packets, read_lines, rejected_lines
from ..sources.schemas import PACKET_FEATURES, read_feature_schema, require_rows
from ..sources.workspace import job_workspace
from .ledger import observe_lines, write_ledger
from .reporting import generate_report


def analyze_packets(
    packets: DataFrame,
    detector: IsolationForestModel,
    classifier: Classifier,
    schema: Sequence[str] | None = None,
    keep: Sequence[str] = ("event_us",),
) -> DataFrame:
    """Parsed packets to features, scores and labels: one stage, no shuffle, batch or stream."""
    return (
        packet_features(packets, PACKET_FEATURES, keep)
        .transform(score_packets, detector, schema=schema)
        .transform(predict_attack_types, classifier, schema=schema)
    )


def run_batch(
    spark: SparkSession,
    capture: str | list[str],
    detector_path: str,
    classifier_path: str,
    report_base: str,
    seconds: float | None = None,
    schema: Sequence[str] | None = None,
    fields: Sequence[str] | None = None,
    predicate: str | Column | None = None,
    schema_path: str | None = None,
    results: str | None = None,
) -> dict[str, str]:
    """Analyze capture text files and write the report; an empty capture is an error.

    ``fields`` names the columns of the capture and ``predicate`` the packets wanted, in SQL or as a
    column such as ``is_web_packet()``. With ``results`` packets go to the result table there, by day. Model
    inputs are ``schema``, or the feature schema saved at ``schema_path``. Lines of another width than
    ``fields`` are written as the table ``rejects``, and counted by width in ``reject_counts``. The
    table ``quality`` counts the lines read, blank, rejected and parsed, in the pass that finds rejects.
    """
    lines = read_lines(spark, capture)
    packets = capture_window(parse_packets(lines, fields), seconds)
    if predicate is not None:
        packets = packets.filter(predicate)
    require_rows(packets, "analyze packets")
    if not schema and schema_path:
        schema = read_feature_schema(spark, schema_path)
    detector = load_isolation_forest(spark, detector_path)
    classifier = load_classifier(spark, classifier_path)
    order = ["event_us", "ip_src", "ip_dst"]
    with job_workspace(spark):
        result = analyze_packets(packets, detector, classifier, schema)
        paths = generate_report(result, report_base, order, results)
    paths |= {name: f"{paths['output_dir']}/{name}" for name in ("rejects", "reject_counts", "quality")}
    seen = Observation("lines")
    rejects = rejected_lines(observe_lines(lines, seen, fields), fields)
    rejects.write.parquet(paths["rejects"])
    written = spark.read.schema(rejects.schema).parquet(paths["rejects"])
    counts = written.groupBy("got_fields", "expected_fields").agg(F.count("*").alias("lines"))
    counts.coalesce(1).write.parquet(paths["reject_counts"])
    write_ledger(spark, "run_batch", seen.get, paths["quality"])
    return paths
