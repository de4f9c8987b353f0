"""Realtime job: arriving capture text to results, event lines, alerts and a final report.

Each step is a checkpointed append-only query on the table before it, so packets are parsed and
scored once and every table survives a restart:

lines -> results -> event_lines
                 -> instants, alerts
      -> rejects
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.classify import Classifier, load_classifier
from ..operators.iforest import IsolationForestModel, load_isolation_forest
from ..operators.report import event_lines, outcome_counts, prepare_report, preview
from ..operators.rules import flag_large_frames
from ..plans.analysis import analyze_packets
from ..plans.reporting import report_of_counts
from ..plans.results import DAY, capture_day
from ..sources.packets import parse_packets, rejected_lines, stream_lines
from .alerts import close_alerts, follow_alerts, stream_instants

PROGRESS_ROWS = 50
TABLES = ("results", "rejects", "event_lines", "progress", "instants", "alerts", "alert_state")


def stream_packets(
    spark: SparkSession,
    folder: str,
    fields: Sequence[str] | None = None,
    max_files: int | None = None,
    predicate: str | Column | None = None,
) -> DataFrame:
    """Packets of a folder that capture exports keep arriving in."""
    packets = parse_packets(stream_lines(spark, folder, max_files), fields)
    return packets if predicate is None else packets.filter(predicate)


def stream_rejects(
    spark: SparkSession,
    folder: str,
    fields: Sequence[str] | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Lines of the same folder that are no packets: neither blank nor as wide as ``fields``."""
    return rejected_lines(stream_lines(spark, folder, max_files), fields)


def realtime_results(
    packets: DataFrame,
    detector: IsolationForestModel,
    classifier: Classifier,
    schema: Sequence[str] | None = None,
    keep: Sequence[str] = ("event_us",),
) -> DataFrame:
    """Scores, labels and the rule, on a stream or a batch."""
    return analyze_packets(packets, detector, classifier, schema, keep).transform(flag_large_frames)


def with_progress(results: DataFrame, name: str = "progress") -> DataFrame:
    """Count packets per micro-batch; listeners read it as the query's observed metric."""
    return results.observe(name, F.count(F.lit(1)).alias("packets"))


def append_outcomes(
    results: DataFrame,
    path: str,
    trigger: dict,
    order: Sequence[str] = ("event_us", "ip_src", "ip_dst"),
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Start a query that keeps, for each batch, its packets by flag and type and its first rows.

    Both tables are small, however many packets came: ``path`` has ``(batch, is_anomaly, attack_type,
    packets)``, ``path``_first the rows that may be among the first. A batch that is run again replaces its rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        prepared = prepare_report(batch)
        outcome_counts(prepared).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")
        first = preview(prepared, [c for c in order if c in prepared.columns])
        first.coalesce(1).write.mode("overwrite").parquet(f"{path}_first/batch={number}")

    options = results.writeStream.option("checkpointLocation", checkpoint or f"{path}_checkpoint")
    return options.foreachBatch(write).trigger(**trigger).start()


def running_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Packets by flag and type of all batches so far: what the report's tables need, without a scan."""
    parts = spark.read.parquet(path)
    return parts.groupBy("is_anomaly", "attack_type").agg(F.sum("packets").alias("packets"))


def batch_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(batch, packets)`` from the same table."""
    return spark.read.parquet(path).groupBy("batch").agg(F.sum("packets").alias("packets"))


def progress_marks(counts: DataFrame, every: int = PROGRESS_ROWS) -> DataFrame:
    """``(batch, mark)``: each multiple of ``every`` that the total of packets has reached, and when.

    ``counts(batch, packets)`` has one row for each micro-batch, however many there were.
    """
    total = F.sum("packets").over(Window.orderBy("batch"))
    reached = counts.select(
        F.col("batch").cast("bigint").alias("batch"),
        F.floor((total - F.col("packets")) / every).alias("before"),
        F.floor(total / every).alias("after"),
    ).filter("after > before")
    numbers = F.sequence(F.col("before") + 1, F.col("after"))
    marks = F.transform(numbers, lambda n: (n * every).cast("bigint"))
    return reached.select("batch", F.explode(marks).alias("mark"))


def append_table(df: DataFrame, path: str, trigger: dict, by: Sequence[str] = ()) -> StreamingQuery:
    """Start an append-only parquet query with its checkpoint beside the table, in folders by ``by``."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy(*by)
        .option("path", path)
        .option("checkpointLocation", f"{path}_checkpoint")
        .trigger(**trigger)
        .start()
    )


def _append_results(results: DataFrame, path: str, trigger: dict, by_day: bool) -> StreamingQuery:
    """The results table; with ``by_day`` in a folder for each day of capture, which is a further column."""
    counted = with_progress(results)
    if not by_day:
        return append_table(counted, path, trigger)
    return append_table(counted.withColumn(DAY, capture_day()), path, trigger, by=[DAY])


def _stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that arrive in a table, by the columns of ``schema``."""
    return spark.readStream.schema(schema).parquet(path).select(*[f"`{c}`" for c in schema.names])


def run_realtime(
    spark: SparkSession,
    source: str,
    base: str,
    detector: IsolationForestModel | str,
    classifier: Classifier | str,
    schema: Sequence[str] | None = None,
    limits: dict[str, tuple[int, int]] | None = None,
    delay_seconds: int = 30,
    max_files: int | None = None,
    sensor: Column | None = None,
    report_base: str | None = None,
    fields: Sequence[str] | None = None,
    predicate: str | Column | None = None,
    time: Column | None = None,
    by_day: bool = False,
) -> dict[str, str]:
    """Process what has arrived in ``source`` to the end, and report when there are rows.

    Lines of another width than ``fields`` go to the table ``rejects``. Alerts take in all packets,
    those in blocks of time that are still open too. A later run on the same ``base`` goes on where
    this one ended, with packets of the same blocks as well. ``predicate`` is SQL or a column such as
    ``is_web_packet()``; ``by_day`` puts results in folders by day of capture. ``start_realtime`` is the same chain
    without an end.
    """
    if isinstance(detector, str):
        detector = load_isolation_forest(spark, detector)
    if isinstance(classifier, str):
        classifier = load_classifier(spark, classifier)
    once = {"availableNow": True}
    paths = {name: f"{base}/{name}" for name in TABLES}

    packets = stream_packets(spark, source, fields, max_files, predicate)
    results = realtime_results(packets, detector, classifier, schema)
    _append_results(results, paths["results"], once, by_day).awaitTermination()
    rejects = stream_rejects(spark, source, fields, max_files)
    append_table(rejects, paths["rejects"], once).awaitTermination()

    table = spark.read.schema(results.schema).parquet(paths["results"])
    if table.isEmpty():
        return paths
    start_followers(
        spark, results.schema, paths, once, limits, delay_seconds, sensor, wait=True, time=time
    )
    close_alerts(spark, paths, limits)
    if report_base:
        order = ["event_us", "ip_src", "ip_dst"]
        first = preview(spark.read.parquet(f"{paths['progress']}_first").drop("batch"), order)
        counts = running_outcomes(spark, paths["progress"])
        paths |= report_of_counts(counts, first, report_base) | {"data": paths["results"]}
    return paths


def start_followers(
    spark: SparkSession,
    schema,
    paths: dict[str, str],
    trigger: dict,
    limits: dict[str, tuple[int, int]] | None = None,
    delay_seconds: int = 30,
    sensor: Column | None = None,
    wait: bool = False,
    time: Column | None = None,
) -> list[StreamingQuery]:
    """Queries that follow the results table: event lines, progress, and instants with their alerts.

    ``time`` is what alerts go by, such as ``F.current_timestamp()`` for arrival.
    """

    def results() -> DataFrame:
        return _stream_table(spark, paths["results"], schema)

    points = stream_instants(results(), f"{delay_seconds} seconds", sensor, time)
    steps = [
        lambda: append_table(event_lines(results()), paths["event_lines"], trigger),
        lambda: append_outcomes(results(), paths["progress"], trigger),
        lambda: follow_alerts(points, paths, trigger, limits),
    ]
    queries = []
    for step in steps:
        queries.append(step())
        if wait:
            queries[-1].awaitTermination()
    return queries


def start_realtime(
    spark: SparkSession,
    source: str,
    base: str,
    detector: IsolationForestModel,
    classifier: Classifier,
    schema: Sequence[str] | None = None,
    limits: dict[str, tuple[int, int]] | None = None,
    delay_seconds: int = 30,
    interval: str = "10 seconds",
    sensor: Column | None = None,
    fields: Sequence[str] | None = None,
    predicate: str | Column | None = None,
    time: Column | None = None,
    by_day: bool = False,
) -> list[StreamingQuery]:
    """Start the whole chain with a processing-time trigger and return its queries."""
    trigger = {"processingTime": interval}
    paths = {name: f"{base}/{name}" for name in TABLES}
    packets = stream_packets(spark, source, fields, predicate=predicate)
    results = realtime_results(packets, detector, classifier, schema)
    first = _append_results(results, paths["results"], trigger, by_day)
    rejects = append_table(stream_rejects(spark, source, fields), paths["rejects"], trigger)
    rest = start_followers(
        spark, results.schema, paths, trigger, limits, delay_seconds, sensor, time=time
    )
    return [first, rejects, *rest]
