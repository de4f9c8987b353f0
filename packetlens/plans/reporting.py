"""Report sinks. The packets are computed and written once; everything else reads that table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report
from ..sources.schemas import path_exists, require_rows
from ..sources.workspace import job_workspace, materialize
from .results import run_results, write_results

# Capture names of columns that carry another name inside Spark.
SINK_NAMES = {"ip_src": "ip.src", "ip_dst": "ip.dst"}


def sink_names(df: DataFrame) -> DataFrame:
    """Columns under their capture names, for files that leave Spark."""
    return df.withColumnsRenamed(SINK_NAMES)


def results_to_json(df: DataFrame, path: str) -> str:
    """One JSON record per packet under ``path``/data and the totals under ``path``/summary."""
    prepared = report.prepare_report(df)
    with job_workspace(df.sparkSession):
        # Computed once into a columnar table, of which the counts read two columns.
        table = materialize(prepared, "results")
        require_rows(table, "write results")
        sink_names(table).write.option("ignoreNullFields", False).json(f"{path}/data")
        _write_summary(report.outcome_counts(table), f"{path}/summary")
    return path


def _write_summary(counts: DataFrame, path: str) -> None:
    stamp = F.struct(
        F.lit(datetime.now().isoformat(timespec="seconds")).alias("timestamp"), "metadata.*"
    )
    payload = report.report_payload(counts).withColumn("metadata", stamp)
    payload.coalesce(1).write.json(path)


def _report_folder(df: DataFrame, base: str) -> str:
    run = f"{base.rstrip('/')}/{datetime.now().strftime('%Y-%m-%d_%H-%M-%S')}"
    if path_exists(df.sparkSession, run):  # another report started in the same second
        run = f"{run}_{uuid.uuid4().hex[:8]}"
    return run


def _write_tables(counts: DataFrame, first: DataFrame, run: str) -> dict[str, str]:
    names = ["summary", "traffic", "attack_distribution", "attack_share", "preview"]
    paths = {name: f"{run}/{name}" for name in names}
    counts = counts.persist()
    try:
        _write_summary(counts, paths["summary"])
        for name, table in {
            "traffic": report.traffic_distribution(counts),
            "attack_distribution": report.attack_distribution(counts),
            "attack_share": report.attack_share(counts),
        }.items():
            table.coalesce(1).write.parquet(paths[name])
    finally:
        counts.unpersist()
    first.coalesce(1).write.parquet(paths["preview"])
    return {"output_dir": run, **paths}


def report_of_counts(counts: DataFrame, first: DataFrame, base: str) -> dict[str, str]:
    """The report tables from packets by flag and type and the previewed rows, both already known."""
    return _write_tables(counts, first, _report_folder(counts, base))


def generate_report(
    df: DataFrame, base: str, order: Sequence[str] = (), results: str | None = None
) -> dict[str, str]:
    """Write the report tables under ``base``/YYYY-MM-DD_HH-MM-SS and return their paths.

    ``data`` is columnar, so the counts read two columns of it back; they are then a few rows.
    ``order`` names the columns whose order defines the previewed first rows. With ``results`` the
    packets replace their days of the result table there instead (``write_results``), and the paths
    have its ``results`` and the name of the ``run`` in place of ``data``.
    """
    spark, folder = df.sparkSession, _report_folder(df, base)
    prepared = report.prepare_report(df)
    require_rows(prepared, "generate a report")
    if results:
        run = write_results(prepared, results)
        written, where = run_results(spark, results, run), {"results": results, "run": run}
    else:
        prepared.write.parquet(f"{folder}/data")
        written, where = spark.read.schema(prepared.schema).parquet(f"{folder}/data"), {"data": f"{folder}/data"}
    data = written.select(*[f"`{c}`" for c in prepared.columns])
    first = report.preview(data, [c for c in order or data.columns if c in data.columns])
    return _write_tables(report.outcome_counts(data), first, folder) | where


def read_summary(spark, path: str) -> dict:
    """The summary record of a report as a dictionary."""
    return json.loads(spark.read.text(path).first().value)
