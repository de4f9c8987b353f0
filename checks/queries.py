"""One query per operator, each over the whole given tables. ``oracle.py`` has the SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from packetlens.functions import packets as PF
from packetlens.functions.labels import anomaly_flag
from packetlens.functions.text import number_or_zero
from packetlens.operators import (
    alerts,
    classify,
    features,
    flows,
    iforest,
    quantile,
    report,
    rules,
    sampling,
)
from packetlens.plans import analysis, reporting, results, training
from packetlens.sources import flows as flow_source
from packetlens.sources import packets as source
from packetlens.plans.ledger import write_ledger
from packetlens.sources.schemas import PACKET_FEATURES, model_columns, require_rows, write_feature_schema
from packetlens.sources.workspace import materialize, new_folder
from packetlens.streaming import alerts as stream_alert
from packetlens.streaming import realtime

from . import views
from .models import FlagClassifier, frozen_forest

ANOMALY_LIMIT = {"anomaly": (10_000_000, 5)}
TRAFFIC_LIMIT = {"traffic": (1_000_000, 5)}
SAMPLE_ROWS = 5000
# Lines that arrive in a second run.
LATE_LINES = "event_id % 3 = 0"

QUERIES = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


# --- inputs shared by several queries ---


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return source.parse_packets(views.lines(spark, sf), keep=["event_id"])


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return features.packet_features(_parsed(spark, sf), keep=["event_id", "event_us"])


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Analyzed packets, some of which have lost their label."""
    result = analysis.analyze_packets(
        _parsed(spark, sf), frozen_forest(), FlagClassifier(), keep=["event_id", "event_us"]
    )
    lost = F.when(F.col("event_id") % 103 != 0, F.col("attack_type"))
    return result.withColumn("attack_type", lost)


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.outcome_counts(report.prepare_report(_results(spark, sf)))


def _large(spark: SparkSession, sf: str) -> DataFrame:
    flag = (F.col("frame_len") > 1200).cast("int")
    return _features(spark, sf).withColumn("is_anomaly", flag)


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Features with a label that flags determine."""
    label = (
        F.when(F.col("tcp_flag_syn") == 1, "port_scan")
        .when(F.col("tcp_flag_rst") == 1, "ddos")
        .otherwise("normal")
    )
    return _features(spark, sf).withColumn("attack_type", label)


def _line_folder(spark: SparkSession, sf: str) -> str:
    folder = new_folder(spark, "lines")
    # Several files in time order, so that a stream has several batches.
    in_order = views.lines(spark, sf).repartitionByRange(8, "us").sortWithinPartitions("us")
    in_order.select("value").write.text(folder)
    return folder


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return flows.clean_flows(views.flows(spark, sf))


def _flow_csv(spark: SparkSession, sf: str) -> str:
    folder = new_folder(spark, "flows")
    writer = views.flows(spark, sf).write.option("header", True)
    writer.option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(folder)
    return folder


# Raw headers of the flow files, which come in two orders and have the packets' column twice.
RAW_NAMES = {
    "flow_id": "Flow ID", "source_ip": " Source IP", "destination_ip": " Destination IP",
    "timestamp": "Timestamp", "destination_port": " Destination Port ", "flow_duration": "Flow Duration",
    "total_fwd_packets": " Total Fwd Packets", "flow_bytes_s": "Flow Bytes/s",
    "state_name": "STATE NAME", "label": " Label",
}


def _raw_flow_folder(spark: SparkSession, sf: str) -> str:
    """Flow CSV as it comes: raw headers in two orders, a repeated one, cells with line breaks."""
    folder = new_folder(spark, "raw-flows")
    rows = views.flows(spark, sf).withColumn("odd", F.col("total_fwd_packets") % 2)
    broken = F.concat(F.lit('"'), F.col("state_name"), F.lit('\n""x"""'))
    rows = rows.withColumn("state_name", F.when(F.col("odd") == 1, broken).otherwise(F.col("state_name")))
    for odd, order in ((0, list(RAW_NAMES)), (1, [*reversed(RAW_NAMES)])):
        names = [*order, "total_fwd_packets"]
        header = ",".join(RAW_NAMES[n] for n in names)
        cells = [F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names]
        lines = rows.filter(F.col("odd") == odd).select(F.concat_ws(",", *cells).alias("value"))

        def with_header(batches, header=header):
            headed = False
            for batch in batches:
                if not headed:
                    yield pa.RecordBatch.from_arrays([pa.array([header], batch.schema[0].type)], schema=batch.schema)
                yield batch
                headed = True

        lines.mapInArrow(with_header, "value string").write.mode("append").text(folder)
    return folder


# --- scans ---


@query
def packet_parse(spark, sf):
    return _parsed(spark, sf)


@query
def packet_stream_parse(spark, sf):
    base = new_folder(spark, "stream")
    packets = realtime.stream_packets(spark, _line_folder(spark, sf), max_files=2)
    realtime.append_table(packets, base, {"availableNow": True}).awaitTermination()
    return spark.read.schema(packets.schema).parquet(base)


@query
def packet_rejects(spark, sf):
    return source.rejected_lines(views.lines(spark, sf), keep=["event_id"])


@query
def select_fields(spark, sf):
    return source.select_fields(_parsed(spark, sf), ["frame.len", "ip.src"], keep=["event_id"])


@query
def first_occurrence(spark, sf):
    twice = F.when(F.col("event_id") % 7 == 0, F.concat_ws(",", "ip_src", "ip_dst"))
    repeated = _parsed(spark, sf).withColumn("ip_src", F.coalesce(twice, F.col("ip_src")))
    return source.first_occurrence(repeated, ["ip_src"]).select("event_id", "ip_src")


@query
def web_traffic_filter(spark, sf):
    at = F.col("event_id") % 5
    port = F.when(at == 0, 80).when(at == 1, 443).when(at == 2, 22).when(at == 3, 53).otherwise(8080)
    ported = views.packets(spark, sf).withColumns(
        {
            "tcp_srcport": (1024 + F.col("event_id") % 60000).cast("string"),
            "tcp_dstport": port.cast("string"),
        }
    )
    return source.web_traffic(ported).select("event_id", "ip_src", "tcp_srcport", "tcp_dstport")


@query
def capture_window(spark, sf):
    return source.capture_window(_parsed(spark, sf), 600).select("event_id", "frame_time_epoch")


@query
def flow_scan(spark, sf):
    table = flow_source.read_flows(spark, _flow_csv(spark, sf))
    infinite = F.abs("flow_bytes_s") == float("inf")
    return table.withColumn("is_inf", F.coalesce(infinite, F.lit(False)).cast("int")).withColumn(
        "flow_bytes_s", F.when(F.col("is_inf") == 0, F.col("flow_bytes_s"))
    )


# --- projections and scalar functions ---


@query
def cast_numeric(spark, sf):
    at = F.col("event_id") % 17
    texts = [
        "", " 12 ", "1e3", "+5", "12.", ".5", "0x1F", "1_000", "1,000", "nan", "inf", "-Infinity",
        "5d", "5.f", "True", "-7.25",
    ]
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (at + 1).cast("int"))
    text = F.when(at < len(texts), text).otherwise(F.col("value").cast("decimal(12,2)").cast("string"))
    number = number_or_zero(F.col("text"))
    return (
        views.table(spark, sf, "events")
        .select("event_id", F.when(at < 16, text).otherwise(text).alias("text"))
        .select(
            "event_id",
            F.when(F.abs(number) == float("inf"), 0.0).otherwise(number).alias("number"),
            F.when(number == float("inf"), 1)
            .when(number == float("-inf"), -1)
            .otherwise(0)
            .alias("infinite"),
        )
    )


@query
def tcp_flags(spark, sf):
    at = F.col("event_id") % 8
    text = (
        F.when(at == 0, F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.col("event_id") % 4096)), 4, "0")))
        .when(at == 1, F.hex(F.col("event_id") % 4096))
        .when(at == 2, F.concat(F.lit(" 0X"), F.hex(F.col("event_id") % 64), F.lit("\t")))
        .when(at == 3, "")
        .when(at == 4, "not_a_number")
        .when(at == 5, "0x")
        .when(at == 6, "-0x2")
    )
    mask = PF.tcp_flag_mask(F.col("text"))
    return (
        views.table(spark, sf, "events")
        .select("event_id", text.alias("text"))
        .select("event_id", mask.alias("mask"), *[PF.has_flag(mask, n).alias(n) for n in PF.TCP_FLAG_BITS])
    )


@query
def packet_features(spark, sf):
    return _features(spark, sf)


@query
def select_features(spark, sf):
    wanted = ["frame_len", "no_such_feature", "hour_of_day"]
    packets = _parsed(spark, sf)
    return features.packet_features(packets, wanted, keep=["event_id"])


@query
def flow_clean(spark, sf):
    return _clean(spark, sf)


@query
def flow_labels(spark, sf):
    named = flows.normalize_labels(_clean(spark, sf))
    return named.groupBy("label").agg(F.count("*").alias("flows"))


@query
def flow_features(spark, sf):
    return flows.flow_features(_clean(spark, sf), keep=("flow_id",))


@query
def filter_anomalies(spark, sf):
    return iforest.filter_anomalies(_results(spark, sf)).select("event_id", "is_anomaly", "ip_src")


@query
def normalize_flag(spark, sf):
    n = F.col("event_id")
    words = ["1", " TRUE ", "t", "Yes", "y", "Anomaly", "anomalous", "1.0", "no", ""]
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (n % 10 + 1).cast("int"))
    raw = views.table(spark, sf, "events").select(
        "event_id",
        F.when(n % 7 != 0, n % 3 == 0).alias("as_bool"),
        F.when(n % 11 == 0, float("nan")).when(n % 7 != 0, (n % 4 - 1).cast("double")).alias("as_number"),
        F.when(n % 13 != 0, word).alias("as_text"),
    )
    kinds = ["as_bool", "as_number", "as_text"]
    return raw.select(
        "event_id", *[anomaly_flag(F.col(c), raw.schema[c].dataType).alias(c) for c in kinds]
    )


@query
def report_prepare(spark, sf):
    return report.prepare_report(_results(spark, sf)).select("event_id", "is_anomaly", "attack_type")


@query
def rule_fallback(spark, sf):
    quiet = _features(spark, sf).withColumns(
        {
            "is_anomaly": (F.col("event_id") % 4 == 0).cast("int"),
            "attack_type": F.lit("normal"),
            "attack_confidence": F.lit(1.0),
        }
    )
    return rules.flag_large_frames(quiet).select(
        "event_id", "frame_len", "is_anomaly", "attack_type", "attack_confidence"
    )


@query
def schema_fallback_detect(spark, sf):
    wanted = ["flow_duration", "frame_len"]
    scored = iforest.score_packets(_features(spark, sf), frozen_forest(), schema=wanted)
    return scored.select("event_id", "is_anomaly", "anomaly_score")


@query
def schema_fallback_classify(spark, sf):
    labelled = classify.predict_attack_types(
        _large(spark, sf), FlagClassifier(), schema=["flow_duration"]
    )
    return labelled.select("event_id", "is_anomaly", "attack_type", "attack_confidence")


@query
def event_lines(spark, sf):
    return report.event_lines(_results(spark, sf)).select("event_id", "line")


# --- aggregates, top-k, union, sampling ---


@query
def traffic_distribution(spark, sf):
    return report.traffic_distribution(_counts(spark, sf))


@query
def attack_distribution(spark, sf):
    return report.attack_distribution(_counts(spark, sf))


@query
def attack_share(spark, sf):
    return report.attack_share(_counts(spark, sf))


@query
def attack_summary(spark, sf):
    return report.attack_summary(_results(spark, sf))


@query
def report_payload(spark, sf):
    return report.report_payload(_counts(spark, sf)).select(
        "metadata.total_packets",
        "metadata.anomalies",
        "summary.normal",
        "summary.anomaly",
        F.explode("attack_distribution").alias("attack_type", "packets"),
    )


@query
def progress_counts(spark, sf):
    packets = realtime.stream_packets(spark, _line_folder(spark, sf), max_files=1)
    out = new_folder(spark, "progress")
    judged = packets.withColumns({"is_anomaly": F.lit(0), "attack_type": F.lit("normal")})
    realtime.append_outcomes(judged, out, {"availableNow": True}).awaitTermination()
    return realtime.progress_marks(realtime.batch_counts(spark, out)).select("mark")


@query
def report_preview(spark, sf):
    return report.preview(_results(spark, sf), ["event_us", "event_id"]).select(
        "event_id", "event_us", "ip_src", "is_anomaly", "attack_type"
    )


@query
def union_batches(spark, sf):
    packets = _parsed(spark, sf)
    tcp = packets.filter("ip_proto = '6'").select("event_id", "ip_src", "tcp_flags")
    other = packets.filter("ip_proto <> '6'").select("ip_proto", "ip_src", "event_id")
    return flows.union_by_name([tcp, other])


@query
def sample_normal(spark, sf):
    table = flows.flow_features(_clean(spark, sf), keep=("flow_id",))
    return sampling.sample_uniform(sampling.normal_rows(table), SAMPLE_ROWS, ["flow_id"])


@query
def sample_stratified(spark, sf):
    table = flows.flow_features(_clean(spark, sf), keep=("flow_id",))
    return sampling.sample_stratified(table, ["flow_id"], max_rows=SAMPLE_ROWS)


# --- windows and alerts ---


@query
def anomaly_window_count(spark, sf):
    counted = alerts.with_window_counts(_large(spark, sf), 10_000_000, "anomalies")
    return counted.select("event_id", "event_us", F.col("window_count").alias("anomalies"))


@query
def traffic_rate(spark, sf):
    counted = alerts.with_window_counts(_large(spark, sf), 1_000_000, "packets")
    rate = F.col("window_count").cast("double") / 1
    return counted.select("event_id", "event_us", rate.alias("packets_per_second"))


@query
def anomaly_alerts(spark, sf):
    return alerts.find_alerts(alerts.instants(_large(spark, sf)), ANOMALY_LIMIT)


@query
def traffic_alerts(spark, sf):
    return alerts.find_alerts(alerts.instants(_large(spark, sf)), TRAFFIC_LIMIT)


@query
def stream_alerts(spark, sf):
    packets = realtime.stream_packets(spark, _line_folder(spark, sf))
    flag = (F.col("frame_len") > 1200).cast("int")
    flagged = features.packet_features(packets, keep=["event_us"]).withColumn("is_anomaly", flag)
    limits, paths = ANOMALY_LIMIT | TRAFFIC_LIMIT, _alert_paths(spark)
    points = stream_alert.stream_instants(flagged)
    stream_alert.follow_alerts(points, paths, {"availableNow": True}, limits).awaitTermination()
    return stream_alert.close_alerts(spark, paths, limits)


def _alert_paths(spark: SparkSession) -> dict[str, str]:
    base = new_folder(spark, "alerts")
    return {name: f"{base}/{name}" for name in ("instants", "alerts", "alert_state")}


@query
def late_packets(spark, sf):
    """A third of the early packets come when all others have come: those of closed blocks are late."""
    folder, paths = new_folder(spark, "lines"), _alert_paths(spark)
    lines = views.lines(spark, sf).withColumn("last", F.expr(LATE_LINES))
    for last in (False, True):
        lines.filter(F.col("last") == last).select("value").write.mode("append").text(folder)
        packets = realtime.stream_packets(spark, folder)
        flagged = features.packet_features(packets, keep=["event_us", "ip_dst"]).withColumn("is_anomaly", F.lit(1))
        points = stream_alert.stream_instants(flagged, sensor=F.col("ip_dst"))
        stream_alert.follow_alerts(points, paths, {"availableNow": True}).awaitTermination()
    found = stream_alert.late_packets(spark, paths)
    held = stream_alert.open_instants(spark, paths).groupBy("sensor").agg(F.sum("packets").alias("n"))
    # In time and late ones and those still held are all there are.
    total = F.expr("late_packets + closed_packets + coalesce(n, 0)").alias("packets")
    return found.join(held, "sensor", "left").select("sensor", "late_packets", total)


# --- models ---


@query
def iforest_score_frozen(spark, sf):
    scored = iforest.score_packets(_features(spark, sf), frozen_forest())
    return scored.select("event_id", "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"))


@query
def iforest_threshold(spark, sf):
    scores = frozen_forest().score(spark, PACKET_FEATURES)
    table = _features(spark, sf).select(scores.alias("score"))
    threshold = quantile.exact_quantile(materialize(table, "scores"), "score", 0.2)
    return table.limit(1).select(F.round(F.lit(threshold), 6).alias("threshold"))


@query
def detect_anomalies(spark, sf):
    path = frozen_forest().save(spark, new_folder(spark, "model"))
    scored = iforest.detect_anomalies(_features(spark, sf), path)
    return scored.select("event_id", "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"))


@query
def iforest_train_score(spark, sf):
    table = _features(spark, sf)
    model = iforest.fit_isolation_forest(table, PACKET_FEATURES, ["event_id"])
    scored = iforest.score_packets(table, model)
    within = F.col("anomaly_score").between(-1 - model.offset, -model.offset)
    same = (F.col("anomaly_score") < 0) == (F.col("is_anomaly") == 1)
    totals = scored.agg(
        F.count("*").alias("packets"),
        F.count_if(within).alias("in_range"),
        F.count_if(same).alias("flag_is_sign"),
        F.avg("is_anomaly").alias("share"),
    )
    # Scores below the offset are at most the wanted share; ties at the offset are not flagged.
    return totals.select("packets", "in_range", "flag_is_sign", (F.col("share") <= 0.2).alias("share_met"))


@query
def model_roundtrip(spark, sf):
    table = _features(spark, sf)
    model = iforest.fit_isolation_forest(table, PACKET_FEATURES, ["event_id"])
    again = iforest.load_isolation_forest(spark, model.save(spark, new_folder(spark, "model")))
    scores = table.select(
        "event_id",
        model.score(spark, PACKET_FEATURES).alias("fitted"),
        again.score(spark, PACKET_FEATURES).alias("loaded"),
    )
    return scores.select("event_id", (F.col("fitted") == F.col("loaded")).alias("same"))


@query
def rf_train_predict(spark, sf):
    table = _labelled(spark, sf)
    model = classify.fit_classifier(table, PACKET_FEATURES)
    flagged = table.withColumnRenamed("attack_type", "label").withColumn("is_anomaly", F.lit(1))
    return classify.predict_attack_types(flagged, model).select("event_id", "label", "attack_type")


@query
def classify_merge(spark, sf):
    labelled = classify.predict_attack_types(_large(spark, sf), FlagClassifier())
    return labelled.select("event_id", "is_anomaly", "attack_type", "attack_confidence")


# --- jobs ---


@query
def batch_analysis(spark, sf):
    path = frozen_forest().save(spark, new_folder(spark, "model"))
    detector = iforest.load_isolation_forest(spark, path)
    folder = _line_folder(spark, sf)
    packets = source.parse_packets(source.read_lines(spark, folder))
    result = analysis.analyze_packets(packets, detector, FlagClassifier())
    return result.withColumn("anomaly_score", F.round("anomaly_score", 6))


def _run_batch(spark, sf, **options):
    detector = frozen_forest().save(spark, new_folder(spark, "model"))
    model = classify.fit_classifier(_labelled(spark, sf), PACKET_FEATURES)
    reports = new_folder(spark, "reports")
    return analysis.run_batch(spark, _line_folder(spark, sf), detector, model.path, reports, **options)


@query
def batch_job(spark, sf):
    schema = write_feature_schema(spark, PACKET_FEATURES, new_folder(spark, "schema"))
    paths = _run_batch(spark, sf, schema_path=schema, predicate="ip_src <> ''")
    return spark.read.parquet(paths["data"]).select("event_us", "ip_src", "is_anomaly", "attack_type")


@query
def batch_job_rejects(spark, sf):
    return spark.read.parquet(_run_batch(spark, sf)["rejects"])


@query
def realtime_job(spark, sf):
    paths = realtime.run_realtime(
        spark, _line_folder(spark, sf), new_folder(spark, "realtime"), frozen_forest(), FlagClassifier()
    )
    return spark.read.parquet(paths["results"]).withColumn(
        "anomaly_score", F.round("anomaly_score", 6)
    )


@query
def running_report(spark, sf):
    """Shares from the counts that batches leave behind; a batch that is run again changes nothing."""
    base = new_folder(spark, "running")
    packets = realtime.stream_packets(spark, _line_folder(spark, sf))
    results = realtime.realtime_results(packets, frozen_forest(), FlagClassifier())
    for attempt in ("first", "again"):
        query = realtime.append_outcomes(
            results, f"{base}/outcomes", {"availableNow": True}, checkpoint=f"{base}/{attempt}"
        )
        query.awaitTermination()
    return report.attack_share(realtime.running_outcomes(spark, f"{base}/outcomes"))


@query
def realtime_alerts(spark, sf):
    """The alerts table of the realtime job itself."""
    paths = realtime.run_realtime(
        spark, _line_folder(spark, sf), new_folder(spark, "realtime"), frozen_forest(), FlagClassifier(),
        limits=ANOMALY_LIMIT | TRAFFIC_LIMIT,
    )
    return stream_alert.alerts_table(spark, paths)


@query
def report_tables(spark, sf):
    paths = reporting.generate_report(
        _results(spark, sf), new_folder(spark, "report"), order=["event_us", "event_id"]
    )
    return spark.read.parquet(paths["attack_share"])


def _result_table(spark: SparkSession, sf: str) -> str:
    """The result table after a run on flagged packets, one on all, and one on those of the last day again."""
    # Analyzed once for the three runs, each of which reads its packets several times.
    table, packets = new_folder(spark, "by-day"), materialize(_results(spark, sf), "analyzed")
    day = results.capture_day()
    last = packets.agg(F.max(day)).first()[0]
    for part in (packets.filter("is_anomaly = 1"), packets, packets.filter(day == F.lit(last))):
        reporting.generate_report(
            part, new_folder(spark, "report"), order=["event_us", "event_id"], results=table
        )
    return table


@query
def results_by_day(spark, sf):
    """Runs that replace days leave each packet once, under its day."""
    packets = results.read_results(spark, _result_table(spark, sf))
    day = F.col("capture_date").cast("string").alias("capture_date")
    return packets.select("event_id", day, "is_anomaly", "attack_type")


@query
def results_daily(spark, sf):
    """Packets and anomalies of each day, from the manifests of the runs."""
    counts = results.daily_counts(spark, _result_table(spark, sf))
    return counts.withColumn("capture_date", F.col("capture_date").cast("string"))


@query
def results_json(spark, sf):
    path = reporting.results_to_json(_results(spark, sf), new_folder(spark, "results"))
    types = "event_id bigint, `ip.src` string, is_anomaly int, attack_type string"
    return spark.read.schema(types).json(f"{path}/data").withColumnRenamed("ip.src", "ip_src")


@query
def train_job(spark, sf):
    paths = training.train(
        _labelled(spark, sf), PACKET_FEATURES, new_folder(spark, "models"), detector_rows="all"
    )
    detector = iforest.load_isolation_forest(spark, paths["detector"])
    classifier = classify.load_classifier(spark, paths["classifier"])
    result = analysis.analyze_packets(_parsed(spark, sf), detector, classifier)
    # Flags decide the label it learned from, so every flagged packet must get that label back.
    flagged = F.col("is_anomaly") == 1
    learned = (
        F.when(~flagged, "normal")
        .when(F.col("tcp_flag_syn") == 1, "port_scan")
        .when(F.col("tcp_flag_rst") == 1, "ddos")
        .otherwise("normal")
    )
    return result.agg(
        F.count("*").alias("packets"),
        F.count_if(F.col("attack_type") == learned).alias("as_learned"),
        (F.avg("is_anomaly") <= 0.2).alias("share_met"),
    )


@query
def flow_load(spark, sf):
    """Raw files to cleaned flows: headers found, repeated ones numbered, normalized, united, typed."""
    return training.load_flows(spark, _raw_flow_folder(spark, sf), pattern="*.txt")


@query
def quality_ledger(spark, sf):
    """What the batch job and a flow load read, kept, rejected and dropped."""
    job = spark.read.parquet(_run_batch(spark, sf)["quality"])
    kept = Observation("flows")
    materialize(training.load_flows(spark, _raw_flow_folder(spark, sf), kept, "*.txt"), "flows")
    seen = kept.get
    path = new_folder(spark, "quality")
    write_ledger(spark, "load_flows", {"read": seen["rows"], "kept": seen["kept"]}, path)
    return job.unionByName(spark.read.parquet(path))


@query
def guards(spark, sf):
    """Each guard's outcome on the given tables: rows it lets through, or its refusal."""
    table, packets = views.flows(spark, sf), _features(spark, sf)
    scored = packets.withColumn("is_anomaly", F.lit(0))

    def columns(*explicit, **options):
        return lambda df: df.select(*model_columns(df, *explicit, **options))

    cases = {
        "label required, there": (table, lambda df: flows.clean_flows(df)),
        "label required, absent": (table.drop("label"), lambda df: flows.clean_flows(df)),
        "report columns required, absent": (packets, lambda df: report.prepare_report(df)),
        "rows required, there": (packets, lambda df: require_rows(df, "go on") or df),
        "rows required, none": (packets.filter("event_us < 0"), lambda df: require_rows(df, "go on") or df),
        "inputs by name": (scored, columns(["frame_len"], ["ip_proto"], ["is_tcp"])),
        "inputs of the schema": (scored, columns(None, ["ip_proto"], ["is_tcp"])),
        "inputs of the model": (scored, columns(None, None, ["is_tcp"])),
        "inputs that are numbers": (scored, columns()),
        "no inputs": (table.select("flow_id"), columns()),
    }
    outcomes = []
    for case, (df, guard) in cases.items():
        try:
            passed = guard(df)
            kept = passed.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(passed.columns)).alias("columns"))
        except ValueError:
            kept = spark.range(1).select(F.lit(-1).cast("bigint").alias("rows"), F.lit(-1).alias("columns"))
        outcomes.append(kept.select(F.lit(case).alias("guard"), "rows", "columns"))
    return flows.union_by_name(outcomes)


@query
def train_flow_job(spark, sf):
    folder = _flow_csv(spark, sf)
    paths = training.train_from_flows(spark, folder, new_folder(spark, "models"))
    table = training.load_flow_features(spark, folder).drop("attack_type")
    scored = iforest.detect_anomalies(table, paths["detector"])
    merged = classify.classify_attacks(scored, paths["classifier"]).withColumnsRenamed(
        {"is_anomaly": "flagged", "attack_type": "merged", "attack_confidence": "sure"}
    )
    # Once more with every row flagged: each gets its predicted label, which its features decide.
    every = classify.classify_attacks(
        merged.withColumn("is_anomaly", F.lit(1)), paths["classifier"], schema=table.columns
    )
    wanted = F.when(F.col("flagged") == 1, F.col("attack_type")).otherwise("normal")
    return every.select(
        *table.columns,
        F.col("attack_type").alias("predicted"),
        (F.col("merged") == wanted).alias("merged_right"),
    )
