"""The same results in SQL that DuckDB runs over the given tables."""

from __future__ import annotations

from .views import DUCKDB, flows_sql, lines_sql, packets_sql

_LINES = lines_sql(DUCKDB, "events")
_FLOWS = flows_sql(DUCKDB, "lineitem")

_PARSED = f"""
select event_id, us, a[1] as ip_src, a[2] as ip_dst, a[3] as frame_len, a[4] as frame_time_epoch,
  a[5] as tcp_flags, a[6] as ip_proto
from (select event_id, us, string_split(value, chr(9)) as a from ({_LINES})) where len(a) = 6
"""

_FEATURES = f"""
select event_id, cast(round(epoch * 1000000) as bigint) as event_us, ip_src, ip_dst, frame_len, ip_proto,
  cast(ip_proto = 6 as integer) as is_tcp, cast(ip_proto = 17 as integer) as is_udp,
  cast(flags & 2 <> 0 as integer) as tcp_flag_syn, cast(flags & 16 <> 0 as integer) as tcp_flag_ack,
  cast(flags & 1 <> 0 as integer) as tcp_flag_fin, cast(flags & 4 <> 0 as integer) as tcp_flag_rst,
  cast(flags & 8 <> 0 as integer) as tcp_flag_psh,
  cast(((cast(floor(round(epoch, 9) / 3600) as bigint) % 24) + 24) % 24 as integer) as hour_of_day
from (select event_id, ip_src, ip_dst, coalesce(try_cast(frame_len as double), 0) as frame_len,
        coalesce(try_cast(ip_proto as double), 0) as ip_proto,
        coalesce(try_cast(frame_time_epoch as double), 0) as epoch,
        case when tcp_flags = '' then 0 else cast(tcp_flags as bigint) end as flags
      from ({_PARSED}))
"""


def _c(n: int) -> str:
    return f"(2 * (ln({n} - 1) + 0.5772156649015329) - 2.0 * ({n} - 1) / {n})"


_SCORED = f"""
select *, cast(score + 0.55 < 0 as integer) as is_anomaly, round(score + 0.55, 6) as anomaly_score
from (select *, -power(2, -((
    case when frame_len <= 1000 then 1 + {_c(200)} when hour_of_day <= 6 then 2 + {_c(6)}
         else 2 + {_c(50)} end
    + case when is_tcp <= 0.5 then 1 + {_c(56)} else 1 + {_c(200)} end) / 2) / {_c(256)}) as score
  from ({_FEATURES}))
"""

_ANALYZED = f"""
select * exclude (score),
  case when is_anomaly = 1 then case when tcp_flag_syn = 1 then 'port_scan' else 'ddos' end
       else 'normal' end as attack_type,
  case when is_anomaly = 1 then cast(event_us % 101 as double) / 100 else 1.0 end as attack_confidence
from ({_SCORED})
"""

_RESULTS = f"""
select * replace (case when event_id % 103 <> 0 then attack_type end as attack_type) from ({_ANALYZED})
"""

_REPORT = f"""
select * replace (coalesce(attack_type, 'unknown') as attack_type) from ({_RESULTS})
"""

_LARGE = f"select *, cast(frame_len > 1200 as integer) as is_anomaly from ({_FEATURES})"

_CLEAN = f"""
select * from ({_FLOWS}) where flow_id is not null and source_ip is not null and destination_ip is not null
  and "timestamp" is not null and destination_port is not null and isfinite(flow_duration)
  and total_fwd_packets is not null and isfinite(flow_bytes_s) and state_name is not null and label is not null
"""

_FLOW_FEATURES = f"""
select flow_id, destination_port, flow_duration, total_fwd_packets, flow_bytes_s,
  case when lab = 'benign' then 'normal' else lab end as attack_type
from (select *, replace(lower(trim(label)), ' ', '_') as lab from ({_CLEAN}))
"""

_FLOW_COLUMNS = "flow_id, destination_port, flow_duration, total_fwd_packets, flow_bytes_s, attack_type"


def _alerts(kind: str, message: str, chosen: str, window_us: int, k: int, rows: str = _LARGE) -> str:
    return f"""
with recursive ev as (
  select event_us, row_number() over (order by event_us, event_id) as rn from ({rows}) where {chosen}),
cand as (
  select event_us, rn from (select event_us, rn, event_us - lag(event_us, {k}) over (order by rn) as g from ev)
  where g <= {window_us}),
pick(rn) as (
  select min(rn) from cand
  union all
  select (select min(rn) from cand where cand.rn >= pick.rn + {k + 1}) from pick where pick.rn is not null)
select 'all' as sensor, '{kind}' as kind, cand.event_us, cand.rn, cast({k + 1} as bigint) as count,
  '{message}' as message
from pick join cand using (rn)
"""


_ANOMALY_ALERTS = _alerts("anomaly", "🚨 High anomaly rate detected", "is_anomaly = 1", 10_000_000, 5)
_TRAFFIC_ALERTS = _alerts("traffic", "⚠️ Traffic spike detected", "true", 1_000_000, 5)

_LIVE = f"""
select event_id, event_us, cast(is_anomaly = 1 or frame_len > 1200 as integer) as is_anomaly from ({_ANALYZED})
"""
_LIVE_ANOMALY = _alerts("anomaly", "🚨 High anomaly rate detected", "is_anomaly = 1", 10_000_000, 5, _LIVE)
_LIVE_TRAFFIC = _alerts("traffic", "⚠️ Traffic spike detected", "true", 1_000_000, 5, _LIVE)

_DECIMAL = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"

ORACLE = {
    "batch_job": f"""
select event_us, ip_src, is_anomaly, case when is_anomaly = 0 then 'normal' when tcp_flag_syn = 1 then 'port_scan'
  when tcp_flag_rst = 1 then 'ddos' else 'normal' end as attack_type from ({_SCORED}) where ip_src <> ''""",
    "batch_job_rejects": f"""
select value, cast(len(string_split(value, chr(9))) as integer) as got_fields, 6 as expected_fields
from ({_LINES}) where len(string_split(value, chr(9))) <> 6""",
    "progress_counts": f"""
select unnest(range(50, n + 1, 50)) as mark from (select count(*) as n from ({_PARSED}))""",
    "iforest_train_score": f"""
select count(*) as packets, count(*) as in_range, count(*) as flag_is_sign, true as share_met
from ({_FEATURES})""",
    "model_roundtrip": f"select event_id, true as same from ({_FEATURES})",
    "rf_train_predict": f"""
select event_id, label, label as attack_type
from (select event_id, case when tcp_flag_syn = 1 then 'port_scan' when tcp_flag_rst = 1 then 'ddos'
        else 'normal' end as label from ({_FEATURES}))""",
    "train_job": f"select count(*) as packets, count(*) as as_learned, true as share_met from ({_FEATURES})",
    "train_flow_job": f"""
select cast(destination_port as double) as destination_port, flow_duration,
  cast(total_fwd_packets as double) as total_fwd_packets, flow_bytes_s, attack_type as predicted,
  true as merged_right from ({_FLOW_FEATURES})""",
    "packet_parse": f"select * exclude (us) from ({_PARSED})",
    "packet_stream_parse": f"select * exclude (us, event_id) from ({_PARSED})",
    "packet_rejects": f"""
select event_id, value, cast(len(string_split(value, chr(9))) as integer) as got_fields, 6 as expected_fields
from ({_LINES}) where len(string_split(value, chr(9))) <> 6""",
    "select_fields": f"select event_id, frame_len, ip_src from ({_PARSED})",
    "first_occurrence": f"""
select event_id, string_split(case when event_id % 7 = 0 then concat(ip_src, ',', ip_dst) else ip_src end, ',')[1]
  as ip_src from ({_PARSED})""",
    "web_traffic_filter": f"""
select * from (select event_id, ip_src, ip_proto, cast(1024 + event_id % 60000 as varchar) as tcp_srcport,
    case event_id % 5 when 0 then '80' when 1 then '443' when 2 then '22' when 3 then '53' else '8080' end
      as tcp_dstport from ({packets_sql(DUCKDB, "events")}))
where ip_src <> '' and ip_proto = '6'
  and (tcp_srcport in ('80', '443') or tcp_dstport in ('80', '443'))""".replace(
        "select * from (select event_id",
        "select event_id, ip_src, tcp_srcport, tcp_dstport from (select event_id",
        1,
    ),
    "capture_window": f"""
select event_id, frame_time_epoch from ({_PARSED}) where cast(frame_time_epoch as double) <=
  (select min(cast(frame_time_epoch as double)) from ({_PARSED})) + 600""",
    "flow_scan": f"""
select flow_id, source_ip, destination_ip, "timestamp", cast(destination_port as double) as destination_port,
  flow_duration, cast(total_fwd_packets as double) as total_fwd_packets,
  case when isfinite(flow_bytes_s) then flow_bytes_s end as flow_bytes_s, state_name, label,
  cast(isinf(flow_bytes_s) as integer) as is_inf
from ({_FLOWS})""",
    "cast_numeric": rf"""
select event_id,
  case when regexp_full_match(trim(text), '{_DECIMAL}') then cast(trim(text) as double) else 0 end as number,
  case text when 'inf' then 1 when '-Infinity' then -1 else 0 end as infinite
from (select event_id, case event_id % 17 when 0 then '' when 1 then ' 12 ' when 2 then '1e3' when 3 then '+5'
  when 4 then '12.' when 5 then '.5' when 6 then '0x1F' when 7 then '1_000' when 8 then '1,000' when 9 then 'nan'
  when 10 then 'inf' when 11 then '-Infinity' when 12 then '5d' when 13 then '5.f' when 14 then 'True'
  when 15 then '-7.25' else cast(cast(value as decimal(12,2)) as varchar) end as text from events)""",
    "tcp_flags": """
select event_id, mask, cast(mask & 1 <> 0 as integer) as fin, cast(mask & 2 <> 0 as integer) as syn,
  cast(mask & 4 <> 0 as integer) as rst, cast(mask & 8 <> 0 as integer) as psh,
  cast(mask & 16 <> 0 as integer) as ack
from (select event_id, cast(case event_id % 8 when 0 then event_id % 4096 when 1 then event_id % 4096
  when 2 then event_id % 64 else 0 end as bigint) as mask from events)""",
    "packet_features": f"select * from ({_FEATURES})",
    "select_features": f"select event_id, ip_src, ip_dst, frame_len, hour_of_day from ({_FEATURES})",
    "flow_load": f"""
select flow_id, source_ip, destination_ip, "timestamp", cast(destination_port as double) as destination_port,
  flow_duration, cast(total_fwd_packets as double) as total_fwd_packets, flow_bytes_s, label,
  state_name || case when total_fwd_packets % 2 = 1 then chr(10) || '"x"' else '' end as state_name,
  cast(total_fwd_packets as double) as "total_fwd_packets.1"
from ({_CLEAN})""",
    "quality_ledger": f"""
with r as (select value, len(string_split(value, chr(9))) as n from ({_LINES}))
select 'run_batch' as job, unnest(['read', 'blank', 'packets', 'rejected']) as outcome,
  unnest([count(*), 0, count(*) filter (n = 6), count(*) filter (n <> 6)]) as rows from r
union all select 'load_flows', 'read', count(*) from ({_FLOWS})
union all select 'load_flows', 'kept', count(*) from ({_CLEAN})""",
    "guards": f"""
with p as (select count(*) as n from ({_FEATURES})), c as (select count(*) as n from ({_CLEAN}))
select 'label required, there' as guard, n as rows, 10 as columns from c
union all select 'label required, absent', -1, -1
union all select 'report columns required, absent', -1, -1
union all select 'rows required, there', n, 14 from p
union all select 'rows required, none', -1, -1
union all select 'inputs by name', n, 1 from p
union all select 'inputs of the schema', n, 1 from p
union all select 'inputs of the model', n, 1 from p
union all select 'inputs that are numbers', n, 12 from p
union all select 'no inputs', -1, -1""",
    "flow_clean": f"select * from ({_CLEAN})",
    "flow_labels": f"select attack_type as label, count(*) as flows from ({_FLOW_FEATURES}) group by 1",
    "flow_features": f"select * from ({_FLOW_FEATURES})",
    "filter_anomalies": f"select event_id, is_anomaly, ip_src from ({_RESULTS}) where is_anomaly = 1",
    "normalize_flag": """
select event_id, case when event_id % 7 = 0 then 0 when event_id % 3 = 0 then 1 else 0 end as as_bool,
  case when event_id % 11 = 0 or event_id % 7 = 0 then 0 when event_id % 4 = 1 then 0 else 1 end as as_number,
  case when event_id % 13 = 0 then 0 when event_id % 10 <= 6 then 1 else 0 end as as_text
from events""",
    "report_prepare": f"select event_id, is_anomaly, attack_type from ({_REPORT})",
    "rule_fallback": f"""
select event_id, frame_len, case when frame_len > 1200 or event_id % 4 = 0 then 1 else 0 end as is_anomaly,
  case when frame_len > 1200 and event_id % 4 <> 0 then 'suspicious_traffic' else 'normal' end as attack_type,
  case when frame_len > 1200 and event_id % 4 <> 0 then 0.9 else cast(1.0 as double) end as attack_confidence
from ({_FEATURES})""",
    "schema_fallback_detect": f"""
select event_id, 0 as is_anomaly, cast(0.0 as double) as anomaly_score from ({_FEATURES})""",
    "schema_fallback_classify": f"""
select event_id, is_anomaly, case when is_anomaly = 1 then 'anomaly' else 'normal' end as attack_type,
  cast(case when is_anomaly = 1 then 0.0 else 1.0 end as double) as attack_confidence from ({_LARGE})""",
    "event_lines": f"""
select event_id, concat(strftime(make_timestamp(event_us), '%Y-%m-%d %H:%M:%S'), ' | [ANOMALY] ',
  coalesce(attack_type, 'anomaly'), ' detected (confidence: ', printf('%.2f', attack_confidence), ') | ',
  ip_src, ' -> ', ip_dst) as line from ({_RESULTS}) where is_anomaly = 1""",
    "traffic_distribution": f"""
select count(*) as total_packets, cast(sum(is_anomaly) as bigint) as anomalies,
  cast(count(*) - sum(is_anomaly) as bigint) as normal from ({_REPORT})""",
    "attack_distribution": f"""
select attack_type, count(*) as packets from ({_REPORT}) group by 1 order by 2 desc, 1""",
    "attack_share": f"""
select attack_type, count(*) as packets, round(100.0 * count(*) / sum(count(*)) over (), 1) as percent
from ({_REPORT}) group by 1""",
    "attack_summary": f"""
select coalesce(attack_type, 'nan') as attack_type, count(*) as packets from ({_RESULTS}) group by 1""",
    "report_payload": f"""
select t.*, d.attack_type, d.packets
from (select count(*) as total_packets, cast(sum(is_anomaly) as bigint) as anomalies,
        cast(count(*) - sum(is_anomaly) as bigint) as normal, cast(sum(is_anomaly) as bigint) as anomaly
      from ({_REPORT})) t,
  (select attack_type, count(*) as packets from ({_REPORT}) group by 1) d""",
    "report_preview": f"""
select event_id, event_us, ip_src, is_anomaly, attack_type from ({_RESULTS}) order by event_us, event_id limit 10""",
    "union_batches": f"""
select event_id, ip_src, tcp_flags, cast(null as varchar) as ip_proto from ({_PARSED}) where ip_proto = '6'
union all select event_id, ip_src, null, ip_proto from ({_PARSED}) where ip_proto <> '6'""",
    "sample_normal": f"""
select {_FLOW_COLUMNS} from ({_FLOW_FEATURES}) where attack_type = 'normal'
order by md5(concat('42:', flow_id)), flow_id limit 5000""",
    "sample_stratified": f"""
with f as ({_FLOW_FEATURES}),
q as (select attack_type, case when sum(count(*)) over () > 5000 then greatest(1, cast(floor(cast(count(*) as double)
    * (cast(5000 as double) / cast(sum(count(*)) over () as double))) as bigint)) else count(*) end as quota
  from f group by 1),
r as (select *, row_number() over (partition by attack_type order by md5(concat('42:', flow_id)), flow_id) as rk from f)
select {_FLOW_COLUMNS} from r join q using (attack_type) where rk <= quota""",
    "anomaly_window_count": f"""
select event_id, event_us, cast(sum(is_anomaly) over (order by event_us range between 10000000 preceding and
  current row) as bigint) as anomalies from ({_LARGE})""",
    "traffic_rate": f"""
select event_id, event_us, cast(count(*) over (order by event_us range between 1000000 preceding and
  current row) as double) as packets_per_second from ({_LARGE})""",
    "anomaly_alerts": _ANOMALY_ALERTS,
    "traffic_alerts": _TRAFFIC_ALERTS,
    "stream_alerts": f"select * from ({_ANOMALY_ALERTS}) union all select * from ({_TRAFFIC_ALERTS})",
    "running_report": f"""
select attack_type, count(*) as packets, round(100.0 * count(*) / sum(count(*)) over (), 1) as percent
from (select case when frame_len > 1200 and is_anomaly <> 1 then 'suspicious_traffic' else attack_type end
        as attack_type from ({_ANALYZED})) group by 1""",
    "realtime_alerts": f"select * from ({_LIVE_ANOMALY}) union all select * from ({_LIVE_TRAFFIC})",
    "late_packets": f"""
with p as (select event_id, event_us, ip_dst from ({_FEATURES})),
border as (select max(event_us) // 1000 - 30000 as ms from p where event_id % 3 <> 0)
select ip_dst as sensor, count(*) as packets,
  count(*) filter (event_id % 3 = 0 and (event_us // 30000000 + 1) * 30000 <= ms) as late_packets
from p, border group by 1""",
    "iforest_score_frozen": f"select event_id, is_anomaly, anomaly_score from ({_SCORED})",
    "iforest_threshold": f"select round(quantile_cont(score, 0.2), 6) as threshold from ({_SCORED})",
    "detect_anomalies": f"select event_id, is_anomaly, anomaly_score from ({_SCORED})",
    "classify_merge": f"""
select event_id, is_anomaly, case when is_anomaly = 0 then 'normal' when tcp_flag_syn = 1 then 'port_scan'
  else 'ddos' end as attack_type,
  case when is_anomaly = 0 then 1.0 else cast(event_us % 101 as double) / 100 end as attack_confidence
from ({_LARGE})""",
    "batch_analysis": f"select * exclude (event_id) from ({_ANALYZED})",
    "realtime_job": f"""
select * exclude (event_id, h) replace (
  case when h then 1 else is_anomaly end as is_anomaly,
  case when h then 'suspicious_traffic' else attack_type end as attack_type,
  case when h then 0.9 else attack_confidence end as attack_confidence)
from (select *, frame_len > 1200 and is_anomaly <> 1 as h from ({_ANALYZED}))""",
    "report_tables": f"""
select attack_type, count(*) as packets, round(100.0 * count(*) / sum(count(*)) over (), 1) as percent
from ({_REPORT}) group by 1""",
    "results_by_day": f"""
select event_id, cast(cast(make_timestamp(greatest(event_us, 0)) as date) as varchar) as capture_date, is_anomaly, attack_type from ({_REPORT})""",
    "results_daily": f"""
select cast(cast(make_timestamp(greatest(event_us, 0)) as date) as varchar) as capture_date, count(*) as packets,
  count(*) filter (is_anomaly = 1) as anomalies from ({_REPORT}) group by 1""",
    "results_json": f"select event_id, ip_src, is_anomaly, attack_type from ({_REPORT})",
}
