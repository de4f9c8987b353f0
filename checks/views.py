"""Packet and flow views over the given tables, as text that Spark and DuckDB both run.

The packet view renders ``events`` as capture lines whose time runs 1000 times faster, so that
bursts occur; it also has malformed lines, blank lengths and blank protocols. The flow view renders
``lineitem`` as flow records with infinities, NaN, nulls and raw labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PACKETS = """
select event_id, us,
  concat('10.0.', cast(user_id {div} 256 as varchar(9)), '.', cast(user_id % 256 as varchar(9))) as ip_src,
  concat('192.168.0.', cast(event_id % 16 as varchar(9))) as ip_dst,
  case when event_id % 89 = 0 then '' else cast(60 + (event_id * 7919) % 1441 as varchar(20)) end as frame_len,
  concat(cast(us {div} 1000000 as varchar(20)), '.', lpad(cast(us % 1000000 as varchar(20)), 6, '0'))
    as frame_time_epoch,
  case event_type when 'click' then '0x0018' when 'view' then '0x0010' when 'purchase' then '0x0002'
                  when 'error' then '0x0014' else '' end as tcp_flags,
  case when event_id % 97 = 0 then '' when event_type = 'signup' then '17' else '6' end as ip_proto
from (select event_id, user_id, event_type,
        1700000000000000 + (cast({us} as bigint) - 1704067200000000) {div} 1000 as us
      from {events})
"""

_LINES = """
select event_id, us, concat_ws({tab}, ip_src, ip_dst, frame_len, frame_time_epoch, tcp_flags,
  case when event_id % 101 = 0 then null else ip_proto end) as value
from {packets}
"""

_FLOWS = """
select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(9)), '-',
              cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20))) as flow_id,
  concat('10.1.0.', cast(l_suppkey % 256 as varchar(9))) as source_ip,
  concat('10.2.0.', cast(l_partkey % 256 as varchar(9))) as destination_ip,
  case when l_orderkey % 53 = 0 then null else 'ts' end as {timestamp},
  l_suppkey as destination_port, l_quantity * 1000 as flow_duration,
  cast(l_linenumber as bigint) as total_fwd_packets,
  case when l_orderkey % 50 = 0 then cast('Infinity' as double)
       when l_orderkey % 51 = 0 then cast('NaN' as double) else l_extendedprice end as flow_bytes_s,
  l_linestatus as state_name,
  case when l_linenumber >= 5 then 'DDoS ' when l_quantity > 30 then 'Web Attack XSS' else ' BENIGN' end as label
from {lineitem}
"""

SPARK = {"div": "div", "us": "unix_micros(cast(ts as timestamp))", "tab": "chr(9)", "timestamp": "`timestamp`"}
DUCKDB = {"div": "//", "us": "epoch_us(ts)", "tab": "chr(9)", "timestamp": '"timestamp"'}


def packets_sql(dialect: dict, events: str) -> str:
    return _PACKETS.format(events=events, **dialect)


def lines_sql(dialect: dict, events: str) -> str:
    return _LINES.format(packets=f"({packets_sql(dialect, events)})", **dialect)


def flows_sql(dialect: dict, lineitem: str) -> str:
    return _FLOWS.format(lineitem=lineitem, **dialect)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(packets_sql(SPARK, "{events}"), events=table(spark, sf_dir, "events"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(lines_sql(SPARK, "{events}"), events=table(spark, sf_dir, "events"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(flows_sql(SPARK, "{lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
