"""DuckDB SQL for the source/sink queries."""

from __future__ import annotations

from .oracle_sql import q, r6

q("s1_write_csv", "SELECT * FROM supplier")

q("s3_append_cases", f"""
SELECT 'O' || CAST(o_orderkey AS VARCHAR) AS gid,
  to_json({{'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority,
            'o_totalprice': o_totalprice}}) AS payload_json,
  {r6("CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1e6 END")} AS target,
  '2024-01-31T00:00:00' AS created_at
FROM orders""")

q("s4_flatten_payload", f"""
SELECT event_id, event_type, {r6('value')} AS "metrics.value", user_id AS "metrics.user_id",
  CAST(json_extract(props, '$.k') AS INTEGER) AS "props.k"
FROM events""")

LOG = f"""
log AS (
  SELECT event_id AS id,
    CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'U' || CAST(user_id AS VARCHAR) END AS gid,
    CASE WHEN event_id % 13 = 0 THEN 'not json' ELSE props END AS payload_json,
    round(CASE WHEN value / 500.0 IS NULL OR isnan(value / 500.0) THEN value / 500.0
               ELSE greatest(least(value / 500.0, 1.0), 0.0) END * 10000.0) / 10000.0 AS prediction,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS created_at,
    strftime(ts, '%Y-%m-%d') AS ds
  FROM events),
log2 AS (SELECT *, CASE WHEN prediction > 0.7 THEN 'High' WHEN prediction > 0.4 THEN 'Medium' ELSE 'Low' END
                   AS confidence FROM log)"""

q("s6_append_inference_log", f"""
WITH {LOG.strip()}
SELECT gid, payload_json, {r6('prediction')} AS prediction, confidence, CAST(NULL AS VARCHAR) AS explanation_summary,
  created_at, ds FROM log2""")

q("s7_export_table", """
SELECT *, 'csv' AS fmt FROM nation UNION ALL SELECT *, 'parquet' AS fmt FROM nation""")

q("s8_recent_log_query", f"""
WITH {LOG.strip()}
SELECT id, gid, {r6('prediction')} AS prediction, confidence, created_at,
  CASE WHEN json_valid(payload_json) THEN CAST(json_extract(payload_json, '$.k') AS INTEGER) END AS k
FROM log2 WHERE created_at >= '2024-01-10' AND created_at <= '2024-01-20T12:00:00'
ORDER BY id DESC LIMIT 50""")

BATCH = """
cases AS (
  SELECT 'B' || CAST(p_partkey // 50 AS VARCHAR) AS batch_id, (p_partkey // 50) % 2 = 0 AS include_explanations,
    CAST(row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS INTEGER) AS pos,
    CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '' ELSE 'P' || CAST(p_partkey AS VARCHAR) END
      AS gid,
    p_brand AS region, p_type AS business_type, p_retailprice AS revenue, p_size AS employee_count,
    p_name AS description
  FROM part)"""

q("s9_read_batch_json", f"""
WITH {BATCH.strip()}
SELECT batch_id, include_explanations, pos, gid, region, business_type, {r6('revenue')} AS revenue,
  employee_count, description FROM cases""")

q("p8_default_id", f"""
WITH {BATCH.strip()}
SELECT batch_id, pos, coalesce(nullif(gid, ''), 'batch_' || CAST(pos AS VARCHAR)) AS gid FROM cases""")

q("s10_dated_partition_write", f"""
SELECT event_id, event_type, {r6('value')} AS value, strftime(ts, '%Y-%m-%d') AS ds
FROM events""")

q("s11_retention_filter", """
SELECT ds, n_rows,
  CASE WHEN try_strptime(ds, '%Y-%m-%d') IS NULL THEN 'skipped'
       WHEN CAST(ds AS DATE) < DATE '2024-01-31' - INTERVAL 7 DAY THEN 'expired' ELSE 'kept' END AS status
FROM (SELECT strftime(ts, '%Y-%m-%d') AS ds, count(*) AS n_rows FROM events GROUP BY 1)""")

q("t6_stream_log", f"""
WITH {LOG.strip()}
SELECT id AS event_id, 'U' || CAST(e.user_id AS VARCHAR) AS gid, e.props AS payload_json, {r6('prediction')} AS prediction,
  confidence, CAST(NULL AS VARCHAR) AS explanation_summary, created_at, ds
FROM log2 JOIN events e ON log2.id = e.event_id""")
