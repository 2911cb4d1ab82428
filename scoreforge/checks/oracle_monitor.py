"""DuckDB SQL for the monitoring queries."""

from __future__ import annotations

from .. import constants as K
from .oracle_sql import q, r6

B = K.LATENCY_BOUNDS


def label(b: float) -> str:
    return repr(float(b))


def ts_text(sec_expr: str) -> str:
    return f"strftime(make_timestamp(CAST({sec_expr} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')"


def windows(size: int, slide: int) -> str:
    """events expanded to every sliding window (start seconds) that holds them."""
    return f"""ew AS (
  SELECT e.*, (epoch_us(ts) // {slide * 1000000}) * {slide} - k * {slide} AS ws
  FROM events e, range({size // slide}) r(k))"""


q("t1_request_rate", f"""
WITH {windows(3600, 900)}
SELECT {ts_text('ws')} AS window_start, {ts_text('ws + 3600')} AS window_end, event_type, count(*) AS n,
  {r6('count(*) / 3600.0')} AS rate
FROM ew GROUP BY ws, event_type""")

q("t2_latency_histogram", " UNION ALL ".join(
    [f"SELECT event_type, '{label(b)}' AS le, count(*) FILTER (WHERE value / 100.0 <= {b!r}) AS count "
     f"FROM events GROUP BY event_type" for b in B]
    + ["SELECT event_type, '+Inf' AS le, count(value) AS count FROM events GROUP BY event_type"]))


def hist_q(qv: float, cum: str, total: str) -> str:
    blist = "[" + ", ".join(f"CAST({b!r} AS DOUBLE)" for b in B) + "]"
    qv = f"CAST({qv!r} AS DOUBLE)"
    idx = f"coalesce(list_position(list_transform({cum}, lambda c: c >= {qv} * {total}), true), 0)"
    return f"""(CASE WHEN {total} = 0 THEN NULL
  WHEN {idx} = 0 THEN {float(B[-1])!r}
  ELSE (CASE WHEN {idx} = 1 THEN 0.0 ELSE {blist}[{idx} - 1] END)
       + ({blist}[{idx}] - (CASE WHEN {idx} = 1 THEN 0.0 ELSE {blist}[{idx} - 1] END))
         * (({qv} * {total} - (CASE WHEN {idx} = 1 THEN 0 ELSE {cum}[{idx} - 1] END))
            / ({cum}[{idx}] - (CASE WHEN {idx} = 1 THEN 0 ELSE {cum}[{idx} - 1] END))) END)"""


CUM = "[" + ", ".join(f"count(*) FILTER (WHERE value / 100.0 <= {b!r})" for b in B) + "]"

q("t3_latency_p95", f"""
SELECT {ts_text('ws')} AS window_start, event_type, total, {r6(hist_q(0.95, 'cum', 'total'))} AS p95
FROM (SELECT (epoch_us(ts) // 86400000000) * 86400 AS ws, event_type, {CUM} AS cum, count(value) AS total
      FROM events GROUP BY 1, 2)""")

q("t3_latency_5min", f"""
SELECT {ts_text('ws')} AS window_start, event_type, total, {r6(hist_q(0.95, 'cum', 'total'))} AS p95
FROM (SELECT (epoch_us(ts) // 300000000) * 300 AS ws, event_type, {CUM} AS cum, count(value) AS total
      FROM events GROUP BY 1, 2)""")

q("t3_latency_exact", f"""
SELECT {ts_text('ws')} AS window_start, event_type, total, {r6('p95')} AS p95
FROM (SELECT (epoch_us(ts) // 3600000000) * 3600 AS ws, event_type, count(value) AS total,
        quantile_cont(value / 100.0, 0.95) AS p95 FROM events GROUP BY 1, 2)""")

q("t4_sustained_alert", f"""
WITH {windows(300, 60)},
ev AS (SELECT ws + 300 AS at_s, event_type, {hist_q(0.95, 'cum', 'total')} AS qv
       FROM (SELECT ws, event_type, {CUM} AS cum, count(value) AS total FROM ew GROUP BY ws, event_type)),
br AS (SELECT event_type, at_s, at_s // 60 - row_number() OVER (PARTITION BY event_type ORDER BY at_s) AS island
       FROM ev WHERE qv > 0.5),
runs AS (SELECT event_type, min(at_s) AS s, max(at_s) AS e, count(*) AS n FROM br GROUP BY event_type, island)
SELECT event_type, {ts_text('s')} AS run_start, {ts_text('e')} AS run_end, n AS n_evaluations,
  {ts_text('s + 300')} AS fired_at
FROM runs WHERE n > 5""")

# The windows emitted in append mode, and those still open when the stream ended
q("t7_stream_windows", f"""
WITH g AS (SELECT (epoch_us(ts) // 3600000000) * 3600 AS ws, event_type, count(*) AS n, {CUM} AS cum
      FROM events GROUP BY 1, 2)
SELECT {ts_text('ws')} AS window_start, event_type, n, {r6('n / 3600.0')} AS rate, {r6(hist_q(0.95, 'cum', 'n'))} AS p95
FROM g""")
