"""DuckDB SQL for the drift queries."""

from __future__ import annotations

from .oracle_model import scored_lines
from .oracle_sql import LINE_ID, q, r6, rnd

KS_P = ("CASE WHEN {lam} <= 0 THEN 1.0 ELSE greatest(least(2.0 * list_sum(list_transform(range(1, 101), "
        "lambda k: pow(-1.0, k - 1) * exp(-2.0 * k * k * {lam} * {lam}))), 1.0), 0.0) END")


def numeric_drift_sql(split_cte: str, cols, value_exprs=None) -> str:
    """split_cte defines ``s(<cols>, cur)``; returns the D1 result query."""
    value_exprs = value_exprs or {c: c for c in cols}
    lng = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({value_exprs[c]} AS DOUBLE) AS x, cur FROM s "
                             f"WHERE {value_exprs[c]} IS NOT NULL AND NOT isnan(CAST({value_exprs[c]} AS DOUBLE))"
                             for c in cols)
    lam = "(sqrt(n_ref * n_cur / (n_ref + n_cur)) * ks_statistic)"
    return f"""
WITH {split_cte},
lng AS ({lng}),
counts AS (SELECT "column", x, CAST(sum(1 - cur) AS DOUBLE) AS c_ref, CAST(sum(cur) AS DOUBLE) AS c_cur
           FROM lng GROUP BY "column", x),
tot AS (SELECT "column", sum(c_ref) AS n_ref, sum(c_cur) AS n_cur FROM counts GROUP BY "column"),
run AS (SELECT c."column", x,
          sum(c_ref) OVER (PARTITION BY c."column" ORDER BY x ROWS UNBOUNDED PRECEDING) / n_ref AS fr,
          sum(c_cur) OVER (PARTITION BY c."column" ORDER BY x ROWS UNBOUNDED PRECEDING) / n_cur AS fc,
          lead(x) OVER (PARTITION BY c."column" ORDER BY x) AS nx
        FROM counts c JOIN tot t ON c."column" = t."column"),
ks AS (SELECT "column", max(abs(fr - fc)) AS ks_statistic,
         sum(CASE WHEN nx IS NOT NULL THEN (nx - x) * abs(fr - fc) ELSE 0.0 END) AS wasserstein
       FROM run GROUP BY "column"),
spread AS (SELECT "column", stddev_pop(x) AS ref_std FROM lng WHERE cur = 0 GROUP BY "column"),
edges AS (SELECT "column", quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e
          FROM lng WHERE cur = 0 GROUP BY "column"),
binned AS (SELECT l."column", len(list_filter(e, lambda v: l.x > v)) AS bin, cur
           FROM lng l JOIN edges g ON l."column" = g."column"),
bc AS (SELECT "column", bin, sum(1 - cur) AS a, sum(cur) AS b FROM binned GROUP BY "column", bin),
bt AS (SELECT "column", sum(a) AS na, sum(b) AS nb FROM bc GROUP BY "column"),
psi AS (SELECT bc."column", sum((greatest(b / nb, 1e-4) - greatest(a / na, 1e-4))
                                * ln(greatest(b / nb, 1e-4) / greatest(a / na, 1e-4))) AS psi
        FROM bc JOIN bt ON bc."column" = bt."column" GROUP BY bc."column"),
res AS (
  SELECT k."column", t.n_ref, t.n_cur, ks_statistic, {KS_P.format(lam=lam)} AS ks_p_value,
    CASE WHEN ref_std > 0 THEN wasserstein / ref_std WHEN wasserstein > 0 THEN 'inf'::DOUBLE ELSE 0.0 END
      AS wasserstein_norm,
    psi
  FROM ks k JOIN tot t ON k."column" = t."column" JOIN spread s2 ON k."column" = s2."column"
  JOIN psi p ON k."column" = p."column")
SELECT "column", CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur, {r6('ks_statistic')} AS ks_statistic,
  {r6('ks_p_value')} AS ks_p_value, {r6('wasserstein_norm')} AS wasserstein_norm, {r6('psi')} AS psi,
  ks_p_value < 0.05 AS drifted_p, wasserstein_norm >= 0.1 AS drifted_distance, 'wasserstein' AS stattest,
  {r6("wasserstein_norm")} AS drift_score, wasserstein_norm >= 0.1 AS drifted
FROM res"""


CHI2_P = ("CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - list_sum(list_transform(range(0, 2000), "
          "lambda n: exp(-({x} / 2.0) + ({d} / 2.0 + n) * ln({x} / 2.0) - lgamma({d} / 2.0 + n + 1))))) END")


def categorical_drift_sql(split_cte: str, cols) -> str:
    lng = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS x, cur FROM s WHERE {c} IS NOT NULL"
                             for c in cols)
    return f"""
WITH {split_cte},
lng AS ({lng}),
c AS (SELECT "column", x, CAST(sum(1 - cur) AS DOUBLE) AS a, CAST(sum(cur) AS DOUBLE) AS b FROM lng GROUP BY "column", x),
tot AS (SELECT "column", sum(a) AS n_ref, sum(b) AS n_cur, count(*) AS k FROM c GROUP BY "column"),
j AS (SELECT c.*, n_ref, n_cur, k, (a + b) * n_ref / (n_ref + n_cur) AS ea, (a + b) * n_cur / (n_ref + n_cur) AS eb,
        a / n_ref AS pa, b / n_cur AS pb FROM c JOIN tot ON c."column" = tot."column"),
agg AS (SELECT "column", n_ref, n_cur, k,
          sum((a - ea) * (a - ea) / ea + (b - eb) * (b - eb) / eb) AS chi2_statistic,
          sqrt(greatest(0.0, sum(0.5 * CASE WHEN pa > 0 THEN pa * ln(pa / ((pa + pb) / 2)) ELSE 0.0 END
                                  + 0.5 * CASE WHEN pb > 0 THEN pb * ln(pb / ((pa + pb) / 2)) ELSE 0.0 END)))
            AS js_distance,
          sum((greatest(pb, 1e-4) - greatest(pa, 1e-4)) * ln(greatest(pb, 1e-4) / greatest(pa, 1e-4))) AS psi
        FROM j GROUP BY "column", n_ref, n_cur, k),
res AS (SELECT *, CAST(k - 1 AS INTEGER) AS dof, {CHI2_P.format(x='chi2_statistic', d='(k - 1)')} AS chi2_p_value
        FROM agg)
SELECT "column", CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur, {r6('chi2_statistic')} AS chi2_statistic,
  dof, {r6('chi2_p_value')} AS chi2_p_value, {r6('js_distance')} AS js_distance, {r6('psi')} AS psi,
  chi2_p_value < 0.05 AS drifted_p, js_distance >= 0.1 AS drifted_distance, 'jensenshannon' AS stattest,
  {r6("js_distance")} AS drift_score, js_distance >= 0.1 AS drifted
FROM res"""


SHIP_SPLIT = """li AS (SELECT *, epoch(l_shipdate) AS ep FROM lineitem),
med AS (SELECT quantile_cont(ep, 0.5) AS m FROM li),
s AS (SELECT li.*, CASE WHEN ep < m THEN 0 ELSE 1 END AS cur FROM li, med)"""

ORDER_SPLIT = """od AS (SELECT *, epoch(o_orderdate) AS ep FROM orders),
med AS (SELECT quantile_cont(ep, 0.5) AS m FROM od),
s AS (SELECT od.*, CASE WHEN ep < m THEN 0 ELSE 1 END AS cur FROM od, med)"""

LNUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

q("d1_numeric_drift", numeric_drift_sql(SHIP_SPLIT, LNUM))
q("d2_categorical_drift", categorical_drift_sql(ORDER_SPLIT, ["o_orderstatus", "o_orderpriority"]))
q("d5_output_drift", numeric_drift_sql(SHIP_SPLIT, ["y_hat"], {
    "y_hat": "(CASE WHEN l_discount * 8 IS NULL OR isnan(l_discount * 8) THEN l_discount * 8 "
             "ELSE greatest(least(l_discount * 8, 1.0), 0.0) END)"}))
q("d3_dataset_drift", f"""
WITH num AS ({numeric_drift_sql(SHIP_SPLIT, LNUM)}),
cat AS ({categorical_drift_sql(SHIP_SPLIT, ['l_returnflag', 'l_linestatus'])}),
allc AS (SELECT "column", drifted, drifted_p FROM num UNION ALL SELECT "column", drifted, drifted_p FROM cat)
SELECT count(*) AS n_columns, count(*) FILTER (WHERE drifted) AS n_drifted,
  count(*) FILTER (WHERE drifted_p) AS n_drifted_p,
  {r6('avg(CAST(drifted AS DOUBLE))')} AS share_drifted, avg(CAST(drifted AS DOUBLE)) >= 0.5 AS dataset_drift
FROM allc""")

q("s12_json_summary_sink", f"""
WITH num AS ({numeric_drift_sql(SHIP_SPLIT, LNUM)}),
cat AS ({categorical_drift_sql(SHIP_SPLIT, ['l_returnflag', 'l_linestatus'])})
SELECT "column", n_ref, n_cur, ks_statistic, ks_p_value, wasserstein_norm, CAST(NULL AS DOUBLE) AS chi2_statistic,
  CAST(NULL AS DOUBLE) AS chi2_p_value, CAST(NULL AS DOUBLE) AS js_distance, psi, stattest, drift_score, drifted FROM num
UNION ALL
SELECT "column", n_ref, n_cur, NULL, NULL, NULL, chi2_statistic, chi2_p_value, js_distance, psi, stattest, drift_score,
  drifted FROM cat""")

# The daily job's summary row; batch = the last 90 days of ship dates, reference = before
DAILY_SPLIT = """li AS (SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem),
mx AS (SELECT max(d) AS m FROM li),
s AS (SELECT li.*, CASE WHEN d > m - 90 THEN 1 ELSE 0 END AS cur FROM li, mx)"""
q("d4_daily_job", f"""
WITH {DAILY_SPLIT},
num AS ({numeric_drift_sql(DAILY_SPLIT, LNUM)}),
cat AS ({categorical_drift_sql(DAILY_SPLIT, ['l_returnflag', 'l_linestatus'])}),
allc AS (SELECT "column", drifted FROM num UNION ALL SELECT "column", drifted FROM cat),
ref_rows AS (SELECT *, {LINE_ID} AS lid FROM s WHERE cur = 0), new_rows AS (SELECT *, {LINE_ID} AS lid FROM s WHERE cur = 1),
{scored_lines('new_rows', 'ref_rows')},
summ AS (SELECT count(*) AS n_columns, count(*) FILTER (WHERE drifted) AS n_drifted,
                avg(CAST(drifted AS DOUBLE)) AS share FROM allc),
b AS (SELECT count(*) AS n FROM lineitem, (SELECT max(CAST(l_shipdate AS DATE)) AS m FROM lineitem) x
      WHERE CAST(l_shipdate AS DATE) > x.m - 90)
SELECT (SELECT strftime(max(CAST(l_shipdate AS DATE)), '%Y-%m-%d') FROM lineitem) AS ds,
  CAST(b.n AS BIGINT) AS n_batch, CAST(b.n AS BIGINT) AS n_logged, CAST(1 AS BIGINT) AS model_version,
  (SELECT {r6('avg(' + rnd('p', 4) + ')')} FROM scored_l) AS mean_prediction, CAST(n_columns AS BIGINT) AS n_columns,
  CAST(n_drifted AS BIGINT) AS n_drifted, {r6('share')} AS share_drifted, share >= 0.5 AS dataset_drift,
  (SELECT count(DISTINCT d) FROM li, mx WHERE d > m - 90 AND d < m - 30) AS n_expired_partitions, share >= 0.5 AS alert
FROM summ, b""")
