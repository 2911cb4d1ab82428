"""DuckDB SQL for each registered query, written from the operator
definitions (not generated from the Spark plans).  Shared CTEs are plain SQL
text; the few that follow a fixed spec (score weights, stop words) are
rendered from the same constants the Spark side uses."""

from __future__ import annotations

from .. import constants as K

SQL: dict[str, str] = {}


def r6(e: str) -> str:
    return f"(round(CAST({e} AS DOUBLE) * 1000000.0) / 1000000.0 + 0.0)"


def rnd(e: str, d: int) -> str:
    return f"(round(CAST({e} AS DOUBLE) * {float(10 ** d)!r}) / {float(10 ** d)!r})"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_case_map(col: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN CAST({v!r} AS DOUBLE)" if not isinstance(v, str)
                     else f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"(CASE {col} {whens} ELSE {default} END)"


HASH = "CAST(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT)"

CASES_BASE = f"""
cases_base AS (
  SELECT c.c_custkey AS case_id,
    CASE WHEN c.c_custkey % 10 = 0 THEN NULL ELSE 'C' || CAST(c.c_custkey AS VARCHAR) END AS gid,
    ({sql_list(K.RISK_CATEGORIES)})[c.c_custkey % 4 + 1] AS risk_category,
    r.r_name AS region,
    c.c_mktsegment AS business_type,
    ({sql_list(K.REGULATORY_STATUSES)})[c.c_custkey % 5 + 1] AS regulatory_status,
    ({sql_list(K.COMPLIANCE_LEVELS)})[(c.c_custkey // 5) % 5 + 1] AS compliance_level,
    o.total AS revenue,
    CAST(o.n_orders AS INTEGER) AS employee_count,
    CAST(1 + c.c_custkey % 40 AS INTEGER) AS years_in_business,
    CAST(300 + (c.c_custkey * 37) % 551 AS INTEGER) AS credit_score,
    (c.c_custkey % 31) / CAST(10.0 AS DOUBLE) AS debt_to_equity_ratio,
    (c.c_custkey % 29) / CAST(10.0 AS DOUBLE) AS liquidity_ratio,
    (c.c_custkey % 51) / CAST(100.0 AS DOUBLE) AS market_share,
    (c.c_custkey % 41 - 10) / CAST(100.0 AS DOUBLE) AS growth_rate,
    (c.c_custkey % 31 - 5) / CAST(100.0 AS DOUBLE) AS profitability_margin,
    CAST(c.c_custkey % 101 AS DOUBLE) AS customer_satisfaction,
    CAST((c.c_custkey * 3) % 101 AS DOUBLE) AS operational_efficiency,
    CAST(c.c_custkey % 9 AS INTEGER) AS regulatory_violations,
    CAST((c.c_custkey * 7) % 101 AS DOUBLE) AS audit_score
  FROM customer c
  JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) o
    ON c.c_custkey = o.o_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


def _description_sql() -> str:
    h = HASH.format(k="case_id")
    w = f"(({h} // 3) % 3)"
    perf_parts = []
    for bound, words in K.PERFORMANCE_WORDS:
        pick = f"({sql_list(words)})[{w} + 1]"
        perf_parts.append(f"WHEN profitability_margin > {bound} THEN {pick}" if bound is not None else f"ELSE {pick}")
    perf = "(CASE " + " ".join(perf_parts) + " END)"
    comp = sql_case_map("compliance_level", K.COMPLIANCE_WORDS, f"'{K.COMPLIANCE_WORD_DEFAULT}'")
    whens = []
    for i, (tmpl, order) in enumerate(zip(K.DESCRIPTION_TEMPLATES, K.DESCRIPTION_ARGS)):
        words = [comp if o == "compliance" else perf for o in order]
        whens.append(f"WHEN {i} THEN printf('{tmpl}', lower(business_type), lower(region), {words[0]}, {words[1]})")
    return f"(CASE {h} % 3 " + " ".join(whens) + " END)"


def _score_sql() -> str:
    groups: dict[str, tuple[float, list[str]]] = {}
    for group, gw, name, transform, scale, w in K.SCORE_SPEC:
        if transform == "ratio":
            term = f"(({name} / CAST({scale!r} AS DOUBLE)) * CAST({w!r} AS DOUBLE))"
        elif transform == "inverse":
            term = f"((CAST(1.0 AS DOUBLE) - {name} / CAST({scale!r} AS DOUBLE)) * CAST({w!r} AS DOUBLE))"
        else:
            term = f"({sql_case_map(name, K.SCORE_MAPS[transform[4:]])} * CAST({w!r} AS DOUBLE))"
        groups.setdefault(group, (gw, []))[1].append(term)
    parts = ["((" + " + ".join(terms) + f") * CAST({gw!r} AS DOUBLE))" for gw, terms in groups.values()]
    s = "(" + " + ".join(parts) + ")"
    return rnd(f"greatest(least({s}, 1.0), 0.0)", 4)


CASES = CASES_BASE + f""",
cases AS (SELECT *, {_description_sql()} AS description FROM cases_base)"""

SCORED = """
scored AS (
  SELECT l_orderkey, l_linenumber, l_tax * 10 AS y,
         greatest(least(l_discount * 8, 1.0), 0.0) AS y_hat
  FROM lineitem
)"""

LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

CONTRIB = f"""
lmeans AS (SELECT avg(l_quantity) AS m_q, avg(l_extendedprice) AS m_p, avg(l_discount) AS m_d, avg(l_tax) AS m_t
           FROM lineitem),
contributions AS (
  SELECT {LINE_ID} AS id, 'l_quantity' AS feature, l_quantity AS value, 0.01 * (l_quantity - m_q) AS shap
    FROM lineitem, lmeans
  UNION ALL SELECT {LINE_ID}, 'l_extendedprice', l_extendedprice, 0.00001 * (l_extendedprice - m_p) FROM lineitem, lmeans
  UNION ALL SELECT {LINE_ID}, 'l_discount', l_discount, 2.0 * (l_discount - m_d) FROM lineitem, lmeans
  UNION ALL SELECT {LINE_ID}, 'l_tax', l_tax, -3.0 * (l_tax - m_t) FROM lineitem, lmeans
),
ranked AS (
  SELECT *, CASE WHEN shap > 0 THEN 'positive' WHEN shap < 0 THEN 'negative' END AS sign,
         row_number() OVER (PARTITION BY id, CASE WHEN shap > 0 THEN 1 WHEN shap < 0 THEN -1 ELSE 0 END
                            ORDER BY abs(shap) DESC, feature) AS rank
  FROM contributions
),
top3 AS (SELECT * FROM ranked WHERE sign IS NOT NULL AND rank <= 3),
preds AS (SELECT id, 0.5 + sum(shap) AS prediction FROM contributions GROUP BY id)"""


def ctext(where: str) -> str:
    """Contributions of one id as 'feature:value:shap|...' ordered by |shap| desc, feature."""
    return (f"(SELECT string_agg(feature || ':' || printf('%.6f', {rnd('value', 6)} + 0.0) || ':' || printf('%.6f', {rnd('shap', 6)} + 0.0), '|' "
            f"ORDER BY abs(shap) DESC, feature) FROM top3 x WHERE x.id = p.id {where})")


def q(name: str, sql: str) -> None:
    SQL[name] = sql.strip()


# ---------------------------------------------------------------- profiling
q("a1_numeric_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, "
    f"{r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max FROM lineitem"
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))

q("a2_target_profile", f"""
SELECT 'o_totalprice' AS column, count(o_totalprice) AS count, {r6('avg(o_totalprice)')} AS mean,
  {r6('stddev_samp(o_totalprice)')} AS std, {r6('min(o_totalprice)')} AS min, {r6('max(o_totalprice)')} AS max,
  {r6('quantile_cont(o_totalprice, 0.25)')} AS q25, {r6('quantile_cont(o_totalprice, 0.5)')} AS q50,
  {r6('quantile_cont(o_totalprice, 0.75)')} AS q75
FROM orders""")

q("a3_value_counts", """
SELECT 'o_orderstatus' AS column, o_orderstatus AS value, count(*) AS count FROM orders
  WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus
UNION ALL
SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")

q("a4_outlier_report", " UNION ALL ".join(f"""
SELECT '{c}' AS column, {r6('q1')} AS q1, {r6('q3')} AS q3, {r6('lo')} AS lower_bound, {r6('hi')} AS upper_bound,
  (SELECT count(*) FROM lineitem WHERE {c} < lo OR {c} > hi) AS n_outliers
FROM (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
      FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem))"""
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))

q("a5_regression_metrics", f"""
WITH {SCORED.strip()}
SELECT count(*) AS n,
  {r6('sqrt(avg((y_hat - y) * (y_hat - y)))')} AS rmse,
  {r6('avg(abs(y_hat - y))')} AS mae,
  {r6('1 - sum((y_hat - y) * (y_hat - y)) / (var_pop(y) * count(*))')} AS r2,
  {r6('1 - var_pop(y - y_hat) / var_pop(y)')} AS explained_variance,
  {r6('max(abs(y_hat - y))')} AS max_error,
  {r6('avg(abs(y_hat - y) / greatest(y, 1e-8)) * 100')} AS mape,
  {r6('stddev_pop(y - y_hat)')} AS std_residual,
  {r6('median(abs(y_hat - y))')} AS median_ae
FROM scored""")

q("a6_tolerance_bands", f"""
WITH {SCORED.strip()}
SELECT {r6('avg(CASE WHEN abs(y_hat - y) <= 0.05 THEN 100.0 ELSE 0.0 END)')} AS within_05,
       {r6('avg(CASE WHEN abs(y_hat - y) <= 0.1 THEN 100.0 ELSE 0.0 END)')} AS within_10,
       {r6('avg(CASE WHEN abs(y_hat - y) <= 0.15 THEN 100.0 ELSE 0.0 END)')} AS within_15,
       {r6('avg(CASE WHEN abs(y_hat - y) <= 0.2 THEN 100.0 ELSE 0.0 END)')} AS within_20
FROM scored""")

q("a7_global_importance", f"""
WITH {CONTRIB.strip()}
SELECT feature, {r6('avg(abs(shap))')} AS mean_abs_shap FROM contributions GROUP BY feature""")

q("s5_count_rows", "SELECT count(*) AS n_rows FROM lineitem")

# ------------------------------------------------------ projections/scalars
q("p5_project_drop", "SELECT p_partkey, p_brand, p_type, p_size FROM part")

q("p6_fill_null", """
SELECT p_partkey,
  coalesce(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END, '') AS p_name,
  coalesce(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END, 'Unknown') AS p_brand,
  coalesce(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END, 'Unknown') AS p_type,
  p_size
FROM part""")

q("p7_clip", f"""
SELECT l_orderkey, l_linenumber,
  {r6('CASE WHEN l_quantity IS NULL OR isnan(l_quantity) THEN l_quantity ELSE greatest(least(l_quantity, 45.0), 5.0) END')} AS quantity_clipped,
  {r6('CASE WHEN l_discount IS NULL OR isnan(l_discount) THEN l_discount ELSE greatest(least(l_discount, 0.09), 0.01) END')} AS discount_clipped,
  {r6('CASE WHEN l_tax IS NULL OR isnan(l_tax) THEN l_tax ELSE least(l_tax, 0.05) END')} AS tax_clipped
FROM lineitem""")

q("p9_tier", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_discount * 8 > 0.7 THEN 'High' WHEN l_discount * 8 > 0.4 THEN 'Medium' ELSE 'Low' END AS tier
FROM lineitem""")

q("p10_round_score", f"""
SELECT l_orderkey, l_linenumber,
  {rnd('CASE WHEN l_quantity * 1000.0 <> 0 THEN l_extendedprice / (l_quantity * 1000.0) END', 4)} + 0.0 AS score_4
FROM lineitem""")

q("p11_map_lookup", """
SELECT o_orderkey,
  CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.8 WHEN '3-MEDIUM' THEN 0.5
       WHEN '4-NOT SPECIFIED' THEN 0.2 ELSE 0.0 END AS DOUBLE) AS priority_weight,
  m.weight AS joined_weight, CASE WHEN m.weight IS NULL THEN 'o_orderpriority:unknown_key' ELSE '' END AS violations
FROM orders LEFT JOIN (VALUES ('1-URGENT', CAST(1.0 AS DOUBLE)), ('2-HIGH', 0.8), ('3-MEDIUM', 0.5), ('4-NOT SPECIFIED', 0.2))
  m(priority, weight) ON o_orderpriority = m.priority""")

q("p12_weighted_score", f"WITH {CASES_BASE.strip()} SELECT case_id, {_score_sql()} AS case_score FROM cases_base")

q("p13_render_text", f"WITH {CASES.strip()} SELECT case_id, description FROM cases")

# --------------------------------------------------------------- validation
LINE_VIOL = """concat_ws(',',
    CASE WHEN l_quantity < 1 THEN 'l_quantity:ge' END, CASE WHEN l_quantity > 45 THEN 'l_quantity:le' END,
    CASE WHEN l_discount > 0.08 THEN 'l_discount:le' END, CASE WHEN l_tax < 0.01 THEN 'l_tax:ge' END,
    CASE WHEN l_extendedprice < 0 THEN 'l_extendedprice:ge' END)"""

ORDER_VIOL = """concat_ws(',',
    CASE WHEN o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')
         THEN 'o_orderpriority:domain' END,
    CASE WHEN o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus:domain' END{extra})"""

q("p1_range_check", f"SELECT l_orderkey, l_linenumber, {LINE_VIOL} AS violations FROM lineitem")
q("p2_domain_check", f"SELECT o_orderkey, {ORDER_VIOL.format(extra='')} AS violations FROM orders")

_case_cols = ["gid", "risk_category", "region", "business_type", "regulatory_status", "compliance_level",
              "revenue", "employee_count", "years_in_business", "credit_score", "debt_to_equity_ratio",
              "liquidity_ratio", "market_share", "growth_rate", "profitability_margin", "customer_satisfaction",
              "operational_efficiency", "regulatory_violations", "audit_score", "description"]
q("p3_required_columns", f"""
WITH {CASES.strip()}
SELECT case_id, concat_ws(',', {', '.join(f"CASE WHEN {c} IS NULL THEN '{c}:null' END" for c in _case_cols)}) AS violations
FROM cases""")

_ov = ORDER_VIOL.format(extra=", CASE WHEN o_totalprice < 1000.0 THEN 'o_totalprice:ge' END")
q("p4_split_valid_invalid", f"""
SELECT o_orderkey, CASE WHEN r = '' THEN 'valid' ELSE 'invalid' END AS status, r AS reasons
FROM (SELECT o_orderkey, {_ov} AS r FROM orders)""")

# ------------------------------------------------------------- explanations
q("e3_linear_contributions", f"""
WITH {CONTRIB.strip()}
SELECT id, feature, {r6('value')} AS value, {r6('shap')} AS shap FROM contributions""")

q("w1_topk_signed", f"""
WITH {CONTRIB.strip()}
SELECT id, sign, CAST(rank AS INTEGER) AS rank, feature, {r6('value')} AS value, {r6('shap')} AS shap FROM top3""")

q("w2_rank_features", f"""
WITH {CONTRIB.strip()}
SELECT feature, {r6('m')} AS mean_abs_shap, CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank
FROM (SELECT feature, avg(abs(shap)) AS m FROM contributions GROUP BY feature)
ORDER BY m DESC, feature LIMIT 10""")

q("w3_contribution_list", f"""
WITH {CONTRIB.strip()}
SELECT p.id, coalesce({ctext('')}, '') AS contributions FROM preds p""")

_expl = """concat_ws('; ',
    printf('Score: %.3f (%s confidence)', round(p.prediction * 1000.0) / 1000.0 + 0.0,
           CASE WHEN p.prediction > 0.7 THEN 'High' WHEN p.prediction > 0.4 THEN 'Medium' ELSE 'Low' END),
    (SELECT 'Main positive factors: ' || string_agg(feature, ', ' ORDER BY rank) FROM top3 x
      WHERE x.id = p.id AND x.sign = 'positive' AND x.rank <= 2),
    (SELECT 'Main risk factors: ' || string_agg(feature, ', ' ORDER BY rank) FROM top3 x
      WHERE x.id = p.id AND x.sign = 'negative' AND x.rank <= 2))"""

q("e4_explanation_text", f"WITH {CONTRIB.strip()} SELECT p.id, {_expl} AS explanation_summary FROM preds p")

q("e5_explanation_record", f"""
WITH {CONTRIB.strip()}
SELECT coalesce(p.id, 'unknown') AS instance_id, {r6('p.prediction')} AS prediction, {r6('0.5')} AS expected_value,
  coalesce({ctext('')}, '') AS feature_contributions,
  coalesce({ctext("AND x.sign = 'positive'")}, '') AS top_positive_features,
  coalesce({ctext("AND x.sign = 'negative'")}, '') AS top_negative_features,
  {_expl} AS explanation_summary
FROM preds p""")

q("e6_name_alignment", f"""
WITH {CONTRIB.strip()},
pos AS (SELECT *, CASE feature WHEN 'l_quantity' THEN 0 WHEN 'l_extendedprice' THEN 1 WHEN 'l_discount' THEN 2
                  ELSE 3 END AS idx FROM contributions)
SELECT catalog, id, idx, CASE WHEN catalog = 'fitting' THEN feature ELSE 'feature_' || CAST(idx AS VARCHAR) END AS feature,
  {r6('CASE WHEN idx < 3 THEN value ELSE 0.0 END')} AS value, {r6('shap')} AS shap
FROM pos, (VALUES ('other'), ('fitting')) k(catalog)""")
