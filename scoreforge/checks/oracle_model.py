"""DuckDB SQL for the model queries that have a fixed, SQL-expressible result."""

from __future__ import annotations

from .oracle_features import capped_expr, standardized_cte, tokens_cte, vocab_cte
from .oracle_sql import CASES, HASH, LINE_ID, _score_sql, q, r6, rnd

q("m1_split", f"""
SELECT o_orderkey, CASE WHEN {HASH.format(k='o_orderkey')} % 100 < 80 THEN 'train' ELSE 'test' END AS split
FROM orders""")

q("m9_bundle_check", f"""
WITH half AS (SELECT * FROM documents WHERE {HASH.format(k='doc_id')} % 100 < 50),
{tokens_cte('half', 'doc_id', 'text', 'a_').strip()}, {vocab_cte('half', 'a_').strip()},
{tokens_cte('documents', 'doc_id', 'text', 'b_').strip()}, {vocab_cte('documents', 'b_').strip()}
SELECT 'error' AS severity, 'feature_count' AS kind,
  printf('metadata=%d state=%d', (SELECT count(*) FROM a_vocab), (SELECT count(*) FROM b_vocab)) AS item
WHERE (SELECT count(*) FROM a_vocab) <> (SELECT count(*) FROM b_vocab)
UNION ALL SELECT 'error', 'missing_in_state', term FROM a_vocab WHERE term NOT IN (SELECT term FROM b_vocab)
UNION ALL SELECT 'error', 'missing_in_metadata', term FROM b_vocab WHERE term NOT IN (SELECT term FROM a_vocab)""")

q("m10_run_log", f"""
WITH s AS (SELECT 'run_' || l_returnflag AS run_id, l_tax * 10 AS y,
                  greatest(least(l_discount * 8, 1.0), 0.0) AS p FROM lineitem),
r AS (SELECT run_id, sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y)) AS mae,
        1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) AS r2 FROM s GROUP BY run_id)
SELECT run_id, {r6('rmse')} AS rmse, CAST(row_number() OVER (ORDER BY rmse, run_id) AS INTEGER) AS rank,
  {r6('mae')} AS mae, {r6('r2')} AS r2, row_number() OVER (ORDER BY started DESC, run_id DESC) = 1 AS is_latest
FROM r JOIN (SELECT 'run_' || l_returnflag AS run_id, max(CAST(l_shipdate AS DATE)) AS started FROM lineitem GROUP BY 1)
  USING (run_id)""")

_cases_tbl = f"(WITH {CASES.strip()} SELECT * FROM cases)"
_cat = ["risk_category", "region", "business_type", "regulatory_status", "compliance_level"]
_num = ["revenue", "employee_count", "years_in_business", "credit_score", "debt_to_equity_ratio",
        "liquidity_ratio", "market_share", "growth_rate", "profitability_margin", "customer_satisfaction",
        "operational_efficiency", "regulatory_violations", "audit_score"]
_names = ", ".join(f"'{c}'" for c in _cat + _num)
q("m11_model_info", f"""
WITH base AS (SELECT *, case_id AS __id FROM {_cases_tbl} c WHERE {HASH.format(k='case_id')} % 100 < 70),
{tokens_cte('base', '__id', 'description', 'f_').strip()}, {vocab_cte('base', 'f_').strip()},
names AS (SELECT 'text_tfidf_' || CAST(idx AS VARCHAR) AS n, idx AS o FROM f_vocab
          UNION ALL SELECT unnest([{_names}]), (SELECT count(*) FROM f_vocab) + unnest(range({len(_cat) + len(_num)})))
SELECT 'GBTRegressionModel' AS model_type, '1' AS model_version,
  CAST((SELECT count(*) FROM names) AS INTEGER) AS n_features,
  (SELECT string_agg(n, ',' ORDER BY o) FROM (SELECT * FROM names ORDER BY o LIMIT 20)) AS first_features,
  '{{"maxBins": 64, "maxDepth": 6, "maxIter": 40, "seed": 42, "stepSize": 0.1, "subsamplingRate": 1.0}}' AS params,
  true AS best_in_history, true AS is_fitted""")

_lw = {"credit_score": 0.05, "debt_to_equity_ratio": -0.03, "liquidity_ratio": 0.02, "audit_score": 0.02}
_lin = " + ".join(f"CAST({w!r} AS DOUBLE) * {c}" for c, w in _lw.items())
_ranges = [("revenue", 0, None), ("employee_count", 1, None), ("years_in_business", 1, None),
           ("credit_score", 300, 850), ("debt_to_equity_ratio", 0, None), ("liquidity_ratio", 0, None),
           ("market_share", 0, 1), ("customer_satisfaction", 0, 100), ("operational_efficiency", 0, 100),
           ("regulatory_violations", 0, None), ("audit_score", 0, 100)]
_req = ["risk_category", "region", "business_type", "regulatory_status", "compliance_level", "revenue",
        "employee_count", "years_in_business", "credit_score", "debt_to_equity_ratio", "liquidity_ratio",
        "market_share", "growth_rate", "profitability_margin", "customer_satisfaction", "operational_efficiency",
        "regulatory_violations", "audit_score", "description"]
_viol = ", ".join([f"CASE WHEN {c} IS NULL THEN '{c}:null' END" for c in _req]
                  + [x for c, lo, hi in _ranges for x in
                     ([f"CASE WHEN {c} < {lo} THEN '{c}:ge' END"] if lo is not None else [])
                     + ([f"CASE WHEN {c} > {hi} THEN '{c}:le' END"] if hi is not None else [])]
                  + ["CASE WHEN risk_category IS NOT NULL AND risk_category NOT IN ('Low', 'Medium', 'High', 'Critical') "
                     "THEN 'risk_category:domain' END",
                     "CASE WHEN regulatory_status IS NOT NULL AND regulatory_status NOT IN ('Compliant', 'Under Review', "
                     "'Minor Issues', 'Major Issues', 'Non-Compliant') THEN 'regulatory_status:domain' END",
                     "CASE WHEN compliance_level IS NOT NULL AND compliance_level NOT IN ('Excellent', 'Good', 'Fair', "
                     "'Poor', 'Critical') THEN 'compliance_level:domain' END"])
q("m12_batch_score", f"""
WITH cs AS (SELECT * FROM {_cases_tbl} c),
{standardized_cte('cs', 'cs', list(_lw), 'case_id')},
pred AS (SELECT id AS case_id, greatest(least(0.5 + ({_lin}), 1.0), 0.0) AS p FROM scaled),
v AS (SELECT case_id, gid, concat_ws(',', {_viol}) AS reasons FROM cs),
terms AS (SELECT *, row_number() OVER (PARTITION BY id, shap > 0, shap < 0 ORDER BY abs(shap) DESC, feature) AS rank
          FROM ({" UNION ALL ".join(f"SELECT id, '{c}' AS feature, {c} AS value, CAST({w!r} AS DOUBLE) * {c} AS shap FROM scaled"
                                    for c, w in _lw.items())}) u)
SELECT v.case_id, coalesce(nullif(gid, ''), 'batch_' || CAST(v.case_id AS VARCHAR)) AS gid,
  CASE WHEN reasons = '' THEN 'scored' ELSE 'rejected' END AS status,
  CASE WHEN reasons = '' THEN {r6(rnd('p', 4))} END AS prediction,
  CASE WHEN reasons = '' THEN (CASE WHEN p > 0.7 THEN 'High' WHEN p > 0.4 THEN 'Medium' ELSE 'Low' END) END AS confidence,
  reasons, '1.0.0' AS model_version, '2024-01-31T00:00:00' AS scored_at,
  CASE WHEN reasons = '' THEN 'Score: ' || printf('%.3f', {rnd('p', 3)}) || ' ('
    || (CASE WHEN p > 0.7 THEN 'High' WHEN p > 0.4 THEN 'Medium' ELSE 'Low' END) || ' confidence)'
    || coalesce('; Main positive factors: ' || (SELECT string_agg(feature, ', ' ORDER BY rank) FROM terms t
         WHERE t.id = v.case_id AND shap > 0 AND rank <= 2), '')
    || coalesce('; Main risk factors: ' || (SELECT string_agg(feature, ', ' ORDER BY rank) FROM terms t
         WHERE t.id = v.case_id AND shap < 0 AND rank <= 2), '') END AS explanation_summary,
  CASE WHEN reasons = '' THEN coalesce((SELECT string_agg(feature || ':' || printf('%.6f', {rnd('value', 6)} + 0.0) || ':'
         || printf('%.6f', {rnd('shap', 6)} + 0.0), '|' ORDER BY abs(shap) DESC, feature) FROM terms t
         WHERE t.id = v.case_id AND shap <> 0 AND rank <= 3), '') END AS contributions
FROM v JOIN pred ON v.case_id = pred.case_id""")

# what any fit must satisfy, over the cases of the real runs
_split = f"CASE WHEN {HASH.format(k='case_id')} % 100 < 70 THEN 'train' WHEN {HASH.format(k='case_id')} % 100 < 80 " \
         "THEN 'validation' ELSE 'test' END"
q("m3_predict_checks", f"SELECT case_id, {_split} AS split, CAST(1 AS BIGINT) AS n, true AS in_range FROM {_cases_tbl} c")
q("m4_fold_checks", f"""
SELECT CAST({HASH.format(k='case_id')} % 5 AS INTEGER) AS fold, count(*) AS n_test, CAST(sum(case_id) AS BIGINT) AS sum_case_id
FROM {_cases_tbl} c GROUP BY 1""")
q("e1_additivity", f"SELECT case_id, true AS adds_up FROM {_cases_tbl} c")
q("m8_reload_check", f"""
SELECT count(*) AS n, CAST(0.0 AS DOUBLE) AS max_abs_diff, CAST(0 AS BIGINT) AS n_unmatched, true AS ok FROM {_cases_tbl} c""")
q("m12_model_batch", f"""
WITH cs AS (SELECT * FROM {_cases_tbl} c),
v AS (SELECT case_id, gid, concat_ws(',', {_viol}) AS reasons FROM cs)
SELECT case_id, coalesce(nullif(gid, ''), 'batch_' || CAST(case_id AS VARCHAR)) AS gid,
  CASE WHEN reasons = '' THEN 'scored' ELSE 'rejected' END AS status, reasons, true AS in_range,
  CASE WHEN reasons = '' THEN true END AS explained, CASE WHEN reasons = '' THEN true END AS labelled
FROM v""")


# one-split trees: the split of the largest squared-error gain among the midpoints of neighbouring values
LINE_SPLITS = ("l_quantity", "l_discount", "l_tax")


def best_split(name: str, rows: str, y: str, by: str | None = None, feats=LINE_SPLITS) -> str:
    """CTE ``name``: (by_, feature, threshold, lo, hi, nl, n) of the best single split of ``rows`` on target ``y``."""
    return f"""
{name}_vals AS (SELECT by_, feature, v, count(*) AS n, sum(y) AS s FROM (
    SELECT {by or 0} AS by_, unnest([{", ".join(f"'{c}'" for c in feats)}]) AS feature,
      unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in feats)}]) AS v, {y} AS y FROM {rows})
  GROUP BY by_, feature, v),
{name}_cuts AS (SELECT by_, feature, (v + lead(v) OVER o) / 2 AS threshold,
    sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER w AS n, sum(s) OVER w AS s FROM {name}_vals
  WINDOW o AS (PARTITION BY by_, feature ORDER BY v), w AS (PARTITION BY by_, feature)),
{name} AS (SELECT by_, feature, threshold, sl / nl AS lo, (s - sl) / (n - nl) AS hi, nl, n FROM {name}_cuts
  WHERE threshold IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY by_ ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, feature) = 1)"""


def split_value(t: str, feats=LINE_SPLITS) -> str:
    return f"(CASE {t}.feature " + " ".join(f"WHEN '{c}' THEN CAST({c} AS DOUBLE)" for c in feats) + " END)"


def leaf(t: str, feats=LINE_SPLITS) -> str:
    return f"(CASE WHEN {split_value(t, feats)} <= {t}.threshold THEN {t}.lo ELSE {t}.hi END)"


_ONE = f"""one AS (SELECT {LINE_ID} AS id, l_quantity, l_discount, l_tax,
  greatest(least(l_extendedprice / 100000, 1.0), 0.0) AS label FROM lineitem)"""
_FOLDS = f"""{_ONE},
folded AS (SELECT *, CAST({HASH.format(k='id')} % 5 AS INTEGER) AS fold FROM one),
others AS (SELECT t.*, f.fold AS held FROM folded t JOIN (SELECT unnest(range(5)) AS fold) f ON t.fold <> f.fold),
{best_split('s1', 'others', 'label', 'held').strip()}"""

q("m3_one_split", f"""
WITH {_ONE}, {best_split('s1', 'one', 'label').strip()}
SELECT id, {r6('greatest(least(' + leaf('s1') + ', 1.0), 0.0)')} AS prediction, s1.feature, {r6('s1.threshold')} AS threshold
FROM one, s1""")

q("m4_one_split", f"""
WITH {_FOLDS},
e AS (SELECT fold, label, {leaf('s1')} - label AS e FROM folded JOIN s1 ON s1.by_ = fold)
SELECT fold, {r6('sqrt(avg(e * e))')} AS rmse, {r6('avg(abs(e))')} AS mae,
  {r6('1 - sum(e * e) / (var_pop(label) * count(*))')} AS r2 FROM e GROUP BY fold""")

# boosting's second tree is fitted to twice the residual and counts by the step size
q("m5_one_split", f"""
WITH {_FOLDS},
left1 AS (SELECT o.*, 2 * (label - {leaf('s1')}) AS r FROM others o JOIN s1 ON s1.by_ = held),
{best_split('s2', 'left1', 'r', 'held').strip()},
p AS (SELECT fold, label, {leaf('s1')} AS t1, {leaf('s2')} AS t2 FROM folded JOIN s1 ON s1.by_ = fold JOIN s2 ON s2.by_ = fold),
cand AS (SELECT * FROM (VALUES (0, 1, 0.1), (1, 1, 0.5), (2, 2, 0.1), (3, 2, 0.5)) c(candidate, trees, step)),
m AS (SELECT candidate, trees, step, fold, avg((t1 + (trees - 1) * step * t2 - label) ** 2) AS mse FROM p, cand
      GROUP BY ALL),
c AS (SELECT candidate, trees, step, -avg(mse) AS neg_mse FROM m GROUP BY ALL)
SELECT CAST(candidate AS INTEGER) AS candidate, '{{"maxIter": ' || trees || ', "stepSize": ' || step || '}}' AS params,
  {r6('neg_mse')} AS neg_mse, row_number() OVER (ORDER BY neg_mse DESC, candidate) = 1 AS is_best FROM c""")

_H1 = HASH.format(k="id || '-42'")
q("m6_one_split", f"""
WITH {_ONE}, {best_split('s1', 'one', 'label').strip()},
o AS (SELECT *, row_number() OVER (ORDER BY {_H1}, id) AS place, count(*) OVER () AS n FROM one),
paired AS (SELECT a.label, a.l_quantity, a.l_discount, a.l_tax, b.l_quantity AS q, b.l_discount AS d, b.l_tax AS t
           FROM o a JOIN o b ON b.place = a.place % a.n + 1),
e AS (SELECT {leaf('s1')} - label AS e,
  CASE WHEN (CASE s1.feature WHEN 'l_quantity' THEN CAST(q AS DOUBLE) WHEN 'l_discount' THEN CAST(d AS DOUBLE)
             ELSE CAST(t AS DOUBLE) END) <= s1.threshold THEN s1.lo ELSE s1.hi END - label AS f FROM paired, s1),
g AS (SELECT sqrt(avg(f * f)) - sqrt(avg(e * e)) AS gain FROM e)
SELECT x.feature, CASE WHEN x.feature = s1.feature THEN {r6('gain')} ELSE 0.0 END AS importance, x.feature <> s1.feature AS is_zero
FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature) x, s1, g""")

# M12 by a served one-split model: its contribution is the leaf less the cover-weighted mean of the leaves
_CF = ["debt_to_equity_ratio", "liquidity_ratio", "audit_score", "regulatory_violations"]
q("m12_one_split", f"""
WITH cs AS (SELECT *, {_score_sql()} AS case_score FROM {_cases_tbl} c),
{standardized_cte('cs', 'cs', _CF, 'case_id')},
train AS (SELECT scaled.*, case_score FROM scaled JOIN cs ON cs.case_id = scaled.id),
{best_split('s1', 'train', 'case_score', None, _CF).strip()},
p AS (SELECT id, {leaf('s1', _CF)} AS raw, (nl * lo + (n - nl) * hi) / n AS base, s1.feature,
        {split_value('s1', _CF)} AS value FROM scaled, s1),
v AS (SELECT case_id, gid, concat_ws(',', {_viol}) AS reasons FROM cs),
asked AS (SELECT case_id, case_id AS own FROM cs UNION ALL SELECT case_id, case_id FROM cs WHERE case_id % 10 = 0
          UNION ALL SELECT NULL, case_id FROM cs WHERE case_id % 10 = 1),
r AS (SELECT a.case_id, v.gid, reasons, greatest(least(raw, 1.0), 0.0) AS p, raw - base AS shap, feature, value
      FROM asked a JOIN v ON v.case_id = a.own JOIN p ON p.id = a.own)
SELECT case_id, coalesce(nullif(gid, ''), 'batch_' || CAST(case_id AS VARCHAR)) AS gid,
  CASE WHEN reasons = '' THEN 'scored' ELSE 'rejected' END AS status,
  CASE WHEN reasons = '' THEN {r6(rnd('p', 4))} END AS prediction,
  CASE WHEN reasons = '' THEN (CASE WHEN p > 0.7 THEN 'High' WHEN p > 0.4 THEN 'Medium' ELSE 'Low' END) END AS confidence,
  reasons, '1.0.0' AS model_version, '2024-01-31T00:00:00' AS scored_at,
  CASE WHEN reasons = '' THEN 'Score: ' || printf('%.3f', {rnd('p', 3)}) || ' ('
    || (CASE WHEN p > 0.7 THEN 'High' WHEN p > 0.4 THEN 'Medium' ELSE 'Low' END) || ' confidence)'
    || (CASE WHEN shap > 0 THEN '; Main positive factors: ' ELSE '; Main risk factors: ' END) || feature END AS explanation_summary,
  CASE WHEN reasons = '' THEN feature || ':' || printf('%.6f', {rnd('value', 6)} + 0.0) || ':'
    || printf('%.6f', {rnd('shap', 6)} + 0.0) END AS contributions
FROM r""")


def scored_lines(rows: str, fit_rows: str) -> str:
    """CTE ``scored_l`` (id, p): ``rows`` scored by the one-split line model fitted on ``fit_rows`` (both with lid)."""
    return f"""{standardized_cte(rows, fit_rows, LINE_SPLITS, 'lid')},
fit_rows AS (SELECT lid, {', '.join(f"({capped_expr(c)} - st.m_{c}) / (CASE WHEN st.s_{c} IS NULL OR st.s_{c} = 0 THEN 1.0 ELSE st.s_{c} END) AS {c}" for c in LINE_SPLITS)},
  greatest(least(l_extendedprice / 100000, 1.0), 0.0) AS label FROM {fit_rows}, fences, st),
{best_split('s1', 'fit_rows', 'label').strip()},
scored_l AS (SELECT id, greatest(least({leaf('s1')}, 1.0), 0.0) AS p FROM scaled, s1)"""


q("t5_stream_score", f"""
WITH li AS (SELECT *, {LINE_ID} AS lid FROM lineitem), {scored_lines('li', 'li')}
SELECT id, {r6(rnd('p', 4))} AS prediction, CASE WHEN {rnd('p', 4)} > 0.7 THEN 'High' WHEN {rnd('p', 4)} > 0.4 THEN 'Medium'
  ELSE 'Low' END AS confidence, CAST(1 AS BIGINT) AS model_version
FROM scored_l""")

_ordered = f"SELECT *, row_number() OVER (ORDER BY {HASH.format(k='id')}, id) AS place FROM one"
q("e2_tree_contributions", f"""
WITH {_ONE}, {best_split('s1', 'one', 'label').strip()},
b AS (SELECT avg({leaf('s1')}) AS base FROM ({_ordered}), s1 WHERE place <= 20),
f AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature)
SELECT id, f.feature, {r6("CASE f.feature WHEN 'l_quantity' THEN CAST(l_quantity AS DOUBLE) WHEN 'l_discount' THEN CAST(l_discount AS DOUBLE) ELSE CAST(l_tax AS DOUBLE) END")} AS value,
  {r6('CASE WHEN f.feature = s1.feature THEN ' + leaf('s1') + ' - base ELSE 0.0 END')} AS shap, {r6('base')} AS expected_value
FROM one, s1, b, f""")

q("m9_bundle_parts", """
SELECT * FROM (VALUES ('error', 'missing_part', 'features/num_stats', 'spoilt'), ('error', 'rows', 'model/data', 'spoilt'),
  ('error', 'checksum', 'model/data', 'spoilt'), ('warning', 'version', 'pyspark', 'spoilt')) v(severity, kind, item, bundle)""")
