"""DuckDB SQL for the feature queries."""

from __future__ import annotations

from .. import constants as K
from .oracle_sql import CASES, HASH, LINE_ID, SQL, q, r6, sql_list

STOP = sql_list(K.ENGLISH_STOP_WORDS)
PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens_cte(table: str, key: str, text: str, prefix: str = "") -> str:
    """<prefix>terms(key, terms): unigrams after stop words, then bigrams."""
    return f"""
{prefix}tok AS (
  SELECT {key} AS key, list_filter(regexp_extract_all(strip_accents(lower(coalesce({text}, ''))),
         '{PATTERN}'), lambda x: NOT list_contains({STOP}, x)) AS t
  FROM {table}),
{prefix}terms AS (
  SELECT key, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS terms FROM {prefix}tok),
{prefix}occ AS (SELECT key, unnest(terms) AS term FROM {prefix}terms)"""


def vocab_cte(table: str, prefix: str = "", max_features: int = 1000) -> str:
    return f"""
{prefix}ndocs AS (SELECT count(*) AS n FROM {table}),
{prefix}stats AS (SELECT term, count(*) AS tf, count(DISTINCT key) AS df FROM {prefix}occ GROUP BY term),
{prefix}kept AS (SELECT s.* FROM {prefix}stats s, {prefix}ndocs d WHERE df >= 2 AND df <= 0.95 * d.n
                 ORDER BY tf DESC, term LIMIT {max_features}),
{prefix}vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df, tf,
                  ln((1.0 + d.n) / (1.0 + df)) + 1 AS idf FROM {prefix}kept, {prefix}ndocs d)"""


def tfidf_cte(prefix: str = "") -> str:
    return f"""
{prefix}cnt AS (SELECT o.key, v.idx, count(*) * v.idf AS w FROM {prefix}occ o JOIN {prefix}vocab v ON o.term = v.term
                GROUP BY o.key, v.idx, v.idf),
{prefix}tfidf AS (SELECT key, idx, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS weight FROM {prefix}cnt)"""


q("f1_tokenize", f"""
WITH {tokens_cte('documents', 'doc_id', 'text').strip()}
SELECT key AS doc_id, CAST(len(terms) AS INTEGER) AS n_terms, md5(array_to_string(terms, '|')) AS terms_md5
FROM terms""")

q("f2_tfidf_fit", f"""
WITH {tokens_cte('documents', 'doc_id', 'text').strip()}, {vocab_cte('documents').strip()}
SELECT term, idx, df, tf, {r6('idf')} AS idf FROM vocab""")

q("f3_tfidf_transform", f"""
WITH {tokens_cte('documents', 'doc_id', 'text').strip()}, {vocab_cte('documents').strip()}, {tfidf_cte().strip()}
SELECT d.doc_id, coalesce(x.idx, -1) AS idx, {r6('coalesce(x.weight, 0.0)')} AS weight
FROM documents d LEFT JOIN tfidf x ON d.doc_id = x.key""")

q("f4_label_fit", """
SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT 'p_brand' AS column, coalesce(p_brand, 'Unknown') AS value FROM part
      UNION SELECT DISTINCT 'p_type', coalesce(p_type, 'Unknown') FROM part)""")

_np = """np AS (SELECT p_partkey,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS p_name,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS p_brand,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS p_type FROM part)"""


def _code(c: str) -> str:
    return f"""CAST(coalesce(
    (SELECT code FROM lab WHERE "column" = '{c}' AND value = coalesce(np.{c}, 'Unknown')),
    (SELECT code FROM lab WHERE "column" = '{c}' AND value = 'Unknown'),
    (SELECT n FROM sizes WHERE "column" = '{c}')) AS INTEGER) AS {c}"""


q("f5_label_transform", f"""
WITH {_np},
fitset AS (SELECT * FROM np WHERE {HASH.format(k='p_partkey')} % 100 < 20),
lab AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS code
        FROM (SELECT DISTINCT 'p_name' AS column, coalesce(p_name, 'Unknown') AS value FROM fitset
              UNION SELECT DISTINCT 'p_brand', coalesce(p_brand, 'Unknown') FROM fitset
              UNION SELECT DISTINCT 'p_type', coalesce(p_type, 'Unknown') FROM fitset)),
sizes AS (SELECT "column", count(*) AS n FROM lab GROUP BY "column")
SELECT p_partkey, {_code('p_name')}, {_code('p_brand')}, {_code('p_type')} FROM np""")

LNUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def fences_cte(table: str, cols, name: str = "fences") -> str:
    sel = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in cols)
    outer = ", ".join(f"q1_{c} - 1.5 * (q3_{c} - q1_{c}) AS lo_{c}, q3_{c} + 1.5 * (q3_{c} - q1_{c}) AS hi_{c}"
                      for c in cols)
    return f"{name} AS (SELECT {outer} FROM (SELECT {sel} FROM {table}))"


def capped_expr(c: str, f: str = "fences") -> str:
    return (f"CASE WHEN {c} IS NULL OR isnan({c}) THEN CAST({c} AS DOUBLE) "
            f"ELSE greatest(least(CAST({c} AS DOUBLE), {f}.hi_{c}), {f}.lo_{c}) END")


q("f6_iqr_cap", f"""
WITH {fences_cte('lineitem', LNUM)}
SELECT {LINE_ID} AS id, {', '.join(f"{r6(capped_expr(c))} AS {c}" for c in LNUM)}
FROM lineitem, fences""")


def standardized_cte(table: str, fit_table: str, cols, key: str, name: str = "scaled") -> str:
    """Fences and scaler from ``fit_table``; applied to ``table``."""
    capped_fit = ", ".join(f"{capped_expr(c)} AS {c}" for c in cols)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    scaled = ", ".join(
        f"({capped_expr(c)} - st.m_{c}) / (CASE WHEN st.s_{c} IS NULL OR st.s_{c} = 0 THEN 1.0 ELSE st.s_{c} END) AS {c}"
        for c in cols)
    return f"""{fences_cte(fit_table, cols)},
fitcap AS (SELECT {capped_fit} FROM {fit_table}, fences),
st AS (SELECT {stats} FROM fitcap),
{name} AS (SELECT {key} AS id, {scaled} FROM {table}, fences, st)"""


q("f7_standardize", f"""
WITH li AS (SELECT *, {LINE_ID} AS lid FROM lineitem), {standardized_cte('li', 'li', LNUM, 'lid')}
SELECT id, {', '.join(f"{r6(c)} AS {c}" for c in LNUM)} FROM scaled""")

CNUM = ["revenue", "employee_count", "years_in_business", "credit_score", "debt_to_equity_ratio",
        "liquidity_ratio", "market_share", "growth_rate", "profitability_margin", "customer_satisfaction",
        "operational_efficiency", "regulatory_violations", "audit_score"]
CCAT = ["risk_category", "region", "business_type", "regulatory_status", "compliance_level"]


def labels_cte(fit_table: str, cols, name: str = "lab") -> str:
    union = " UNION ".join(f"SELECT DISTINCT '{c}' AS column, coalesce(CAST({c} AS VARCHAR), 'Unknown') AS value "
                           f"FROM {fit_table}" for c in cols)
    return f"""{name} AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS code
        FROM ({union})),
{name}_sizes AS (SELECT "column", count(*) AS n FROM {name} GROUP BY "column")"""


def code_expr(c: str, row: str, lab: str = "lab") -> str:
    v = f"coalesce(CAST({row}.{c} AS VARCHAR), 'Unknown')"
    return f"""CAST(coalesce(
    (SELECT code FROM {lab} WHERE "column" = '{c}' AND value = {v}),
    (SELECT code FROM {lab} WHERE "column" = '{c}' AND value = 'Unknown'),
    (SELECT n FROM {lab}_sizes WHERE "column" = '{c}')) AS DOUBLE)"""


def long_form_sql(table: str, fit_table: str, key: str, cats, nums, text: str | None) -> str:
    """(id, idx, name, value) of the assembled features, text first."""
    parts = []
    ctes = [f"base AS (SELECT *, {key} AS __id FROM {table})", f"fitbase AS (SELECT *, {key} AS __id FROM {fit_table})"]
    if text:
        ctes.append(tokens_cte("fitbase", "__id", text, "f_").strip())
        ctes.append(vocab_cte("fitbase", "f_").strip())
        ctes.append(tokens_cte("base", "__id", text).strip())
        ctes.append(f"""vocab AS (SELECT * FROM f_vocab)""")
        ctes.append(tfidf_cte().strip())
        parts.append("SELECT key AS id, idx, 'text_tfidf_' || CAST(idx AS VARCHAR) AS name, weight AS value FROM tfidf "
                     "WHERE weight <> 0")
        ntext = "(SELECT count(*) FROM f_vocab)"
    else:
        ntext = "0"
    ctes.append(labels_cte("fitbase", cats))
    ctes.append(standardized_cte("base", "fitbase", nums, "__id"))
    for i, c in enumerate(cats):
        parts.append(f"SELECT __id AS id, CAST({ntext} + {i} AS INTEGER) AS idx, '{c}' AS name, "
                     f"{code_expr(c, 'base')} AS value FROM base")
    for i, c in enumerate(nums):
        parts.append(f"SELECT id, CAST({ntext} + {len(cats) + i} AS INTEGER) AS idx, '{c}' AS name, {c} AS value "
                     f"FROM scaled")
    body = " UNION ALL ".join(parts)
    return f"WITH {', '.join(ctes)} SELECT id, CAST(idx AS INTEGER) AS idx, name, {r6('value')} AS value FROM ({body})"


_cases_tbl = f"(WITH {CASES.strip()} SELECT * FROM cases)"
q("f8_assemble", long_form_sql(_cases_tbl, _cases_tbl, "case_id", CCAT, CNUM, "description"))

q("f9_feature_catalog", f"""
WITH base AS (SELECT *, case_id AS __id FROM {_cases_tbl} c),
{tokens_cte('base', '__id', 'description', 'f_').strip()}, {vocab_cte('base', 'f_').strip()}
SELECT 'text' AS "group", CAST(idx AS INTEGER) AS idx, 'text_tfidf_' || CAST(idx AS VARCHAR) AS name FROM f_vocab
UNION ALL SELECT 'categorical', CAST((SELECT count(*) FROM f_vocab) + i AS INTEGER), n
  FROM (SELECT unnest(range({len(CCAT)})) AS i, unnest({sql_list(CCAT)}) AS n)
UNION ALL SELECT 'numerical', CAST((SELECT count(*) FROM f_vocab) + {len(CCAT)} + i AS INTEGER), n
  FROM (SELECT unnest(range({len(CNUM)})) AS i, unnest({sql_list(CNUM)}) AS n)""")

q("f10_target_column", "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")

_li_train = f"(SELECT * FROM lineitem WHERE {HASH.format(k=LINE_ID)} % 100 < 80)"
q("f11_pipeline_fit_transform", long_form_sql("lineitem", _li_train, LINE_ID, ["l_returnflag", "l_linestatus"], LNUM,
                                              None))
q("f12_state_save_load", long_form_sql("lineitem", _li_train, LINE_ID, ["l_returnflag", "l_linestatus"], LNUM, None))

_lw = {"l_quantity": 0.02, "l_extendedprice": 0.05, "l_discount": -0.04, "l_tax": 0.01}
_lin = " + ".join(f"CAST({w!r} AS DOUBLE) * {c}" for c, w in _lw.items())
_fw = {"l_quantity": 0.12, "l_extendedprice": 0.10, "l_discount": -0.08, "l_tax": 0.05}
_flin = " + ".join(f"CAST({w!r} AS DOUBLE) * {c}" for c, w in _fw.items())
q("flagship_tier_summary", f"""
WITH li AS (SELECT *, {LINE_ID} AS lid FROM lineitem), {standardized_cte('li', 'li', LNUM, 'lid')},
sc AS (SELECT s.id, greatest(least(0.5 + ({_flin}), 1.0), 0.0) AS score FROM scaled s),
j AS (SELECT score, y FROM sc JOIN (SELECT {LINE_ID} AS id, l_tax * 10 AS y FROM lineitem) l ON sc.id = l.id)
SELECT CASE WHEN score > 0.7 THEN 'High' WHEN score > 0.4 THEN 'Medium' ELSE 'Low' END AS tier, count(*) AS n,
  {r6('avg(score)')} AS mean_score, {r6('min(score)')} AS min_score, {r6('max(score)')} AS max_score,
  {r6('sqrt(avg((score - y) * (score - y)))')} AS rmse, {r6('avg(abs(score - y))')} AS mae
FROM j GROUP BY 1""")


_ew = {"l_returnflag": 0.0, "l_linestatus": 0.0, "l_quantity": 0.02, "l_extendedprice": 0.05, "l_discount": -0.04, "l_tax": 0.01}
_avg = ", ".join(f"avg(bg.{c}) AS {c}" for c in _ew)
_exp = " + ".join(f"CAST({w!r} AS DOUBLE) * avg({c})" for c, w in _ew.items())
_codes = ", ".join(f"{c}_c AS (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS code "
                   f"FROM (SELECT DISTINCT {c} FROM lineitem))" for c in ("l_returnflag", "l_linestatus"))
# E2 with a linear scorer: a feature's share is its weight times its distance from the background rows drawn
q("e2_sampled_contributions", f"""
WITH li AS (SELECT *, {LINE_ID} AS lid FROM lineitem), {standardized_cte('li', 'li', LNUM, 'lid')}, {_codes},
x AS (SELECT s.id, a.code AS l_returnflag, b.code AS l_linestatus, {', '.join(f's.{c}' for c in LNUM)}
      FROM scaled s JOIN li ON s.id = li.lid JOIN l_returnflag_c a ON a.v = li.l_returnflag
      JOIN l_linestatus_c b ON b.v = li.l_linestatus),
bg AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {HASH.format(k='id')}, id) - 1 AS b FROM x) WHERE b < 100),
z AS (SELECT {_avg} FROM bg),
e AS (SELECT 0.5 + {_exp} AS expected_value FROM bg)
{" UNION ALL ".join(f"SELECT x.id, '{c}' AS feature, {r6('x.' + c)} AS value, {r6(f'CAST({w!r} AS DOUBLE) * (x.{c} - z.{c}) + 0.0')} AS shap, {r6('expected_value')} AS expected_value FROM x, z, e" for c, w in _ew.items())}""")

SQL["f12_text_state"] = SQL["f8_assemble"]
