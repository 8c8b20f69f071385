"""The registered queries as SQL over the same tables, for the check against DuckDB."""

from __future__ import annotations

_NET = "l_extendedprice * (1 - l_discount)"
_KEYS = "l_orderkey, l_linenumber, l_extendedprice, l_discount, l_returnflag"


def _d(number: str) -> str:
    return f"CAST({number} AS DOUBLE)"


_VARIANT = f"""
SELECT {_KEYS}, net, levy, relief, net + levy - relief AS total
FROM (
  SELECT *, net * {_d('0.08')} AS levy,
         CASE WHEN l_returnflag = 'R' THEN net * {_d('0.02')} ELSE {_d('0')} END AS relief
  FROM (SELECT {_KEYS}, {_NET} AS net FROM lineitem))
"""

_BASELINE = f"""
SELECT {_KEYS}, net, levy, net + levy AS total
FROM (SELECT *, net * {_d('0.05')} AS levy FROM (SELECT {_KEYS}, {_NET} AS net FROM lineitem))
"""

_DIFF = f"""
WITH priced AS (SELECT l_orderkey, l_linenumber, l_returnflag, {_NET} AS net FROM lineitem),
ruled AS (
  SELECT *, net * {_d('0.05')} AS levy_b, net * {_d('0.08')} AS levy_v,
         CASE WHEN l_returnflag = 'R' THEN net * {_d('0.02')} ELSE {_d('0')} END AS relief_v
  FROM priced)
SELECT l_orderkey, l_linenumber, net - net AS d_net, levy_v - levy_b AS d_levy,
       CAST(NULL AS DOUBLE) AS d_relief, (net + levy_v - relief_v) - (net + levy_b) AS d_total
FROM ruled
"""

_BRACKETS = f"""
WITH based AS (
  SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
    CASE WHEN o_totalprice - 20000 > 0 THEN o_totalprice - 20000 ELSE {_d('0')} END
      * CASE WHEN o_orderstatus IN ('F', 'O') AND o_custkey % 3 <> 0 THEN
          CASE o_orderpriority WHEN '1-URGENT' THEN {_d('0.5')} WHEN '2-HIGH' THEN {_d('0.75')} ELSE {_d('1')} END
        ELSE {_d('1')} END AS base
  FROM orders),
levied AS (
  SELECT *, CASE WHEN base = 0 THEN {_d('0')} ELSE
    least(base, {_d('100000')}) * {_d('0.1')} + CASE WHEN base > 100000 THEN base - {_d('100000')} ELSE {_d('0')} END * {_d('0.25')} END AS levy
  FROM based)
SELECT *, CAST(CASE WHEN levy / 500 > 120 THEN 120 + o_orderkey // 7 % 5 ELSE trunc(levy / 500) END AS DOUBLE) AS months FROM levied
"""

_FAULTS = f"""
WITH judged AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice, nullif(l_discount, {_d('0.05')}) AS discount,
    CASE WHEN l_linenumber <> 3 THEN l_extendedprice / CAST(l_linenumber - 3 AS DOUBLE) END AS unit,
    CASE l_returnflag WHEN 'R' THEN {_d('0.5')} + {_d('0.25')} WHEN 'N' THEN {_d('1')} + {_d('0.25')} END AS raw
  FROM lineitem),
rated AS (SELECT *, CASE WHEN unit IS NOT NULL THEN raw END AS rate FROM judged)
SELECT l_orderkey, l_linenumber, unit, rate, CASE WHEN rate IS NOT NULL THEN unit * rate * discount END AS due,
  CASE WHEN unit IS NULL THEN 'unit' WHEN rate IS NULL THEN 'rate' WHEN discount IS NULL THEN 'due' END AS component,
  CASE WHEN unit IS NULL THEN 'ZeroDivisionError' WHEN rate IS NULL THEN 'KeyError' WHEN discount IS NULL THEN 'TypeError' END AS error
FROM rated
"""

_BY_SUPPLIER = f"""
WITH rates AS (
  SELECT s_suppkey AS l_suppkey, CASE WHEN s_nationkey % 3 <> 0 THEN s_acctbal / 100000 END AS tau,
    CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey / CAST(50 AS DOUBLE) END AS rho
  FROM supplier),
netted AS (
  SELECT {_KEYS}, l_suppkey, {_NET} AS net, coalesce(tau, {_d('0.08')}) AS tau, coalesce(rho, {_d('0.02')}) AS rho
  FROM lineitem LEFT JOIN rates USING (l_suppkey)),
levied AS (SELECT *, net * tau AS levy, CASE WHEN l_returnflag = 'R' THEN net * rho ELSE {_d('0')} END AS relief FROM netted)
SELECT {_KEYS}, l_suppkey, net, levy, relief, net + levy - relief AS total FROM levied
"""

_CUSTOMER = """
SELECT CAST(c_custkey AS INTEGER) AS custkey, c_name AS name, c_nationkey AS nationkey,
       c_acctbal AS acctbal, c_mktsegment AS mktsegment
FROM customer
"""

_DUES = f"""
SELECT *, CASE WHEN mktsegment = 'BUILDING' THEN due * {_d('0.5')} ELSE {_d('0')} END AS bonus
FROM (SELECT *, acctbal * {_d('0.1')} AS due FROM ({_CUSTOMER}))
"""

_FLOAT_PATTERN = (
    "[+-]?(?i:inf|infinity|nan|([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?)"
)


def _kind(cell: str) -> str:
    return f"""CASE
      WHEN regexp_full_match({cell}, '[+-]?[0-9]+')
           AND TRY_CAST({cell} AS DOUBLE) BETWEEN -2147483648 AND 2147483647 THEN 0
      WHEN regexp_full_match({cell}, '{_FLOAT_PATTERN}') THEN 1
      ELSE 2 END"""


def _short(number: str) -> str:
    return f"regexp_replace(CAST({number} AS VARCHAR), '\\.0$', '')"


_FORMS = {
    "value": "CAST(value AS VARCHAR)",
    "short": _short("value"),
    "key": "CAST(event_id AS VARCHAR)",
    "signed": "'+' || event_id",
    "blank": "' ' || event_id",
    "large": "event_id || '000000'",
    "point": "string_split(CAST(value AS VARCHAR), '.')[1] || '.'",
    "exponent": "value || 'e' || event_id",
    "suffix": "value || 'd'",
    "group": "event_id || '_000'",
    "newline": "event_id || chr(10)",
    "type": "event_type",
    "props": "props",
    "special": "CASE event_type WHEN 'error' THEN '-NaN' WHEN 'view' THEN 'iNf' WHEN 'click' THEN ''"
    " WHEN 'signup' THEN '.' ELSE 'infinit' END",
}

_CELL_KINDS = " UNION ALL ".join(
    f"SELECT event_id, '{form}' AS form, {_kind('(' + cell + ')')} AS kind FROM events"
    for form, cell in _FORMS.items()
)

_LINE_TEXT = {
    name: f"CAST({name} AS VARCHAR)"
    for name in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
} | {"short_price": _short("l_extendedprice")}

_COLUMN_TYPES = " UNION ALL ".join(
    f"""SELECT '{name}' AS attribute, CASE WHEN min(kind) <> max(kind) THEN 'mixed' WHEN min(kind) = 0 THEN 'int'
        WHEN min(kind) = 1 THEN 'double' ELSE 'string' END AS type
        FROM (SELECT {_kind(cell)} AS kind FROM lineitem)"""
    for name, cell in _LINE_TEXT.items()
)

_ORDER_TEXT = {
    "customer": "CAST(o_custkey AS VARCHAR)",
    "status": "o_orderstatus",
    "price": _short("o_totalprice"),
}

_FIRST_MISMATCH = (
    "WITH kinds AS ("
    + " UNION ALL ".join(
        f"SELECT o_orderkey + 1 AS place, '{name}' AS attribute, {_kind(cell)} AS kind FROM orders"
        for name, cell in _ORDER_TEXT.items()
    )
    + """),
neighbours AS (
  SELECT place, attribute, kind, lead(kind) OVER (PARTITION BY attribute ORDER BY place) AS following FROM kinds)
SELECT place AS index, attribute FROM neighbours WHERE following <> kind ORDER BY place, attribute LIMIT 1"""
)

_NULL_CELLS = """
SELECT attribute, min(place) AS index FROM (
  SELECT 'priority' AS attribute, o_orderkey + 1 AS place FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'
  UNION ALL SELECT 'status', o_orderkey + 1 FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'price', o_orderkey + 1 FROM orders WHERE o_totalprice >= 400000)
GROUP BY attribute
"""

_GAPS = """
SELECT CASE WHEN o_orderkey > 0 THEN o_orderkey END AS o_orderkey, attribute FROM (
  SELECT o_orderkey, 'price' AS attribute FROM orders WHERE NOT o_totalprice > 50000
  UNION ALL SELECT o_orderkey, 'priority' FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'
  UNION ALL SELECT o_orderkey, 'date' FROM orders WHERE o_orderstatus = 'P')
"""

_WORD_GAPS = """
WITH have AS (SELECT DISTINCT nullif(lang, 'es') AS lang, unnest(string_split(text, ' ')) AS word FROM documents),
held AS (SELECT word, list(coalesce(lang, 'none')) AS langs FROM have GROUP BY word),
langs AS (SELECT DISTINCT lang FROM have)
SELECT lang, word FROM held, langs WHERE NOT list_contains(langs, coalesce(lang, 'none'))
"""

_TYPE_FAULT = """
WITH placed AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS place, o_orderkey FROM orders)
SELECT min(place) - 1 AS index, 'price' AS attribute FROM placed WHERE o_orderkey >= 700
"""

_RAGGED = """
SELECT event_id || ';' || event_type || CASE WHEN event_type = 'error' THEN ';' || value || ';late' ELSE '' END
       AS record
FROM events WHERE event_type IN ('signup', 'error')
UNION ALL SELECT repeat(' ', CAST(event_id % 3 + 1 AS INTEGER)) FROM events WHERE event_type = 'click'
"""

_VALID = "FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING')"

_POLICIES = f"""
SELECT CAST(c_custkey AS VARCHAR) AS source, c_name AS policy, 'Segment ' || c_mktsegment AS label,
       2 AS components {_VALID}
"""

_POLICY_ERRORS = """
SELECT CAST(c_custkey AS VARCHAR) AS source,
       'missing keys: name' AS error
FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL
SELECT CAST(c_custkey AS VARCHAR),
       CASE c_custkey % 5 WHEN 0 THEN 'unknown keys: komposante'
            WHEN 3 THEN 'component 2: logical_order is missing' WHEN 4 THEN 'component 2: values is not a list of numbers'
            ELSE 'component 2: logical_order is not a 32-bit integer' END
FROM customer WHERE c_mktsegment = 'BUILDING'
"""

_COMPONENTS = f"""
SELECT CAST(c_custkey AS VARCHAR) AS source, c_name AS policy,
       CASE WHEN c_nationkey <= 12 THEN 1 ELSE 2 END AS rank, 1 AS position, 'relief' AS component,
       c_nationkey AS logical_order, 'Relief' AS label, 'acctbal,' || lower(c_mktsegment) AS dependencies,
       'def relief(v, p, a):' || chr(10) || '    return p["rho"] * a["acctbal"]' || chr(10) AS function {_VALID}
UNION ALL
SELECT CAST(c_custkey AS VARCHAR), c_name, CASE WHEN c_nationkey <= 12 THEN 2 ELSE 1 END, 2, 'levy', 12,
       'Levy', '', 'def levy(v, p, a):' || chr(10) || '    return p["tau"]' || chr(10) {_VALID}
"""

_RANKS = f"""ranks AS (
  SELECT CAST(c_custkey AS VARCHAR) AS source, CASE WHEN c_nationkey <= 12 THEN 1 ELSE 2 END AS relief_rank,
         CASE WHEN c_nationkey <= 12 THEN 2 ELSE 1 END AS levy_rank, c_acctbal, c_nationkey {_VALID})"""

_PARAMETER_VALUES = f"""
WITH {_RANKS}
SELECT source, relief_rank AS rank, 'relief' AS component, 1 AS parameter_position, 'rho' AS name,
       c_acctbal AS value FROM ranks
UNION ALL SELECT source, relief_rank, 'relief', 2, 'cap', 3.0 FROM ranks
UNION ALL SELECT source, levy_rank, 'levy', 1, 'tau', CAST(c_nationkey AS DOUBLE) FROM ranks
"""

_PARAMETER_LABELS = f"""
WITH {_RANKS}
SELECT source, relief_rank AS rank, 'relief' AS component, 1 AS parameter_position, 'rho' AS name,
       'Share' AS label FROM ranks
UNION ALL SELECT source, levy_rank, 'levy', 1, 'tau', 'Rate' FROM ranks
"""

_PAIRS = """
WITH lists AS (
  SELECT conv_id, turn, string_split(text, ' ') AS names,
         CASE WHEN role <> 'system' THEN string_split(text, '.') END AS words FROM conversations),
places AS (SELECT *, unnest(range(1, least(len(names), coalesce(len(words), 0)) + 1)) AS place FROM lists)
SELECT conv_id, turn, CAST(place AS INTEGER) AS parameter_position, names[place] AS name,
       CAST(length(words[place]) AS DOUBLE) AS value
FROM places
"""

_LINE_COMPONENTS = """
SELECT l_suppkey AS policy, 'flag_' || l_returnflag AS attribute FROM lineitem
UNION SELECT l_suppkey, 'status_' || l_linestatus FROM lineitem
UNION SELECT l_suppkey, 'line_' || l_linenumber FROM lineitem
"""

_RESOLUTION = """
WITH parts AS (
  SELECT o_orderpriority AS policy, lower(o_orderstatus) AS own, o_totalprice, o_custkey, o_orderkey,
         CASE WHEN o_totalprice < 2000 THEN 'unknown' ELSE lower(o_orderstatus) END AS component,
         'def ' || lower(o_orderstatus) || '(v, p, a):' || chr(10) || '    return ' || o_totalprice
         || CASE WHEN o_totalprice > 300000 THEN chr(10) || 'def helper(v, p, a):' || chr(10) || '    f = 1'
              || chr(10) || '    return f' || chr(10) || 'f = lambda v, p, a: 0.0' ELSE '' END AS function
  FROM orders),
defined AS (
  SELECT policy, own AS name, o_custkey, o_orderkey, function FROM parts
  UNION ALL SELECT policy, 'f', o_custkey, o_orderkey, function FROM parts WHERE o_totalprice > 300000),
last AS (
  SELECT * FROM defined
  QUALIFY row_number() OVER (PARTITION BY policy, name ORDER BY o_custkey DESC, o_orderkey DESC) = 1)
SELECT p.policy, p.component, CAST(last.o_custkey AS INTEGER) AS defined_by_o_custkey, CAST(last.o_orderkey AS INTEGER) AS defined_by_o_orderkey,
       last.function
FROM (SELECT DISTINCT policy, component FROM parts) p
LEFT JOIN last ON last.policy = p.policy AND last.name = p.component
"""

ORACLES: dict[str, str] = {
    "apply_policy": _VARIANT,
    "scenario_diff_keyed_strict": f"SELECT o_orderkey, o_totalprice * {_d('0.08')} - o_totalprice * {_d('0.05')} AS levy FROM orders",
    "checked_table": _CUSTOMER,
    "policy_by_supplier": _BY_SUPPLIER,
    "rule_faults_compiled": _FAULTS,
    "rule_faults_python": _FAULTS,
    "read_quoted_breaks": "SELECT CAST(doc_id AS INTEGER) AS doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents",
    "apply_policy_compiled": _VARIANT,
    "apply_brackets_compiled": _BRACKETS,
    "scenario_diff_compiled": _DIFF,
    "apply_policy_python": _VARIANT,
    "apply_policy_vector": _VARIANT,
    "apply_policy_mixed": _VARIANT,
    "extra_outputs": f"""
SELECT o_orderkey, o_totalprice, (o_totalprice * {_d('0.05')} + o_totalprice * {_d('0.08')}) / 2 AS levy,
       o_totalprice * {_d('0.05')} AS low, o_totalprice * {_d('0.08')} AS high
FROM orders
""",
    "scenario_baseline": _BASELINE,
    "scenario_variant": _VARIANT,
    "scenario_diff": _DIFF,
    "scenario_diff_python": _DIFF,
    "scenario_diff_keyed": f"""
WITH base AS (SELECT o_orderkey, o_totalprice * {_d('0.05')} AS levy FROM orders WHERE o_orderstatus <> 'P'),
variant AS (SELECT o_orderkey, o_totalprice * {_d('0.08')} AS levy FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT variant.o_orderkey, variant.levy - base.levy AS levy, CAST(NULL AS DOUBLE) AS surcharge
FROM variant LEFT JOIN base ON base.o_orderkey = variant.o_orderkey
""",
    "scenario_run": f"""
SELECT row_number() OVER (ORDER BY custkey) AS "Index", custkey,
       acctbal * {_d('0.25')} - acctbal * {_d('0.1')} AS due, CAST(NULL AS DOUBLE) AS bonus
FROM ({_CUSTOMER})
""",
    "read_delimited": _CUSTOMER,
    "read_delimited_typed": _CUSTOMER,
    "write_delimited": _DUES,
    "ragged_rows": _RAGGED,
    "read_arrow_ipc": _CUSTOMER,
    "write_arrow_ipc": _DUES,
    "cell_kinds": _CELL_KINDS,
    "column_types": _COLUMN_TYPES,
    "first_type_mismatch": _FIRST_MISMATCH,
    "null_cells": _NULL_CELLS,
    "attribute_gaps": _GAPS,
    "attribute_gaps_words": _WORD_GAPS,
    "type_fault": _TYPE_FAULT,
    "duplicate_header": "SELECT CAST(c_custkey AS INTEGER) AS custkey, c_mktsegment AS label FROM customer",
    "policy_tables": _POLICIES,
    "policy_errors": _POLICY_ERRORS,
    "policy_components": _COMPONENTS,
    "policy_parameter_values": _PARAMETER_VALUES,
    "policy_parameter_labels": _PARAMETER_LABELS,
    "parameter_pairs": _PAIRS,
    "component_order": """
SELECT o_orderpriority AS policy, o_custkey AS logical_order, o_orderkey AS position,
       row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS rank
FROM orders
""",
    "parameter_merge": """
SELECT o_orderstatus AS policy, o_orderpriority AS name, arg_max(o_totalprice, (o_custkey, o_orderkey)) AS value
FROM orders GROUP BY ALL
""",
    "dependency_set": _LINE_COMPONENTS,
    "missing_dependencies": f"""
SELECT * FROM ({_LINE_COMPONENTS})
WHERE attribute NOT IN ('flag_A', 'flag_N', 'status_O', 'line_1', 'line_2', 'line_3')
""",
    "function_resolution": _RESOLUTION,
    "results_to_columns": f"""
SELECT o_orderkey, CASE WHEN mapped THEN o_totalprice * {_d('0.05')} END AS levy,
       CASE WHEN mapped AND o_orderstatus <> 'P' THEN o_totalprice * {_d('0.01')} END AS relief,
       CASE WHEN mapped THEN o_totalprice END AS total
FROM (SELECT *, o_orderstatus = 'P' OR o_orderpriority <> '5-LOW' AS mapped FROM orders)
""",
    "missing_results": """
SELECT o_orderkey, 'relief' AS name FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, unnest(['levy', 'relief', 'total']) FROM orders
WHERE o_orderstatus <> 'P' AND o_orderpriority = '5-LOW'
""",
    "result_names": "SELECT unnest(['levy', 'relief', 'total']) AS name",
    "indexed_results": f"""
SELECT row_number() OVER (ORDER BY custkey) AS "Index", custkey, acctbal * {_d('0.1')} AS due FROM ({_CUSTOMER})
""",
    "indexed_input": f"""
SELECT row_number() OVER (ORDER BY custkey) AS "Index", custkey FROM ({_CUSTOMER})
""",
    "output_layout": f"""
SELECT acctbal, CAST(NULL AS DOUBLE) AS bonus, custkey, acctbal * {_d('0.25')} - acctbal * {_d('0.1')} AS due,
       mktsegment, name, nationkey
FROM ({_CUSTOMER})
""",
}
