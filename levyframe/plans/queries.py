"""The registered queries: each takes (spark, folder of Parquet tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe.functions.cells import cell_kind
from levyframe.operators import checks, policy_tables
from levyframe.operators.by_key import apply_policy_by_key
from levyframe.operators.compare import (
    BASELINE,
    DIFF,
    VARIANT,
    compare_policies,
    diff_results,
    difference_results,
    results_of,
)
from levyframe.operators.evaluate import apply_policy
from levyframe.operators.layout import output_layout, result_names, results_to_columns
from levyframe.operators.ordering import with_index
from levyframe.operators.rules import COLUMN, VECTOR, Component, Policy
from levyframe.plans import policies
from levyframe.plans.scenario import run_scenario
from levyframe.sources.delimited import (
    POSITIONS,
    locate_type_fault,
    ragged_rows,
    read_delimited,
    read_text_cells,
    write_delimited,
)
from levyframe.sources.households import read_households, write_arrow_ipc
from levyframe.sources.policy_files import parse_policies, policy_from_text
from levyframe.storage import fresh_path

Query = Callable[[SparkSession, str], DataFrame]

DOCUMENTS_IN_TASK = 5_000
LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(*LINE_COLUMNS)


# Rule evaluation and comparison ------------------------------------------------------------------------


def apply_policy_query(spark: SparkSession, folder: str) -> DataFrame:
    return apply_policy(lines(spark, folder), policies.variant())


def apply_policy_python(spark: SparkSession, folder: str) -> DataFrame:
    return apply_policy(lines(spark, folder), policies.python_variant())


def apply_policy_vector(spark: SparkSession, folder: str) -> DataFrame:
    return apply_policy(lines(spark, folder), policies.variant(VECTOR))


def apply_policy_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return apply_policy(lines(spark, folder), policies.variant(COLUMN, VECTOR))


def apply_policy_compiled(spark: SparkSession, folder: str) -> DataFrame:
    """The Python source of a policy file as columns."""
    return apply_policy(lines(spark, folder), policy_from_text(spark, policies.VARIANT_FILE), compiled=True)


def apply_brackets_compiled(spark: SparkSession, folder: str) -> DataFrame:
    """Branches, local names, helpers and a dictionary; one status is NULL."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_totalprice", "o_orderpriority"
    )
    rules = policy_from_text(spark, policies.BRACKETS_FILE)
    return apply_policy(orders, rules, compiled=True).select("o_orderkey", "o_orderstatus", *rules.outputs)


def scenario_diff_compiled(spark: SparkSession, folder: str) -> DataFrame:
    """Both policies from files, compiled; what they share is one column."""
    base, variant = (policy_from_text(spark, text) for text in (policies.BASELINE_FILE, policies.VARIANT_FILE))
    return _differences(spark, folder, base, variant, compiled=True)


def _rule_faults(spark: SparkSession, folder: str, **options: bool) -> DataFrame:
    """Rows that are errors of a rule, beside the results of all others."""
    discount = F.nullif(F.col("l_discount"), F.lit(0.05)).alias("l_discount")
    rows = lines(spark, folder).select("l_orderkey", "l_linenumber", "l_extendedprice", discount, "l_returnflag")
    rules = policy_from_text(spark, policies.FAULTS_FILE)
    wide = apply_policy(rows, rules, faults=True, **options)
    kind = F.split(F.col("fault.message"), ": ")[1].alias("error")
    return wide.select("l_orderkey", "l_linenumber", *rules.outputs, F.col("fault.component").alias("component"), kind)


def rule_faults_compiled(spark: SparkSession, folder: str) -> DataFrame:
    return _rule_faults(spark, folder, compiled=True)


def rule_faults_python(spark: SparkSession, folder: str) -> DataFrame:
    return _rule_faults(spark, folder, trust_source=True)


def policy_by_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier has its own rates; some have only one of them, some none."""
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal", "s_nationkey")
    rates = F.array(
        F.when(F.col("s_nationkey") % 3 != 0, F.struct(F.lit("tau").alias("name"), (F.col("s_acctbal") / 100000).alias("value"))),
        F.when(F.col("s_nationkey") % 2 == 0, F.struct(F.lit("rho").alias("name"), (F.col("s_nationkey") / 50).alias("value"))),
    )
    parameters = supplier.select("l_suppkey", F.inline(F.array_compact(rates)))
    rows = table(spark, folder, "lineitem").select(*LINE_COLUMNS, "l_suppkey")
    rules = policy_from_text(spark, policies.VARIANT_FILE)
    return apply_policy_by_key(rows, rules, "l_suppkey", parameters, compiled=True)


def _one_of_both(spark: SparkSession, folder: str, which: str, names: list[str]) -> DataFrame:
    """One policy's results out of a pass that evaluates both."""
    wide = compare_policies(lines(spark, folder), policies.baseline(), policies.variant())
    return results_of(wide, which, LINE_COLUMNS, names)


def scenario_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return _one_of_both(spark, folder, BASELINE, policies.baseline().outputs)


def scenario_variant(spark: SparkSession, folder: str) -> DataFrame:
    return _one_of_both(spark, folder, VARIANT, policies.variant().outputs)


def extra_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """A rule that gives two results more than its own."""

    def levies(v, p, a):
        v["low"], v["high"] = a["o_totalprice"] * p["low"], a["o_totalprice"] * p["high"]
        return (v["low"] + v["high"]) / 2

    rule = Component("levy", levies, {"low": 0.05, "high": 0.08}, extra_outputs=("low", "high"))
    return apply_policy(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), Policy("range", [rule]))


def _differences(spark: SparkSession, folder: str, base: Policy, variant: Policy, **options: bool) -> DataFrame:
    wide = compare_policies(lines(spark, folder), base, variant, **options)
    named = [F.col(DIFF + name).alias("d_" + name) for name in variant.outputs]
    return wide.select("l_orderkey", "l_linenumber", *named)


def scenario_diff(spark: SparkSession, folder: str) -> DataFrame:
    return _differences(spark, folder, policies.baseline(), policies.variant())


def scenario_diff_python(spark: SparkSession, folder: str) -> DataFrame:
    return _differences(spark, folder, policies.python_baseline(), policies.python_variant())


def scenario_diff_keyed(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    price = F.col("o_totalprice")
    base_rows = orders.where("o_orderstatus <> 'P'")
    stored_base = base_rows.select("o_orderkey", (price * 0.05).alias("levy"), (price + price * 0.05).alias("total"))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", price * 0.01).otherwise(0.0)
    variant_rows = orders.where("o_orderpriority <> '5-LOW'")
    stored_variant = variant_rows.select("o_orderkey", (price * 0.08).alias("levy"), urgent.alias("surcharge"))
    return diff_results(stored_base, stored_variant, "o_orderkey", check_rows=False)


def scenario_diff_keyed_strict(spark: SparkSession, folder: str) -> DataFrame:
    """Two stored results that must have the same keys, in different orders of rows."""
    orders = table(spark, folder, "orders")
    price = F.col("o_totalprice")
    base = orders.select("o_orderkey", (price * 0.05).alias("levy"))
    variant = orders.orderBy("o_custkey").select((price * 0.08).alias("levy"), "o_orderkey")
    return diff_results(base, variant, "o_orderkey", check_rows=True)


# Files -------------------------------------------------------------------------------------------------


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("int").alias("custkey"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("mktsegment"),
    )


CUSTOMER_SCHEMA = {
    "custkey": T.IntegerType(),
    "name": T.StringType(),
    "nationkey": T.IntegerType(),
    "acctbal": T.DoubleType(),
    "mktsegment": T.StringType(),
}
CUSTOMER_COLUMNS = list(CUSTOMER_SCHEMA)


def _customers_as_text(spark: SparkSession, folder: str) -> str:
    path = fresh_path(spark, "customers.csv")
    write_delimited(customers(spark, folder), path)
    return path


def _ordered_customers_as_text(spark: SparkSession, folder: str) -> str:
    """Several files whose order, and the order within, is that of the key."""
    path = fresh_path(spark, "ordered.csv")
    write_delimited(customers(spark, folder).repartitionByRange(8, "custkey").sortWithinPartitions("custkey"), path)
    return path


def read_delimited_query(spark: SparkSession, folder: str) -> DataFrame:
    return read_delimited(spark, _customers_as_text(spark, folder))


def read_delimited_typed(spark: SparkSession, folder: str) -> DataFrame:
    return read_delimited(spark, _customers_as_text(spark, folder), CUSTOMER_SCHEMA)


def read_quoted_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with their line breaks, in files of several blocks: one of every two tasks that read the texts."""
    path = fresh_path(spark, "texts.csv")
    texts = table(spark, folder, "documents").select(F.col("doc_id").cast("int").alias("doc_id"), "lang", "text")
    write_delimited(texts.coalesce((texts.rdd.getNumPartitions() + 1) // 2), path)
    return read_delimited(spark, path, {"doc_id": T.IntegerType(), "lang": T.StringType(), "text": T.StringType()}, multi_line=True)


def write_delimited_query(spark: SparkSession, folder: str) -> DataFrame:
    results = apply_policy(customers(spark, folder), policies.account_policy(0.1, True))
    path = fresh_path(spark, "results.csv")
    write_delimited(output_layout(results, CUSTOMER_COLUMNS, ["due", "bonus"], "csv"), path)
    return read_delimited(spark, path)


def ragged_rows_query(spark: SparkSession, folder: str) -> DataFrame:
    header = "event_id;event_type;value"
    short = F.concat_ws(";", "event_id", "event_type")
    line = (
        F.when(F.col("event_type") == "signup", short)
        .when(F.col("event_type") == "error", F.concat_ws(";", short, "value", F.lit("late")))
        .when(F.col("event_type") == "click", F.repeat(F.lit(" "), F.pmod("event_id", F.lit(3)).cast("int") + 1))
        .otherwise(F.concat_ws(";", short, "value"))
    )
    path = fresh_path(spark, "events.csv")
    written = table(spark, folder, "events").select(line.alias(header)).write
    written.option("header", True).option("sep", "\u0001").option("quote", "").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return ragged_rows(spark, path).select("record")


def _customers_as_arrow(spark: SparkSession, folder: str) -> str:
    path = fresh_path(spark, "customers.arrow")
    write_arrow_ipc(customers(spark, folder), path)
    return path


def read_arrow_ipc(spark: SparkSession, folder: str) -> DataFrame:
    return read_households(spark, _customers_as_arrow(spark, folder), "arrow")


def write_arrow_ipc_query(spark: SparkSession, folder: str) -> DataFrame:
    results = apply_policy(customers(spark, folder), policies.account_policy(0.1, True))
    path = fresh_path(spark, "results.arrow")
    write_arrow_ipc(output_layout(results, CUSTOMER_COLUMNS, ["due", "bonus"], "arrow"), path)
    return read_households(spark, path, "arrow")


def scenario_run(spark: SparkSession, folder: str) -> DataFrame:
    """Files to files, then the written difference read back."""
    households = _ordered_customers_as_text(spark, folder)
    written = run_scenario(
        spark,
        households,
        "csv",
        policies.account_policy(0.1, False),
        policies.account_policy(0.25, True),
        folder=fresh_path(spark, "run"),
        prefix="customers",
    )
    cells = read_text_cells(spark, written["diff"])
    return cells.select(
        F.col("Index").cast("long").alias("Index"),
        F.col("custkey").cast("int").alias("custkey"),
        F.col("due").cast("double").alias("due"),
        F.nullif(F.col("bonus"), F.lit("")).cast("double").alias("bonus"),
    )


# Typing and checks -------------------------------------------------------------------------------------


def _without_zero(number: Column) -> Column:
    """A float as text, whole numbers without their '.0'."""
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def cell_kinds(spark: SparkSession, folder: str) -> DataFrame:
    value, key = F.col("value").cast("string"), F.col("event_id").cast("string")
    whole = F.split("value", r"\.")[0]
    forms = {
        "value": value,
        "short": _without_zero(F.col("value")),
        "key": key,
        "signed": F.concat(F.lit("+"), key),
        "blank": F.concat(F.lit(" "), key),
        "large": F.concat(key, F.lit("000000")),
        "point": F.concat(whole, F.lit(".")),
        "exponent": F.concat(value, F.lit("e"), key),
        "suffix": F.concat(value, F.lit("d")),
        "group": F.concat(key, F.lit("_000")),
        "newline": F.concat(key, F.lit("\n")),
        "type": F.col("event_type"),
        "props": F.col("props"),
        "special": F.when(F.col("event_type") == "error", "-NaN").when(F.col("event_type") == "view", "iNf")
        .when(F.col("event_type") == "click", "").when(F.col("event_type") == "signup", ".").otherwise("infinit"),
    }
    cells = F.array(*(F.struct(F.lit(name).alias("form"), cell.alias("cell")) for name, cell in forms.items()))
    long = table(spark, folder, "events").select("event_id", F.explode(cells).alias("c"))
    return long.select("event_id", F.col("c.form").alias("form"), cell_kind(F.col("c.cell")).alias("kind"))


def column_types(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    text = lineitem.select(
        *(F.col(name).cast("string").alias(name) for name in lineitem.columns),
        _without_zero(F.col("l_extendedprice")).alias("short_price"),
    )
    return checks.column_types(text)


def first_type_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        (F.col("o_orderkey") + 1).alias("at"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.col("o_orderstatus").alias("status"),
        _without_zero(F.col("o_totalprice")).alias("price"),
    )
    return checks.first_type_mismatch(orders, "at")


def type_fault(spark: SparkSession, folder: str) -> DataFrame:
    """Where a written table first mixes kinds, found in the text."""
    price = F.when(F.col("o_orderkey") < 700, F.col("o_totalprice").cast("string")).otherwise("late")
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderkey").alias("key"), price.alias("price")
    )
    path = fresh_path(spark, "orders.csv")
    write_delimited(orders.repartitionByRange(4, "key").sortWithinPartitions("key").drop("key"), path)
    return locate_type_fault(spark, path)


def duplicate_header(spark: SparkSession, folder: str) -> DataFrame:
    """Of two columns with one name the last stays."""
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("custkey;label;label")
    path = fresh_path(spark, "twice.csv")
    written = table(spark, folder, "customer").select(line).write
    written.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return read_delimited(spark, path)


def checked_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table that holds a row, supported types and no NULL, or the query stops."""
    return checks.check_table(customers(spark, folder))


def null_cells(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        (F.col("o_orderkey") + 1).alias("at"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("priority"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice")).alias("price"),
        F.col("o_custkey").alias("customer"),
    )
    return checks.null_cells(orders, "at")


def attribute_gaps(spark: SparkSession, folder: str) -> DataFrame:
    held = F.array_compact(
        F.array(
            F.lit("status"),
            F.when(F.col("o_totalprice") > 50000, "price"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", "priority"),
            F.when(F.col("o_orderstatus") != "P", "date"),
        )
    )
    key = F.when(F.col("o_orderkey") > 0, F.col("o_orderkey")).alias("o_orderkey")  # order 0 is the NULL entity
    eav = table(spark, folder, "orders").select(key, F.explode(held).alias("attribute"))
    return checks.attribute_gaps(eav, "o_orderkey", "attribute")


def attribute_gaps_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all texts that a language lacks though another has them: very many names."""
    words = F.explode(F.split("text", " ")).alias("word")
    eav = table(spark, folder, "documents").select(F.nullif("lang", F.lit("es")).alias("lang"), words)
    return checks.attribute_gaps(eav, "lang", "word")


# Policy tables -----------------------------------------------------------------------------------------


def policy_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One TOML document per customer; two market segments write faulty ones, with faults of several kinds."""
    segment = F.col("c_mktsegment")
    balance = F.col("c_acctbal").cast("string")

    def quoted(cell: Column) -> Column:
        return F.concat(F.lit('"'), cell, F.lit('"'))

    named = F.when(segment != "MACHINERY", F.concat(F.lit("name = "), quoted(F.col("c_name")), F.lit("\n")))
    fault = F.when(segment == "BUILDING", F.pmod("c_custkey", F.lit(5)))
    second = F.when(fault == 0, F.lit("[[komposante]]\n")).otherwise(F.lit("[[composante]]\n"))
    order = (
        F.when(fault == 1, F.lit("logical_order = 4294967296\n"))
        .when(fault == 2, F.lit('logical_order = "12"\n'))
        .when(fault == 3, F.lit(""))
        .otherwise(F.lit("logical_order = 12\n"))
    )
    rate = F.when(fault == 4, F.lit('"high"')).otherwise(F.col("c_nationkey").cast("string"))
    parts = [
        F.coalesce(named, F.lit("")),
        F.lit("intitule_long = "), quoted(F.concat(F.lit("Segment "), segment)), F.lit("\n\n"),
        F.lit('[[composante]]\nname = "relief"\nintitule_long = "Relief"\n'),
        F.lit("logical_order = "), F.col("c_nationkey").cast("string"), F.lit("\n"),
        F.lit('caracteristiques_dependencies = ["acctbal", '), quoted(F.lower(segment)), F.lit("]\n"),
        F.lit("function = '''\ndef relief(v, p, a):\n    return p[\"rho\"] * a[\"acctbal\"]\n'''\n"),
        F.lit('[composante.parameters]\nnames = ["rho", "cap"]\nintitules_long = ["Share"]\n'),
        F.lit("values = ["), balance, F.lit(", 3, 4.5]\n\n"),
        second,
        F.lit('name = "levy"\nintitule_long = "Levy"\n'), order, F.lit("caracteristiques_dependencies = []\n"),
        F.lit("function = '''\ndef levy(v, p, a):\n    return p[\"tau\"]\n'''\n"),
        F.lit('parameters = { names = ["tau"], intitules_long = ["Rate", "Spare"], values = ['),
        rate, F.lit("] }\n"),
    ]
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    # A few bytes of a customer become a document that takes long to parse: a file's one task would parse all of them.
    dealt = customer.repartition(1 + customer.count() // DOCUMENTS_IN_TASK)
    return parse_policies(dealt.select("c_custkey", F.concat(*parts).alias("text")), "c_custkey", "text")


def policy_table(spark: SparkSession, folder: str) -> DataFrame:
    return policy_tables.policies(policy_documents(spark, folder))


def policy_errors(spark: SparkSession, folder: str) -> DataFrame:
    return policy_tables.policy_errors(policy_documents(spark, folder))


def policy_components(spark: SparkSession, folder: str) -> DataFrame:
    return policy_tables.components(policy_documents(spark, folder)).select(
        "source", "policy", "rank", "position", "component", "logical_order", "label",
        F.array_join("dependencies", ",").alias("dependencies"), "function",
    )


def policy_parameter_values(spark: SparkSession, folder: str) -> DataFrame:
    parts = policy_tables.components(policy_documents(spark, folder))
    return policy_tables.parameter_values(parts, ["source", "rank", "component"])


def policy_parameter_labels(spark: SparkSession, folder: str) -> DataFrame:
    parts = policy_tables.components(policy_documents(spark, folder))
    return policy_tables.parameter_labels(parts, ["source", "rank", "component"])


def parameter_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each turn as names, the lengths of its sentences as values; one role has no values."""
    lengths = F.transform(F.split("text", "[.]"), lambda part: F.length(part).cast("double"))
    turns = table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.split("text", " ").alias("names"),
        F.when(F.col("role") != "system", lengths).alias("values"),
    )
    return policy_tables.parameter_values(turns, ["conv_id", "turn"], "names", "values")


def component_order(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("policy"),
        F.col("o_custkey").alias("logical_order"),
        F.col("o_orderkey").alias("position"),
    )
    return policy_tables.ordered_components(orders, ["policy"], "logical_order", "position")


def parameter_merge(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("policy"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_totalprice").alias("value"),
        F.col("o_custkey").cast("int").alias("o_custkey"),
        F.col("o_orderkey").cast("int").alias("o_orderkey"),
    )
    return policy_tables.merged_parameters(orders, ["policy"], "name", "value", ["o_custkey", "o_orderkey"])


def _line_components(spark: SparkSession, folder: str) -> DataFrame:
    declared = F.array(
        F.concat(F.lit("flag_"), "l_returnflag"),
        F.concat(F.lit("status_"), "l_linestatus"),
        F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")),
    )
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("policy"), declared.alias("dependencies"))


def dependency_set(spark: SparkSession, folder: str) -> DataFrame:
    return policy_tables.dependency_set(_line_components(spark, folder), ["policy"])


def missing_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["flag_A", "flag_N", "status_O", "line_1", "line_2", "line_3"]
    return policy_tables.missing_dependencies(_line_components(spark, folder), ["policy"], columns)


def function_resolution(spark: SparkSession, folder: str) -> DataFrame:
    status = F.lower("o_orderstatus")
    own = F.concat(F.lit("def "), status, F.lit("(v, p, a):\n    return "), F.col("o_totalprice").cast("string"))
    helper = F.lit("\ndef helper(v, p, a):\n    f = 1\n    return f\nf = lambda v, p, a: 0.0")
    source = F.concat(own, F.when(F.col("o_totalprice") > 300000, helper).otherwise(F.lit("")))
    orders = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("policy"),
        F.when(F.col("o_totalprice") < 2000, F.lit("unknown")).otherwise(status).alias("component"),
        source.alias("function"),
        F.col("o_custkey").cast("int").alias("o_custkey"),
        F.col("o_orderkey").cast("int").alias("o_orderkey"),
    )
    return policy_tables.function_resolution(orders, ["policy"], order=["o_custkey", "o_orderkey"])


# Results -----------------------------------------------------------------------------------------------


def _result_maps(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice")
    always = F.create_map(F.lit("total"), price, F.lit("levy"), price * 0.05)
    relief = F.create_map(F.lit("relief"), price * 0.01)
    results = F.when(F.col("o_orderstatus") == "P", always).when(
        F.col("o_orderpriority") != "5-LOW", F.map_concat(always, relief)
    )  # the rest has no map
    return table(spark, folder, "orders").select("o_orderkey", results.alias("results"))


def results_to_columns_query(spark: SparkSession, folder: str) -> DataFrame:
    return results_to_columns(_result_maps(spark, folder), "results", ["levy", "relief", "total"])


def missing_results(spark: SparkSession, folder: str) -> DataFrame:
    return checks.missing_results(_result_maps(spark, folder), "results", "o_orderkey", ["levy", "relief", "total"])


def result_names_query(spark: SparkSession, folder: str) -> DataFrame:
    return result_names(_result_maps(spark, folder), "results")


def indexed_results(spark: SparkSession, folder: str) -> DataFrame:
    results = apply_policy(customers(spark, folder), policies.account_policy(0.1, False))
    return with_index(results.select("custkey", "due"), ["custkey"])


def indexed_input(spark: SparkSession, folder: str) -> DataFrame:
    """Positions in the order of the files."""
    cells = read_delimited(spark, _ordered_customers_as_text(spark, folder), CUSTOMER_SCHEMA, positions=True)
    return with_index(cells, block=POSITIONS).select("Index", "custkey")


def output_layout_query(spark: SparkSession, folder: str) -> DataFrame:
    attributes = CUSTOMER_COLUMNS
    variant = policies.account_policy(0.25, True)
    wide = difference_results(customers(spark, folder), policies.account_policy(0.1, False), variant)
    return output_layout(wide, attributes, variant.outputs, "csv")


QUERIES: dict[str, Query] = {
    "apply_policy": apply_policy_query,
    "apply_policy_python": apply_policy_python,
    "apply_policy_vector": apply_policy_vector,
    "apply_policy_mixed": apply_policy_mixed,
    "apply_policy_compiled": apply_policy_compiled,
    "apply_brackets_compiled": apply_brackets_compiled,
    "policy_by_supplier": policy_by_supplier,
    "rule_faults_compiled": rule_faults_compiled,
    "rule_faults_python": rule_faults_python,
    "extra_outputs": extra_outputs,
    "scenario_baseline": scenario_baseline,
    "scenario_variant": scenario_variant,
    "scenario_diff": scenario_diff,
    "scenario_diff_python": scenario_diff_python,
    "scenario_diff_compiled": scenario_diff_compiled,
    "scenario_diff_keyed": scenario_diff_keyed,
    "scenario_diff_keyed_strict": scenario_diff_keyed_strict,
    "checked_table": checked_table,
    "scenario_run": scenario_run,
    "read_delimited": read_delimited_query,
    "read_delimited_typed": read_delimited_typed,
    "read_quoted_breaks": read_quoted_breaks,
    "write_delimited": write_delimited_query,
    "ragged_rows": ragged_rows_query,
    "read_arrow_ipc": read_arrow_ipc,
    "write_arrow_ipc": write_arrow_ipc_query,
    "cell_kinds": cell_kinds,
    "column_types": column_types,
    "first_type_mismatch": first_type_mismatch,
    "null_cells": null_cells,
    "attribute_gaps": attribute_gaps,
    "attribute_gaps_words": attribute_gaps_words,
    "type_fault": type_fault,
    "duplicate_header": duplicate_header,
    "policy_tables": policy_table,
    "policy_errors": policy_errors,
    "policy_components": policy_components,
    "policy_parameter_values": policy_parameter_values,
    "policy_parameter_labels": policy_parameter_labels,
    "parameter_pairs": parameter_pairs,
    "component_order": component_order,
    "parameter_merge": parameter_merge,
    "dependency_set": dependency_set,
    "missing_dependencies": missing_dependencies,
    "function_resolution": function_resolution,
    "results_to_columns": results_to_columns_query,
    "missing_results": missing_results,
    "result_names": result_names_query,
    "indexed_results": indexed_results,
    "indexed_input": indexed_input,
    "output_layout": output_layout_query,
}
