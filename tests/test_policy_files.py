from __future__ import annotations

import random

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from levyframe import (
    components,
    dependency_set,
    function_resolution,
    load_policy,
    merged_parameters,
    missing_dependencies,
    ordered_components,
    parameter_labels,
    parameter_values,
    parse_policies,
    policies,
    policy_errors,
    read_policies,
)
from levyframe.errors import PolicyError
from levyframe.operators.policy_tables import defined_functions
from levyframe.plans.queries import policy_documents
from levyframe.sources.policy_files import _as_json, parse_policies, policy_from_text

NOTIF = """
[[composante]]
name = "plan_notif"
intitule_long = "Notified plan"
logical_order = 1
caracteristiques_dependencies = ["Age", "GIR"]
function = '''
def plan_notif(variables, parameters, attributes):
    if attributes["Age"] > 60 and attributes["GIR"] == 1:
        return parameters["tau_1"] * attributes["x"] + attributes["y"]
    return parameters["tau_2"] * attributes["z"]
'''
[composante.parameters]
names = ["tau_1", "tau_2"]
intitules_long = ["First rate", "Second rate"]
values = [0.15, 0.3]
"""
CONS = """
[[composante]]
name = "plan_cons"
intitule_long = "Consumed plan"
logical_order = 2
caracteristiques_dependencies = []
function = '''
def plan_cons(variables, parameters, attributes):
    return variables["plan_notif"] * parameters["taux_ss_conso"]
'''
parameters = { names = ["taux_ss_conso"], intitules_long = ["Share"], values = [0.8] }
"""
HEAD = 'name = "apa"\nintitule_long = "Allowance"\n'
VALID = HEAD + NOTIF + CONS


def read_texts(spark, *texts):
    kind = "binary" if any(isinstance(t, bytes) for t in texts) else "string"
    table = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], f"s string, t {kind}")
    found = sorted(parse_policies(table, "s", "t").collect(), key=lambda r: int(r["source"]))
    return [r.asDict(recursive=True) for r in found]


def test_valid_document(spark):
    (row,) = read_texts(spark, VALID)
    assert row["error"] is None and row["policy"] == "apa"
    assert [part["name"] for part in row["components"]] == ["plan_notif", "plan_cons"]
    assert row["components"][0]["parameter_values"] == [0.15, 0.3]


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ('intitule_long = "x"\n' + NOTIF, "missing keys: name"),
        (HEAD + NOTIF.replace("[composante", "[komposante"), "missing keys: composante"),
        (HEAD + NOTIF + CONS.replace("[[composante]]", "[[komposante]]"), "unknown keys: komposante"),
        (HEAD + "composante = []", "no component"),
        (HEAD + 'composante = "x"', "composante is not a list of tables"),
        (HEAD + "composante = [1]", "component 1 is not a table"),
        ("name = 3\n" + VALID.split("\n", 1)[1], "name is not text"),
        (VALID.replace("logical_order = 2", "logical_order = 2.5"), "component 2: logical_order is not a 32-bit integer"),
        (VALID.replace("logical_order = 2", "logical_order = 3000000000"), "32-bit integer"),
        (VALID.replace("logical_order = 2\n", ""), "component 2: logical_order is missing"),
        (VALID.replace("[0.15, 0.3]", '[0.15, "0.3"]'), "component 1: values is not a list of numbers"),
        (VALID.replace("[0.15, 0.3]", "[0.15, true]"), "values is not a list of numbers"),
        (VALID.replace('["Age", "GIR"]', '["Age", 1]'), "caracteristiques_dependencies is not a list of texts"),
        ("name = ", "Invalid value"),
        (b"\xff\xfe", "utf-8"),
        (None, "no text"),
    ],
)
def test_faulty_documents(spark, text, reason):
    (row,) = read_texts(spark, text)
    assert reason in row["error"] and row["components"] is None and row["policy"] is None


def test_integers_are_numbers_and_further_keys_are_ignored(spark):
    text = VALID.replace("values = [0.8]", "values = [1]").replace("logical_order = 2", 'logical_order = 2\nnote = "x"')
    assert read_texts(spark, text)[0]["components"][1]["parameter_values"] == [1.0]


def test_scalars_keep_their_kind_and_value(spark):
    values = "[3, 3.0, 1_000, 0x1F, 1e21, -0.0, inf, nan, 123456789012345678901234567890]"
    texts = '["i3", "f", "", "s", "é\\n\\u0001", "null"]'
    text = VALID.replace("[0.15, 0.3]", values).replace('["tau_1", "tau_2"]', texts)
    (row,) = read_texts(spark, text)
    part = row["components"][0]
    assert part["parameter_names"] == ["i3", "f", "", "s", "é\n\x01", "null"]
    found = part["parameter_values"]
    assert found[:7] == [3.0, 3.0, 1000.0, 31.0, 1e21, 0.0, float("inf")] and found[7] != found[7]
    assert found[8] == float(123456789012345678901234567890)
    odd = VALID.replace("logical_order = 2", "logical_order = 2024-01-01")
    assert "component 2: logical_order is not a 32-bit integer" in read_texts(spark, odd)[0]["error"]
    low = VALID.replace("logical_order = 2", "logical_order = -2147483648")
    assert read_texts(spark, low)[0]["components"][1]["logical_order"] == -(2**31)


def test_the_first_fault_is_told(spark):
    both = VALID.replace("[0.15, 0.3]", "[true]").replace("logical_order = 2", "logical_order = 2.5")
    texts = [both, both.replace("Allowance", "x").replace('intitule_long = "x"', "intitule_long = 1"), HEAD + "composante = [{}]", ""]
    assert [r["error"] for r in read_texts(spark, *texts)] == [
        "component 1: values is not a list of numbers", "document: intitule_long is not text", "component 1: parameters is missing",
        "missing keys: name, intitule_long, composante",
    ]
    nested = VALID.replace("parameters = { names", 'parameters = "x" # { names')
    assert read_texts(spark, nested)[0]["error"] == "component 2: parameters is not a table"


def test_documents_of_many_digits_or_deep_lists_are_faulty(spark):
    assert "digits" in read_texts(spark, "a = " + "9" * 5000)[0]["error"]
    assert _as_json("a = " + "[" * 100_000)[1]


def test_python_only_turns_text_to_json(spark):
    df = parse_policies(spark.createDataFrame([("s", VALID)], "s string, t string"), "s", "t")
    assert plan(df).count("MapInArrow") == 1 and "Exchange" not in plan(df)
    assert policy_from_text(spark, VALID).outputs == ["plan_notif", "plan_cons"]


def test_folder_of_files(spark, write, tmp_path):
    write("p/good.toml", VALID)
    write("p/bad.toml", HEAD)
    write("p/notes.txt", "no policy")
    documents = read_policies(spark, str(tmp_path / "p"))
    assert [r["policy"] for r in policies(documents).collect()] == ["apa"]
    errors = policy_errors(documents).collect()
    assert len(errors) == 1 and errors[0]["source"].endswith("bad.toml")
    with pytest.raises(PolicyError, match="not a .toml"):
        read_policies(spark, str(tmp_path / "p" / "notes.txt"))


def test_load_policy(spark, write):
    policy = load_policy(spark, write("apa.toml", VALID))
    assert policy.name == "apa" and policy.label == "Allowance"
    assert [c.name for c in policy.ordered] == ["plan_notif", "plan_cons"]
    assert policy.parameters == {"tau_1": 0.15, "tau_2": 0.3, "taux_ss_conso": 0.8}
    assert policy.parameter_labels["taux_ss_conso"] == "Share"
    assert policy.dependencies == {"Age", "GIR"}
    with pytest.raises(PolicyError, match="missing keys"):
        load_policy(spark, write("bad.toml", HEAD))
    with pytest.raises(PolicyError, match="not a .toml"):
        load_policy(spark, write("apa.txt", VALID))
    with pytest.raises(Exception):
        load_policy(spark, "/nowhere/none.toml")


def document(order_a, order_b, order_c):
    def part(name, order, parameters):
        return (
            f'[[composante]]\nname = "{name}"\nintitule_long = ""\nlogical_order = {order}\n'
            f'caracteristiques_dependencies = ["{name}1", "shared"]\nfunction = "def {name}(v, p, a): return 1"\n'
            f"parameters = {parameters}\n"
        )

    return (
        'name = "p"\nintitule_long = ""\n'
        + part("a", order_a, '{ names = ["k", "k", "only_label"], intitules_long = ["A1", "A2", "A3"], values = [1, 2] }')
        + part("b", order_b, '{ names = ["k", "m"], intitules_long = [], values = [3, 4, 5] }')
        + part("c", order_c, "{ names = [], intitules_long = [], values = [] }")
    )


def parsed(spark, *orders):
    data = [(str(orders), document(*orders))]
    return parse_policies(spark.createDataFrame(data, "id string, text string"), "id", "text")


def test_component_rank_keeps_file_order_among_ties(spark):
    df = components(parsed(spark, 2, 1, 2))
    assert [(r["component"], r["rank"], r["position"]) for r in df.orderBy("rank").collect()] == [
        ("b", 1, 2), ("a", 2, 1), ("c", 3, 3),
    ]
    assert "Exchange" not in plan(df)


def test_pairs_stop_at_the_shorter_list(spark):
    df = components(parsed(spark, 1, 2, 3))
    assert rows(parameter_values(df, ["component"])) == [
        ("a", 1, "k", 1.0), ("a", 2, "k", 2.0), ("b", 1, "k", 3.0), ("b", 2, "m", 4.0),
    ]
    assert rows(parameter_labels(df, ["component"])) == [
        ("a", 1, "k", "A1"), ("a", 2, "k", "A2"), ("a", 3, "only_label", "A3"),
    ]


@pytest.mark.parametrize(("orders", "k"), [((1, 2, 3), 3.0), ((2, 1, 3), 2.0), ((1, 1, 1), 3.0)])
def test_last_parameter_wins(spark, write, orders, k):
    df = components(parsed(spark, *orders))
    pairs = parameter_values(df, ["source", "rank"])
    merged = merged_parameters(pairs, ["source"], "name", "value", ["rank", "parameter_position"])
    found = {r["name"]: r["value"] for r in merged.collect()}
    assert found == {"k": k, "m": 4.0}
    assert load_policy(spark, write("p.toml", document(*orders))).parameters == found


def test_merge_combines_before_the_shuffle(spark):
    """A hot policy is reduced to one row per name in each task."""
    pairs = spark.range(1000).selectExpr("'hot' AS policy", "concat('n', id % 3) AS name", "id * 1.0D AS value", "id AS at")
    merged = merged_parameters(pairs, ["policy"], "name", "value", ["at"])
    assert rows(merged) == [("hot", "n0", 999.0), ("hot", "n1", 997.0), ("hot", "n2", 998.0)]
    text = plan(merged)
    assert text.index("partial_max_by") > text.index("Exchange hashpartitioning")


def test_dependencies(spark):
    df = components(parsed(spark, 1, 2, 3))
    assert rows(dependency_set(df, ["policy"])) == [("p", n) for n in ("a1", "b1", "c1", "shared")]
    assert rows(missing_dependencies(df, ["policy"], ["a1", "shared"])) == [("p", "b1"), ("p", "c1")]
    assert rows(missing_dependencies(df, ["policy"], [])) == [("p", n) for n in ("a1", "b1", "c1", "shared")]


def test_names_that_a_module_binds(spark):
    text = """from math import sqrt, floor as low  # two
import os.path as place
@cached
def decorated(v, p, a):
    inner = 1
    return inner == 2
async def later(v, p, a): pass
given = partial(decorated, 1)
typed: Callable[..., float] = decorated
été = lambda v, p, a: 1
class Rule: pass
same == given
"""
    module = ["low", "place", "decorated", "later", "given", "typed", "été", "Rule"]
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(defined_functions(F.col("t"))).first()[0] == module


def test_function_resolution(spark):
    data = [
        ("p", "a", 1, "def a(v, p, x):\n    return 1\ndef b(v, p, x):\n    return 1"),
        ("p", "b", 2, "def b(v, p, x):\n    def a(): pass\n    return 2"),
        ("p", "c", 3, "other = 3\nasync def d(): pass"),
        ("p", "d", 4, "a = lambda v, p, x: 4"),
        ("q", "a", 1, "  def a(): indented"),
    ]
    df = spark.createDataFrame(data, "policy string, component string, rank int, function string")
    found = {(r["policy"], r["component"]): r["defined_by_rank"] for r in function_resolution(df, ["policy"]).collect()}
    assert found == {("p", "a"): 4, ("p", "b"): 2, ("p", "c"): None, ("p", "d"): 3, ("q", "a"): None}


def test_ordered_components_with_a_hot_policy(spark):
    """One policy holds most rows and is cut over several tasks; ranks agree with brute force."""
    random.seed(11)
    data = [("hot" if i % 4 else random.choice(["x", "y", None]), random.randint(0, 5), i) for i in range(3000)]
    random.shuffle(data)
    df = spark.createDataFrame(data, "policy string, logical_order int, position int").repartition(5)
    ranked = ordered_components(df, ["policy"], "logical_order", "position")
    expected = []
    for name in ("hot", "x", "y", None):
        members = sorted(row[1:] for row in data if row[0] == name)
        expected += [(name, *member, rank) for rank, member in enumerate(members, start=1)]
    assert rows(ranked) == sorted(expected, key=repr)


def test_documents_of_one_file_are_parsed_by_several_tasks(spark, tmp_path):
    """A file of few bytes is read by one task, which parsed all its documents."""
    customers = spark.range(12_000).selectExpr(
        "nullif(id, 5) % 9000 AS c_custkey", "concat('c', id) AS c_name", "cast(id % 7 AS int) AS c_nationkey",
        "id / 8.0 AS c_acctbal", "'BUILDING' AS c_mktsegment",
    )
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    documents = policy_documents(spark, str(tmp_path))
    sizes = [row["count"] for row in documents.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 12_000 and len(sizes) == 3 and max(sizes) < 4_500


def test_tables_of_a_document_are_unpacked_once(spark):
    """Each use of a component's key unpacked the component again, and its parameters within it."""
    documents = parse_policies(spark.createDataFrame([("a", VALID)], "source string, text string"), "source", "text")
    assert plan(documents).count("MapType(StringType,VariantType,true)") <= 6
    (row,) = documents.collect()
    assert row["error"] is None and [part["name"] for part in row["components"]] == ["plan_notif", "plan_cons"]
