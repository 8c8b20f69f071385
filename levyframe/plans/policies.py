"""The policies of the registered queries, as column rules, as Python rules, and as policy files."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from levyframe.operators.rules import COLUMN, PYTHON, VECTOR, Component, Policy


def _net(variables: Mapping[str, Any], parameters: Mapping[str, float], row: Mapping[str, Any]) -> Any:
    return row["l_extendedprice"] * (1 - row["l_discount"])


def _levy(variables: Mapping[str, Any], parameters: Mapping[str, float], row: Mapping[str, Any]) -> Any:
    return variables["net"] * parameters["tau"]


def _total(variables: Mapping[str, Any], parameters: Mapping[str, float], row: Mapping[str, Any]) -> Any:
    return variables["net"] + variables["levy"]


def _relieved_total(variables: Mapping[str, Any], parameters: Mapping[str, float], row: Mapping[str, Any]) -> Any:
    return variables["net"] + variables["levy"] - variables["relief"]


def _relief_column(variables: Mapping[str, Column], parameters: Mapping[str, float], row: Mapping[str, Column]) -> Column:
    return F.when(row["l_returnflag"] == "R", variables["net"] * parameters["rho"]).otherwise(0.0)


def _relief_python(variables: Mapping[str, float], parameters: Mapping[str, float], row: Mapping[str, Any]) -> float:
    return variables["net"] * parameters["rho"] if row["l_returnflag"] == "R" else 0.0


def _relief_vector(variables: Mapping[str, Any], parameters: Mapping[str, float], row: Mapping[str, Any]) -> Any:
    return np.where(row["l_returnflag"] == "R", variables["net"] * parameters["rho"], 0.0)


RELIEFS = {COLUMN: _relief_column, PYTHON: _relief_python, VECTOR: _relief_vector}
PRICES = ("l_extendedprice", "l_discount")


def baseline(kind: str = COLUMN) -> Policy:
    return Policy(
        "flat",
        [
            Component("net", _net, dependencies=PRICES, logical_order=1, kind=kind),
            Component("levy", _levy, {"tau": 0.05}, logical_order=2, kind=kind),
            Component("total", _total, logical_order=3, kind=kind),
        ],
        "Flat levy",
    )


def variant(kind: str = COLUMN, relief_kind: str | None = None) -> Policy:
    relief_kind = relief_kind or kind
    relief = RELIEFS[relief_kind]
    return Policy(
        "relieved",
        [
            Component("total", _relieved_total, logical_order=4, kind=kind),
            Component("net", _net, dependencies=PRICES, logical_order=1, kind=kind),
            Component("levy", _levy, {"tau": 0.08}, logical_order=2, kind=kind),
            Component("relief", relief, {"rho": 0.02}, dependencies=("l_returnflag",), logical_order=3, kind=relief_kind),
        ],
        "Higher levy with relief for returned goods",
    )


def python_baseline() -> Policy:
    return baseline(PYTHON)


def python_variant() -> Policy:
    return variant(PYTHON)


def _due(variables: Mapping[str, Any], parameters: Mapping[str, float], row: Mapping[str, Any]) -> Any:
    return row["acctbal"] * parameters["rate"]


def _bonus(variables: Mapping[str, Column], parameters: Mapping[str, float], row: Mapping[str, Column]) -> Column:
    return F.when(row["mktsegment"] == "BUILDING", variables["due"] * parameters["share"]).otherwise(0.0)


def account_policy(rate: float, with_bonus: bool) -> Policy:
    """Rules on the customers table as written to files by the queries."""
    rules = [Component("due", _due, {"rate": rate}, 1, ("acctbal",))]
    if with_bonus:
        rules.append(Component("bonus", _bonus, {"share": 0.5}, 2, ("mktsegment",)))
    return Policy(f"rate {rate}", rules)


# The same two policies as files, and one whose rules hold more of Python.
BASELINE_FILE = """
name = "flat"
intitule_long = "Flat levy"

[[composante]]
name = "net"
intitule_long = "Net price"
parameters = { names = [], intitules_long = [], values = [] }
logical_order = 1
caracteristiques_dependencies = ["l_extendedprice", "l_discount"]
function = '''
def net(variables, parameters, row):
    return row["l_extendedprice"] * (1 - row["l_discount"])
'''

[[composante]]
name = "levy"
intitule_long = "Levy"
parameters = { names = ["tau"], intitules_long = ["Rate"], values = [0.05] }
logical_order = 2
caracteristiques_dependencies = []
function = '''
def levy(variables, parameters, row):
    return variables["net"] * parameters["tau"]
'''

[[composante]]
name = "total"
intitule_long = "Total"
parameters = { names = [], intitules_long = [], values = [] }
logical_order = 4
caracteristiques_dependencies = []
function = '''
def total(variables, parameters, row):
    return variables["net"] + variables["levy"]
'''
"""

VARIANT_FILE = (
    BASELINE_FILE.replace('"flat"', '"relieved"')
    .replace("[0.05]", "[0.08]")
    .replace('return variables["net"] + variables["levy"]', 'return variables["net"] + variables["levy"] - variables["relief"]')
    + """
[[composante]]
name = "relief"
intitule_long = "Relief"
parameters = { names = ["rho"], intitules_long = ["Share"], values = [0.02] }
logical_order = 3
caracteristiques_dependencies = ["l_returnflag"]
function = '''
def relief(variables, parameters, row):
    if row["l_returnflag"] == "R":
        output = variables["net"] * parameters["rho"]
    else:
        output = 0.0
    return output
'''
"""
)

BRACKETS_FILE = """
name = "brackets"
intitule_long = "Levy by brackets"

[[composante]]
name = "base"
intitule_long = "Base"
parameters = { names = ["allowance"], intitules_long = ["Allowance"], values = [20000] }
logical_order = 1
caracteristiques_dependencies = ["o_totalprice", "o_custkey"]
function = '''
SHARES = {"1-URGENT": 0.5, "2-HIGH": 0.75, "3-MEDIUM": 1}

def share(priority):
    return SHARES.get(priority, 1)

def base(variables, parameters, row):
    rest = max(row["o_totalprice"] - parameters["allowance"], 0)
    if row["o_orderstatus"] is None:
        return rest
    elif row["o_orderstatus"] in ("F", "O") and row["o_custkey"] % 3 != 0:
        rest *= share(row["o_orderpriority"])
    return rest
'''

[[composante]]
name = "levy"
intitule_long = "Levy"
parameters = { names = ["low", "high", "limit"], intitules_long = ["Low", "High", "Limit"], values = [0.1, 0.25, 100000] }
logical_order = 2
caracteristiques_dependencies = []
function = '''
def above(value, limit):
    return value - limit if value > limit else 0.0

def levy(variables, parameters, row):
    base = variables["base"]
    if not base:
        return 0
    first = min(base, parameters["limit"]) * parameters["low"]
    return first + above(base, parameters["limit"]) * parameters["high"]
'''

[[composante]]
name = "months"
intitule_long = "Months to pay"
parameters = { names = [], intitules_long = [], values = [] }
logical_order = 3
caracteristiques_dependencies = ["o_orderkey"]
function = '''
def months(variables, parameters, row):
    if variables["levy"] / 500 > 120:
        return 120 + row["o_orderkey"] // 7 % 5
    return int(variables["levy"] / 500)
'''
"""


FAULTS_FILE = """
name = "faults"
intitule_long = "Rules that some rows are errors of"

[[composante]]
name = "unit"
intitule_long = "Price of a unit beyond three"
parameters = { names = [], intitules_long = [], values = [] }
logical_order = 1
caracteristiques_dependencies = []
function = '''
def unit(variables, parameters, row):
    return row["l_extendedprice"] / (row["l_linenumber"] - 3)
'''

[[composante]]
name = "rate"
intitule_long = "Rate by flag"
parameters = { names = ["more"], intitules_long = ["More"], values = [0.25] }
logical_order = 2
caracteristiques_dependencies = []
function = '''
RATES = {"R": 0.5, "N": 1}

def rate(variables, parameters, row):
    return RATES[row["l_returnflag"]] + parameters["more"]
'''

[[composante]]
name = "due"
intitule_long = "Due"
parameters = { names = [], intitules_long = [], values = [] }
logical_order = 3
caracteristiques_dependencies = []
function = '''
def due(variables, parameters, row):
    return variables["unit"] * variables["rate"] * row["l_discount"]
'''
"""
