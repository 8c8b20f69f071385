"""Operators on DataFrames: checks, policy tables, rule evaluation, comparison, positions, layout."""

from levyframe.operators.by_key import apply_policy_by_key
from levyframe.operators.checks import (
    apply_types,
    attribute_gaps,
    check_result_columns,
    check_table,
    column_types,
    first_type_mismatch,
    missing_results,
    null_cells,
    resolve_types,
    unsupported_columns,
)
from levyframe.operators.compare import (
    BASELINE,
    DIFF,
    VARIANT,
    compare_policies,
    diff_results,
    difference_results,
    results_of,
)
from levyframe.operators.compile_rules import compile_policy
from levyframe.operators.evaluate import apply_policy, check_dependencies, missing_attributes
from levyframe.operators.layout import output_columns, output_layout, results_to_columns
from levyframe.operators.ordering import with_index, with_rank
from levyframe.operators.policy_tables import (
    components,
    dependency_set,
    function_resolution,
    merged_parameters,
    missing_dependencies,
    ordered_components,
    parameter_labels,
    parameter_values,
    policies,
    policy_errors,
)
from levyframe.operators.rules import Component, Policy

__all__ = [
    "BASELINE",
    "DIFF",
    "VARIANT",
    "Component",
    "Policy",
    "apply_policy",
    "apply_policy_by_key",
    "apply_types",
    "attribute_gaps",
    "check_dependencies",
    "check_result_columns",
    "check_table",
    "column_types",
    "compare_policies",
    "compile_policy",
    "components",
    "dependency_set",
    "diff_results",
    "difference_results",
    "first_type_mismatch",
    "function_resolution",
    "merged_parameters",
    "missing_attributes",
    "missing_dependencies",
    "missing_results",
    "null_cells",
    "ordered_components",
    "output_columns",
    "output_layout",
    "parameter_labels",
    "parameter_values",
    "policies",
    "policy_errors",
    "resolve_types",
    "results_of",
    "results_to_columns",
    "unsupported_columns",
    "with_index",
    "with_rank",
]
