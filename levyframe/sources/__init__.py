"""Readers and writers: delimited text, Arrow files, policy documents."""

from levyframe.sources.arrow_ipc import ArrowIpcDataSource, register
from levyframe.sources.delimited import (
    POSITIONS,
    locate_type_fault,
    ragged_rows,
    read_delimited,
    read_text_cells,
    write_delimited,
)
from levyframe.sources.households import read_households, result_path, write_arrow_ipc, write_result
from levyframe.sources.policy_files import load_policy, parse_policies, policy_from_text, read_policies, to_policy

__all__ = [
    "POSITIONS",
    "ArrowIpcDataSource",
    "load_policy",
    "locate_type_fault",
    "parse_policies",
    "policy_from_text",
    "ragged_rows",
    "read_delimited",
    "read_households",
    "read_policies",
    "read_text_cells",
    "register",
    "result_path",
    "to_policy",
    "write_arrow_ipc",
    "write_delimited",
    "write_result",
]
