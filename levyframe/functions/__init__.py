"""Column expressions: name handling and strict typing of text cells."""

from levyframe.functions.cells import KIND_NAMES, cell_kind, checked_cast
from levyframe.functions.names import case_clashes, column, quoted

__all__ = ["KIND_NAMES", "case_clashes", "cell_kind", "checked_cast", "column", "quoted"]
