"""The exceptions the package raises."""


class LevyError(ValueError):
    """Base of all errors raised by this package."""


class TableError(LevyError):
    """An attribute table is malformed: format, types, nulls or names."""


class PolicyError(LevyError):
    """A policy is malformed or does not fit the table it is applied to."""


class RuleError(LevyError):
    """A component failed; the message names it."""


class ResultError(LevyError):
    """Results are incomplete or do not pair up."""
