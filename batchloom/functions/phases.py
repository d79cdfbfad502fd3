"""Column expressions on run phases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom import fixed_values as fixed


def phase_or_pending(phase: Column) -> Column:
    """A missing or empty phase counts as ``Pending``."""
    return F.coalesce(F.nullif(phase, F.lit("")), F.lit(fixed.PENDING))


def is_terminal(phase: Column) -> Column:
    return phase_or_pending(phase).isin(*fixed.TERMINAL_PHASES)


def is_success(phase: Column) -> Column:
    return phase_or_pending(phase) == fixed.SUCCEEDED
