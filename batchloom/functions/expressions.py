"""Column expressions of the batch model. All are built-in, code-generated functions."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom import fixed_values as fixed


def case_of(value: Column, cases: Mapping[Any, Any], default: Any) -> Column:
    """Simple CASE with ELSE. A NULL value matches no case and takes ``default``."""
    chosen = None
    for key, result in cases.items():
        branch = F.when if chosen is None else chosen.when
        chosen = branch(value == F.lit(key), F.lit(result))
    return F.lit(default) if chosen is None else chosen.otherwise(F.lit(default))


def category_of(id_: Column) -> Column:
    """Category of a generated row; the last category is also the ELSE."""
    *named, rest = fixed.CATEGORIES
    residue = F.pmod(id_, F.lit(len(fixed.CATEGORIES)))
    return case_of(residue, dict(enumerate(named)), rest)


def quantity_of(id_: Column) -> Column:
    return (F.pmod(id_, F.lit(fixed.QUANTITY_CYCLE)) + 1).cast("int")


def unit_price_of(id_: Column) -> Column:
    """Price as DOUBLE: the base plus a residue in steps of one divisor-th.

    The residue is taken before the multiplication as well, so ids near the BIGINT limit
    do not overflow. Both terms of the quotient are whole numbers, so the one division is
    correctly rounded and equals the exact decimal price cast to DOUBLE, without decimal
    arithmetic per row.
    """
    cycle = F.lit(fixed.PRICE_CYCLE)
    steps = F.pmod(F.pmod(id_, cycle) * fixed.PRICE_STEP, cycle)
    base = int(fixed.PRICE_BASE * fixed.PRICE_DIVISOR)
    return (steps + base).cast("double") / float(fixed.PRICE_DIVISOR)


def decimal_quotient(value: Column, divisor: Decimal) -> Column:
    """Divide by a decimal literal, exactly, and store as DOUBLE."""
    return (value / F.lit(divisor)).cast("double")


def line_total_of(quantity: Column, unit_price: Column) -> Column:
    return quantity.cast("double") * unit_price


def quantity_band_of(quantity: Column) -> Column:
    """``bulk`` from the limit upwards; a smaller or NULL quantity is ``standard``."""
    return F.when(quantity >= fixed.BULK_FROM, fixed.BULK).otherwise(fixed.STANDARD)


def money(value: Column) -> Column:
    """An amount as an exact two-place decimal."""
    return value.cast("decimal(18,2)")


def round_money(value: Column) -> Column:
    """Round to two places, half up; the type of ``value`` is kept."""
    return F.round(value, 2)


# Cents up to here are whole numbers that a DOUBLE holds with room to round.
_MOST_CENTS = float(1 << 50)
# Sums of 18-bit parts of the cents stay within BIGINT for 2^45 rows.
_PART_BITS = 18


def _is_amount(value: Column) -> Column:
    """Whether whole cents hold the value: not so for NaN, infinities and beyond 2^50 cents."""
    return F.abs(value * 100) < _MOST_CENTS


def _cents(value: Column) -> Column:
    return F.when(_is_amount(value), F.rint(value * 100).cast("long"))


def _sum_of_cents(value: Column) -> Column:
    """Whole cents as a decimal: three sums of BIGINT parts, so rows are added without error."""
    cents, mask = _cents(value), F.lit((1 << _PART_BITS) - 1)
    parts = [
        cents.bitwiseAND(mask),
        F.shiftright(cents, _PART_BITS).bitwiseAND(mask),
        F.shiftright(cents, 2 * _PART_BITS),
    ]
    sums = [F.coalesce(F.sum(part), F.lit(0)).cast("decimal(20,0)") for part in parts]
    scales = [F.lit(Decimal(1 << (_PART_BITS * i))) for i in range(len(parts))]
    return sums[0] * scales[0] + sums[1] * scales[1] + sums[2] * scales[2]


def _sum_beyond_cents(value: Column) -> Column:
    """Sum of the values that are no amounts, as DOUBLE; 0 where there are none."""
    return F.coalesce(F.sum(F.when(~_is_amount(value), value)), F.lit(0.0))


def accurate_sum(value: Column) -> Column:
    """Sum of a DOUBLE column whose error does not grow with the number of rows.

    A plain DOUBLE sum of a few million prices is already off by whole cents, and by
    different ones in each run. Here cents are summed as whole numbers; only what lies
    below a cent, which is next to nothing for amounts of money, is summed as DOUBLE.
    Values beyond 2^50 cents, infinities and NaN go into that sum whole.
    """
    below = F.sum(value - F.coalesce(_cents(value), F.lit(0)) / 100)
    return (_sum_of_cents(value) / 100).cast("double") + below


def accurate_average(value: Column) -> Column:
    return accurate_sum(value) / F.count(value)


def exact_sum(value: Column) -> Column:
    """Sum of two-place amounts, each taken as whole cents.

    Values that are no amounts are added as DOUBLE, so nothing that is counted is left out.
    """
    total = (_sum_of_cents(value) / 100).cast("double") + _sum_beyond_cents(value)
    return F.when(F.count(value) > 0, total)


def exact_average(value: Column) -> Column:
    """Average of two-place amounts, rounded half up on the exact quotient.

    With values that are no amounts it is the quotient of the DOUBLE sum.
    """
    total, rows = _sum_of_cents(value), F.count(value)
    whole = F.count_if(~_is_amount(value)) == 0
    rounded = F.call_function("div", F.abs(total) * 2 + rows, rows * 2)
    return F.when((rows > 0) & whole, F.signum(total) * rounded / 100).when(
        rows > 0, exact_sum(value) / rows
    )
