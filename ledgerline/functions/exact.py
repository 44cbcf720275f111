"""Exact sums over two-place amounts stored as doubles.

A sum of doubles depends on the order of the rows, so it changes with the
partitioning. Casting each double to a decimal is exact, but goes through
a string per value. Here amounts become whole hundredths in a ``bigint``,
stay in primitive arithmetic for every row, and turn into a decimal once
per group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW_BITS = 20


def hundredths(amount: str, most: int = 10**10) -> Column:
    """The two-place column ``amount`` as a whole number of hundredths.

    Raises, in ANSI mode and without it, on NaN, infinity, amounts beyond
    ``most`` either way, and amounts that are further from two places than
    a double's rounding explains. ``most`` is 10**10 at the highest: there
    that rounding is a fifth of the 0.001 hundredths allowed for it.
    """
    if not 0 < most <= 10**10:
        raise ValueError(f"most is {most}, want 1 to 10**10")
    return F.expr(
        f"CASE WHEN `{amount}` IS NULL THEN CAST(NULL AS bigint)"
        f" WHEN abs(`{amount}`) <= {most}D"
        f" AND abs(`{amount}` * 100 - rint(`{amount}` * 100)) <= 0.001D"
        f" THEN cast(rint(`{amount}` * 100) AS bigint)"
        f" ELSE cast(raise_error(concat('no amount of two places up to {most}: {amount} = ',"
        f" `{amount}`)) AS bigint) END"
    )


def exact_sum(units: str, scale: int = 0) -> Column:
    """Sum of the bigint column ``units`` as ``decimal(38, scale)``.

    ``units`` counts steps of 10**-scale. A bigint sum of price times
    discount times tax overflows at about 1e8 rows, so the upper and the
    lowest 20 bits are summed apart: with values up to 1e12 both sums hold
    for more than 8e12 rows in one group. Past that the sum raises, in ANSI
    mode and without it.
    """
    return F.expr(_sum_text(units, scale))


def exact_mean(units: str, scale: int, places: int = 6) -> Column:
    """Mean of the non-null values, from the exact sum, as a rounded double."""
    total = _sum_text(units, scale)
    return F.expr(f"round(cast({total} AS double) / count(`{units}`), {places})")


def _sum_text(units: str, scale: int) -> str:
    # As one expression text: built call by call, a report's columns take
    # longer to put together than a small table takes to read.
    size = 1 << _LOW_BITS

    def whole(part: str) -> str:
        over = f"cast(raise_error('the sum of {units} is beyond its range') AS bigint)"
        held = f"CASE WHEN try_sum({part}) IS NULL AND count({part}) > 0 THEN {over} ELSE try_sum({part}) END"
        return f"cast({held} AS decimal(20, 0))"

    upper = whole(f"shiftright(`{units}`, {_LOW_BITS})")
    lower = whole(f"`{units}` & {size - 1}")
    step = "1" if scale == 0 else "0." + "0" * (scale - 1) + "1"
    return f"cast(({upper} * {size} + {lower}) * {step} AS decimal(38, {scale}))"
