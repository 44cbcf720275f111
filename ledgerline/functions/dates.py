"""Date literals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(value: date) -> Column:
    """Midnight of a day, without a time zone.

    ``F.lit(datetime)`` would be a zoned timestamp: compared with a
    ``timestamp_ntz`` column it casts the column, which keeps the filter
    away from the scan and makes it depend on the session's time zone.
    """
    return F.lit(value.isoformat()).cast("timestamp_ntz")
