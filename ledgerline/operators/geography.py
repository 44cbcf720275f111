"""Restricting tables to the nations of a region.

No broadcast hints: Catalyst compares each side's size with
``spark.sql.autoBroadcastJoinThreshold`` and sorts and merges above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nations_in(nation: DataFrame, region: DataFrame, region_name: str) -> DataFrame:
    """Key and name of the nations of one region."""
    chosen = region.where(F.col("r_name") == region_name)
    return nation.join(
        chosen, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi"
    ).select("n_nationkey", "n_name")


def keep_nations(df: DataFrame, key: str, nations: DataFrame) -> DataFrame:
    """Rows of ``df`` whose nation key is among ``nations``."""
    return df.join(nations, F.col(key) == F.col("n_nationkey"), "left_semi")
