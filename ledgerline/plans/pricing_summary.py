"""Totals and means of line items by return flag and line status."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import day, exact_mean, exact_sum, hundredths


#: Largest discount and tax; with prices up to 10**10 every charge is below 2**63.
MOST_SHARE = 10


def pricing_summary(lineitem: DataFrame, shipped_by: date, places: int = 6) -> DataFrame:
    """Line items shipped up to the end of the day ``shipped_by``.

    After query 1 of the public TPC-H benchmark. Totals are exact; means
    are computed from them and rounded to ``places``. Amounts that are not
    of two places raise an error (see ``hundredths``).

    One shuffle, of partial sums: a row per group and map task, whatever
    share of the lines one group holds.
    """
    return (
        lineitem.where(F.col("l_shipdate") < day(shipped_by + timedelta(days=1)))
        .select(
            "l_returnflag",
            "l_linestatus",
            hundredths("l_quantity").alias("quantity"),
            hundredths("l_extendedprice").alias("price"),
            hundredths("l_discount", MOST_SHARE).alias("discount"),
            hundredths("l_tax", MOST_SHARE).alias("tax"),
        )
        .withColumn("net", F.expr("price * (100 - discount)"))
        .withColumn("charge", F.expr("net * (100 + tax)"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            exact_sum("quantity", 2).alias("sum_qty"),
            exact_sum("price", 2).alias("sum_base_price"),
            exact_sum("net", 4).alias("sum_disc_price"),
            exact_sum("charge", 6).alias("sum_charge"),
            exact_mean("quantity", 2, places).alias("avg_qty"),
            exact_mean("price", 2, places).alias("avg_price"),
            exact_mean("discount", 2, places).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
    )
