"""Revenue from customers and suppliers of the same nation, in one region."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import day, exact_sum, hundredths
from ledgerline.operators import keep_nations, nations_in
from ledgerline.plans.pricing_summary import MOST_SHARE


def regional_revenue(
    region: DataFrame,
    nation: DataFrame,
    customer: DataFrame,
    supplier: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    region_name: str,
    first_day: date,
    end_day: date,
    sellers_first: bool = True,
) -> DataFrame:
    """Net revenue per nation for orders in ``[first_day, end_day)``.

    After query 5 of the public TPC-H benchmark. The rows do not depend on
    ``sellers_first``, which orders the joins:

    - True: line items meet the region's suppliers first and go on by order
      with the seller's nation. While those suppliers fit a broadcast only
      the region's line items are shuffled; beyond that all are, by
      supplier, and the region's again by order.
    - False: line items are shuffled once, by order, all of them. What is
      left is summed by supplier and customer nation before it meets the
      suppliers; that shuffle carries partial sums and also serves the join.

    A hot customer, order or supplier is split by AQE's skew join where the
    join has a shuffle of its own on both sides, as all but the last of
    ``sellers_first=False`` have; there a supplier takes one row per map
    task.
    """
    nations = nations_in(nation, region, region_name)
    buyers = keep_nations(customer, "c_nationkey", nations)
    sellers = keep_nations(supplier, "s_nationkey", nations)

    sales = (
        orders.where(
            (F.col("o_orderdate") >= day(first_day)) & (F.col("o_orderdate") < day(end_day))
        )
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_nationkey")
    )
    lines = lineitem.select(
        "l_orderkey",
        "l_suppkey",
        (hundredths("l_extendedprice") * (100 - hundredths("l_discount", MOST_SHARE))).alias("net"),
    )
    if sellers_first:
        sold = lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).select(
            "l_orderkey", "s_nationkey", "net"
        )
        at_home = (F.col("l_orderkey") == F.col("o_orderkey")) & (
            F.col("s_nationkey") == F.col("c_nationkey")
        )
        return (
            sold.join(sales, at_home)
            .groupBy("s_nationkey")
            .agg(exact_sum("net", 4).alias("net"))
            .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name")
            .agg(F.sum("net").cast("decimal(38,4)").alias("revenue"))
        )
    by_supplier = (
        lines.join(sales, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_suppkey", "c_nationkey")
        .agg(exact_sum("net", 4).alias("net"))
    )
    same_nation = (F.col("l_suppkey") == F.col("s_suppkey")) & (
        F.col("c_nationkey") == F.col("s_nationkey")
    )
    return (
        by_supplier.join(sellers, same_nation)
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.sum("net").cast("decimal(38,4)").alias("revenue"))
    )
