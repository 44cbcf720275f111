"""Positions and running totals within groups of any size.

Rows are dealt over tasks by ranges of group and order, so a group with any
share of the rows has many tasks. Within a task a row's place is known from
the order alone; what earlier tasks hold of its group is added from a table
with a row per task and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import BROADCAST_BYTES, cut

#: Bits of `at` that count rows within a task; the others number the task.
_ROW_BITS = 33


def _small(frame: DataFrame, group: str) -> DataFrame:
    """The frame, for a broadcast if it is small enough."""
    name = F.octet_length(F.col(group).cast("string"))
    size = frame.agg(F.sum(F.lit(96) + F.coalesce(name, F.lit(0)))).first()[0]
    return F.broadcast(frame) if (size or 0) < BROADCAST_BYTES else frame


def task_of(at: str = "at") -> Column:
    return F.shiftright(at, _ROW_BITS)


def placed(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """`keep` and `at`, which ascends with `by` and names the row in all that is derived from this stored frame.

    Tasks hold about as many rows each, those of equal `by` included.
    """
    by = [*by, "salt"]
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*by)
    return cut(dealt.sortWithinPartitions(*by).select(*keep, F.monotonically_increasing_id().alias("at")))


def numbered(rows: DataFrame, group: str, order: list[str], keep: list[str]) -> DataFrame:
    """`group` and `keep`, with `at`, `number` (from 0) and `total` within the group.

    `group` is a column without nulls; nulls come first in `order`. Rows
    equal in group and order are numbered in any order, and apart.
    """
    dealt = placed(rows, [group, *order], [group, *keep])
    task = task_of().alias("task")
    spans = cut(
        dealt.groupBy(group, task)
        .agg(F.min("at").alias("first"), F.count("*").alias("n"))
        .withColumnRenamed(group, "span_group")
    )
    of = Window.partitionBy("span_group")
    earlier = of.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut(
        spans.select(
            "span_group",
            F.col("task").alias("span_task"),
            (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("n").over(of).alias("total"),
        )
    )
    here = (F.col(group) == F.col("span_group")) & (task_of() == F.col("span_task"))
    joined = dealt.join(_small(spans, "span_group"), here)
    return joined.select(group, *keep, "at", (F.col("at") + F.col("shift")).alias("number"), "total")


def running(rows: DataFrame, group: str, values: dict[str, Column], keep: list[str]) -> DataFrame:
    """`group`, `keep` and `at` of numbered rows, with running totals of `values`, each row's own included."""
    task = task_of()
    rows = rows.select(group, *keep, "at", task.alias("task"), *(c.alias(name) for name, c in values.items()))
    spans = rows.groupBy(F.col(group).alias("span_group"), F.col("task").alias("span_task"))
    spans = cut(spans.agg(*(F.sum(name).alias(name) for name in values)))
    earlier = Window.partitionBy("span_group").orderBy("span_task").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"before_{name}") for name in values]
    spans = cut(spans.select("span_group", "span_task", *before))
    inside = Window.partitionBy(group, "task").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select(group, *keep, "at", "task", *(F.sum(name).over(inside).alias(name) for name in values))
    here = (F.col(group) == F.col("span_group")) & (F.col("task") == F.col("span_task"))
    totals = [(F.col(name) + F.col(f"before_{name}")).alias(name) for name in values]
    return within.join(_small(spans, "span_group"), here).select(group, *keep, "at", *totals)
