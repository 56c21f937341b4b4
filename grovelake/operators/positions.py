"""Positions and running sums within groups of any size by one range-partitioned sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import Scratch


def _sorted_parts(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """``df`` written in order of group and ``order``, with ``_at`` (growing within a partition) and ``_part``.

    The sort is range-partitioned on group and order together, so a group with most of the rows is spread over tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    _, numbered = Scratch(df.sparkSession, name).write(ordered.withColumn("_at", F.monotonically_increasing_id()))
    return numbered.withColumn("_part", F.shiftright("_at", 33))


def _with_earlier(rows: DataFrame, group: list[str], *sums) -> DataFrame:
    """Rows with the sums of their group's part and those of its earlier parts (``_before``); joined on group and part, so no group is one task."""
    per = rows.groupBy(*group, "_part").agg(*sums)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and partition of the sort
    per = per.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    same = F.col("a._part") == F.col("b._part")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return rows.alias("a").join(per.alias("b"), same).select("a.*", *[F.col(f"b.{c}") for c in per.columns if c not in (*group, "_part")])


def with_position(df: DataFrame, group: list[str], order: list, name: str = "position") -> DataFrame:
    """``df`` with each row's position (from 0) within its group.

    ``order`` must be total within a group, or ties are in any order. Nulls are a group of their own.
    """
    rows = _sorted_parts(df, group, order, "positions")
    rows = _with_earlier(rows, group, F.count("*").alias("_sum"), F.min("_at").alias("_first"))
    return rows.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def with_running_sum(df: DataFrame, group: list[str], order: list, value: str, name: str = "upto") -> DataFrame:
    """``df`` with the sum of ``value`` (nulls count 0) over its group's rows up to and with this one."""
    size = F.coalesce(F.col(value), F.lit(0)).cast("long")
    rows = _with_earlier(_sorted_parts(df, group, order, "sums"), group, F.sum(size).alias("_sum"))
    inside = F.sum(size).over(Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*df.columns, (F.col("_before") + inside).alias(name))
