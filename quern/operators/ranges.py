"""Sums and ranks in an order, over groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, by: str, order: list[str], cost: Column, keep: Callable[[DataFrame], DataFrame], ranges: int | None = None) -> DataFrame:
    """df with spent: the sum of cost over the group's rows up to and with each row, in order.  Rows of a group should differ in order.

    Rows are split into ranges of (group, order), so that no task gets a whole group because it is large.  Each range's sums,
    one row for each group in it, are added up in a window over ranges, and each row's sum within its range is added to that
    of the ranges before.  ``ranges``: the shuffle's own number of partitions by default.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = keep(keep(df.withColumn("__cost", cost)).repartitionByRange(n, by, *order).withColumn("__range", F.spark_partition_id()))
    sums = split.groupBy(by, "__range").agg(F.sum("__cost").alias("__sum"))
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(by, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = split.withColumn("__own", F.sum("__cost").over(within))
    # null groups are groups too
    met = own.join(base.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")) & (own["__range"] == base["__range"])).drop(base["__range"])
    return met.withColumn("spent", F.col("__own") + F.col("__base")).drop("__cost", "__range", "__own", "__base", "__by")
