"""Positions in a global order, ranks and medians without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commlens.session import durable

#: Rows of a table of ranks that are broadcast at most (16 bytes each); larger ones are joined by shuffle.
SMALL = 1_000_000


def running_total(rows: DataFrame, order: list[str], n: str, alias: str) -> DataFrame:
    """The sum of ``n`` up to and with each row, in the order of the columns.

    Rows are dealt by ranges; each range is summed alone, and what lies before it is added.
    The ranges are written first, so that both sides of the join see the same ones.
    """
    ranged = durable(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.sum(n).alias("_size"))  # a row a range
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_upto", F.sum(n).over(inner))
    return local.join(F.broadcast(before), "_range").withColumn(alias, F.col("_before") + F.col("_upto")).drop("_range", "_before", "_upto")


def positions(rows: DataFrame, order: list[str], alias: str) -> DataFrame:
    """The place of every row, from 0; the order should leave no ties."""
    return running_total(rows.withColumn("_one", F.lit(1)), order, "_one", alias).withColumn(alias, F.col(alias) - 1).drop("_one")


def average_ranks(df: DataFrame, column: str, alias: str) -> DataFrame:
    """Average rank of each distinct value (ties share theirs), from a histogram."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return running_total(counts, [column], "_n", "_to").select(column, (F.col("_to") - (F.col("_n") - 1) / 2).cast("double").alias(alias))


def small(table: DataFrame) -> DataFrame:
    """The table, written once and counted there: marked for broadcast if it is small, joined by shuffle if not."""
    held = durable(table)
    return F.broadcast(held) if held.count() <= SMALL else held


def medians(df: DataFrame, groups: list[str], value: str, alias: str) -> DataFrame:
    """Exact median of each group: its one or two middle values, found by position.

    Only a histogram is ordered, so a hot group is spread over many ranges.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counts, [*groups, value], "_n", "_to")
    whole = placed.groupBy(*groups).agg(F.max("_to").alias("_end"), F.sum("_n").alias("_all"))
    x = placed.join(small(whole), groups) if groups else placed.crossJoin(F.broadcast(whole))  # without groups: one row
    upto = F.col("_to") - F.col("_end") + F.col("_all")
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = lambda at: (upto - F.col("_n") <= at) & (at < upto)
    middle = x.where(holds(low) | holds(high)).groupBy(*groups)
    # the lower and the higher middle value, which are one where the number is odd or values repeat
    return middle.agg(((F.min(value) + F.max(value)) / 2).alias(alias))
