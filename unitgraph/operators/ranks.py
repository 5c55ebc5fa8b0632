"""Ranks within lists of any length, and joins with sides of a checked size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitgraph.plans.durable import durable

#: Rows that are broadcast, or ranked in one task, once they have been counted.
SMALL = 100_000
#: Rows of a list up to which Spark limits windows before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
CUT = 1_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` rows, broadcast if these are few; else joins sort and merge it, whatever Spark guesses of its size."""
    return F.broadcast(df) if rows <= SMALL else df.hint("merge")


def hint(rows: int) -> str:
    """``small`` for SQL text: the name of the hint."""
    return "broadcast" if rows <= SMALL else "merge"


def rank_within(df: DataFrame, lists: Sequence[str], order: Sequence[Column], out: str = "rank", kind: str = "int", keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """``df`` with each row's place, from 1, in its list by ``order``, which must be total.

    Rows are dealt by ranges of list and order, so a list that holds a third of all rows is spread over
    many tasks; each range is ranked by itself, after the rows its list has in the ranges before. ``keep`` stores
    the dealt rows.
    """
    placed = total_within(df.withColumn("_one", F.lit(1).cast("long")), lists, order, "_one", "_before", keep)
    return placed.select(*df.columns, (F.col("_before") + 1).cast(kind).alias(out))


def total_within(df: DataFrame, lists: Sequence[str], order: Sequence[Column], value: str, out: str, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its list that come before each by ``order``; dealt as in ``rank_within``."""
    lists = list(lists)
    dealt = keep(df.repartitionByRange(*lists, *order).withColumn("_range", F.spark_partition_id()))
    zero = F.lit(0).cast("long")
    ahead = Window.partitionBy(*lists).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A list has a row here for each range it is in.
    base = dealt.groupBy(*lists, "_range").agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(ahead), zero)).drop("_sum")
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(*lists, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), zero)
    return dealt.withColumn("_inner", inner).join(base, [*lists, "_range"]).select(*df.columns, (F.col("_base") + F.col("_inner")).alias(out))


def first_within(df: DataFrame, lists: Sequence[str], order: Sequence[Column], limit: int, out: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each list with their place, by a total order.

    Up to CUT rows, Spark has every task cut its own rows before lists meet. A longer limit is no longer
    cut there, so all ranks are taken by ranges; either way no task holds a list.
    """
    if limit > CUT:
        return rank_within(df, lists, order, out).where(F.col(out) <= limit)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*lists).orderBy(*order))).where(F.col(out) <= limit)
