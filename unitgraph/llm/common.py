"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitgraph.plans.durable import durable

#: A word is a run of code points other than space, tab, line feed, vertical tab, form feed and return.
#: ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker holds the texts and results of few rows at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    pa.default_memory_pool().release_unused()  # the worker lives on for other stages


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, group: Sequence[str], order: Column, value: str, out: str, bits: int = 10) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of its group that come before it.

    The order is that of ``order``, a long spread evenly over all 64 bits (a hash). Its upper ``bits``
    cut each group into pieces of even size: totals of pieces are added up first, then rows within a
    piece, so no task ever holds a whole group and a source with a third of all rows is no hot spot.
    ``df`` is read twice and should be cheap to read or durable.
    """
    group = list(group)
    cut = df.withColumn("_order", order).withColumn("_cut", F.shiftright("_order", 64 - bits).cast("int"))
    before = Window.partitionBy(*group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        cut.groupBy(*group, "_cut").agg(F.sum(value).alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_cut").alias("_g_cut"), "_base")
    )
    same = [cut[g].eqNullSafe(base[f"_g_{g}"]) for g in group] + [cut["_cut"] == base["_g_cut"]]
    inner = Window.partitionBy(*group, "_cut").orderBy("_order", *[c for c in df.columns if c not in group and c != value]).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(base, same)
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).select(*df.columns, out)


def join_counted(rows: DataFrame, counts: DataFrame, key: Sequence[str], n: str, most: int = 50_000, least: int = 100, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``counts`` on ``key``, whatever share of the rows one key holds.

    ``counts`` has one row per key, ``n`` being its number of rows. Keys that hold more than one in
    ``most`` of all rows are fewer than ``most``, so they are broadcast and their rows stay where they
    are; the others are shuffled, none of them hot. Both inputs are read twice and should be durable or
    cheap. ``total`` is the number of rows, if it is known.
    """
    key = list(key)
    total = total if total is not None else counts.agg(F.sum(n)).first()[0] or 0
    bar = max(total // most, least)
    hot, cold = counts.where(F.col(n) > bar), counts.where(F.col(n) <= bar)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df``, durable and in order, with ``_rank`` from 0: places within ranges, after the rows of the ranges before."""
    cut = durable(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    base = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut.join(F.broadcast(base), "_part").withColumn("_rank", F.col("_base") + within - 1).select(*df.columns, "_rank")
