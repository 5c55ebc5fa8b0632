"""Cutting lineage where every executor can read the result."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and all runs in one
    process (tests, a laptop) a temporary folder is taken.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR")))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that losing an executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared folder. Unlike a checkpoint they carry nothing over of what Spark has
    inferred about the columns, which in a long loop would grow with every round."""
    at = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, Row]:
    """``df``, written, and aggregates over its rows, taken meanwhile."""
    seen = Observation()
    kept = written(df.observe(seen, *[c.alias(name) for name, c in measures.items()]))
    return kept, Row(**seen.get)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df``, written, and its number of rows."""
    kept, n = observed(df, rows=F.count(F.lit(1)))
    return kept, n["rows"]


def bucketed(df: DataFrame, *keys: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, dealt into buckets by ``keys``: joins on these do not shuffle it.

    There are as many buckets as shuffle partitions, so the other side of a join is dealt likewise. ``then`` is
    done with the rows once they are dealt, and must leave each where it is: what it groups by ``keys`` and more
    needs no shuffle of its own.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"dealt_{uuid.uuid4().hex}"
    # One task writes each bucket, whole.
    dealt = df.repartition(n, *keys)
    dealt = then(dealt) if then else dealt
    dealt.write.bucketBy(n, *keys).sortBy(*keys).option("path", f"{shared_dir(spark).rstrip('/')}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)
