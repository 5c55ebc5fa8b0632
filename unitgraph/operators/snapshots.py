"""Stored snapshots, compared by sums first: parts that agree are never read.

A snapshot is written in parts by a hash of each row's identity, with the number of rows and an
order-independent sum of their hashes for each part. Two snapshots are compared part by part; only parts
that differ are read and joined. Reading follows what changed, not what there is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitgraph.operators.diff import IDENTITY, diff_edges, identity

#: Parts of a snapshot unless told otherwise. Both sides of a comparison need the same number.
PARTS = 1024
SUMS = "part int, parts int, n long, h1 decimal(30,0), h2 decimal(30,0)"
EDGES = "graph_id string, from_key string, to_key string, section string, certainty string, cond string, cond_key string"


def _sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``SUMS`` of each part. Parts are taken as alike if their counts and both sums of 64-bit hashes are.

    A hash passes over nulls, so where they stand is hashed too.
    """
    whole = [*keys, *[F.isnull(k) for k in keys]]
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    return rows.groupBy("part", "parts").agg(F.count(F.lit(1)).alias("n"), wide(*whole).alias("h1"), wide(F.lit("\x02"), *whole).alias("h2"))


def write_snapshot(rows: DataFrame, at: str, keys: Sequence[str], parts: int = PARTS) -> None:
    """``rows`` under ``at``: ``rows/part=N`` and ``sums``. ``keys`` are what a row is.

    A part is a file: rows are dealt by part before they are written, so no task holds many writers open.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    dealt.repartition("part").write.partitionBy("part").parquet(f"{at}/rows")
    read = rows.sparkSession.read.schema(dealt.schema).parquet(f"{at}/rows")
    _sums(read.withColumn("parts", F.lit(parts)), keys).coalesce(1).write.parquet(f"{at}/sums")


def write_edges_snapshot(edges: DataFrame, at: str, parts: int = PARTS) -> None:
    """Edges by their identity; a line that has moved is no other edge."""
    write_snapshot(identity(edges), at, IDENTITY, parts)


def differing_parts(spark: SparkSession, before: str, after: str) -> list[int]:
    """The parts that are not alike; at most as many as there are parts, so the driver may hold them."""
    b, a = [spark.read.schema(SUMS).parquet(f"{at}/sums") for at in (before, after)]
    if b.select("parts").unionByName(a.select("parts")).distinct().count() > 1:
        raise ValueError("the snapshots were written in different numbers of parts")
    same = b.join(a, ["part", "parts", "n", "h1", "h2"], "left_semi").select("part")
    return sorted(r["part"] for r in b.select("part").unionByName(a.select("part")).distinct().join(same, "part", "left_anti").collect())


def read_parts(spark: SparkSession, at: str, parts: Sequence[int], schema: str) -> DataFrame:
    """The rows of some parts, of ``schema``; the others' folders are not opened."""
    return spark.read.schema(f"{schema}, part int").parquet(f"{at}/rows").where(F.col("part").isin(*parts) if parts else F.lit(False)).drop("part")


def diff_edges_stored(spark: SparkSession, before: str, after: str) -> DataFrame:
    """``diff_edges`` of two stored snapshots, whose identities hold no nulls (``dedup_edges``)."""
    parts = differing_parts(spark, before, after)
    return diff_edges(*[read_parts(spark, at, parts, EDGES).drop("cond_key") for at in (before, after)])
