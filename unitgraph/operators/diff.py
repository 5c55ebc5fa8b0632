"""What changed between two snapshots of the same graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_units(before: DataFrame, after: DataFrame) -> DataFrame:
    """(graph_id, key, name, change): units on one side only."""
    keys = ["graph_id", "key"]
    gone = before.join(after.select(*keys), keys, "left_anti").select(*keys, "name", F.lit("removed").alias("change"))
    return gone.unionByName(after.join(before.select(*keys), keys, "left_anti").select(*keys, "name", F.lit("added").alias("change")))


def identity(edges: DataFrame) -> DataFrame:
    return edges.withColumn("cond_key", F.upper("cond"))


IDENTITY = ["graph_id", "from_key", "to_key", "section", "certainty", "cond_key"]


def _sides(before: DataFrame, after: DataFrame, keys: list[str], *first: str) -> DataFrame:
    """Distinct ``keys`` of both, with the least of the columns ``first``; ``sides`` is 1 for before, 2 for after, 3 for both."""
    both = before.select(*keys, *first, F.lit(1).alias("side")).unionByName(after.select(*keys, *first, F.lit(2).alias("side")))
    return both.groupBy(*keys).agg(F.bit_or("side").alias("sides"), *[F.min(c).alias(c) for c in first])


def diff_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges whose identity is on one side only. A moved line is no change, a moved clause is two.

    Edges may be distinct already or not: one shuffle of their identities makes them so and compares them.
    """
    only = _sides(identity(before), identity(after), IDENTITY, "cond").where("sides != 3")
    return only.select("graph_id", "from_key", "to_key", "section", "certainty", "cond", F.when(F.col("sides") == 1, "removed").otherwise("added").alias("change"))


def diff_summary(before_nodes: DataFrame, before_edges: DataFrame, after_nodes: DataFrame, after_edges: DataFrame) -> DataFrame:
    """Distinct unit and edge counts before and after, their change, and whether nothing differs; each row is shuffled once."""
    def n(sides: DataFrame, what: str) -> DataFrame:
        count = lambda c, name: F.count_if(c).alias(name)
        s = F.col("sides")
        return sides.groupBy("graph_id").agg(count(s != 2, f"{what}_before"), count(s != 1, f"{what}_after"), count(s != 3, f"{what}_differ"))
    units = n(_sides(before_nodes, after_nodes, ["graph_id", "key"]), "units")
    out = units.join(n(_sides(identity(before_edges), identity(after_edges), IDENTITY), "edges"), "graph_id", "full_outer")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in out.columns if c != "graph_id"}).withColumn("changes", F.col("units_differ") + F.col("edges_differ"))
    return out.select("graph_id", "units_before", "units_after", (F.col("units_after") - F.col("units_before")).alias("units_change"), "edges_before", "edges_after", (F.col("edges_after") - F.col("edges_before")).alias("edges_change"), (F.col("changes") == 0).alias("is_empty"))
