"""Lists and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitgraph.functions.names import CERTAINTIES, KINDS, guard_label, ordinal, place
from unitgraph.operators.ranks import first_within, rank_within


def limit_with_more(df: DataFrame, partition: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each list with ``rank``, and in ``more`` how many were left out; 0 keeps all.

    ``partition`` columns are never null and ``order`` is total. No list is ever in one task: its first rows
    are cut out where they lie, its length is counted by an aggregate, and all its ranks come by ranges.
    """
    if not limit:
        return rank_within(df, partition, order).withColumn("more", F.lit(0).cast("long"))
    n = df.groupBy(*partition).agg(F.count(F.lit(1)).alias("_n"))
    top = first_within(df, partition, order, limit).join(n, list(partition))
    return top.select(*df.columns, "rank", F.greatest(F.lit(0), F.col("_n") - limit).cast("long").alias("more"))


def unresolved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Unresolved units, each with its references by certainty, from and line; one row if it has none."""
    units = nodes.where("kind = 'unresolved'").select("graph_id", F.col("key").alias("to_key"), "name")
    hits = units.join(edges, ["graph_id", "to_key"], "left")
    order = [ordinal(F.col("certainty"), CERTAINTIES), F.col("from_key"), F.col("line"), F.col("seq")]
    ranked = rank_within(hits, ["graph_id", "to_key"], order)
    return ranked.select("graph_id", F.col("to_key").alias("key"), "name", "from_unit", "certainty", "cond", "section", "file", "line", "rank")


def unresolved_report(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """Each unresolved unit with its first reference, where it is, and how many more there are.

    The first is taken by an aggregate, so a unit that everything references is no hot spot.
    """
    units = nodes.where("kind = 'unresolved'").select("graph_id", F.col("key").alias("to_key"), "name")
    first = F.min(F.struct(ordinal(F.col("certainty"), CERTAINTIES).alias("o"), "from_key", "line", "seq", "from_unit", "certainty", "cond", "file")).alias("f")
    refs = edges.join(units.select("graph_id", "to_key"), ["graph_id", "to_key"], "left_semi").groupBy("graph_id", "to_key").agg(first, F.count(F.lit(1)).alias("n"))
    out = units.join(refs, ["graph_id", "to_key"], "left").select("graph_id", F.col("to_key").alias("key"), "name", F.col("f.from_unit").alias("from_unit"), place(F.col("f.file"), F.col("f.line")).alias("where"), guard_label(F.col("f.certainty"), F.col("f.cond")).alias("guard"), F.greatest(F.lit(0).cast("long"), F.coalesce("n", F.lit(0)) - 1).alias("others"))
    return limit_with_more(out, ["graph_id"], [F.col("key")], limit)


def unresolved_count(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id").agg(F.count_if(F.col("kind") == "unresolved").alias("unresolved"))


def summary(nodes: DataFrame, edges: DataFrame, warnings: DataFrame) -> DataFrame:
    """(graph_id, ord, label, value): units per kind in kind order, the program among project units, their
    total, then edges, unresolved units and warnings."""
    kind = F.when(F.col("kind") == "program", "project").otherwise(F.col("kind"))
    kinds = nodes.select("graph_id", kind.alias("kind")).rollup("graph_id", "kind").agg(F.count(F.lit(1)).alias("value")).where("graph_id is not null")
    units = kinds.select("graph_id", F.when(F.col("kind").isNull(), 10).otherwise(ordinal(F.col("kind"), KINDS)).alias("ord"), F.coalesce("kind", F.lit("total")).alias("label"), "value")
    def counted(df: DataFrame, ord_: int, label: str) -> DataFrame:
        n = df.groupBy("graph_id").agg(F.count(F.lit(1)).alias("value"))
        return nodes.select("graph_id").distinct().join(n, "graph_id", "left").select("graph_id", F.lit(ord_).alias("ord"), F.lit(label).alias("label"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return units.unionByName(counted(edges, 11, "edges")).unionByName(counted(nodes.where("kind = 'unresolved'"), 12, "unresolved units")).unionByName(counted(warnings, 13, "warnings"))


def warning_report(warnings: DataFrame, limit: int = 20) -> DataFrame:
    """``File.pas(12) message``, the line left out where it is 0."""
    where = F.when(F.col("line") > 0, place(F.col("file"), F.col("line"))).otherwise(F.regexp_extract("file", r"[^\\/]*$", 0))
    top = limit_with_more(warnings, ["graph_id"], [F.col("seq")], limit)
    return top.select("graph_id", "rank", "more", F.concat_ws(" ", where, "message").alias("text"))
