"""Who uses whom: lookups and counts over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitgraph.functions.names import SECTIONS, guard_label, ordinal, place, short_section
from unitgraph.operators.match import find_nodes
from unitgraph.operators.ranks import rank_within
from unitgraph.operators.reports import limit_with_more


def dependencies(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct units that the units of ``keys`` (graph_id, key) use, in first-seen order (``adj_ord``)."""
    k = keys.select("graph_id", F.col("key").alias("from_key")).distinct()
    return pairs.join(k, ["graph_id", "from_key"])


def dependents(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct units that use the units of ``keys``, with ``dep_ord``, the order first seen."""
    k = keys.select("graph_id", F.col("key").alias("to_key")).distinct()
    return rank_within(pairs.join(k, ["graph_id", "to_key"]), ["graph_id", "to_key"], [F.col("first_seq"), F.col("from_key")], "dep_ord")


def edges_to(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select("graph_id", F.col("key").alias("to_key")).distinct(), ["graph_id", "to_key"])


def edges_from(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select("graph_id", F.col("key").alias("from_key")).distinct(), ["graph_id", "from_key"])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct dependencies and dependents, and references, of every node; 0 is kept."""
    out = edges.groupBy("graph_id", F.col("from_key").alias("key")).agg(F.count_distinct("to_key").alias("uses"))
    into = edges.groupBy("graph_id", F.col("to_key").alias("key")).agg(F.count_distinct("from_key").alias("used_by"), F.count(F.lit(1)).alias("references"))
    joined = nodes.join(out, ["graph_id", "key"], "left").join(into, ["graph_id", "key"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("graph_id", "key", "name", zero("uses"), zero("used_by"), zero("references"))


def references(nodes: DataFrame, edges: DataFrame, patterns: DataFrame, limit: int = 50) -> DataFrame:
    """Per matched unit its references, by from, then section: who, short section, where, guard.

    A unit that nothing references is one row with a null ``from_unit`` and a count of 0; ``more`` is
    what the limit left out.
    """
    units = find_nodes(nodes, patterns).select("graph_id", F.col("key").alias("to_key"), "name")
    hits = units.join(edges, ["graph_id", "to_key"], "left")
    order = [F.col("from_key"), ordinal(F.col("section"), SECTIONS), F.col("seq")]
    top = limit_with_more(hits, ["graph_id", "to_key"], order, limit)
    total = hits.groupBy("graph_id", "to_key").agg(F.count("from_key").alias("total"))
    top = top.join(total, ["graph_id", "to_key"])
    return top.select("graph_id", F.col("to_key").alias("key"), "name", "total", "rank", "more", "from_unit", F.when(F.col("from_unit").isNotNull(), short_section(F.col("section"))).alias("section"), place(F.col("file"), F.col("line")).alias("where"), F.when(F.col("from_unit").isNotNull(), guard_label(F.col("certainty"), F.col("cond"))).alias("guard"))
