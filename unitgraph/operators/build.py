"""From raw edges to the tables of a graph: edges, pairs, nodes.

Tables hold many graphs at once, told apart by ``graph_id``. A unit's key is its upper-cased name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitgraph.functions.names import KINDS, key, ordinal

EDGE_COLUMNS = ("graph_id", "seq", "from_key", "to_key", "from_unit", "to_unit", "section", "certainty", "cond", "file", "line")


def keyed_edges(raw: DataFrame) -> DataFrame:
    """Raw edges with the keys of their ends; one with an empty end is dropped."""
    return raw.where((F.col("from_unit") != "") & (F.col("to_unit") != "")).withColumns({"from_key": key(F.col("from_unit")), "to_key": key(F.col("to_unit"))})


def dedup_edges(raw: DataFrame) -> DataFrame:
    """Edges by identity: both ends, section, certainty and condition, without case.

    The first edge written wins and keeps its file and line; an edge with an empty end is dropped. The
    first is found by an aggregate, which Spark combines before the shuffle, and not by a window.
    """
    keyed = keyed_edges(raw).withColumn("_cond", F.upper("cond"))
    first = keyed.groupBy("graph_id", "from_key", "to_key", "section", "certainty", "_cond").agg(F.min(F.struct("seq", "to_unit", "from_unit", "cond", "file", "line")).alias("f"))
    return first.select("graph_id", "f.seq", "from_key", "to_key", "f.from_unit", "f.to_unit", "section", "certainty", "f.cond", "f.file", "f.line")


def pairs(edges: DataFrame) -> DataFrame:
    """Distinct (from, to) with ``adj_ord``, the order in which a unit's dependencies were first seen.

    Edges with keys give the same pairs before they are made distinct and after.
    """
    first = edges.groupBy("graph_id", "from_key", "to_key").agg(F.min("seq").alias("first_seq"))
    w = Window.partitionBy("graph_id", "from_key").orderBy("first_seq", "to_key")
    return first.withColumn("adj_ord", F.row_number().over(w))


def where_written(edges: DataFrame) -> DataFrame:
    """For each pair its first edge: section, file, line, certainty and condition."""
    first = F.min_by(F.struct("section", "file", "line", "certainty", "cond"), F.struct("seq", F.col("to_unit"))).alias("w")
    return edges.groupBy("graph_id", "from_key", "to_key").agg(first).select("graph_id", "from_key", "to_key", "w.*")


def nodes_from_aliases(raw: DataFrame) -> DataFrame:
    """Node rows with one alias each (empty: none) to nodes with an array of aliases."""
    out = raw.groupBy("graph_id", key(F.col("name")).alias("key")).agg(
        F.min("name").alias("name"), F.min("file_name").alias("file_name"), F.min_by("kind", ordinal(F.col("kind"), KINDS)).alias("kind"), F.max("parsed").alias("parsed"),
        F.sort_array(F.collect_set(F.when(F.col("alias") != "", F.col("alias")))).alias("aliases"))
    return out


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge: (graph_id, key, name, seq); a from end counts before the to end of its edge."""
    a = edges.select("graph_id", F.col("from_key").alias("key"), F.col("from_unit").alias("name"), (F.col("seq") * 2).alias("seq"))
    return a.unionByName(edges.select("graph_id", F.col("to_key").alias("key"), F.col("to_unit").alias("name"), (F.col("seq") * 2 + 1).alias("seq")))


def build_nodes(edges: DataFrame, resolved: DataFrame, units: DataFrame, roots: DataFrame) -> DataFrame:
    """One node per key among the ends of all edges and the roots.

    The name is the first casing seen. ``resolved`` (graph_id, key, file_name, origin) gives kind and
    file, the best-ranked one where several references resolved; without any the unit is unresolved.
    ``units`` (graph_id, key) were parsed. A root is the program.
    """
    seen = ends(edges).unionByName(roots.select("graph_id", F.col("root_key").alias("key"), F.col("root_unit").alias("name"), F.lit(-1).cast("long").alias("seq")))
    named = seen.groupBy("graph_id", "key").agg(F.min_by("name", F.struct("seq", "name")).alias("name"))
    best = resolved.withColumn("kind", F.col("origin")).groupBy("graph_id", "key").agg(F.min_by(F.struct("kind", "file_name"), F.struct(ordinal(F.col("kind"), KINDS), "file_name")).alias("r"))
    root = roots.select("graph_id", F.col("root_key").alias("key"), F.lit(True).alias("is_root")).distinct()
    parsed = units.select("graph_id", "key", F.lit(True).alias("was_parsed")).distinct()
    out = named.join(best, ["graph_id", "key"], "left").join(root, ["graph_id", "key"], "left").join(parsed, ["graph_id", "key"], "left")
    kind = F.when(F.col("is_root"), "program").otherwise(F.coalesce("r.kind", F.lit("unresolved")))
    return out.select("graph_id", "key", "name", F.col("r.file_name").alias("file_name"), kind.alias("kind"), F.coalesce("was_parsed", F.lit(False)).alias("parsed"))


def collect_aliases(used: DataFrame) -> DataFrame:
    """Other spellings that resolved to a unit, distinct by exact text, in first-seen order.

    ``used``: (graph_id, seq, used_name, unit_name).
    """
    other = used.where(F.upper("used_name") != F.upper("unit_name")).groupBy("graph_id", key(F.col("unit_name")).alias("key"), F.col("used_name").alias("alias")).agg(F.min("seq").alias("seq"))
    return other.groupBy("graph_id", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "alias"))), lambda x: x["alias"]).alias("aliases"))


def canonical_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the spelling their nodes keep."""
    n = nodes.select("graph_id", "key", "name")
    f = n.select("graph_id", F.col("key").alias("from_key"), F.col("name").alias("_from"))
    t = n.select("graph_id", F.col("key").alias("to_key"), F.col("name").alias("_to"))
    out = edges.join(f, ["graph_id", "from_key"], "left").join(t, ["graph_id", "to_key"], "left")
    return out.withColumns({"from_unit": F.coalesce("_from", "from_unit"), "to_unit": F.coalesce("_to", "to_unit")}).select(*edges.columns)
