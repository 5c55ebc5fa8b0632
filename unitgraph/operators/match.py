"""Finding units by name or glob."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitgraph.functions.names import glob_match, is_wildcard
from unitgraph.operators.ranks import rank_within, small
from unitgraph.plans.durable import counted, written


def patterns(spark, *texts: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "pattern string")


#: Patterns without three literal characters in a row that are compared with every name at a time.
BLOCK = 1_000


def _grams(runs: Column) -> Column:
    """All runs of three characters within each of the texts ``runs``."""
    cut = lambda r: F.when(F.length(r) >= 3, F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda i: F.substr(r, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(runs, cut)))


def glob_pairs(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(graph_id, key, pattern), distinct: which names (graph_id, key, any_name) match which patterns as globs.

    A name that matches holds every three literal characters in a row of the pattern. Each pattern is joined
    with the names that hold the rarest of these, found by counting, and only these are compared with it.
    Patterns that have none, like ``*`` or ``P?``, say so little that they are compared with every name.
    """
    p, n = counted(wanted.select("pattern").where("pattern != ''").distinct().withColumn("grams", _grams(F.split(F.upper("pattern"), "[*?]"))))
    asked = p.select("pattern", F.explode("grams").alias("gram"))
    held = names.select("graph_id", "key", "any_name", F.explode(_grams(F.array(F.upper("any_name")))).alias("gram"))
    held = written(held.join(small(asked.select("gram").distinct(), n), "gram", "left_semi"))
    rare = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    pick = asked.join(rare, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    found = held.join(small(pick, n), "gram").where(glob_match(F.col("pattern"), F.col("any_name"))).select("graph_id", "key", "pattern")
    vague, m = counted(rank_within(p.where(F.size("grams") == 0).select("pattern"), [], [F.col("pattern")], "no"))
    for first in range(0, m, BLOCK):
        block = F.broadcast(vague.where((F.col("no") > first) & (F.col("no") <= first + BLOCK)).select("pattern"))
        found = found.unionByName(names.join(block, glob_match(F.col("pattern"), F.col("any_name"))).select("graph_id", "key", "pattern"))
    return found.distinct()


def unit_names(nodes: DataFrame) -> DataFrame:
    """(graph_id, key, any_name): a unit's name and its aliases."""
    return nodes.select("graph_id", "key", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("any_name"))


def matches(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(graph_id, key, pattern): which node matches which pattern.

    A pattern without wildcards that is a unit's name stands for that unit alone, in each graph by itself;
    else names and aliases are matched as globs. The first is an equi-join, so is most of the second.
    """
    p = wanted.where(F.trim("pattern") != "").select("pattern").distinct()
    plain = p.where(~is_wildcard(F.col("pattern"))).withColumn("key", F.upper("pattern"))
    exact = nodes.join(plain, "key").select("graph_id", "key", "pattern")
    globbed = glob_pairs(unit_names(nodes), p).join(exact.select("graph_id", "pattern").distinct(), ["graph_id", "pattern"], "left_anti").select("graph_id", "key", "pattern")
    return exact.unionByName(globbed)


def find_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes that match any pattern, each once."""
    return nodes.join(matches(nodes, wanted).select("graph_id", "key").distinct(), ["graph_id", "key"], "left_semi")


def not_in_graph(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(graph_id, pattern, reason): patterns that match nothing."""
    # One list of patterns for each graph; a pattern is missing where it is not in the list of those found.
    asked = wanted.agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
    graphs = nodes.groupBy("graph_id").agg(F.lit(0).alias("one")).join(F.broadcast(asked.withColumn("one", F.lit(0))), "one")
    missing = graphs.select("graph_id", F.explode("patterns").alias("pattern")).join(matches(nodes, wanted).select("graph_id", "pattern").distinct(), ["graph_id", "pattern"], "left_anti")
    return missing.withColumn("reason", F.when(is_wildcard(F.col("pattern")), "wildcard").otherwise("name"))
