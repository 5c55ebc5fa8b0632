"""Forbidden-dependency rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitgraph.functions.names import glob_match, place
from unitgraph.operators.bfs import shortest_path_dag
from unitgraph.operators.build import where_written
from unitgraph.operators.match import glob_pairs, unit_names
from unitgraph.plans.durable import durable


def _hits(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(graph_id, key, rule_pos, pattern): the rules that any name of a unit matches."""
    return glob_pairs(names, rules).join(rules.select("rule_pos", "pattern"), "pattern").select("graph_id", "key", "rule_pos", "pattern")


def excused(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(graph_id, key) of units that an allow rule names."""
    return _hits(names, rules.where("allow")).select("graph_id", "key").distinct()


def violated_by(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(graph_id, key, pattern): the first forbidding rule that a unit breaks and that nothing excuses."""
    broken = _hits(names, rules.where("not allow")).join(excused(names, rules), ["graph_id", "key"], "left_anti")
    return broken.groupBy("graph_id", "key").agg(F.min_by("pattern", "rule_pos").alias("pattern"))


def forbid_count(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count_if(~F.col("allow")).alias("forbids"))


def check(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, roots: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each forbid rule judged alone over the reachable units but the root.

    Returns (graph_id, rule_pos, pattern, broken, passed), rules that nothing breaks included, and
    (graph_id, rule_pos, pattern, key, name, via, where): via is the second unit of the first shortest
    chain, empty if that is the unit itself; where is the place the root names it.
    """
    units, _ = shortest_path_dag(pairs, roots)
    reached = units.where("depth > 0").select("graph_id", "root_key", "key", "first_hop")
    names = unit_names(nodes.join(reached.select("graph_id", "key").distinct(), ["graph_id", "key"], "left_semi"))
    open_ = names.join(excused(names, rules), ["graph_id", "key"], "left_anti")
    broken = durable(_hits(open_, rules.where("not allow")))
    w = where_written(edges).select("graph_id", F.col("from_key").alias("root_key"), F.col("to_key").alias("first_hop"), place(F.col("file"), F.col("line")).alias("where"))
    label = nodes.select("graph_id", "key", "name")
    via_name = label.select("graph_id", F.col("key").alias("first_hop"), F.col("name").alias("via_name"))
    detail = broken.join(reached, ["graph_id", "key"]).join(w, ["graph_id", "root_key", "first_hop"], "left").join(label, ["graph_id", "key"]).join(via_name, ["graph_id", "first_hop"])
    detail = detail.select("graph_id", "rule_pos", "pattern", "key", "name", F.when(F.col("first_hop") == F.col("key"), "").otherwise(F.col("via_name")).alias("via"), "where")
    counted = broken.groupBy("graph_id", "rule_pos").agg(F.count(F.lit(1)).alias("broken"))
    forbids = rules.where("not allow").agg(F.array_sort(F.collect_list(F.struct("rule_pos", "pattern"))).alias("forbids"), F.lit(0).alias("one"))
    every = roots.groupBy("graph_id").agg(F.lit(0).alias("one")).join(F.broadcast(forbids), "one").select("graph_id", F.inline("forbids"))
    verdict = every.join(counted, ["graph_id", "rule_pos"], "left").select("graph_id", "rule_pos", "pattern", F.coalesce("broken", F.lit(0).cast("long")).alias("broken"), F.col("broken").isNull().alias("passed"))
    return verdict, detail
