"""Shortest chains between units, and the reports built on them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitgraph.functions.names import step_label
from unitgraph.operators.bfs import _union, shortest_path_dag
from unitgraph.operators.build import where_written
from unitgraph.operators.match import find_nodes
from unitgraph.operators.ranks import rank_within, small, total_within
from unitgraph.operators.reports import limit_with_more
from unitgraph.plans.durable import counted, durable, written


#: Numbers of chains are exact below this, and this from there on.
MOST_CHAINS = 10**30


def _total(column: Column) -> Column:
    return F.least(column, F.lit(Decimal(MOST_CHAINS))).cast("decimal(38,0)")


def count_chains(units: DataFrame, preds: DataFrame, deepest: int) -> DataFrame:
    """(graph_id, root_key, key, total): how many shortest chains lead to each unit, down to a depth.

    ``units`` and ``preds`` as ``shortest_path_dag`` gives them. A unit has as many chains as its
    predecessors together; a level reads those of the one above only.
    """
    level, n = counted(units.where("depth = 0").select("graph_id", "root_key", "key", F.lit(1).cast("decimal(38,0)").alias("total")))
    levels = [level]
    for d in range(1, deepest + 1):
        above = small(level.withColumnRenamed("key", "pred_key"), n)
        met = preds.where(F.col("depth") == d).join(above, ["graph_id", "root_key", "pred_key"])
        level, n = counted(met.groupBy("graph_id", "root_key", "key").agg(_total(F.sum("total")).alias("total")))
        levels.append(level)
    return _union(levels)


def _every_path(pairs: DataFrame, roots: DataFrame, targets: DataFrame) -> DataFrame:
    """``find_paths`` without a limit: from the targets up, what is on no way to them is left out; from the roots
    down, chains then grow a unit a level, so that no level holds a chain which does not go on to a target."""
    units, preds = shortest_path_dag(pairs, roots)
    keys = ["graph_id", "root_key", "key"]
    wanted, many = counted(units.join(targets.select("graph_id", "key").distinct(), ["graph_id", "key"], "left_semi").select(*keys, "depth"))
    deepest = wanted.agg(F.max("depth")).first()[0] or 0
    preds = written(preds.where(F.col("depth") <= deepest))
    at = lambda d: wanted.where(F.col("depth") == d).select(*keys)
    needed, n = counted(at(deepest))
    steps: list[DataFrame] = []
    for d in range(deepest, 0, -1):
        step = written(preds.where(F.col("depth") == d).join(small(needed, n), keys, "left_semi").select(*keys, "pred_key", "pred_rank"))
        steps.insert(0, step)
        needed, n = counted(step.select("graph_id", "root_key", F.col("pred_key").alias("key")).unionByName(at(d - 1)).distinct())
    # ``ranks``: of the units before the last, the last of them first; by these chains are in order.
    grown, n = counted(needed.select(*keys, F.array("key").alias("chain"), F.array().cast("array<int>").alias("ranks")))
    found = [grown]
    for step in steps:
        met = step.join(small(grown.withColumnRenamed("key", "pred_key"), n), ["graph_id", "root_key", "pred_key"])
        grown, n = counted(met.select(*keys, F.array_append("chain", F.col("key")).alias("chain"), F.array_prepend("ranks", F.col("pred_rank")).alias("ranks")))
        found.append(grown)
    whole = written(_union(found).join(small(wanted.select(*keys), many), keys, "left_semi").withColumnRenamed("key", "to_key"))
    lists = ["graph_id", "root_key", "to_key"]
    total = whole.groupBy(*lists).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("total"))
    return rank_within(whole, lists, [F.col("ranks")], "chain_no").join(total, lists).select(*lists, "chain_no", "chain", "total")


def find_paths(pairs: DataFrame, roots: DataFrame, targets: DataFrame, max_paths: int | None = 5) -> DataFrame:
    """(graph_id, root_key, to_key, chain_no, chain, total): the first ``max_paths`` shortest chains to each target; None: all.

    Chains come in the order of their predecessors' discovery; ``total`` is how many there are. They are
    counted, not listed: the i-th chain of a unit goes through the predecessor among whose chains the i-th
    falls, and on from there with its number among those. So a level holds one row for each chain wanted,
    however many there are, and chains are put together at the end. A root that is a target has itself as
    its one chain.
    """
    if max_paths is None:
        return _every_path(pairs, roots, targets)
    units, preds = shortest_path_dag(pairs, roots)
    keys = ["graph_id", "root_key", "key"]
    wanted, _ = counted(units.join(targets.select("graph_id", "key").distinct(), ["graph_id", "key"], "left_semi").select(*keys, "depth").where(F.lit(max_paths > 0)))
    deepest = wanted.agg(F.max("depth")).first()[0] or 0
    preds = durable(preds.where(F.col("depth") <= deepest))
    totals = durable(count_chains(units, preds, deepest))
    # Where in a unit's chains those through each predecessor begin and end; those past the limit are of no use.
    each = preds.join(totals.withColumnsRenamed({"key": "pred_key", "total": "ways"}), ["graph_id", "root_key", "pred_key"])
    begun = total_within(each, keys, [F.col("pred_rank")], "ways", "before").where(F.col("before") < max_paths)
    steps = durable(begun.select(*keys, "depth", "pred_key", F.col("before").cast("int").alias("before"), F.least("ways", F.lit(max_paths)).cast("int").alias("ways")))
    first = wanted.join(totals, keys).select("graph_id", "root_key", F.col("key").alias("to_key"), "key", "depth", F.explode(F.sequence(F.lit(1), F.least("total", F.lit(max(max_paths, 1))).cast("int"))).alias("chain_no"), "total")
    state = ["graph_id", "root_key", "to_key", "chain_no", "key", "at"]
    starts = durable(first.withColumn("at", F.col("chain_no")))
    rows, n = counted(starts.where(F.col("depth") == deepest).select(*state))
    found = []
    for d in range(deepest, -1, -1):
        found.append(rows.select(*state[:4], F.lit(d).alias("depth"), "key"))
        if d:
            here = steps.where(F.col("depth") == d).withColumn("at", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("ways"), F.lit(max_paths)))))
            moved = here.join(small(rows, n), [*keys, "at"]).select(*state[:4], F.col("pred_key").alias("key"), (F.col("at") - F.col("before")).alias("at"))
            rows, n = counted(moved.unionByName(starts.where(F.col("depth") == d - 1).select(*state)))
    whole = _union(found).groupBy(*state[:4]).agg(F.sort_array(F.collect_list(F.struct("depth", "key"))).alias("units"))
    return whole.join(starts.select(*state[:4], "total"), state[:4]).select(*state[:4], F.transform("units", lambda u: u["key"]).alias("chain"), "total")


def prefix_tree(chains: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every distinct prefix of the chains, once: its unit, its parent and how that step is written."""
    cut = chains.select("graph_id", "root_key", "to_key", "chain_no", "chain", F.posexplode("chain").alias("depth", "key"))
    cut = cut.withColumn("prefix", F.array_join(F.slice("chain", 1, F.col("depth") + 1), ">")).withColumn("parent", F.when(F.col("depth") > 0, F.array_join(F.slice("chain", 1, F.col("depth")), ">"))).withColumn("parent_key", F.when(F.col("depth") > 0, F.element_at("chain", F.col("depth"))))
    one = cut.groupBy("graph_id", "root_key", "prefix").agg(F.min(F.struct("depth", "key", "parent", "parent_key")).alias("p"), F.max(F.col("key") == F.col("to_key")).alias("is_target"))
    w = where_written(edges)
    names = nodes.select("graph_id", "key", "name")
    flat = one.select("graph_id", "root_key", "prefix", "p.*", "is_target").join(names, ["graph_id", "key"], "left")
    joined = flat.join(w.withColumnsRenamed({"from_key": "parent_key", "to_key": "key"}), ["graph_id", "parent_key", "key"], "left")
    label = F.when(F.col("parent").isNotNull(), step_label(F.col("section"), F.col("file"), F.col("line"), F.col("certainty"), F.col("cond")))
    return joined.select("graph_id", "root_key", "prefix", "depth", "key", F.coalesce("name", "key").alias("name"), "parent", label.alias("step"), "is_target")


def why(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, roots: DataFrame, patterns: DataFrame, max_paths: int | None = 5) -> tuple[DataFrame, DataFrame]:
    """Chains from the root to every matched unit as a prefix tree, and the matched units out of reach."""
    targets = durable(find_nodes(nodes, patterns).select("graph_id", "key", "name"))
    chains = durable(find_paths(pairs, roots, targets, max_paths))
    missed = targets.join(chains.select("graph_id", F.col("to_key").alias("key")).distinct(), ["graph_id", "key"], "left_anti")
    return prefix_tree(chains, nodes, edges), missed


def path(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, start: DataFrame, patterns: DataFrame, max_paths: int | None = 5) -> tuple[DataFrame | None, DataFrame]:
    """``why`` from a chosen start, which must match exactly one unit of a graph.

    Returns (tree, units out of reach), or (None, candidates) where the start matches no unit or several.
    """
    found = find_nodes(nodes, start).select("graph_id", "key", "name")
    if len(found.limit(2).collect()) != 1:
        return None, found
    return why(nodes, edges, pairs, found.select("graph_id", F.col("key").alias("root_key")), patterns, max_paths)


def deps(nodes: DataFrame, pairs: DataFrame, patterns: DataFrame, depth: int = 3, limit: int = 50) -> DataFrame:
    """What the matched units pull in: one row per dependency of each unit that is opened.

    A unit is opened once, where it is nearest; a later mention has ``above`` set if it has dependencies
    of its own. ``depth`` 0 opens all. ``total`` is how many units the start pulls in; ``more`` what the
    limit left out below a unit; ``cut`` marks units that were not opened for want of depth.
    """
    roots = find_nodes(nodes, patterns).select("graph_id", F.col("key").alias("root_key"))
    units, _ = shortest_path_dag(pairs, roots)
    reach = units.select("graph_id", F.col("root_key").alias("scenario"), "key", "depth")
    total = reach.groupBy("graph_id", "scenario").agg((F.count(F.lit(1)) - 1).alias("total"))
    tree = units.where("parent is not null").select("graph_id", F.col("root_key").alias("scenario"), "key", "parent")
    opened = reach.where(F.col("depth") < depth) if depth else reach
    rows = opened.select("graph_id", "scenario", F.col("key").alias("from_key"), F.col("depth").alias("at")).join(pairs, ["graph_id", "from_key"])
    first = tree.select("graph_id", "scenario", F.col("key").alias("to_key"), F.col("parent").alias("from_key"), F.lit(True).alias("is_expanded"))
    has = pairs.select("graph_id", F.col("from_key").alias("to_key"), F.lit(True).alias("has_deps")).distinct()
    out = rows.join(first, ["graph_id", "scenario", "from_key", "to_key"], "left").join(has, ["graph_id", "to_key"], "left").join(total, ["graph_id", "scenario"])
    expanded, inner = F.coalesce("is_expanded", F.lit(False)), F.coalesce("has_deps", F.lit(False))
    out = out.select("graph_id", F.col("scenario").alias("root_key"), "from_key", "to_key", (F.col("at") + 1).alias("depth"), "adj_ord", expanded.alias("is_expanded"), (~expanded & inner).alias("above"),
                     (expanded & inner & (F.lit(bool(depth)) & (F.col("at") + 1 >= depth))).alias("cut"), "total")
    return limit_with_more(out, ["graph_id", "root_key", "from_key"], [F.col("adj_ord")], limit)
