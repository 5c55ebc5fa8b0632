"""Reachability by levels: each round joins the newest units with their dependencies.

Every loop joins only ``pairs``, which the caller makes durable once and best deals by (graph_id, from_key),
see ``plans.durable.bucketed``. They stay where they are: a round sends the newest units to them, by
broadcast if these have been counted and are few, else dealt by key like the pairs. Every level is written
to the shared folder before the next, so lineage stays short and a lost executor costs one level.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitgraph.operators import ranks
from unitgraph.operators.ranks import rank_within, small
from unitgraph.plans.durable import counted, durable, written

MAX_ROUNDS = 100_000
#: Levels kept apart before they are written as one.
FOLD = 16


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _seen(levels: list[DataFrame], sizes: list[int], columns: list[str]) -> DataFrame:
    return small(_union([level.select(*columns) for level in levels]), sum(sizes))


def _fresh(met: DataFrame, seen: DataFrame, many: int, keys: list[str], once: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``met`` without what is ``seen``, each unit ``once``.

    A seen set that is broadcast cuts rows before the shuffle; a large one is met by rows that were added up before.
    """
    return once(met.join(seen, keys, "left_anti")) if many <= ranks.SMALL else once(met).join(seen, keys, "left_anti")


def known_units(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """Of ``starts`` (graph_id, key), the units that a pair names."""
    starts, n = counted(starts.select("graph_id", "key").distinct())
    named = pairs.select("graph_id", F.explode(F.array("from_key", "to_key")).alias("key"))
    return named.join(small(starts, n), ["graph_id", "key"], "left_semi").distinct()


def walk(pairs: DataFrame, sources: DataFrame, without: DataFrame | None = None, max_depth: int | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(graph_id, scenario, key, depth): what each scenario reaches, its start included at depth 0.

    ``sources``: (graph_id, scenario, key). ``without``: (graph_id, scenario, from_key, to_key), pairs
    that a scenario may not use. A start that no pair names reaches nothing.
    """
    keys = ["graph_id", "scenario", "key"]
    level, n = counted(sources.select(*keys).distinct().join(known_units(pairs, sources), ["graph_id", "key"], "left_semi").select(*keys, F.lit(0).alias("depth")))
    gone = None
    if without is not None:
        gone, many = counted(without.select("graph_id", "scenario", "from_key", F.col("to_key").alias("key")).distinct())
        gone = small(gone, many)
    levels, sizes = [level], [n]
    for round_ in range(1, max_rounds + 1):
        if max_depth is not None and round_ > max_depth:
            return _union(levels)
        near = level.select("graph_id", "scenario", F.col("key").alias("from_key"), (F.col("depth") + 1).alias("depth"))
        met = pairs.select("graph_id", "from_key", F.col("to_key").alias("key")).join(small(near, sizes[-1]), ["graph_id", "from_key"])
        if gone is not None:
            met = met.join(gone, ["graph_id", "scenario", "from_key", "key"], "left_anti")
        level, n = counted(_fresh(met, _seen(levels, sizes, keys), sum(sizes), keys, lambda m: m.select(*keys, "depth").distinct()))
        if not n:
            return _union(levels)
        levels, sizes = [*levels, level], [*sizes, n]
        if len(levels) > FOLD:
            levels, sizes = [durable(_union(levels[:-1])), level], [sum(sizes[:-1]), n]
    raise RuntimeError(f"not finished after {max_rounds} rounds")


def reachable_from(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(graph_id, root_key, key, depth)."""
    return walk(pairs, roots.select("graph_id", F.col("root_key").alias("scenario"), F.col("root_key").alias("key"))).withColumnRenamed("scenario", "root_key")


def is_reachable(pairs: DataFrame, roots: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (graph_id, key) with ``reachable``."""
    found = reachable_from(pairs, roots).select("graph_id", "key", F.lit(True).alias("hit")).distinct()
    return keys.join(found, ["graph_id", "key"], "left").select("graph_id", "key", F.coalesce("hit", F.lit(False)).alias("reachable"))


#: Scenarios that share a row of a unit in ``walk_bits``.
WORD = 64


def _bit(no: str) -> tuple[Column, Column]:
    """The word and the bit in it that stand for a number."""
    return F.floor(F.col(no) / WORD).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast({no} % {WORD} as int))").alias("bits")


def walk_bits(pairs: DataFrame, starts: DataFrame, gone: DataFrame | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(graph_id, key, word, bits): by which scenarios a unit is reached, a bit for each; rows of a unit and word share no bit.

    ``walk`` for many scenarios that reach much of the same: one row serves up to 64 of them, and only bits that
    are new to a unit are sent on. ``starts``: (graph_id, key, word, bits); ``gone``: (graph_id, from_key, to_key,
    word, gone), pairs closed to the bits ``gone``.
    """
    keys = ["graph_id", "key", "word"]
    level, n = counted(starts.join(known_units(pairs, starts), ["graph_id", "key"], "left_semi").groupBy(*keys).agg(F.bit_or("bits").alias("bits")))
    levels = [level]
    if gone is not None:
        gone, many = counted(gone)
        gone = small(gone, many)
    for _ in range(max_rounds):
        near = small(level.withColumnRenamed("key", "from_key"), n)
        met = pairs.select("graph_id", "from_key", "to_key").join(near, ["graph_id", "from_key"])
        if gone is not None:
            left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("gone", F.lit(0).cast("long"))))
            met = met.join(gone, ["graph_id", "from_key", "to_key", "word"], "left").withColumn("bits", left).where("bits != 0")
        met, m = counted(met.groupBy("graph_id", F.col("to_key").alias("key"), "word").agg(F.bit_or("bits").alias("bits")))
        seen = _union(levels)
        if m <= ranks.SMALL:
            seen = seen.join(F.broadcast(met.select(*keys)), keys, "left_semi")
        none = F.lit(0).cast("long")
        both = met.withColumn("old", none).unionByName(seen.select(*keys, none.alias("bits"), F.col("bits").alias("old")))
        fresh = both.groupBy(*keys).agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old")).select(*keys, F.col("bits").bitwiseAND(F.bitwise_not("old")).alias("bits"))
        level, n = counted(fresh.where("bits != 0"))
        if not n:
            return _union(levels)
        levels = [*levels, level]
        if len(levels) > FOLD:
            levels = [written(_union(levels[:-1])), level]
    raise RuntimeError(f"not finished after {max_rounds} rounds")


def reach_of(pairs: DataFrame, starts: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """(no, reach): how many units each numbered scenario reaches from its ``starts`` (graph_id, no, key); none if unknown.

    ``gone``: (graph_id, no, from_key, to_key), pairs that a scenario may not use.
    """
    word, bits = _bit("no")
    if gone is not None:
        gone = gone.select("graph_id", "from_key", "to_key", word, bits).groupBy("graph_id", "from_key", "to_key", "word").agg(F.bit_or("bits").alias("gone"))
    found = walk_bits(pairs, starts.select("graph_id", "key", word, bits), gone)
    counts = found.groupBy("word").agg(*[F.count_if(F.col("bits").bitwiseAND(F.expr(f"shiftleft(1L, {k})")) != 0).alias(f"b{k}") for k in range(WORD)])
    each = counts.select("word", F.posexplode(F.array(*[f"b{k}" for k in range(WORD)])).alias("k", "reach"))
    return each.where("reach > 0").select((F.col("word") * WORD + F.col("k")).alias("no"), "reach")


def reach_count(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(graph_id, source, reach): how many units each source reaches, itself included; 0 if unknown."""
    s = written(rank_within(sources.select("graph_id", F.col("key").alias("source")).distinct(), [], [F.col("graph_id"), F.col("source")], "no", "long"))
    n = reach_of(pairs, s.select("graph_id", "no", F.col("source").alias("key")))
    return s.join(n, "no", "left").select("graph_id", "source", F.coalesce("reach", F.lit(0).cast("long")).alias("reach"))


def reach_count_without_edge(pairs: DataFrame, roots: DataFrame, removed: DataFrame) -> DataFrame:
    """(graph_id, from_key, to_key, reach): the root's reach if that dependency were gone.

    A pair that the graph does not have changes nothing. All removals run side by side as scenarios.
    """
    gone = removed.select("graph_id", F.concat_ws("\x01", "from_key", "to_key").alias("scenario"), "from_key", "to_key").distinct()
    starts = gone.join(roots.select("graph_id", F.col("root_key").alias("key")), "graph_id").select("graph_id", "scenario", "key")
    n = walk(pairs, starts, gone).groupBy("graph_id", "scenario").agg(F.count(F.lit(1)).alias("reach"))
    return gone.join(n, ["graph_id", "scenario"], "left").select("graph_id", "from_key", "to_key", F.coalesce("reach", F.lit(0).cast("long")).alias("reach"))


def shortest_path_dag(pairs: DataFrame, roots: DataFrame, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Units by breadth-first discovery, and every predecessor one level nearer.

    Returns (graph_id, root_key, key, depth, rank, parent, first_hop), durable, and (graph_id, root_key,
    key, pred_key, pred_rank, depth). ``rank`` is the order of discovery within a level: by the first
    predecessor's rank, then by the order in which that one names its dependencies. ``parent`` is that
    first predecessor and ``first_hop`` the second unit of the chain through the parents; both are null for
    the root. Only the units found are written in a round; predecessors follow from them in one join.
    """
    keys = ["graph_id", "root_key", "key"]
    none = F.lit(None).cast("string")
    start = roots.select("graph_id", F.col("root_key").alias("key")).distinct()
    level = known_units(pairs, start).select("graph_id", F.col("key").alias("root_key"), "key", F.lit(0).alias("depth"), F.lit(1).alias("rank"), none.alias("parent"), none.alias("first_hop"))
    level, n = counted(level)
    levels, found, sizes = [level], [level.select(*keys)], [n]
    for _ in range(max_rounds):
        near = level.select("graph_id", "root_key", F.col("key").alias("from_key"), F.col("rank").alias("pred_rank"), "first_hop", (F.col("depth") + 1).alias("depth"))
        met = pairs.select("graph_id", "from_key", F.col("to_key").alias("key"), "adj_ord").join(small(near, n), ["graph_id", "from_key"])
        best = lambda m: m.groupBy(*keys).agg(F.min(F.struct("pred_rank", "adj_ord", "from_key", "first_hop", "depth")).alias("o"))
        first, n = counted(_fresh(met, _seen(found, sizes, keys), sum(sizes), keys, best))
        if not n:
            units = durable(_union(levels))
            return units, _predecessors(pairs, units, sum(sizes))
        order = [F.col("o.pred_rank"), F.col("o.adj_ord")]
        # A level that has been counted and is small is ranked as it is read.
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id", "root_key").orderBy(*order))) if n <= ranks.SMALL else rank_within(first, ["graph_id", "root_key"], order)
        level = ranked.select(*keys, F.col("o.depth").alias("depth"), "rank", F.col("o.from_key").alias("parent"), F.coalesce("o.first_hop", "key").alias("first_hop"))
        levels, found, sizes = [*levels, level], [*found, first.select(*keys)], [*sizes, n]
        if len(levels) > FOLD:
            level = durable(level)
            levels = [durable(_union(levels[:-1])), level]
            found, sizes = [x.select(*keys) for x in levels], [sum(sizes[:-1]), n]
    raise RuntimeError(f"not finished after {max_rounds} rounds")


def _predecessors(pairs: DataFrame, units: DataFrame, n: int) -> DataFrame:
    near = units.select("graph_id", "root_key", F.col("key").alias("from_key"), F.col("rank").alias("pred_rank"), (F.col("depth") + 1).alias("depth"))
    here = units.select("graph_id", "root_key", "key", "depth")
    met = pairs.select("graph_id", "from_key", F.col("to_key").alias("key")).join(small(near, n), ["graph_id", "from_key"])
    return met.join(small(here, n), ["graph_id", "root_key", "key", "depth"]).select("graph_id", "root_key", "key", F.col("from_key").alias("pred_key"), "pred_rank", "depth")
