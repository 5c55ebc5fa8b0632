"""From used names to files, and from files to the graph a program reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitgraph.operators.bfs import reachable_from
from unitgraph.operators.build import pairs
from unitgraph.plans.durable import durable


def effective_defines(targets: DataFrame) -> DataFrame:
    """``targets`` (graph_id, base, project, extra, removed: arrays) with ``defines``.

    Upper-cased, distinct, sorted, without empty names; numeric symbols are kept elsewhere.
    """
    up = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    every = F.array_union(F.array_union(up(F.col("base")), up(F.col("project"))), up(F.col("extra")))
    return targets.withColumn("defines", F.array_sort(F.array_except(every, up(F.col("removed")))))


def order_search_paths(paths: DataFrame) -> DataFrame:
    """Trimmed folders in order; a repeated one (without case) keeps its first place and origin.

    ``paths``: (graph_id, path_pos, folder, origin). Folders of a package cache have origin package.
    """
    p = paths.withColumn("folder", F.trim("folder")).where("folder != ''")
    low = F.lower("folder")
    p = p.withColumn("origin", F.when(low.contains("package_cache") | low.contains(".dpm"), "package").otherwise(F.col("origin")))
    first = p.groupBy("graph_id", low.alias("_low")).agg(F.min(F.struct("path_pos", "folder", "origin")).alias("f"))
    w = Window.partitionBy("graph_id").orderBy("f.path_pos")
    return first.select("graph_id", (F.row_number().over(w) - 1).alias("path_pos"), "f.folder", "f.origin")


def order_namespaces(texts: DataFrame) -> DataFrame:
    """(graph_id, ns_pos, prefix) from a ``;`` list of scopes; exact repeats go."""
    split = texts.select("graph_id", F.posexplode(F.split("namespaces", ";")).alias("p", "prefix")).withColumn("prefix", F.trim("prefix")).where("prefix != ''")
    first = split.groupBy("graph_id", "prefix").agg(F.min("p").alias("p"))
    return first.select("graph_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("p")) - 1).alias("ns_pos"), "prefix")


def expand_candidates(uses: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(graph_id, unit_name, candidate, cand_pos): each name as written, then under every scope in order."""
    names = uses.select("graph_id", "unit_name").distinct()
    scoped = names.join(namespaces, "graph_id").select("graph_id", "unit_name", F.concat("prefix", F.lit("."), "unit_name").alias("candidate"), (F.col("ns_pos") + 1).alias("cand_pos"))
    every = names.select("graph_id", "unit_name", F.col("unit_name").alias("candidate"), F.lit(0).alias("cand_pos")).unionByName(scoped)
    return every.groupBy("graph_id", "unit_name", "candidate").agg(F.min("cand_pos").alias("cand_pos"))


def resolve_units(uses: DataFrame, namespaces: DataFrame, search_paths: DataFrame, explicit_units: DataFrame, listing: DataFrame) -> DataFrame:
    """The file each used name stands for, per name and folder that uses it; misses are kept, with nulls.

    ``uses``: (graph_id, unit_name, folder); ``listing``: (folder, file_name); ``explicit_units``:
    (graph_id, unit_name, file). First a registered path that exists; then sources before compiled
    units; in either, the using folder before the search paths in order; in a folder, candidates in
    order. Names are made distinct first, since a popular one is used almost everywhere, and meet the
    listing by file name alone, never by folder.
    """
    asked = uses.select("graph_id", "unit_name", "folder").distinct()
    files = listing.select(F.lower("file_name").alias("file"), F.lower("folder").alias("in_folder"), F.col("folder").alias("found_folder"), "file_name")
    cand = expand_candidates(uses, namespaces)
    both = cand.select("*", F.explode(F.array(F.lit(".pas"), F.lit(".dcu"))).alias("ext"))
    hits = both.withColumn("file", F.lower(F.concat("candidate", "ext"))).join(files, "file")
    own = asked.join(hits, ["graph_id", "unit_name"]).where(F.lower("folder") == F.col("in_folder")).select("graph_id", "unit_name", "folder", "candidate", "cand_pos", "ext", "found_folder", "file_name", F.lit(-1).alias("path_pos"), F.lit("project").alias("origin"))
    sp = search_paths.select("graph_id", F.lower("folder").alias("in_folder"), "path_pos", "origin")
    by_path = hits.join(sp, ["graph_id", "in_folder"])
    # A name's best hit on the search paths does not depend on who uses it.
    best_path = by_path.groupBy("graph_id", "unit_name").agg(F.min(_rank("candidate")).alias("best"))
    path_hits = asked.join(best_path, ["graph_id", "unit_name"]).select("graph_id", "unit_name", "folder", "best")
    own_hits = own.groupBy("graph_id", "unit_name", "folder").agg(F.min(_rank("candidate")).alias("best"))
    full = listing.select(F.lower(F.concat_ws("/", "folder", "file_name")).alias("path"), "folder", "file_name")
    given = explicit_units.withColumn("path", F.lower("file")).join(full, "path").select("graph_id", F.upper("unit_name").alias("_key"), F.col("unit_name").alias("candidate"), F.lit(0).alias("cand_pos"), F.when(F.col("path").endswith(".pas"), ".pas").otherwise(".dcu").alias("ext"), F.col("folder").alias("found_folder"), "file_name", F.lit(-1).alias("path_pos"), F.lit("project").alias("origin"))
    given = given.groupBy("graph_id", "_key").agg(F.min(_rank("candidate", explicit=True)).alias("best"))
    explicit = asked.withColumn("_key", F.upper("unit_name")).join(given, ["graph_id", "_key"]).select("graph_id", "unit_name", "folder", "best")
    best = explicit.unionByName(own_hits).unionByName(path_hits).groupBy("graph_id", "unit_name", "folder").agg(F.min("best").alias("b"))
    out = asked.join(best, ["graph_id", "unit_name", "folder"], "left")
    return out.select("graph_id", "unit_name", "folder", F.col("b.candidate").alias("resolved_name"), F.concat_ws("/", "b.found_folder", "b.file_name").alias("file"), F.col("b.origin").alias("origin"), (F.col("b.is_dcu") == 0).alias("is_source"))


def _rank(name: str, explicit: bool = False) -> Column:
    return F.struct(F.lit(0 if explicit else 1).alias("by"), (F.col("ext") == ".dcu").cast("int").alias("is_dcu"), "path_pos", "cand_pos", "found_folder", "file_name", F.col(name).alias("candidate"), "origin")


def openable(resolved: DataFrame, deep: bool = False) -> Column:
    """Targets that are opened: sources, and runtime-library ones only if ``deep``."""
    source = F.col("is_source") & F.col("file").endswith(".pas")
    return source if deep else source & (F.col("origin") != "rtl")


def walk_program(roots: DataFrame, edges: DataFrame, opened: DataFrame) -> DataFrame:
    """The edges a program reaches: those written in units it gets to through opened units.

    ``opened``: (graph_id, key). Scanning everything first and walking then gives what walking first
    would, as a scan depends on the file and the target's symbols alone.
    """
    openers = opened.select("graph_id", F.col("key").alias("from_key")).unionByName(roots.select("graph_id", F.col("root_key").alias("from_key"))).distinct()
    usable = edges.join(openers, ["graph_id", "from_key"], "left_semi")
    reach = reachable_from(durable(pairs(usable)), roots).select("graph_id", F.col("key").alias("from_key")).distinct()
    return usable.join(reach, ["graph_id", "from_key"], "left_semi")
