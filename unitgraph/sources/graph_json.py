"""Saved graph documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitgraph.functions.names import CERTAINTIES, KINDS, SECTIONS
from unitgraph.operators.build import dedup_edges
from unitgraph.operators.ranks import rank_within
from unitgraph.plans.durable import counted

VERSION = 2
#: Nodes, edges or warnings that one document holds; a larger graph is several.
ROWS = 50_000
ORIGINS = ("project", "package", "library", "rtl")
SCHEMA = """schemaVersion int, part int,
project struct<dproj:string,dpr:string,rootUnit:string,compiler:string,compilerName:string,platform:string,config:string,appType:string,projectVersion:string>,
defines array<string>, searchPaths array<struct<path:string,origin:string>>,
nodes array<struct<name:string,fileName:string,source:string,parsed:boolean,aliases:array<string>>>,
edges array<struct<`from`:string,`to`:string,section:string,certainty:string,condition:string,file:string,line:int>>,
warnings array<struct<file:string,line:int,message:string>>, _corrupt string"""


class GraphFormatError(ValueError):
    """A document that is not a graph of a known version."""


def _one_of(value: Column, known: tuple[str, ...], default: str) -> Column:
    return F.when(F.lower(value).isin(*known), F.lower(value)).otherwise(default)


def read_graph_json(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """graphs, nodes, edges, warnings, search_paths and defines of saved documents.

    A file is a graph, and so is a folder that ``write_graph_json`` wrote, with a document for each part.
    Missing values are empty; unknown kinds are unresolved, sections interface, certainties
    unconditional, origins project, all without case. Edges are made distinct again. A document that is
    broken, has no version, another version or no nodes is refused.
    """
    docs = spark.read.schema(SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(paths)
    path = F.col("_metadata.file_path")
    docs = docs.withColumn("graph_id", F.coalesce(F.nullif(F.regexp_extract(path, "^(.*)/slice=[^/]*/[^/]*$", 1), F.lit("")), path)).withColumn("part", F.coalesce("part", F.lit(0)))
    reason = F.when(F.col("_corrupt").isNotNull(), "not readable as JSON").when(F.col("schemaVersion").isNull(), "no schemaVersion").when(F.col("schemaVersion") != VERSION, "another schemaVersion").when(F.col("nodes").isNull(), "no nodes")
    # Documents are read anew for each table and never stored as rows; here, where all is looked at, each is read whole.
    whole = F.xxhash64("project", *[F.size(c) for c in ("defines", "searchPaths", "nodes", "edges", "warnings")])
    bad = docs.select("graph_id", reason.alias("reason"), whole.alias("whole")).where("reason is not null").limit(1).collect()
    if bad:
        raise GraphFormatError(f"{bad[0]['graph_id']}: {bad[0]['reason']}")
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    p = "project"
    graphs = docs.where("part = 0").select("graph_id", s(f"{p}.rootUnit").alias("root_unit"), s(f"{p}.dproj").alias("dproj"), s(f"{p}.dpr").alias("dpr"), s(f"{p}.compiler").alias("compiler"), s(f"{p}.compilerName").alias("compiler_name"), s(f"{p}.platform").alias("platform"), s(f"{p}.config").alias("config"), F.col(f"{p}.appType").alias("app_type"), F.col(f"{p}.projectVersion").alias("project_version"))
    n = docs.select("graph_id", F.explode("nodes").alias("n")).where("n.name != ''")
    nodes = n.select("graph_id", F.upper("n.name").alias("key"), F.col("n.name").alias("name"), F.col("n.fileName").alias("file_name"), _one_of(F.col("n.source"), KINDS, "unresolved").alias("kind"), F.coalesce("n.parsed", F.lit(False)).alias("parsed"), F.coalesce("n.aliases", F.array().cast("array<string>")).alias("aliases"))
    place = (F.col("part").cast("long") * ROWS + F.col("pos")).alias("seq")
    e = docs.select("graph_id", "part", F.posexplode("edges").alias("pos", "e")).select("graph_id", place, "e")
    raw = e.select("graph_id", "seq", s("e.from").alias("from_unit"), s("e.to").alias("to_unit"), _one_of(F.col("e.section"), SECTIONS, "interface").alias("section"), _one_of(F.col("e.certainty"), CERTAINTIES, "unconditional").alias("certainty"), s("e.condition").alias("cond"), s("e.file").alias("file"), F.coalesce("e.line", F.lit(0)).alias("line"))
    warnings = docs.select("graph_id", "part", F.posexplode("warnings").alias("pos", "w")).select("graph_id", place, s("w.file").alias("file"), F.coalesce("w.line", F.lit(0)).alias("line"), s("w.message").alias("message"))
    paths_ = docs.select("graph_id", F.posexplode("searchPaths").alias("path_pos", "p")).select("graph_id", "path_pos", s("p.path").alias("folder"), _one_of(F.col("p.origin"), ORIGINS, "project").alias("origin"))
    defines = docs.select("graph_id", F.explode("defines").alias("define"))
    return {"graphs": graphs, "nodes": nodes, "edges": dedup_edges(raw), "warnings": warnings, "search_paths": paths_, "defines": defines}


def graph_documents(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, warnings: DataFrame, search_paths: DataFrame, defines: DataFrame, rows: int = ROWS) -> DataFrame:
    """(graph_id, slice, value): JSON documents of at most ``rows`` nodes, edges and warnings each.

    A graph that fits is one document. A larger one is several, each a graph document by itself with the
    whole graph's summary, numbered by ``part``; the first has the defines and search paths. So no row and
    no task ever holds a whole large graph.
    """
    sizes: list[int] = []
    counts: list[DataFrame] = []

    def numbered(df: DataFrame, order: list[str], body: Column, kinds: bool = False) -> DataFrame:
        def keep(dealt: DataFrame) -> DataFrame:
            kept, n = counted(dealt)
            sizes.append(n)
            more = [F.count_if(F.col("_b.source") == "unresolved").alias("_unresolved")] if kinds else []
            counts.append(kept.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"), *more))
            return kept
        slim = df.select("graph_id", *[F.col(c).alias(f"_{c}") for c in order], body.alias("_b"))
        return rank_within(slim, ["graph_id"], [F.col(f"_{c}") for c in order], "_at", "long", keep).select("graph_id", F.floor((F.col("_at") - 1) / rows).cast("int").alias("part"), "_at", "_b")

    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    node = F.struct("name", empty("file_name").alias("fileName"), F.col("kind").alias("source"), "parsed", F.when(F.size("aliases") > 0, F.col("aliases")).alias("aliases"))
    edge = F.struct(F.col("from_unit").alias("from"), F.col("to_unit").alias("to"), "section", "certainty", empty("cond").alias("condition"), "file", "line")
    sliced = {
        "defines": numbered(defines, ["define"], F.col("define")), "searchPaths": numbered(search_paths, ["path_pos"], F.struct(F.col("folder").alias("path"), "origin")),
        "nodes": numbered(nodes, ["key"], node, True), "edges": numbered(edges, ["seq", "to_unit"], edge), "warnings": numbered(warnings, ["seq", "file", "line", "message"], F.struct("file", "line", "message")),
    }
    number = dict(zip(sliced, counts))
    # As many tasks as there are documents: an aggregate or a join then holds a few of them, however large the graphs are.
    n = max(int(graphs.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(sizes) // rows + 1)
    deal = lambda df: df.repartition(n, "graph_id", "part")
    longest = reduce(DataFrame.unionByName, [c.select("graph_id", "_n") for c in counts]).groupBy("graph_id").agg(F.max("_n").alias("_n"))
    last = F.floor((F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1)) - 1) / rows).cast("int")
    spine = graphs.join(longest, "graph_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), last))).drop("_n")
    for name, columns in (("nodes", {"_n": "_units"}), ("edges", {"_n": "_edges"}), ("warnings", {"_n": "_warnings"})):
        spine = spine.join(number[name].withColumnsRenamed(columns), "graph_id", "left")
    out = deal(spine)
    for name, parts in sliced.items():
        listed = deal(parts).groupBy("graph_id", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_b"))), lambda x: x["_b"]).alias(name))
        out = out.join(listed.hint("merge"), ["graph_id", "part"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    head = F.struct("dproj", "dpr", F.col("root_unit").alias("rootUnit"), "compiler", F.col("compiler_name").alias("compilerName"), "platform", "config", F.col("app_type").alias("appType"), F.col("project_version").alias("projectVersion"))
    summary = F.struct(zero("_units").alias("units"), zero("_edges").alias("edges"), zero("_unresolved").alias("unresolved"), zero("_warnings").alias("warnings"))
    none = F.from_json(F.lit("[]"), "array<struct<name:string,fileName:string,source:string,parsed:boolean,aliases:array<string>>>")
    place = F.when(F.col("part") > 0, F.col("part")).alias("part")
    body = F.to_json(F.struct(F.lit(VERSION).alias("schemaVersion"), place, head.alias("project"), "defines", "searchPaths", F.coalesce("nodes", none).alias("nodes"), "edges", "warnings", summary.alias("summary")))
    return out.select("graph_id", F.col("part").alias("slice"), body.alias("value"))


def write_graph_json(documents: DataFrame, path: str, compression: str = "none") -> None:
    """One folder per graph, and in it one for each document, as text, which may be compressed (``gzip``)."""
    documents.write.partitionBy("graph_id", "slice").text(path, compression=compression)
