"""Which include files every source file can reach, found by joins, so that each carries only those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitgraph.operators.bfs import walk
from unitgraph.operators.ranks import small
from unitgraph.plans.durable import bucketed, counted

#: Where an include directive starts. What follows is only looked at, so that no directive hides in another's text.
DIRECTIVE = r"(?iu:INCLUDE|I)(?!\p{L})"
BRACED, STARRED = rf"\{{\$(?={DIRECTIVE}([^}}]*))", rf"\(\*\$(?={DIRECTIVE}((?s:.*?))(?:\*\)|\z))"
#: What Python strips from a text.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Parts that the readers of one include file are dealt into.
PARTS = 64


def slashed(path: Column) -> Column:
    """A path as it is compared: in lower case, with forward slashes."""
    return F.lower(F.translate(path, "\\", "/"))


def normal_path(path: Column) -> Column:
    """Without empty, "." and resolvable ".." parts, as ``posixpath.normpath``."""
    lead = F.when(path.rlike("^//(?!/)"), "//").when(path.startswith("/"), "/").otherwise("")
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    last = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when((x != "..") | (last(done) == "..") | ((lead == "") & (F.size(done) == 0)), F.concat(done, F.array(x))).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))),
    )
    out = F.concat(lead, F.array_join(kept, "/"))
    return F.when(out == "", ".").otherwise(out)


def strip(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, rf"\A{chars}|{chars}\z", "")


def include_names(content: Column) -> Column:
    """The names in the include directives of a text, those in dead branches and comments too, each once."""
    bodies = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in (BRACED, STARRED)])
    rests = F.filter(F.transform(bodies, lambda b: strip(b, r"[\x00-\x20]+")), lambda r: (r != "") & ~r.rlike(r"(?s)\A(?:[+-]|%.*%\z)"))
    bare = lambda r: F.when(r.rlike(r"(?s)\A'.*'\z"), F.substring(r, F.lit(2), F.length(r) - 2)).otherwise(r)
    return F.array_distinct(F.transform(rests, lambda r: slashed(strip(bare(r), SPACE))))


def candidates(parent: Column, name: Column, folders: Column) -> Column:
    """The paths tried for an include, in order: beside the file that names it, then in the search folders.

    A name without an extension is tried with ``.inc`` first, a rooted one by itself before all folders.
    """
    beside = F.array(F.regexp_extract(slashed(parent), r"(?s)\A(.*)/", 1))
    looked = F.concat(beside, F.transform(F.coalesce(folders, F.array().cast("array<string>")), lambda f: F.regexp_replace(slashed(f), r"/+\z", "")))
    looked = F.when(name.startswith("/"), F.concat(F.array(F.lit("")), looked)).otherwise(looked)
    names = F.when(F.substring_index(name, "/", -1).contains("."), F.array(name)).otherwise(F.array(F.concat(name, F.lit(".inc")), name))
    return F.flatten(F.transform(names, lambda n: F.transform(looked, lambda f: F.when(f == "", n).otherwise(F.concat(f, F.lit("/"), n)))))


def include_texts(includes: DataFrame) -> DataFrame:
    """(graph_id, at, path, content): each include file by its path as compared; of several, the least path and text."""
    named = includes.where("path is not null").select("graph_id", normal_path(slashed(F.col("path"))).alias("at"), F.struct("path", F.coalesce("content", F.lit("")).alias("content")).alias("f"))
    return named.groupBy("graph_id", "at").agg(F.min("f").alias("f")).select("graph_id", "at", "f.*")


def search_key() -> Column:
    """A graph and its search folders as one value."""
    return F.to_json(F.struct("graph_id", "folders"))


def include_links(files: DataFrame, texts: DataFrame, many: int, searches: DataFrame) -> DataFrame:
    """(graph_id, from_key, to_key): which include file each directive of a file means.

    ``graph_id`` is the graph with its search folders (``search_key``); keys are "f" and the path of a
    source file, "i" and the compared path of an include file. ``many`` is the number of ``texts``. Directives that no file answers have no row.
    """
    sources = files.select("graph_id", F.concat(F.lit("f"), "path").alias("from_key"), F.col("path").alias("parent"), F.explode(include_names(F.col("content"))).alias("name"))
    nested = texts.select("graph_id", F.concat(F.lit("i"), "at").alias("from_key"), F.col("path").alias("parent"), F.explode(include_names(F.col("content"))).alias("name"))
    tried = sources.unionByName(nested).distinct().join(searches.select("graph_id", "folders").distinct(), "graph_id")
    tried = tried.select("graph_id", search_key().alias("search"), "from_key", "name", F.posexplode(candidates(F.col("parent"), F.col("name"), F.col("folders"))).alias("pos", "path"))
    met = tried.withColumn("at", normal_path(F.col("path"))).join(small(texts.select("graph_id", "at"), many), ["graph_id", "at"])
    first = met.groupBy("search", "from_key", "name").agg(F.min_by("at", "pos").alias("at"))
    return first.select(F.col("search").alias("graph_id"), "from_key", F.concat(F.lit("i"), "at").alias("to_key")).distinct()


def reached_includes(files: DataFrame, includes: DataFrame, searches: DataFrame) -> DataFrame:
    """(search, path, own): for each source file the include files that it can reach, path to text.

    ``searches``: (graph_id, folders). A file that reaches none has no row. Names and links are found for
    each file once, levels of includes by ``walk``; the readers of one include file, which may be all files,
    are dealt into PARTS. Directives that are not read (dead branches, comments) count too: a scan takes what
    it needs of these and finds the same file as among all.
    """
    texts, many = counted(include_texts(includes))
    links = bucketed(include_links(files, texts, many, searches), "graph_id", "from_key")
    starts = links.where(F.col("from_key").startswith("f")).select("graph_id", F.col("from_key").alias("scenario"), F.col("from_key").alias("key")).distinct()
    of = F.from_json("graph_id", "graph_id string").getField("graph_id")
    found = walk(links, starts).where("depth > 0").select(F.col("graph_id").alias("search"), of.alias("graph_id"), F.substring("scenario", 2, 2**31 - 1).alias("path"), F.substring("key", 2, 2**31 - 1).alias("at"))
    found = found.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(PARTS)))
    dealt = found.select("graph_id", "at", "part").distinct().join(texts.withColumnRenamed("path", "file"), ["graph_id", "at"])
    return found.join(dealt, ["graph_id", "at", "part"]).groupBy("search", "path").agg(F.map_from_entries(F.collect_list(F.struct("file", "content"))).alias("own"))
