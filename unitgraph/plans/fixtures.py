"""Graphs derived from the test tables; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "supplier", "part", "lineitem")


def edges_sql(after: bool = False) -> str:
    """Raw edges, of every row of the tables; ``after`` gives the snapshot after some rows have changed.

    The program names four regions, a library that nothing names the fifth. Regions name nations, nations
    their suppliers, suppliers the parts they deliver, and each part but the unresolved (size 50) one unit:
    rings of four parts, a nation now and then, else a part with a smaller key or itself. In the later
    snapshot every line has moved, deliveries of one piece and parts of size 15 name other units, and the
    library has another name.
    """
    line = lambda x: f"cast({x} + 10 as int)" if after else f"cast({x} as int)"
    library = "Later" if after else "Library"
    part = "case when l_quantity = 1 then l_suppkey else l_partkey end" if after else "l_partkey"
    changed = "when p_size = 15 then 'Nation.N' || (p_partkey % 25) " if after else ""
    return f"""
select 'x1' as graph_id, cast(r_regionkey as bigint) as seq, case when r_regionkey < 4 then 'App' else '{library}' end as from_unit, 'Region.R' || r_regionkey as to_unit, case when r_regionkey < 4 then 'program' else 'interface' end as section, 'unconditional' as certainty, '' as cond, case when r_regionkey < 4 then 'App.dpr' else '{library}.pas' end as file, {line("r_regionkey + 1")} as line from region
union all select 'x1', 1000000000000 + n_nationkey, 'Region.R' || n_regionkey, 'Nation.N' || n_nationkey, 'interface', 'unconditional', '', 'Region.R' || n_regionkey || '.pas', {line("n_nationkey + 1")} from nation
union all select 'x1', 2000000000000 + s_suppkey, 'Nation.N' || s_nationkey, 'Supp.S' || s_suppkey, 'interface', 'unconditional', '', 'Nation.N' || s_nationkey || '.pas', {line("s_suppkey + 1")} from supplier
union all select 'x1', 3000000000000 + l_orderkey * 10 + l_linenumber, (case when l_linenumber = 7 then 'SUPP.S' else 'Supp.S' end) || l_suppkey, 'Part.P' || ({part}),
  case when l_returnflag = 'A' then 'interface' else 'implementation' end,
  case when l_linestatus = 'F' then 'unconditional' when l_returnflag = 'N' then 'unevaluated' else 'conditional' end,
  case when l_linestatus = 'F' then '' when l_returnflag = 'N' then 'Declared(X)' else 'MSWINDOWS' end,
  'Supp.S' || l_suppkey || '.pas', {line("l_linenumber")} from lineitem
union all select 'x1', 4000000000000 + p_partkey, 'Part.P' || p_partkey,
  case {changed}when p_partkey % 28 < 4 then 'Part.P' || (p_partkey - p_partkey % 4 + (p_partkey + 1) % 4) when p_partkey % 97 = 0 then 'Nation.N' || (p_partkey % 25) else 'Part.P' || (p_partkey - p_partkey % p_size) end,
  'implementation', 'unconditional', '', 'Part.P' || p_partkey || '.pas', {line("p_size")} from part where p_size <> 50"""


NODES_SQL = """
select 'x1' as graph_id, 'App' as name, 'App.dpr' as file_name, 'program' as kind, true as parsed, '' as alias
union all select 'x1', 'Library', 'Library.pas', 'project', true, ''
union all select 'x1', 'Region.R' || r_regionkey, 'Region.R' || r_regionkey || '.pas', 'rtl', false, '' from region
union all select 'x1', 'Nation.N' || n_nationkey, 'Nation.N' || n_nationkey || '.pas', 'library', true, '' from nation
union all select 'x1', 'Supp.S' || s_suppkey, 'Supp.S' || s_suppkey || '.pas', 'package', true, '' from supplier
union all select 'x1', 'Part.P' || p_partkey, case when p_size = 50 then '' else 'Part.P' || p_partkey || '.pas' end, case when p_size = 50 then 'unresolved' else 'project' end, p_size < 50, replace(p_name, ' ', '.') from part"""

RULES = ((1, False, "Supp.S1*"), (2, False, "*.bolt"), (3, False, "Vcl.*"), (4, False, "Part.P1?"), (5, True, "Supp.S12"), (6, True, "Nation.N2"))
RULES_SQL = " union all ".join(f"select {p} as rule_pos, {str(a).lower()} as allow, '{g}' as pattern, {p} as line" for p, a, g in RULES)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``text`` over the test tables under a folder."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for t, df in frames.items():
        df.createOrReplaceTempView(f"fixture_{t}")
    for t in TABLES:
        text = text.replace(f"from {t}", f"from fixture_{t}")
    return spark.sql(text)


def raw_edges(spark: SparkSession, sf_dir: str, after: bool = False) -> DataFrame:
    return sql(spark, sf_dir, edges_sql(after))


def raw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, NODES_SQL)


def rules(spark: SparkSession) -> DataFrame:
    return spark.sql(RULES_SQL)
