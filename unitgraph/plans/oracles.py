"""DuckDB SQL with the same results as the registered graph queries."""

from __future__ import annotations

from unitgraph.plans.fixtures import NODES_SQL, RULES_SQL, edges_sql
from unitgraph.plans.queries import LISTING_SQL, NAMES_SQL, RULE_LINES_SQL


def _edges(name: str, sql: str) -> str:
    return f"""{name}_keyed as (select *, upper(from_unit) as from_key, upper(to_unit) as to_key from ({sql}) where from_unit <> '' and to_unit <> ''),
{name} as (select graph_id, seq, from_key, to_key, from_unit, to_unit, section, certainty, cond, file, line from {name}_keyed
  qualify row_number() over (partition by graph_id, from_key, to_key, section, certainty, upper(cond) order by seq, to_unit) = 1)"""


BASE = f"""with recursive {_edges('edges', edges_sql())},
pairs as (select graph_id, from_key, to_key, first_seq, row_number() over (partition by graph_id, from_key order by first_seq, to_key) as adj_ord
  from (select graph_id, from_key, to_key, min(seq) as first_seq from edges group by all)),
nodes as (select graph_id, upper(name) as key, name, file_name, kind, parsed, alias from ({NODES_SQL})),
written as (select graph_id, from_key, to_key, section, file, line, certainty, cond from edges qualify row_number() over (partition by graph_id, from_key, to_key order by seq, to_unit) = 1)"""

# Breadth-first levels from App, up to a depth no test graph reaches.
DEPTHS = """, steps(key, d) as (select 'APP', 0 union select p.to_key, s.d + 1 from steps s join pairs p on p.from_key = s.key where s.d < 30),
reach as (select key, min(d) as depth from steps group by key)"""
CLOSURE = ", closure(source, key) as (select distinct from_key, from_key from pairs union select c.source, p.to_key from closure c join pairs p on p.from_key = c.key)"
# A strict dominator lies on every way from App, so on the one of this tree: the least predecessor a level nearer.
TREE = DEPTHS + """, tree as (select r.key, min(p.from_key) as parent from reach r join pairs p on p.to_key = r.key join reach q on q.key = p.from_key and q.depth = r.depth - 1 group by r.key)"""
# What App reaches without each inner unit of the tree in turn; a unit that is then missed has it as a dominator.
DOM = TREE + """, without(gone, key) as (select distinct parent, 'APP' from tree where parent <> 'APP' union select w.gone, p.to_key from without w join pairs p on p.from_key = w.key where p.to_key <> w.gone),
dom as (select r.key, g.gone as dom_key from reach r cross join (select distinct gone from without) g where (g.gone, r.key) not in (select gone, key from without) and r.key <> g.gone union all select key, 'APP' from reach where key <> 'APP' union all select key, key from reach)"""
CHAINS = """, chains(key, depth, chain) as (select {start}, 0, {start} union all select p.to_key, c.depth + 1, c.chain || '>' || p.to_key from chains c join pairs p on p.from_key = c.key join reach r on r.key = p.to_key and r.depth = c.depth + 1)"""
PARTS = "key like 'PART.P1_'"
SHORT = "case section when 'program' then 'prog' when 'interface' then 'intf' else 'impl' end"
GUARD = "case certainty when 'conditional' then cond when 'unevaluated' then 'unevaluated: ' || cond else '' end"
PLACE = "file || '(' || line || ')'"
STEP = SHORT.replace("section", "{0}section", 1) + " || ' ' || {0}file || '(' || {0}line || ')' || case {0}certainty when 'conditional' then ' [' || {0}cond || ']' when 'unevaluated' then ' [unevaluated: ' || {0}cond || ']' else '' end"
SECTION_ORD = "case section when 'program' then 0 when 'interface' then 1 else 2 end"
CERTAINTY_ORD = "case certainty when 'unconditional' then 0 when 'conditional' then 1 else 2 end"


def _glob(pattern: str, value: str) -> str:
    like = f"upper({pattern})"
    for c in "!%_":
        like = f"replace({like}, '{c}', '!{c}')"
    return f"({pattern} <> '' and upper({value}) like replace(replace({like}, '*', '%'), '?', '_') escape '!')"


NAMES = ", any_names as (select key, name as any_name from nodes union all select key, alias from nodes where alias <> '')"
HITS = NAMES + f""", rules as ({RULES_SQL}), hits as (select distinct key, rule_pos, allow, pattern from any_names join rules on {_glob('pattern', 'any_name')}),
open_hits as (select * from hits where not allow and key not in (select key from hits where allow))"""
EDGE_OUT = "from_key, to_key, section, certainty, file, line, seq"
AFTER = f", {_edges('after', edges_sql(True))}"
USED = """, used as (select from_key as key from edges union select to_key from edges), used_after as (select from_key as key from after union select to_key from after)"""
SCANNED = """, supplied as (select * replace (case when certainty = 'conditional' and seq % 4 = 3 then '(DEFINED(MSWINDOWS))' when certainty = 'unevaluated' and seq % 2 = 1 then '(Declared(X))' else cond end as cond), replace(from_unit, 'SUPP', 'Supp') || '.pas' as path from ({raw}) where seq >= 3000000000000 and seq < 4000000000000),
placed as (select path, to_unit, section, certainty, cond, seq, row_number() over (partition by path, section order by seq, to_unit) as i, count(*) filter (section = 'interface') over (partition by path) as ni, count(*) filter (section = 'implementation') over (partition by path) as nm from supplied),
lined as (select path, to_unit, section, certainty, cond, seq, cast(case when section = 'interface' then 3 + i else 6 + ni + i end as int) as line from placed),
fixed as (select distinct path, 'System.Init' as to_unit, 'interface' as section, 'unconditional' as certainty, '' as cond, cast(4 + ni as int) as line from placed
  union all select distinct path, 'System.Fini', 'implementation', 'unconditional', '', cast(7 + ni + nm as int) from placed)""".replace("{raw}", edges_sql())

ORACLES: dict[str, str] = {
    "dedup_edges": f"{BASE} select * from edges",
    "pairs": f"{BASE} select * from pairs",
    "where_written": f"{BASE} select * from written",
    "edges_to": f"{BASE} select {EDGE_OUT} from edges where to_{PARTS.replace('key', 'key', 1)}",
    "edges_from": f"{BASE} select {EDGE_OUT} from edges where from_key = 'NATION.N2'",
    "dependencies": f"{BASE} select from_key, to_key, adj_ord from pairs where from_key like 'SUPP.%'",
    "dependents": f"{BASE} select from_key, to_key, row_number() over (partition by to_key order by first_seq, from_key) as dep_ord from pairs where to_{PARTS}",
    "degrees": f"""{BASE} select n.graph_id, n.key, n.name, coalesce(u.c, 0) as uses, coalesce(b.c, 0) as used_by, coalesce(b.r, 0) as "references" from nodes n
      left join (select from_key, count(distinct to_key) as c from edges group by 1) u on u.from_key = n.key left join (select to_key, count(distinct from_key) as c, count(*) as r from edges group by 1) b on b.to_key = n.key""",
    "references": f"""{BASE}, r as (select n.graph_id, n.key, n.name, e.* exclude (graph_id) from nodes n left join edges e on e.to_key = n.key where n.{PARTS}),
      k as (select *, count(from_key) over (partition by key) as total, row_number() over (partition by key order by from_key nulls first, {SECTION_ORD}, seq) as rank, count(*) over (partition by key) as n from r)
      select graph_id, key, name, total, rank, greatest(0, n - 5) as more, from_unit, case when from_unit is not null then {SHORT} end as section, {PLACE} as "where", case when from_unit is not null then {GUARD} end as guard from k where rank <= 5""",
    "glob_match": f"""{BASE}, p(pattern) as (values ('part.p?'), ('*.P1*'), ('Nation.N2'), ('*'), ('S?PP.s*'), (''), ('P%')) select pattern, key, contains(pattern, '*') or contains(pattern, '?') as is_wildcard from nodes join p on {_glob('pattern', 'name')}""",
    "find_nodes": f"{BASE} select key, name, kind from nodes where {PARTS} or key like '%.BOLT' or upper(alias) like '%.BOLT' or key = 'NATION.N2' or key like 'SUPP.%' or upper(alias) like 'PART.P1_' or upper(alias) like 'SUPP.%'",
    "not_in_graph": "select 'x1' as graph_id, 'Vcl.*' as pattern, 'wildcard' as reason union all select 'x1', 'NoSuch', 'name'",
    "labels": f"""{BASE} select from_key, to_key, seq, {SHORT} as short, {GUARD} as guard, {PLACE} as place, {SHORT} || ' ' || {PLACE} || case when {GUARD} <> '' then ' [' || {GUARD} || ']' else '' end as step from edges""",
    "tri_state": f"""{BASE}, t as (select *, case when certainty <> 'unevaluated' then certainty = 'unconditional' end as t, case when section <> 'program' then section = 'interface' end as i from edges)
      select seq, from_key, to_key, t and i as both, t or i as either, not t as neither from t""",
    "reachable_from": f"{BASE}{DEPTHS} select 'x1' as graph_id, 'APP' as root_key, key, depth from reach",
    "is_reachable": f"{BASE}{DEPTHS} select n.graph_id, n.key, r.key is not null as reachable from nodes n left join reach r using (key)",
    "reach_count": f"""{BASE}, closure(source, key) as (select distinct from_key, from_key from pairs where from_key like 'REGION.%' or from_key like 'NATION.%' union select c.source, p.to_key from closure c join pairs p on p.from_key = c.key)
      select n.graph_id, n.key as source, coalesce(c.n, case when exists (select 1 from pairs where to_key = n.key) then 1 else 0 end) as reach from nodes n left join (select source, count(*) as n from closure group by 1) c on c.source = n.key where n.key like 'REGION.%' or n.key like 'NATION.%'""",
    "reach_count_without_edge": f"""{BASE}, w(gone, key) as (select to_key, 'APP' from pairs where from_key = 'APP' union select w.gone, p.to_key from w join pairs p on p.from_key = w.key where not (p.from_key = 'APP' and p.to_key = w.gone))
      select 'x1' as graph_id, 'APP' as from_key, gone as to_key, count(*) as reach from w group by gone""",
    "shortest_path_dag": f"{BASE}{DEPTHS} select r.key, p.from_key as pred_key, r.depth from reach r join pairs p on p.to_key = r.key join reach q on q.key = p.from_key and q.depth = r.depth - 1",
    "find_paths": f"{BASE}{DEPTHS}{CHAINS.format(start=chr(39) + 'APP' + chr(39))} select key as to_key, chain from chains where {PARTS}",
    "find_paths_first": f"{BASE}{DEPTHS}{CHAINS.format(start=chr(39) + 'APP' + chr(39))} select key as to_key, least(count(*), 2) as chains, max(depth) + 1 as units from chains where key like 'PART.%' group by key",
    "chain_counts": f"{BASE}{DEPTHS}{CHAINS.format(start=chr(39) + 'APP' + chr(39))} select key as to_key, count(*) as total from chains where key like 'PART.%' group by key",
    "why": f"""{BASE}{DEPTHS}{CHAINS.format(start=chr(39) + 'APP' + chr(39))}, hit as (select chain from chains where {PARTS})
      select distinct c.chain as prefix, c.depth, c.key, n.name, case when c.depth > 0 then left(c.chain, length(c.chain) - length(c.key) - 1) end as parent, {STEP.format("w.")} as step, c.{PARTS} as is_target
      from chains c join (select distinct array_to_string(x[1:i], '>') as chain from (select string_split(chain, '>') as x from hit), unnest(range(1, len(x) + 1)) as u(i)) h on h.chain = c.chain join nodes n on n.key = c.key
      left join written w on w.to_key = c.key and w.from_key = string_split(c.chain, '>')[-2]""",
    "why_unreachable": f"{BASE}{DEPTHS} select key, name from nodes where key not in (select key from reach)",
    "path": f"""{BASE}{DEPTHS.replace("'APP'", "'NATION.N2'")}{CHAINS.format(start=chr(39) + 'NATION.N2' + chr(39))}, hit as (select chain from chains where {PARTS})
      select distinct c.chain as prefix, c.depth, c.key, c.{PARTS} as is_target from chains c join (select distinct array_to_string(x[1:i], '>') as chain from (select string_split(chain, '>') as x from hit), unnest(range(1, len(x) + 1)) as u(i)) h on h.chain = c.chain""",
    # The first to name a unit a level down has it; at depth 2 units are opened at depths 0 and 1.
    "deps": f"""{BASE}{DEPTHS.replace("'APP'", "'REGION.R1'")}, named as (select p.*, r.depth, case when r.depth = 0 then 0 else (select q.adj_ord from pairs q where q.from_key = 'REGION.R1' and q.to_key = p.from_key) end as o from reach r join pairs p on p.from_key = r.key where r.depth < 2),
      firsts as (select n.to_key, arg_min(n.from_key, n.o) as f from named n join reach r on r.key = n.to_key and r.depth = n.depth + 1 group by 1),
      x as (select n.*, coalesce(f.f = n.from_key, false) as is_expanded, exists (select 1 from pairs p where p.from_key = n.to_key) as inner_ from named n left join firsts f using (to_key))
      select 'REGION.R1' as root_key, from_key, to_key, depth + 1 as depth, adj_ord, is_expanded, not is_expanded and inner_ as above, is_expanded and inner_ and depth + 1 >= 2 as cut, (select count(*) - 1 from reach) as total, cast(0 as bigint) as more from x""",
    "dominator_sets": f"{BASE}{DOM} select key, dom_key from dom",
    "immediate_dominator": f"""{BASE}{DOM}, lv as (select key, count(*) as n from dom group by key) select r.key, (select arg_max(d.dom_key, l.n) from dom d join lv l on l.key = d.dom_key where d.key = r.key and d.dom_key <> r.key) as idom from reach r""",
    "exclusive_reach": f"{BASE}{DOM}, x as (select dom_key as key, count(*) as n from dom group by 1) select n.key, coalesce(x.n, 0) as exclusive from nodes n left join x using (key)",
    "cost_project": f"""{BASE}{DOM}, x as (select dom_key as key, count(*) as exclusive from dom where dom_key <> 'APP' group by 1), k as (select key, name, kind, exclusive, row_number() over (order by exclusive desc, key) as rank, count(*) over () as n from x join nodes using (key))
      select key, name, kind, exclusive, rank, greatest(0, n - 50) as more from k where rank <= 50""",
    # Only an edge of the tree whose target has no other predecessor as near as itself can cost anything.
    "edge_cost": f"""{BASE}{TREE}, near as (select p.to_key as key, count(*) as n from pairs p join reach q on q.key = p.from_key join reach r on r.key = p.to_key where q.depth <= r.depth and p.from_key <> p.to_key group by 1),
      picked as (select t.parent as a, t.key as b from tree t join near using (key) where near.n = 1),
      w(a, b, key) as (select a, b, 'APP' from picked union select w.a, w.b, p.to_key from w join pairs p on p.from_key = w.key where not (p.from_key = w.a and p.to_key = w.b)),
      c as (select a, b, (select count(*) from reach) - count(*) as n from w group by a, b)
      select p.from_key, p.to_key, coalesce(c.n, 0) as exclusive from pairs p left join c on c.a = p.from_key and c.b = p.to_key""",
    "cost_unit": f"""{BASE}{DEPTHS}, picked as (select from_key as a, to_key as b from pairs where from_key = 'REGION.R1'),
      w(a, b, key) as (select a, b, 'APP' from picked union select w.a, w.b, p.to_key from w join pairs p on p.from_key = w.key where not (p.from_key = w.a and p.to_key = w.b)),
      t(b, key) as (select b, b from picked union select t.b, p.to_key from t join pairs p on p.from_key = t.key)
      select w.a as from_key, w.b as to_key, (select count(*) from reach) - count(*) as exclusive, (select count(*) from t where t.b = w.b) as total, any_value(x.file || '(' || x.line || ')') as "where" from w join written x on x.from_key = w.a and x.to_key = w.b group by w.a, w.b""",
    "reach_count_all": f"""{BASE}, closure(source, key) as (select distinct k, k from (select from_key as k from pairs union select to_key from pairs) union select c.source, p.to_key from closure c join pairs p on p.from_key = c.key) select source as key, count(*) as reach from closure group by 1""",
    "cycle_groups": f"""{BASE}{CLOSURE}, mutual as (select a.source as key, a.key as other from closure a join closure b on a.source = b.key and a.key = b.source), g as (select key, min(other) as component, count(*) as size from mutual group by key)
      select component, size, key from g where size > 1""",
    "round_trip": f"""{BASE}{CLOSURE}, mutual as (select a.source as key, a.key as other from closure a join closure b on a.source = b.key and a.key = b.source), g as (select key, min(other) as component from mutual group by key having count(*) > 1),
      trip(component, key, n) as (select distinct component, component, 1 from g union select t.component, p.to_key, t.n + 1 from trip t join pairs p on p.from_key = t.key join g on g.key = p.to_key and g.component = t.component where t.n < 200 and (t.n = 1 or t.key <> t.component))
      select component, min(n) as units, component as first, component as last from trip where key = component and n > 1 group by component""",
    "cycle_report_first": f"""{BASE}{CLOSURE}, mutual as (select a.source as key, a.key as other from closure a join closure b on a.source = b.key and a.key = b.source), g as (select key, min(other) as component, count(*) as size from mutual group by key having count(*) > 1),
      trip(component, key, n) as (select distinct component, component, 0 from g union select t.component, p.to_key, t.n + 1 from trip t join pairs p on p.from_key = t.key join g on g.key = p.to_key and g.component = t.component where t.n < 200 and (t.n = 0 or t.key <> t.component)),
      r as (select t.component, any_value(g.size) as size, cast(min(t.n) as bigint) as hops from trip t join g on g.key = t.component where t.key = t.component and t.n > 0 group by t.component)
      select component, size, cast(row_number() over (order by size desc, component) as int) as group_no, greatest(0, count(*) over () - 20) as more, hops from r qualify group_no <= 20""",
    "cycle_report": f"""{BASE}{CLOSURE}, mutual as (select a.source as key, a.key as other from closure a join closure b on a.source = b.key and a.key = b.source), g as (select key, min(other) as component, count(*) as size from mutual group by key having count(*) > 1),
      trip(component, key, n) as (select distinct component, component, 0 from g union select t.component, p.to_key, t.n + 1 from trip t join pairs p on p.from_key = t.key join g on g.key = p.to_key and g.component = t.component where t.n < 200 and (t.n = 0 or t.key <> t.component))
      select t.component, any_value(g.size) as size, cast(min(t.n) as bigint) as hops from trip t join g on g.key = t.component where t.key = t.component and t.n > 0 group by t.component""",
    "unresolved": f"""{BASE} select n.key, n.name, e.from_unit, e.certainty, e.line, row_number() over (partition by n.key order by {CERTAINTY_ORD}, e.from_key nulls first, e.line, e.seq) as rank from nodes n left join edges e on e.to_key = n.key where n.kind = 'unresolved'""",
    "unresolved_report": f"""{BASE}, r as (select n.key, n.name, e.from_unit, e.certainty, e.cond, e.file, e.line, row_number() over (partition by n.key order by {CERTAINTY_ORD}, e.from_key, e.line, e.seq) as i, count(e.from_key) over (partition by n.key) as c from nodes n left join edges e on e.to_key = n.key where n.kind = 'unresolved'),
      k as (select *, row_number() over (order by key) as rank, count(*) over () as n from r where i = 1)
      select key, from_unit, {PLACE} as "where", case when certainty is null then '' else {GUARD} end as guard, greatest(0, c - 1) as others, rank, greatest(0, n - 20) as more from k where rank <= 20""",
    "unresolved_count": f"{BASE} select graph_id, count(*) filter (kind = 'unresolved') as unresolved from nodes group by 1",
    "summary": f"""{BASE}, k as (select case kind when 'program' then 'project' else kind end as kind from nodes)
      select case kind when 'project' then 1 when 'package' then 2 when 'library' then 3 when 'rtl' then 4 when 'unresolved' then 5 else 10 end as ord, coalesce(kind, 'total') as label, count(*) as value from k group by rollup (kind)
      union all select 11, 'edges', count(*) from edges union all select 12, 'unresolved units', count(*) from k where kind = 'unresolved' union all select 13, 'warnings', count(*) from edges where certainty = 'unevaluated'""",
    "warning_report": f"""{BASE}, k as (select *, row_number() over (order by seq) as rank, count(*) over () as n from edges where certainty = 'unevaluated')
      select rank, greatest(0, n - 20) as more, {PLACE} || ' cannot evaluate ' || cond as text from k where rank <= 20""",
    "limit_with_more": f"""{BASE}, k as (select *, row_number() over (partition by from_key order by seq, to_key) as rank, count(*) over (partition by from_key) as n from edges) select from_key, to_key, seq, section, rank, greatest(0, n - 3) as more from k where rank <= 3""",
    "violated_by": f"{BASE}{HITS} select key, arg_min(pattern, rule_pos) as pattern from open_hits group by key",
    "excused": f"{BASE}{HITS} select distinct key from hits where allow",
    "check": f"""{BASE}{DEPTHS}{HITS}, b as (select rule_pos, count(*) as n from open_hits join reach using (key) where key <> 'APP' group by 1)
      select r.rule_pos, r.pattern, coalesce(b.n, 0) as broken, b.n is null as passed from rules r left join b using (rule_pos) where not r.allow""",
    "check_broken": f"{BASE}{DEPTHS}{HITS} select h.rule_pos, h.pattern, h.key, n.name from open_hits h join reach using (key) join nodes n using (key) where h.key <> 'APP'",
    "diff_units": f"{BASE}{AFTER}{USED} select key, 'removed' as change from used where key not in (select key from used_after) union all select key, 'added' from used_after where key not in (select key from used)",
    "diff_edges": f"""{BASE}{AFTER}, b as (select from_key, to_key, section, certainty, upper(cond) as c from edges), a as (select from_key, to_key, section, certainty, upper(cond) as c from after)
      select from_key, to_key, section, certainty, 'removed' as change from (from b except from a) union all select from_key, to_key, section, certainty, 'added' from (from a except from b)""",
    "diff_summary": f"""{BASE}{AFTER}{USED}, c as (select (select count(*) from used) as ub, (select count(*) from used_after) as ua, (select count(*) from edges) as eb, (select count(*) from after) as ea)
      select 'x1' as graph_id, ub as units_before, ua as units_after, ua - ub as units_change, eb as edges_before, ea as edges_after, ea - eb as edges_change, false as is_empty from c""",
    "build_nodes": f"""{BASE}, ends as (select from_key as key, from_unit as name, seq * 2 as s from edges union all select to_key, to_unit, seq * 2 + 1 from edges union all select 'APP', 'App', -1),
      f as (select key, arg_min(name, (s, name)) as name from ends group by key)
      select f.key, f.name, case when n.kind = 'unresolved' then null else n.file_name end as file_name, case when f.key = 'APP' then 'program' else n.kind end as kind, n.parsed from f join nodes n using (key)""",
    "collect_aliases": f"{BASE} select key, alias as aliases from nodes where alias <> '' and upper(alias) <> key",
    "canonical_names": f"{BASE} select e.seq, f.name as from_unit, t.name as to_unit, e.section, e.certainty from edges e join nodes f on f.key = e.from_key join nodes t on t.key = e.to_key",
    "effective_defines": "select cast(s_suppkey as varchar) as graph_id, array_to_string(list_sort(list_filter(list_distinct(['MSWINDOWS', 'X' || s_suppkey, 'Y' || s_nationkey]), lambda x: x <> 'Y1')), ';') as defines from supplier",
    "order_search_paths": """with p as (select s_suppkey as pos, (case when s_suppkey % 2 = 0 then 'F' else 'f' end) || (s_suppkey % 7) || (case when s_suppkey % 3 = 0 then '/.dpm' else '' end) as folder from supplier),
      f as (select * from p qualify row_number() over (partition by lower(folder) order by pos) = 1)
      select 'x1' as graph_id, cast(row_number() over (order by pos) - 1 as int) as path_pos, folder, case when contains(folder, '.dpm') then 'package' else 'project' end as origin from f""",
    "order_namespaces": "select cast(s_suppkey as varchar) as graph_id, unnest([0, 1, 2]) as ns_pos, unnest(['System', 'Vcl', 'N' || s_nationkey]) as prefix from supplier",
    "expand_candidates": f"with u as (select distinct unit_name from ({NAMES_SQL})) select unit_name, unit_name as candidate, 0 as cand_pos from u union all select unit_name, 'Part.' || unit_name, 1 from u union all select unit_name, 'Supp.' || unit_name, 2 from u",
    "resolve_units": f"""with u as ({NAMES_SQL}), l as ({LISTING_SQL}), sp(folder, path_pos, origin) as (values ('f1', 0, 'project'), ('f0', 1, 'package'), ('f2', 2, 'library'), ('f3', 3, 'rtl')),
      c as (select *, unit_name as cand, 0 as cp from u union all select *, 'Part.' || unit_name, 1 from u union all select *, 'Supp.' || unit_name, 2 from u),
      h as (select c.unit_name, c.folder, c.cand, c.cp, l.folder as lf, l.file_name, case when l.file_name like '%.dcu' then 1 else 0 end as dcu from c join l on lower(l.file_name) in (lower(c.cand || '.pas'), lower(c.cand || '.dcu'))),
      x as (select unit_name, folder, 'Part.P' || k as cand, 0 as ex, 1 as dcu, -1 as pp, 0 as cp, 'f' || (k % 4) as lf, 'Part.P' || k || '.dcu' as file_name, 'project' as origin from (select *, cast(replace(unit_name, 'Part.P', '') as bigint) as k from u where unit_name like 'Part.P%') where k % 11 = 1 and exists (select 1 from l where l.file_name = 'Part.P' || k || '.dcu')),
      every as (select unit_name, folder, cand, 1 as ex, dcu, -1 as pp, cp, lf, file_name, 'project' as origin from h where lf = folder union all select h.unit_name, h.folder, h.cand, 1, h.dcu, sp.path_pos, h.cp, h.lf, h.file_name, sp.origin from h join sp on sp.folder = h.lf union all from x),
      best as (select * from every qualify row_number() over (partition by unit_name, folder order by ex, dcu, pp, cp, lf, file_name) = 1)
      select u.unit_name, u.folder, b.cand as resolved_name, b.lf || '/' || b.file_name as file, b.origin, b.dcu = 0 as is_source from u left join best b on b.unit_name = u.unit_name and b.folder = u.folder""",
    "walk_program": f"""{BASE}, opened as (select key from nodes where parsed and kind <> 'rtl' union select key from nodes where key like 'REGION.%' union select 'APP'), usable as (select * from edges where from_key in (select key from opened)),
      r(key) as (select 'APP' union select u.to_key from r join usable u on u.from_key = r.key) select from_key, to_key, section, certainty, seq from usable where from_key in (select key from r)""",
    "read_corpus": f"""{BASE}{SCANNED}, text(path, line, t) as (select path, line, '  ' || case certainty when 'unconditional' then to_unit || ',' when 'conditional' then '{{$IFDEF MSWINDOWS}} ' || to_unit || ', {{$ENDIF}}' else '{{$IF Declared(X)}} ' || to_unit || ', {{$IFEND}}' end from lined
      union all select path, line, '  ' || to_unit || ';' from fixed union all select distinct path, unnest([1, 2, 3, 5 + ni, 6 + ni, 8 + ni + nm]), unnest(['unit ' || replace(path, '.pas', '') || ';', 'interface', 'uses', 'implementation', 'uses', 'end.']) from placed),
      f as (select path, string_agg(t, chr(10) order by line) || chr(10) as content from text group by 1) select path, '.txt' as ext, length(content) as chars, sha256(content) as sha256 from f""",
    "read_rules": f"with l as ({RULE_LINES_SQL}) select cast(row_number() over (order by k) as int) as rule_pos, value like '!%' as allow, ltrim(split_part(value, ' ', 1), '!') as pattern, cast(row_number() over (order by k) as int) as line from l",
    "combine_rules": """with l as (select cast(s_suppkey + 1 as int) as rule_pos, s_suppkey % 3 = 0 as allow, s_name as pattern, cast(s_suppkey + 1 as int) as line from supplier)
      select * from l union all select (select max(rule_pos) from l) + p, a, g, 0 from (values (1, false, 'Vcl.*'), (2, false, 'Fmx.*'), (3, true, 'Supp.S1'), (4, true, 'Part.P1')) as v(p, a, g)""",
    "forbid_count": "select count(*) filter (s_suppkey % 3 <> 0) as forbids from supplier",
    "walk_program_deep": f"""{BASE}, opened as (select key, kind <> 'rtl' as flat from nodes where file_name like '%.pas' and kind <> 'unresolved' union select 'APP', true),
      usable as (select e.*, o.flat from edges e join opened o on o.key = e.from_key),
      r(key, deep) as (select 'APP', d from (values (true), (false)) as v(d) union select u.to_key, r.deep from r join usable u on u.from_key = r.key where r.deep or u.flat)
      select from_key, to_key, section, certainty, seq, r.deep from usable u join r on r.key = u.from_key where r.deep or u.flat""",
    "extract_uses": f"{BASE}{SCANNED} select path, to_unit as unit_name, section, certainty, cond, line from lined union all select path, to_unit, section, certainty, cond, line from fixed",
    "extract_uses_without": f"{BASE}{SCANNED} select path, to_unit as unit_name, section, certainty, line from lined where certainty <> 'conditional' union all select path, to_unit, section, certainty, line from fixed union all select path, 'No', section, 'conditional', line from lined where certainty = 'conditional' and seq % 4 = 3",
    "scan_warnings": f"{BASE}{SCANNED} select path, line, 'cannot evaluate {{$IF ' || cond || '}}, taking every branch' as message from lined where certainty = 'unevaluated'",
    "extract_uses_included": """with f as (select 'parts/Part.P' || p_partkey || '.pas' as path, p_size as s, p_size - p_size % 10 as t from part)
      select path, 'Size' || s as unit_name, 'interface' as section, 'unconditional' as certainty, '' as cond, 'Inc/Size' || s || '.inc' as file, 1 as line from f
      union all select path, 'Tens' || t, 'interface', 'conditional', 'TENS', 'tens/T' || t || '.inc', 2 from f union all select path, 'System.Init', 'interface', 'unconditional', '', path, 5 from f""",
    "included_files": """select 'parts/Part.P' || p_partkey || '.pas' as path, 'Inc/Size' || p_size || '.inc;tens/T' || (p_size - p_size % 10) || '.inc' as included, 1 as warnings,
      'include cycle detected at "Size' || p_size || '"' as message from part""",
    "graph_json_nodes": f"{BASE} select key, name, nullif(file_name, '') as file_name, kind, parsed, alias as aliases from nodes",
    "graph_json_warnings": f"{BASE} select row_number() over (order by seq, file, line) - 1 as seq, file, line, 'cannot evaluate ' || cond as message from edges where certainty = 'unevaluated'",
    "graph_json_round_trip": f"{BASE} select from_key, to_key, from_unit, to_unit, section, certainty, cond, file, line from edges",
}
ORACLES["diff_edges_stored"] = ORACLES["diff_edges"]
