"""Tiny graphs with known answers."""

import itertools
import random
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from unitgraph.operators import adjacency, bfs, build, cycles, diff, dominators, match, paths, reports, rules
from unitgraph.plans import queries
from unitgraph.plans.durable import durable

RAW = "graph_id string, seq long, from_unit string, to_unit string, section string, certainty string, cond string, file string, line int"
NODES = "graph_id string, name string, file_name string, kind string, parsed boolean, alias string"


def graph(spark, text, graph_id="g"):
    """Edges from ``A>B|A>C``."""
    rows = [(graph_id, i, *e.split(">"), "interface", "unconditional", "", f"{e.split('>')[0]}.pas", i + 1) for i, e in enumerate(text.split("|"))]
    return build.dedup_edges(spark.createDataFrame(rows, RAW))


def pairs_of(spark, text):
    return durable(build.pairs(graph(spark, text)))


def root(spark, name="MyApp"):
    return spark.createDataFrame([("g", name.upper())], "graph_id string, root_key string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def chains(spark, text, start, target, k=5):
    t = spark.createDataFrame([("g", target.upper())], "graph_id string, key string")
    out = paths.find_paths(pairs_of(spark, text), root(spark, start), t, k).collect()
    return [">".join(r["chain"]) for r in sorted(out, key=lambda r: r["chain_no"])]


def test_casing_and_dedup(spark):
    e = spark.createDataFrame([("g", 1, "MyApp", "Winapi.Windows", "interface", "unconditional", "", "a", 3), ("g", 2, "MyApp", "WinAPi.WINDOWS", "implementation", "unconditional", "", "a", 9), ("g", 3, "myapp", "winapi.windows", "interface", "unconditional", "", "b", 40), ("g", 4, "", "X", "interface", "unconditional", "", "", 1)], RAW)
    d = build.dedup_edges(e)
    assert rows(d, "seq", "line") == [(1, 3), (2, 9)]
    assert build.pairs(d).count() == 1
    assert rows(build.where_written(d), "section", "line") == [("interface", 3)]


@pytest.mark.parametrize("edges,start,target,k,expected", [
    ("MyApp>Short|MyApp>Long1|Long1>Long2|Short>T|Long2>T", "MyApp", "T", 5, ["MYAPP>SHORT>T"]),
    ("MyApp>Left|MyApp>Right|Left>Shared|Right>Shared", "MyApp", "Shared", 5, ["MYAPP>LEFT>SHARED", "MYAPP>RIGHT>SHARED"]),
    ("MyApp>A|MyApp>B|MyApp>C|A>T|B>T|C>T", "MyApp", "T", 2, ["MYAPP>A>T", "MYAPP>B>T"]),
    ("MyApp>A", "MyApp", "MyApp", 5, ["MYAPP"]),
    ("MyApp>A", "MyApp", "A", 0, []),
    ("MyApp>A", "Nope", "A", 5, []),
])
def test_chains(spark, edges, start, target, k, expected):
    assert chains(spark, edges, start, target, k) == expected


def test_dominators(spark):
    p = pairs_of(spark, "MyApp>Left|MyApp>Right|Left>Shared|Right>Shared|Left>Only")
    assert rows(dominators.immediate_dominator(p, root(spark)).na.fill("-"), "key", "idom") == [("LEFT", "MYAPP"), ("MYAPP", "-"), ("ONLY", "LEFT"), ("RIGHT", "MYAPP"), ("SHARED", "MYAPP")]
    assert rows(dominators.exclusive_reach(p, root(spark)), "key", "exclusive") == [("LEFT", 2), ("MYAPP", 5), ("ONLY", 1), ("RIGHT", 1), ("SHARED", 1)]


def test_edge_removal(spark):
    p = pairs_of(spark, "MyApp>Middle|Middle>Inner|MyApp>Other")
    gone = spark.createDataFrame([("g", "MYAPP", "MIDDLE"), ("g", "X", "Y")], "graph_id string, from_key string, to_key string")
    assert rows(bfs.reach_count_without_edge(p, root(spark), gone), "to_key", "reach") == [("MIDDLE", 2), ("Y", 4)]


def test_cycles(spark):
    p = pairs_of(spark, "UnitA>UnitB|UnitB>UnitA|UnitC>UnitD|UnitD>UnitE|UnitE>UnitC|UnitE>UnitA|S>S")
    g = durable(cycles.cycles(p))
    assert rows(g, "component", "size", "key") == [("UNITA", 2, "UNITA"), ("UNITA", 2, "UNITB"), ("UNITC", 3, "UNITC"), ("UNITC", 3, "UNITD"), ("UNITC", 3, "UNITE")]
    assert [r["chain"] for r in cycles.round_trip(p, g).orderBy("component").collect()] == [["UNITA", "UNITB", "UNITA"], ["UNITC", "UNITD", "UNITE", "UNITC"]]


def test_short_way_round(spark):
    p = pairs_of(spark, "A>B|B>C|C>A|A>D|D>A")
    assert cycles.round_trip(p, durable(cycles.cycles(p))).first()["chain"] == ["A", "D", "A"]


def test_unresolved_order(spark):
    e = spark.createDataFrame([("g", 1, "Alpha", "Missing", "interface", "unevaluated", "", "a", 10), ("g", 2, "Beta", "Missing", "interface", "conditional", "", "b", 20), ("g", 3, "Gamma", "Missing", "interface", "unconditional", "", "c", 30)], RAW)
    n = build.nodes_from_aliases(spark.createDataFrame([("g", "Missing", "", "unresolved", False, ""), ("g", "Lonely", "", "unresolved", False, "")], NODES))
    out = reports.unresolved(n, build.dedup_edges(e)).where("key = 'MISSING'").orderBy("rank")
    assert [r["from_unit"] for r in out.collect()] == ["Gamma", "Beta", "Alpha"]
    assert reports.unresolved(n, build.dedup_edges(e)).where("key = 'LONELY'").count() == 1


def test_diff_ignores_lines(spark):
    a, b = graph(spark, "A>B|B>C"), graph(spark, "B>C|A>B")
    assert diff.diff_edges(a, b).count() == 0
    assert rows(diff.diff_edges(graph(spark, "A>B|B>C"), graph(spark, "A>B|B>D")), "to_key", "change") == [("C", "removed"), ("D", "added")]


def test_match_prefers_exact_name(spark):
    n = build.nodes_from_aliases(spark.createDataFrame([("g", "Forms", "", "project", True, ""), ("g", "Vcl.Forms", "", "rtl", True, "Forms"), ("g", "Vcl.Grids", "", "rtl", True, "")], NODES))
    find = lambda *p: rows(match.find_nodes(n, match.patterns(spark, *p)), "key")
    assert find("forms") == [("FORMS",)]
    assert find("f?rms") == [("FORMS",), ("VCL.FORMS",)]
    assert find(" ") == []
    assert rows(match.not_in_graph(n, match.patterns(spark, "X*", "y", "Forms")), "pattern", "reason") == [("X*", "wildcard"), ("y", "name")]


def test_check_keeps_passing_rules(spark):
    e = graph(spark, "MyApp>Mid|Mid>Vcl.A|MyApp>Bad.B")
    n = build.nodes_from_aliases(spark.createDataFrame([("g", x, "", "project", True, "") for x in ("MyApp", "Mid", "Vcl.A", "Bad.B", "Bad.Far")], NODES))
    r = spark.createDataFrame([(1, False, "Vcl.*", 1), (2, False, "Bad.*", 2), (3, False, "Zip*", 3), (4, True, "Bad.B", 4)], "rule_pos int, allow boolean, pattern string, line int")
    verdict, detail = rules.check(n, e, durable(build.pairs(e)), root(spark), r)
    assert rows(verdict, "pattern", "broken", "passed") == [("Bad.*", 0, True), ("Vcl.*", 1, False), ("Zip*", 0, True)]
    assert rows(detail, "name", "via", "where") == [("Vcl.A", "Mid", "MyApp.pas(1)")]


def test_references_keep_unused(spark):
    e = graph(spark, "A>B|C>B")
    n = build.nodes_from_aliases(spark.createDataFrame([("g", x, "", "project", True, "") for x in "ABC"], NODES))
    out = adjacency.references(n, e, match.patterns(spark, "*"), 1)
    assert rows(out.na.fill("-"), "name", "total", "from_unit", "more") == [("A", 0, "-", 0), ("B", 2, "A", 1), ("C", 0, "-", 0)]


def test_random_graphs(spark):
    """Edge costs against removal, groups against mutual reach, on a few random graphs at once."""
    rng = random.Random(7)
    text = [(f"g{g}", f"N{rng.randrange(9)}", f"N{rng.randrange(9)}") for g in range(12) for _ in range(14)]
    df = spark.createDataFrame([(g, i, a, b, "interface", "unconditional", "", "", 1) for i, (g, a, b) in enumerate(text)], RAW)
    p = durable(build.pairs(build.dedup_edges(df)))
    roots = spark.createDataFrame([(f"g{g}", "N0") for g in range(12)], "graph_id string, root_key string")
    adj = {}
    for g, a, b in text:
        adj.setdefault(g, set()).add((a, b))

    def reach(edges, start):
        if not any(start in e for e in edges):
            return set()
        seen, todo = {start}, [start]
        while todo:
            u = todo.pop()
            for a, b in edges:
                if a == u and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    cost = {(r["graph_id"], r["from_key"], r["to_key"]): r["exclusive"] for r in dominators.edge_cost(p, roots).collect()}
    for g, edges in adj.items():
        for e in edges:
            assert cost[(g, *e)] == len(reach(edges, "N0")) - (len(reach(edges - {e}, "N0")) or (1 if reach(edges, "N0") else 0)), (g, e)
    groups = {(r["graph_id"], r["key"]): r["component"] for r in cycles.cycles(p).collect()}
    for g, edges in adj.items():
        names = {x for e in edges for x in e}
        for u in names:
            same = {v for v in names if v in reach(edges, u) and u in reach(edges, v)}
            assert groups.get((g, u)) == (min(same) if len(same) > 1 else None)


def test_registered_costs_and_trips_are_whole(spark):
    """All pairs against edge removal; each hop an edge, each trip as short as any."""
    from unitgraph.plans import queries

    run, at = queries.queries(), "/root/testdata/sf0.001"
    edges = {(r["from_key"], r["to_key"], r["section"], r["file"], r["line"]) for r in run["where_written"](spark, at).collect()}
    out = {}
    for a, b, *_ in edges:
        out.setdefault(a, set()).add(b)

    def reach(start, gone=None):
        depth, todo = {start: 0}, [start]
        for u in todo:
            for v in out.get(u, ()):
                if v not in depth and (u, v) != gone:
                    depth[v] = depth[u] + 1
                    todo.append(v)
        return depth

    every = len(reach("APP"))
    assert rows(run["edge_cost"](spark, at), "from_key", "to_key", "exclusive") == sorted((a, b, every - len(reach("APP", (a, b)))) for a, b, *_ in edges)
    trips = {r["component"]: r["chain"].split(">") for r in run["round_trip_chain"](spark, at).collect()}
    far = {u: reach(u) for u in out}
    mutual = {u: [v for v in far[u] if v in far and u in far[v]] for u in out}
    assert set(trips) == {u for u, vs in mutual.items() if len(vs) > 1 and u == min(vs)}
    hops = {}
    for r in run["cycle_report_hops"](spark, at).collect():
        hops.setdefault(r["component"], {})[r["hop"]] = r
    for c, chain in trips.items():
        assert chain[0] == chain[-1] == c and len(chain) - 1 == 1 + min(far[c][u] for u in mutual[c] if u != c and c in out[u])
        assert sorted(hops[c]) == list(range(len(chain) - 1))
        for i, r in hops[c].items():
            section = {"prog": "program", "intf": "interface", "impl": "implementation"}[r["section"]]
            assert any((a, b, s, f"{f}({n})") == (chain[i], chain[i + 1], section, r["where"]) for a, b, s, f, n in edges)
            assert (r["from_unit"].upper(), r["to_unit"].upper(), r["size"]) == (chain[i], chain[i + 1], len(mutual[c]))
    assert trips


def test_discovery_chains_and_dominators_of_many_graphs(spark, monkeypatch):
    """Ranks, parents, first hops, chains in their order and dominator sets of random graphs, by searching each one by hand."""
    from unitgraph.operators import ranks

    rng = random.Random(11)
    text = [(f"g{g}", f"N{rng.randrange(8)}", f"N{rng.randrange(8)}") for g in range(10) for _ in range(13)]
    df = spark.createDataFrame([(g, i, a, b, "interface", "unconditional", "", "", 1) for i, (g, a, b) in enumerate(text)], RAW)
    p = durable(build.pairs(build.dedup_edges(df)))
    roots = spark.createDataFrame([(f"g{g}", "N0") for g in range(10)], "graph_id string, root_key string")
    out = {}
    for g, a, b in text:
        out.setdefault(g, {}).setdefault(a, [])
        if b not in out[g][a]:
            out[g][a].append(b)
    units, chains, doms = set(), set(), set()
    for g, adj in out.items():
        if not any("N0" in (a, *bs) for a, bs in adj.items()):
            continue
        depth, order, parent, hop, preds = {"N0": 0}, ["N0"], {"N0": None}, {"N0": None}, {}
        for u in order:
            for v in adj.get(u, []):
                if v not in depth:
                    depth[v], parent[v], hop[v] = depth[u] + 1, u, hop[u] or v
                    order.append(v)
                if depth[v] == depth[u] + 1:
                    preds.setdefault(v, []).append(u)
        place = {d: [u for u in order if depth[u] == d] for d in set(depth.values())}
        units |= {(g, u, depth[u], place[depth[u]].index(u) + 1, parent[u], hop[u]) for u in order}
        first = {"N0": ["N0"]}
        for u in order[1:]:
            first[u] = [f"{c}>{u}" for w in preds[u] for c in first[w]][:2]
        chains |= {(g, u, i + 1, c) for u in order for i, c in enumerate(first[u])}
        for gone in order:
            seen, todo = set(), ["N0"] if gone != "N0" else []
            while todo:
                u = todo.pop()
                if u not in seen and u != gone:
                    seen.add(u)
                    todo += adj.get(u, [])
            doms |= {(g, u, gone) for u in order if u not in seen}
    targets = p.select("graph_id", F.col("to_key").alias("key")).unionByName(roots.select("graph_id", F.col("root_key").alias("key")))
    for most in (ranks.SMALL, 0):  # and once with nothing small enough to be broadcast or ranked in one task
        monkeypatch.setattr(ranks, "SMALL", most)
        found = bfs.shortest_path_dag(p, roots)[0].collect()
        assert {(r["graph_id"], r["key"], r["depth"], r["rank"], r["parent"], r["first_hop"]) for r in found} == units
    assert {(r["graph_id"], r["to_key"], r["chain_no"], ">".join(r["chain"])) for r in paths.find_paths(p, roots, targets, 2).collect()} == chains
    assert {(r["graph_id"], r["key"], r["dom_key"]) for r in dominators.dominators(p, roots).collect()} == doms


def test_diff_in_one_shuffle(spark):
    """Edges that are not yet distinct differ as the distinct ones do, after a single shuffle; the summary counts what differs."""
    row = lambda seq, a, b, cond="", line=1: ("g", seq, a, b, "interface", "conditional" if cond else "unconditional", cond, "f", line)
    raw = [spark.createDataFrame(r, RAW) for r in ([row(1, "A", "B"), row(2, "a", "b", line=9), row(3, "A", "C", "X"), row(4, "B", "C")], [row(1, "A", "b", line=5), row(3, "A", "C", "x"), row(4, "A", "C", "Y"), row(5, "", "C"), row(6, "D", "B")])]
    keyed, edges = [build.keyed_edges(r) for r in raw], [build.dedup_edges(r) for r in raw]
    columns = ["from_key", "to_key", "cond", "change"]
    expected = [("A", "C", "Y", "added"), ("B", "C", "", "removed"), ("D", "B", "", "added")]
    assert rows(diff.diff_edges(*keyed), *columns) == rows(diff.diff_edges(*edges), *columns) == expected
    plan = diff.diff_edges(*keyed).select("from_key", "to_key", "change")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan and "Join" not in plan
    used = lambda e: build.ends(e).select("graph_id", "key")
    b, a = keyed
    assert [tuple(r) for r in diff.diff_summary(used(b), b, used(a), a).collect()] == [("g", 3, 4, 1, 3, 4, 1, False)]
    same = diff.diff_summary(used(b), b, used(edges[0]), edges[0])
    assert [tuple(r) for r in same.collect()] == [("g", 3, 3, 0, 3, 3, 0, True)]
    plan = same._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "min(" not in plan.partition("Join")[2].partition("Union")[0]


def test_summary_of_graphs_on_one_side(spark):
    """A graph that is only there before or after is counted against nothing; the rest by itself."""
    a, b = graph(spark, "A>B|B>C").unionByName(graph(spark, "X>Y", "h")), graph(spark, "A>B|B>C").unionByName(graph(spark, "X>Y|X>Z", "i"))
    used = lambda e: build.ends(e).select("graph_id", "key")
    out = diff.diff_summary(used(a), a, used(b), b)
    assert sorted(tuple(r) for r in out.collect()) == [("g", 3, 3, 0, 2, 2, 0, True), ("h", 2, 0, -2, 1, 0, -1, False), ("i", 0, 3, 3, 0, 2, 2, False)]


def test_stored_snapshots_differ_as_their_edges(spark, tmp_path):
    """Only parts with a difference are read; sums see rows come, go, change and null places swap, not lines move."""
    from unitgraph.operators import snapshots

    text = [f"A{i}>B{i % 7}" for i in range(60)]
    before, after = graph(spark, "|".join(text)), graph(spark, "|".join(["A3>New", "More>A1", *text[:3], *text[4:50]]))
    moved = before.withColumn("line", F.col("line") + 5).repartition(3)
    for name, df in (("before", before), ("after", after), ("moved", moved), ("none", before.limit(0))):
        snapshots.write_edges_snapshot(df, f"{tmp_path}/{name}", 16)
    at = lambda a, b: (spark, f"{tmp_path}/{a}", f"{tmp_path}/{b}")
    columns = ["from_key", "to_key", "section", "certainty", "cond", "change"]
    for a, b, x, y in (("before", "after", before, after), ("none", "after", before.limit(0), after), ("before", "none", before, before.limit(0)), ("before", "moved", before, moved)):
        assert rows(snapshots.diff_edges_stored(*at(a, b)), *columns) == rows(diff.diff_edges(x, y), *columns)
    assert snapshots.differing_parts(*at("before", "moved")) == [] and 0 < len(snapshots.differing_parts(*at("before", "after"))) < 16
    one = graph(spark, "|".join(["A0>X", *text[1:]]))
    snapshots.write_edges_snapshot(one, f"{tmp_path}/one", 16)
    parts = snapshots.differing_parts(*at("before", "one"))
    read = snapshots.read_parts(spark, f"{tmp_path}/one", parts, snapshots.EDGES)
    assert 1 <= len(parts) <= 2 and len(read.inputFiles()) >= 1 and 0 < read.count() < 60
    assert "PartitionFilters: [isnotnull(part" in read._jdf.queryExecution().toString() or "PartitionFilters: [part" in read._jdf.queryExecution().toString()
    snapshots.write_edges_snapshot(one, f"{tmp_path}/other", 8)
    with pytest.raises(ValueError, match="different numbers of parts"):
        snapshots.differing_parts(*at("one", "other"))
    sides = [spark.createDataFrame([r], "a string, b string") for r in ((None, "x"), ("x", None))]
    for n, df in enumerate(sides):
        snapshots.write_snapshot(df, f"{tmp_path}/null{n}", ["a", "b"], 4)
    assert snapshots.differing_parts(*at("null0", "null1")) != []


@pytest.mark.parametrize("k", [5, 1000])
def test_chains_of_a_lattice(spark, k):
    """Six layers of four units, each naming all of the next: 4,096 chains, in the order of discovery."""
    layers = [["R"], *[[f"L{d}U{i}" for i in range(4)] for d in range(6)], ["T"]]
    text = "|".join(f"{a}>{b}" for one, two in itertools.pairwise(layers) for a in one for b in two)
    t = spark.createDataFrame([("g", "T"), ("g", "L2U3")], "graph_id string, key string")
    out = paths.find_paths(pairs_of(spark, text), root(spark, "R"), t, k).collect()
    # The last unit but one decides first, then the one before it.
    for to, depth in (("T", 6), ("L2U3", 2)):
        all_ = [["R", *[f"L{depth - 1 - j}U{i}" for j, i in reversed(list(enumerate(c)))], to] for c in itertools.product(range(4), repeat=depth)]
        got = sorted((r["chain_no"], r["chain"], int(r["total"])) for r in out if r["to_key"] == to)
        assert got == [(n + 1, c, 4**depth) for n, c in enumerate(all_[:k])]


def test_all_chains_are_listed(spark):
    """Without a limit every chain is there, in the same order, and the query ``path`` leaves none out of its tree."""
    layers = [["Nation.N2"], *[[f"L{d}U{i}" for i in range(4)] for d in range(5)], ["Part.P10", "Part.P20"]]
    text = "|".join(f"{a}>{b}" for one, two in itertools.pairwise(layers) for a in one for b in two) + "|L0U1>Part.P11|L1U0>Nation.N2|Other>L0U1"
    p = pairs_of(spark, text)
    t = spark.createDataFrame([("g", "PART.P10"), ("g", "PART.P11"), ("g", "NATION.N2"), ("g", "OTHER")], "graph_id string, key string")
    some, every = [sorted(tuple(r) for r in paths.find_paths(p, root(spark, "Nation.N2"), t, k).collect()) for k in (1024, None)]
    assert len(every) == 1026 and some == every
    names = ["Nation.N2", "Part.P10", "Part.P11"]
    nodes = spark.createDataFrame([("g", n.upper(), n, []) for n in names], "graph_id string, key string, name string, aliases array<string>")
    tree = queries.QUERIES["path"](SimpleNamespace(spark=spark, nodes=nodes, edges=graph(spark, text), pairs=p)).collect()
    assert len({r["prefix"] for r in tree}) == len(tree) == sum(4**d for d in range(6)) + 1024 + 1
    assert sum(r["is_target"] for r in tree) == 1025


def test_counts_of_chains_stay_numbers(spark):
    """Three diamonds have eight chains; sums beyond the greatest number that is told apart stay at it."""
    text = "|".join(f"D{n}>L{n}|D{n}>R{n}|L{n}>D{n + 1}|R{n}>D{n + 1}" for n in range(3))
    units, preds = bfs.shortest_path_dag(pairs_of(spark, text), root(spark, "D0"))
    assert dict(rows(paths.count_chains(units, preds, 6), "key", "total"))["D3"] == 8
    many = units.where("depth = 0").select("graph_id", "root_key", "key", F.lit(Decimal(paths.MOST_CHAINS)).alias("total")).unionByName(units.where("depth = 0").select("graph_id", "root_key", "key", F.lit(Decimal(7)).alias("total")))
    assert many.agg(paths._total(F.sum("total")).alias("n")).first()["n"] == paths.MOST_CHAINS


def test_reach_of_units_that_reach_little(spark, tmp_path, monkeypatch):
    """Three hundred units in rows of three, and one that uses a hundred: sets take room for what is in them, not 4 KB each."""
    from unitgraph.operators import condense

    kept = []
    monkeypatch.setattr(condense, "written", lambda df, f=condense.written: kept.append(f(df)) or kept[-1])
    text = "|".join([f"A{i}>B{i}|B{i}>C{i}" for i in range(100)] + [f"TOP>C{i}" for i in range(100)])
    out = condense.reach_count_all(pairs_of(spark, text), spark.createDataFrame([], "graph_id string, component string, size long, key string"))
    assert dict(rows(out, "key", "reach")) == {"TOP": 101} | {f"{u}{i}": n for i in range(100) for u, n in (("A", 3), ("B", 2), ("C", 1))}
    assert all(df.schema["bits"].dataType.simpleString() == "bigint" for df in kept if "bits" in df.columns)


def test_groups_trees_and_reach_without_broadcasts(spark, monkeypatch):
    """Groups, dominators and reach of many graphs by searching each by hand, with every side sorted and merged."""
    from unitgraph.operators import condense, ranks

    rng = random.Random(5)
    text = {(f"g{g}", f"N{rng.randrange(9)}", f"N{rng.randrange(9)}") for g in range(12) for _ in range(rng.randrange(5, 16))}
    p = spark.createDataFrame([(g, a, b, i, i) for i, (g, a, b) in enumerate(sorted(text))], "graph_id string, from_key string, to_key string, first_seq long, adj_ord int")
    units = {(g, u) for g, a, b in text for u in (a, b)}

    def reach(g, start, gone=None):
        seen, todo = set(), [start]
        while todo:
            u = todo.pop()
            if u not in seen and u != gone:
                seen.add(u)
                todo += [b for h, a, b in text if (h, a) == (g, u)]
        return seen

    far = {(g, u): reach(g, u) for g, u in units}
    mutual = {(g, u): [v for v in far[g, u] if u in far[g, v]] for g, u in units}
    monkeypatch.setattr(ranks, "SMALL", 0)
    found, rounds = cycles.components(p)
    assert {(r["graph_id"], r["component"], r["size"], r["key"]) for r in found.collect()} == {(g, min(vs), len(vs), u) for (g, u), vs in mutual.items() if len(vs) > 1}
    assert 1 <= rounds["phases"] <= rounds["rounds"] <= 40
    assert {(r["graph_id"], r["key"], r["reach"]) for r in condense.reach_count_all(p).collect()} == {(g, u, len(vs)) for (g, u), vs in far.items()}
    roots = spark.createDataFrame([(f"g{g}", f"N{k}") for g in range(12) for k in (0, 1)], "graph_id string, root_key string")
    doms = {(g, r, u, d) for g in {x[0] for x in units} for r in ("N0", "N1") if (g, r) in units for d in far[g, r] for u in far[g, r] - reach(g, r, d)}
    assert {tuple(r) for r in dominators.dominators(p, roots).collect()} == doms


@pytest.mark.parametrize("most", [100_000, 0])
def test_reach_of_many_sources_in_one_walk(spark, monkeypatch, most):
    """A hundred sources in two words of bits, some unknown; rows of the walk are units and words, not units and sources."""
    from unitgraph.operators import ranks

    monkeypatch.setattr(ranks, "SMALL", most)
    rng = random.Random(11)
    text = {(f"g{k % 3}", f"N{rng.randrange(40)}", f"N{rng.randrange(40)}") for k in range(180)}
    p = durable(spark.createDataFrame([(g, a, b, i, i) for i, (g, a, b) in enumerate(sorted(text))], "graph_id string, from_key string, to_key string, first_seq long, adj_ord int"))
    units = {(g, u) for g, a, b in text for u in (a, b)}

    def reach(g, start, gone=None):
        seen, todo = set(), [start]
        while todo:
            u = todo.pop()
            if u not in seen:
                seen.add(u)
                todo += [b for h, a, b in text if (h, a) == (g, u) and (a, b) != gone]
        return len(seen)

    asked = sorted({(f"g{k % 3}", f"N{k}") for k in range(42)} | units)
    sources = spark.createDataFrame([*asked, asked[0]], "graph_id string, key string")
    assert len(asked) > bfs.WORD
    expected = sorted((g, u, reach(g, u) if (g, u) in units else 0) for g, u in asked)
    assert rows(bfs.reach_count(p, sources), "graph_id", "source", "reach") == expected
    bits = spark.createDataFrame([(g, u, i // 64, (1 << i % 63)) for i, (g, u) in enumerate(asked)], "graph_id string, key string, word long, bits long")
    assert bfs.walk_bits(p, bits).select("graph_id", "key", "word").distinct().count() <= 2 * len(units)
    wanted = p.where("from_key in ('N1', 'N2', 'N3')").select("graph_id", "from_key", "to_key")
    roots = spark.createDataFrame([(f"g{g}", f"N{k}") for g in range(3) for k in (0, 1, 99)], "graph_id string, root_key string")
    columns = ["graph_id", "root_key", "from_key", "to_key", "exclusive"]
    walked = rows(dominators._edge_cost_by_walks(wanted, p, roots), *columns)
    assert walked == sorted((g, r, a, b, reach(g, r) - reach(g, r, (a, b)) if (g, r) in units else 0) for g, a, b in map(tuple, wanted.collect()) for r in ("N0", "N1", "N99"))
    assert walked == rows(dominators._edge_cost(wanted, p, roots), *columns)


def test_dominators_of_a_long_chain(spark):
    """10,000 units in a row, with a second way round every thousandth: n log n pointers, and no level for each unit."""
    pairs_ = [(i, i + 1) for i in range(9_999)] + [(i, i + 2) for i in range(0, 9_000, 1000)]
    p = spark.createDataFrame([("g", f"N{a}", f"N{b}") for a, b in pairs_], "graph_id string, from_key string, to_key string")
    tree = dominators.dominator_tree(p, spark.createDataFrame([("g", "N0")], "graph_id string, root_key string"))
    size = {r["key"]: r["size"] for r in tree.select("key", "size").collect()}
    jumped = {i + 1 for i in range(0, 9_000, 1000)}
    assert size == {f"N{i}": 1 if i in jumped else 10_000 - i for i in range(10_000)}


def test_globs_by_their_rarest_letters(spark, monkeypatch):
    """Against comparing all with all: many patterns, ones without three letters in a row, signs that mean something elsewhere."""
    from unitgraph.operators import match

    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("aB.%_!é") for _ in range(n))
    names_ = [("g", f"K{i}", text(rng.randrange(0, 9))) for i in range(150)] + [("h", "K1", "aBa.aB"), ("h", "K1", "other"), ("h", "K2", None)]
    wanted = {"".join(rng.choice(["*", "?", text(3), text(1), text(4)]) for _ in range(rng.randrange(1, 4))) for _ in range(1500)} | {"", "*", "??", "none*at*all"}
    names_df = spark.createDataFrame(names_, "graph_id string, key string, any_name string")
    patterns_ = spark.createDataFrame([(p,) for p in sorted(wanted)], "pattern string")
    from unitgraph.functions.names import glob_match

    slow = names_df.join(patterns_, glob_match(F.col("pattern"), F.col("any_name"))).select("graph_id", "key", "pattern").distinct()
    monkeypatch.setattr(match, "BLOCK", 40)
    assert rows(match.glob_pairs(names_df, patterns_), "graph_id", "key", "pattern") == rows(slow, "graph_id", "key", "pattern")
    clear = match.glob_pairs(names_df, match.patterns(spark, "aBa*", "*.aB"))
    assert "NestedLoop" not in clear._jdf.queryExecution().executedPlan().toString()
    assert match.glob_pairs(names_df, patterns_.limit(0)).collect() == []


def test_no_level_sends_or_deals_the_pairs(spark):
    """The plan of a level: pairs are read where they lie, in buckets if the other side is large."""
    from unitgraph.operators.ranks import small
    from unitgraph.plans.durable import bucketed, written

    p = bucketed(spark.range(50_000).select(F.lit("g").alias("graph_id"), (F.col("id") % 900).cast("string").alias("from_key"), F.col("id").cast("string").alias("to_key")), "graph_id", "from_key")
    near = written(spark.range(900).select(F.lit("g").alias("graph_id"), F.col("id").cast("string").alias("from_key")))
    for rows_, sends in ((900, "BroadcastExchange"), (10**9, "Exchange hashpartitioning")):
        plan = p.join(small(near, rows_), ["graph_id", "from_key"])._jdf.queryExecution().executedPlan().toString()
        left, right = plan.split("FileScan parquet", 1)
        assert "Exchange" not in left and sends in right


def test_first_rows_of_a_hub_for_any_limit(spark):
    """Beyond what Spark cuts before it sorts, a hub's list is dealt by ranges: no task holds it."""
    df = spark.range(20_000).select(F.when(F.col("id") % 4 != 0, "hub").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), ((F.col("id") * 7919) % 20_000).alias("v"))
    out = reports.limit_with_more(df, ["key"], [F.col("v")], 5_000)
    hub = sorted(r["v"] for r in df.where("key = 'hub'").collect())
    top = out.where("key = 'hub'").orderBy("rank").collect()
    assert [(r["v"], r["rank"], r["more"]) for r in top] == [(v, i + 1, 10_000) for i, v in enumerate(hub[:5_000])]
    assert out.where("key != 'hub'").count() == 5_000 and "_range" in out._jdf.queryExecution().toString()


def test_ranks_within_lists_that_span_ranges(spark):
    from unitgraph.operators.ranks import rank_within

    rows_ = [("hub" if i % 3 else f"k{i}", (i * 37) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows_, "key string, v int").repartition(7)
    got = {(r["key"], r["v"]): r["rank"] for r in rank_within(df, ["key"], [F.col("v")]).collect()}
    hub = sorted(v for k, v in rows_ if k == "hub")
    assert [got["hub", v] for v in hub] == list(range(1, len(hub) + 1)) and len(got) == 1000
    top = reports.limit_with_more(df, ["key"], [F.col("v").desc()], 2).where("key = 'hub'").orderBy("rank").collect()
    assert [(r["v"], r["rank"], r["more"]) for r in top] == [(hub[-1], 1, len(hub) - 2), (hub[-2], 2, len(hub) - 2)]
