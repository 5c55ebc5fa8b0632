"""What a unit, or a single dependency, is responsible for.

All of it follows from the tree of immediate dominators: a unit goes with another if that one is above it in
the tree. Units of all trees are numbered, and a tree is one row a unit, with its place in an order in
which whatever is below a unit follows it directly, and pointers to the units 1, 2, 4, ... above: n log n
values for n units, however long a chain may be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitgraph.functions.names import place
from unitgraph.operators.bfs import known_units, reach_count, reach_of, walk
from unitgraph.operators.build import where_written
from unitgraph.operators.match import find_nodes
from unitgraph.operators.ranks import hint, rank_within, small, total_within
from unitgraph.operators.reports import limit_with_more
from unitgraph.plans.durable import bucketed, counted, observed, written


def _sql(text: str, broadcast_if: int, **frames: DataFrame) -> DataFrame:
    """SQL over frames; HINT in it is the join hint for a side of ``broadcast_if`` rows."""
    return next(iter(frames.values())).sparkSession.sql(text.replace("HINT", hint(broadcast_if)), **frames)


def _only_ways(p: DataFrame) -> tuple[DataFrame, int]:
    """(tree, key, only, top), written, and their number: units that just one other uses, and where that way begins.

    ``top`` is the first unit above that is not such a unit itself, found by doubling: n units in a row take
    log n rounds. Rings that nothing leads into have no top and are left out, with what hangs on them.
    """
    way, n = counted(p.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n"), F.min("pred").alias("only")).where("n = 1").select("tree", "key", "only", F.col("only").alias("top")))
    step = "select /*+ HINT(b) */ a.tree, a.key, a.only, coalesce(b.top, a.top) as top, b.top is not null as moved from {way} a left join {way} b on a.tree = b.tree and a.top = b.key"
    for _ in range(n.bit_length() + 1):
        way, seen = observed(_sql(step, n, way=way), moved=F.count_if("moved"))
        if not seen["moved"]:
            break
    return way.where("not moved").drop("moved"), n


def _first_tree(pairs: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Numbered units of all trees (tree, key, id, parent), predecessors (id, pred) of units with several, the heads
    (tree, graph_id, root_key), and the number of units.

    Units with one way to them hang on that way, and are not searched: the levels of the search are those
    of the units with several ways, or none, which they lead to.
    """
    heads = known_units(pairs, roots.select("graph_id", F.col("root_key").alias("key"))).select("graph_id", F.col("key").alias("root_key"))
    heads, many = counted(heads.withColumn("tree", F.monotonically_increasing_id()))
    p = pairs.select("graph_id", F.col("from_key").alias("pred"), F.col("to_key").alias("key")).where("pred != key").join(small(heads, many), "graph_id").where("key != root_key").select("tree", "pred", "key")
    way, ways = _only_ways(p)
    led = _sql("""select /*+ HINT(t), HINT(s) */ p.tree, coalesce(t.top, p.pred) as top, p.key, min(p.pred) as via from {p} p left join {way} t on p.tree = t.tree and p.pred = t.key
      left join {way} s on p.tree = s.tree and p.key = s.key where s.key is null and coalesce(t.top, p.pred) != p.key group by 1, 2, 3""", ways, p=p, way=way)
    led = bucketed(led, "tree", "top")
    starts = heads.select(F.col("tree").alias("graph_id"), F.lit(0).alias("scenario"), F.col("root_key").alias("key"))
    found = walk(led.select(F.col("tree").alias("graph_id"), F.col("top").alias("from_key"), F.col("key").alias("to_key")), starts).select(F.col("graph_id").alias("tree"), "key", "depth")
    # A root whose units all hang on single ways leads to nothing that is searched.
    found, n = counted(found.unionByName(heads.select("tree", F.col("root_key").alias("key"), F.lit(0).alias("depth"))).distinct())
    near = _sql("""select /*+ HINT(a), HINT(b) */ b.tree, b.key, min(l.via) as parent_key from {led} l join {found} a on l.tree = a.tree and l.top = a.key join {found} b on l.tree = b.tree and l.key = b.key
      where b.depth = a.depth + 1 group by 1, 2""", n, led=led, found=found)
    hanging = way.join(small(found.select("tree", F.col("key").alias("top")), n), ["tree", "top"], "left_semi").select("tree", "key", F.col("only").alias("parent_key"))
    root = heads.select("tree", F.col("root_key").alias("key"), F.lit(None).cast("string").alias("parent_key"))
    # Any numbers will do that differ and, once written, stay; 0 is nobody's.
    units, n = counted(near.unionByName(hanging).unionByName(root).withColumn("id", F.monotonically_increasing_id() + 1))
    named = _sql("select /*+ HINT(b) */ a.tree, a.key, a.id, b.id as parent from {units} a left join {units} b on a.tree = b.tree and a.parent_key = b.key", n, units=units)
    ends = _sql("""select /*+ HINT(u), HINT(v), HINT(s) */ v.id, u.id as pred from {p} p join {units} u on p.tree = u.tree and p.pred = u.key join {units} v on p.tree = v.tree and p.key = v.key
      left anti join {way} s on p.tree = s.tree and p.key = s.key""", max(n, ways), p=p, units=units, way=way)
    return written(named), bucketed(ends, "id"), heads, n


def _navigate(tree: DataFrame, n: int) -> DataFrame:
    """(id, parent, start, size, ups, ends), written, of ``tree`` (id, parent) with ``n`` units.

    ``size`` counts a unit and all below it, which are those with ``start`` from its own to ``start + size - 1``.
    ``ups`` are the units 1, 2, 4, ... above, ``ends`` where their units end in this order.
    """
    t = written(tree.select("id", "parent", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"), F.array().cast("array<bigint>").alias("ups")))
    step = """select /*+ HINT(b), HINT(s) */ t.id, t.parent, b.up, t.size + coalesce(s.more, 0) as size, if(t.up is null, t.ups, array_append(t.ups, t.up)) as ups from {t} t left join {t} b on t.up = b.id
      left join (select up as id, sum(size) as more from {t} where up is not null group by up) s on t.id = s.id"""
    left = 1
    while left:
        t, seen = observed(_sql(step, n, t=t), left=F.count("up"))
        left = seen["left"]
    # Below its parent, a unit comes after its elder sisters and all below them; a list of sisters may be of any length.
    placed = total_within(t.withColumn("among", F.coalesce("parent", F.lit(0))), ["among"], [F.col("id")], "size", "elder")
    s = written(placed.select("id", "parent", "size", "ups", (F.col("elder") + 1).alias("start")))
    step = "select /*+ HINT(b) */ s.id, s.parent, s.size, s.ups, s.start + coalesce(b.start, 0) as start, b.id is not null as open from {s} s left join {s} b on get(s.ups, K) = b.id"
    k, open_ = 0, n
    while open_:
        s, seen = observed(_sql(step.replace("K", str(k)), n, s=s), open=F.count_if("open"))
        k, open_ = k + 1, seen["open"]
    ends = _sql("""select /*+ HINT(b) */ a.id, transform(array_sort(collect_list(struct(a.k, b.start + b.size as end))), x -> x.end) as ends from (select id, posexplode(ups) as (k, up) from {s}) a
      join {s} b on a.up = b.id group by a.id""", n, s=s)
    return written(s.drop("open").join(small(ends, n), "id", "left"))


def dominator_tree(pairs: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(graph_id, root_key, key, id, idom_id, start, size), written: the units each root reaches, as a tree.

    A unit's parent in the tree is its immediate dominator, the nearest of the units on every route to it.
    From a tree of first discoveries, a round hangs every unit on the nearest unit above all of its
    predecessors; it ends when none moves. Whatever is on every route stays above a unit throughout, and a
    unit only ever moves up, so one that hangs on the root, or has one predecessor, is looked at no more.
    The nearest unit above many is the one above the first and the last of them in the tree's order.
    """
    named, ends, heads, n = _first_tree(pairs, roots)
    tree = named.select("id", "parent")
    top = named.where("parent is null").select(F.col("id").alias("parent"))
    active = ends.select("id").distinct()
    for _ in range(max_rounds):
        nav = _navigate(tree, n)
        # Still to be looked at: units with several predecessors that do not hang on their root.
        active, left = counted(nav.join(active, "id", "left_semi").join(small(top, n), "parent", "left_anti").select("id"))
        moved, m = counted(_meet(ends.join(small(active, left), "id", "left_semi"), nav, n)) if left else (None, 0)
        if not m:
            nav = nav.select("id", "parent", "start", "size")
            return written(named.drop("parent").join(small(nav, n), "id").join(heads, "tree").select("graph_id", "root_key", "key", "id", F.col("parent").alias("idom_id"), "start", "size"))
        tree = written(_sql("select /*+ HINT(m) */ t.id, coalesce(m.parent, t.parent) as parent from {tree} t left join {moved} m on t.id = m.id", m, tree=tree, moved=moved))
    raise RuntimeError(f"not finished after {max_rounds} rounds")


def _meet(ends: DataFrame, nav: DataFrame, n: int) -> DataFrame:
    """(id, parent): units whose nearest unit above all predecessors is another than their parent.

    From the first predecessor in the tree's order up, by halving steps, past all units whose units end
    before the last predecessor.
    """
    deep = nav.agg(F.max(F.size("ups"))).first()[0] or 0
    both = _sql("select /*+ HINT(u) */ e.id, min(u.start) as lo, max(u.start) as hi from {ends} e join {nav} u on e.pred = u.id group by e.id", n, ends=ends, nav=nav)
    at = written(_sql("select /*+ HINT(u) */ b.id, b.hi, u.id as at from {both} b join {nav} u on b.lo = u.start", n, both=both, nav=nav))
    for k in range(deep - 1, -1, -1):
        # Each step is written: in one plan, what Spark infers about ``at`` would double with each.
        at = written(_sql(f"select /*+ HINT(u) */ a.id, a.hi, if(get(u.ends, {k}) <= a.hi, get(u.ups, {k}), a.at) as at from {{at}} a join {{nav}} u on a.at = u.id", n, at=at, nav=nav))
    met = _sql("select /*+ HINT(u) */ a.id, if(u.start + u.size <= a.hi, u.parent, u.id) as parent from {at} a join {nav} u on a.at = u.id", n, at=at, nav=nav)
    return _sql("select /*+ HINT(u) */ m.id, m.parent from {met} m join {nav} u on m.id = u.id where m.parent != u.parent", n, met=met, nav=nav)


def dominators(pairs: DataFrame, roots: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(graph_id, root_key, key, dom_key): units on every route from the root, the unit itself included.

    This is the tree written out, a row for each unit and each one above it; the other functions do without.
    """
    tree = tree if tree is not None else dominator_tree(pairs, roots)
    up = written(_above(tree.select("id", F.col("idom_id").alias("parent"))).unionByName(tree.select("id", F.col("id").alias("above"))))
    names = tree.select("graph_id", "root_key", "key", "id")
    return up.join(names, "id").join(names.select(F.col("id").alias("above"), F.col("key").alias("dom_key")), "above").select("graph_id", "root_key", "key", "dom_key")


def _above(tree: DataFrame) -> DataFrame:
    """(id, above): the units above each in the tree, by doubling the way up."""
    up = written(tree.where("parent is not null").select("id", F.col("parent").alias("above")))
    jump, n = up, 1
    while n:
        # ``up`` holds all within 2**k steps, ``jump`` what is just 2**k above.
        over = jump.select("id", F.col("above").alias("mid"))
        up = written(up.unionByName(over.join(up.select(F.col("id").alias("mid"), "above"), "mid").select("id", "above")))
        jump, n = counted(over.join(jump.select(F.col("id").alias("mid"), "above"), "mid").select("id", "above"))
    return up


def immediate_dominator(pairs: DataFrame, roots: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(graph_id, root_key, key, idom): the nearest strict dominator; null for the root."""
    tree = tree if tree is not None else dominator_tree(pairs, roots)
    return tree.join(tree.select(F.col("id").alias("idom_id"), F.col("key").alias("idom")), "idom_id", "left").select("graph_id", "root_key", "key", "idom")


def exclusive_reach(pairs: DataFrame, roots: DataFrame, nodes: DataFrame | None = None, tree: DataFrame | None = None) -> DataFrame:
    """(graph_id, root_key, key, exclusive): units that go if this one goes, itself included; 0 out of reach."""
    tree = tree if tree is not None else dominator_tree(pairs, roots)
    n = tree.select("graph_id", "root_key", "key", F.col("size").alias("exclusive"))
    if nodes is None:
        return n
    heads = roots.select("graph_id", "root_key").distinct()
    every = nodes.select("graph_id", "key").join(small(heads, heads.count()), "graph_id")
    return every.join(n, ["graph_id", "root_key", "key"], "left").withColumn("exclusive", F.coalesce("exclusive", F.lit(0).cast("long")))


def cost_project(nodes: DataFrame, pairs: DataFrame, roots: DataFrame, limit: int = 50) -> DataFrame:
    """Reachable units but the root by what they alone pull in, the dearest first, then by name."""
    cost = exclusive_reach(pairs, roots).where("key != root_key").join(nodes.select("graph_id", "key", "name", "kind"), ["graph_id", "key"])
    return limit_with_more(cost, ["graph_id", "root_key"], [F.desc("exclusive"), F.col("key")], limit)


def edge_cost(pairs: DataFrame, roots: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(graph_id, root_key, from_key, to_key, exclusive) for every pair: units that go if it goes.

    In closed form: all that its target is responsible for, if every other reachable predecessor of the
    target is itself behind the target; else nothing.
    """
    return _edge_cost(pairs.select("graph_id", "from_key", "to_key"), pairs, roots, tree)


def _edge_cost(wanted: DataFrame, pairs: DataFrame, roots: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """``edge_cost`` of the pairs ``wanted`` (graph_id, from_key, to_key); only predecessors of their targets are looked at.

    Behind a unit is what lies within it in the tree's order, so two numbers tell, and nothing is joined with
    the units above.
    """
    tree = tree if tree is not None else dominator_tree(pairs, roots)
    n = tree.count()
    p = pairs.join(wanted.select("graph_id", "to_key").distinct(), ["graph_id", "to_key"], "left_semi").select("graph_id", "from_key", "to_key").where("from_key != to_key")
    only = _sql("""select /*+ HINT(u), HINT(v) */ v.graph_id, v.root_key, min(u.key) as from_key, v.key as to_key, min(v.size) as size from {p} p join {tree} u on p.graph_id = u.graph_id and p.from_key = u.key
      join {tree} v on p.graph_id = v.graph_id and p.to_key = v.key and u.root_key = v.root_key where v.key != v.root_key and not u.start between v.start and v.start + v.size - 1
      group by v.graph_id, v.root_key, v.key having count(*) = 1""", n, p=p, tree=tree)
    heads = roots.select("graph_id", "root_key").distinct()
    every = wanted.join(small(heads, heads.count()), "graph_id")
    return every.join(only, ["graph_id", "root_key", "from_key", "to_key"], "left").select("graph_id", "root_key", "from_key", "to_key", F.coalesce("size", F.lit(0).cast("long")).alias("exclusive"))


#: Dependencies and roots, multiplied, up to which walks without each are shorter than making the tree.
MOST_WALKS = 256


def _edge_cost_by_walks(wanted: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``_edge_cost`` of few pairs: what each root reaches, less what it reaches without each, all in one walk."""
    cases = roots.withColumns({"from_key": F.lit(None).cast("string"), "to_key": F.lit(None).cast("string")}).unionByName(wanted.join(roots, "graph_id").select("graph_id", "root_key", "from_key", "to_key"))
    names = ["graph_id", "root_key", "from_key", "to_key"]
    cases = written(rank_within(cases, [], [F.col(c) for c in names], "no", "long"))
    gone = cases.where("from_key is not null")
    n = written(reach_of(pairs, cases.select("graph_id", "no", F.col("root_key").alias("key")), gone.select("graph_id", "no", "from_key", "to_key")))
    whole = cases.where("from_key is null").join(n, "no").select("graph_id", "root_key", F.col("reach").alias("whole"))
    left = gone.join(n, "no", "left").join(whole, ["graph_id", "root_key"], "left")
    return left.select(*names, F.coalesce(F.col("whole") - F.col("reach"), F.lit(0).cast("long")).alias("exclusive"))


def cost_unit(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, roots: DataFrame, patterns: DataFrame, limit: int = 50) -> DataFrame:
    """For each direct dependency of the matched units: what goes without it, all it reaches, where it is.

    A unit that uses nothing is one row with a null ``to_key``.
    """
    units = written(find_nodes(nodes, patterns).select("graph_id", F.col("key").alias("from_key"), "name"))
    mine, m = counted(pairs.join(units.select("graph_id", "from_key"), ["graph_id", "from_key"], "left_semi").select("graph_id", "from_key", "to_key"))
    total = reach_count(pairs, mine.select("graph_id", F.col("to_key").alias("key"))).withColumnsRenamed({"source": "to_key", "reach": "total"})
    heads, many = counted(roots.select("graph_id", "root_key").distinct())
    cost = _edge_cost_by_walks(mine, pairs, heads) if m * max(many, 1) <= MOST_WALKS else _edge_cost(mine, pairs, roots)
    here = where_written(edges.join(small(mine, m), ["graph_id", "from_key", "to_key"], "left_semi"))
    rows = cost.join(total, ["graph_id", "to_key"]).join(here, ["graph_id", "from_key", "to_key"])
    rows = units.join(rows.drop("root_key"), ["graph_id", "from_key"], "left").withColumn("where", place(F.col("file"), F.col("line")))
    top = limit_with_more(rows, ["graph_id", "from_key"], [F.desc("exclusive"), F.desc("total"), F.col("to_key")], limit)
    return top.select("graph_id", "from_key", "to_key", "exclusive", "total", "where", "rank", "more")
