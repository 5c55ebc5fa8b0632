"""Resharding: the transfers between shards that move the fewest bytes, and new files for the shards they touch.

A shard's rows lie in the order of a key. A plan cuts old shards into blocks, runs of that order, and
sends each block to one new shard; it has fewer blocks than there are old and new shards together, so
every row finds its shard by comparing its key with a few bounds, and no text is shuffled to learn it.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitgraph.plans.durable import durable, shared_dir

#: Old shards of a corpus that has none yet.
OLD_SHARDS = 6


def unit_cost(old: int, new: int) -> int:
    """A byte that stays costs nothing, one that moves costs one."""
    return int(old != new)


def cheapest_transfers(sizes: Sequence[int], capacities: Sequence[int], cost: Callable[[int, int], int] = unit_cost) -> dict[tuple[int, int], int]:
    """{(old, new): bytes} that brings ``sizes`` into ``capacities`` at the least cost: a minimum-cost flow.

    Flow is sent along cheapest paths from shards with bytes left to shards with room left, one after the
    other; a path may take back what an earlier one sent. Potentials keep all reduced costs at 0 or more.
    The graph has the shards as its nodes, not the rows. Capacities must hold all bytes between them.
    """
    if sum(sizes) > sum(capacities):
        raise ValueError("capacities hold less than the shards do")
    m, n = len(sizes), len(capacities)
    left, room = list(sizes), list(capacities)
    sent: dict[tuple[int, int], int] = defaultdict(int)
    potential = [0] * (m + n)
    while any(left):
        far, via, done = [float("inf")] * (m + n), [-1] * (m + n), [False] * (m + n)
        heap = []
        for i in range(m):
            if left[i]:
                far[i] = 0
                heappush(heap, (0, i))
        end = -1
        while heap:
            d, u = heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if u >= m and room[u - m]:
                end = u
                break
            steps = [(m + j, cost(u, j)) for j in range(n)] if u < m else [(i, -cost(i, u - m)) for i in range(m) if sent[i, u - m]]
            for v, c in steps:
                reach = d + c + potential[u] - potential[v]
                if reach < far[v]:
                    far[v], via[v] = reach, u
                    heappush(heap, (reach, v))
        for u in range(m + n):
            potential[u] += min(far[u], far[end]) if far[u] < float("inf") else far[end]
        path = [end]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        path.reverse()
        back = [sent[v, u - m] for u, v in zip(path, path[1:], strict=False) if u >= m]
        amount = min([left[path[0]], room[end - m], *back])
        for u, v in zip(path, path[1:], strict=False):
            if u < m:
                sent[u, v - m] += amount
            else:
                sent[v, u - m] -= amount
        left[path[0]] -= amount
        room[end - m] -= amount
    return {k: x for k, x in sorted(sent.items()) if x}


def even(total: int, shards: int) -> list[int]:
    """``total`` bytes over ``shards``, at most one byte apart."""
    return [total // shards + (k < total % shards) for k in range(shards)]


@dataclass(frozen=True)
class Block:
    """Rows of an old shard from key ``first`` (None: its start) up to the next block go to shard ``new``."""

    old: int
    new: int
    first: tuple | None


def positions(rows: DataFrame, order: Sequence[Column], shard: str = "shard", size: str = "size") -> DataFrame:
    """``rows``, durable, with ``before`` and ``rank``: bytes and rows of the shard that come before each, by ``order``.

    Rows are dealt by ranges of shard and order, so a shard that holds a third of all rows is spread over
    many tasks; a task's rows follow those of its shard in the ranges before.
    """
    dealt = durable(rows.repartitionByRange(F.col(shard), *order).withColumn("_range", F.spark_partition_id()))
    ahead = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A shard has a row here for each range it is in.
    base = dealt.groupBy(shard, "_range").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    zero = F.lit(0).cast("long")
    base = base.select(shard, "_range", F.coalesce(F.sum("_bytes").over(ahead), zero).alias("_bytes"), F.coalesce(F.sum("_rows").over(ahead), zero).alias("_rows"))
    within = Window.partitionBy(shard, "_range").orderBy(*order)
    inner = dealt.withColumns({"_in": F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), zero), "_no": (F.row_number().over(within) - 1).cast("long")})
    joined = inner.join(base, [shard, "_range"])
    return joined.select(*rows.columns, (F.col("_bytes") + F.col("_in")).alias("before"), (F.col("_rows") + F.col("_no")).alias("rank"))


def plan_blocks(placed: DataFrame, capacities: Sequence[int], keys: Sequence[str], old_shards: int, cost: Callable[[int, int], int] = unit_cost) -> list[Block]:
    """The blocks that the cheapest transfers cut, as bounds on ``keys``, in the order of ``placed``.

    ``placed``: (shard, size, before, *keys), the rows of each shard by ``before``. What a shard keeps
    comes first. A block begins with the row whose middle is the first at or beyond the block's first
    byte, so a block is off by at most half a row at each end. One row a bound reaches the driver.
    """
    sizes = [0] * old_shards
    for r in placed.groupBy("shard").agg(F.sum("size").alias("size")).collect():  # one row a shard
        sizes[r["shard"]] = r["size"]
    sent = cheapest_transfers(sizes, capacities, cost)
    cuts: list[tuple[int, int, int]] = []
    for i in range(old_shards):
        at = 0
        for j in sorted((j for o, j in sent if o == i), key=lambda j: (j != i, j)):
            cuts.append((i, j, at))
            at += sent[i, j]
    later = [c for c in cuts if c[2]]
    if not later:
        return [Block(i, j, None) for i, j, _ in cuts]
    # Twice the middle of a row, to stay with whole numbers.
    middle = 2 * F.col("before") + F.col("size")
    bounds = [F.min(F.when((F.col("shard") == i) & (middle >= 2 * at), F.struct("before", *keys))).alias(f"b{k}") for k, (i, _, at) in enumerate(later)]
    row = placed.agg(*bounds).first()
    first = {c: row[f"b{k}"] for k, c in enumerate(later)}
    out = [Block(c[0], c[1], None if not c[2] else tuple(first[c][k] for k in keys)) for c in cuts if not c[2] or first[c] is not None]
    return [b for b, nxt in zip(out, [*out[1:], None], strict=True) if nxt is None or (b.old, b.first) != (nxt.old, nxt.first)]


def place(shard: Column, keys: Sequence[Column], blocks: Sequence[Block], descending: Sequence[bool]) -> Column:
    """The new shard of a row with these ``keys``: that of the last block of its shard that begins at or before it.

    The blocks are one literal, an array for each old shard, so an expression does not grow with them.
    """
    by_shard: dict[int, list[Block]] = defaultdict(list)
    for b in blocks:
        by_shard[b.old].append(b)
    names = [f"k{i}" for i in range(len(keys))]
    kind = "array<array<struct<new:int,starts:boolean," + ",".join(f"{k}:bigint" for k in names) + ">>>"

    def literal(b: Block) -> Column:
        first = b.first or [0] * len(keys)
        return F.struct(F.lit(b.new), F.lit(b.first is None), *[F.lit(x).cast("long") for x in first])

    table = F.array(*[F.array(*map(literal, by_shard[i])) for i in range(max(by_shard, default=-1) + 1)]).cast(kind)
    begins = lambda b: b["starts"] | _at_or_after([(c, b[k], down) for c, k, down in zip(keys, names, descending, strict=True)])
    return F.aggregate(F.get(table, shard), F.lit(None).cast("int"), lambda found, b: F.when(begins(b), b["new"]).otherwise(found))


def _at_or_after(terms: list[tuple[Column, Column, bool]]) -> Column:
    column, bound, down = terms[0]
    after = column < bound if down else column > bound
    return after | (column == bound) & _at_or_after(terms[1:]) if len(terms) > 1 else after | (column == bound)


def _keyed(docs: DataFrame, old: Column, id_col: str, text: str) -> DataFrame:
    """``docs`` with what a plan looks at; null ids and null texts have keys of their own."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    size = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.octet_length(F.col(text))).cast("long") + 1
    return docs.select(F.struct(*docs.columns).alias("row"), old.cast("int").alias("shard"), size.alias("size"), F.xxhash64(body).alias("k_text"), F.xxhash64(F.lit(1), F.col(id_col)).alias("k_id"))


BY_TEXT = ("k_text", "k_id")
BY_SIZE = ("size", "k_text", "k_id")


def plan(docs: DataFrame, old: Column, old_shards: int, shards: int, id_col: str = "doc_id", text: str = "text", cost: Callable[[int, int], int] = unit_cost) -> tuple[list[Block], list[Block]]:
    """Two lists of blocks: the transfers, and a few small rows that even out what whole rows left over.

    A flow counts bytes, shards hold rows, and a bound that falls within a long text leaves a shard off by
    up to half of it. So what has been planned is planned once more, with each shard's smallest rows at
    its end: these bounds fall between small rows.
    """
    thin = _keyed(docs, old, id_col, text).select("shard", "size", *BY_TEXT)
    placed = positions(thin, [F.col(k) for k in BY_TEXT])
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    capacities = even(total, shards)
    moves = plan_blocks(placed, capacities, BY_TEXT, old_shards, cost)
    moved = placed.withColumn("shard", place(F.col("shard"), [F.col(k) for k in BY_TEXT], moves, [False] * 2)).drop("before", "rank")
    settled = positions(moved, [F.desc("size"), F.col("k_text"), F.col("k_id")])
    return moves, plan_blocks(settled, capacities, BY_SIZE, shards, cost)


@dataclass(frozen=True)
class Resharded:
    """``rows``: (row, shard, size, k_text, k_id) as they now lie; ``affected``: shards with new files, under ``at``."""

    rows: DataFrame
    at: str
    affected: Sequence[int]
    moves: Sequence[Block]
    settled: Sequence[Block]


def touched(blocks: Sequence[Block]) -> set[int]:
    """Shards that rows leave or enter."""
    return {s for b in blocks if b.old != b.new for s in (b.old, b.new)}


def reshard(docs: DataFrame, old: Column, old_shards: int, shards: int, id_col: str = "doc_id", text: str = "text", cost: Callable[[int, int], int] = unit_cost, at: str | None = None) -> Resharded:
    """``docs``, which lie in shards ``old`` (0 up to ``old_shards``), in ``shards`` shards of near equal bytes.

    Size of a row: bytes of its text, null none, plus 1. The fewest bytes move (see
    ``cheapest_transfers``), in blocks of a shard's rows by text and id, then a few small rows, so sizes
    differ by about the smallest rows. Equal texts lie in one old block and stay together but where a bound
    falls among them. Files are written anew, in the order of text and id, below ``at`` for the shards that rows leave
    or enter; rows of the others are read where they are.

    Null texts have size 1; null ids are one id. Rows alike in id and text are never parted, so many of
    them make a shard larger. An empty table has no shards. Long texts are whole. Columns of any name stay.
    """
    moves, settled = plan(docs, old, old_shards, shards, id_col, text, cost)
    at = at or f"{shared_dir(docs.sparkSession).rstrip('/')}/shards-{uuid.uuid4().hex}"
    affected = sorted(touched(moves) | touched(settled))
    keyed = _keyed(docs, old, id_col, text)
    first = keyed.withColumn("old", F.col("shard")).withColumn("shard", place(F.col("shard"), [F.col(k) for k in BY_TEXT], moves, [False] * 2))
    new = first.withColumn("shard", place(F.col("shard"), [F.col(k) for k in BY_SIZE], settled, [True, False, False]))
    if not affected:
        return Resharded(new, at, affected, moves, settled)
    written = new.where(F.col("shard").isin(affected))
    dealt = written.repartitionByRange("shard", *BY_TEXT).sortWithinPartitions("shard", *BY_TEXT)
    dealt.write.partitionBy("shard").parquet(at)
    again = docs.sparkSession.read.schema(dealt.schema).parquet(at)
    stay = [s for s in range(shards) if s not in affected]
    rows = again.unionByName(new.where(F.col("shard").isin(stay))) if stay else again
    return Resharded(rows, at, affected, moves, settled)


def digest(done: Resharded, id_col: str = "doc_id", text: str = "text", law: str = "bytes") -> DataFrame:
    """One row per document as it lies: id, size, text_crc32, law, shard, slot, grown_shard, old_shard."""
    body = F.encode(F.coalesce(F.col("row")[text], F.lit("")), "UTF-8")
    thin = done.rows.select(F.col("row")[id_col].alias(id_col), "size", F.crc32(body).alias("text_crc32"), "shard", "old", *BY_TEXT)
    slots = positions(thin, [F.col(k) for k in BY_TEXT])
    return slots.select(id_col, "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def hashed(text: Column, shards: int = OLD_SHARDS) -> Column:
    """The shard, by its text, of a row that lies in none yet."""
    return F.pmod(F.xxhash64(F.lit(7), F.coalesce(text, F.lit(""))), F.lit(shards)).cast("int")
