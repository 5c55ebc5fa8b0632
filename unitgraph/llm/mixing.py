"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitgraph.llm.common import SPACE, join_counted, ranked, running_total
from unitgraph.plans.durable import durable

#: 2**64 divided by the golden ratio: multiples of it, modulo 2**64, are the golden-ratio points.
GOLDEN = 0x9E3779B97F4A7C15


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, f"{SPACE}+"))).cast("long")


def water_level(sources: DataFrame, budget: float, most: float) -> float:
    """The level at which sources, each taking the least of ``most * size`` and level * weight, take ``budget`` together.

    What is cut off at a source's cap is shared again by weight among the rest, until none is above. The
    level only rises, so each round is one aggregate over ``sources`` (size, weight), however many there are.
    """
    cap, level, full = F.col("size") * F.lit(float(most)), 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > cap
        r = sources.agg(F.sum(F.when(over, cap)).alias("caps"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count(F.when(over, True)).alias("full")).first()
        if r["full"] == full or not r["open"]:
            return level
        full, level = r["full"], (float(budget) - (r["caps"] or 0.0)) / r["open"]


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Durable: each source (_key, _null), numbered ``at`` in code point order with null last: documents, source_size, target, words, blocks."""
    found = durable(sized.groupBy("_key", "_null").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("documents")))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = durable(ranked(found, "_null", "_key").withColumn("weight", F.get(cycle, (F.col("_rank") % len(weights)).cast("int"))))
    level = water_level(named, share * (named.agg(F.sum("size")).first()[0] or 0), most)
    target = F.least(F.col("size") * F.lit(float(most)), F.lit(level) * F.col("weight"))
    return durable(named.select("_key", "_null", "documents", F.col("_rank").alias("at"), F.col("size").alias("source_size"), target.alias("target"), F.round(target).cast("long").alias("words")))


@F.pandas_udf(T.DoubleType())
def golden_point(slot: pd.Series) -> pd.Series:
    """Point number ``slot`` of the golden-ratio sequence, in [0, 1)."""
    with np.errstate(over="ignore"):
        u = (slot.to_numpy(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
    return pd.Series(np.minimum(u.astype(float) / 2.0**64, np.nextafter(1.0, 0.0)))


def schedule(sources: DataFrame, few: int = 100_000) -> DataFrame:
    """The order in which blocks are taken: (slot, at, rank), with ``blocks`` ranks for each source ``at``.

    Slot i looks up point i of the golden-ratio sequence in the cumulative shares; the k-th slot that
    falls to a source takes its k-th block. Any run of slots holds each source in its share to within
    a few blocks. A source that the points give too few slots has its last blocks at the end. Shares are
    looked up by equal cuts of [0, 1), of which a large source has many: a join that no source makes hot.
    """
    spark = sources.sparkSession
    size = sources.agg(F.sum("blocks").alias("blocks"), F.count(F.lit(1)).alias("n")).first()
    total, many = int(size["blocks"] or 0), int(size["n"])
    if total == 0:
        return spark.createDataFrame([], "slot long, at long, rank long")
    cuts = max(1024, many)
    ends = running_total(sources.select("at", "blocks"), [], F.col("at") * F.lit((2**63 - 1) // many), "blocks", "before").where("blocks > 0")
    ends = ends.select(F.col("at"), (F.col("before") / F.lit(total)).alias("lo"), ((F.col("before") + F.col("blocks")) / F.lit(total)).alias("hi"))
    ends = ends.withColumn("cut", F.explode(F.sequence(F.floor(F.col("lo") * cuts), F.least(F.floor(F.col("hi") * cuts), F.lit(cuts - 1)))))
    n = total + total // 64 + 16 * many
    points = spark.range(n).select(F.col("id").alias("slot"), golden_point("id").alias("u")).withColumn("cut", F.floor(F.col("u") * cuts))
    slots = points.join(F.broadcast(ends) if many <= few else ends, "cut").where("lo <= u and u < hi").select("slot", "at", F.lit(1).cast("long").alias("one"))
    slots = durable(slots)
    taken = running_total(slots, ["at"], F.col("slot") * F.lit((2**63 - 1) // n), "one", "rank")
    have = durable(slots.groupBy("at").agg(F.sum("one").alias("have")))
    wanted = sources.select("at", "blocks").join(have, "at", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    kept = join_counted(durable(taken), wanted.where("have > 0"), ["at"], "have").where("rank < blocks").select("slot", "at", "rank")
    late = wanted.where("have < blocks").select("at", F.explode(F.sequence(F.col("have"), F.col("blocks") - 1)).alias("rank"))
    return kept.unionByName(late.select((F.lit(n) + F.col("rank") * many + F.col("at")).alias("slot"), "at", "rank"))


def _mixture(docs: DataFrame, id_col: str, source: str, text: str, weights: Sequence[float], share: float, most: float, block_words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their sources' targets, and the pieces of them that the blocks of the schedule hold."""
    sized = durable(docs.select(
        F.monotonically_increasing_id().alias("_id"), F.col(id_col).alias("_doc"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_key"), F.col(source).isNull().alias("_null"),
        F.xxhash64(text).alias("_text_hash"), n_words(F.col(text)).alias("size")))
    sources = source_targets(sized, weights, share, most)
    known = join_counted(sized, sources, ["_key", "_null"], "documents").withColumn("_shuffled", F.xxhash64(F.lit(seed), "_doc"))
    known = durable(known.select("_id", "_doc", "_key", "_null", "_text_hash", "size", "at", "source_size", "target", "words", "_shuffled"))
    placed = running_total(known.select("_id", "at", "_shuffled", "size"), ["at"], F.col("_shuffled"), "size", "start").select("_id", "start")
    epochs = known.join(placed, "_id").where("size > 0").withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("long") for e in range(int(np.ceil(most)))])))
    at = F.col("epoch") * F.col("source_size") + F.col("start")
    pieces = epochs.select("_id", "at", at.alias("a"), F.least(at + F.col("size"), F.col("words")).alias("b")).where("a < b")
    b = F.lit(block_words).cast("long")
    block = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / b), F.floor((F.col("b") - 1) / b))))
    first = F.greatest("a", F.col("rank") * b)
    block = block.select("_id", "at", "rank", (first - F.col("a")).alias("start"), (F.least("b", (F.col("rank") + 1) * b) - first).alias("words"))
    slots = schedule(sources.withColumn("blocks", F.ceil(F.col("words") / b)))
    return known, block.join(slots, ["at", "rank"]).select("_id", "slot", "rank", "start", "words")


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
        most: float = 2.0, block_words: int = 256, seed: int = 42) -> DataFrame:
    """How many words the mix takes of each document: id, source, size, source_size, target, taken, first_slot.

    Each source's documents, shuffled by a hash of their ids, form one stream, which is read again from
    its start when it ends and is cut into blocks of ``block_words`` words. The schedule takes block
    after block; the last one is cut where the source's target is met, so a source's taken words are its
    target, rounded, and no document is taken more than ``most`` times. The same input gives the same
    mix. ``first_slot`` is where the mix first reads of the document; ``mix_blocks`` has all of them.

    Null texts have size 0 and are taken 0 times; a null source is a source of its own, last. Any number of
    sources will do. Repeated rows are separate documents; ties in the shuffle are settled by the row.
    Long texts are cut over many blocks. An empty table gives an empty result. Other columns play no
    part, whatever their names.
    """
    known, pieces = _mixture(docs, id_col, source, text, weights, share, most, block_words, seed)
    taken = pieces.groupBy("_id").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return known.join(taken, "_id", "left").select(F.col("_doc").alias(id_col), F.when(~F.col("_null"), F.col("_key")).alias("source"), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot", "_text_hash", F.col("_id").alias("_row"))


def mix_blocks(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
               most: float = 2.0, block_words: int = 256, seed: int = 42) -> DataFrame:
    """The mix itself: (slot, source, rank, id, start, words), to be read by slot.

    Block ``rank`` of a source is read at ``slot``; it holds ``words`` words from word ``start`` of each of
    its documents on. See ``mix``.
    """
    known, pieces = _mixture(docs, id_col, source, text, weights, share, most, block_words, seed)
    name = known.select("_id", F.col("_doc").alias(id_col), F.when(~F.col("_null"), F.col("_key")).alias("source"))
    return pieces.join(name, "_id").select("slot", "source", "rank", id_col, "start", "words")
