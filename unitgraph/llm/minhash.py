"""Near-duplicate documents by bottom-k sketches, with links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitgraph.llm.common import as_bytes, join_counted, slices
from unitgraph.plans.durable import durable

SKETCH = 64
#: Values of a longer sketch, for documents that meet on long lists only.
LONG_SKETCH = 512
#: Similarity of linked sets, in hundredths.
PERCENT = 80
#: The longest inverted list whose pairs are formed directly.
SHORT = 32
#: Members of a group of long lists that one task compares with those outside its largest component.
BLOCK = 256
#: Words of 64 bits in a set's parities.
PARITIES = 32
#: Standard deviations below its mean at which a linked pair's estimate is still taken.
SPREAD = 6.2


class _Hashes(dict):
    """64-bit hashes of words; a bounded memory of those met before."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 250_000:
            self[word] = h
        return h


def shingle_set(text: bytes, n: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's n-word shingles, ASCII letters lower-cased.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    words = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h.view(np.int64)
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        x = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            x = (x ^ h[i : i + len(x)]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    x = np.sort(x >> np.uint64(1))
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep].view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(values) + 1, np.int32)
    ends[1:] = np.cumsum([len(v) for v in values])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def sketches(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(_id, _doc, _text_hash, size, h1, h2, sketch): set size, a 128-bit hash of the set, its k least values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in slices(batches):
            sets = [shingle_set(t, n, hashes) for t in as_bytes(b.column("_text"))]
            ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("_id", "_doc", "_text_hash")], pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[:, 0].astype(np.int64)), pa.array(ids[:, 1].astype(np.int64)), _lists([s[:k] for s in sets])],
                names=["_id", "_doc", "_text_hash", "size", "h1", "h2", "sketch"])

    return docs.mapInArrow(run, "_id long, _doc long, _text_hash long, size long, h1 long, h2 long, sketch array<long>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(_id, full): the whole shingle set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("_id"), _lists([shingle_set(t, n, hashes) for t in as_bytes(b.column("_text"))])], names=["_id", "full"])

    return docs.select("_id", "_text").mapInArrow(run, "_id long, full array<long>")


def parities(full: DataFrame) -> DataFrame:
    """(_id, p0, p1, ...): for each of 64 * PARITIES classes of hashes whether the set has an odd number of them.

    Each value that only one of two sets holds turns one bit, so two sets' bits differ in no more places
    than the sets do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ends, values = b.column("full").offsets.to_numpy(), b.column("full").values.to_numpy()
            odd = [np.bincount(values[i:j] & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1 for i, j in zip(ends, ends[1:])]
            words = np.packbits(np.array(odd, np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), *map(pa.array, words.T)], names=["_id", *(f"p{i}" for i in range(PARITIES))])

    return full.select("_id", "full").mapInArrow(run, ", ".join(["_id long", *(f"p{i} long" for i in range(PARITIES))]))


def least_shared(k: int) -> int:
    """Values that the bottom-k sketches of two linked sets share, but for a chance of about 1e-8.

    Of the k least values of the union each is in both sets with a probability of 0.8 or more, and all of
    those are in both sketches.
    """
    return floor(PERCENT / 100 * k - SPREAD * sqrt(k * PERCENT * (100 - PERCENT) / 10_000))


def rare_prefix(sketched: DataFrame, k: int) -> DataFrame:
    """Of each document's sketch the rarest values, as many as a linked document can not avoid altogether.

    ``sketched``: (_id, size, sketch), durable. Two sketches that share at least s values have one in
    common among the first (held - s + 1) of each, in any order common to both; the rarest first gives
    the shortest lists. A set whose partners are all whole in their sketches needs the exact overlap.
    Returns (_id, size, value, place), place counting from 0 in that order. Values that one document holds
    alone come first in it and are not returned.
    """
    size, held = F.col("size"), F.least(F.col("size"), F.lit(k).cast("long"))
    exact = F.ceil(size * PERCENT / F.lit(100))
    need = F.when(100 * size < PERCENT * (k + 1), exact).otherwise(F.least(exact, F.lit(least_shared(k)).cast("long")))
    postings = sketched.select("_id", "size", F.explode("sketch").alias("value"))
    df = durable(postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    known = join_counted(postings, df, ["value"], "df").groupBy("_id").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs"))
    # Counted before the list is cut: what is left out of it later is not a document's own.
    known = known.select("_id", "size", "vs", (held - F.size("vs")).alias("lone"), (held - need + 1).alias("length"))
    cut = known.withColumn("vs", F.slice("vs", 1, F.greatest(F.lit(0), F.col("length") - F.col("lone")).cast("int")))
    return cut.select("_id", "size", "lone", F.posexplode("vs").alias("p", "v")).select("_id", "size", F.col("v.value").alias("value"), (F.col("p") + F.col("lone")).alias("place"))


def with_list_size(lists: DataFrame) -> DataFrame:
    """``lists``, durable, with the length ``n`` of each value's list, where that is 2 or more."""
    n = durable(lists.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return join_counted(lists, n, ["value"], "n")


def pairs_within(lists: DataFrame, k: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of documents on one list that can be linked; lists are short."""
    x, y = lists.alias("x"), lists.alias("y")
    same = (F.col("x.value") == F.col("y.value")) & (F.col("x._id") < F.col("y._id")) & can_link(k)
    return x.join(y, same).select(F.col("x._id").alias("a"), F.col("y._id").alias("b")).distinct()


def can_link(k: int) -> Column:
    """Whether x and y, met on a value, are similar enough in size and can still share enough from there on."""
    a, b = F.col("x.size"), F.col("y.size")
    fit = 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)
    left = F.least(F.least(a, F.lit(k)) - F.col("x.place"), F.least(b, F.lit(k)) - F.col("y.place"))
    whole = F.greatest(a, b) <= k
    return fit & F.when(whole, (100 + PERCENT) * left >= PERCENT * (a + b)).otherwise(left >= least_shared(k))


def estimate(pairs: DataFrame, sketched: DataFrame, k: int) -> DataFrame:
    """Pairs that may be linked by the share of the union's k least values that both hold.

    Two sets that are whole in their sketches are judged exactly. For others the bar is SPREAD standard
    deviations below the similarity of a link; the k values are drawn from a union of at most
    (a + b) / 1.8, so the deviation shrinks as the sketch nears the whole.
    """
    s = sketched.select("_id", "size", "sketch")
    both = pairs.join(s.select(F.col("_id").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("_id").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("sb")), "b")
    whole, least = F.greatest("na", "nb") <= k, F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    both = both.withColumn("shared", F.when(whole, F.size(F.array_intersect("sa", "sb"))).otherwise(F.size(F.array_intersect(F.array_intersect("sa", "sb"), least))))
    exact = 100 * F.col("shared") >= PERCENT * (F.col("na") + F.col("nb") - F.col("shared"))
    part = F.greatest(F.lit(0.0), 1 - k / ((F.col("na") + F.col("nb")) * 100 / (100 + PERCENT)))
    bar = PERCENT / 100 * k - SPREAD * F.sqrt(F.lit(k * PERCENT * (100 - PERCENT) / 10_000) * part) - 1
    return both.where(F.when(whole, exact).otherwise(F.col("shared") >= bar)).select("a", "b")


def verify(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs with 100 * intersection >= 80 * union, on full sets."""
    both = pairs.join(full.select(F.col("_id").alias("a"), F.col("full").alias("fa")), "a").join(full.select(F.col("_id").alias("b"), F.col("full").alias("fb")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("fa", "fb")))
    return both.where(100 * F.col("common") >= PERCENT * (F.size("fa") + F.size("fb") - F.col("common"))).select("a", "b")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node each linked node can reach.

    Each round takes the least label among neighbours, then the label of that label, so long chains
    shrink by more than half a round. Raises rather than return an unfinished answer.
    """
    edges = durable(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    label = durable(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("component")).withColumnRenamed("u", "node"))
    for _ in range(max_rounds):
        near = edges.join(label, edges["v"] == label["node"]).groupBy("u").agg(F.min("component").alias("near"))
        lower = label.join(near, label["node"] == near["u"]).select("node", "component", F.least("component", "near").alias("least"))
        up = lower.select(F.col("node").alias("k"), F.col("least").alias("jump"))
        step = lower.join(up, lower["least"] == up["k"], "left").select("node", F.least("least", F.coalesce("jump", "least")).alias("component"), F.col("component").alias("before"))
        step = durable(step)
        label = step.select("node", "component")
        if not step.where("component < before").limit(1).count():
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def parted(rows: DataFrame, key: str) -> DataFrame:
    """Of keys whose rows are in several components: the largest of them, its rows, and the key's."""
    sizes = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("c")).groupBy(key)
    return sizes.agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.max("c").alias("most"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("members")).where("parts > 1").drop("parts")


def open_groups(placed: DataFrame, hub: DataFrame) -> DataFrame:
    """(_id, size, component, key, largest, members): long lists whose members are in several components.

    ``placed``: (_id, size, value, component), ``hub``: (value, hub, members), both durable. The values of a
    template are held by much the same documents and have the same hub: lists of one hub are one group, in
    which a pair meets once and not for each value, if that makes no more pairs than the lists apart.
    """
    at_hub = durable(join_counted(placed.select("_id", "size", "value", "component"), hub, ["value"], "members").select("hub", "_id", "size", "component").distinct())
    apart, together = durable(parted(placed, "value")), durable(parted(at_hub, "hub"))
    pairs = F.col("members") * (F.col("members") - F.col("most"))
    costs = apart.select("value", pairs.alias("cost")).join(hub.select("value", "hub"), "value").groupBy("hub").agg(F.sum("cost").alias("cost"))
    merged = durable(together.join(costs, "hub").where(pairs <= F.col("cost")).select("hub", "largest", "members"))
    # A value is not negative, nor is an id.
    alone = durable(apart.join(hub.select("value", "hub"), "value").join(merged.select("hub"), "hub", "left_anti").select("value", "largest", "members"))
    columns = ["_id", "size", "component", "key", "largest", "members"]
    of_hubs = join_counted(at_hub, merged, ["hub"], "members").withColumn("key", -1 - F.col("hub")).select(columns)
    of_values = join_counted(placed.select("_id", "size", "value", "component"), alone, ["value"], "members").withColumnRenamed("value", "key").select(columns)
    return of_hubs.unionByName(of_values)


def pairs_apart(groups: DataFrame, full: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a group's members in different components that their parities let be linked.

    Linked sets differ in at most (a + b) * (100 - PERCENT) / (100 + PERCENT) values, so this loses none.
    Members outside the largest component are compared with all, in blocks; only pairs near enough become rows.
    """
    open_ = groups.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).join(parities(full), "_id")
    open_ = durable(open_)
    y = open_.withColumn("block", F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int")).alias("y")
    x = open_.where("component != largest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    a, b = F.col("x.size"), F.col("y.size")
    fit = 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)
    unlike = sum((F.bit_count(F.col(f"x.p{i}").bitwiseXOR(F.col(f"y.p{i}"))) for i in range(1, PARITIES)), F.bit_count(F.col("x.p0").bitwiseXOR(F.col("y.p0"))))
    near = fit & ((100 + PERCENT) * unlike <= (100 - PERCENT) * (a + b))
    once = (F.col("y.component") == F.col("y.largest")) | (F.col("x._id") < F.col("y._id"))
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.component") != F.col("y.component"))
    return x.join(y, apart & once & near).select(F.least("x._id", "y._id").alias("a"), F.greatest("x._id", "y._id").alias("b")).distinct()


def link_long_lists(full: DataFrame, known: DataFrame, k: int = LONG_SKETCH) -> DataFrame:
    """(node, component) of ``known`` and of the documents of ``full``, which met on lists too long for all pairs.

    The same method with a longer sketch: whole for most documents, and its estimate is sharp enough to
    leave few pairs for the full sets. Values are ordered by their number among these documents only,
    which pushes what a group of copies shares to the end. A list still long is first linked to one hub,
    the member that holds least of its own, which makes one component of a group of near copies. Then
    only members outside the largest component of a list, or of all lists of a hub, are tried against those
    of other components, in blocks, so a hot value is many tasks' work. Components come out the same as from
    all pairs.

    Documents of one template that are not linked have to be told apart pair by pair: this is the one
    step whose work is not linear in the input. It compares 256 bytes a pair, within the join, and makes
    rows only of pairs that these bits let be linked.
    """
    sketched = durable(full.select("_id", F.size("full").cast("long").alias("size"), F.slice("full", 1, k).alias("sketch")))
    lists = durable(with_list_size(durable(rare_prefix(sketched, k))))
    short, long_ = lists.where(F.col("n") <= SHORT), lists.where(F.col("n") > SHORT)
    own = (F.lit(0) - F.col("place") / F.col("size")).alias("own")
    hub = durable(long_.groupBy("value").agg(F.max_by("_id", F.struct(own, (-F.col("_id")).alias("id"))).alias("hub"), F.first("n").alias("members")))
    to_hub = join_counted(long_, hub, ["value"], "members").where("_id != hub").select(F.least("_id", "hub").alias("a"), F.greatest("_id", "hub").alias("b"))
    met = pairs_within(short, k).unionByName(to_hub).distinct()
    part = components(verify(durable(estimate(met, sketched, k)), full).unionByName(known))
    placed = durable(long_.join(part, long_["_id"] == part["node"], "left").withColumn("component", F.coalesce("component", "_id")).drop("node"))
    rest = pairs_apart(open_groups(placed, hub), full)
    more = durable(verify(durable(estimate(rest, sketched, k)), full))
    # Components found later join those found before.
    name = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    between = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    over = components(between)
    every = part.unionByName(over.join(part, "node", "left_anti"))
    late = over.select(F.col("node").alias("component"), F.col("component").alias("over"))
    return every.join(late, "component", "left").select("node", F.coalesce("over", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, k: int = SKETCH) -> DataFrame:
    """Per document: n_shingles, component_id and kept.

    Documents are linked at a Jaccard similarity of 0.8 or more of their shingle sets; a component is
    what links reach. Equal sets are one class first, so copies cost nothing. Each class keeps a
    bottom-k sketch from one hash function. Two sets at 0.8 share 31 values of 64 (but for a chance of
    1e-8), so an inverted list over each sketch's rarest values finds every pair: short lists give pairs,
    which the estimate on the union's sketch filters and full sets confirm; what meets on longer lists
    goes to ``link_long_lists``, the same with a longer sketch. Sets of few shingles are whole in their
    sketch, and exact throughout.

    Null and empty texts have no shingles and are linked with nothing. Repeated rows are copies; of
    copies with one id all have the same verdict. Long texts are taken whole. A null id is never a
    component's id unless all ids in it are null. An empty table gives an empty result; other columns play
    no part, whatever their names. Returns id, n_shingles, component_id, kept, _text_hash and _class, which
    is one for linked rows whatever their ids, and a row's own without shingles.
    """
    source = docs.select(F.monotonically_increasing_id().alias("_id"), F.col(id_col).cast("long").alias("_doc"), F.xxhash64(text).alias("_text_hash"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sketched = durable(sketches(source, shingle, k))
    classes = durable(sketched.where("size > 0").groupBy("h1", "h2").agg(F.min("_id").alias("rep"), F.min("_doc").alias("least_doc"), F.count(F.lit(1)).alias("members")))
    reps = durable(sketched.join(classes.select(F.col("rep").alias("_id")), "_id", "left_semi"))
    lists = durable(with_list_size(durable(rare_prefix(reps.select("_id", "size", "sketch"), k))))
    near = durable(estimate(pairs_within(lists.where(F.col("n") <= SHORT), k), reps, k))
    met = lists.where(F.col("n") > SHORT).select("_id").distinct()
    wanted = near.select(F.col("a").alias("_id")).unionByName(near.select(F.col("b").alias("_id"))).unionByName(met).distinct()
    keys = reps.join(wanted, "_id", "left_semi").select("_id", "_doc", "_text_hash")
    texts = source.drop("_id").join(keys, source["_doc"].eqNullSafe(keys["_doc"]) & (source["_text_hash"] == keys["_text_hash"])).select("_id", "_text").dropDuplicates(["_id"])
    full = durable(full_sets(texts, shingle))
    part = link_long_lists(full.join(met, "_id", "left_semi"), durable(verify(near, full)))
    mapped = durable(classes.join(part, classes["rep"] == part["node"], "left").withColumn("component", F.coalesce("component", "rep")).select("h1", "h2", "component", "least_doc", "members"))
    ids = durable(mapped.groupBy("component").agg(F.min("least_doc").alias("component_id"), F.count(F.lit(1)).alias("classes")))
    named = durable(join_counted(mapped.drop("least_doc"), ids, ["component"], "classes").drop("classes"))
    slim = sketched.select("_id", "_doc", "_text_hash", "size", "h1", "h2")
    linked = join_counted(slim.where("size > 0"), named, ["h1", "h2"], "members").select("_id", "_doc", "_text_hash", "size", "component", "component_id")
    bare = slim.where("size = 0").select("_id", "_doc", "_text_hash", "size", F.col("_id").alias("component"), F.col("_doc").alias("component_id"))
    out = linked.unionByName(bare)
    return out.select(F.col("_doc").alias(id_col), F.col("size").alias("n_shingles"), "component_id", F.col("_doc").eqNullSafe(F.col("component_id")).alias("kept"), "_text_hash", F.col("component").alias("_class"))
