"""How filters overlap: what each removes in any order of all, and what it is answerable for.

A document is known by the set of filters it fails. Counted by that set, any corpus is a table of at most
2**n rows a part, from which follows what each coalition of filters removes; every order's steps are
differences of two coalitions, and the Shapley value is a least-squares fit to all of them.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitgraph.llm.common import SPACE
from unitgraph.plans.durable import durable

FILTERS = "ABCDE"
#: What is counted of documents: all, those labelled good, those labelled toxic.
COUNTS = ("documents", "good", "toxic")


def shapley_weights(n: int) -> list[list[int]]:
    """For each of n filters, the factor of each coalition's removal in n! times its Shapley value.

    Payments p_i are fitted to the removals v(S) by least squares: the sum over S of k(S) (v(S) - sum of
    p_i in S)**2, where k(S) = (n - 1) / (C(n, s) s (n - s)) for the s filters of S, neither none nor
    all, is made least under the condition that all p_i add up to v(all). Its normal equations, with a
    multiplier for the condition, do not depend on v, so they are solved once, in rationals, for every
    v(S) as a right side of its own.
    """
    full = (1 << n) - 1
    kernel = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, full)}
    system = []
    for i in range(n):
        among = {s: w for s, w in kernel.items() if s >> i & 1}
        left = [sum((w for s, w in among.items() if s >> j & 1), Fraction(0)) for j in range(n)]
        system.append([*left, Fraction(1), *[among.get(s, Fraction(0)) for s in range(full + 1)]])
    system.append([*[Fraction(1)] * n, Fraction(0), *[Fraction(s == full) for s in range(full + 1)]])
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if system[r][c])
        system[c], system[pivot] = system[pivot], system[c]
        system[c] = [x / system[c][c] for x in system[c]]
        for r in range(n + 1):
            if r != c and system[r][c]:
                system[r] = [x - system[r][c] * y for x, y in zip(system[r], system[c], strict=True)]
    weights = [[x * factorial(n) for x in row[n + 1 :]] for row in system[:n]]
    assert all(w.denominator == 1 for row in weights for w in row)
    return [[int(w) for w in row] for row in weights]


def coalitions(profile: DataFrame, n: int) -> DataFrame:
    """(part, table): for each part an array, by coalition 0 to 2**n - 1, of what that coalition removes.

    ``profile``: (part, mask, documents, good, toxic), ``mask`` having bit i for filter i failed. Entries
    are structs of COUNTS. A part's array has 2**n entries, however many documents it stands for.
    """
    every = profile.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    counted = every.groupBy("part", "coalition").agg(*[F.sum(F.when(hit, F.col(c)).otherwise(F.lit(0).cast("long"))).alias(c) for c in COUNTS])
    table = F.array_sort(F.collect_list(F.struct("coalition", *COUNTS)))
    return counted.groupBy("part").agg(table.alias("table"))


def orders(profile: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of all filters and step, with counts of the documents of the part.

    Returns (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley), as described at ``audit``. A filter is one letter; a part without documents has no rows.
    """
    n = len(filters)
    full = (1 << n) - 1
    before, after, which, names = [], [], [], []
    for order in permutations(range(n)):
        names.append("".join(filters[i] for i in order))
        done = 0
        for i in order:
            before.append(done)
            done |= 1 << i
            after.append(done)
            which.append(i)
    total = profile.groupBy("part").agg(F.sum("documents").alias("total"))
    table = coalitions(profile, n).join(total, "part")
    ints = lambda xs: F.array(*map(F.lit, xs))
    removed_by = F.transform("table", lambda x: x["documents"])
    value = lambda w: F.aggregate(F.zip_with(removed_by, ints(w).cast("array<bigint>"), lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x)
    table = table.withColumn("values", F.array(*[value(w) for w in shapley_weights(n)])).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(which) - 1))))
    at = lambda xs: F.get(ints(xs), F.col("k"))
    row = table.select("part", "total", "table", "values", F.get(F.array(*map(F.lit, names)), F.floor(F.col("k") / n).cast("int")).alias("filter_order"), (F.col("k") % n + 1).cast("int").alias("step"), at(before).alias("before"), at(after).alias("after"), at(which).alias("which"))
    bit = F.get(ints([1 << i for i in range(n)]), F.col("which"))
    of = lambda s, c: F.get("table", s)[c]
    lost = lambda c: of(F.col("after"), c) - of(F.col("before"), c)
    return row.select(
        "part", "filter_order", "step", (F.col("total") - of(F.col("after"), "documents")).alias("kept"), lost("documents").alias("removed"),
        (of(bit, "documents") - lost("documents")).alias("redundant"), (of(F.lit(full), "documents") - of(F.lit(full) - bit, "documents")).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("values", F.col("which")).alias("shapley"))


def text_failures(text: Column, min_words: int = 200, distinct_pct: int = 50, capital_pct: int = 2, symbols: str = "#$%&*|") -> Column:
    """Bits of the filters A to D that a text fails: few words, few distinct ones, many capitals, any of the symbols."""
    body = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"{SPACE}+"))
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]", ""))
    fails = (n < min_words, 100 * F.size(F.array_distinct(words)) < distinct_pct * n, 100 * capitals.cast("long") > capital_pct * F.length(text), text.rlike("[" + "".join("\\" + s for s in symbols) + "]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def fail_profile(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source", **limits: object) -> DataFrame:
    """(part, mask, documents, good, toxic): documents by the set of filters that they fail, as bits A to E.

    A to D look at a text alone. E, a copy of a document with a smaller id, is found by digests: a text's
    rows are counted by id, then by part, mask and label, so copies are added up before they meet, and
    all of them fail but those with the text's least id.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    thin = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("_text"), text_failures(body, **limits).alias("mask"))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    zero = F.lit(0)
    rows = thin.join(marked, "_doc", "left").select("_doc", "part", "_text", "mask", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    kinds = ["_text", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("_doc", *kinds).agg(F.count(zero).alias("n"))
    named = F.col("_doc").isNotNull()
    copies = durable(by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(~named, F.col("n")).otherwise(zero)).alias("unnamed"), F.min(F.when(named, F.struct("_doc", "n"))).alias("first")))
    least = copies.groupBy("_text").agg(F.min("first._doc").alias("least"))
    first = copies.join(least, "_text").withColumn("fine", F.col("unnamed") + F.when(F.col("first._doc") == F.col("least"), F.col("first.n")).otherwise(zero))
    split = first.select("part", "good", "toxic", F.inline(F.array(F.struct("mask", F.col("fine").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("fine")).alias("n")))))
    return split.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source", **limits: object) -> DataFrame:
    """Five filters in all 120 orders over each part of a corpus.

    A fails under 200 words; B where under half of the words are distinct; C where more than 2 in 100
    code points are capitals A-Z; D where any of ``#$%&*|`` stands; E where a smaller id has the same
    text, in any part, removed or not. One row per part, filter_order and step, zeros included, with the
    part's documents that are kept after the step, removed by it, redundant (fail its filter but went
    before), unique_fails (fail no other filter), good_lost and toxic_lost (removed, by ``labels``), and
    shapley (removals by its filter summed over all orders, its Shapley value times 120).

    A null text is empty; a null part is the part ''. Rows with one id and text are documents of their
    own, and none is a copy of another of them; a row with a null id is neither a copy nor copied, and
    has no label. Of several labels of an id any 1 counts, null is no label. An empty table gives no
    rows. Texts are judged whole; other columns play no part, whatever their names.
    """
    return orders(fail_profile(docs, labels, id_col, text, part, **limits))

