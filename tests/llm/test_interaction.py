"""The filter audit against removal one by one, and its weights against every order."""

from itertools import permutations
from math import factorial

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from unitgraph.llm import interaction

WORDS = [f"w{i}" for i in range(300)]
TEXTS = [
    " ".join(WORDS), " ".join(WORDS), " ".join(WORDS[:100] * 3), "a a a a", "", None, "ABC def", " ".join(WORDS) + " $", " ".join(WORDS) + " " + "X" * 200, "a a # A", " \t\n\x0b", "x\x0by\x0cz", "é ß 日本", "a a # A",
    " ".join(["A"] * 250), " ".join(WORDS),
]


def fails(t):
    w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}


def brute(rows, labels):
    """{(part, order, step): counts} by applying the filters one after the other."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    judged = []
    for i, t, p in rows:
        f = fails(t or "")
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
        judged.append((i, p or "", f))
    out = {}
    for part in {p for _, p, _ in judged}:
        mine = [(i, f) for i, p, f in judged if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, c in enumerate(order):
                gone = [x for x in left if x[1][c]]
                left = [x for x in left if not x[1][c]]
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f[c] for _, f in mine) - len(gone), sum(f[c] and sum(f.values()) == 1 for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    total = {}
    for (part, order, k), x in out.items():
        total[part, order[k - 1]] = total.get((part, order[k - 1]), 0) + x[1]
    return {key: (*x, total[key[0], key[1][key[2] - 1]]) for key, x in out.items()}


def audited(spark, rows, labels, wide=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if wide:
        docs = docs.select("*", *[F.lit("clash").alias(c) for c in ("part", "mask", "good", "toxic", "n", "_doc", "_text", "k", "table", "which", "quality")])
    out = interaction.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in out.collect()}


def test_audit(spark):
    """Copies across parts, null ids, texts and parts, repeated rows, an id with several labels."""
    rows = [(k, t, ["a", "b", None, ""][k % 4]) for k, t in enumerate(TEXTS)]
    rows += [(None, TEXTS[0], "a"), (None, TEXTS[0], "a"), (0, TEXTS[0], "b"), (0, TEXTS[0], "b"), (3, "a a a a", "a"), (40, "long " * 60_000, "b")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 16)] + [(3, None, None), (None, 1, 1), (4, 1, None), (4, 0, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    want = brute(rows, labels)
    assert audited(spark, rows, labels) == want
    assert audited(spark, rows, labels, wide=True) == want
    assert len(want) == 3 * 600
    assert audited(spark, [], labels) == {}


def test_one_text_holds_most_rows(spark):
    rows = [(i, "same #" if i % 3 else f"own {i}", "s") for i in range(600)]
    out = audited(spark, rows, [])
    assert out["s", "EABCD", 1][:2] == (201, 399)
    assert out["s", "DEABC", 2][1] == 0 and out["s", "DEABC", 2][2] == 399


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.data())
def test_weights(n, data):
    """Least squares gives what the average over all orders gives, for any removals."""
    masks = data.draw(st.lists(st.integers(0, 2**n - 1), max_size=12))
    v = [sum(bool(m & s) for m in masks) for s in range(2**n)]
    by_order = [0] * n
    for order in permutations(range(n)):
        done = 0
        for i in order:
            by_order[i] += v[done | 1 << i] - v[done]
            done |= 1 << i
    weights = interaction.shapley_weights(n)
    assert [sum(w * x for w, x in zip(row, v, strict=True)) for row in weights] == by_order
    assert sum(by_order) == factorial(n) * v[-1]
