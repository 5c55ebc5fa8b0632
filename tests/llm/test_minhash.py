"""Near-duplicates against brute force on pages of one template and on groups of copies."""

import numpy as np
import pytest

from unitgraph.llm import minhash


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n)]


def pages_of_a_template(seed, n, keep=0.82, own=0):
    """Pages that share most of a template's sentences without being linked, each with one near copy."""
    rng = np.random.default_rng(seed)
    template = [" ".join(words(rng, 10)) for _ in range(60)]
    out = []
    for _ in range(n):
        page = [s for s in template if rng.random() < keep] + [" ".join(words(rng, own))] * bool(own)
        out.append(" ".join(page))
        near = [s for s in page if rng.random() < 0.93]
        out.append(" ".join([*near, *words(rng, 3)]))
    return out


def brute(texts, n):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    at = list(range(len(texts)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    links = 0
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = sorted((top(a), top(b)))
                at[y] = x
    return [top(i) for i in range(len(texts))], links


def components(spark, texts, n):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, shingle=n).collect()}
    return [out[i] for i in range(len(texts))]


@pytest.mark.parametrize("n,own,pages", [(1, 0, 30), (2, 0, 70), (5, 0, 40), (2, 60, 40)])
def test_pages_of_one_template(spark, monkeypatch, n, own, pages):
    """None lost, none invented, and on long lists few pairs reach the full sets."""
    monkeypatch.setattr(minhash, "SHORT", 4)
    texts = pages_of_a_template(17 + n, pages, own=own)
    expected, links = brute(texts, n)
    seen = []
    verify = minhash.verify
    monkeypatch.setattr(minhash, "verify", lambda pairs, full: (seen.append(pairs.count()), verify(pairs, full))[1])
    assert components(spark, texts, n) == expected
    assert len(set(expected)) > 10
    assert sum(seen) < len(texts) * (len(texts) - 1) / 8 + 2 * links


def test_long_texts_of_one_template(spark, monkeypatch):
    """Sets longer than either sketch, on long lists."""
    monkeypatch.setattr(minhash, "SHORT", 4)
    rng = np.random.default_rng(3)
    base, texts = words(rng, 1500), []
    for _ in range(30):
        w = list(base)
        for k in rng.choice(1500, int(rng.integers(20, 220)), replace=False):
            w[k] = words(rng, 1)[0]
        texts.append(" ".join(w))
    assert components(spark, texts, 2) == brute(texts, 2)[0]


def test_places_of_rare_values(spark):
    """Places count a document's own values and those held by several, but not those cut off."""
    rows = [(1, 3, [1, 2, 3]), (2, 3, [1, 2, 3]), (3, 3, [1, 2, 4])]
    df = spark.createDataFrame(rows, "_id long, size long, sketch array<long>")
    got = sorted((r["_id"], r["value"], r["place"]) for r in minhash.rare_prefix(df, 64).collect())
    assert got == [(1, 3, 0), (2, 3, 0)]


@pytest.mark.parametrize("block", [8, 256])
def test_unlinked_pages_of_a_template_make_few_rows(spark, monkeypatch, block):
    """On long lists only pairs near enough to be links become rows, and none of those is lost."""
    monkeypatch.setattr(minhash, "SHORT", 4)
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = pages_of_a_template(5, 60)
    expected, links = brute(texts, 2)
    seen, estimate = [], minhash.estimate
    monkeypatch.setattr(minhash, "estimate", lambda pairs, sketched, k: (seen.append(pairs.count()), estimate(pairs, sketched, k))[1])
    assert components(spark, texts, 2) == expected
    assert seen[-1] <= links


def test_parities_differ_in_no_more_places_than_sets(spark):
    rng = np.random.default_rng(2)
    base = [int(v) for v in rng.integers(0, 1 << 63, 500)]
    sets = [base, base[3:], base[:100], base[100:], [*base, *(int(v) for v in rng.integers(0, 1 << 63, 90))]]
    full = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "_id long, full array<long>")
    bits = {r["_id"]: [v & (2**64 - 1) for v in r[1:]] for r in minhash.parities(full).collect()}
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            unlike = sum((x ^ y).bit_count() for x, y in zip(bits[i], bits[j]))
            apart = len(set(s) ^ set(t))
            assert unlike <= apart and (apart - unlike) % 2 == 0 and unlike > 0.7 * apart - 1


def test_lists_of_one_hub_are_one_group_where_that_makes_fewer_pairs(spark):
    """Values with the same members meet once; lists that share no more than their hub stay apart."""
    same = [(i, 50, v, c) for v in (1, 2, 3) for i, c in [(10, 10), (11, 10), (12, 12)]]
    unlike = [(20, 50, 4, 20), (21, 50, 4, 21), (20, 50, 5, 20), (22, 50, 5, 22)]
    placed = spark.createDataFrame(same + unlike, "_id long, size long, value long, component long")
    hub = spark.createDataFrame([(1, 10, 3), (2, 10, 3), (3, 10, 3), (4, 20, 2), (5, 20, 2)], "value long, hub long, members long")
    got = {(r["key"], r["_id"]) for r in minhash.open_groups(placed, hub).collect()}
    assert got == {(-11, 10), (-11, 11), (-11, 12), (4, 20), (4, 21), (5, 20), (5, 22)}
