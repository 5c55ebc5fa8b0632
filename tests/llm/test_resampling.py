"""Importance resampling against a plain reading of every n-gram."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from unitgraph.llm import resampling

SHIFT = resampling.Shift()
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))


def buckets(t):
    w = words(t)
    return Counter(crc32(b" ".join(w[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def brute(docs, target):
    s, t = (sum(map(buckets, x), Counter()) for x in ([d for _, d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, d in docs:
        b = buckets(d)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] * n for k, n in b.items())
        rows.append([i, len(words(d)), sum(b.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = {id(r): k + 1 for k, r in enumerate(order[: 5 * len(order) // 100])}
    return sorted(((r[0], r[2], r[3], r[4], drawn.get(id(r))) for r in rows), key=repr)


def prose(rng, n, letters="abcdXY01é日"):
    return " ".join("".join(rng.choice(list(letters), rng.integers(1, 4))) for _ in range(n))


def test_resample(spark):
    rng = np.random.default_rng(3)
    docs = [(k, prose(rng, int(rng.integers(10, 60)))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, " .,\n"), (503, "One"), (504, "A--b\tC"), (None, prose(rng, 30)), (None, docs[3][1]), (7, docs[7][1]), (505, docs[8][1]), (506, prose(rng, 40_000)), (507, "x" * 5000 + " y " + "z" * 300)]
    target = [prose(rng, 40, "abX"), None, "", prose(rng, 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    read = lambda d: sorted((tuple(r) for r in resampling.resample(d, goal).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    want = brute(docs, target)
    assert read(frame.repartition(5)) == want
    assert sum(r[4] is not None for r in want) == 5 * sum(len(words(d)) >= 20 for _, d in docs) // 100 > 3
    wide = frame.select("*", *[F.lit("clash").alias(c) for c in ("bucket", "n", "s", "t", "weight", "score", "rank", "_rank", "_in", "_text", "n_words", "item_id")])
    assert read(wide) == want
    assert resampling.resample(frame.limit(0), goal).collect() == []


def test_empty_target(spark):
    docs = [(k, prose(np.random.default_rng(k), 25)) for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = resampling.resample(frame, spark.createDataFrame([], "item_id long, text string")).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, out), key=repr) == brute(docs, [])


@pytest.mark.parametrize(("flush", "piece"), [(1 << 15, 1 << 20), (5, 7), (1, 3), (2, 1)])
def test_runs_across_pieces(monkeypatch, flush, piece):
    """However texts are cut into pieces and batches, each run of words is met once, with its own CRC."""
    monkeypatch.setattr(resampling, "FLUSH", flush)
    monkeypatch.setattr(resampling, "PIECE", piece)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcXYZ019 .,-é日 \n"), rng.integers(0, 200))) for _ in range(60)] + ["", "a" * 500 + " b " + "c" * 3000 + " d"]
    found = [Counter() for _ in texts]

    def use(of, bucket):
        for k, b in zip(of.tolist(), bucket.tolist(), strict=True):
            found[k][b] += 1

    features = resampling.Features(use)
    counts = [features.read(k, t.encode()) for k, t in enumerate(texts)]
    features.flush()
    assert found == [buckets(t) for t in texts]
    assert counts == [len(words(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=3000))
def test_crc_of_a_run_from_two_prefixes(head, run):
    start = np.array([crc32(head)], np.uint32)
    cut = [(start >> np.uint32(8 * k) & 255).astype(np.int64) for k in range(4)]
    shifted = SHIFT.over(start, cut, np.array([len(run)]))
    assert int(crc32(head + run) ^ int(shifted[0])) == crc32(run)
