"""Removing passages that an earlier document holds, with a count-min prefilter."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitgraph.llm.common import as_bytes, join_counted, partitions, slices
from unitgraph.llm.minhash import _Hashes
from unitgraph.plans.durable import durable

#: Bits: counters in one row of one segment of the sketch.
BITS = 16
#: Bytes of text that hold a run of windows, at the least: 13 words of two letters and a space.
RUN_BYTES = 40
DEPTH = 3
#: Each segment's rows are dealt over so many tasks, so that one common passage is not one task's work.
SALTS = 8
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two adjoining pieces from the pieces' hashes."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(ODD[0])) ^ (b + np.uint64(ODD[2]))
        x ^= x >> np.uint64(31)
        x *= np.uint64(ODD[1])
        return x ^ (x >> np.uint64(29))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, from powers of two of them."""
    out, length, power, size = None, 0, h, 1
    while True:
        if n & size:
            out = power if out is None else _join(out[: len(h) - (length + size) + 1], power[length : length + len(h) - (length + size) + 1])
            length += size
        if length == n:
            return out
        power, size = _join(power[:-size], power[size:]), 2 * size


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return x if size == n else np.minimum(x[: len(x) - (n - size)], x[n - size :])


@dataclass
class Windows:
    """The windows of one text: their hashes, and each one's anchor, the least hash of half as long a gram in it."""

    hashes: np.ndarray
    anchors: np.ndarray

    @staticmethod
    def of(text: bytes, size: int, known: _Hashes) -> Windows | None:
        words = text.split()
        if len(words) < size:
            return None
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        half = size // 2
        return Windows(grams(h, size), sliding_min(grams(h, half), size - half + 1))


def segment_of(anchors: np.ndarray, segments: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = anchors * np.uint64(ODD[3])
    return ((x ^ (x >> np.uint64(29))) % np.uint64(segments)).astype(np.int64)


def counters(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    """An anchor's counter in a row of its segment."""
    with np.errstate(over="ignore"):
        return ((anchors * np.uint64(ODD[row])) >> np.uint64(64 - bits)).astype(np.int64)


RUN = ("_doc", "_hash", "anchor", "span", "start", "n", "once")


def finder(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of texts (_doc, _hash, _text) to batches of RUN: runs of consecutive windows with one anchor.

    ``span`` hashes the ``n`` windows from word ``start`` on; ``once`` marks an anchor's first run in its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in slices(batches):
            which, anchor, span, start, n, once = [], [], [], [], [], []
            for i, t in enumerate(as_bytes(b.column("_text"))):
                w = Windows.of(t, size, known)
                if w is None:
                    continue
                cut = np.concatenate([[0], np.flatnonzero(w.anchors[1:] != w.anchors[:-1]) + 1])
                length = np.diff(np.append(cut, len(w.anchors)))
                with np.errstate(over="ignore"):
                    span.append(_join(np.add.reduceat(_join(w.hashes, w.hashes), cut), length.astype(np.uint64)))
                a = w.anchors[cut]
                first = np.zeros(len(a), bool)
                first[np.unique(a, return_index=True)[1]] = True
                which.append(np.full(len(a), i))
                anchor.append(a)
                start.append(cut)
                n.append(length)
                once.append(first)
            if which:
                at = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([b.column("_doc").take(at), b.column("_hash").take(at), *[pa.array(np.concatenate(x).view(np.int64)) for x in (anchor, span)], *[pa.array(np.concatenate(x).astype(np.int32)) for x in (start, n)], pa.array(np.concatenate(once))], names=list(RUN))

    return run


def count_min(rows: DataFrame, size: int, segments: int, bits: int = BITS, depth: int = DEPTH, flush: int = 1_000_000) -> DataFrame:
    """A count-min sketch of the documents that hold each anchor: (segment, repeated).

    The sketch has as many segments as the input asks for, each of ``depth`` rows of ``2**bits`` counters,
    and stays distributed. Every task sketches what it reads, as the counters it met once and more often;
    a segment's parts are added up. ``repeated`` holds a bit for each counter of 2 or more.
    """

    def parts(anchors: np.ndarray) -> Iterator[pa.RecordBatch]:
        segment = segment_of(anchors, segments)
        order = np.argsort(segment, kind="stable")
        anchors, segment = anchors[order], segment[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(segment)]])
        ones, more = [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            at, n = np.unique(np.concatenate([counters(anchors[a:b], r, bits) + (r << bits) for r in range(depth)]), return_counts=True)
            ones.append(at[n == 1].astype("<u4").tobytes())
            more.append(at[n > 1].astype("<u4").tobytes())
        for k in range(0, len(ones), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(segment[cut[:-1]][k : k + 1000]), pa.array(ones[k : k + 1000], pa.binary()), pa.array(more[k : k + 1000], pa.binary())], names=["segment", "ones", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = [], 0
        for b in finder(size)(batches):
            seen.append(b.column("anchor").filter(b.column("once")).to_numpy().view(np.uint64))
            n += len(seen[-1])
            if n > flush:
                yield from parts(np.concatenate(seen))
                seen, n = [], 0
        if n:
            yield from parts(np.concatenate(seen))

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(depth << bits, np.uint8)
        for one, more in zip(g["ones"], g["more"], strict=True):
            at = np.frombuffer(one, "<u4")
            total[at] = np.minimum(total[at] + 1, 2)
            total[np.frombuffer(more, "<u4")] = 2
        return pd.DataFrame({"segment": [g["segment"].iloc[0]], "repeated": [np.packbits(total == 2).tobytes()]})

    sketch = rows.select("_doc", "_hash", "_text").mapInArrow(run, "segment long, ones binary, more binary")
    return sketch.groupBy("segment").applyInPandas(add, "segment long, repeated binary")


def estimated_repeated(rows: DataFrame, size: int, sketch: DataFrame, segments: int, bits: int = BITS, depth: int = DEPTH) -> DataFrame:
    """The runs whose anchor is estimated to be in two documents or more.

    Runs meet their segment of the sketch in a shuffle: within a task each segment's bits come first and
    its runs stream past them, so what a task holds is one segment, and nothing is broadcast.
    """
    columns = ["_doc", "_hash", "anchor", "span", "start", "n"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in finder(size)(batches):
            at = segment_of(b.column("anchor").to_numpy().view(np.uint64), segments)
            yield pa.RecordBatch.from_arrays([pa.array(at), *[b.column(c) for c in columns]], names=["segment", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = -1, None
        for b in batches:
            at, keep = b.column("segment").to_numpy(), np.zeros(b.num_rows, bool)
            anchors = b.column("anchor").fill_null(0).to_numpy().view(np.uint64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                if at[lo] != current:
                    current, held = at[lo], np.unpackbits(np.frombuffer(b.column("repeated")[lo].as_py(), np.uint8)).astype(bool)
                    lo += 1
                ok = np.ones(hi - lo, bool)
                for r in range(depth):
                    ok &= held[counters(anchors[lo:hi], r, bits) + (r << bits)]
                keep[lo:hi] = ok
            if keep.any():
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in columns], names=columns)

    kinds = "_doc long, _hash long, anchor long, span long, start int, n int"
    runs = rows.select("_doc", "_hash", "_text").mapInArrow(find, f"segment long, {kinds}")
    some = runs.select("segment", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), F.lit(None).cast("binary").alias("repeated"), *columns)
    bits_ = sketch.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    bits_ = bits_.select("segment", "salt", "repeated", *[F.lit(None).cast(runs.schema[c].dataType).alias(c) for c in columns])
    dealt = some.unionByName(bits_).repartition(partitions(rows), "segment", "salt").sortWithinPartitions("segment", "salt", F.col("repeated").isNull())
    # A task may hold several salts of a segment; each starts with the segment's bits again.
    return dealt.select(F.col("segment") * SALTS + F.col("salt"), "repeated", *columns).toDF("segment", "repeated", *columns).mapInArrow(run, kinds)


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with the text as compressed bytes, to be shuffled: (_doc, _hash, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("_doc"), b.column("_hash"), pa.array([pack(t) for t in as_bytes(b.column("_text"))], pa.binary())], names=["_doc", "_hash", "packed"])

    return rows.select("_doc", "_hash", "_text").mapInArrow(run, "_doc long, _hash long, packed binary")


def windows_of(rows: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """Every window of the runs in ``needed`` (_doc, _hash, runs): (_doc, _hash, anchor, window, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpack = _Hashes(), zstandard.ZstdDecompressor().decompress
        for b in slices(batches):
            which, anchor, window, start = [], [], [], []
            for i, (t, runs) in enumerate(zip(b.column("packed").to_pylist(), b.column("runs").to_pylist(), strict=True)):
                words = unpack(t).split()
                h = grams(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), size).view(np.int64)
                for r in runs:
                    which.append(np.full(r["n"], i))
                    anchor.append(np.full(r["n"], r["anchor"]))
                    window.append(h[r["start"] : r["start"] + r["n"]])
                    start.append(np.arange(r["start"], r["start"] + r["n"]))
            if which:
                at = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([b.column("_doc").take(at), b.column("_hash").take(at), *[pa.array(np.concatenate(x)) for x in (anchor, window)], pa.array(np.concatenate(start).astype(np.int32))], names=["_doc", "_hash", "anchor", "window", "start"])

    joined = packed(rows).join(needed, ["_doc", "_hash"])
    return joined.select("_doc", "_hash", "packed", "runs").mapInArrow(run, "_doc long, _hash long, anchor long, window long, start int")


def repeated_windows(rows: DataFrame, size: int, bits: int = BITS, depth: int = DEPTH) -> DataFrame:
    """(_doc, _hash, start, n): windows that also start in a document with a smaller id.

    Exact. A window's anchor depends on its words alone, so a window found twice has its anchor counted
    twice, and a count-min estimate is never too low. The sketch grows with the texts, so that at any size
    it lets a small share of the anchors found once through. Candidate runs are grouped by their
    whole span: a run seen in a smaller document goes entirely. Only the first holder of each span is left
    to be compared window by window, and only where an anchor stands in different spans; every window of
    a span is also in its first holder, so nothing is missed. Joins keep the rows of hot anchors in place.
    """
    letters = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    segments = max(1, -(-(letters // RUN_BYTES) >> (bits - 1)))
    sketch = durable(count_min(rows, size, segments, bits, depth))
    kept = durable(estimated_repeated(rows, size, sketch, segments, bits, depth))
    spans = durable(kept.groupBy("anchor", "span").agg(F.min("_doc").alias("first"), F.count(F.lit(1)).alias("members")))
    several = durable(spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_spans")).where("n_spans > 1"))
    known = durable(join_counted(kept, spans, ["anchor", "span"], "members"))
    whole = known.where("first < _doc").select("_doc", "_hash", "start", "n")
    open_ = join_counted(known.where("first = _doc"), several, ["anchor"], "n_spans")
    needed = durable(open_.groupBy("_doc", "_hash").agg(F.collect_set(F.struct("anchor", "start", "n")).alias("runs")))
    held = durable(windows_of(rows, needed, size))
    least = durable(held.groupBy("anchor", "window").agg(F.min("_doc").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    single = join_counted(held, least, ["anchor", "window"], "members").where("least < _doc").select("_doc", "_hash", "start", F.lit(1).alias("n"))
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 50) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and the kept text.

    A word goes if a window of ``size`` words that covers it also starts in a document with a smaller
    id, judged on the input. A count-min sketch, with two counters or more in each of its rows for every
    run of windows, lets what may be repeated through to an exact grouping; see ``repeated_windows``.

    Null and empty texts have no words. Rows with one id never remove from each other, and repeated rows
    get the same result. Long texts are taken whole. A null id counts as smaller than all others. An empty
    table gives an empty result. Other columns of ``docs`` play no part, whatever their names.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    gone = repeated_windows(rows, size)
    per_doc = gone.groupBy("_doc", "_hash").agg(F.collect_set(F.struct("start", "n")).alias("gone"))
    joined = packed(rows).join(per_doc, ["_doc", "_hash"], "left").select("_doc", "packed", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in slices(batches):
            n, removed, sha, kept_text = [], [], [], []
            for t, cuts in zip(b.column("packed").to_pylist(), b.column("gone").to_pylist(), strict=True):
                words = unpack(t).split()
                n.append(len(words))
                if cuts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [c["start"] for c in cuts], 1)
                    np.add.at(edge, [c["start"] + c["n"] + size - 1 for c in cuts], -1)
                    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    removed.append(len(words) - len(kept))
                    words = [words[i] for i in kept.tolist()]
                else:
                    removed.append(0)
                body = b" ".join(words)
                sha.append(hashlib.sha256(body).hexdigest())
                kept_text.append(body.decode())
            yield pa.RecordBatch.from_arrays([b.column("_doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept_text)], names=["_doc", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = joined.mapInArrow(run, "_doc long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(F.nullif("_doc", F.lit(-(2**63)).cast("long")).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept_text")
