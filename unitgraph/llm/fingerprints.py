"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitgraph.llm.common import as_text, partitions

SAMPLES = 64
#: Terms whose draws one worker keeps; each takes 8 bytes times SAMPLES.
CACHE = 112_000


def _uniform(keys: np.ndarray, stream: int, samples: int) -> np.ndarray:
    """Uniform numbers in (0, 1), one for each key and sample, the same everywhere (splitmix64)."""
    with np.errstate(over="ignore"):
        z = keys[:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(samples, dtype=np.uint64) + np.uint64(1 + 1000 * stream))[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def sample_terms(keys: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Improved consistent weighted sampling (Ioffe 2010) for terms with hashes and weights.

    For each term and sample r and c come from Gamma(2, 1) and b from U(0, 1), drawn from the term's
    hash alone. The term with the least a is the sample. Returns one number for each: ln a in single
    precision, in the order of its values, and below it a 16-bit tag of (term, level), so that of equal ln a
    the least tag decides, whatever the order of the terms.
    """
    r = -np.log(_uniform(keys, 0, samples) * _uniform(keys, 1, samples))
    c = -np.log(_uniform(keys, 2, samples) * _uniform(keys, 3, samples))
    b = _uniform(keys, 4, samples)
    level = np.floor(np.log(weights)[:, None] / r + b)
    ln_a = np.log(c) - r * (level - b) - r
    with np.errstate(over="ignore"):
        tag = (keys[:, None] ^ level.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    bits = ln_a.astype(np.float32).view(np.uint32)
    rising = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
    return rising.astype(np.uint64) << np.uint64(16) | tag >> np.uint64(48)


class Fingerprinter:
    """Signatures of texts; keeps the parameters of frequent (term, count) pairs between texts."""

    def __init__(self, samples: int = SAMPLES, cache: int = CACHE) -> None:
        self.samples, self.cache = samples, cache
        self.at: dict[tuple[bytes, int], int] = {}
        self.drawn = np.empty((cache, samples), np.uint64)

    def signature(self, text: bytes) -> np.ndarray | None:
        """None for a text without words."""
        counts = Counter(text.lower().split())
        if not counts:
            return None
        known, new = [], []
        for pair in counts.items():
            k = self.at.get(pair)
            if k is None:
                new.append(pair)
            else:
                known.append(k)
        best = np.full(self.samples, ~np.uint64(0))
        for i in range(0, len(known), 4096):
            np.minimum(best, self.drawn[known[i : i + 4096]].min(axis=0), out=best)
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w, _ in some), np.uint64, len(some))
            part = sample_terms(keys, np.fromiter((n for _, n in some), np.float64, len(some)), self.samples)
            np.minimum(best, part.min(axis=0), out=best)
            k = len(self.at)
            kept = some[: self.cache - k]
            self.at.update((pair, k + j) for j, pair in enumerate(kept))
            self.drawn[k : k + len(kept)] = part[: len(kept)]
        return (best & np.uint64(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The share of equal samples: an estimate of sum(min) / sum(max) over term counts; 1 for two empty texts."""
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def text_of(signature: np.ndarray | None) -> str:
    return "" if signature is None else signature.astype(">u2").tobytes().hex()


def splice(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_neighbour_order(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Documents by descending id within ranges, each range ended by a copy of the row that follows it.

    Ranges come from quantiles of the id column, a fixed number of them, so no task holds the whole
    table. ``_ghost`` marks the copies. A null id comes after all others; rows with one id are ordered
    by their text's hash.
    """
    n = 4 * partitions(docs)
    lowest = F.lit(-(2**63)).cast("long")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    base = base.withColumn("_hash", F.xxhash64("_text")).withColumn("_value", F.col("_doc").cast("double"))
    cuts = sorted(set(base.approxQuantile("_value", [i / n for i in range(1, n)], 0.2 / n)))
    if cuts:
        cut = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_value", outputCol="_range")
        ranged = cut.transform(base).withColumn("_range", F.col("_range").cast("int")).drop("_value")
    else:
        ranged = base.withColumn("_range", F.lit(0)).drop("_value")
    heads = ranged.groupBy("_range").agg(F.max(F.struct("_doc", "_hash")).alias("_at"))
    # One row per range here, so one task is enough and a broadcast is bounded.
    ordered, whole = Window.partitionBy(F.lit(0)).orderBy(F.col("_range").desc()), Window.partitionBy(F.lit(0))
    follow = heads.select(F.col("_range").alias("_for"), F.coalesce(F.lead("_at").over(ordered), F.max("_at").over(whole)).alias("_next"))
    follow = F.broadcast(follow.select("_for", "_next.*"))
    ghosts = ranged.drop("_range").join(follow, ["_doc", "_hash"]).dropDuplicates(["_for"])
    rows = ranged.withColumn("_ghost", F.lit(False)).unionByName(ghosts.withColumnRenamed("_for", "_range").withColumn("_ghost", F.lit(True)))
    return rows.repartition(partitions(docs), "_range").sortWithinPartitions("_range", "_ghost", F.col("_doc").desc(), F.col("_hash").desc())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    A document's weighted terms are its words, ASCII letters lower-cased, with their counts; a
    fingerprint is ``samples`` consistent weighted samples of 16 bits, as hex. Two fingerprints agree in
    a sample with a probability equal to the generalised Jaccard similarity of the two bags of words.
    The edited text replaces the last half of the text by the start of the next document's, by
    descending id; after the last comes the first.

    Null and empty texts have an empty fingerprint, alike only to each other. Equal texts have equal
    fingerprints, whatever was read before them: of terms that tie in a sample the least tag wins. A
    single document is its own next one. A null id comes after all others; rows with one id are ordered by
    their text. Long texts are taken whole. An empty table gives an empty result. Other columns of ``docs``
    play no part, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held = Fingerprinter(samples), None
        for b in batches:
            out: list[tuple] = []
            for doc, body, part, ghost in zip(b.column("_doc").to_pylist(), as_text(b.column("_text")), b.column("_range").to_pylist(), b.column("_ghost").to_pylist(), strict=True):
                mine = make.signature(body.encode())
                if held is not None and held[2] == part:
                    out.append(_row(make, held, body, mine))
                held = None if ghost else (doc, body, part, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=kind)

    kind = pa.schema([("_doc", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    rows = in_neighbour_order(docs, id_col, text).mapInArrow(run, "_doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return rows.select(F.nullif("_doc", F.lit(-(2**63)).cast("long")).alias(id_col), *rows.columns[1:])


def _row(make: Fingerprinter, held: tuple, following: str, next_signature: np.ndarray | None) -> tuple:
    doc, body, _, mine = held
    edited = splice(body, following)
    other = make.signature(edited.encode())
    return doc, len(body), hashlib.sha256(edited.encode()).hexdigest(), text_of(mine), text_of(other), likeness(mine, other), likeness(mine, next_signature)
