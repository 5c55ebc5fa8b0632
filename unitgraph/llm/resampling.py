"""Resampling a corpus towards a target by importance weights of hashed n-grams.

Each document is read once, its words joined by single spaces, and the CRC of everything up to each
word's start and end is kept. The CRC of any run of words follows from two of these: a CRC is linear over
GF(2), so the part before the run, shifted over the run's length, cancels out.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitgraph.llm.common import as_bytes, ranked, slices
from unitgraph.plans.durable import durable

POLYNOMIAL = 0xEDB88320
#: Words that are looked at together.
FLUSH = 1 << 17
#: Bytes of one document that are split into words at once.
PIECE = 1 << 20
#: Runs of up to so many bytes have a table of their own.
SHORT = 96


def byte_table() -> np.ndarray:
    """What a byte at the register's low end becomes after eight steps."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> np.uint32(1) ^ np.uint32(POLYNOMIAL), out >> np.uint32(1))
    return out


TABLE = byte_table()


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit words, given by its values on each of their four bytes."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def _one_byte() -> np.ndarray:
    """The map that shifts a CRC over one byte: (4, 256)."""
    b = np.arange(256, dtype=np.uint32)
    return np.stack([TABLE[(b << np.uint32(8 * k)) & 255] ^ (b << np.uint32(8 * k)) >> np.uint32(8) for k in range(4)])


class Shift:
    """Shifts CRCs over any number of bytes: short ones by a table each, longer ones by powers of two."""

    def __init__(self) -> None:
        one = _one_byte()
        b = np.arange(256, dtype=np.uint32)
        tables = [np.stack([b << np.uint32(8 * k) for k in range(4)])]
        for _ in range(SHORT - 1):
            tables.append(_apply(one, tables[-1]))
        # By byte of the CRC, then (length, value) in one row.
        self.short = np.ascontiguousarray(np.stack(tables).transpose(1, 0, 2)).reshape(4, -1)
        self.powers = [one]

    def _power(self, k: int) -> np.ndarray:
        while len(self.powers) <= k:
            self.powers.append(_apply(self.powers[-1], self.powers[-1]))
        return self.powers[k]

    def over(self, crc: np.ndarray, cut: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        """``crc``, whose bytes are ``cut``, shifted over ``n`` zero bytes each."""
        low = np.minimum(n, SHORT - 1) << 8
        out = self.short[0].take(low | cut[0])
        for t, part in zip(self.short[1:], cut[1:], strict=True):
            out ^= t.take(low | part)
        rest = np.flatnonzero(n >= SHORT)
        if len(rest):
            more, part = n[rest] - (SHORT - 1), out[rest]
            for k in range(int(more.max()).bit_length()):
                hit = (more >> k & 1).astype(bool)
                part[hit] = _apply(self._power(k), part[hit])
            out[rest] = part
        return out


def separators() -> bytes:
    """Bytes to bytes: A-Z lower-cased, digits, letters and what is not ASCII kept, all else a space."""
    own = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
    return bytes(b + 32 if 65 <= b <= 90 else b if b in own else 32 for b in range(256))


SEPARATORS = separators()


class Features:
    """Buckets of all runs of 1 to ``most`` consecutive words of texts that are read one after the other.

    ``use(of, bucket)`` is called with the text's number and the bucket of each run, many at a time. Texts
    of any length are read in pieces; the last words of a piece are kept for runs that go on in the next.
    """

    def __init__(self, use, buckets: int = 10_000, most: int = 3) -> None:
        self.use, self.buckets, self.most, self.shift = use, np.uint32(buckets), most, Shift()
        self.crcs: list[int] = []
        self.lengths: list[int] = []
        self.of: list[np.ndarray] = []
        none = np.zeros(0, np.int64)
        self.kept = (none.astype(np.uint32), none.astype(np.uint32), none, none)

    def read(self, number: int, text: bytes) -> int:
        """Number of words of ``text``."""
        words, crc, at, size = 0, 0, 0, len(text)
        while at < size:
            end = at + PIECE
            if end < size:
                # Up to a separator: no word is cut.
                while end < size and SEPARATORS[text[end]] != 32:
                    end += 1
            found = text[at:end].translate(SEPARATORS).split()
            at = end
            if not found:
                continue
            self.lengths += map(len, found)
            # A space goes before each word; the first one's makes no difference to any run.
            self.crcs += [crc := crc32(w, crc) for w in (b" " + b"\n ".join(found)).split(b"\n")]
            self.of.append(np.full(len(found), number, np.int64))
            words += len(found)
            if len(self.crcs) >= FLUSH:
                self.flush()
        return words

    def flush(self) -> None:
        end, of = np.array(self.crcs, np.uint32), np.concatenate([np.zeros(0, np.int64), *self.of])
        length = np.array(self.lengths, np.int64)
        old_end, old_start, old_length, old_of = self.kept
        # What a run's CRC is counted from: that up to the space before its first word.
        before = np.concatenate([old_end[-1:] if len(old_end) else np.zeros(1, np.uint32), end[:-1]])[: len(end)]
        first = np.concatenate([old_of[-1:] if len(old_of) else np.full(1, -1), of[:-1]])[: len(of)] != of
        before[first] = 0
        x = ~before
        start = ~(TABLE[(x ^ np.uint32(32)) & 255] ^ x >> np.uint32(8))
        c = len(old_end)
        end, start, length, of = np.concatenate([old_end, end]), np.concatenate([old_start, start]), np.concatenate([old_length, length]), np.concatenate([old_of, of])
        cut = [(start >> np.uint32(8 * k) & 255).astype(np.int64) for k in range(4)]
        size = np.zeros(len(end), np.int64)
        for n in range(1, self.most + 1):
            # Runs that start at word 0, 1, ...; those that end in what was kept have been used before.
            m = len(end) - (n - 1)
            if m <= 0:
                break
            size = (size[:m] + length[n - 1 :] + (n > 1)) if n > 1 else length
            run = end[n - 1 :] ^ self.shift.over(start[:m], [x[:m] for x in cut], size)
            bucket = (run % self.buckets).astype(np.int64)
            new = of[:m] == of[n - 1 :]
            new[: max(0, c - (n - 1))] = False
            self.use(of[:m][new], bucket[new])
        k = self.most - 1
        self.kept = (end[len(end) - k :], start[len(start) - k :], length[len(length) - k :], of[len(of) - k :]) if len(end) > k else (end, start, length, of)
        self.crcs, self.lengths, self.of = [], [], []


def count_buckets(texts: DataFrame, text: str = "text", buckets: int = 10_000, most: int = 3) -> DataFrame:
    """(bucket, n): the features of all texts by bucket; a task hands on one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)

        def add(of: np.ndarray, bucket: np.ndarray) -> None:
            total[:] += np.bincount(bucket, minlength=buckets)

        features, number = Features(add, buckets, most), 0
        for b in slices(batches, 256):
            for t in as_bytes(b.column(0)):
                features.read(number, t)
                number += 1
        features.flush()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return texts.select(F.col(text).alias("_text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """By bucket, floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))).

    ``corpus`` and ``target``: (bucket, n) with s and t of a bucket, S and T of all. There are ``buckets``
    numbers, whatever the sizes of the two.
    """
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = durable(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    d = lambda x: x.cast("double")
    all_s, all_t = float(total["s"] + buckets), float(total["t"] + buckets)
    gain = F.floor(1000 * F.log((d(F.col("t")) + 1) * F.lit(all_s) / ((d(F.col("s")) + 1) * F.lit(all_t))))
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(both, "bucket", "left").fillna(0, ["s", "t"])
    out = [0] * buckets
    for r in every.select("bucket", gain.alias("gain")).collect():  # one row a bucket
        out[r["bucket"]] = r["gain"]
    return out


def weigh(docs: DataFrame, by_bucket: list[int], id_col: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """(id, n_words, n_features, weight): each document's sum of gains over its features."""
    kind = docs.schema[id_col].dataType.simpleString()
    gain = np.array(by_bucket, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            n = b.num_rows
            weight, count = np.zeros(n, np.int64), np.zeros(n, np.int64)

            def add(of: np.ndarray, bucket: np.ndarray, n: int = n, weight: np.ndarray = weight, count: np.ndarray = count) -> None:
                # Sums stay far below 2**53, so doubles hold them exactly.
                weight[:] += np.bincount(of, gain[bucket], n).astype(np.int64)
                count[:] += np.bincount(of, minlength=n)

            features = Features(add, len(gain), most)
            words = [features.read(k, t) for k, t in enumerate(as_bytes(b.column(1)))]
            features.flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(count), pa.array(weight)], [id_col, "n_words", "n_features", "weight"])

    return docs.select(id_col, F.col(text).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h from the first 8 hex digits of sha256 of seed:id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 5, min_words: int = 20, buckets: int = 10_000, most: int = 3, seed: int = 42) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): a draw without replacement towards the texts of ``target``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; features all runs of 1
    to ``most`` words with a space between, repeats counted, by the CRC-32 of their bytes. A document's
    weight is the sum of its features' gains (see ``gains``), its score that and a Gumbel number of its
    own, so that the highest scores are a draw in proportion to the weights. Of the documents with
    ``min_words`` words or more, ``percent`` in 100, rounded down, are drawn and ranked from 1; ``rank`` is
    null for the others, which are returned too.

    Ties go to the smaller id, null ids last, then to fewer features; rows alike in both rank in any
    order, which no column shows. Null and empty texts have no features, weight 0, and are not drawn.
    Texts of any length are read whole, in pieces. An empty corpus gives no rows; against an empty target
    all features count by their rarity. Repeated rows are documents of their own. Other columns play no part.
    """
    s = count_buckets(docs, text, buckets, most)
    t = count_buckets(target, text, buckets, most)
    weighed = weigh(docs, gains(s, t, buckets), id_col, text, most)
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed))
    placed = ranked(scored.withColumn("_in", F.col("n_words") >= min_words), F.desc("_in"), F.desc("score"), F.asc_nulls_last(id_col), "n_features", "weight")
    n = placed.where("_in").count()
    drawn = F.col("_in") & (F.col("_rank") < percent * n // 100)
    return placed.select(id_col, "n_words", "n_features", "weight", "score", F.when(drawn, F.col("_rank") + 1).cast("long").alias("rank"))
