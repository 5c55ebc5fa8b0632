"""Packing token ids into sequences under a mixture, by deficit round-robin over source queues."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitgraph.llm.common import as_text, running_total
from unitgraph.plans.durable import durable

#: Chunks whose ids one worker keeps.
CACHE = 200_000
#: A space before white space or at an end: there a text can not be cut at single spaces.
ODD_SPACE = re.compile(r" (?=\s|$)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts by a byte-level tokenizer file, as little-endian bytes.

    Such a tokenizer never joins what a space parts from the next word (the space goes with the word),
    so a text is cut before each space and frequent pieces are encoded once. The file's vocabulary is
    also its merge order; a second reader of the same vocabulary, which is faster on short pieces,
    encodes those met for the first time. Texts that hold a special token's string go through the file's
    own tokenizer whole.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in special.values()]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if i not in special}
        self.pieces = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache, self.ids = cache, {}

    def _piece(self, text: str) -> bytes:
        return array(self.code, self.pieces(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if ODD_SPACE.search(text):
            return self._piece(text)
        chunks, known, out = text.split(" "), self.ids, []
        out.append(self._piece(chunks[0]))
        for c, ids in zip(chunks[1:], map(known.get, chunks[1:]), strict=True):
            if ids is None:
                ids = self._piece(" " + c)
                if len(known) < self.cache:
                    known[c] = ids
            out.append(ids)
        return b"".join(out)


def tokenize(docs: DataFrame, id_col: str, source: str, text: str, tokenizer_path: str, batch: int = 512) -> DataFrame:
    """(_id, _doc, source, tokens, ids): each document's ids and a final 0; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        end = np.zeros(1, encoder.dtype).tobytes()
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                b = whole.slice(k, batch)
                ids = [encoder.encode(t) + end for t in as_text(b.column("_text"))]
                n = pa.array([len(x) // encoder.dtype.itemsize for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_doc"), b.column("source"), n, pa.array(ids, pa.binary())], names=["_id", "_doc", "source", "tokens", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("_id"), F.col(id_col).alias("_doc"), F.col(source).cast("string").alias("source"), F.col(text).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"_id long, _doc {kind}, source string, tokens long, ids binary")


def served(window: Column, windows: int, total: Column) -> Column:
    """Tokens a source has been served before a window: its share of all windows so far, whole tokens.

    This is deficit round-robin in closed form. Each window adds the source's quantum, total / windows,
    to its deficit and serves the whole tokens of it; the fraction left over is carried on. As it is a
    function of the window's number alone, it carries across partitions without passing state.
    """
    return F.floor(window.cast("double") / F.lit(float(windows)) * total.cast("double")).cast("long")


def window_of(position: Column, windows: int, total: Column) -> Column:
    """The window that serves a position of a source's queue, by the same ``served``."""
    guess = F.floor(position.cast("double") / total.cast("double") * F.lit(float(windows))).cast("long")
    return F.when(served(guess + 1, windows, total) <= position, guess + 1).when(served(guess, windows, total) > position, guess - 1).otherwise(guess)


def layout(sizes: DataFrame, sequence: int, window_tokens: int, seed: int) -> DataFrame:
    """Where each document's tokens go: (_id, start, length, sequence_id, offset).

    ``sizes``: durable rows (_id, _doc, source, tokens). Within a source, documents queue by a hash of
    their ids. Windows follow each other without gaps, and in a window its sources, in order.
    """
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    windows = max(1, -(-total // window_tokens))
    queues = sizes.groupBy("source").agg(F.sum("tokens").alias("_queue"))
    start = running_total(sizes.select("_id", "source", "tokens", F.xxhash64(F.lit(seed), "_doc").alias("_shuffled")), ["source"], F.col("_shuffled"), "tokens", "_start")
    q = queues.withColumnRenamed("source", "_source")
    placed = start.join(q, start["source"].eqNullSafe(q["_source"])).select("_id", "source", "tokens", "_start", "_queue")
    end = F.col("_start") + F.col("tokens")
    cut = placed.withColumn("_window", F.explode(F.sequence(window_of(F.col("_start"), windows, F.col("_queue")), window_of(end - 1, windows, F.col("_queue")))))
    first = served(F.col("_window"), windows, F.col("_queue"))
    a, b = F.greatest(F.col("_start"), first), F.least(end, served(F.col("_window") + 1, windows, F.col("_queue")))
    pieces = durable(cut.select("_id", "source", "_window", (a - F.col("_start")).alias("start"), (b - a).alias("length"), (a - first).alias("_in")).where("length > 0"))
    cells = pieces.groupBy("_window", "source").agg(F.sum("length").alias("_cell"))
    cells = running_total(cells, [], F.col("_window") * F.lit((2**63 - 1) // windows), "_cell", "_base").select(F.col("_window").alias("_w"), F.col("source").alias("_s"), "_base")
    at = pieces.join(cells, (pieces["_window"] == cells["_w"]) & pieces["source"].eqNullSafe(cells["_s"])).withColumn("_at", F.col("_base") + F.col("_in"))
    n = F.lit(sequence).cast("long")
    split = at.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("_at") / n), F.floor((F.col("_at") + F.col("length") - 1) / n))))
    lo, hi = F.greatest(F.col("_at"), F.col("sequence_id") * n), F.least(F.col("_at") + F.col("length"), (F.col("sequence_id") + 1) * n)
    return split.select("_id", (F.col("start") + lo - F.col("_at")).alias("start"), (hi - lo).alias("length"), "sequence_id", (lo - F.col("sequence_id") * n).alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", source: str = "source", text: str = "text", sequence: int = 1024, window_tokens: int = 131_072, seed: int = 42, with_ids: bool = True) -> DataFrame:
    """All documents' tokens in sequences of ``sequence`` ids; one row per piece, with the piece's ids.

    Each window of about ``window_tokens`` tokens holds every source in the share it has of all tokens,
    to within one token. Documents are cut where a window or a sequence ends. All sequences are full but
    the last, so there is no other padding.

    Null texts are a single 0; a null source is a queue of its own. Repeated rows are separate
    documents. Long texts are cut over many sequences. An empty table gives an empty result.
    Returns id, start, length, ids (binary, unsigned 32 bit little-endian; null without ``with_ids``), ids_crc32, doc_tokens,
    sequence_id, offset.
    """
    tokens = durable(tokenize(docs, id_col, source, text, tokenizer_path))
    pieces = layout(tokens.drop("ids"), sequence, window_tokens, seed)
    per_doc = pieces.groupBy("_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    joined = tokens.join(per_doc, "_id").select("_doc", "tokens", "ids", "cuts")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, rows, ids, crc = [], [], [], []
            for i, (n, raw, cuts) in enumerate(zip(b.column("tokens").to_pylist(), b.column("ids").to_pylist(), b.column("cuts").to_pylist(), strict=True)):
                full = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")
                for c in cuts:
                    part = full[c["start"] : c["start"] + c["length"]].astype("<u4").tobytes()
                    take.append(i)
                    rows.append((c["start"], c["length"], n, c["sequence_id"], c["offset"]))
                    ids.append(part if with_ids else None)
                    crc.append(zlib.crc32(part))
            if rows:
                start, length, n, seq, off = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("_doc").take(pa.array(take)), start, length, pa.array(ids, pa.binary()), pa.array(crc, pa.int64()), n, seq, off], names=[id_col, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return joined.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
