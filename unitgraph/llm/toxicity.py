"""Toxic spans and scores by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitgraph.llm.common import as_bytes, as_text, slices
from unitgraph.plans.durable import durable

WORD_AT = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\`~"
PREFIXES = (4, 5, 6)
SLOTS = 1 + len(PREFIXES)
CHUNK = 64


def features(token: str) -> tuple[str, ...]:
    """The word itself and its prefixes, lower-cased, without punctuation at its ends."""
    w = token.lower().strip(EDGE)
    return (f"w:{w}", *(f"p{n}:{w[:n]}" if len(w) >= n else "" for n in PREFIXES))


@dataclass
class Crf:
    """Two states, 1 being toxic. A token's score for state 1 is ``bias`` plus its features' weights."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = 0.0
    document: np.ndarray = field(default_factory=lambda: np.array([-10.0, 0.0, 0.0, 0.0]))

    def slots(self, token: str) -> tuple[int, ...]:
        return tuple(self.index.get(f, 0) for f in features(token))

    def marginals(self, at: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
        """Forward-backward over a text of ``n`` tokens; P(toxic) at the tokens ``at`` that bear features.

        The tokens between them all have the same potentials, so a gap of g tokens is the g-th power of
        one 2 x 2 matrix, taken exactly from its eigenvectors; the cost is that of the tokens ``at``.
        """
        k = len(at)
        if not k:
            return np.zeros(0)
        plain = np.exp(self.trans) * np.array([1.0, np.exp(self.bias)])
        values, right = np.linalg.eig(plain)
        order = np.argsort(-values.real)
        values, right = values.real[order], right.real[:, order]
        left = np.linalg.inv(right)
        lead, rest = np.outer(right[:, 0], left[0]), np.outer(right[:, 1], left[1])
        ratio = values[1] / values[0]
        emit = np.stack([np.ones(k), np.exp(np.clip(self.bias + score, -30, 30))], axis=1)
        gaps = np.diff(at) - 1
        step = np.exp(self.trans)
        forward, backward = np.empty((k, 2)), np.empty((k, 2))
        # The first token has no transition of its own: a uniform start, then emissions.
        a = np.ones(2) if at[0] == 0 else np.array([1.0, np.exp(self.bias)]) @ (lead + rest * ratio ** (at[0] - 1)) @ step
        for i in range(k):
            if i:
                a = a @ (lead + rest * ratio ** gaps[i - 1]) @ step if gaps[i - 1] else a @ step
            a = a * emit[i]
            a = a / a.sum()
            forward[i] = a
        b = (lead + rest * ratio ** (n - 1 - at[-1])) @ np.ones(2) if n - 1 > at[-1] else np.ones(2)
        for i in range(k - 1, -1, -1):
            backward[i] = b
            if i:
                b = step @ (emit[i] * b)
                b = (lead + rest * ratio ** gaps[i - 1]) @ b if gaps[i - 1] else b
                b = b / b.sum()
        both = forward * backward
        return both[:, 1] / both.sum(axis=1)

    def summary(self, marginal: np.ndarray, n: int) -> np.ndarray:
        """What the document score reads: expected toxic tokens, the surest one, and their density."""
        expected = float(marginal.sum())
        return np.array([1.0, np.log1p(expected), float(marginal.max(initial=0.0)), min(1.0, 20 * expected / max(n, 1))])

    def score(self, marginal: np.ndarray, n: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.summary(marginal, n) @ self.document, -30, 30))))


class TokenScores(dict):
    """Scores of tokens, as UTF-8; a bounded memory of those met before."""

    def __init__(self, model: Crf, cache: int = 100_000) -> None:
        super().__init__()
        self.model, self.cache = model, cache

    def __missing__(self, token: bytes) -> float:
        s = float(sum(self.model.weights[i] for i in self.model.slots(token.decode())))
        if len(self) < self.cache:
            self[token] = s
        return s


class Tagger:
    """Marginals of texts."""

    def __init__(self, model: Crf) -> None:
        self.model, self.scores = model, TokenScores(model)

    def marginals(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens that bear features, their marginals, and the number of all tokens."""
        tokens = text.encode().split()
        scores = np.fromiter(map(self.scores.__getitem__, tokens), float, len(tokens))
        at = np.flatnonzero(scores)
        return at, self.model.marginals(at, scores[at], len(tokens)), len(tokens)

    def tag(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The score, and (start, end, marginal) in code points of each token that bears features."""
        at, marginal, n = self.marginals(text)
        spans = []
        if len(at):
            places = dict(zip(at.tolist(), marginal.tolist(), strict=True))
            spans = [(m.start(), m.end(), places[k]) for k, m in enumerate(WORD_AT.finditer(text)) if k in places]
        return self.model.score(marginal, n), spans


def held_out(id_col: Column) -> Column:
    """Never learnt from: ids whose CRC-32 is divisible by 5. A null id is not held out; no label joins it."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def feature_counts(labelled: DataFrame, text: str = "text", label: str = "toxic", flush: int = 100_000, cache: int = 50_000) -> DataFrame:
    """(feature, toxic, clean): documents of either label that hold it, over all labelled documents.

    Each task adds up what it has read before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        known: dict[bytes, tuple[str, ...]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["feature", "toxic", "clean"])

        for b in slices(batches):
            for t, y in zip(as_bytes(b.column("_text")), b.column("_label").to_pylist(), strict=True):
                found: set[str] = set()
                for w in set(t.split()):
                    f = known.get(w)
                    if f is None:
                        f = features(w.decode())
                        if len(known) < cache:
                            known[w] = f
                    found.update(f)
                for f in found:
                    c = counts.get(f)
                    if c is None:
                        c = counts[f] = [0, 0]
                    c[y] += 1
                if len(counts) > flush:
                    yield out()
                    counts = {}
        if counts:
            yield out()

    parts = labelled.select(F.col(text).alias("_text"), F.col(label).cast("int").alias("_label")).mapInArrow(run, "feature string, toxic long, clean long")
    return parts.where("feature != ''").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def held_features(docs: DataFrame, names: list[str], cache: int = 100_000) -> DataFrame:
    """(_doc, features): places in ``names`` of the features each text holds; texts that hold none are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: i for i, f in enumerate(names)}
        known: dict[bytes, tuple[int, ...]] = {}
        for b in slices(batches):
            rows, found = [], []
            for i, t in enumerate(as_bytes(b.column("_body"))):
                held: set[int] = set()
                for w in set(t.split()):
                    f = known.get(w)
                    if f is None:
                        f = tuple(place[x] for x in features(w.decode()) if x in place)
                        if len(known) < cache:
                            known[w] = f
                    if f:
                        held.update(f)
                if held:
                    rows.append(i)
                    found.append(sorted(held))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("_doc").take(pa.array(rows)), pa.array(found, pa.list_(pa.int32()))], names=["_doc", "features"])

    return docs.mapInArrow(run, f"_doc {docs.schema['_doc'].dataType.simpleString()}, features array<int>")


def learn_labels(texts: list[tuple[str, int]], lexicon: dict[str, float], model: Crf, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token features, token labels and lengths of chunks of at most CHUNK tokens.

    A token of a toxic document is labelled toxic if one of its features marks toxic documents.
    """
    feats, labels, lengths = [], [], []
    known: dict[str, tuple[tuple[int, ...], bool]] = {}
    for t, y in texts:
        tokens = WORD_AT.findall(t)
        for w in tokens:
            if w not in known:
                known[w] = (model.slots(w), max(lexicon.get(f, 0.0) for f in features(w)) >= least)
        for i in range(0, len(tokens), CHUNK):
            some = [known[w] for w in tokens[i : i + CHUNK]]
            if y or any(any(s) for s, _ in some) or i == 0:
                lengths.append(len(some))
                feats.append(np.array([s for s, _ in some] + [(0,) * SLOTS] * (CHUNK - len(some)), np.int32))
                labels.append(np.array([int(y and hit) for _, hit in some] + [0] * (CHUNK - len(some)), np.int8))
    return np.array(feats), np.array(labels), np.array(lengths)


def chain_gradient(theta: np.ndarray, feats: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray]:
    """The chunks' conditional log likelihood and its gradient: observed minus expected counts.

    ``theta``: a weight for each feature (the first, for none, is 0), the bias, and the four transitions.
    """
    n, length = labels.shape
    live = (np.arange(length)[None, :] < lengths[:, None]).astype(float)
    y, size = labels.astype(int), len(theta) - 5
    pair = live[:, 1:] * live[:, :-1]
    w = theta[:size].copy()
    w[0] = 0.0
    trans = theta[size + 1 :].reshape(2, 2)
    score = np.clip(w[feats].sum(axis=2) + theta[size], -30, 30)
    emit, step = np.exp(score), np.exp(trans)
    f, g = np.empty((length, n, 2)), np.ones((length, n, 2))
    a = np.stack([np.ones(n), emit[:, 0]], axis=1)
    total = a.sum(axis=1, keepdims=True)
    f[0], log_z = a / total, np.log(total).sum()
    for t in range(1, length):
        a = f[t - 1] @ step
        a[:, 1] *= emit[:, t]
        total = a.sum(axis=1, keepdims=True)
        f[t] = np.where(live[:, t, None] > 0, a / total, f[t - 1])
        log_z += (live[:, t] * np.log(total[:, 0])).sum()
    expected = np.zeros((2, 2))
    for t in range(length - 1, 0, -1):
        e = np.stack([g[t][:, 0], g[t][:, 1] * emit[:, t]], axis=1)
        joint = f[t - 1][:, :, None] * step[None] * e[:, None, :]
        joint *= (live[:, t] / joint.sum(axis=(1, 2)))[:, None, None]
        expected += joint.sum(axis=0)
        b = e @ step.T
        g[t - 1] = np.where(live[:, t, None] > 0, b / b.sum(axis=1, keepdims=True), 1.0)
    p = (f * g)[:, :, 1] / (f * g).sum(axis=2)
    miss = (y - p.T) * live
    seen = np.array([[(pair * (y[:, :-1] == i) * (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
    grad = np.empty_like(theta)
    grad[:size] = np.bincount(feats.ravel(), np.repeat(miss.ravel(), SLOTS), minlength=size)
    grad[0] = 0.0
    grad[size] = miss.sum()
    grad[size + 1 :] = (seen - expected).ravel()
    return float((y * live * score).sum() + (seen * trans).sum() - log_z), grad


def fit_chain(model: Crf, feats: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 60, rate: float = 0.3, l2: float = 1e-3) -> None:
    """Maximum conditional likelihood by Adam."""
    size = len(model.weights)
    theta = np.zeros(size + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = float(np.minimum(lengths, labels.shape[1]).sum())
    for k in range(1, rounds + 1):
        grad = chain_gradient(theta, feats, labels, lengths)[1] / total * 100 - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model.weights = theta[:size].copy()
    model.weights[0] = 0.0
    model.bias, model.trans = float(theta[size]), theta[size + 1 :].reshape(2, 2).copy()


def fit_document(model: Crf, texts: list[tuple[str, int]], weight: tuple[float, float], rounds: int = 30, l2: float = 1e-2) -> None:
    """Logistic regression from a text's marginals to its label, by Newton steps."""
    tagger = Tagger(model)
    x, y = [], []
    for t, label in texts:
        _, marginal, n = tagger.marginals(t)
        x.append(model.summary(marginal, n))
        y.append(label)
    x, y = np.array(x), np.array(y, float)
    w, c = np.zeros(x.shape[1]), np.where(y > 0, weight[1], weight[0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (c * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (c * (y - p)) - l2 * w), -5, 5)
    model.document = w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_features: int = 5000,
          max_documents: int = 1000, max_chars: int = 8_000_000, max_sample: int = 5000, min_share: float = 0.004, min_support: int = 4, least: float = 3.0) -> Crf:
    """A model learnt from the labelled documents that are not held out.

    Features that mark toxic documents are looked for in at most ``max_sample`` documents of each label,
    picked by a hash; half the support and log odds of ``least - 1`` suffice there. Those found, at most
    4 * ``max_features``, are then counted over all labelled documents. The ``max_features`` best make the
    model's vocabulary: held by ``min_support`` toxic documents and ``min_share`` of them, with log odds
    of ``least`` or more. Texts are never shuffled, only ids with the features found in them. The chain and
    the document score are fitted on at most ``max_documents`` documents of each label, the first of the
    same order, with at most ``max_chars`` characters in all for each label: a text that the rest of that
    bound can not hold is passed over, which bounds what the driver holds. Without documents of both
    labels the model scores 0. Null ids and labels teach nothing; null texts are empty; an id with
    several labels counts as toxic if one of them is; other columns play no part.
    """
    truth = durable(labels.where(F.col(label).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label")))
    texts = docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_body"))
    n = {r["_label"]: r["count"] for r in truth.groupBy("_label").count().collect()}
    model = Crf()
    if not n.get(0) or not n.get(1):
        return model

    def first(most: int) -> DataFrame:
        """At most ``most`` ids of either label, so of bounded size."""
        return durable(reduce(DataFrame.unionByName, [truth.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(most) for y in (0, 1)]))

    def odds(held: dict[int, int]) -> Column:
        return F.log((F.col("toxic") + 0.5) / (held[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (held[0] + 1.0))

    def best(counts: DataFrame, held: dict[int, int], support: float, share: float, least: float, most: int) -> dict[str, float]:
        marks = counts.withColumn("odds", odds(held)).where((F.col("toxic") >= max(support, share * held[1])) & (F.col("odds") >= least))
        return {r["feature"]: r["odds"] for r in marks.orderBy(F.desc(F.col("odds") * F.log(F.col("toxic") + 1.0)), "feature").limit(most).collect()}

    sample = texts.join(F.broadcast(first(max_sample)), F.col("_doc") == F.col("_id"))
    found = sorted(best(feature_counts(sample, "_body", "_label"), {y: min(c, max_sample) for y, c in n.items()}, min_support / 2, min_share / 2, least - 1, 4 * max_features))
    if not found:
        return model
    held = held_features(texts, found).join(truth, F.col("_doc") == F.col("_id")).select(F.explode("features").alias("place"), "_label")
    counts = held.groupBy("place").agg(F.sum("_label").alias("toxic"), F.sum(1 - F.col("_label")).alias("clean"))
    named = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(found)), "place int, feature string"))
    lexicon = best(counts.join(named, "place"), n, min_support, min_share, least, max_features)
    model.index = {f: i + 1 for i, f in enumerate(sorted(lexicon))}
    model.weights = np.zeros(len(model.index) + 1)
    wanted = texts.join(F.broadcast(first(max_documents)), F.col("_doc") == F.col("_id")).select("_doc", "_label", F.length("_body").alias("chars"), F.xxhash64("_body").alias("hash"))
    fit, left = [], {0: max_chars, 1: max_chars}
    for r in wanted.orderBy(F.xxhash64("_doc"), "_doc", "hash").limit(4 * max_documents).collect():
        if r["chars"] <= left[r["_label"]]:
            left[r["_label"]] -= r["chars"]
            fit.append((r["_doc"], r["hash"], r["_label"]))
    named = docs.sparkSession.createDataFrame(fit, T.StructType([T.StructField("_id", texts.schema["_doc"].dataType), T.StructField("hash", T.LongType()), T.StructField("_label", T.IntegerType())]))
    rows = texts.join(F.broadcast(named.distinct()), (F.col("_doc") == F.col("_id")) & (F.xxhash64("_body") == F.col("hash"))).limit(len(fit)).collect()
    picked = sorted(((r["_body"], r["_label"]) for r in rows), key=lambda x: (x[1], x[0]))
    if not model.index or len({y for _, y in picked}) < 2:
        return model
    feats, tags, lengths = learn_labels(picked, lexicon, model, least)
    fit_chain(model, feats, tags, lengths)
    got = [sum(y == k for _, y in picked) for k in (0, 1)]
    fit_document(model, picked, (n[0] / got[0] / n[1] * got[1], 1.0))
    return model


def score(docs: DataFrame, model: Crf, keep: list[str], text: str = "text", offending: float = 0.5) -> DataFrame:
    """``keep``, ``score``, ``predicted`` and ``spans`` (start, end, marginal of offending tokens).

    Texts are scored whole. Null and empty texts have the score of a text without toxic tokens.
    Repeated rows get the same score; a tie at 0.5 is called toxic; an empty table gives an empty result.
    Columns that are not in ``keep`` play no part; to keep columns named as the results are, keep a struct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])
        for b in slices(batches):
            done = [tagger.tag(t) for t in as_text(b.column(body))]
            s = pa.array([x for x, _ in done], pa.float64())
            spans = pa.array([[{"start": a, "end": e, "marginal": m} for a, e, m in sp if m >= offending] for _, sp in done], pa.list_(span))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], s, pa.array([int(x >= 0.5) for x, _ in done], pa.int32()), spans], names=[*keep, "score", "predicted", "spans"])

    # A text that is kept goes to the workers once.
    body = text if text in keep else "_text"
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias(body))
    kept = [rows.schema[c] for c in keep]
    spans_of = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())]))
    result = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", spans_of)])
    return rows.mapInArrow(run, result)
