"""Secrets in documents, told apart by how many owners share them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitgraph.llm.common import as_text, join_counted
from unitgraph.plans.durable import durable

KINDS = ("assign", "access", "hex", "live")
# ASCII flag: letters match in either case, but not the long s or the Kelvin sign.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

SCANNED = "_id long, {keys}, n_assign long, n_access long, n_hex long, base string, found array<struct<kind:string,start:long,end:long,value_start:long,value:string,varied:boolean>>"


def find(text: str) -> list[tuple[str, int, int, int, str]]:
    """Base matches of one text: (kind, start, end, start of the value, value), by start, then kind.

    A match that is too short is dropped after it has taken its characters, as in a leftmost scan.
    """
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end(), m.start(2), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # A run of hex digits is always matched whole, so asking for 24 at once is the same as dropping later.
    out += [("hex", m.start(), m.end(), m.start(), m[0]) for m in HEX.finditer(text)]
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def looks_random(value: str) -> bool:
    """Letters and digits mixed, and at least six different characters: not a word, not ``xxxxxx``."""
    return len(set(value)) >= 6 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Base matches of every document, with the columns ``keep``; one row per input row, without texts."""
    source = docs.select(F.monotonically_increasing_id().alias("_id"), *keep, F.col(text).alias("_text"))
    schema = SCANNED.format(keys=", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [find(t) for t in as_text(b.column("_text"))]
            base = [",".join(f"{k}:{s}:{e}" for k, s, e, _, _ in r) for r in rows]
            kind_of = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value", pa.string()), ("varied", pa.bool_())])
            found = [[{"kind": k, "start": s, "end": e, "value_start": v, "value": hashlib.blake2b(x.encode(), digest_size=16).hexdigest(), "varied": looks_random(x)} for k, s, e, v, x in r] for r in rows]
            counts = [pa.array([sum(x[0] == k for x in r) for r in rows], pa.int64()) for k in KINDS[:3]]
            columns = [b.column("_id"), *[b.column(k) for k in keep], *counts, pa.array(base, pa.string()), pa.array(found, pa.list_(kind_of))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", *keep, "n_assign", "n_access", "n_hex", "base", "found"])

    return source.mapInArrow(run, schema)


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, times, repositories, owners): how often each candidate hash occurs, in how many distinct ones of both.

    Candidates are counted by repository and owner first, map side, so a secret copied a million times is
    a few rows.
    """
    one = candidates.groupBy("value", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("value").agg(F.sum("n").alias("times"), F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))


def find_secrets(docs: DataFrame, id_col: str, repository: Column, owner: Column, text: str = "text", example_owners: int = 3, example_repositories: int = 5) -> DataFrame:
    """Every document with its secrets: counts, base spans, and all spans with a verdict.

    A candidate's value is hashed and its distinct repositories and owners are counted over all documents.
    A value held by ``example_owners`` or more owners, or in ``example_repositories`` or more
    repositories, is a copied example. One held by fewer that mixes letters and digits is a live-looking
    credential, and adds a span of kind ``live`` over the bare value. A null repository or owner counts as
    one unnamed repository or owner.

    Null and empty texts have no spans. Repeated rows are separate documents of one repository. Very long
    texts are scanned whole. Spans that tie in their start are in the order of their kinds. An empty table
    gives an empty result. Other columns of ``docs`` play no part, whatever their names.

    Returns id, n_assign, n_access, n_hex, base, spans (array of kind, start, end), spans_text,
    n_live, n_example.
    """
    named = docs.select(F.col(id_col).alias("_doc"), F.coalesce(repository.cast("string"), F.lit("\x00")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("\x00")).alias("owner"), F.xxhash64(text).alias("_text_hash"), F.col(text).alias("_body"))
    scanned = durable(scan(named, ["_doc", "repository", "owner", "_text_hash"], "_body"))
    hits = scanned.select("_id", "repository", "owner", F.explode("found").alias("f")).select("_id", "repository", "owner", "f.*")
    known = durable(ownership(hits))
    copied = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    judged = join_counted(hits, known, ["value"], "times").select(
        "_id", "kind", "start", "end", "value_start", copied.alias("example"), (~copied & F.col("varied")).alias("live"), F.col("end").alias("value_end"))
    span = lambda start, rank, kind, end: F.struct(start.alias("start"), rank.alias("rank"), kind.alias("kind"), end.alias("end"))
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    both = judged.withColumn("span", F.explode(F.when(
        F.col("live"), F.array(span(F.col("start"), rank, F.col("kind"), F.col("end")), span(F.col("value_start"), F.lit(KINDS.index("live")), F.lit("live"), F.col("value_end")))
    ).otherwise(F.array(span(F.col("start"), rank, F.col("kind"), F.col("end"))))))
    # A value found twice at one place (hex within an assignment) is one live span.
    per_doc = both.groupBy("_id").agg(
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.count_distinct(F.when(F.col("example"), F.col("value_start"))).alias("n_example"),
        F.count_distinct(F.when(F.col("live"), F.col("value_start"))).alias("n_live"),
    )
    joined = scanned.join(per_doc, "_id", "left")
    text_of = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return joined.select(
        F.col("_doc").alias(id_col), "_text_hash", "n_assign", "n_access", "n_hex", "base", "spans",
        F.coalesce(text_of, F.lit("")).alias("spans_text"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def redact(docs: DataFrame, found: DataFrame, id_col: str, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each live credential's value replaced by ``mark``; no document is dropped.

    Null texts stay null. Overlapping credentials make one mark. Rows with one id and text are treated
    alike. Other columns stay as they are, whatever their names.
    """
    live = found.where("n_live > 0").select(
        F.col(id_col).alias("_doc"), F.col("_text_hash").alias("_hash"),
        F.transform(F.filter("spans", lambda s: s["kind"] == "live"), lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"))).alias("_cuts"),
    ).dropDuplicates(["_doc", "_hash"])
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.col(text).alias("_body"))
    joined = rows.join(live, F.col("_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("_body") == F.col("_hash")), "left")
    # Pieces between the cuts, which are sorted by start; a cut that begins within the one before moves its
    # end, if it reaches further.
    body = F.col("_body")
    state = F.struct(F.lit(1).cast("long").alias("at"), F.lit("").alias("out"))
    walked = F.aggregate(
        "_cuts", state,
        lambda acc, c: F.when(c["s"] + 1 < acc["at"], F.struct(F.greatest(acc["at"], c["e"] + 1).alias("at"), acc["out"].alias("out"))).otherwise(F.struct((c["e"] + 1).alias("at"), F.concat(acc["out"], F.substring(body, acc["at"].cast("int"), (c["s"] + 1 - acc["at"]).cast("int")), F.lit(mark)).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"].cast("int"), F.length(body))),
    )
    fixed = F.when(F.col("_cuts").isNotNull(), walked).otherwise(body)
    return joined.select(*[fixed.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
