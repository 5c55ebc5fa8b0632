"""The corpus pipeline: toxicity, near-duplicates, secrets, mixture and packing, one after the other.

Each stage reads what the one before kept, as Parquet in the cluster's shared folder, and returns the
columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitgraph.llm import minhash, mixing, packing, secrets, toxicity
from unitgraph.llm.common import table
from unitgraph.llm.queries import tokenizer
from unitgraph.plans.durable import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger does not call toxic.

    Null and empty texts stay, as do rows with a null id; rows with one text share one verdict. An empty
    table, or labels of one kind only, drop nothing. Texts are scored whole. Extra columns stay as they are.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    others = F.struct(*[c for c in docs.columns if c != "text"])
    scored = toxicity.score(docs.select(others.alias("_row"), F.col("text").alias("_body")), model, ["_row", "_body"], "_body")
    return scored.where("predicted = 0").select(*[F.col("_body").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least id, nulls last; of those with one id, the least text's hash.

    Documents without words (null, empty, white space) are linked with nothing and all stay, repeated rows
    among them. Of other repeated rows one stays. An empty table stays empty. Texts are compared whole.
    Extra columns stay as they are.
    """
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")) == ""
    # A group's first id is its component's, so among the rows that have it the least text decides.
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("n_shingles") > 0)
    judged = minhash.near_duplicates(docs, shingle=5).where(first).groupBy("_class").agg(F.min("doc_id").alias("_doc"), F.min("_text_hash").alias("_kept")).drop("_class")
    rows = docs.where(~bare).select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    kept = rows.join(judged, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_kept")))
    return kept.dropDuplicates(["_id", "_hash"]).select("_row.*").unionByName(docs.where(bare))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials replaced and n_chars counted anew (null for a null text).

    Null ids, sources and languages are values of their own; repeated rows are treated alike; texts are
    scanned whole; overlapping credentials make one mark; an empty table stays empty; extra columns stay.
    """
    found = secrets.find_secrets(docs, "doc_id", F.concat_ws("/", "source", "lang"), F.col("source"))
    fixed = secrets.redact(docs, found, "doc_id")
    return fixed.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole time; documents without words once.

    A null source is a source of its own, last; rows with one id and text are taken equally often; texts
    are taken whole; ties in the shuffle are settled by the rows themselves; an empty table stays empty;
    extra columns stay as they are.
    """
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
    taken = mixing.mix(docs).select(F.col("doc_id").alias("_doc"), F.col("_text_hash").alias("_hash"), times.alias("_times")).where("_times > 0").dropDuplicates(["_doc", "_hash"])
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
    joined = rows.join(taken, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_hash")))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences.

    A null text is a single 0; a null source is a queue of its own; repeated rows are separate documents;
    long texts are cut over many sequences; ties in a queue are settled by the rows; an empty table gives
    no pieces; extra columns are not returned.
    """
    return packing.pack(docs, tokenizer(), with_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can not express the trained tagger or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
