"""The registered queries of this subpackage: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitgraph.llm import fingerprints, interaction, licenses, minhash, mixing, packing, quality, resampling, secrets, sharding, substring, toxicity, warc
from unitgraph.llm.common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2).drop("_text_hash", "_class")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, "doc_id", F.concat_ws("/", "source", "lang"), F.col("source"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), F.col("spans_text").alias("spans"), "n_live", "n_example")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))[1]


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), with_ids=False).drop("ids")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.judge_quality(docs).drop("lang").withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, ["doc_id"]).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.to_json("spans").alias("offending"))


def op11_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From six shards by text to eight of near equal bytes."""
    docs = table(spark, sf_dir, "documents")
    return sharding.digest(sharding.reshard(docs, sharding.hashed(F.col("text")), sharding.OLD_SHARDS, 8))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_fingerprints": op2_fingerprints,
        "op3_secrets": op3_secrets,
        "op4_warc": op4_warc,
        "op5_packing": op5_packing,
        "op6_mixing": op6_mixing,
        "op7_substring": op7_substring,
        "op8_quality": op8_quality,
        "op9_licenses": op9_licenses,
        "op10_toxicity": op10_toxicity,
        "op11_interaction": op11_interaction,
        "op12_resampling": op12_resampling,
        "op13_sharding": op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    from unitgraph.llm.sql import ORACLES

    return ORACLES
