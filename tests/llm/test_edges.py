"""Hard rows for every operator and every pipeline stage: nulls, long and empty texts, ties, repeats, clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitgraph.llm import fingerprints, licenses, minhash, mixing, packing, quality, queries, secrets, substring, toxicity, warc

#: Every name that an operator or a stage uses for a column of its own.
CLASH = (
    "_id", "_doc", "_text", "_hash", "_row", "_key", "_null", "_lang", "_body", "_t", "_w", "_s", "_h", "_b", "_cuts", "_kept", "_class", "_times", "_copy", "_page", "_url", "_refers",
    "value", "size", "target", "taken", "words", "at", "start", "end", "n", "score", "predicted", "spans", "component_id", "kept", "n_words", "base", "owner", "repository", "rank", "slot", "blocks", "label",
)


def text(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijk"), 5)) for _ in range(n))


def rows():
    rng = np.random.default_rng(5)
    a, long_ = text(rng, 90), text(rng, 120_000)
    texts = [a, a, a + " end", None, None, "", " \n\t ", "one", long_, "x " * 50_000, "token=Abc123xyz All rights reserved. É ß 日本", text(rng, 70)]
    ids = [1, 1, 2, None, 3, 4, 5, None, 7, 8, 9, 9]
    return [(i, t, None if k % 5 == 4 else "en", None if k % 4 == 3 else f"s{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


BASE = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark):
    docs = spark.createDataFrame(rows(), BASE)
    wide = docs.select("*", *[F.lit("clash").alias(c) for c in CLASH])
    return docs, wide, wide.limit(0)


def taught(docs, labels):
    return toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"]).drop("spans")


OPERATORS = {
    "minhash": (lambda d: minhash.near_duplicates(d).drop("_class"), 12),
    "fingerprints": (fingerprints.fingerprint, 12),
    "secrets": (lambda d: secrets.find_secrets(d, "doc_id", F.concat_ws("/", "source", "lang"), F.col("source")), 12),
    "warc": (lambda d: warc.archive(d, None, "doc_id", "lang", "text")[1], 12),
    "packing": (lambda d: packing.pack(d, queries.tokenizer(), sequence=4096).groupBy("doc_id").agg(F.sum("length").alias("n")), 9),
    "mixing": (lambda d: mixing.mix(d).drop("_row"), 12),
    "substring": (substring.remove_repeats, 12),
    "quality": (lambda d: quality.judge_quality(d).select("doc_id", *quality.RESULTS), 12),
    "licenses": (licenses.scan_licenses, 1),
    "toxicity": (lambda d: taught(d, d.sparkSession.createDataFrame([(1, 0), (8, 1), (None, 1), (2, None)], "doc_id long, toxic int")), 12),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(spark, name):
    """Other columns, whatever their names, change nothing; an empty table gives an empty result."""
    run, n = OPERATORS[name]
    docs, wide, none = tables(spark)
    plain = sorted(map(repr, run(docs).collect()))
    assert len(plain) == n
    assert sorted(map(repr, run(wide).collect())) == plain
    assert run(none).collect() == []


def test_pipeline_on_hard_rows(spark, tmp_path):
    import corpus_pipeline

    docs, wide, _ = tables(spark)
    spark.createDataFrame([(1, 0), (8, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {}
    for kind, d in (("plain", docs), ("wide", wide)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, str(tmp_path))
            out.write.parquet(str(tmp_path / kind / str(k)))
            d, before = spark.read.parquet(str(tmp_path / kind / str(k))), d
            if name != "packing":
                assert d.columns == before.columns, name
            if name in ("toxicity", "secrets"):
                assert d.count() == before.count()
            if name == "near-duplicates":
                # Two copies and the near one make one; documents without words all stay.
                assert sorted(r["doc_id"] or 0 for r in d.select("doc_id").collect()) == [0, 0, 1, 3, 4, 5, 7, 8, 9, 9]
            if name == "secrets":
                assert d.where(F.col("text").contains("[secret]")).count() == 1 and d.where("text is null and n_chars is null").count() == 2
        left[kind] = sorted(map(repr, d.collect()))
    assert left["plain"] == left["wide"] and left["plain"]


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    _, _, none = tables(spark)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
