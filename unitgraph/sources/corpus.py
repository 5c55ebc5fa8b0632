"""Source files as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def decoded(raw: bytes, fallback: str = "cp1252") -> str:
    """A file's text: by its byte order mark, which is left out, else UTF-8, else ``fallback``; never an error."""
    for mark, charset in BOMS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(charset, "replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode(fallback, "replace")


def _files(spark: SparkSession, paths: str | list[str], pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths)


def read_corpus(spark: SparkSession, paths: str | list[str], pattern: str | None = None, fallback: str = "cp1252") -> DataFrame:
    """(path, folder, file_name, file_name_lower, ext, content) of the files under folders.

    Files in UTF-8, with or without a byte order mark, and in UTF-16 with one are read as such, others in
    the ``fallback`` charset. Spark's reader passes over files without a byte. Unreadable files do not fail the job; ``unreadable`` lists them. Without
    ``content`` the frame is the listing that names are resolved against, and contents are not read.
    """

    @F.pandas_udf("string")
    def text(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: decoded(x, fallback))

    name = F.regexp_extract("path", r"[^/]*$", 0)
    return _files(spark, paths, pattern).select(
        "path", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), name.alias("file_name"), F.lower(name).alias("file_name_lower"),
        F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)).alias("ext"), text("content").alias("content"))


def unreadable(spark: SparkSession, paths: str | list[str], read: DataFrame, pattern: str | None = None) -> DataFrame:
    """(file, line, message): a warning for each listed file whose content is not among those ``read``."""
    listed = _files(spark, paths, pattern).select("path")
    missed = listed.join(read.where("content is not null").select("path"), "path", "left_anti")
    return missed.select(F.col("path").alias("file"), F.lit(0).alias("line"), F.lit("could not read").alias("message"))


def listing(corpus: DataFrame) -> DataFrame:
    return corpus.select("folder", "file_name")
