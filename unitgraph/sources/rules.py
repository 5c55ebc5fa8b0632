"""Rule files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "rule_pos int, allow boolean, pattern string, line int"


class RuleError(ValueError):
    """A rule that can not be read; names its source and line."""


def _parsed(lines: DataFrame) -> DataFrame:
    text = F.trim(F.regexp_replace("text", r"(#|//).*$", ""))
    rows = lines.withColumn("text", text).where("text != ''")
    return rows.withColumn("allow", F.col("text").startswith("!")).withColumn("pattern", F.trim(F.regexp_replace("text", "^!", "")))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """One glob a line; ``!`` allows; ``#`` and ``//`` begin comments; blank lines count but say nothing.

    A missing file, a bare ``!`` and a space within a pattern are errors.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("pos", "text"))
    rows = _parsed(lines.withColumn("line", F.col("pos") + 1))
    bad = rows.where((F.col("pattern") == "") | F.col("pattern").rlike(r"\s")).orderBy("line").limit(1).collect()
    if bad:
        raise RuleError(f"{path}({bad[0]['line']}): " + ("a pattern is missing after !" if not bad[0]["pattern"] else "one pattern a line"))
    return rows.select((F.row_number().over(Window.orderBy("line"))).alias("rule_pos"), "allow", "pattern", "line")


def rules_from_lists(spark: SparkSession, forbid: str = "", allow: str = "") -> DataFrame:
    """Rules from ``;`` or ``,`` lists; values are trimmed, empty ones ignored, and have line 0."""
    rows, cut = [], str.maketrans(",", ";")
    for text, is_allow in ((forbid, False), (allow, True)):
        for p in filter(None, (x.strip() for x in text.translate(cut).split(";"))):
            is_not = p.startswith("!")
            rows.append((len(rows) + 1, is_allow or is_not, p.removeprefix("!").strip(), 0))
    bad = [r for r in rows if not r[2] or any(c.isspace() for c in r[2])]
    if bad:
        raise RuleError(f"not a pattern: {bad[0][2]!r}")
    return spark.createDataFrame(rows, SCHEMA)


def combine_rules(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second set's rules after the first's."""
    last = first.agg(F.coalesce(F.max("rule_pos"), F.lit(0))).first()[0]
    return first.unionByName(second.withColumn("rule_pos", F.col("rule_pos") + F.lit(last)))
