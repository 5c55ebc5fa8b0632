"""Names, globs and labels, as column expressions. Names are compared without regard to case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTIONS = ("program", "interface", "implementation")
CERTAINTIES = ("unconditional", "conditional", "unevaluated")
KINDS = ("program", "project", "package", "library", "rtl", "unresolved")


def key(name: Column) -> Column:
    """The identity of a unit's name. Unicode-aware."""
    return F.upper(name)


def ordinal(value: Column, values: tuple[str, ...]) -> Column:
    out = F.lit(len(values))
    for i, v in enumerate(values):
        out = F.when(value == v, i).otherwise(out)
    return out


def glob_match(pattern: Column, value: Column) -> Column:
    """Whole-string glob: ``*`` any run, ``?`` one character, all else literal; an empty pattern matches nothing."""
    escaped = F.upper(pattern)
    for c in "!%_":
        escaped = F.replace(escaped, F.lit(c), F.lit("!" + c))
    like = F.replace(F.replace(escaped, F.lit("*"), F.lit("%")), F.lit("?"), F.lit("_"))
    return (pattern != "") & F.like(F.upper(value), like, F.lit("!"))


def is_wildcard(pattern: Column) -> Column:
    return F.contains(pattern, F.lit("*")) | F.contains(pattern, F.lit("?"))


def tri_and(a: Column, b: Column) -> Column:
    """Kleene logic, null being unknown: SQL's own."""
    return a & b


def tri_or(a: Column, b: Column) -> Column:
    return a | b


def tri_not(a: Column) -> Column:
    return ~a


def short_section(section: Column) -> Column:
    return F.when(section == "program", "prog").when(section == "interface", "intf").otherwise("impl")


def guard_label(certainty: Column, cond: Column) -> Column:
    return F.when(certainty == "conditional", cond).when(certainty == "unevaluated", F.concat(F.lit("unevaluated: "), cond)).otherwise("")


def file_name_only(path: Column) -> Column:
    return F.regexp_extract(path, r"[^\\/]*$", 0)


def place(file: Column, line: Column) -> Column:
    """``File.pas(12)``."""
    return F.concat(file_name_only(file), F.lit("("), line.cast("string"), F.lit(")"))


def step_label(section: Column, file: Column, line: Column, certainty: Column, cond: Column) -> Column:
    """Short section, place, and the guard if there is one."""
    guard = guard_label(certainty, cond)
    return F.concat_ws(" ", short_section(section), place(file, line), F.when(guard != "", F.concat(F.lit("["), guard, F.lit("]"))))
