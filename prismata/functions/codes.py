"""Hierarchical dotted codes and `;` lists of them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_list(codes: Column) -> Column:
    """A `;` list as an array of trimmed codes without empty ones; duplicates stay, null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(codes, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def level(code: Column, i: int) -> Column:
    """Level 1 to 4; empty where the code is shorter."""
    return F.coalesce(F.get(F.split(code, "\\."), F.lit(i - 1)), F.lit(""))


def ancestor(code: Column, depth: int) -> Column:
    return F.substring_index(code, ".", depth)


def is_full(code: Column) -> Column:
    """Exactly four levels, none empty or unknown."""
    parts = F.split(code, "\\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda x: ~x.isin("", "-"))


def is_partial(code: Column) -> Column:
    return code.contains("-") | F.upper(code).isin("NA", "N/A")


def or_na(value: Column) -> Column:
    """Unknown levels become NA; so do missing ones (a null would otherwise turn into text)."""
    return F.when(value.isNull() | F.trim(value).isin("", "-", "nan"), F.lit("NA")).otherwise(F.trim(value))


def contains_code(codes: Column, code: Column) -> Column:
    return F.array_contains(code_list(codes), code)


def sanitized(code: Column) -> Column:
    """A code as a file name."""
    return F.replace(F.translate(code, "/.", "__"), F.lit("-"), F.lit("neg"))


def first_filled(*columns: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def node(depth: int, value: Column) -> Column:
    return F.concat(F.lit(f"EC{depth}:"), value)


def natural_order(value: Column) -> list[Column]:
    """Sort keys: numbers by value, then texts, NA last."""
    number = value.try_cast("double")
    return [F.when(value == "NA", 2).when(number.isNotNull(), 0).otherwise(1), number, value]
