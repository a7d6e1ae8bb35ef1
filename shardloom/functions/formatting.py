"""Report text. Patterns of ``format_number`` round half-even on the exact binary value, as C and Python
``%.2f`` do; ``format_string('%.2f')`` of the JVM rounds the decimal text half-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(value: Column, decimals: int = 2) -> Column:
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def mb_to_gb(size_mb: Column) -> Column:
    return fixed(size_mb.cast("double") / 1024)


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def fixed_or_missing(value: Column, decimals: int = 1, missing: str = "N/A") -> Column:
    return F.coalesce(fixed(value, decimals), F.lit(missing))
