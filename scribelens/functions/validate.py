"""Strict or quarantining checks of delimited rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fields_of(line: Column) -> Column:
    """Comma-separated fields; empty fields at the end of a line do not count."""
    return F.split(F.regexp_replace(line, ",+$", ""), ",", -1)


def split_fields(
    lines: DataFrame,
    names: list[str],
    on_error: str = "fail",
    message: str = "Data malformed",
) -> DataFrame:
    """Split the column ``value`` into named string fields.

    ``on_error="fail"`` raises when a row with another field count is read, as a job over
    trusted data should; ``"drop"`` keeps the good rows and leaves the rest to `malformed`.
    """
    parts = fields_of(F.col("value"))
    good = F.size(parts) == len(names)
    if on_error == "drop":
        return lines.where(good).select(*[parts[i].alias(n) for i, n in enumerate(names)])
    if on_error != "fail":
        raise ValueError(f"on_error must be 'fail' or 'drop', not {on_error!r}")
    # The check sits inside every field, so column pruning cannot optimise it away.
    checked = F.when(good, parts).otherwise(F.raise_error(F.lit(message)))
    return lines.select(checked.alias("_f")).select(
        *[F.col("_f")[i].alias(n) for i, n in enumerate(names)]
    )


def malformed(lines: DataFrame, fields: int) -> DataFrame:
    """The rows whose field count is not ``fields``."""
    n = F.size(fields_of(F.col("value")))
    return lines.where(n != fields).select("value", n.alias("n_fields"))


def int32(value: Column) -> Column:
    """Cast to INT, failing loudly on ids the factor model cannot hold."""
    inside = value.between(-(2**31), 2**31 - 1)
    return F.when(inside, value).otherwise(F.raise_error(F.lit("id outside the 32-bit range"))).cast("int")
