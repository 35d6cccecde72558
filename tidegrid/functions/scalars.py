"""Small column and header functions of the loader."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRAILING_DIGITS = re.compile(r"^(.*?)(\d*)$", re.DOTALL | re.ASCII)


def is_empty(cell: Column) -> Column:
    """Whether a text cell holds nothing."""
    return F.coalesce(cell, F.lit("")) == ""


def holds(ok: Column, message: Column) -> Column:
    """A condition for ``filter``: true, or a failing query where ``ok`` is not true.

    As a filter it stays in the plan whichever columns are read later, also under a count.
    """
    return F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean"))


def parsed_or_fail(cell: Column, parsed: Column, what: str) -> Column:
    """A condition for ``filter``: ``parsed`` is there, or the query fails."""
    return holds(parsed.isNotNull(), F.concat(F.lit(f"cannot read {what}: "), F.coalesce(cell, F.lit(""))))


def to_epoch_ms(seconds: Column) -> Column:
    """Text or numeric seconds as epoch milliseconds, truncated toward zero."""
    return (seconds.try_cast("double") * 1000).cast("long")


def split_header(header: str) -> tuple[str, int | None]:
    """Prefix and trailing number of a column name."""
    prefix, digits = _TRAILING_DIGITS.match(header).groups()
    return prefix, int(digits) if digits else None
