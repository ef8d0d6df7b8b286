"""Values of samples as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number() -> Column:
    """Doubles and whole numbers: what statistics take."""
    return F.coalesce("v_num", F.col("v_long").cast("double"))


def number_or_flag() -> Column:
    """Numbers, and booleans as 1 and 0: what interpolation, agreement and quality take."""
    return F.coalesce(number(), F.col("v_bool").cast("double"))


def json_number(column: str, path: str) -> Column:
    """A number within a JSON text; null where it is missing or something else."""
    return F.get_json_object(column, path).try_cast("double")
