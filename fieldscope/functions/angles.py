"""Sine, cosine and arc tangent by the C library, as SQL engines take them.

The JVM's own differ from it in the last digit, which decides a comparison with a threshold that an angle meets exactly. numpy's depend on the
processor.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.arrow_udf(DoubleType())
def sine(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else math.sin(v) if math.isfinite(v) else math.nan for v in x.to_pylist()], pa.float64())


@F.arrow_udf(DoubleType())
def cosine(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else math.cos(v) if math.isfinite(v) else math.nan for v in x.to_pylist()], pa.float64())


@F.arrow_udf(DoubleType())
def arctan2(y: pa.Array, x: pa.Array) -> pa.Array:
    return pa.array([None if u is None or v is None else math.atan2(u, v) for u, v in zip(y.to_pylist(), x.to_pylist())], pa.float64())
