"""Season files: timing, scoring and field geometry of a year's game, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What every season file must hold.
REQUIRED = ("season", "game_name", "match_timing", "field_geometry.field_length_m", "field_geometry.field_width_m")


def _holds(schema, name: str, *rest: str) -> bool:
    return name in getattr(schema, "names", ()) and (not rest or _holds(schema[name].dataType, *rest))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a season; an error names the fields that are missing."""
    found = spark.read.json(path, multiLine=True)
    missing = [c for c in REQUIRED if not _holds(found.schema, *c.split("."))]
    if missing:
        raise ValueError(f"season file lacks {', '.join(missing)}")
    return found


def info(seasons: DataFrame, season: int | None = None) -> DataFrame:
    """The season asked for, or the latest."""
    if season is not None:
        return seasons.where(F.col("season") == season)
    return seasons.orderBy(F.desc("season")).limit(1)
