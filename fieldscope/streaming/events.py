"""Streaming forms of threshold events and windowed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_statistics(stream: DataFrame, keys: list[str], length: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """count, min, max, mean by tumbling event-time windows; `time` is a timestamp column."""
    return stream.withWatermark("time", late).groupBy(F.window("time", length), *keys).agg(F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def hysteresis(stream: DataFrame, key: str, enter: float, leave: float) -> DataFrame:
    """key, begin, end of closed events, as hysteresis of the batch operators gives them; rows of a series must arrive in order."""
    import pandas as pd

    def run(k, frames, state: GroupState):
        begin, out = state.get[0] if state.exists else None, []
        for pdf in frames:
            for ts, v in pdf.sort_values("ts")[["ts", "value"]].itertuples(index=False):
                if begin is None and v < enter:
                    begin = ts
                elif begin is not None and v >= leave:
                    out.append((k[0], begin, ts))
                    begin = None
        state.update((begin,))
        yield pd.DataFrame(out, columns=[key, "begin", "end"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, begin double, end double", "begin double", "append", GroupStateTimeout.NoTimeout)
