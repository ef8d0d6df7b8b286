"""Export of one entry to CSV."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_rows(samples: DataFrame) -> DataFrame:
    """timestamp, index, field, value: arrays, structs and arrays of structs give a row for each element; raw bytes as hexadecimal text.

    One pass: a sample's elements are put into one array, of which there is one kind a sample, and spread.
    """
    cell = "array<struct<index:int,field:string,value:string>>"
    none = F.array().cast(cell)
    text = lambda c: c.cast("string")
    row = lambda value, index=F.lit(None).cast("int"), field=F.lit(None).cast("string"): F.struct(index.alias("index"), field.alias("field"), value.alias("value"))
    fields = lambda m, index: F.transform(F.map_entries(m), lambda e: row(text(e["value"]), index, e["key"]))
    has = lambda c: c in samples.columns
    scalars = [text(F.col(c)) for c in ("v_num", "v_bool", "v_str") if has(c)] + [F.lower(F.hex("v_raw"))] * has("v_raw")
    one = F.coalesce(*scalars)
    parts = [F.when(one.isNotNull(), F.array(row(one)))]
    for c in ("v_arr_num", "v_arr_str"):
        if has(c):
            parts.append(F.transform(c, lambda x, i: row(text(x), i.cast("int"))))
    if has("v_struct"):
        parts.append(fields(F.col("v_struct"), F.lit(None).cast("int")))
    if has("v_structs"):
        parts.append(F.flatten(F.transform("v_structs", lambda m, i: fields(m, i.cast("int")))))
    cells = F.concat(*(F.coalesce(x.cast(cell), none) for x in parts))
    return samples.select(F.col("ts").alias("timestamp"), F.explode(cells).alias("c")).select("timestamp", "c.index", "c.field", "c.value")


def export_csv(samples: DataFrame, entry: str, directory: str, name: str) -> str:
    """Writes into the export directory only."""
    target = os.path.realpath(os.path.join(directory, name))
    if os.path.commonpath([target, os.path.realpath(directory)]) != os.path.realpath(directory):
        raise ValueError("the output path leaves the export directory")
    csv_rows(samples.where(F.col("entry") == entry)).orderBy("timestamp", "index").write.csv(target, header=True, escape='"', mode="overwrite")
    return target
