"""Shards along a Hilbert curve, by DataFrame functions alone.

Metadata columns are quantised to a few bits each and the cell's place on the Hilbert curve through that grid is looked up. Rows are
ordered by (curve index, bucket, id) and the order is cut into runs whose counts differ by one at most, so a shard's files cover a compact
region of all dimensions and min/max statistics of any of them prune files. The rank of a row is the number of rows in earlier (cell, bucket)
groups plus its place in its own group; only counts of groups are summed globally. A cell has a bucket for every BUCKET_ROWS of its rows, by
a hash of the row, so that one which holds a third of all rows is split accordingly; equal rows are counted before the shuffle and get
places one after another. Only the counts of cells, 2**16 at most, are broadcast.

Defined results: a null dimension is quantised as 0; null text has no bytes; ties and repeated rows get places of their own; an empty
table gives no rows; columns not named are not read, or, by write_shards, written as they are. law is always "rows"; grown_shard is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.llm.common import durable

SHARDS, BITS, BUCKET_ROWS = 24, 4, 1000


def curve(dims: int, bits: int) -> list[int]:
    """For each cell (first dimension in the highest bits) its place on the Hilbert curve; at most 2**16 cells."""
    if dims * bits > 16:
        raise ValueError("the curve's table is for 16 bits at most")

    def place(cell: int) -> int:
        x = [(cell >> bits * (dims - 1 - i)) & ((1 << bits) - 1) for i in range(dims)]
        # Undo the rotations and reflections level by level, then read the bits as a Gray code.
        for level in range(bits - 1, 0, -1):
            low = (1 << level) - 1
            for i in range(dims):
                if x[i] >> level & 1:
                    x[0] ^= low
                else:
                    swap = (x[0] ^ x[i]) & low
                    x[0] ^= swap
                    x[i] ^= swap
        gray = 0
        for level in range(bits - 1, -1, -1):
            for i in range(dims):
                gray = gray << 1 | (x[i] >> level & 1)
        shift, h = 1, gray
        while shift < dims * bits:
            h ^= h >> shift
            shift *= 2
        return h

    return [place(c) for c in range(1 << dims * bits)]


def quantised_text(column: str, bits: int = BITS) -> Column:
    """A bucket of a name: leading bits of its MD5."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(column).cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(0)) % (1 << bits)


def quantised_size(column: str, bits: int = BITS) -> Column:
    """The number of binary digits of a size, below 2**bits."""
    n = F.greatest(F.coalesce(F.col(column).cast("long"), F.lit(0)), F.lit(0))
    return F.least(F.when(n > 0, F.length(F.bin(n))).otherwise(0), F.lit((1 << bits) - 1))


def cell_of(dims: list[Column], bits: int = BITS) -> Column:
    code = F.lit(0)
    for d in dims:
        code = code * (1 << bits) + d
    return F.element_at(F.array(*(F.lit(h) for h in curve(len(dims), bits))), code.cast("int") + 1)


def runs(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """rows (cell, spread, times, others) with shard and slot. spread: a text that parts the rows of a cell; times: equal rows that a row
    stands for, which become as many rows; order: the columns that order the rows of a bucket."""
    cell_rows = durable(rows.groupBy("cell").agg(F.sum("times").alias("n")))
    total = max(1, cell_rows.agg(F.sum("n")).first()[0] or 0)
    split = cell_rows.select("cell", F.expr(f"cast((n + {BUCKET_ROWS - 1}) div {BUCKET_ROWS} as bigint)").alias("buckets"))
    bucket = F.conv(F.substring(F.md5(F.col("spread").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("buckets")
    place = rows.join(F.broadcast(split), "cell").withColumn("bucket", bucket)
    # One row a group; the cells are 2**16 at most, and within a cell the sum runs over its buckets.
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = place.groupBy("cell", "bucket").agg(F.sum("times").alias("n"))
    groups = groups.withColumn("in_cell", before("n", Window.partitionBy("cell").orderBy("bucket"))).drop("n")
    cells = cell_rows.select("cell", before("n", Window.orderBy("cell")).alias("earlier"))
    first = groups.join(F.broadcast(cells), "cell").select("cell", "bucket", (F.col("earlier") + F.col("in_cell")).alias("before"))
    ranked = place.join(first, ["cell", "bucket"]).withColumn("own", before("times", Window.partitionBy("cell", "bucket").orderBy(*order)))
    ranked = ranked.withColumn("equal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    # Integer division, so that a large rank is not rounded.
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own") + F.col("equal")).withColumn("shard", F.expr(f"cast((rank * {shards}L) div {total}L as int)"))
    start = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("slot", (F.col("rank") - start).cast("long")).drop("spread", "times", "buckets", "bucket", "before", "own", "equal", "rank")


def shard(df: DataFrame, dims: list[Column], shards: int = SHARDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    rows = df.select(cell_of(dims, bits).alias("cell"), *own).groupBy("cell", "doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    spread = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32"), F.col("size"))
    placed = runs(rows.withColumn("spread", spread), ["doc_id", "text_crc32", "size"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, dims: list[Column], path: str, shards: int = SHARDS, bits: int = BITS, files: int | None = None, folder: str = "hilbert_shard") -> None:
    """Writes df, with all its columns, as Parquet in a folder a shard, along the curve; `files` ranges (a shard each unless given) are tasks."""
    row = F.struct("*")
    rows = df.select(cell_of(dims, bits).alias("cell"), row.alias("row"), F.xxhash64(row).cast("string").alias("spread"), F.lit(1).cast("long").alias("times"))
    placed = runs(rows.withColumn("hash", F.col("spread").cast("long")), ["hash"], shards)
    ranged = placed.repartitionByRange(files or shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)


def dimensions() -> list[Column]:
    """Language, source and length of a document."""
    return [quantised_text("lang"), quantised_text("source"), quantised_size("n_chars")]


def shard_documents(docs: DataFrame) -> DataFrame:
    return shard(docs, dimensions())
