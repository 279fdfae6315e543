"""Two-pass external shuffle into shards.

Pass 1 scatters the records uniformly into buckets by a seeded hash; there are so many buckets that each holds about ``bucket_bytes``.
Pass 2 loads one bucket at a time, puts it in a fixed order and shuffles it (Fisher-Yates, seeded by bucket). The buckets one
after the other are a random permutation of all records; the record at place p goes to shard p mod n, slot p div n,
so counts of shards are at most one apart and slots have no gaps (law ``rows``).

The hash covers the record's id, its text's checksum and its place in the input (path of the file and row index), so a group of copies of any
size spreads over all buckets, rows equal in everything too. Input that is not read from files is written once first: places
must be the same when a lost task runs again. The permutation is fixed by the seed, the stored files and their paths. The buckets' offsets are summed in one task, from a row for each bucket.

Edge cases: null texts count 8 bytes and have the checksum of the empty text; null ids and repeated rows are placed like others;
an empty table gives no rows; columns may have any name and type, nullable or not, as they travel in a struct.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from quarry.llm.common import partitions, placed, schema

BUCKET_BYTES = 16 << 20
#: Buckets up to which their offsets (two numbers each) are broadcast; beyond it the join shuffles.
BROADCAST_BUCKETS = 100_000


def shuffle_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs' rows as struct ``row`` with size, text_crc32, bucket and place (long, from 0, all records permuted)."""
    size = F.coalesce(F.octet_length(F.col("row")[text_col]), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary"))
    rows = placed(docs.select(F.struct("*").alias("row")))
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    keyed = rows.select("row", size.alias("size"), crc.alias("text_crc32"), F.xxhash64(F.lit(seed), F.col("row")[id_col].cast("string"), crc, "_at").alias("key"), "_at")
    unit = F.shiftrightunsigned("key", 11) / F.lit(float(2**53))
    scattered = keyed.select("row", "size", "text_crc32", "key", F.col("_at.file").alias("file"), F.col("_at.row").alias("index"), F.floor(unit * n).cast("int").alias("bucket"))

    def shuffle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("key", "file", "index")]))
        order = np.random.default_rng((seed, bucket)).permutation(len(table))
        return table.take(pa.array(order)).append_column("at", pa.array(np.arange(len(table)), pa.int64())).select(["row", "size", "text_crc32", "bucket", "at"])

    kind = schema(row=scattered.schema["row"].dataType, size=LongType(), text_crc32=LongType(), bucket=IntegerType(), at=LongType())
    # Dealt by number, buckets are spread evenly over the tasks; by hash two of few buckets could meet in one.
    tasks = min(n, 16 * partitions(docs.sparkSession))
    dealt = scattered.withColumn("task", (F.col("bucket") % tasks).cast("int")).repartitionById(tasks, "task")
    shuffled = dealt.groupBy("task", "bucket").applyInArrow(shuffle, kind)
    sizes = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = sizes.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return shuffled.join(F.broadcast(offsets) if n <= BROADCAST_BUCKETS else offsets, "bucket").select("row", "size", "text_crc32", "bucket", (F.col("start") + F.col("at")).alias("place"))


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """shuffle_rows with shard (int) and slot (long, gapless from 0 within a shard)."""
    rows = shuffle_rows(docs, id_col, text_col, seed, bucket_bytes)
    return rows.withColumn("shard", (F.col("place") % n_shards).cast("int")).withColumn("slot", F.expr(f"place div {n_shards}"))


def write_shards(docs: DataFrame, path: str, n_shards: int, pieces: int = 1, **options) -> None:
    """The records as Parquet (``row``, slot), a folder per shard; a shard is written by ``pieces`` tasks, each a run of slots in order."""
    out = shard(docs, n_shards, **options).select("row", "shard", "slot")
    longest = max(1, -(-docs.count() // n_shards))
    piece = F.floor(F.col("slot") * pieces / longest).cast("int")
    dealt = out.withColumn("_to", F.col("shard") * pieces + piece).repartitionById(n_shards * pieces, "_to").drop("_to")
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
