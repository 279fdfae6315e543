"""Shared pieces: scratch tables in the shared folder, connected components, small column helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from quarry.sources.scratch import stored as written

#: ASCII white space, as the contracts give it: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def from_files(docs: DataFrame) -> DataFrame:
    """docs if it is read from files, so that a task that runs again reads the same rows in the same order; else docs written once."""
    try:
        docs.select(docs.metadataColumn("_metadata"))
        return docs
    except AnalysisException:
        return written(docs)


def placed(docs: DataFrame, name: str = "_at") -> DataFrame:
    """docs with each row's place: file (its whole path, as names repeat in the folders of a partitioned table) and row index in it.

    What is not read from files is written once first, so that places survive retries, and so is what reads a file twice: places are unique.
    """
    at = lambda df: F.struct(df.metadataColumn("_metadata").getField("file_path").alias("file"), df.metadataColumn("_metadata").getField("row_index").alias("row"))
    docs = from_files(docs)
    # No column is read for it. A file that is read twice gives more rows than it holds.
    files = docs.select(at(docs).alias("at")).groupBy("at.file").agg(F.count("*").alias("n"), F.max("at.row").alias("last"))
    docs = written(docs) if files.where("n > last + 1").limit(1).count() else docs
    return docs.select("*", at(docs).alias(name))


def schema(**fields: DataType) -> StructType:
    """A schema of nullable columns, for types that a DDL string can't spell (not-null fields inside a struct)."""
    return StructType([StructField(n, t, True) for n, t in fields.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone; the built-in lower() serves where the text is ASCII anyway."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


#: What stands between words after lower-casing; bytes beyond ASCII belong to words.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): words of all texts one after the other, A-Z lower-cased, and where each text's begin. Null texts have none."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), NO_WORD)
    pieces = lists.flatten()
    real = pc.greater(pc.binary_length(pieces), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))]).astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return before[offsets - offsets[0]], pieces.filter(real)


def runs_of(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """[from, to) of runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) + 1)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + size, "right")))
        yield low, high
        low = high


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of an edge (a, b): component is the smallest id reachable.

    Alternates the large-star and small-star rewiring. A round groups with map-side combine, so a node with
    very many neighbours costs one aggregated row per task; the join back may be split by AQE. No edges give no rows.
    """
    tree = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m")).distinct())
    before = None
    for _ in range(max_rounds):
        now = tuple(tree.agg(F.count("*"), F.sum(F.xxhash64("u", "m").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        both = tree.select("u", F.col("m").alias("v")).union(tree.select(F.col("m").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), "m").where("u <> m").distinct()
        low = large.groupBy("u").agg(F.min("m").alias("least"))
        small = large.join(low, "u").select("u", "m", "least")
        tree = written(small.select("u", F.col("least").alias("m")).union(small.where("m <> least").select(F.col("m").alias("u"), F.col("least").alias("m"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = tree.select(F.col("m").alias("id")).distinct()
    return tree.select(F.col("u").alias("id"), F.col("m").alias("component")).union(roots.select("id", F.col("id").alias("component")))
