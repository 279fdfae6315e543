"""Line dedup: range-partitioned line hashes, first occurrences streamed in sorted order, keep bitmaps per document.

Built-in functions only. A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at
least ``min_chars`` code points that occur in two or more documents keep their lines only in the smallest id.

Hashes are uniform, so the ranges need no sample: a line's range is where its hash lies among 2**53 places, and there are as many ranges as
shuffle partitions. A line that very many documents hold would fill one range; so hashes are first turned by a salt of the document,
which lays the rows of one key over all ranges. What is first in its key and salt, at most one document a range for a key, meets in a
second pass by key alone.

Edge cases: null or empty text is one empty line; rows with a null id hold no keys and lose no lines; a repeated row
gets the same bitmap as its twin, and rows that share an id with other text are told apart by a text hash; an empty
table gives no rows. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import ASCII_SPACE, ascii_lower, partitions, written


def _range(n: int, turn: Column | int = 0) -> Column:
    """Which of n ranges of equal width holds the hash h1, turned by ``turn`` ranges."""
    at = F.floor(F.shiftrightunsigned("h1", 11) / F.lit(float(2**53)) * n)
    return ((at + turn) % n).cast("int")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, text_hash, n_dropped, keep_words) of each document that loses a line.

    keep_words is the keep bitmap in 64-bit words, bit i % 64 of word i div 64 for line i; words with every bit set
    are left out, which is what compresses it.
    """
    n = partitions(docs.sparkSession)
    lines = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"), _text_hash(F.col(text_col)).alias("th"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line")
    )
    key = ascii_lower(F.btrim("line", F.lit(ASCII_SPACE)))
    hashes = (
        lines.select("doc", "th", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int").alias("salt"), "doc", "th", "pos")
    )
    # The range stands first among the window's keys, so the shuffle by it serves the window too.
    local = Window.partitionBy("range", "h1", "h2", "salt").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = written(hashes.withColumn("range", _range(n, F.col("salt"))).repartitionById(n, "range").withColumn("first", F.first("doc").over(local)).drop("range", "salt"))
    whole = Window.partitionBy("range", "h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = ranged.where("doc = first").withColumn("range", _range(n)).repartitionById(n, "range")
    dropped = (
        ranged.where("doc <> first")
        .select("doc", "th", "pos")
        .union(left.withColumn("least", F.first("doc").over(whole)).where("doc <> least").select("doc", "th", "pos"))
    )
    words = dropped.distinct().groupBy("doc", "th", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
    return words.groupBy("doc", "th").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep_words"),
    ).select(F.col("doc").alias("id"), F.col("th").alias("text_hash"), "n_dropped", "keep_words")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as struct ``row`` with n_lines, n_dropped, keep_words and kept_text (the lines that stay, joined by \\n)."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), _text_hash(F.col(text_col)).alias("text_hash"))
    joined = rows.join(bitmaps, ["id", "text_hash"], "left")
    n_words = F.expr("cast((size(lines) + 63) div 64 as int)")
    known = F.map_from_entries("keep_words")
    dense = F.transform(F.sequence(F.lit(0), n_words - 1), lambda w: F.coalesce(F.try_element_at(known, w), F.lit(-1).cast("long")))
    out = joined.withColumn("lines", _lines(F.col("text")))
    out = out.withColumn("dense", F.when(F.col("keep_words").isNotNull(), dense))
    kept = F.expr("array_join(filter(lines, (x, i) -> (shiftright(dense[i div 64], cast(i % 64 as int)) & 1L) = 1L), '\\n')")
    return out.select(
        "row", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep_words",
        F.when(F.col("keep_words").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)
