"""Importance resampling towards a target distribution by hashed n-grams. Built-in functions only.

Features of a text are its runs of 1 to ``orders`` consecutive words, repeats counted, hashed into ``buckets`` by crc32. A bucket's gain is the
logarithm (in thousandths, rounded down) of its smoothed share of the target's features over that of the corpus; a document's weight is the sum of its
features' gains. With Gumbel noise from a seeded hash of the id added, the highest scores are a sample without replacement in
proportion to exp(weight / 1000).

N-grams are exploded word by word, so a text of any length needs no list of its n-grams; buckets are counted where they are read, so a
shuffle moves a row for each bucket and task, and the gains (``buckets`` rows, a fixed number) are broadcast. Documents' sums are made beside
their texts. The ranks come from one distributed sort of narrow rows: a rank is the place in a partition plus the rows of all partitions before it.

Edge cases: null and empty texts have no features and weight 0; null ids draw noise as the empty id; repeated rows are
ranked one by one; rows equal in score and id lie in order of their place in the input; with an empty target, or none at all, smoothed shares stay defined; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import NO_WORD, ascii_lower, from_files, written

ORDERS, BUCKETS = 3, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 5, 42


#: ASCII characters that are in no word.
_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; null for a text without any."""
    body = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_GAPS))
    return F.when(body != "", F.split(body, NO_WORD))


def _features(rows: DataFrame, orders: int, buckets: int) -> DataFrame:
    """rows (with an array ``words``) as one row for each feature, with its ``bucket``; a row without words stays, with a null bucket."""
    columns = [c for c in rows.columns if c != "words"]
    at = rows.select(*columns, "words", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(1)))).alias("_i"))
    gram, grams = None, []
    for k in range(orders):
        word = F.try_element_at("words", F.col("_i") + k)
        gram = word if gram is None else F.concat(gram, F.lit(" "), word)
        grams.append(gram)  # null behind the last word
    each = at.select(*columns, F.col("words").isNull().alias("_none"), F.explode(F.array(*grams)).alias("_gram")).where("_gram is not null or _none")
    return each.select(*columns, (F.crc32(F.col("_gram").cast("binary")) % buckets).cast("int").alias("bucket"))


def bucket_counts(texts: DataFrame, text_col: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all texts' features."""
    rows = texts.select(words(F.col(text_col)).alias("words")).where("words is not null")
    return _features(rows, orders, buckets).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that corpus or target have; both are bucket counts, so of at most ``buckets`` rows."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    both = written(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    share = ((F.col("t") + 1).cast("double") * (F.col("all_s") + buckets)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000.0 * F.log(share)).alias("gain"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Noise in thousandths from the first 32 bits of a hash of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(place, id, n_words, n_features, weight, score) of each row; ``place`` is unique. docs that are not read from files are written once first."""
    docs = from_files(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    gain = gains(bucket_counts(docs, "text", orders, buckets), bucket_counts(target, target_text_col, orders, buckets), buckets)
    # A row is numbered, exploded and summed by the task that reads it, so its features don't leave it.
    rows = docs.select(F.monotonically_increasing_id().alias("place"), "id", words(F.col("text")).alias("words"))
    rows = rows.select("place", "id", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"), "words")
    weighed = _features(rows, orders, buckets).join(F.broadcast(gain), "bucket", "left")
    sums = weighed.groupBy("place", "id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    return sums.select("*", (F.col("weight") + gumbel(F.col("id"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """:func:`scores` with ``rank``, from 1 by falling score, then id: the best ``percent`` of the rows with at least ``least_words`` words; null for others."""
    every = written(scores(docs, target, **options))
    fit = every.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = [F.desc("score"), F.asc("id"), F.asc("place")]
    # Of a sorted partition's running number the upper bits are its own number, the lower ones the row's.
    numbered = written(fit.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()))
    part, row = F.shiftright("_n", 33), F.col("_n").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("rows"))
    # One row for each partition of the sort.
    starts = sizes.select("_part", (F.sum("rows").over(Window.orderBy("_part")) - F.col("rows")).alias("_start"))
    rank = F.col("_start") + row + 1
    ranked = numbered.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", F.when(rank <= drawn, rank))
    return ranked.select(*every.columns, "rank").unionByName(every.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
