"""Corpus ingest: cache lookup by content, chunking, ids, drift between two states, replace by source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.markdown import chunk_texts
from quarry.functions.text import content_hash, py_strip, safe_name
from quarry.sources.scratch import stored

LEAST_TRANSLATION = 10
#: Of a content tree: slices below a slice (one hex digit), keys in a lowest one.
FAN_OUT, SLICE_KEYS = 16, 64


def split_by_cache(docs: DataFrame, cache: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits with ``translated``, misses) by md5 of the text. cache: (key, translated).

    Only keys meet: texts are joined once, and equal texts cost one cache row.
    """
    keyed = docs.withColumn("key", content_hash(F.col(text_col)))
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")


def translate(docs: DataFrame, cache: DataFrame, translator: Column, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs with ``text`` and ``translated_ok``, new cache rows). The translator, any column over the text, sees each missing text once.

    Results that are empty or of at most ten characters are failures: the source text stays and nothing is cached.
    """
    _, misses = split_by_cache(docs, cache, text_col)
    new = misses.groupBy("key").agg(F.min(text_col).alias(text_col)).select("key", translator.alias("translated"))
    new = new.where(F.length(F.coalesce(F.trim("translated"), F.lit(""))) > LEAST_TRANSLATION)
    every = cache.unionByName(new)
    out = docs.withColumn("key", content_hash(F.col(text_col))).join(every, "key", "left")
    return out.withColumn(text_col, F.coalesce("translated", text_col)).withColumn("translated_ok", F.col("translated").isNotNull()).drop("translated"), new


def next_version(prev: str, new: str, docs: DataFrame) -> str:
    """The corpus version advances only if nothing failed."""
    return prev if docs.where(~F.col("translated_ok")).limit(1).count() else new


def chunk(docs: DataFrame, file_col: str, text_col: str, source: Column, model: str | None = None) -> DataFrame:
    """(chunk_id, source_file, chunk_index, text, chunk_hash, source): numbered within each file, hashed without outer white space.

    Chunking is row by row, so it needs no shuffle. Ids hold file and number: equal texts in two files stay apart.
    """
    rows = docs.select(F.col(file_col).alias("source_file"), source.alias("source"), F.posexplode(chunk_texts(F.col(text_col))).alias("chunk_index", "text"))
    rows = rows.withColumn("chunk_hash", content_hash(F.col("text")))
    out = rows.withColumn("chunk_id", F.md5(F.concat_ws("|", "source", F.col("source_file").cast("string"), F.col("chunk_index").cast("string"), "chunk_hash").cast("binary")))
    return out.withColumn("model", F.lit(model)) if model else out


def numbered(chunks: DataFrame, order: Sequence[str], out: str = "number") -> DataFrame:
    """chunks with a running number over all of them, from 0, in an order that is unique.

    Ranges of the order are numbered by themselves; what meets in one place is one count a range.
    """
    ranged = stored(chunks.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(starts), "_range").select(*chunks.columns, (F.col("_start") + F.col("_place") - 1).alias(out))


def split_sections(files: DataFrame, text_col: str = "text", least: int = 50, prefix: str = "sections") -> DataFrame:
    """(topic, text, chunk_hash, source): one file cut before each level-2 heading; short blocks are dropped."""
    block = files.select(F.explode(F.split(F.col(text_col), r"\n(?=## )")).alias("text")).select(py_strip(F.col("text")).alias("text")).where(F.length("text") >= least)
    topic = F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), "^#+", ""))
    return _named(block.withColumn("topic", topic), prefix)


def whole_files(files: DataFrame, path_col: str, text_col: str = "text", prefix: str = "files") -> DataFrame:
    """The same for files that are one chunk each; the topic is the first part of the path."""
    block = files.select(F.col(path_col).alias("path"), py_strip(F.col(text_col)).alias("text")).where("text <> ''")
    return _named(block.withColumn("topic", F.split("path", "/")[0]), prefix)


def _named(rows: DataFrame, prefix: str) -> DataFrame:
    hashed = rows.withColumn("chunk_hash", content_hash(F.col("text")))
    return hashed.withColumn("source", F.concat_ws("_", F.lit(prefix), safe_name(F.col("topic")), F.substring("chunk_hash", 1, 8)))


def union_families(*families: DataFrame) -> DataFrame:
    """Chunks of all layouts; columns that one lacks are null."""
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def manifest(docs: DataFrame, path_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(path_col).alias("path"), content_hash(F.col(text_col)).alias("md5"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of paths added, removed or modified between two manifests (path, md5)."""
    b, a = before.select("path", F.col("md5").alias("old")), after.select("path", F.col("md5").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return b.join(a, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("path", change.alias("change"))


def changed_paths(upstream: DataFrame, local: DataFrame, dirty: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, ord) of upstream changes, local changes and dirty files whose content is not indexed yet; first mention counts.

    upstream, local: (path); dirty: (path, md5); indexed: (md5).
    """
    fresh = dirty.join(indexed.select("md5").distinct(), "md5", "left_anti").select("path")
    every = upstream.select("path", F.lit(0).alias("ord")).union(local.select("path", F.lit(1))).union(fresh.select("path", F.lit(2)))
    return every.groupBy("path").agg(F.min("ord").alias("ord"))


def to_embed(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks without a vector of the same model: running ingest again does only what is missing."""
    return chunks.join(done.select("chunk_id", "model"), ["chunk_id", "model"], "left_anti")


def embed(chunks: DataFrame, embedder, text_col: str = "text") -> DataFrame:
    """chunks with ``embedding`` from a pandas UDF string -> array<float>; input is cleaned as models need it."""
    from quarry.functions.text import embedding_input

    return chunks.withColumn("embedding", embedder(embedding_input(F.col(text_col))))


def content_depth(n: int) -> int:
    """Levels of a content tree whose lowest slices hold some ``SLICE_KEYS`` of n keys."""
    depth = 1
    while SLICE_KEYS * FAN_OUT**depth < n:
        depth += 1
    return depth


def content_tree(manifest: DataFrame, depth: int) -> DataFrame:
    """(level, slice, digest, n) of a manifest (path, md5): a hash tree over the keys. A slice is a prefix of the hex digits of a key's md5, ``level`` digits
    long; the lowest slices have the digest of their keys and contents in order, the others that of the (at most 16) slices below them.

    However the rows are dealt the digests are the same. What a task gathers are the keys of one lowest slice, or 16 digests.
    """
    name = F.col("path").cast("string")
    keys = manifest.select(F.substring(F.md5(name.cast("binary")), 1, depth).alias("slice"), F.coalesce(name, F.lit("")).alias("k"), F.coalesce("md5", F.lit("")).alias("v"))
    digest = lambda items: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: F.concat(x["k"], F.lit(" "), x["v"], F.lit("\n"))), "").cast("binary"), 256)
    level = keys.groupBy("slice").agg(digest(F.struct("k", "v")).alias("digest"), F.count("*").alias("n")).select(F.lit(depth).alias("level"), "slice", "digest", "n")
    out = level
    for i in range(depth - 1, -1, -1):
        inner = level.select(F.substring("slice", 1, i).alias("slice"), F.struct(F.col("slice").alias("k"), F.col("digest").alias("v")).alias("kv"), "n")
        level = inner.groupBy("slice").agg(digest(F.col("kv")).alias("digest"), F.sum("n").alias("n")).select(F.lit(i).alias("level"), "slice", "digest", "n")
        out = out.union(level)
    return out


def fingerprint_of(tree: DataFrame) -> DataFrame:
    """(fingerprint): 16 hex digits of the root; no row for an empty manifest."""
    return tree.where("level = 0").select(F.substring("digest", 1, 16).alias("fingerprint"))


def changed_slices(before: DataFrame, after: DataFrame, depth: int) -> DataFrame:
    """(slice) of the lowest slices that differ, found from the root down: of each level only what lies below a difference is compared."""
    ends = None
    for level in range(depth + 1):
        sides = [t.where(F.col("level") == level).select("slice", F.col("digest").alias(f"_{n}")) for n, t in (("b", before), ("a", after))]
        if ends is not None:
            sides = [s.withColumn("_up", F.substring("slice", 1, level - 1)).join(ends.withColumnRenamed("slice", "_up"), "_up", "left_semi").drop("_up") for s in sides]
        ends = stored(sides[0].join(sides[1], "slice", "full_outer").where("not (_b <=> _a)").select("slice"))
    return ends


def drift_by_trees(before: DataFrame, after: DataFrame, tree_before: DataFrame, tree_after: DataFrame, depth: int) -> DataFrame:
    """:func:`drift` of two manifests whose trees are stored; only keys in slices that differ meet."""
    slices = changed_slices(tree_before, tree_after, depth)
    some = lambda m: m.withColumn("slice", F.substring(F.md5(F.col("path").cast("string").cast("binary")), 1, depth)).join(slices, "slice", "left_semi").drop("slice")
    return drift(some(before), some(after))


def fingerprint(entries: DataFrame, key_col: str, text_col: str, content: bool = False, depth: int | None = None) -> DataFrame:
    """(fingerprint): the root of the content tree over keys with the lengths of their texts, or with content hashes. Without ``depth`` it follows from
    the number of entries."""
    depth = content_depth(entries.count()) if depth is None else depth
    mark = content_hash(F.col(text_col)) if content else F.length(text_col).cast("string")
    return fingerprint_of(content_tree(entries.select(F.col(key_col).alias("path"), mark.alias("md5")), depth))
