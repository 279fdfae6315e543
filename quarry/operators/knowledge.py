"""The stored knowledge base: chunks with vectors by source, a lexical index beside them, full rebuild and incremental update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import ingest, lexical
from quarry.sources import scratch, writers


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks with vectors; refused as a whole if ids, texts, sources and vectors aren't of one number, ids repeat or lengths differ."""
    rows = spark.read.parquet(path)
    n = rows.agg(*[F.count(c).alias(c) for c in ("chunk_id", "text", "source", "embedding")], F.count("*").alias("rows"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    twice = rows.groupBy("chunk_id").count().where("count > 1").limit(1).count()
    if len({n[c] for c in ("chunk_id", "text", "source", "embedding", "rows")}) > 1 or n["least"] != n["most"] or twice:
        raise ValueError(f"the vectors under {path} are not whole: {n.asDict()}")
    return rows


def rebuild(docs: DataFrame, path: str, file_col: str, text_col: str, source: Column, embedder, model: str) -> DataFrame:
    """Chunks, embeds and stores all documents, replacing what is stored of their sources. Returns the manifest (path, md5) of what is stored."""
    chunks = ingest.chunk(docs, file_col, text_col, source, model)
    writers.replace_by_source(ingest.embed(chunks, embedder), path)
    return ingest.manifest(docs, file_col, text_col)


def update(docs: DataFrame, before: DataFrame, path: str, file_col: str, text_col: str, source: Column, embedder, model: str) -> tuple[str, DataFrame]:
    """(status, manifest): ``current`` if no document differs from ``before``, else ``updated`` with the sources' chunks replaced.

    Vectors of chunks that are stored already, by the same model, are taken over; the embedder sees the others alone.
    """
    now = scratch.stored(ingest.manifest(docs, file_col, text_col))
    if not ingest.drift(before, now).limit(1).count():
        return "current", now
    spark = docs.sparkSession
    chunks, done = ingest.chunk(docs, file_col, text_col, source, model), load_vectors(spark, path)
    kept = chunks.join(done.select("chunk_id", "model", "embedding"), ["chunk_id", "model"])
    fresh = ingest.embed(ingest.to_embed(chunks, done), embedder)
    # What is about to be replaced is read, so the new rows are written aside first.
    writers.replace_by_source(scratch.stored(kept.unionByName(fresh)), path)
    return "updated", now


def lexical_index(spark: SparkSession, path: str) -> lexical.Index:
    """The lexical index of the stored chunks: built once; later calls bring it to what is stored now, at the cost of what has changed."""
    chunks, place = spark.read.parquet(path), f"{path.rstrip('/')}-lexical"
    if not lexical.versions(spark, place):
        return lexical.index(chunks, "chunk_id", "text", path=place)
    return lexical.sync(lexical.load_index(spark, place), chunks, "chunk_id", "text")
