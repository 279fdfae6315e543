"""A stored BM25 index of immutable segments, and searches that skip what can't be among the best.

A segment holds what one build or update added. Its postings lie in blocks: a block is what one term has in one cell, some ``CELL_DOCS`` documents
of similar length, with the largest tf and the smallest length in it, so that a bound of its scores is known whatever the corpus becomes. Cells
are the same for all terms: the sum of a cell's bounds over a query's terms bounds the score of each document in it. A search for the k best reads the
bounds, scores the most promising cells, and of the others those alone whose bound reaches the k-th best score found.

Documents change by segments: an update tokenizes what is new or changed, writes it as a segment, marks the ids as dead in all segments before, and adds
what that means for document frequencies, number and lengths of documents. Scores are then those of a rebuild. ``compact`` merges all
segments without tokenizing again. Readers open a version, a row that names its segments and is written last; older versions stay readable.

Layout below the index's path, in folders ``segment=n``: ``forward`` (id, h, dl, terms, tfs), ``postings`` (bucket, term, cell, n, max_tf, min_dl,
ids, tfs, dls), ``df`` (term, df: what the segment adds, negative for what it takes away), ``dead`` (id); ``versions/version=n``: one row.

Edge cases: null texts have no terms; ids are taken as unique: rows that share one are counted each, but found as one, and all go when the id is changed
or removed; null ids can't be removed; equal scores (rounded to six digits, as sums of floats differ by order) rank by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarry.functions.text import words
from quarry.sources import scratch

#: The published defaults of Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
LEXICAL_POOL = 40
SCORE_DIGITS = 6
#: Documents in a cell; classes of document length; cells scored first; postings in a folder of the index, and written by one task.
CELL_DOCS, LENGTH_CLASSES, FIRST_CELLS, FOLDER_POSTINGS, TASK_POSTINGS = 128, 16, 8, 4_000_000, 250_000
#: Cells of one search that are named in the scan's filter; more are joined.
NAMED_CELLS = 2_000


@dataclass(frozen=True)
class Index:
    """One version: ``n`` documents of ``total`` terms, the mean of all terms' raw idf, the fingerprint of ids and texts."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[int, ...]
    buckets: int
    n: int
    total: int
    avg_idf: float
    fingerprint: int
    tokenize: Callable[[Column], Column]
    #: (id, text) of the documents, where the caller has it.
    docs: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        read = self.spark.read
        if name == "postings":  # an empty segment has no file to take it from
            kind = self.table("dead").schema["id"].dataType.simpleString()
            read = read.schema(f"term string, cell long, n int, max_tf int, min_dl int, ids array<{kind}>, tfs array<int>, dls array<int>, segment int, bucket int")
        return read.parquet(f"{self.path}/{name}").where(F.col("segment").isin(*self.segments))

    @property
    def avgdl(self) -> float:
        return self.total / self.n if self.n else 0.0

    @property
    def df(self) -> DataFrame:
        """(term, df) of the terms that occur."""
        return self.table("df").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def live(self, rows: DataFrame) -> DataFrame:
        """rows (segment, id, ..) without those that a later segment replaces or removes."""
        if len(self.segments) < 2:
            return rows
        dead = self.table("dead").groupBy("id").agg(F.max("segment").alias("_upto")).withColumnRenamed("id", "_id")
        return rows.join(dead, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("_upto")), "left_anti")


def raw_idf(n, df: Column) -> Column:
    return F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _print(docs: DataFrame) -> Column:
    """A sum that tells tables of (id, h) apart, whatever their order; sums of parts add up."""
    return F.coalesce(F.sum(F.xxhash64("id", "h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, tokens) to (id, h, dl, terms, tfs): terms of all rows of a batch are counted at once."""
    for b in batches:
        lists = b.column(2)
        dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary
        pairs, tfs = np.unique(np.repeat(np.arange(len(b)), dl) * max(1, len(names)) + coded.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(pairs, np.arange(len(b) + 1) * max(1, len(names))), pa.int32())
        terms = pa.ListArray.from_arrays(ends, names.take(pa.array(pairs % max(1, len(names)))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dl, pa.int32()), terms, pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))], ["id", "h", "dl", "terms", "tfs"])


def _forward(docs: DataFrame, tokenize: Callable[[Column], Column]) -> DataFrame:
    """(id, h, dl, terms, tfs): each text tokenized once, its terms counted beside it."""
    rows = docs.select("id", _hash(F.col("text")).alias("h"), tokenize(F.col("text")).alias("t"))
    kind = StructType([StructField("id", rows.schema["id"].dataType), *StructType.fromDDL("h long, dl int, terms array<string>, tfs array<int>").fields])
    return rows.mapInArrow(_counted, kind)


def _write_postings(forward: DataFrame, path: str, segment: int, buckets: int, n: int, size: int) -> None:
    """Blocks of a segment. Cells are hashed within classes of length, so no term, however frequent, is one task's: its cells are dealt over several."""
    cuts = forward.agg(F.percentile_approx("dl", [i / LENGTH_CLASSES for i in range(1, LENGTH_CLASSES)])).first()[0] or []
    cuts = sorted(set(cuts))
    each = max(1, n // (CELL_DOCS * (len(cuts) + 1)))
    kind = sum(((F.col("dl") > c).cast("int") for c in cuts), F.lit(0))
    salts = max(1, -(-size // (buckets * TASK_POSTINGS)))
    rows = forward.select("id", "dl", (kind.cast("long") * each + F.pmod(F.xxhash64("id"), F.lit(each))).alias("cell"), F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    rows = rows.select("id", "dl", "cell", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"), _bucket(F.col("p.terms"), buckets).alias("bucket"), F.pmod("cell", F.lit(salts)).alias("salt"))
    lists = F.array_sort(F.collect_list(F.struct("id", "tf", "dl")))
    blocks = rows.repartition("bucket", "salt").groupBy("bucket", "salt", "term", "cell").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), lists.alias("l"))
    blocks = blocks.select("bucket", "term", "cell", "n", "max_tf", "min_dl", F.col("l.id").alias("ids"), F.col("l.tf").alias("tfs"), F.col("l.dl").alias("dls"))
    blocks.sortWithinPartitions("bucket", "term", "cell").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")


def _publish(ix: Index) -> Index:
    """Writes the version's row, with the mean idf of its terms, when all that it names is written."""
    mean = ix.df.agg(F.avg(raw_idf(float(ix.n), F.col("df")))).first()[0] or 0.0
    row = (list(ix.segments), ix.buckets, ix.n, ix.total, mean, str(ix.fingerprint))
    kind = "segments array<int>, buckets int, n long, total long, avg_idf double, fingerprint string"
    ix.spark.createDataFrame([row], kind).coalesce(1).write.mode("overwrite").parquet(f"{ix.path}/versions/version={ix.version}")
    return replace(ix, avg_idf=mean)


def _store(forward: DataFrame, path: str, segment: int, buckets: int | None) -> tuple[int, int, int, int]:
    """Writes postings of a forward table that is stored; (buckets, n, total, fingerprint)."""
    n, total, size, seal = forward.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0)), _print(forward)).first()
    buckets = buckets or max(1, -(-size // FOLDER_POSTINGS))
    _write_postings(forward, path, segment, buckets, n, size)
    return buckets, n, total, int(seal)


def index(docs: DataFrame, id_col: str, text_col: str, tokenize: Callable[[Column], Column] = words, path: str | None = None) -> Index:
    """Builds the index under ``path`` (else with the scratch tables). Folders and tasks follow from the corpus's size."""
    spark, path = docs.sparkSession, path or scratch.folder(docs.sparkSession)
    docs = _named(docs, id_col, text_col)
    _forward(docs, tokenize).write.mode("overwrite").parquet(f"{path}/forward/segment=0")
    forward = spark.read.parquet(f"{path}/forward/segment=0")
    buckets, n, total, seal = _store(forward, path, 0, None)
    forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/df/segment=0")
    forward.select("id").limit(0).write.mode("overwrite").parquet(f"{path}/dead/segment=0")
    return _publish(Index(spark, path, 0, (0,), buckets, n, total, 0.0, seal, tokenize, docs))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that are whole, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/version=*/_SUCCESS")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def load_index(spark: SparkSession, path: str, docs: DataFrame | None = None, id_col: str = "id", text_col: str = "text", tokenize: Callable[[Column], Column] = words, version: int | None = None) -> Index:
    """A stored version (the last) without tokenizing again; refused if ``docs``, where given, are not the documents it was made of."""
    version = versions(spark, path)[-1] if version is None else version
    row = spark.read.parquet(f"{path}/versions/version={version}").first()
    named = None if docs is None else _named(docs, id_col, text_col)
    ix = Index(spark, path, version, tuple(row["segments"]), row["buckets"], row["n"], row["total"], row["avg_idf"], int(row["fingerprint"]), tokenize, named)
    if named is not None:
        hashed = named.select("id", _hash(F.col("text")).alias("h"))
        n, seal = hashed.agg(F.count("*"), _print(hashed)).first()
        if (n, int(seal)) != (ix.n, ix.fingerprint):
            raise ValueError(f"the index under {path} is of {ix.n} other documents, not of these {n}")
    return ix


def update(ix: Index, upserts: DataFrame | None = None, removed: DataFrame | None = None) -> Index:
    """The next version: ``upserts`` (id, text) are added or take the place of their ids, ids of ``removed`` go. The cost is that of what changes
    and of one pass over the narrow columns of the forward tables."""
    spark, k = ix.spark, max(versions(ix.spark, ix.path)) + 1
    kind = ix.table("forward").schema["id"].dataType
    new = upserts if upserts is not None else spark.createDataFrame([], f"id {kind.simpleString()}, text string")
    _forward(new.select("id", "text"), ix.tokenize).write.mode("overwrite").parquet(f"{ix.path}/forward/segment={k}")
    forward = spark.read.parquet(f"{ix.path}/forward/segment={k}")
    gone = forward.select("id") if removed is None else forward.select("id").union(removed.select(F.col("id").cast(kind)))
    old = scratch.stored(ix.live(ix.table("forward")).join(gone.distinct(), "id", "left_semi"))
    old.select("id").distinct().write.mode("overwrite").parquet(f"{ix.path}/dead/segment={k}")
    signed = lambda rows, sign: rows.select(F.explode("terms").alias("term"), F.lit(sign).cast("long").alias("d"))
    signed(forward, 1).union(signed(old, -1)).groupBy("term").agg(F.sum("d").alias("df")).where("df <> 0").write.mode("overwrite").parquet(f"{ix.path}/df/segment={k}")
    _, n, total, seal = _store(forward, ix.path, k, ix.buckets)
    less, less_total, less_seal = old.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), _print(old)).first()
    return _publish(replace(ix, version=k, segments=(*ix.segments, k), n=ix.n + n - less, total=ix.total + total - less_total, fingerprint=ix.fingerprint + seal - int(less_seal), docs=None))


def sync(ix: Index, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> Index:
    """The version of ``docs``: what differs from what is indexed, by id and hash of the text, is updated; the same index if nothing does. Ids are unique."""
    docs = _named(docs, id_col, text_col)
    now = docs.select("id", _hash(F.col("text")).alias("h"))
    known = ix.live(ix.table("forward")).select("id", "h")
    changed = scratch.stored(now.join(known, ["id", "h"], "left_anti").select("id"))
    removed = scratch.stored(known.join(now, "id", "left_anti").select("id"))
    if changed.isEmpty() and removed.isEmpty():
        return replace(ix, docs=docs)
    return replace(update(ix, docs.join(changed, "id", "left_semi"), removed), docs=docs)


def compact(ix: Index) -> Index:
    """The same documents in one segment; nothing is tokenized."""
    spark, k = ix.spark, max(versions(ix.spark, ix.path)) + 1
    ix.live(ix.table("forward")).drop("segment").write.mode("overwrite").parquet(f"{ix.path}/forward/segment={k}")
    buckets, *_ = _store(spark.read.parquet(f"{ix.path}/forward/segment={k}"), ix.path, k, None)
    ix.df.write.mode("overwrite").parquet(f"{ix.path}/df/segment={k}")
    ix.table("dead").select("id").limit(0).write.mode("overwrite").parquet(f"{ix.path}/dead/segment={k}")
    return _publish(replace(ix, version=k, segments=(k,), buckets=buckets))


def corpus_stats(ix: Index) -> DataFrame:
    """(n_docs, avgdl, n_terms, n_floored): size of the corpus and how many terms get the idf floor."""
    return ix.df.agg(F.lit(ix.n).cast("long").alias("n_docs"), F.lit(ix.avgdl).alias("avgdl"), F.count("*").alias("n_terms"), F.count_if(raw_idf(float(ix.n), F.col("df")) < 0).alias("n_floored"))


def _idf(ix: Index, df: Column) -> Column:
    """Negative values become EPSILON times the mean."""
    w = raw_idf(float(ix.n), df)
    return F.when(w < 0, EPSILON * ix.avg_idf).otherwise(w)


def idf(ix: Index, terms: Sequence[str]) -> DataFrame:
    """(term, df, idf) of the terms that occur."""
    return _df_of(ix, terms).select("term", "df", _idf(ix, F.col("df")).alias("idf"))


def _df_of(ix: Index, terms: Sequence[str]) -> DataFrame:
    return ix.table("df").where(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def _blocks(ix: Index, terms: Sequence[str]) -> DataFrame:
    """Blocks of some terms; folders are a function of the terms, known when the query is planned, and others aren't read."""
    return ix.table("postings").where(F.col("bucket").isin(*[_bucket(F.lit(t), ix.buckets) for t in terms]) & F.col("term").isin(*terms))


def _part(ix: Index, tf: str, dl: str) -> Column:
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.lit(ix.avgdl or 1.0)))


def _scores(ix: Index, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, score) of blocks with a weight ``w``: each block's documents, live ones, summed."""
    rows = blocks.select(*keys, "w", "segment", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select(*keys, "w", "segment", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
    return ix.live(rows).groupBy(*keys, "id").agg(F.round(F.sum(F.col("w") * _part(ix, "tf", "dl")), SCORE_DIGITS).alias("score")).where(F.col("score") > 0)


def _weights(ix: Index, query_terms: Sequence[str]) -> DataFrame:
    """(term, w) of one query: how often it has the term, times the idf."""
    times = F.create_map(*[F.lit(x) for t in dict.fromkeys(query_terms) for x in (t, list(query_terms).count(t))])
    return _df_of(ix, query_terms).select("term", (times[F.col("term")] * _idf(ix, F.col("df"))).alias("w"))


def _none(ix: Index) -> DataFrame:
    return ix.table("forward").select("id", F.lit(0.0).alias("score")).where("false")


def bm25(ix: Index, query_terms: Sequence[str]) -> DataFrame:
    """(id, score) of documents with a positive score. Only postings of the query's terms are read and shuffled."""
    if not query_terms:
        return _none(ix)
    # As many rows as the query has terms.
    return _scores(ix, _blocks(ix, query_terms).join(F.broadcast(_weights(ix, query_terms)), "term"), [])


def _bounds(ix: Index, blocks: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, segment, cell, bound): no document of the cell scores more."""
    narrow = blocks.select("segment", "term", "cell", "max_tf", "min_dl").join(weights, "term")
    return narrow.groupBy(*keys, "segment", "cell").agg((F.sum(F.greatest("w", F.lit(0.0)) * _part(ix, "max_tf", "min_dl")) * (1 + 1e-9) + 10.0**-SCORE_DIGITS).alias("bound"))


def cell_bounds(ix: Index, query_terms: Sequence[str]) -> DataFrame:
    """(segment, cell, bound) of the cells that hold a term of the query; no postings are read."""
    return _bounds(ix, _blocks(ix, query_terms), F.broadcast(_weights(ix, query_terms)), [])


def needed_cells(ix: Index, query_terms: Sequence[str], k: int) -> DataFrame | list[tuple[int, int]]:
    """The cells (segment, cell) that may hold one of the k best: those whose bound reaches the k-th best score of the most promising ones. A list
    if they are at most ``NAMED_CELLS``, else a table."""
    bounds = cell_bounds(ix, query_terms)
    top = bounds.orderBy(F.desc("bound"), "segment", "cell").limit(NAMED_CELLS + 1).collect()
    first = [(r["segment"], r["cell"]) for r in top[: max(FIRST_CELLS, k)]]
    best = _in_cells(ix, query_terms, first).orderBy(F.desc("score")).limit(k).collect()
    least = best[-1]["score"] if len(best) == k else 0.0
    if len(top) > NAMED_CELLS and top[-1]["bound"] >= least:
        return bounds.where(F.col("bound") >= least).select("segment", "cell")
    return [(r["segment"], r["cell"]) for r in top if r["bound"] >= least]


def _in_cells(ix: Index, query_terms: Sequence[str], cells: DataFrame | list[tuple[int, int]]) -> DataFrame:
    blocks = _blocks(ix, query_terms)
    if isinstance(cells, list):  # the scan skips what lies between them
        blocks = blocks.where(F.col("cell").isin(*{c for _, c in cells}) if cells else F.lit(False))
        cells = F.broadcast(ix.spark.createDataFrame(cells, "segment int, cell long"))
    blocks = blocks.join(cells, ["segment", "cell"], "left_semi")
    return _scores(ix, blocks.join(F.broadcast(_weights(ix, query_terms)), "term"), [])


def bm25_top(ix: Index, query_terms: Sequence[str], k: int = LEXICAL_POOL) -> DataFrame:
    """(id, score) of the k best. Cells whose bound is below the k-th best score of the first ones are not scored, nor read where few are left."""
    if not query_terms:
        return _none(ix)
    return _in_cells(ix, query_terms, needed_cells(ix, query_terms, k)).orderBy(F.desc("score"), "id").limit(k)


def bm25_queries(ix: Index, queries: DataFrame, k: int = LEXICAL_POOL) -> DataFrame:
    """(query_id, rank, id, score): the k best of each query. queries: (query_id, terms array<string>), of any number.

    Queries meet the bounds of their terms' blocks first; each one's postings only in the cells that may hold one of its k best.
    """
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weights = scratch.stored(asked.join(ix.df, "term").select("query_id", "term", (F.col("times") * _idf(ix, F.col("df"))).alias("w")))
    blocks = ix.table("postings").join(weights.select("term").distinct(), "term", "left_semi")
    bounds = scratch.stored(_bounds(ix, blocks, weights, ["query_id"]))
    by = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "cell")
    key = ["query_id", "segment", "cell"]
    first = scratch.stored(bounds.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= max(FIRST_CELLS, k)).select(*key))

    def scored(cells: DataFrame) -> DataFrame:
        # A cell's queries and a query's terms meet the blocks, both by cell and term, whose number of rows is bounded by the cell's size.
        wanted = cells.join(weights, "query_id")
        return _scores(ix, blocks.join(wanted, ["segment", "cell", "term"]), ["query_id"])

    one = scratch.stored(scored(first))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    least = one.withColumn("_r", rank).where(F.col("_r") == k).select("query_id", F.col("score").alias("least"))
    second = bounds.join(least, "query_id", "left").where("bound >= coalesce(least, 0)").join(first, key, "left_anti").select(*key)
    return one.unionByName(scored(second)).select("query_id", rank.alias("rank"), "id", "score").where(F.col("rank") <= k)


def texts_of(ix: Index, hits: DataFrame) -> DataFrame:
    """(id, text) of hits (id), which a search bounds: their ids go into the scan of the documents, which skips what holds none of them."""
    ids = [r["id"] for r in hits.select("id").distinct().collect()]
    return ix.docs.where(F.col("id").isin(*ids) if ids else F.lit(False))
