"""Ranked lexical search in integers by a three-phase uniform threshold (TPUT) over term-partitioned postings.

The index: documents are taken in blocks of about ``BLOCK_BYTES`` of text; a term's postings of one block are a segment, ordered by impact
(what the posting adds to a score, but for the term's weight). Segments are range-partitioned and sorted by term and block, so that a list is
read by its term, and one as long as the corpus lies in many partitions. A term's list is all its segments.

A batch of queries takes three phases. (1) The heads of the lists, the ``k`` postings of the highest impact of each, give partial sums; the k-th best of a query
is a lower bound b of its k-th best score. (2) A document in none of the query's m lists with b / m or more can't be among the k best, so
every list is fetched down to that threshold, for all queries of the batch at once: a posting travels one time to its document's block, where
partial sums and upper bounds of all queries are made, and a block passes on what may be among its k best. (3) What is left, by the
bounds of all blocks, is scored exactly by looking its postings up.

Scores: a term's weight is floor(1000 ln((2N+2)/(2df+1))); a posting's impact is (10**9 tf) div (1000 tf + 8m), m = 25 + (75 n N) div L, with N documents
that have terms, L terms of all, n of this one. A score is the sum over the query's terms, repeats included.

Edge cases: null texts have no terms; documents and queries without terms find nothing and are not found; null ids are ranked first among equal scores;
repeated rows are ranked each (queries, too); fewer than k documents with a score above 0 are all returned; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from quarry.llm.common import from_files, runs_of, schema, word_lists, written

K = 10
BLOCK_BYTES = 8 << 20
#: Words of the queries that are searched together; what the driver holds and broadcasts of them is bounded by it.
BATCH_WORDS = 1 << 20
#: Look-ups up to which they are broadcast to the postings; beyond it a join shuffles.
BROADCAST_LOOKUPS = 200_000
#: Distinct terms of all queries up to which an index of those terms alone is made.
ASKED_TERMS = 1_000_000


@dataclass(frozen=True)
class Index:
    """``segments``: (term, block, top, offs, g); ``terms``: (term, weight); ``docs``: (block, ids)."""

    segments: DataFrame
    terms: DataFrame
    docs: DataFrame


def _segments(terms: pa.Array | None):
    """Batches of (place, id, text) to the segments of their blocks, and for each block a row without a term that has ids and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for whole in batches:
            for low, high in runs_of(whole.column(2), BLOCK_BYTES):
                b = whole.slice(low, high - low)
                offsets, tokens = word_lists(b.column(2))
                sizes = np.diff(offsets)
                if terms is None:
                    encoded = tokens.dictionary_encode()
                    names, numbers = encoded.dictionary, encoded.indices
                else:
                    names, numbers = terms, pc.index_in(tokens, value_set=terms)
                numbers = pc.fill_null(numbers, -1).to_numpy().astype(np.int64)
                known = numbers >= 0
                pairs, tf = np.unique(numbers[known] * len(b) + np.repeat(np.arange(len(b)), sizes)[known], return_counts=True)
                term, off = pairs // len(b), pairs % len(b)
                first = np.flatnonzero(np.diff(term, prepend=-1))
                ends = pa.array(np.append(first, len(term)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (off, tf, sizes[off])]
                n, block = len(first), b.column(0)[0].as_py()
                ids = pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), b.column(1))
                none = pa.array([[]], ints)
                columns = [pa.array([block] * (n + 1), pa.int64()), pa.concat_arrays([names.take(pa.array(term[first])), pa.nulls(1, pa.string())])]
                columns += [pa.concat_arrays([x, y]) for x, y in zip(lists, (none, none, pa.array([sizes], ints)))]
                columns.append(pa.concat_arrays([pa.nulls(n, ids.type), ids]))
                yield pa.RecordBatch.from_arrays(columns, ["block", "term", "offs", "tf", "n", "ids"])

    return run


def _impacts(n_docs: int, n_terms: int):
    """Raw segments to (term, block, top, offs, g), ordered by falling impact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offs, tf, n = (b.column(i) for i in (2, 3, 4))
            tf_, n_ = (x.flatten().to_numpy().astype(np.int64) for x in (tf, n))
            g = (1_000_000_000 * tf_) // (1000 * tf_ + 8 * (25 + (75 * n_ * n_docs) // n_terms))
            ends = offs.offsets.to_numpy() - offs.offsets[0].as_py()
            order = np.lexsort((-g, np.repeat(np.arange(len(b)), np.diff(ends))))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[order], pa.int32())) for x in (offs.flatten().to_numpy(), g)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(g[order][ends[:-1]], pa.int32()), *lists], ["term", "block", "top", "offs", "g"])

    return run


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: pa.Array | None = None) -> Index:
    """Reads each text once. With ``terms`` (strings) only their lists are made; N, L and df are of all documents anyway."""
    rows = from_files(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    ids = ArrayType(rows.schema["id"].dataType)
    ints = ArrayType(IntegerType())
    rows = rows.select(F.monotonically_increasing_id().alias("place"), "id", "text")
    raw = written(rows.mapInArrow(_segments(terms), schema(block=LongType(), term=StringType(), offs=ints, tf=ints, n=ints, ids=ids)))
    sizes = raw.where("term is null")
    each = sizes.select(F.explode("n").alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(each[0]), int(each[1])
    kept = raw.where("term is not null").select("block", "term", "offs", "tf", "n")
    lists = kept.mapInArrow(_impacts(n_docs, max(1, n_terms)), schema(term=StringType(), block=LongType(), top=IntegerType(), offs=ints, g=ints))
    segments = written(lists.repartitionByRange("term", "block").sortWithinPartitions("term", "block"))
    df = segments.groupBy("term").agg(F.sum(F.size("offs")).alias("df"))
    weight = F.floor(1000.0 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    return Index(segments, written(df.select("term", weight.alias("weight"))), sizes.select("block", "ids"))


def distinct_terms(items: DataFrame, text_col: str = "text", most: int = ASKED_TERMS) -> pa.Array | None:
    """The distinct terms of all items, if they are at most ``most``; else None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([word_lists(b.column(0))[1].unique()], ["term"])

    each = items.select(text_col).mapInArrow(run, "term string").distinct().limit(most + 1).toArrow().column(0).combine_chunks()
    return each if len(each) <= most else None


def _batches(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[tuple[list, pa.Table]]:
    """(ids, table of query number, term, times) of runs of items with at most ``most`` words (one item at least)."""

    def batch() -> tuple[list, pa.Table]:
        offsets, words = word_lists(pa.array(texts, pa.string()))
        table = pa.table({"q": pa.array(np.repeat(np.arange(len(texts)), np.diff(offsets)), pa.int32()), "term": words})
        return ids, table.group_by(["q", "term"]).aggregate([([], "count_all")]).rename_columns(["q", "term", "times"])

    ids, texts, size = [], [], 0
    for row in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        n = len(row["text"] or "") // 2 + 1
        if texts and size + n > most:
            yield batch()
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        size += n
    if texts:
        yield batch()


def _kth(sums: DataFrame, k: int, value: str) -> DataFrame:
    """(q, bound): the k-th largest value of each query that has so many."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(value)))
    return sums.withColumn("_r", rank).where(F.col("_r") == k).select("q", F.col(value).alias("bound"))


def _accumulate(k: int, asked: dict, bounds: dict, n_queries: int):
    """One block's fetched segments and ids to (q, block, off, id, partial, upper) of what may be among the k best of all blocks.

    asked: term -> (queries, factors, cut); what was not fetched of a list has an impact below the term's cut.
    """

    def run(block: pa.Table, docs: pa.Table) -> pa.Table:
        ids = docs.column("ids").combine_chunks()[0].values
        n = len(ids)
        by_id = np.empty(n, np.int64)
        by_id[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(n)
        found: dict[int, list] = {}
        for term, offs, g in zip(block.column("term").to_pylist(), block.column("offs"), block.column("g")):
            offs, g = offs.values.to_numpy(), g.values.to_numpy().astype(np.int64)
            queries, factors, cut = asked.value[0][term]
            for q, factor in zip(queries, factors):
                found.setdefault(int(q), []).append((offs, g * factor, (cut - 1) * int(factor)))
        out = []
        for q, lists in found.items():
            partial, slack = np.zeros(n, np.int64), np.full(n, asked.value[1][q], np.int64)
            for offs, value, rest in lists:
                partial[offs] += value  # a document stands in a list once
                if rest:
                    slack[offs] -= rest
            upper = partial + slack
            some = np.flatnonzero((partial > 0) & (upper >= bounds.value.get(q, 0)))
            if len(some) > k:
                least = np.partition(partial[some], len(some) - k)[len(some) - k]
                some = some[upper[some] >= least]
                if not asked.value[1][q]:  # all is known, so equal scores are decided by id
                    some = some[np.lexsort((by_id[some], -partial[some]))[:k]]
            out.append((np.full(len(some), q), some, partial[some], upper[some]))
        q, off, partial, upper = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(4))
        at = block.column("block")[0].as_py()
        return pa.table({"q": pa.array(q, pa.int32()), "block": pa.array(np.full(len(q), at), pa.int64()), "off": pa.array(off, pa.int32()), "id": ids.take(pa.array(off)), "partial": pa.array(partial, pa.int64()), "upper": pa.array(upper, pa.int64())})

    return run


def _batch(ix: Index, k: int, asked: pa.Table, n_queries: int) -> DataFrame:
    """(q, rank, id, score) of one batch of queries."""
    spark = ix.segments.sparkSession
    context = spark.sparkContext
    weights = ix.terms.join(F.broadcast(spark.createDataFrame(asked.select(["term"]).group_by("term").aggregate([]))), "term").where("weight > 0").toArrow()
    place = pc.index_in(asked.column("term").combine_chunks(), value_set=weights.column("term").combine_chunks())
    asked = asked.append_column("at", place).filter(pc.is_valid(place))
    factor = pc.multiply(weights.column("weight").take(asked.column("at")), asked.column("times"))
    asked = asked.select(["q", "term"]).append_column("factor", factor)
    factors = spark.createDataFrame(asked)
    # As many rows as the batch has words.
    lists = F.broadcast(factors)

    # 1. Heads: the k postings of most impact lie in the k segments with the highest tops.
    names = F.broadcast(factors.select("term").distinct())
    ranked = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("top"), "block"))
    best = ix.segments.select("term", "block", "top").join(names, "term").withColumn("_r", ranked).where(F.col("_r") <= k).select("term", "block")
    heads = ix.segments.join(F.broadcast(best), ["term", "block"]).select("term", "block", F.explode(F.slice(F.arrays_zip("offs", "g"), 1, k)).alias("p")).select("term", "block", "p.*")
    heads = heads.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("g"), "block", "offs"))).where(F.col("_r") <= k)
    sums = heads.join(lists, "term").groupBy("q", "block", "offs").agg(F.sum(F.col("factor") * F.col("g")).alias("partial"))
    bounds = {r["q"]: r["bound"] for r in _kth(sums, k, "partial").collect()}

    # 2. The uniform threshold: in each of the query's m lists what is at least bound / m.
    q, f = asked.column("q").to_numpy(), asked.column("factor").to_numpy()
    terms, which = np.unique(asked.column("term").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    m = np.bincount(q, minlength=n_queries)
    bound = np.array([bounds.get(i, 0) for i in range(n_queries)], np.int64)
    least = np.maximum(1, -(-bound[q] // (f * m[q])))
    cuts = np.full(len(terms), np.iinfo(np.int64).max)
    np.minimum.at(cuts, which, least)
    order = np.argsort(which, kind="stable")
    starts = np.searchsorted(which[order], np.arange(len(terms) + 1))
    of = {t: (q[order[a:b]], f[order[a:b]], int(c)) for t, a, b, c in zip(terms.tolist(), starts, starts[1:], cuts)}
    slack = np.zeros(n_queries, np.int64)
    np.add.at(slack, q, (cuts[which] - 1) * f)
    known, limits = context.broadcast((of, slack.tolist())), context.broadcast(bounds)
    cut = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(terms.tolist(), pa.string()), "cut": pa.array(cuts, pa.int64())})))
    size = F.when(F.element_at("g", -1) >= F.col("cut"), F.size("g")).otherwise(F.size(F.filter("g", lambda x: x >= F.col("cut"))))
    fetched = ix.segments.join(cut, "term").where("top >= cut").select("term", "block", F.slice("offs", F.lit(1), size).alias("offs"), F.slice("g", F.lit(1), size).alias("g"))
    kind = schema(q=IntegerType(), block=LongType(), off=IntegerType(), id=ix.docs.schema["ids"].dataType.elementType, partial=LongType(), upper=LongType())
    # Blocks without fetched postings have no candidates.
    some = ix.docs.join(fetched.select("block").distinct(), "block", "left_semi")
    found = written(fetched.groupBy("block").cogroup(some.groupBy("block")).applyInArrow(_accumulate(k, known, limits, n_queries), kind))

    # 3. Exact scores of what no bound rules out.
    left = written(found.join(F.broadcast(_kth(found, k, "partial")), "q", "left").where("bound is null or upper >= bound").select("q", "block", "off", "id"))
    asks = left.join(lists, "q")
    near = asks.count() <= BROADCAST_LOOKUPS
    postings = ix.segments.join(F.broadcast(asks) if near else asks, ["term", "block"])
    at = F.array_position("offs", F.col("off"))
    scores = postings.withColumn("_at", at).where("_at > 0").groupBy("q", "block", "off", "id").agg(F.sum(F.col("factor") * F.element_at("g", F.col("_at").cast("int"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("id"), "block", "off"))
    return scores.where("score > 0").select("q", rank.alias("rank"), "id", "score").where(F.col("rank") <= k)


def search(ix: Index, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): each item's k best documents, equal scores by id."""
    spark: SparkSession = items.sparkSession
    kind = schema(item=items.schema[id_col].dataType, rank=IntegerType(), id=ix.docs.schema["ids"].dataType.elementType, score=LongType())
    out = spark.createDataFrame([], kind)
    for ids, asked in _batches(items, id_col, text_col, BATCH_WORDS):
        names = spark.createDataFrame(list(enumerate(ids)), schema(q=IntegerType(), item=kind["item"].dataType))
        hits = _batch(ix, k, asked, len(ids)).join(F.broadcast(names), "q")
        out = out.unionByName(hits.select("item", "rank", "id", "score"))
    return out
