"""Benchmark decontamination by suffix arrays of the training texts.

A task takes its documents in shards of about ``SHARD_BYTES`` of text (a longer document is a shard of its own). A shard's suffix array
holds its word positions in the order of the words that follow, to the depth of the longest test sequence looked for; positions that no
test sequence can begin at are left out, as one of the words after them is in no test item. Every test suffix is found in it by binary
search: its range of the array gives all places where it stands, and the neighbours of its place the longest match.

Test items are searched in blocks of at most ``BLOCK_WORDS`` words, one broadcast each; documents pass from block to block in one stage,
so they are never shuffled and a hot source, a group of copies or a passage that all documents share is no heavier than other text.

Words are runs of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. A window is ``window`` consecutive words of an item,
or all words of an item that has fewer (but some).

Edge cases: null and empty texts have no words and no hits; an item without words has no windows; items with a null id
hit words but are not named; items of one id are one; repeated rows are found alike; null ids stay; no items hit nothing, no documents
give no rows. Carried columns may have any name, as they travel in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quarry.llm.common import runs_of, schema, word_lists

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_WORDS = 4 << 20
#: Shortest match that :func:`longest_matches` tells, in words.
LEAST_MATCH = 5
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


@dataclass(frozen=True)
class Block:
    """Test items: their distinct words, the word numbers (from 1) of all items one after the other, where each item begins, the items' names."""

    words: pa.Array
    numbers: np.ndarray
    offsets: np.ndarray
    names: list[str | None]

    def windows(self, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of windows: the distinct ones as rows, and as offsets and numbers the items that hold each."""
        lengths = np.diff(self.offsets)
        out = []
        for k in np.unique(np.minimum(lengths[lengths > 0], size)):
            items = np.flatnonzero((lengths == k) if k < size else (lengths >= k))
            counts = lengths[items] - k + 1
            at = np.repeat(self.offsets[items] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            rows, which = np.unique(self.numbers[at[:, None] + np.arange(k)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.repeat(items, counts)], 1), axis=0)
            out.append((rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1]))
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items in blocks of at most ``most`` words (one item at least); the driver holds one at a time."""
    texts, names, size = [], [], 0

    def block() -> Block:
        offsets, words = word_lists(pa.array(texts, pa.string()))
        encoded = words.dictionary_encode()
        return Block(encoded.dictionary, encoded.indices.to_numpy().astype(np.int64) + 1, offsets, names)

    for row in items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        n = len(row["text"] or "") // 2 + 1  # words are apart, so there are no more
        if texts and size + n > most:
            yield block()
            texts, names, size = [], [], 0
        texts.append(row["text"])
        names.append(row["id"])
        size += n
    if texts:
        yield block()


class Shard:
    """The suffix array of some texts over the words of a block.

    ``at`` are the positions from which at least ``least`` known words follow, sorted by the ``depth`` words there; ``keys`` are
    those words, packed into as few columns as hold them. ``starts`` are the documents' first positions; a gap stands after each.
    """

    def __init__(self, texts: pa.Array, words: pa.Array, least: int, depth: int):
        offsets, tokens = word_lists(texts)
        self.n_words, self.depth = np.diff(offsets), depth
        self.starts = offsets[:-1] + np.arange(len(texts))
        n = len(tokens) + len(texts)
        self.text = np.zeros(n + depth, np.int64)  # 0 stands for words that no item has, and for gaps
        self.text[np.arange(len(tokens)) + np.repeat(np.arange(len(texts)), self.n_words)] = pc.fill_null(pc.index_in(tokens, value_set=words), -1).to_numpy().astype(np.int64) + 1
        gaps = np.flatnonzero(self.text == 0)
        run = gaps[np.searchsorted(gaps, np.arange(n))] - np.arange(n)
        at = np.flatnonzero(run >= least)
        self.bits = max(1, int(len(words)).bit_length())
        keys = self._packed(lambda j: self.text[at + j])
        order = np.lexsort(keys[::-1])
        self.at, self.keys = at[order], [k[order] for k in keys]

    def _packed(self, column, length: int | None = None, fill: int = 0) -> list[np.ndarray]:
        """Columns 0 to depth - 1 by number, several to an integer; those from ``length`` on have all bits set to ``fill``."""
        each, out = 63 // self.bits, []
        for first in range(0, self.depth, each):
            key = np.int64(0)
            for j in range(first, min(first + each, self.depth)):
                key = (key << self.bits) | (column(j) if length is None or j < length else np.int64(fill * ((1 << self.bits) - 1)))
            out.append(key)
        return out

    def _place(self, rows: np.ndarray, upper: bool) -> np.ndarray:
        """Of each row of words the first place of the array whose suffix is not smaller or, if ``upper``, larger and doesn't begin with it."""
        want = [np.broadcast_to(k, len(rows)) for k in self._packed(lambda j: rows[:, j], rows.shape[1], int(upper))]
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.at), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            probe = np.minimum(middle, len(self.at) - 1)
            less, tied = np.zeros(len(rows), bool), np.ones(len(rows), bool)
            for key, w in zip(self.keys, want):
                less |= tied & (key[probe] < w)
                tied &= key[probe] == w
            right = open_ & (less | (tied if upper else False))
            low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
        return low

    def find(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of words its range in the array."""
        return self._place(rows, False), self._place(rows, True)

    def longest(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row (``lengths`` words, then zeros) the longest match of its beginning and a position of it (-1 for none): no other suffix
        has more of it than one of the two beside its place."""
        best, where = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        if not len(self.at):
            return best, where
        place = self._place(rows, False)
        for near in (place, place - 1):
            at = self.at[np.clip(near, 0, len(self.at) - 1)]
            same = (self.text[at[:, None] + np.arange(self.depth)] == rows) & (np.arange(self.depth) < lengths[:, None])
            common = np.where((near >= 0) & (near < len(self.at)), np.cumprod(same, 1).sum(1), 0)
            better = (common > best) | ((common == best) & (common > 0) & (at < where))
            best, where = np.where(better, common, best), np.where(better, at, where)
        return best, where

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range number, member) of all members of the ranges [low, high)."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]


def _merge(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(a + b, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _search(texts: pa.Array, block: Block, windows) -> tuple[np.ndarray, dict[int, tuple[list[dict], list[str]]]]:
    """Words of each text; of those with hits the spans hit (merged) and the names of the items."""
    sizes = [rows.shape[1] for rows, _, _ in windows]
    shard = Shard(texts, block.words, min(sizes, default=1), max(sizes, default=1))
    marks = np.zeros(len(shard.text) + 1, np.int64)
    pairs = []
    for rows, first, items in windows if len(shard.at) else ():
        low, high = shard.find(rows)
        which, place = _spread(low, high)
        at = shard.at[place]
        marks += np.bincount(at, minlength=len(marks)) - np.bincount(at + rows.shape[1], minlength=len(marks))
        seen = np.unique(shard.document(at) * len(rows) + which)
        doc, which = seen // len(rows), seen % len(rows)
        of, member = _spread(first[which], first[which + 1])
        pairs.append(np.unique(doc[of] * len(block.names) + items[member]))
    hit = np.diff(np.concatenate([[0], (np.cumsum(marks) > 0).astype(np.int8), [0]]))
    out: dict[int, tuple[list[dict], list[str]]] = {}
    for start, end in zip(np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)):
        doc = int(shard.document(start))
        out.setdefault(doc, ([], []))[0].append({"start": int(start - shard.starts[doc]), "end": int(end - shard.starts[doc])})
    for p in np.unique(np.concatenate(pairs)) if pairs else ():
        if (name := block.names[p % len(block.names)]) is not None:
            out[int(p // len(block.names))][1].append(name)
    return shard.n_words, out


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, carry: bool = False) -> DataFrame:
    """(id, n_words, spans, items) of each document: hit words as spans [start, end) of word numbers, merged, and the names of the items whose
    windows occur, distinct and sorted. With ``carry`` the row comes along as struct ``row``."""
    more = {"row": F.struct("*") if carry else F.lit(True)}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(n) for n, c in more.items()])
    rows = rows.select("*", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    context, kind = docs.sparkSession.sparkContext, schema(**{f.name: f.dataType for f in rows.schema.fields})
    every = [context.broadcast((b, b.windows(window))) for b in blocks(items, item_col, item_text_col)]
    if not every:
        every = [context.broadcast((Block(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(1, np.int64), []), []))]
    for one in every:

        def run(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low, high in runs_of(whole.column(1), SHARD_BYTES):
                    b = whole.slice(low, high - low)
                    n_words, found = _search(b.column(1), *one.value)
                    spans, names = b.column("spans").to_pylist(), b.column("items").to_pylist()
                    for i in range(len(b)):
                        new = found.get(i, ([], []))
                        spans[i] = _merge(spans[i], new[0]) if spans[i] else new[0]
                        names[i] = sorted({*(names[i] or ()), *new[1]})
                    arrays = [b.column("id"), b.column("text"), b.column("row"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(names, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["id", "text", "row", "n_words", "spans", "items"])

        rows = rows.mapInArrow(run, kind)
    return rows.select("id", "n_words", "spans", "items", *(["row"] if carry else []))


def n_hit(spans="spans"):
    """How many words the spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that hold a window of an item."""
    return hits(docs, items, id_col, text_col, carry=True, **options).where(F.size("spans") == 0).select("row.*")


def longest_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST_MATCH) -> DataFrame:
    """(item, item_at, length, id, at): of every suffix of every item (by its first word's number) the longest verbatim match in the documents,
    of ``least`` words at least, and one place where it stands: of the best places next to it in each shard's array that of the smallest id, then the first."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = None
    kind = schema(item=StringType(), item_at=IntegerType(), length=IntegerType(), id=rows.schema["id"].dataType, at=LongType())
    for block in blocks(items, item_col, item_text_col):
        one = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
            block = one.value
            sizes = np.diff(block.offsets)
            of = np.repeat(np.arange(len(sizes)), sizes)
            depth = max(int(sizes.max(initial=0)), 1)
            padded = np.concatenate([block.numbers, np.zeros(depth, np.int64)])
            for b in batches:
                for low, high in runs_of(b.column(1), SHARD_BYTES):
                    part = b.slice(low, high - low)
                    shard = Shard(part.column(1), block.words, least, depth)
                    for begin in range(0, len(of), 1 << 14):
                        at = np.arange(begin, min(begin + (1 << 14), len(of)))
                        left = block.offsets[of[at] + 1] - at
                        words = np.where(np.arange(depth) < left[:, None], padded[at[:, None] + np.arange(depth)], 0)
                        length, where = shard.longest(words, left)
                        good = np.flatnonzero(length >= least)
                        doc = shard.document(where[good])
                        arrays = [pa.array([block.names[i] for i in of[at[good]]], pa.string()), pa.array((at - block.offsets[of[at]])[good], pa.int32()), pa.array(length[good], pa.int32()), part.column(0).take(pa.array(doc)), pa.array(where[good] - shard.starts[doc], pa.int64())]
                        yield pa.RecordBatch.from_arrays(arrays, ["item", "item_at", "length", "id", "at"])

        each = rows.mapInArrow(run, kind)
        found = each if found is None else found.unionByName(each)
    if found is None:
        return docs.sparkSession.createDataFrame([], kind)
    # Longest first, then the smallest place.
    best = F.min_by(F.struct("length", "id", "at"), F.struct(-F.col("length"), "id", "at"))
    return found.groupBy("item", "item_at").agg(best.alias("m")).select("item", "item_at", "m.*")
