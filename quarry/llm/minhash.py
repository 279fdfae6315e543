"""Near-duplicates by b-bit MinHash.

Words are runs without ASCII white space after lower-casing A-Z; a document's set holds its distinct n-word shingles
(all words as one shingle if there are fewer than n; nothing without words). Signatures of ``BANDS`` x ``ROWS`` minima
give band keys, and the low ``BITS`` bits of the minima, packed in 64-bit words, estimate the similarity by counting
bits. Steps:

1. one pass over the texts: set size, 128-bit set fingerprint, band keys, packed signature;
2. equal sets collapse to the smallest id;
3. in each band bucket every member is paired with one center only, the member whose buckets are fullest; estimates far
   below the threshold drop out; the rest are confirmed on full shingle sets, and confirmed links give components;
4. only members of one bucket in different components can still add a link. A linked pair must share one of the rarest shingles of
   each (the prefix filter: in any fixed order of all shingles, two sets of similarity s share one of their first
   n - ceil(s n) + 1, at places that leave room for the rest of the overlap). Pairs that do, in different components, are
   estimated and confirmed likewise, and components are taken again. The order is by a sketch of shingle counts of fixed size;
   a coarse sketch costs time, never a link.

A bucket of many copies so costs one pair a member, not all pairs, and no group meets in one task's memory: pairs
are confirmed in a stream sorted by one end, which is salted.

A true pair at the threshold 0.8 misses all bands with probability (1 - 0.8**5)**32 = 3e-6, and its
estimate lies ``SLACK`` (over six standard deviations) too low less often still.

Edge cases: null, empty and blank texts have n_shingles 0 and link with nothing; a null id passes through with a null
component and kept = true; rows that share an id share their component, and are linked by any of their texts; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, partitions, written

BANDS, ROWS, BITS = 32, 5, 2
HASHES = BANDS * ROWS
SIG_WORDS = HASHES * BITS // 64
SLACK = 0.24
#: Pairs that one salted run of an end's pairs holds about.
RUN = 512
#: Ids (8 bytes each) up to which they are broadcast to pick texts; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Parts that a class of equal sets is dealt over.
COPY_SALTS = 64
#: Counters of the sketch that orders shingles from rare to frequent; as a broadcast it has this size whatever the input.
COUNTERS = 1 << 20
#: Distinct words that a task remembers the hashes of; then it starts afresh.
CACHE = 400_000
_M = np.uint64(0x9E3779B97F4A7C15)
_X = np.uint64(0xBF58476D1CE4E5B9)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _X
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str | None, n: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    m = max(1, len(h) - n + 1)
    size = min(n, len(h))
    acc = np.full(m, size, np.uint64)
    for j in range(size):
        acc = _mixed((acc + h[j : j + m]) * _M)
    return np.unique(acc)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, HASHES, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[i : i + 1024, None] * a + b).min(axis=0), out=low)
    return low


def packed(minima: np.ndarray) -> np.ndarray:
    """The low BITS bits of each mixed minimum, in SIG_WORDS words."""
    low = _mixed(minima) & np.uint64(2**BITS - 1)
    per = 64 // BITS
    return (low.reshape(SIG_WORDS, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def band_keys(minima: np.ndarray) -> np.ndarray:
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    rows = minima.reshape(BANDS, ROWS)
    for j in range(ROWS):
        acc = _mixed((acc + rows[:, j]) * _M)
    return acc


SKETCH = "id long, n_shingles long, set_a long, set_b long, bands array<long>, sig array<long>"


def _sketcher(n: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        a, b = _permutations()
        for batch in batches:
            size, one, two, bands, sigs = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_hashes(text.as_py(), n, cache)
                size.append(len(s))
                if not len(s):
                    for c in (one, two, bands, sigs):
                        c.append(None)
                    continue
                low = signature(s, a, b)
                fp = xxhash.xxh3_128_intdigest(s.tobytes())
                one.append((fp & (2**64 - 1)) - 2**63)
                two.append((fp >> 64) - 2**63)
                bands.append(band_keys(low).view(np.int64))
                sigs.append(packed(low).view(np.int64))
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (size, one, two)), pa.array(bands, many), pa.array(sigs, many)], ["id", "n_shingles", "set_a", "set_b", "bands", "sig"])

    return sketch


def estimate(x: Column, y: Column) -> Column:
    """Similarity from two packed signatures: equal fields are counted by bits, then chance collisions are taken off."""
    lanes = F.lit(int("01" * 32, 2))
    differ = None
    for w in range(SIG_WORDS):
        d = x[w].bitwiseXOR(y[w])
        for k in range(1, BITS):
            d = d.bitwiseOR(F.shiftrightunsigned(x[w].bitwiseXOR(y[w]), k))
        one = F.bit_count(d.bitwiseAND(lanes))
        differ = one if differ is None else differ + one
    chance = 2.0**-BITS
    return (1 - differ / F.lit(float(HASHES)) - chance) / (1 - chance)


def _confirm(n: int, percent: int):
    """Rows come sorted by (center, salt) with the center's own texts (one, but for repeated ids) first in each run; yields the members that pass."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _WordHash()
        center, own, member = None, [], False
        for pdf in batches:
            out = []
            for c, i, text in zip(pdf["center"], pdf["member"], pdf["text"]):
                s = shingle_hashes(text, n, cache)
                if i == c:
                    own = [*own, s] if c == center and not member else [s]
                    center, member = c, False
                    continue
                assert c == center
                member = True
                for o in own:
                    both = len(np.intersect1d(o, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(o) + len(s) - both):
                        out.append((c, i))
                        break
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return confirm


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets pass. texts: (id, text)."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    member = pairs.join(degree, "a").select(F.col("a").alias("center"), F.col("b").alias("member"), F.pmod(F.xxhash64("b"), F.col("runs").cast("long")).cast("int").alias("salt"))
    lead = degree.select(F.col("a").alias("center"), F.col("a").alias("member"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("salt"))
    rows = member.union(lead).join(texts, F.col("member") == F.col("id"))
    runs = rows.select("center", "salt", (F.col("member") != F.col("center")).alias("later"), "member", "text")
    runs = runs.repartition(partitions(pairs.sparkSession), "center", "salt").sortWithinPartitions("center", "salt", "later", "member")
    return runs.select("center", "member", "text").mapInPandas(_confirm(n, percent), "a long, b long")


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (_mixed(shingles * _M) >> np.uint64(44)).astype(np.int64)


def shingle_counts(texts: DataFrame, n: int) -> np.ndarray:
    """How often each counter's shingles occur in the texts. Each task adds up its own; what is gathered has COUNTERS numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, sums = _WordHash(), np.zeros(COUNTERS, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                np.add.at(sums, _slot(shingle_hashes(text, n, cache)), 1)
        some = np.flatnonzero(sums)
        yield pd.DataFrame({"slot": some, "n": sums[some]})

    got = texts.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(COUNTERS, np.int64)
    sums[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return sums


def prefixes(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, size, at, shingle): the rarest shingles of each text, at their places, as many as the prefix filter needs."""
    order = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts, n))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _WordHash()
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"]):
                s = shingle_hashes(text, n, cache)
                first = s[np.lexsort((s, order.value[_slot(s)]))][: len(s) - -(-percent * len(s) // 100) + 1]
                out.append(pd.DataFrame({"id": i, "size": len(s), "at": np.arange(len(first)), "shingle": first.view(np.int64)}))
            yield pd.concat(out) if out else pd.DataFrame({"id": [], "size": [], "at": [], "shingle": []}).astype("int64")

    return texts.select("id", "text").mapInPandas(take, "id long, size long, at long, shingle long")


def across_components(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix shingle with room for the overlap. rows: prefixes with component.

    In each shingle the largest component is the right side alone, so that a large group isn't tried against itself.
    """
    sizes = rows.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("shingle").agg(F.count("*").alias("k"), F.max_by("component", F.struct("n", "component")).alias("largest")).where("k > 1")
    rest = written(rows.join(mixed.select("shingle", "largest"), "shingle"))
    left = rest.where("component <> largest").select("shingle", *[F.col(c).alias(f"{c}1") for c in ("id", "size", "at", "component")])
    right = rest.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("id", "size", "at", "component")])
    room = F.least(F.col("size1") - F.col("at1"), F.col("size2") - F.col("at2"))
    fits = ((100 + percent) * room >= percent * (F.col("size1") + F.col("size2"))) & (100 * F.least("size1", "size2") >= percent * F.greatest("size1", "size2"))
    met = left.join(right, "shingle").where((F.col("component1") != F.col("component2")) & fits)
    return met.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = written(rows.mapInArrow(_sketcher(n_words), SKETCH))
    sets = sketch.where("n_shingles > 0 and id is not null")
    # Copies join the first of their part of the class, and that joins the class's first; a class of any size is dealt over the parts.
    salted = sets.select("id", "set_a", "set_b", F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)).cast("int").alias("salt"))
    parts = written(salted.groupBy("set_a", "set_b", "salt").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    tops = parts.groupBy("set_a", "set_b").agg(F.min("first").alias("top"), F.count("*").alias("k")).where("k > 1")
    same = salted.join(parts.where("n > 1"), ["set_a", "set_b", "salt"]).select(F.col("id").alias("a"), F.col("first").alias("b"))
    same = same.union(parts.join(tops, ["set_a", "set_b"]).select("first", "top")).where("a <> b")
    reps = sets.groupBy("set_a", "set_b").agg(F.min(F.struct("id", "sig", "bands")).alias("rep"))
    reps = written(reps.select("rep.*"))
    bands = reps.select("id", F.explode("bands").alias("band"))
    # Most buckets hold one document; only keys of the others are written.
    buckets = bands.groupBy("band").agg(F.count("*").alias("full")).where("full > 1")
    met = written(bands.join(buckets, "band"))
    weight = met.groupBy("id").agg(F.sum("full").alias("weight"))
    # A center stands amid its near-copies: the fuller its buckets, the likelier. Ties go to the smaller id.
    shared = met.join(weight, "id")
    centers = shared.groupBy("band").agg(F.min(F.struct((-F.col("weight")).alias("w"), "id")).alias("c")).select("band", F.col("c.id").alias("a"))
    shared = written(met.join(centers, "band").select("band", "id", "a"))
    sigs = written(reps.join(shared.select("id").distinct(), "id").select("id", "sig"))
    floor = percent / 100 - SLACK

    stars = shared.where("a <> id").select("a", F.col("id").alias("b")).distinct()
    likely = stars.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = written(likely.where(estimate(F.col("sa"), F.col("sb")) >= floor).select("a", "b"))
    # The ids are as many as documents that share a bucket; while they are few, texts that nobody asks for aren't shuffled.
    wanted = sigs.select("id").distinct()
    texts = written(rows.join(F.broadcast(wanted) if sigs.count() <= BROADCAST_IDS else wanted, "id").dropDuplicates(["id", "text"]))
    links = written(confirmed(pairs, texts, n_words, percent))
    first = components(links)

    # What can still join two components: members of one bucket in different ones.
    tagged = written(shared.select("band", "id").join(first, "id", "left").withColumn("component", F.coalesce("component", "id")))
    mixed = tagged.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("band")
    rest = written(tagged.join(mixed, "band").groupBy("id").agg(F.first("component").alias("component")))
    # Texts of documents that no bucket leaves open aren't read again.
    rare = prefixes(texts.join(rest.select("id"), "id"), n_words, percent).join(rest, "id")
    both = across_components(rare, percent)
    likely = both.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    across = likely.where(estimate(F.col("sa"), F.col("sb")) >= floor).select("a", "b")
    more = written(confirmed(written(across), texts, n_words, percent))

    final = components(links.union(more).union(same))
    return (
        sketch.select("id", "n_shingles")
        .join(final, "id", "left")
        .select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose group holds a smaller id; columns as they were. Rows that share an id are one document."""
    found = near_duplicates(docs, id_col, text_col, n_words, percent).where("not kept").select(F.col("id").alias("_dup_id")).distinct()
    kept = docs.join(found, F.col(f"`{id_col}`").cast("long") == F.col("_dup_id"), "left_anti")
    return kept
