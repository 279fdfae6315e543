"""Language identification by rank-order profiles.

A language's profile lists its most frequent character n-grams (1 to 3 letters, words padded by a space) by rank, over
training texts. A document's own most frequent n-grams are compared: the out-of-place distance sums how far each is from its
rank in the profile, with the profile's length for n-grams it lacks. The least distance wins, ties to the smaller name.

``score`` is 1 - best / second best distance, from 0 (no evidence) to 1; 1 if one language alone was learned. ``distance`` is the best
distance relative to the largest possible, that of a text without a single n-gram of the profile: near 0.1 to 0.3 for texts in
the language, near 1 for texts in none of the learned ones.

The fit reads at most about ``fit_rows`` documents a language, taken by a hash of the id (all, where there are fewer); prediction
covers every whole text. The model holds ``profile`` numbers a language and is broadcast; a column with more than ``MOST_LANGUAGES``
values is no language column and is refused.

Edge cases: null texts and texts without a letter give ``und`` with score 0 and distance 1, as does everything if nothing was learned;
training rows with a null language or text are left out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from quarry.llm.common import schema

#: N-grams in a language's profile, and in a document's own.
PROFILE, OWN = 800, 400
FIT_ROWS = 4_000
MOST_LANGUAGES = 10_000
_BITS = 21


@lru_cache(maxsize=None)
def _letters() -> np.ndarray:
    """Code point to itself where it is a letter, else to a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.int64)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (n code points, 21 bits each) with their counts, for n of 1 to 3 within space-padded words."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)]
    space = points == 32
    keep = ~(space & np.r_[False, space[:-1]])  # runs of other than letters are one space
    p, space = points[keep], space[keep]
    if len(p) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = (p[:-1] << _BITS) | p[1:]
    three = (two[:-1] << _BITS) | p[2:]
    grams, counts = np.unique(np.r_[p[~space], two, three[~space[1:-1]]], return_counts=True)
    return grams, counts


def top_grams(text: str | None, k: int) -> np.ndarray:
    grams, counts = gram_counts(text)
    if len(grams) > k:
        cut = np.partition(counts, len(counts) - k)[len(counts) - k]
        more = counts >= cut
        grams, counts = grams[more], counts[more]
    return grams[np.lexsort((grams, -counts))][:k]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, profile: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language, best first. What reaches the driver is ``profile`` numbers for each language."""
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    found = sizes.count()
    if found > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has {found} values; languages are {MOST_LANGUAGES} at most")
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("fit"), "id"), 11) / F.lit(float(2**53))
    some = rows.join(F.broadcast(sizes), "lang").where(unit < fit_rows / F.col("rows"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                grams, counts = zip(*[gram_counts(t) for t in texts])
                g, at = np.unique(np.concatenate(grams), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": g, "n": np.bincount(at, np.concatenate(counts), len(g)).astype("int64")})

    sums = some.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("rank", rank).where(F.col("rank") <= profile)
    out: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "rank", "gram").collect()):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", own: int = OWN) -> DataFrame:
    """(id, lang_pred, score, distance) of each text."""
    names = sorted(profiles)
    missing = max([1, *map(len, profiles.values())])
    grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    ranks = np.full((len(grams) + 1, max(1, len(names))), missing, np.int32)  # the last row: in no profile
    for j, name in enumerate(names):
        ranks[np.searchsorted(grams, np.array(profiles[name], np.int64)), j] = np.arange(len(profiles[name]))
    model = docs.sparkSession.sparkContext.broadcast((names, grams, ranks, missing))
    kind = schema(id=docs.select(id_col).schema[0].dataType, lang_pred=StringType(), score=DoubleType(), distance=DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, grams, ranks, missing = model.value

        def one(text: str | None) -> tuple[str, float, float]:
            top = top_grams(text, own)
            if not len(top) or not len(grams):
                return "und", 0.0, 1.0
            at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
            at[grams[at] != top] = len(grams)
            found = ranks[at]
            away = np.where(found < missing, np.abs(found - np.arange(len(top), dtype=np.int32)[:, None]), missing).sum(axis=0, dtype=np.int64)
            best = int(np.argmin(away))
            distance = float(away[best]) / (missing * len(top))
            if len(names) == 1:
                return names[0], 1.0, distance
            second = int(np.partition(away, 1)[1])
            return names[best], float(1 - away[best] / second) if second else 0.0, distance

        for batch in batches:
            got = [one(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())], ["id", "lang_pred", "score", "distance"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, kind)
