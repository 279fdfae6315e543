"""Toxicity by cumulative-link ordinal regression: P(grade <= k) = sigmoid(theta_k - w.x), one w for all thresholds.

x marks which of the selected features a text holds: words (lower-cased) and the first 3 to 7 letters of words. Features are
selected whose log odds between grade 0 and above stand out among the fit's rows; weights and ordered thresholds are then
fitted together with an L2 penalty. The output is the probability of each grade, the expected severity and whether
grade 1 or more is likelier than not.

Grades come from the labels alone. Where those only say toxic or not there are two grades, one threshold, and the severity is the
probability of being toxic.

The fit reads a bounded sample of labelled rows (``fit_rows``, those with the smallest hashes of the id, copies of one text once)
and at most ``most_features`` features; prediction covers every whole text.

Edge cases: null and empty texts hold no feature and get the base rate; labelled rows with a null grade or id or text are left
out; an id with several grades has the highest; a grade that no row has gets next to no probability; without labelled rows, or with one grade alone, everything gets that grade (0 if none); an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType

from quarry.llm.common import schema, written

FIT_ROWS = 10_000
#: A feature is selected if it is in so many rows and its log odds ratio is so many standard errors from 0.
MIN_ROWS, MIN_Z, MOST_FEATURES = 5, 4.5, 5_000
#: Features a task counts before it passes the counts on, and words it remembers the features of.
FLUSH, CACHE = 200_000, 400_000
L2, STEPS = 0.2, 400
_WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[str]:
    return [word, *[f"{word[:k]}*" for k in range(3, min(8, len(word)))]]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: list[float]


class _Held(dict):
    """Word to those of its features that were selected."""

    def __init__(self, selected: dict[str, float]):
        self.selected = selected

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = got = tuple(f for f in features(word) if f in self.selected)
        return got

    def of(self, text: str | None) -> set[str]:
        return {f for got in map(self.__getitem__, words(text)) if got for f in got}


def grades(model: Model, held: _Held, text: str | None) -> np.ndarray:
    """Probability of each grade."""
    score = sum(model.weights[f] for f in held.of(text))
    upto = [1 / (1 + np.exp(min(500.0, score - t))) for t in model.thresholds]
    return np.diff(np.array([0.0, *upto, 1.0]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _thresholds(p: np.ndarray, n_cols: int) -> np.ndarray:
    """A first threshold, then positive gaps, which p holds as logarithms."""
    return p[n_cols] + np.r_[0.0, np.cumsum(np.exp(p[n_cols + 1 :]))]


def loss(p: np.ndarray, rows: np.ndarray, cols: np.ndarray, n_cols: int, grade: np.ndarray) -> tuple[float, np.ndarray]:
    """Penalised negative log likelihood of the parameters (weights, first threshold, logarithms of gaps), and its gradient."""
    w, theta, steps = p[:n_cols], _thresholds(p, n_cols), np.exp(p[n_cols + 1 :])
    score = np.bincount(rows, w[cols], len(grade))
    above = np.r_[theta, np.inf][grade] - score
    below = np.r_[-np.inf, theta][grade] - score
    up, lo = np.where(np.isinf(above), 1.0, _sigmoid(above)), np.where(np.isinf(below), 0.0, _sigmoid(below))
    mass = np.maximum(up - lo, 1e-12)
    d_up, d_lo = up * (1 - up) / mass, lo * (1 - lo) / mass
    by_theta = np.array([(-d_up[grade == j]).sum() + d_lo[grade == j + 1].sum() for j in range(len(theta))])
    later = np.cumsum(by_theta[::-1])[::-1]
    by_weight = np.bincount(cols, (d_up - d_lo)[rows], n_cols) + L2 * w
    return float(-np.log(mass).sum() + L2 / 2 * (w @ w)), np.concatenate([by_weight, later[:1], later[1:] * steps])


def solve(rows: np.ndarray, cols: np.ndarray, n_cols: int, grade: np.ndarray, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least :func:`loss`, by Adam on the full sample. rows, cols: the marked cells of the feature matrix."""
    n, k = len(grade), n_grades - 1
    share = np.clip(np.cumsum(np.bincount(grade, minlength=n_grades) + 0.5)[:k] / (n + 0.5 * n_grades), 1e-6, 1 - 1e-6)
    theta = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(n_cols), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        _, g = loss(p, rows, cols, n_cols, grade)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * 0.99 ** max(0, step - STEPS // 2) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:n_cols], _thresholds(p, n_cols)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, rows with it, of those with a grade over 0), added up by task as far as memory allows."""

    def flush(rows: Counter, high: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64()), pa.array([high[f] for f in rows], pa.int64())], ["feature", "n", "high"])

    rows, high = Counter(), Counter()
    for b in batches:
        for grade, text in zip(b.column(0).to_pylist(), b.column(1)):
            held = {f for w in words(text.as_py()) for f in features(w)}
            rows.update(held)
            if grade:
                high.update(held)
            if len(rows) > FLUSH:
                yield flush(rows, high)
                rows, high = Counter(), Counter()
    yield flush(rows, high)


def _selected(sample: DataFrame, most: int) -> list[str]:
    n, high = sample.agg(F.count("*"), F.sum((F.col("grade") > 0).cast("long"))).first()
    counts = sample.select("grade", "text").mapInArrow(_counted, "feature string, n long, high long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("high").alias("high"))
    a, b = F.col("high") + 0.5, F.col("n") - F.col("high") + 0.5
    c, d = high - F.col("high") + 0.5, (n - high) - (F.col("n") - F.col("high")) + 0.5
    z = F.abs(F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    best = counts.where(F.col("n") >= MIN_ROWS).withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(most)
    return sorted(r["feature"] for r in best.select("feature").collect())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", fit_rows: int = FIT_ROWS, most_features: int = MOST_FEATURES) -> Model:
    """labels: (id_col, grade_col int from 0)."""
    known = labels.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).where("id is not null and grade is not null")
    some = known.orderBy(F.xxhash64(F.lit("fit"), "id"), "id", "grade").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(some), "id")
    sample = written(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text"))
    seen = sorted(r["grade"] for r in sample.select("grade").distinct().collect())
    if len(seen) < 2:
        only = seen[0] if seen else 0
        return Model({}, [-50.0] * only + [50.0])
    names = _selected(sample, most_features)
    place = {f: i for i, f in enumerate(names)}

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(place)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(place[f] for f in held.of(t.as_py())) for t in b.column(1)], pa.list_(pa.int32()))], ["grade", "marks"])

    got = sample.mapInArrow(marked, "grade int, marks array<int>").toArrow().combine_chunks()
    grade, marks = got.column("grade").to_numpy().astype(np.int64), got.column("marks").to_pylist()
    order = sorted(range(len(grade)), key=lambda i: (grade[i], marks[i]))  # partitions come in any order
    grade, marks = grade[order], [marks[i] for i in order]
    row = np.repeat(np.arange(len(grade)), [len(m) for m in marks])
    col = np.array([i for m in marks for i in m], np.int64)
    w, theta = solve(row, col, len(names), grade, int(grade.max()) + 1)
    return Model(dict(zip(names, map(float, w))), [float(t) for t in theta])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, probabilities, severity, toxic) of each text: severity is the expected grade, toxic says P(grade >= 1) >= 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = schema(id=docs.select(id_col).schema[0].dataType, probabilities=ArrayType(DoubleType()), severity=DoubleType(), toxic=BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        held = _Held(model.weights)
        for b in batches:
            p = [grades(model, held, t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p, pa.list_(pa.float64())), pa.array([float(x @ np.arange(len(x))) for x in p], pa.float64()), pa.array([bool(x[0] <= 0.5) for x in p], pa.bool_())],
                ["id", "probabilities", "severity", "toxic"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, kind)
