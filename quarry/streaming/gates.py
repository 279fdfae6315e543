"""Rules that depend on what they decided before: rate limit, fixed-anchor dedup, alert gate.

Each is a small fold with bounded state. Batches replay history exactly and in parallel: after a quiet stretch as long as the rule
remembers, its state is empty, so history is cut there (:func:`quiet_segments`) and each piece is folded by itself, streamed in
order through Arrow batches. Only a key that never pauses is one piece, and it too is streamed, not collected. Streams keep the
same folds in keyed state and decide by event time, so they agree with the batches; they need a session whose state store is RocksDB
(``quarry.session.SETTINGS``).
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quarry.functions.labels import DEFAULTS

SECOND = 1_000_000


class RateFold:
    """At most ``cap`` admissions in any window. ``times``: the admissions the rule still remembers, in order; refused hits leave no trace."""

    outputs, saved = "allowed boolean, retry_after long", "times array<long>"

    def __init__(self, window_s: int = DEFAULTS.rate_window_s, times: Sequence[int] = ()):
        self.window, self.times = window_s * SECOND, [int(x) for x in times]

    def save(self) -> tuple:
        return (self.times,)

    def newest(self) -> int:
        return self.times[-1] if self.times else 0

    def step(self, id_: int, us: int, cap: int) -> tuple[bool, int]:
        del self.times[: bisect_right(self.times, us - self.window)]
        allowed = len(self.times) < cap
        if allowed:
            self.times.append(us)
            return allowed, 0
        free_at = (self.times[0] if self.times else us) + self.window
        return allowed, max(1, (free_at - us) // SECOND + 1)


class FixedAnchor:
    """A row within the window of its key's anchor is a repeat of it; the anchor is not moved by repeats."""

    outputs, saved = "anchor_id long, repeat_no long", "anchor long, since long, n long"

    def __init__(self, window_s: int = DEFAULTS.dedup_seconds, anchor: int = 0, since: int | None = None, n: int = 0):
        self.window = window_s * SECOND
        self.anchor, self.since, self.n = anchor, since, n

    def save(self) -> tuple:
        return self.anchor, self.since, self.n

    def newest(self) -> int:
        return self.since or 0

    def step(self, id_: int, us: int, cap: int) -> tuple[int, int]:
        if self.since is None or us - self.since >= self.window:
            self.anchor, self.since, self.n = id_, us, 0
        self.n += 1
        return self.anchor, self.n


class AlertGate:
    """At most ``most`` alerts of all keys in a window, then a cooldown of each key; only what is sent counts."""

    outputs, saved = "sent boolean", "times array<long>, keys array<string>"

    def __init__(self, window_s: int = DEFAULTS.alert_window_s, most: int = DEFAULTS.alerts_per_window, cooldown_s: int = DEFAULTS.alert_cooldown_s, times: Sequence[int] = (), keys: Sequence[str] = ()):
        self.window, self.most, self.cooldown = window_s * SECOND, most, cooldown_s * SECOND
        self.recent: deque[tuple[int, str]] = deque(zip(map(int, times), keys))

    def save(self) -> tuple:
        return [t for t, _ in self.recent], [k for _, k in self.recent]

    def newest(self) -> int:
        return self.recent[-1][0] if self.recent else 0

    def step(self, id_: int, us: int, key: str) -> tuple[bool]:
        keep = max(self.window, self.cooldown)
        while self.recent and us - self.recent[0][0] >= keep:
            self.recent.popleft()
        full = sum(us - t < self.window for t, _ in self.recent) >= self.most
        if full or any(k == key and us - t < self.cooldown for t, k in self.recent):
            return (False,)
        self.recent.append((us, key))
        return (True,)


class Replay(StatefulProcessor):
    """One fold for each key of a stream. Rows wait in state until the watermark has passed them and are folded in order of time and id; a timer
    wakes the key then, and once more when the fold has forgotten everything, to drop its state."""

    def __init__(self, keys: list[str], make: Callable, columns: list[str], waiting: StructType, out: list[str], value: str, gap_us: int):
        self.keys, self.make, self.columns, self.kind, self.out, self.value, self.gap = keys, make, columns, waiting, out, value, gap_us
        self.names = [f.name for f in StructType.fromDDL(make().saved)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", self.make().saved)
        self.waiting = handle.getListState("waiting", self.kind)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(x) else x for x in r) for pdf in rows for r in pdf[self.columns].astype(object).itertuples(index=False, name=None)]
        self.waiting.appendList(new)
        self._wake(min(int(r[self.columns.index("us")]) for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        id_, us, value = (self.columns.index(c) for c in ("id", "us", self.value))
        rows = sorted(self.waiting.get(), key=lambda r: (r[us], r[id_])) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[us] <= passed], [r for r in rows if r[us] > passed]
        fold = self.make(*self.fold.get()) if self.fold.exists() else self.make()
        got = [fold.step(r[id_], r[us], r[value]) for r in ready]
        if ready:
            self.fold.update(fold.save())
        self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self._wake(rest[0][us])
        elif self.fold.exists():
            if fold.newest() + self.gap <= passed:
                self.fold.clear()
            else:
                self._wake(fold.newest() + self.gap)
        if ready:
            yield pd.DataFrame([(*key, *r, *g) for r, g in zip(ready, got)], columns=[*self.keys, *self.columns, *self.out[len(self.keys) + len(self.columns) :]])[self.out]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.fold.update(tuple([int(x) for x in row[n]] if hasattr(row[n], "__len__") else int(row[n]) for n in self.names))
        self._wake(self.make(*self.fold.get()).newest() + self.gap)

    def close(self) -> None:
        pass


def quiet_segments(df: DataFrame, keys: Sequence[str], us: str, order: str, gap_s: int, slab_s: int = 86_400) -> DataFrame:
    """df with ``segment``: the time at which the key's last stretch without a pause of ``gap_s`` began.

    Two levels, so that a hot key spreads: pauses are found within each (key, day), and one summary row a day finds those between.
    """
    keys, gap, slab = list(keys), gap_s * SECOND, slab_s * SECOND
    day = Window.partitionBy(*keys, "_slab").orderBy(us, order)
    cut = df.withColumn("_slab", F.floor(F.col(us) / slab)).withColumn("_gap", F.col(us) - F.lag(us).over(day))
    cut = cut.withColumn("_start", F.when(F.col("_gap") >= gap, F.col(us)))
    days = cut.groupBy(*keys, "_slab").agg(F.min(us).alias("_min"), F.max(us).alias("_max"), F.max("_start").alias("_last"))
    by = Window.partitionBy(*keys).orderBy("_slab")
    days = days.withColumn("_first", F.when(F.coalesce(F.col("_min") - F.lag("_max").over(by) >= gap, F.lit(True)), F.col("_min")))
    carried = F.last(F.coalesce("_last", "_first"), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slab").alias("_s"), F.coalesce("_first", carried).alias("_open"))
    same = F.col("_slab") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    upto = F.max("_start").over(day.rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_upto", upto).join(days, same).withColumn("segment", F.coalesce("_upto", "_open")).select(*df.columns, "segment")


def _replay(rows: DataFrame, keys: Sequence[str], value: str, make: Callable, gap_s: int) -> DataFrame:
    """rows (keys, id, us, value) with the outputs of one fold per segment. Arrow carries the columns through as they are, nulls too."""
    keys, names, outputs = list(keys), rows.columns, make().outputs
    kinds = {"boolean": pa.bool_(), "long": pa.int64()}
    new = [tuple(x.split()) for x in outputs.split(", ")]

    piece = [*keys, "segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fold = None, None
        for b in batches:
            if not len(b):
                continue
            starts = _starts([b.column(c) for c in piece])
            first = tuple(b.column(c)[0].as_py() for c in piece)
            fold = make() if fold is None or first != last else fold
            got = []
            for new_piece, id_, us, v in zip(starts, *[b.column(c).to_pylist() for c in ("id", "us", value)]):
                if new_piece:
                    fold = make()
                got.append(fold.step(id_, us, v))
            last = tuple(b.column(c)[len(b) - 1].as_py() for c in piece)
            made = [pa.array(x, kinds[kind]) for x, (_, kind) in zip(zip(*got), new)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *made], [*names, *[n for n, _ in new]])

    cut = quiet_segments(rows, keys, "us", "id", gap_s)
    ordered = cut.repartition(*piece).sortWithinPartitions(*piece, "us", "id")
    kind = StructType([*rows.schema.fields, *StructType.fromDDL(outputs).fields])
    return ordered.select(*names, "segment").mapInArrow(run, kind)


def _starts(columns: Sequence[pa.Array]) -> list[bool]:
    """Whether a row differs from the one before it in any column; null equals null alone. The first one doesn't."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        either = pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
        out[1:] |= either | pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return out.tolist()


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rate_limit(hits: DataFrame, keys: Sequence[str], ts: str, id_col: str, cap, window_s: int = DEFAULTS.rate_window_s) -> DataFrame:
    """(keys, id, us, cap, allowed, retry_after) of each hit. cap: a column or a number."""
    rows = hits.select(*keys, F.col(id_col).alias("id"), _micros(ts).alias("us"), (F.lit(cap) if isinstance(cap, int) else cap).cast("long").alias("cap"))
    return _replay(rows, keys, "cap", lambda: RateFold(window_s), window_s)


def fixed_anchor(log: DataFrame, keys: Sequence[str], ts: str, id_col: str, window_s: int = DEFAULTS.dedup_seconds) -> DataFrame:
    """(keys, id, us, anchor_id, repeat_no): the surviving row of each row, and which repeat it is."""
    rows = log.select(*keys, F.col(id_col).alias("id"), _micros(ts).alias("us"), F.lit(0).cast("long").alias("cap"))
    return _replay(rows, keys, "cap", lambda: FixedAnchor(window_s), max(1, window_s)).drop("cap")


def alert_gate(alerts: DataFrame, key: str, ts: str, id_col: str, window_s: int = DEFAULTS.alert_window_s, most: int = DEFAULTS.alerts_per_window, cooldown_s: int = DEFAULTS.alert_cooldown_s) -> DataFrame:
    """(id, us, key, sent). The gate is one for all keys; its history is cut at pauses of all alerts together."""
    rows = alerts.select(F.lit(0).alias("gate"), F.col(id_col).alias("id"), _micros(ts).alias("us"), F.col(key).cast("string").alias("key"))
    return _replay(rows, ["gate"], "key", lambda: AlertGate(window_s, most, cooldown_s), max(window_s, cooldown_s)).drop("gate")


def merged_log(log: DataFrame, anchors: DataFrame) -> DataFrame:
    """log's surviving rows after dedup: repeat_count, and the quality columns of the latest repeat (answer: the latest not empty)."""
    joined = log.join(anchors.select("id", "anchor_id", "us"), "id")
    at = F.struct("us", "id")
    latest = joined.groupBy("anchor_id").agg(
        F.count("*").alias("repeat_count"), F.max_by(F.struct("sources_count", "top_score", "answered"), at).alias("q"),
        F.max_by(F.col("answer"), F.when(F.coalesce("answer", F.lit("")) != "", at)).alias("last_answer"),
    )
    out = log.join(latest, log["id"] == latest["anchor_id"])
    new = {"repeat_count": F.col("repeat_count"), "sources_count": F.col("q.sources_count"), "top_score": F.col("q.top_score"), "answered": F.col("q.answered"), "answer": F.coalesce("last_answer", log["answer"])}
    return out.select(*[new[c].alias(c) if c in new else log[c] for c in log.columns if c != "repeat_count"], latest["repeat_count"])


def _stream(rows: DataFrame, keys: Sequence[str], ts: str, value: str, make: Callable, gap_s: int, late: str, initial: DataFrame | None) -> DataFrame:
    rows = rows.withWatermark(ts, late)
    kept = [f for f in rows.schema.fields if f.name != ts]
    kind = StructType([*kept, *StructType.fromDDL(make().outputs).fields])
    waiting = StructType([f for f in kept if f.name not in keys])
    processor = Replay(list(keys), make, [f.name for f in waiting], waiting, [f.name for f in kind], value, gap_s * SECOND)
    start = None if initial is None else initial.groupBy(*keys)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, kind, "Append", "EventTime", start)


def rate_limit_stream(hits: DataFrame, keys: Sequence[str], ts: str, id_col: str, cap, window_s: int = DEFAULTS.rate_window_s, late: str = "0 seconds", initial: DataFrame | None = None) -> DataFrame:
    """The rate limit on a stream, as :func:`rate_limit` decides it. A hit is decided when the watermark, ``late`` behind the newest, has passed it, in
    order of time whatever the order of arrival; later ones are left out. ``initial``: :func:`rate_state` of the history before the stream."""
    rows = hits.select(*keys, F.col(ts).cast("timestamp").alias(ts), F.col(id_col).alias("id"), _micros(ts).alias("us"), (F.lit(cap) if isinstance(cap, int) else cap).cast("long").alias("cap"))
    return _stream(rows, keys, ts, "cap", partial(RateFold, window_s), window_s, late, initial)


def fixed_anchor_stream(log: DataFrame, keys: Sequence[str], ts: str, id_col: str, window_s: int = DEFAULTS.dedup_seconds, late: str = "0 seconds", initial: DataFrame | None = None) -> DataFrame:
    """Dedup on a stream: state is the anchor's id, time and count, and the rows that the watermark has not passed."""
    rows = log.select(*keys, F.col(ts).cast("timestamp").alias(ts), F.col(id_col).alias("id"), _micros(ts).alias("us"), F.lit(0).cast("long").alias("cap"))
    return _stream(rows, keys, ts, "cap", partial(FixedAnchor, window_s), max(1, window_s), late, initial).drop("cap")


def alert_gate_stream(alerts: DataFrame, key: str, ts: str, id_col: str, window_s: int = DEFAULTS.alert_window_s, most: int = DEFAULTS.alerts_per_window, cooldown_s: int = DEFAULTS.alert_cooldown_s, late: str = "0 seconds") -> DataFrame:
    """The alert gate on a stream. The gate is one for all keys, so it is one state, of what was sent within its memory; its task sees alerts alone."""
    rows = alerts.select(F.lit(0).alias("gate"), F.col(ts).cast("timestamp").alias(ts), F.col(id_col).alias("id"), _micros(ts).alias("us"), F.col(key).cast("string").alias("key"))
    return _stream(rows, ["gate"], ts, "key", partial(AlertGate, window_s, most, cooldown_s), max(window_s, cooldown_s), late, None).drop("gate")


def rate_state(decided: DataFrame, keys: Sequence[str], window_s: int = DEFAULTS.rate_window_s) -> DataFrame:
    """(keys, times): what a stream must remember of a batch that :func:`rate_limit` decided: each key's admissions of its last window, at most its cap."""
    last = Window.partitionBy(*keys)
    recent = decided.where("allowed").withColumn("_last", F.max("us").over(last)).where(F.col("us") > F.col("_last") - window_s * SECOND)
    return recent.groupBy(*keys).agg(F.array_sort(F.collect_list("us")).alias("times"))


def anchor_state(decided: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, anchor, since, n): each key's last anchor in a batch that :func:`fixed_anchor` decided."""
    at = F.struct("us", "id")
    last = decided.groupBy(*keys, "anchor_id").agg(F.min("us").alias("since"), F.max("repeat_no").alias("n"), F.max(at).alias("_at"))
    return last.groupBy(*keys).agg(F.max_by(F.struct(F.col("anchor_id").alias("anchor"), "since", "n"), "_at").alias("s")).select(*keys, "s.*")


def request_metrics_stream(requests: DataFrame, ts: str, window: str = "1 minute", late: str = "2 minutes", slow_ms: int = DEFAULTS.slow_ms) -> DataFrame:
    """Request counters by window; rows later than the watermark are left out."""
    return requests.withWatermark(ts, late).groupBy(F.window(ts, window), "method", "path", "status").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.count_if(F.col("ms") >= slow_ms).alias("n_slow"))
