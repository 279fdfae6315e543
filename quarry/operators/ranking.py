"""Order-based operators: first per key, top per key, pages, retention, budgets, runs. No group is ever collected whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key, the least by ``order`` (which should end with a unique column).

    A minimum combines on the map side, so a key of any size costs a row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    slim = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.min_by(slim, F.struct(*order)).alias("_first")).select(*[F.col(c) if c in keys else F.col(f"_first.{c}") for c in df.columns])


def keep_first_by(df: DataFrame, key: Column, id_col: str, order: Sequence[str]) -> DataFrame:
    """df without the later rows of each key. Only key, order and id are shuffled for the choice; wide rows are met by a semi join."""
    firsts = df.select(key.alias("_key"), F.struct(*order, id_col).alias("_at")).groupBy("_key").agg(F.min("_at").alias("_at")).select(F.col(f"_at.{id_col}").alias("_id"))
    return df.join(firsts, df[id_col].eqNullSafe(F.col("_id")), "left_semi")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The n first rows of each key. The rank filter is pushed below the shuffle, so a task passes at most n rows a key on."""
    r = rank or "_rank"
    out = df.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(r) <= n)
    return out if rank else out.drop(r)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, largest: int = 200) -> DataFrame:
    """A page of the ordered rows, number from 1; numbers and sizes out of range are clamped."""
    size = max(1, min(largest, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def newest(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Retention: the n rows with the largest ids. The bound comes from a top-n of ids; rows are then filtered, not sorted."""
    last = df.select(id_col).orderBy(F.desc(id_col)).limit(n).agg(F.min(id_col).alias("_least"))
    return df.join(F.broadcast(last), F.col(id_col) >= F.col("_least"), "left_semi")


def context_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], text_col: str, most: int = 8000, least_tail: int = 200, salts: int = 32) -> DataFrame:
    """Rows of each key in order until ``most`` characters are used up; the first that overflows is cut to what is left if that is over
    ``least_tail``. ``order`` is unique within a key.

    Lengths alone are sorted, and texts join the few rows that stay. A key of any size is first cut in ``salts`` parts: what is
    beyond the budget within a part is beyond it in the whole.
    """
    slim = df.select(*keys, *order, F.coalesce(F.length(text_col), F.lit(0)).alias("_n"))
    before = lambda *by: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = slim.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    few = parts.withColumn("_before", before(*keys, "_salt")).where(F.col("_before") <= most).withColumn("_before", before(*keys))
    left = most - F.col("_before")
    few = few.where((F.col("_n") <= left) | (left > least_tail)).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, *order])], "_n", left.alias("_left"))
    same = F.lit(True)
    for i, c in enumerate([*keys, *order]):
        same = same & df[c].eqNullSafe(F.col(f"_k{i}"))
    text = F.when(F.col("_n") <= F.col("_left"), F.col(text_col)).otherwise(F.substring(F.col(text_col), F.lit(1), F.col("_left").cast("int")))
    return df.join(few, same).withColumn(text_col, text).select(*df.columns)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[str], out: str = "run") -> DataFrame:
    """Numbers, from 0, the runs of consecutive rows with equal ``same`` columns within each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now, before = F.struct(*same), F.lag(F.struct(*same)).over(w)
    change = F.when(F.row_number().over(w) == 1, 0).otherwise((~now.eqNullSafe(before)).cast("int"))
    return df.withColumn("_change", change).withColumn(out, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def mode_first_seen(df: DataFrame, keys: Sequence[str], value: Column, order: str) -> DataFrame:
    """(keys, value, n): the most frequent value of each key, ties to the one seen first."""
    counts = df.select(*keys, value.alias("value"), F.col(order).alias("_at")).where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min("_at").alias("_at"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "_at", "value")).alias("b"))
    return best.select(*keys, F.col("b.value").alias("value"), (-F.col("b.m")).alias("n"))
