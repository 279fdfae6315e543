"""Upload quotas replayed in order, in parallel.

Whether an upload is taken depends on what was taken before it: of all users (total bytes), of its user (files) and of its address that day (files). A
decision depends on earlier ones alone, so the sequential outcome is the one that reproduces itself: all decisions made at once from
sums over the decisions before each. Starting from "all taken", rounds repeat that until no decision changes; each settles at least one
more upload, and in practice all up to the next refusal that makes room for a smaller one.

Sums are taken in two levels: uploads lie in ranges of time, a sum runs within a range and starts from the sums of the ranges before, of which
there is one for each range, or user and range. So neither the total nor a user or address with very many uploads is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.labels import DEFAULTS, Tunables, quota_gate
from quarry.sources import scratch

MOST_ROUNDS = 1_000


def _before(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """rows with ``name``: the sum of value over the earlier rows (by range, us, id) of the same keys."""
    rows = rows.withColumn("_v", value)
    sums = rows.groupBy(*keys, "_range").agg(F.sum("_v").alias("_s"))
    starts = sums.select(*keys, "_range", (F.sum("_s").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_s")).alias("_start"))
    inside = Window.partitionBy(*keys, "_range").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return rows.join(starts, [*keys, "_range"]).withColumn(name, F.col("_start") + F.col("_in")).drop("_v", "_in", "_start")


def quota_replay(uploads: DataFrame, ts: str = "created_at", t: Tunables = DEFAULTS) -> DataFrame:
    """uploads (id, user_id, ip, bytes, files, ts) with ``refused``: the gate that failed when its turn came, null if it was taken.

    Turns are by time, then id, which are unique together. Uploads without a user or an address share one; null numbers count 0; one
    without a time comes first, on a day of its own.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("k"), F.col(c).cast("string")), F.lit("none"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    us = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(1 << 62)))
    rows = uploads.select("id", named("user_id").alias("_user"), F.concat_ws(" ", named("ip"), F.coalesce(F.to_date(ts).cast("string"), F.lit(""))).alias("_ip"), number("bytes").alias("bytes"), number("files").alias("files"), us.alias("us"))
    rows = rows.repartitionByRange("us", "id").withColumn("_range", F.spark_partition_id()).withColumn("refused", F.lit(None).cast("string"))
    with scratch.scope() as made:
        rows = scratch.stored(rows)
        for _ in range(MOST_ROUNDS):
            taken = lambda v: F.when(F.col("refused").isNull(), F.col(v)).otherwise(0)
            sums = _before(_before(_before(rows, [], taken("bytes"), "_total"), ["_user"], taken("files"), "_u"), ["_ip"], taken("files"), "_i")
            gate = quota_gate(F.col("_total"), F.col("bytes"), F.col("files"), F.col("_u"), F.col("_i"), t)
            changed = gate.isNull() != F.col("refused").isNull()
            after = scratch.stored(sums.select(*[gate.alias(c) if c == "refused" else c for c in rows.columns], changed.alias("_changed")))
            settled = after.where("_changed").isEmpty()
            rows = after.drop("_changed")
            scratch.remove(uploads.sparkSession, made[:-1])
            if settled:
                return uploads.join(rows.select("id", "refused"), "id")
    raise RuntimeError("the replay did not settle")
