"""The gates on streams: out of order and late rows, a restart from the checkpoint, a history before the stream, against the batch replay."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.streaming import gates

HITS = "id long, k string, us long"
BASE = 1_700_000_000_000_000


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    us, out = BASE, []
    for i in range(240):
        us += r.choice([0, 200_000, 5_000_000, 40_000_000, 90_000_000])
        out.append((i, r.choice("aab"), us))
    return out


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _frame(spark, rows):
    return spark.createDataFrame(rows, HITS).withColumn("ts", F.timestamp_micros("us"))


def _put(spark, rows, path):
    _frame(spark, rows).coalesce(1).write.mode("append").parquet(path)


def _run(spark, make, tmp_path, name):
    stream = spark.readStream.schema(_frame(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return {r["id"]: r for r in spark.read.parquet(str(tmp_path / name)).where("id < 1000").collect()}


def test_streams_agree_with_batches_over_restarts(spark, rows, tmp_path):
    """Two files with rows out of order, a restart, a third file with a late row, and one far ahead that lets the rest pass."""
    r = random.Random(2)
    parts = [rows[:80], rows[80:160], rows[160:]]
    mixed = [sorted(p, key=lambda x: x[2] + r.randrange(30_000_000)) for p in parts]
    late = (900, "a", BASE - 1)
    folder = str(tmp_path / "in")
    makes = {
        "allowed": (lambda s: gates.rate_limit_stream(s, ["k"], "ts", "id", 3, late="10 minutes"), lambda df: gates.rate_limit(df, ["k"], "ts", "id", 3)),
        "anchor_id": (lambda s: gates.fixed_anchor_stream(s, ["k"], "ts", "id", late="10 minutes"), lambda df: gates.fixed_anchor(df, ["k"], "ts", "id")),
        "sent": (lambda s: gates.alert_gate_stream(s, "k", "ts", "id", late="10 minutes"), lambda df: gates.alert_gate(df, "k", "ts", "id")),
    }
    _put(spark, mixed[0], folder)
    _put(spark, mixed[1], folder)
    for column, (make, _) in makes.items():
        assert len(_run(spark, make, tmp_path, column)) < 160  # what the watermark has not passed waits
    _put(spark, [*mixed[2], late], folder)
    _put(spark, [(1000, "z", rows[-1][2] + 10**10)], folder)
    for column, (make, batch) in makes.items():
        got = {i: x[column] for i, x in _run(spark, make, tmp_path, column).items()}
        assert got == {x["id"]: x[column] for x in batch(_frame(spark, rows)).collect()}


def test_a_stream_goes_on_from_a_batch(spark, rows, tmp_path):
    """History decided by the replay, later rows by the stream with what it must remember."""
    cut = next(i for i in range(100, 200) if rows[i][2] - rows[i - 1][2] == 200_000)
    _put(spark, [*rows[cut:], (1000, "z", rows[-1][2] + 10**10)], str(tmp_path / "in"))
    for column, make, batch, state in (
        ("allowed", lambda s, i: gates.rate_limit_stream(s, ["k"], "ts", "id", 2, initial=i), lambda df: gates.rate_limit(df, ["k"], "ts", "id", 2), lambda df: gates.rate_state(df, ["k"])),
        ("anchor_id", lambda s, i: gates.fixed_anchor_stream(s, ["k"], "ts", "id", initial=i), lambda df: gates.fixed_anchor(df, ["k"], "ts", "id"), lambda df: gates.anchor_state(df, ["k"])),
    ):
        first = state(batch(_frame(spark, rows[:cut])))
        got = {i: x[column] for i, x in _run(spark, lambda s, make=make, first=first: make(s, first), tmp_path, column).items()}
        assert got == {x["id"]: x[column] for x in batch(_frame(spark, rows)).collect() if x["id"] >= cut}
