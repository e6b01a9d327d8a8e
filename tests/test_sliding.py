"""Sliding counts equal a plain count of the last window, on a batch and on a stream."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewise.streaming import monitors

START = datetime.datetime(2026, 1, 1)
SCHEMA = "ts timestamp_ntz, user_id long, scope string"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def plain(rows, limit, seconds):
    """Every event against all others of its subject."""
    found = {}
    for ts, user, scope in rows:
        if ts is not None:
            times = [t for t, u, s in rows if (u, s) == (user, scope) and t is not None]
            n = sum(datetime.timedelta(0) <= ts - t < datetime.timedelta(seconds=seconds) for t in times)
            if n > limit:
                found[(user, scope, ts)] = n
    return sorted(((*k, n) for k, n in found.items()), key=str)


def events(seed, n=400):
    draw = random.Random(seed)
    # Quarter seconds, so that moments repeat and lie exactly one window apart.
    return [(at(draw.randrange(1200) / 4), draw.choice([1, 1, 1, 2, None]), draw.choice(["a", "b"])) for _ in range(n)]


def told(df):
    return sorted(((r.user_id, r.scope, r.moment, r.requests) for r in df.collect()), key=str)


@pytest.mark.parametrize("windows", [1, 3, 64])
def test_batch(spark, windows):
    rows = [*events(1), (None, 1, "a"), (datetime.datetime(1969, 12, 31, 23, 59, 58), 1, "a"), (datetime.datetime(1970, 1, 1), 1, "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit, seconds in ((1, 2), (5, 7)):
        found = monitors.sliding_breaches(df, "ts", ["user_id", "scope"], limit, seconds, windows=windows)
        assert told(found) == plain(rows, limit, seconds)
    assert monitors.sliding_breaches(df.limit(0), "ts", ["user_id", "scope"], 1).count() == 0


def test_stream_late_rows_and_restart(spark, tmp_path):
    rows = sorted(events(2, 300), key=lambda r: r[0])
    draw = random.Random(3)
    # Within the delay of 30 seconds events come in any order.
    arriving = sorted(rows, key=lambda r: r[0] + datetime.timedelta(seconds=draw.randrange(25)))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def add(batch):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        found = monitors.sliding_breaches(stream, "ts", ["user_id", "scope"], 3, 7, delay="30 seconds", windows=4)
        query = found.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(target)
        assert query.awaitTermination(120)
        return spark.read.schema("user_id long, scope string, moment timestamp_ntz, requests long").parquet(target)

    add(arriving[:120])
    before = told(run())
    # The query starts again from its checkpoint; the last event pushes the watermark over all others.
    add(arriving[120:])
    add([(at(5000), 9, "z")])
    # Far behind the watermark by now: left out.
    add([(at(10), 1, "a")] * 9)
    found = run()
    expected = plain(rows, 3, 7)
    assert told(found) == expected and len(expected) > 20
    assert not Counter(before) - Counter(expected)
