"""Trailing limits as state against the batch form, with several batches and late rows."""

from __future__ import annotations

from unittest.mock import MagicMock

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import timeline
from tessera.streaming import limits
from tessera.streaming import events as streams


@pytest.fixture
def state_store(spark):
    before = spark.conf.get(limits.STATE_STORE[0], None)
    spark.conf.set(*limits.STATE_STORE)
    yield
    if before is None:
        spark.conf.unset(limits.STATE_STORE[0])
    else:
        spark.conf.set(limits.STATE_STORE[0], before)


def test_stream_equals_the_batch_form_and_drops_late_rows(spark, tmp_path, state_store):
    base = 1_700_000_000
    rows = [(i, "ab"[i % 2], base + i * 700 // 3, float(i % 7)) for i in range(600)]
    rows += [(1000 + i, "a", base + 5000, None) for i in range(3)]
    rows.sort(key=lambda r: r[2])
    parts = [rows[:300], rows[300:], [(5000, "a", base, 1.0), (5001, "b", base + 600 * 700, 2.0)]]  # the last one is late but for its second row
    schema = "event_id long, event_type string, at long, value double"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    typed = "event_id long, event_type string, at long, value double"
    stream = spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream = stream.withColumn("ts", F.timestamp_seconds("at"))
    got = {r.id: r for r in streams.finished(limits.trailing_usage(stream, late="10 minutes"), "append").collect()}
    kept = spark.createDataFrame([r for r in rows] + parts[2][1:], schema).na.fill(0.0)
    want = {r.event_id: r for r in timeline.trailing(kept, "event_type", "at", "value", limits.SPANS).collect()}
    assert 5000 not in got and set(got) == {r[0] for r in rows}  # the very last row still waits
    for i, r in got.items():
        for span in limits.SPANS:
            assert (r[f"n_{span}"], round(r[f"sum_{span}"], 4)) == (want[i][f"n_{span}"], round(want[i][f"sum_{span}"], 4)), (i, span)


def test_first_limit_that_is_exceeded(spark):
    usage = spark.createDataFrame([(1, 61, 5.0), (2, 3, 200.0), (3, 3, 5.0)], "id int, n_minute long, sum_day double")
    got = {r.id: r.over for r in limits.over_limits(usage, {"n_minute": 60, "sum_day": 100}).collect()}
    assert got == {1: "n_minute", 2: "sum_day", 3: None}


def test_a_batch_costs_a_few_state_calls_and_a_stretch_is_dropped_whole():
    stored = {}

    def state(name, schema):
        held, calls = stored.setdefault(name, []), MagicMock()
        calls.appendValue.side_effect = held.append
        calls.get.side_effect = lambda: iter(list(held))
        calls.clear.side_effect = held.clear
        return calls

    handle, timers = MagicMock(), MagicMock()
    handle.getListState.side_effect = state
    processor = limits._Trailing({"minute": 60, "day": 86400})
    processor.init(handle)
    rows = pd.DataFrame({"id": range(2000), "second": [86400 + i // 2 for i in range(2000)], "amount": 0.5, "own": [i >= 100 for i in range(2000)]})
    assert list(processor.handleInputRows(("a", 1), iter([rows]), timers)) == []
    used = processor.seconds.method_calls + processor.waiting.method_calls + handle.registerTimer.call_args_list
    assert len(used) <= 3  # the store is asked by batch, not by second
    timers.getCurrentWatermarkInMs.return_value = 2 * 86_400_000
    (out,) = processor.handleExpiredTimer(("a", 1), timers, None)
    last = out.iloc[-1]
    assert len(out) == 1900 and (last.n_minute, last.sum_minute, last.n_day, last.sum_day) == (122, 61.0, 2000, 1000.0)
    assert stored == {"seconds": [], "waiting": []}
    assert list(processor.handleExpiredTimer(("a", 1), timers, None)) == []  # a timer that is left over
