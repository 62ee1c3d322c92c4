"""Trailing limits as state: what each key used in the last minute, hour and day, kept by timers and forgotten after the longest span.

Events are dealt by key and stretch of time, a stretch as long as the longest span, and a stretch sees the one before
it besides; so a key of any size is many states, which are worked on side by side, and the state of a stretch is
dropped whole once the watermark has passed its end.  A state is one count and one amount for each second, so it is bounded by
two stretches and the lateness however many events there are, and the ids of events that still wait.  Both are kept as
blocks of whole columns, one for each batch and merged when a timer fires, as a call of the state store for
each second costs more than the work on it.  An event comes out once the watermark has passed its second, as events of the same
second count for each other.  Events later than the watermark are dropped by Spark.  The session must use the RocksDB state store.

Defined cases: a null or NaN amount adds nothing; events without a time or an id are left out; events of one key and second
all see each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The setting that ``trailing_usage`` needs, and its value.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SPANS = {"minute": 60, "hour": 3600, "day": 86400}


def _by_second(second: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and amounts summed by second, in order of time."""
    order = np.argsort(second, kind="stable")
    second, starts = np.unique(second[order], return_index=True)
    return second, np.add.reduceat(n[order], starts), np.add.reduceat(total[order], starts)


def _columns(blocks: list[tuple], *kinds: type) -> list[np.ndarray]:
    """The columns of all blocks, each put together."""
    return [np.concatenate([np.empty(0, kind), *(np.frombuffer(b[i], kind) for b in blocks)]) for i, kind in enumerate(kinds)]


class _Trailing(StatefulProcessor):
    """Counts by second, waiting events, and one timer for the first of them, or for the end of the stretch."""

    def __init__(self, spans: dict[str, int]) -> None:
        self.spans = spans
        self.width = max(spans.values())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seconds = handle.getListState("seconds", "second binary, n binary, total binary")
        self.waiting = handle.getListState("waiting", "id binary, second binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            second = part["second"].to_numpy(np.int64)
            counted = _by_second(second, np.ones(len(second), np.int64), np.nan_to_num(part["amount"].to_numpy(np.float64), nan=0.0, posinf=np.inf, neginf=-np.inf))
            self.seconds.appendValue(tuple(c.tobytes() for c in counted))
            own = part["own"].to_numpy(bool)
            if own.any():
                self.waiting.appendValue((part["id"].to_numpy(np.int64)[own].tobytes(), second[own].tobytes()))
                first = second[own].min() if first is None else min(first, second[own].min())
        self.handle.registerTimer(self._end(key) if first is None else (int(first) + 1) * 1000)
        return iter(())

    def _end(self, key) -> int:
        """The time in ms at which nothing more can come into a stretch."""
        return (int(key[1]) + 1) * self.width * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done = timerValues.getCurrentWatermarkInMs() // 1000  # seconds before it are complete
        ids, at = _columns(list(self.waiting.get()), np.int64, np.int64)
        second, n, total = _by_second(*_columns(list(self.seconds.get()), np.int64, np.int64, np.float64))
        ready = at < done
        if self._end(key) <= done * 1000:
            self.seconds.clear()
            self.waiting.clear()
        else:
            later = ~ready
            kept = second >= min([done, *at[later].tolist()]) - self.width
            self.seconds.put([tuple(c[kept].tobytes() for c in (second, n, total))])
            if later.any():
                self.waiting.put([(ids[later].tobytes(), at[later].tobytes())])
            else:
                self.waiting.clear()
            self.handle.registerTimer((int(at[later].min()) + 1) * 1000 if later.any() else self._end(key))
        if ready.any():
            upto = [np.concatenate([[0], np.cumsum(c)]) for c in (n, total)]
            ids, at = ids[ready], at[ready]
            high = np.searchsorted(second, at, "right")
            out = {"key": [key[0]] * len(at), "id": ids}
            for name, span in self.spans.items():
                low = np.searchsorted(second, at - span, "left")
                out |= {f"n_{name}": upto[0][high] - upto[0][low], f"sum_{name}": np.round(upto[1][high] - upto[1][low], 4)}
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def trailing_usage(
    events: DataFrame, *, key: str = "event_type", id_col: str = "event_id", at: str = "ts", amount: str = "value", spans: dict[str, int] = SPANS, late: str = "1 hour"
) -> DataFrame:
    """``key, id, n_minute, sum_minute, ...`` of each event of a stream: count and amount of its key in the trailing spans, both ends included."""
    rows = events.where(F.col(at).isNotNull() & F.col(id_col).isNotNull()).withWatermark(at, late).select(
        F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), F.col(at),
        F.unix_timestamp(at).alias("second"), F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("amount"),
    )
    # of each event a row in its own stretch, and one in the next, whose events look back at it
    stretch = F.floor(F.col("second") / max(spans.values())).cast("long")
    dealt = rows.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("stretch", stretch + F.when(F.col("own"), 0).otherwise(1))
    schema = ", ".join(["key string, id long", *[f"n_{s} long, sum_{s} double" for s in spans]])
    return dealt.groupBy("key", "stretch").transformWithStateInPandas(_Trailing(spans), schema, "Append", "EventTime")


def over_limits(usage: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``usage`` with ``over``, the first of the limits, as ``n_minute`` or ``sum_day``, that a row exceeds; null within all."""
    over = [F.when(F.col(name) > most, F.lit(name)) for name, most in limits.items()]
    return usage.withColumn("over", F.coalesce(*over))
