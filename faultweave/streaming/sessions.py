"""Chains of a live feed, over all sources at once.

Two steps keep the state small and the work spread. First, matches are summed up in windows
of time as wide as the longest pause inside a chain. Matches of one such window always
belong to one chain, so its summary (first and last time, size, greatest severity, root) is
all that a chain needs of it; this is a plain windowed aggregation, with partial sums before
the shuffle, for any number of lines and sources. Then the summaries, one at most for each
window of time however many lines there were, are joined in order of time by a stateful
step (``Sessions``), whose state is the one chain that is still open.

Spark hands a window on once the watermark has passed its end, so no summary arrives late:
a chain is closed by the first summary that lies too far behind it, or by a timer once the
watermark proves that no such window can still come. State and progress are in the stream's
checkpoint, so a restarted stream goes on with the chain that was open.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: arbitrary state with timers needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROOT = "root_weight int, root_sec long, root_nano int, root_source string, root_place long, root_line string, root_category string, root_pattern string"
_SUMMARY = f"start_sec long, start_nano int, last_sec long, last_nano int, size long, severity_rank int, {_ROOT}"
FIELDS = [f.split()[0] for f in _SUMMARY.split(", ")]
_START, _LAST, _SIZE, _SEVERITY, _OF_ROOT = slice(0, 2), slice(2, 4), 4, 5, slice(6, None)
_NANO = 1_000_000_000


def window_summaries(timed: DataFrame, window_s: float, keys: list[str], place: Column) -> DataFrame:
    """What chains need of the matches of each window of time. ``timed`` has a watermark."""
    micros = int(window_s * 1_000_000)
    at = F.struct("ts_sec", "ts_nano")
    # The least of these is the first match of the greatest causal weight.
    root = F.struct((-F.col("causal_weight")).alias("weight"), "ts_sec", "ts_nano", "source", place.cast("long").alias("place"), "line", "category", "pattern")
    sums = timed.groupBy(F.window("ts", f"{micros} microseconds"), *keys).agg(F.min(at).alias("a"), F.max(at).alias("z"), F.count(F.lit(1)).alias("size"), F.max("severity_rank").alias("severity_rank"), F.min(root).alias("r"))
    return sums.select("window", *keys, *[F.col(c).alias(n) for c, n in zip(("a.ts_sec", "a.ts_nano", "z.ts_sec", "z.ts_nano", "size", "severity_rank", "r.weight", "r.ts_sec", "r.ts_nano", "r.source", "r.place", "r.line", "r.category", "r.pattern"), FIELDS, strict=True)])


class Sessions(StatefulProcessor):
    """Joins summaries that are no further apart than ``window_ns``."""

    def __init__(self, window_ns: int, wait_ms: int) -> None:
        self.window_ns, self.wait_ms = window_ns, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _SUMMARY)

    def _apart(self, a: tuple, b: tuple) -> bool:
        return (b[_START][0] - a[_LAST][0]) * _NANO + b[_START][1] - a[_LAST][1] > self.window_ns

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        # Without a place (null) the line decides; tuples are compared field by field.
        def order(x: tuple) -> tuple:
            return tuple((v is not None, v) if not isinstance(v, str) else (True, v.encode()) for v in x[_OF_ROOT])

        root = min(a, b, key=order)[_OF_ROOT]
        return (*min(a[_START], b[_START]), *max(a[_LAST], b[_LAST]), a[_SIZE] + b[_SIZE], max(a[_SEVERITY], b[_SEVERITY]), *root)

    def _until(self, summary: tuple) -> int:
        """The watermark, in ms, from which nothing can reach the summary any more."""
        return summary[_LAST][0] * 1000 + summary[_LAST][1] // 1_000_000 + self.wait_ms

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = tuple(self.open.get()) if self.open.exists() else None
        was = now
        for row in sorted((tuple(r[c] for c in FIELDS) for r in rows), key=lambda r: r[_START]):
            if now is not None and self._apart(now, row):
                yield Row(chain_key=key[0], **dict(zip(FIELDS, now, strict=True)))
                now = None
            now = row if now is None else self._joined(now, row)
        if now == was:
            return
        if was is not None:
            self.handle.deleteTimer(self._until(was))
        if self._until(now) <= timerValues.getCurrentWatermarkInMs():
            # Known to be closed at once: there may be no later batch for a timer to run in.
            self.open.clear()
            yield Row(chain_key=key[0], **dict(zip(FIELDS, now, strict=True)))
        else:
            self.open.update(now)
            self.handle.registerTimer(self._until(now))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            now = tuple(self.open.get())
            if self._until(now) <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield Row(chain_key=key[0], **dict(zip(FIELDS, now, strict=True)))

    def close(self) -> None:
        pass


def joined_sessions(summaries: DataFrame, window_s: float, key: Column) -> DataFrame:
    """Chains, as summaries with ``chain_key``, each once it is closed."""
    spark = summaries.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # A batch then adds its changes to the checkpoint, not another copy of the store's files.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # A window may still be filled until the watermark passes its end, one width later.
    sessions = Sessions(int(window_s * _NANO), int(2 * window_s * 1000) + 1)
    return summaries.withColumn("chain_key", key).groupBy("chain_key").transformWithState(statefulProcessor=sessions, outputStructType=f"chain_key string, {_SUMMARY}", outputMode="Append", timeMode="EventTime")
