"""The access expiry of each key over a stream whose events come out of order.

The fold over events does not commute, so an event that comes late must be
put where it belongs. Each key keeps what its expiry was before its oldest
event that may still be preceded by another, and the events since, in a list;
both are the state of ``transformWithStateInPandas``. An event is waited for
as long as it is no more than ``lateness`` blocks behind the key's highest
block; older ones are folded into the expiry, and what comes before them then
goes to the side output as too late. A grant or a revocation makes the events
before it of no account, so they are dropped from the list at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tilework.functions import NEVER
from tilework.operators.access import KINDS

OUT = "model_id string, key string, kind string, block long, log_index int, expiry string, version long"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
#: Buckets of keys of a stream.
BUCKETS = 1024
#: Rows of the output: the key's state after a batch, and events that came too late.
STATE, TOO_LATE = "state", "too_late"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Event = tuple[int, int, str, int]  # block, log_index, kind, duration


def fold(expiry: int, events: Iterable[Event]) -> int:
    """The expiry after events in their order."""
    for block, _, kind, duration in events:
        if kind == "access_granted":
            expiry = NEVER
        elif kind == "access_revoked":
            expiry = 0
        elif expiry != NEVER:
            expiry = max(expiry, block) + duration
    return expiry


def merge(pending: list[Event], new: Iterable[Event], floor: tuple[int, int]) -> tuple[list[Event], list[Event]]:
    """(the list in order with the new events, those too late).

    ``floor`` is the (block, log_index) up to which events were folded. An
    event that is in the list already came twice and counts once.
    """
    known = {e[:2]: e for e in pending}
    late = []
    for e in new:
        if e[:2] <= floor:
            late.append(e)
        else:
            known.setdefault(e[:2], e)
    return sorted(known.values()), late


def settle_until(expiry: int, pending: list[Event], floor: tuple[int, int], bound: int) -> tuple[int, list[Event], tuple[int, int]]:
    """Fold the events of blocks below ``bound``; what is left waits."""
    old = [e for e in pending if e[0] < bound]
    if not old:
        return expiry, pending, floor
    return fold(expiry, old), pending[len(old) :], old[-1][:2]


def told(key: tuple, expiry: int, waiting: list[Event], floor: tuple[int, int], version: int, late: list[Event]) -> list[tuple]:
    """The rows of a key after a batch."""
    at = waiting[-1][:2] if waiting else floor
    return [(*key, STATE, *at, str(fold(expiry, waiting)), version)] + [(*key, TOO_LATE, e[0], e[1], None, version) for e in late]


class AccessProcessor(StatefulProcessor):
    """One key's expiry, with a state of its own; see the module."""

    def __init__(self, lateness: int, idle_ms: int | None):
        self.lateness, self.idle_ms = lateness, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "expiry string, block long, log_index int, highest long, version long")
        self.waiting = handle.getListState("waiting", "block long, log_index int, kind string, duration long")

    def _read(self) -> tuple[int, list[Event], tuple[int, int], int, int]:
        expiry, block, log, highest, version = self.base.get() if self.base.exists() else ("0", -1, -1, -1, 0)
        return int(expiry), [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else [], (block, log), highest, version

    def _write(self, expiry: int, waiting: list[Event], floor: tuple[int, int], highest: int, version: int) -> None:
        self.base.update((str(expiry), floor[0], floor[1], highest, version))
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expiry, waiting, floor, highest, version = self._read()
        late: list[Event] = []
        for part in rows:
            new = [(int(b), int(i), k, int(d)) for b, i, k, d in zip(part["block"], part["log_index"], part["kind"], part["duration_blocks"])]
            waiting, behind = merge(waiting, new, floor)
            late += behind
            highest = max(highest, *(e[0] for e in new))
        expiry, waiting, floor = settle_until(expiry, waiting, floor, highest - self.lateness)
        version += 1
        self._write(expiry, waiting, floor, highest, version)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._told(key, expiry, waiting, floor, version, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A key that nothing came for is folded whole; what still comes for these blocks is too late."""
        expiry, waiting, floor, highest, version = self._read()
        expiry, waiting, floor = settle_until(expiry, waiting, floor, highest + 1)
        self._write(expiry, waiting, floor, highest, version + 1)
        yield self._told(key, expiry, waiting, floor, version + 1, [])

    def _told(self, key, expiry: int, waiting: list[Event], floor: tuple[int, int], version: int, late: list[Event]) -> pd.DataFrame:
        return pd.DataFrame(told(key, expiry, waiting, floor, version, late), columns=COLUMNS)

    def close(self) -> None:
        pass


class BucketProcessor(StatefulProcessor):
    """The expiries of the keys of one bucket; see the module. A batch costs what the keys it touches cost."""

    def __init__(self, lateness: int, idle_ms: int | None):
        self.lateness, self.idle_ms = lateness, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # waiting: block, log_index, place in KINDS and duration of each event, one after another; seen: when the key's last batch came, -1 after its timer.
        self.keys = handle.getMapState("keys", "model_id string, key string", "expiry string, block long, log_index int, highest long, version long, waiting array<long>, seen long")

    def _read(self, key: tuple) -> tuple[int, list[Event], tuple[int, int], int, int]:
        return self._state(self.keys.getValue(key) or ("0", -1, -1, -1, 0, [], -1))

    @staticmethod
    def _state(held: tuple) -> tuple[int, list[Event], tuple[int, int], int, int]:
        expiry, block, log, highest, version, flat, _ = held
        waiting = [(b, i, KINDS[k], d) for b, i, k, d in zip(*[iter(flat)] * 4)]
        return int(expiry), waiting, (block, log), highest, version

    def _write(self, key: tuple, expiry: int, waiting: list[Event], floor: tuple[int, int], highest: int, version: int, seen: int) -> None:
        flat = [v for b, i, kind, d in waiting for v in (b, i, KINDS.index(kind), d)]
        self.keys.updateValue(key, (str(expiry), floor[0], floor[1], highest, version, flat, seen))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: dict[tuple, list[Event]] = {}
        for part in rows:
            cells = (part[c].tolist() for c in ("model_id", "key", "block", "log_index", "kind", "duration_blocks"))
            for model_id, name, block, log, kind, duration in zip(*cells):
                came.setdefault((model_id, name), []).append((int(block), int(log), kind, int(duration)))
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms is not None else 0
        out: list[tuple] = []
        for one, new in came.items():
            expiry, waiting, floor, highest, version = self._read(one)
            waiting, late = merge(waiting, new, floor)
            highest = max(highest, *(e[0] for e in new))
            expiry, waiting, floor = settle_until(expiry, waiting, floor, highest - self.lateness)
            self._write(one, expiry, waiting, floor, highest, version + 1, now)
            out += told(one, expiry, waiting, floor, version + 1, late)
        if self.idle_ms is not None:
            self.handle.registerTimer(now + self.idle_ms)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Keys that nothing came for since the timer was set are folded whole; what still comes for these blocks is too late."""
        since = expiredTimerInfo.getExpiryTimeInMs() - self.idle_ms
        idle = [(tuple(k), tuple(v)) for k, v in self.keys.iterator() if 0 <= v[-1] <= since]
        out: list[tuple] = []
        for one, held in idle:
            expiry, waiting, floor, highest, version = self._state(held)
            expiry, waiting, floor = settle_until(expiry, waiting, floor, highest + 1)
            self._write(one, expiry, waiting, floor, highest, version + 1, -1)
            out += told(one, expiry, waiting, floor, version + 1, [])
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def stream_access(events: DataFrame, lateness: int, idle_ms: int | None = None, buckets: int | None = BUCKETS) -> DataFrame:
    """For each batch and key a row of kind 'state' with its expiry now, and a row of kind 'too_late' for each event that was.

    events: model_id, key, kind, block, log_index, duration_blocks (null: 0);
    other kinds are left out, and so are rows with a null block or log_index.
    ``lateness`` is in blocks of the same key. With ``idle_ms`` a key that
    nothing came for that long (by the clock) is folded whole by a timer, so
    its list goes. Keys are dealt into ``buckets`` (None: each key a state and
    a call of its own); the number stays as it was when a stream goes on from
    a checkpoint. The session needs the RocksDB state store.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    mine = events.filter(F.col("kind").isin(*KINDS) & F.col("block").isNotNull() & F.col("log_index").isNotNull())
    mine = mine.select("model_id", "key", "kind", "block", "log_index", F.coalesce("duration_blocks", F.lit(0)).alias("duration_blocks"))
    mode = "None" if idle_ms is None else "ProcessingTime"
    if buckets is None:
        return mine.groupBy("model_id", "key").transformWithStateInPandas(AccessProcessor(lateness, idle_ms), OUT, "Update", mode)
    dealt = mine.withColumn("bucket", F.pmod(F.xxhash64("model_id", "key"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(BucketProcessor(lateness, idle_ms), OUT, "Update", mode)


def keep_batches(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the output of each batch under path/batch=<n>; a repeated batch takes the place of its first try."""

    def run(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return run


def current_access(out: DataFrame) -> DataFrame:
    """(model_id, key, expiry) after the last batch of each key."""
    return out.filter(F.col("kind") == STATE).groupBy("model_id", "key").agg(F.max_by("expiry", "version").alias("expiry"))


def too_late(out: DataFrame) -> DataFrame:
    """(model_id, key, n): how many events of each key came too late."""
    return out.filter(F.col("kind") == TOO_LATE).groupBy("model_id", "key").agg(F.count(F.lit(1)).alias("n"))
