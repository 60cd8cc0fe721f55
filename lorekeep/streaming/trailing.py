"""Keyed state that outlives a micro-batch: trailing windows in order of seq, and working rows with a time to live."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import policy
from ..operators.policy import Rule
from ..sources.tables import micros

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a mutation carries through the state.
CARRIED = ("event_id", "client_id", "category", "path", "command", "session_cost", "at")
CARRIED_TYPES = "event_id long, client_id long, category string, path string, command string, session_cost double, at long"
#: Seqs of a block of waiting events.
BLOCK = 256


def use_state_store(spark: SparkSession) -> None:
    """Arbitrary state needs the store that keeps keys on the executors' disks instead of in memory.

    The processors here go to their workers by value: Spark starts one beside the driver that has not the driver's path.
    """
    register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def plain(value):
    return None if pd.isna(value) else value.item() if hasattr(value, "item") else value


class TrailingShares(StatefulProcessor):
    """Error shares over the last events of a session, whatever order its events arrive in.

    An event is let out once all events with a smaller seq have come. What came early waits in the state, in blocks of
    ``BLOCK`` successive seqs, each read and written once a batch; so does nothing else but a few flags and counts,
    however long the session. A seq seen before is a repeat and is dropped. If the gap before a waiting event stays open
    until the watermark is ``lateness`` past the event's own instant, the event goes on without what is missing; a
    session has one timer, at the first such instant.
    """

    def __init__(self, bounds: list[int | None], lateness: timedelta):
        self.bounds, self.wait = bounds, int(lateness.total_seconds() * 1000)
        self.most = max([n for n in bounds if n is not None], default=1)
        self.row = Row("session_id", "seq", *CARRIED[:6], *[f"error_{n or 'all'}" for n in bounds])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", "next long, events long, errors long, flags string, held long, due long")
        self.waiting = handle.getMapState("waiting", "block long", "rows binary")

    def _out(self, session, seq: int, row: tuple, state: list) -> Row:
        bad = row[2] == "error"
        state[0], state[1], state[2] = seq + 1, state[1] + 1, state[2] + bad
        state[3] = (state[3] + "01"[bad])[-self.most :]
        share = lambda n: state[2] / state[1] if n is None else state[3][-n:].count("1") / min(n, state[1])
        return self.row(session, seq, *row[:6], *[share(n) for n in self.bounds])

    def _put(self, block: int, rows: dict[int, tuple]) -> None:
        if rows:
            self.waiting.updateValue((block,), (pickle.dumps(rows),))
        else:
            self.waiting.removeKey((block,))

    def _await(self, state: list, due: int) -> None:
        if state[5] is None or due < state[5]:
            state[5] = due
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = list(self.tail.get() or (1, 0, 0, "", 0, None))
        fresh: dict[int, dict[int, tuple]] = {}
        for r in rows:
            if r["seq"] >= state[0]:
                fresh.setdefault(r["seq"] // BLOCK, {})[r["seq"]] = tuple(r[c] for c in CARRIED)
        out, held, met = [], {}, set()

        def block(n: int) -> dict[int, tuple]:
            if n not in held:
                stored = self.waiting.getValue((n,)) if state[4] else None
                held[n] = pickle.loads(stored[0]) if stored else {}
                state[4] -= len(held[n])
                if n in fresh:
                    met.add(n)
                    held[n] |= fresh[n]
            return held[n]

        for n in sorted(fresh):
            block(n)
        while (own := block(state[0] // BLOCK)) and (row := own.pop(state[0], None)):
            met.add(state[0] // BLOCK)
            out.append(self._out(key[0], state[0], row, state))
        for n, own in held.items():
            state[4] += len(own)
            if n in met:
                self._put(n, own)
        due = [own[seq][6] for n, own in held.items() for seq in fresh.get(n, ()) if seq in own]
        if due:
            self._await(state, min(due) // 1000 + self.wait)
        self.tail.update(tuple(state))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = list(self.tail.get() or (1, 0, 0, "", 0, None))
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) - self.wait
        blocks = {k[0]: pickle.loads(v[0]) for k, v in self.waiting.iterator()} if state[4] else {}
        last = max((seq for own in blocks.values() for seq, row in own.items() if row[6] // 1000 <= due), default=0)
        out, state[4], state[5] = [], 0, None
        for n, own in sorted(blocks.items()):
            before = len(own)
            for seq in sorted(own):
                if seq <= last or seq == state[0]:  # what follows without a gap goes along
                    out.append(self._out(key[0], seq, own.pop(seq), state))
            if len(own) < before:
                self._put(n, own)
            state[4] += len(own)
        left = [row[6] for own in blocks.values() for row in own.values()]
        if left:
            self._await(state, min(left) // 1000 + self.wait)
        self.tail.update(tuple(state))
        yield from out


def trailing_stream(mutations: DataFrame, session: DataFrame, rules: list[Rule], lateness: timedelta = timedelta(days=1)) -> DataFrame:
    """ST-04, C-12: outcomes of every rule, those over a trailing window of the session too, as mutations arrive.

    Equal to ``policy.evaluate(policy.enrich(...))`` over the finished table for any order of arrival, as long as no event
    is ``lateness`` late. The stream is dealt by session; a task holds one session's flags at a time.
    """
    use_state_store(mutations.sparkSession)
    bounds = sorted({r.window_events for r in rules if r.match_kind == "error_rate"}, key=lambda n: n or 0)
    cost = session.select("session_id", F.col("cost_usd").cast("double").alias("session_cost"))
    timed = mutations.withColumns({"at": micros(F.col("occurred_at")), "_time": F.col("occurred_at").cast("timestamp")})
    timed = timed.withWatermark("_time", f"{int(lateness.total_seconds())} seconds").join(cost, "session_id", "left")
    rows = timed.select("session_id", "seq", *CARRIED, "_time")
    shares = "".join(f", error_{n or 'all'} double" for n in bounds)
    kinds = f"session_id long, seq long, {CARRIED_TYPES.removesuffix(', at long')}{shares}"
    done = rows.groupBy("session_id").transformWithState(TrailingShares(bounds, lateness), kinds, "append", "eventTime")
    return policy.evaluate(done, rules)


class LiveRows(StatefulProcessor):
    """The last write of a key, until its time to live has passed."""

    def __init__(self, ttl: timedelta):
        self.ttl = int(ttl.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "value string, at long")

    def _frame(self, key, value, at: int, live: bool) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"session_id": [key[0]], "scratch_key": [key[1]], "value": [value], "at": [at], "live": [live]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.row.get()
        best = (held[1], held[0] or "") if held else None
        value = held[0] if held else None
        for frame in rows:
            for v, at in zip(frame["value"], frame["at"]):
                v = plain(v)
                if best is None or (at, v or "") > best:
                    best, value = (int(at), v or ""), v
        if held is None or (value, best[0]) != tuple(held):
            if held is not None:
                self.handle.deleteTimer(held[1] // 1000 + self.ttl)
            self.row.update((value, best[0]))
            self.handle.registerTimer(best[0] // 1000 + self.ttl)
            yield from self._frame(key, value, best[0], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, at = self.row.get()
        self.row.clear()
        yield from self._frame(key, value, at, False)


def live_stream(writes: DataFrame, ttl: timedelta, lateness: timedelta = timedelta(hours=1)) -> DataFrame:
    """ST-09, D-18: changes of the working tier: (session_id, scratch_key, value, at, live).

    A key's row appears with each newer write and once more, not live, when the watermark has passed its last write by
    ``ttl``; its state is gone then. State is bounded by the keys that are alive, not by those ever written.
    """
    use_state_store(writes.sparkSession)
    timed = writes.withColumns({"at": micros(F.col("updated_at")), "_time": F.col("updated_at").cast("timestamp")})
    timed = timed.withWatermark("_time", f"{int(lateness.total_seconds())} seconds")
    rows = timed.select("session_id", "scratch_key", "value", "at", "_time")
    kinds = "session_id long, scratch_key string, value string, at long, live boolean"
    return rows.groupBy("session_id", "scratch_key").transformWithStateInPandas(LiveRows(ttl), kinds, "append", "eventTime")


def standing(changes: DataFrame) -> DataFrame:
    """Rows that are live after all ``changes`` with the number of their ``batch``."""
    last = F.max_by(F.struct("value", "at", "live"), F.struct("batch", (~F.col("live")).alias("gone"), "at"))
    return changes.groupBy("session_id", "scratch_key").agg(last.alias("r")).where("r.live").select("session_id", "scratch_key", "r.value", "r.at")
