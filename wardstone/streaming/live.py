"""Live variants: keyed state for repeated frames, failure streaks, titles, alerts and dialogues; the continuous cascade.

Rows of a key may come in any order within a micro-batch: handlers sort them by sequence, and drop what is not later than
the last row seen. State is a few values for each key; dialogues expire after a time of silence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

from ..operators import decide, lexicon, table
from ..operators.dialogue import AGREED, PHASES

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TICK_OUT = "device_id long, seq long, skipped boolean, run_seq long, failures int, wait int, degraded boolean, segment int"


_KINDS = {"long": LongType(), "int": IntegerType(), "boolean": BooleanType(), "string": StringType(), "double": DoubleType()}


def _state(fields: str) -> StructType:
    """A state's fields; workers have no session that could parse a schema."""
    out = StructType()
    for name, kind in (f.split() for f in fields.split(", ")):
        out.add(name, _KINDS[kind])
    return out


class Ticks(StatefulProcessor):
    """Repeated frames, failure streaks and title segments of one device."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        state = _state("seq long, run_seq long, analysed boolean, hash string, failures int, title string, segment int")
        self.last = handle.getValueState("last", state)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, run_seq, analysed, held, failures, title, segment = self.last.get() if self.last.exists() else (None, None, False, None, 0, None, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if seq is not None and r.seq <= seq:
                continue
            frame = r.frame_hash if isinstance(r.frame_hash, str) else None
            now = r.title if isinstance(r.title, str) else None
            if seq is not None and now != title:
                segment += 1
            title = now
            skipped = bool(analysed and not r.has_audio and frame is not None and frame == held)
            if not skipped and r.failed:
                failures += 1
            elif not skipped:
                failures, held, analysed, run_seq = 0, frame, True, int(r.seq)
            seq = int(r.seq)
            out.append((key[0], seq, skipped, run_seq, failures, min(15, 2 * failures), failures >= 3, segment))
        self.last.update((seq, run_seq, analysed, held, failures, title, segment))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TICK_OUT.split(", ")])

    def close(self) -> None:
        pass


class OrderedTicks(Ticks):
    """The same in event time: rows wait until the watermark has passed them and are then taken in the order of time and
    number, so rows that come late, within the watermark's delay, count as if they had come in time. A device that is silent
    for ``quiet_ms`` of event time is forgotten."""

    def __init__(self, quiet_ms: int = 86_400_000):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getListState("waiting", _state("ms long, seq long, frame_hash string, has_audio boolean, failed boolean, title string"))
        self.seen = handle.getValueState("seen", _state("ms long"))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        text = lambda v: v if isinstance(v, str) else None
        times = set()
        for df in rows:
            for r in df.itertuples():
                ms = int(r.ts.timestamp() * 1000)
                self.waiting.appendValue((ms, int(r.seq), text(r.frame_hash), bool(r.has_audio), bool(r.failed), text(r.title)))
                times.add(ms)
        for ms in times:
            self.handle.registerTimer(ms)
        yield pd.DataFrame(columns=[c.split()[0] for c in TICK_OUT.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, then = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ripe = sorted((r for r in waiting if r[0] <= now), key=lambda r: r[:2])
        later = [r for r in waiting if r[0] > now]
        if ripe:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
            at, groups = self.seen.get()[0] if self.seen.exists() else None, []
            for r in ripe:  # after a silence of quiet_ms a device begins anew
                silent = at is not None and r[0] - at >= self.quiet_ms
                if silent or not groups:
                    groups.append((silent, []))
                groups[-1][1].append(r[1:])
                at = r[0]
            self.seen.update((at,))
            self.handle.registerTimer(at + self.quiet_ms)
            for silent, rows in groups:
                if silent:
                    self.last.clear()
                yield from super().handleInputRows(key, iter([pd.DataFrame(rows, columns=["seq", "frame_hash", "has_audio", "failed", "title"])]), timerValues)
        elif self.seen.exists() and then >= self.seen.get()[0] + self.quiet_ms:
            self.last.clear()
            self.seen.clear()


class Ring(StatefulProcessor):
    """The newest rows of a device, as many as ``most``; a change is answered with the whole ring (``upto`` is its newest row)."""

    def __init__(self, most: int = 30):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", _state("seq long, trace string"))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {int(s): t for s, t in (self.ring.get() if self.ring.exists() else [])}
        for df in rows:
            held |= {int(r.seq): r.trace if isinstance(r.trace, str) else None for r in df.itertuples()}
            held = {s: held[s] for s in sorted(held, reverse=True)[: self.most]}
        self.ring.put(list(held.items()))
        newest = max(held)
        yield pd.DataFrame([(key[0], newest, s, t, i + 1) for i, (s, t) in enumerate(held.items())], columns=["device_id", "upto", "seq", "trace", "rank"])

    def close(self) -> None:
        pass


class Records(StatefulProcessor):
    """Records of a device that rows open and complete by number: each change is answered with the record's last state. The
    oldest go when there are more than ``most``, and all that nothing touched for ``quiet_ms``."""

    def __init__(self, most: int = 1500, quiet_ms: int = 86_400_000):
        self.most, self.quiet_ms = most, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", _state("record long"), _state("event_id long, state string"), self.quiet_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changed: dict[int, tuple[int, str | None]] = {}
        for df in rows:
            for r in df.itertuples():
                record, at = int(r.record), int(r.event_id)
                last = changed.get(record) or (tuple(self.open.getValue((record,))) if self.open.containsKey((record,)) else None)
                if last is None or at > last[0]:
                    changed[record] = (at, r.state if isinstance(r.state, str) else None)
                    self.open.updateValue((record,), changed[record])
        held = sorted((v[0], k[0]) for k, v in self.open.iterator())
        for _, record in held[: max(0, len(held) - self.most)]:
            self.open.removeKey((record,))
        yield pd.DataFrame([(key[0], r, *v) for r, v in changed.items()], columns=["device_id", "record", "event_id", "state"])

    def close(self) -> None:
        pass


class Alerts(StatefulProcessor):
    """New hate runs of a device while no intercept is open. An alert opens one; rows with ``closed`` close it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _state("id long, open boolean"))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, is_open = self.last.get() if self.last.exists() else (None, False)
        out = []
        for r in pd.concat(list(rows)).assign(later=lambda d: ~d["closed"]).sort_values(["ts", "later", "id"]).itertuples():
            if r.closed:
                is_open = False
            elif r.decision == "hate" and not is_open and r.id != last:
                last, is_open = int(r.id), True
                out.append((key[0], last))
        self.last.update((last, is_open))
        yield pd.DataFrame(out, columns=["device_id", "id"])

    def close(self) -> None:
        pass


class Dialogue(StatefulProcessor):
    """Phase of each turn of a session; ``start`` rows open it, turns of unknown sessions are errors."""

    def __init__(self, words: tuple[str, ...] = AGREED, quiet_ms: int = 86_400_000):
        self.words, self.quiet_ms = words, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _state("turn long, n int, done boolean"), self.quiet_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn, n, done = self.state.get() if self.state.exists() else (None, 0, False)
        known, out = turn is not None, []
        for r in pd.concat(list(rows)).sort_values("turn").itertuples():
            if r.start:
                known, turn, n, done = True, int(r.turn), 0, False
                continue
            if not known:
                out.append((key[0], int(r.turn), None, False, "unknown session"))
                continue
            if r.turn <= turn:
                continue
            turn, n = int(r.turn), n + 1
            phase = "Completed" if done else PHASES[min(n, 3) - 1]
            done = done or n >= 3 and any(w in str(r.child_response).lower() for w in self.words)
            out.append((key[0], turn, phase, done, None))
        if known:
            self.state.update((turn, n, done))
        yield pd.DataFrame(out, columns=["session_id", "turn", "phase", "completed", "error"])

    def close(self) -> None:
        pass


def live_ticks(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("device_id").transformWithStateInPandas(Ticks(), TICK_OUT, "Append", "None")


def on_time(ticks: DataFrame, delay: str = "10 minutes", ts: str = "ts", keys: tuple[str, ...] = ("device_id", "seq")) -> DataFrame:
    """Rows by event time: those later than the delay are dropped, and so are repeats of a key within it."""
    return ticks.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def live_ticks_in_time(ticks: DataFrame, delay: str = "10 minutes", quiet_ms: int = 86_400_000) -> DataFrame:
    """Repeats, streaks and segments of rows (with ``ts``) in the order of event time, once the watermark has passed them."""
    return on_time(ticks, delay).groupBy("device_id").transformWithStateInPandas(OrderedTicks(quiet_ms), TICK_OUT, "Append", "EventTime")


def live_ring(ticks: DataFrame, most: int = 30) -> DataFrame:
    """The newest traces of each device that got a row: (device_id, upto, seq, trace, rank)."""
    return ticks.groupBy("device_id").transformWithStateInPandas(Ring(most), "device_id long, upto long, seq long, trace string, rank int", "Update", "None")


def live_records(events: DataFrame, most: int = 1500, quiet_ms: int = 86_400_000) -> DataFrame:
    """Last states of records as they change: (device_id, record, event_id, state)."""
    return events.groupBy("device_id").transformWithStateInPandas(Records(most, quiet_ms), "device_id long, record long, event_id long, state string", "Update", "ProcessingTime")


def live_alerts(runs: DataFrame) -> DataFrame:
    """Alerts of rows (device_id, id, ts, decision, closed)."""
    return runs.groupBy("device_id").transformWithStateInPandas(Alerts(), "device_id long, id long", "Append", "None")


def live_dialogue(turns: DataFrame, words: tuple[str, ...] = AGREED) -> DataFrame:
    return turns.groupBy("session_id").transformWithStateInPandas(Dialogue(words), "session_id long, turn long, phase string, completed boolean, error string", "Append", "ProcessingTime")


def cascade(ticks: DataFrame) -> DataFrame:
    """Ticks with text, child_age and a vision reading, to decided rows; a plan without state or shuffle."""
    screened = lexicon.screen(ticks).withColumnRenamed("lexicon_score", "text_score")
    return decide.decided(screened)


def persist_batches(path: str, prune_every: int = 25, prune: Callable[[int], None] | None = None, stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes each batch of decided rows to the table once, however often it is tried, and prunes after every
    so many rows. A batch that the ledger knows is left alone; one that was written but not entered is written over. The number
    of rows since the stream began is the ledger's, so it outlives restarts; ``prune`` is called with it."""
    done: dict[int, int] | None = None

    def write(batch: DataFrame, number: int) -> None:
        nonlocal done
        spark = batch.sparkSession
        if done is None:
            done = table.committed(spark, path, stream)
        if number in done:
            return
        before = sum(done.values())
        decided = batch.select("id", "ts", "device_id", "decision", "category", F.col("risk").alias("score"), "child_age", "app_exe")
        rows = table.write_batch(decided, path, f"{stream}-{number}")
        table.commit(spark, path, stream, number, rows)
        done[number] = rows
        if prune and (before + rows) // prune_every > before // prune_every:
            prune(before + rows)

    return write
