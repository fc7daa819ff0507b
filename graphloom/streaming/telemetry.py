"""Structured Streaming over telemetry events (ts TIMESTAMP, …)."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..catalog import small
from ..operators.ingest import RankedBuffer, ground_bits


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """[R3] Events and their first value per tumbling window and key; rows later than ``late`` drop in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("n"), F.bround(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def downsample(events: DataFrame, key: str, size: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """[R3] The earliest value per key and window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), key).agg(F.min_by("value", "ts").alias("value")).select(F.col("w.start").alias("start"), key, "value")


def thresholds(events: DataFrame, limits: dict[str, float]) -> DataFrame:
    """[R4] Readings over their series' limit; no state."""
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("event_type")]
    return events.withColumn("threshold", limit).where("value > threshold")


def rise_rate(events: DataFrame, key: str, size: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """[R4] Rise from the first to the last value of each sliding window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), key).agg((F.max_by("value", "ts") - F.min_by("value", "ts")).alias("rise"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, F.bround("rise", 2).alias("rise"), "n")


def grounded_bits(events: DataFrame, bits: DataFrame) -> DataFrame:
    """[R5] (…, field, bit) of a stream joined with the bit dimension."""
    return ground_bits(events, bits, ["field", "bit"])


def _stateful(df: DataFrame) -> DataFrame:
    """df; bounded input too needs the coordinator of state stores, which the session's stream manager starts."""
    df.sparkSession.streams.active  # noqa: B018
    return df


CHANGES = ["session", "event_id", "severity", "change"]
#: Rows of one frame given out, and of one sorted run on disk.
CHUNK, RUN = 1 << 14, 1 << 18
_ROW = np.dtype([("none", "?"), ("event", "<i8"), ("code", "<i4")])


def _by_event(frames: Iterator[pd.DataFrame], run: int = RUN) -> Iterator[tuple]:
    """(event_id, severity) of frames in order of event_id, nulls last, ties as they arrived.

    Sorted runs of at most ``run`` rows go to a temporary file and are merged
    part by part, so a batch of any size takes the memory of a run.  Severities
    are numbers, so there may be many rows but few different ones.
    """
    codes: dict = {}
    sort = lambda a: a[np.lexsort((a["event"], a["none"]))]  # noqa: E731, stable
    held, n, ends = [], 0, [0]

    def rows(a):
        names = list(codes)
        for none, event, code in a.tolist():
            yield None if none else event, names[code]

    with tempfile.TemporaryFile() as file:
        for frame in frames:
            for at in range(0, len(frame), run):
                part = frame.iloc[at : at + run]
                a = np.empty(len(part), _ROW)
                a["none"] = part["event_id"].isna()
                a["event"] = np.where(a["none"], 0, part["event_id"]).astype("int64")
                a["code"] = [codes.setdefault(None if pd.isna(s) else s, len(codes)) for s in part["severity"]]
                if n + len(a) > run:
                    file.write(sort(np.concatenate(held)).tobytes())
                    ends.append(ends[-1] + n)
                    held, n = [], 0
                held.append(a)
                n += len(a)
        if not held:
            return
        last = sort(np.concatenate(held))
        if len(ends) == 1:
            yield from rows(last)
            return
        file.write(last.tobytes())
        ends.append(ends[-1] + n)
        del held, last
        # Of each run a part is read; what is up to the least end of a part that has more to come can go out.
        step = max(1, run // (len(ends) - 1))
        at, parts = ends[:-1], [np.empty(0, _ROW)] * (len(ends) - 1)
        while True:
            for i, p in enumerate(parts):
                if not len(p) and at[i] < ends[i + 1]:
                    m = min(step, ends[i + 1] - at[i])
                    file.seek(at[i] * _ROW.itemsize)
                    parts[i] = np.frombuffer(file.read(m * _ROW.itemsize), _ROW)
                    at[i] += m
            if not any(map(len, parts)):
                return
            # Ties: of the run with the least end all of the part goes, of later runs only what is before it.
            end, j = min(((bool(p["none"][-1]), int(p["event"][-1])), i) for i, p in enumerate(parts) if len(p))
            out = []
            for i, p in enumerate(parts):
                until = _upto(p, end, i <= j)
                out.append(p[:until])
                parts[i] = p[until:]
            yield from rows(sort(np.concatenate(out)))


def _upto(part: np.ndarray, end: tuple[bool, int], ties: bool) -> int:
    """Rows of a sorted part before ``end``, with or without those equal to it."""
    nulls = int(np.searchsorted(part["none"], True))
    if end[0]:
        return len(part) if ties else nulls
    return int(np.searchsorted(part["event"][:nulls], end[1], "right" if ties else "left"))


class Retention(StatefulProcessor):
    """[R1] The severity-ranked buffer of a session over all batches; a row for each event that is kept, and for each that goes later.

    The state holds what can still go, at most the quota, and the number of
    critical events, which never go.
    """

    def __init__(self, quota: int):
        self.quota = quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "event_id long, severity string")
        self.critical = handle.getValueState("critical", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        critical = self.critical.get()[0] if self.critical.exists() else 0
        buffer = RankedBuffer(self.quota - critical)
        for event, severity in self.held.get() if self.held.exists() else []:
            buffer.put((event, severity), severity)
        out = []
        for event, severity in _by_event(rows):
            if severity == "critical":
                critical += 1
                buffer.quota -= 1
                out.append((key[0], event, severity, "kept"))
            else:
                entered, gone = buffer.offer((event, severity), severity or "")
                if gone is not None:
                    out.append((key[0], *gone, "evicted"))
                if entered:
                    out.append((key[0], event, severity, "kept"))
            if len(out) >= CHUNK:
                yield pd.DataFrame(out, columns=CHANGES)
                out = []
        if kept := buffer.kept():
            self.held.put(kept)
        else:
            self.held.clear()
        self.critical.update((critical,))
        yield pd.DataFrame(out, columns=CHANGES)

    def close(self) -> None:
        pass


def retain_stream(events: DataFrame, quota: int) -> DataFrame:
    """[R1] events (session, event_id, severity) -> changes (session, event_id, severity, change); needs the RocksDB state store."""
    return _stateful(events).groupBy("session").transformWithStateInPandas(Retention(quota), "session string, event_id long, severity string, change string", "Append", "None")


class FirstN(StatefulProcessor):
    """[R2] The first n rows of each key over all batches."""

    def __init__(self, n: int, columns: list[str]):
        self.n, self.columns = n, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues):
        seen = self.seen.get()[0] if self.seen.exists() else 0
        for pdf in rows:
            take = pdf.head(max(0, self.n - seen))
            seen += len(take)
            yield take[self.columns]
        self.seen.update((seen,))

    def close(self) -> None:
        pass


def first_n_stream(events: DataFrame, key: str, n: int) -> DataFrame:
    """[R2]"""
    return _stateful(events).groupBy(key).transformWithStateInPandas(FirstN(n, events.columns), events.schema, "Append", "None")


class Arbitration:
    """[R6] Input sources with priority and time to live; of the live ones the highest priority wins, then the first name."""

    def __init__(self, live: dict[str, tuple[int, int]] | None = None, winner: str | None = None):
        self.live, self.winner = live or {}, winner

    def _change(self, ms: int) -> list[tuple[int, str | None]]:
        best = min(self.live, key=lambda s: (-self.live[s][0], s), default=None)
        if best == self.winner:
            return []
        self.winner = best
        return [(ms, best)]

    def expire(self, upto: int) -> list[tuple[int, str | None]]:
        """Changes of the winner by sources whose time ended before ``upto``, each at the moment after its end."""
        out = []
        while ended := [(until, s) for s, (_, until) in self.live.items() if until < upto]:
            until = min(ended)[0]
            for _, source in [e for e in ended if e[0] == until]:
                del self.live[source]
            out += self._change(until + 1)
        return out

    def seen(self, source: str, priority: int, ms: int, timeout_ms: int) -> list[tuple[int, str | None]]:
        out = self.expire(ms)
        self.live[source] = (priority, max(ms + timeout_ms, self.live.get(source, (0, 0))[1]))
        return out + self._change(ms)


class Arbiter(StatefulProcessor):
    """[R6] :class:`Arbitration` per robot, a row per change; a timer ends a source that goes silent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getMapState("active", "source string", "priority long, until long")
        self.winner = handle.getValueState("winner", "source string")

    def _load(self) -> Arbitration:
        return Arbitration({s[0]: (p[0], p[1]) for s, p in self.active.iterator()}, self.winner.get()[0] if self.winner.exists() else None)

    def _store(self, now: Arbitration, before: dict) -> None:
        for source in before.keys() - now.live.keys():
            self.active.removeKey((source,))
        for source, value in now.live.items():
            if before.get(source) != value:
                self.active.updateValue((source,), value)
                self.handle.registerTimer(value[1] + 2)
        self.winner.update((now.winner,))

    def handleInputRows(self, key, rows, timerValues):
        now, out = self._load(), []
        before = dict(now.live)
        for r in pd.concat(list(rows)).sort_values("ms", kind="stable").itertuples():
            out += now.seen(r.source, int(r.priority), int(r.ms), int(r.timeout_ms))
        self._store(now, before)
        yield pd.DataFrame([(key[0], *change) for change in out], columns=["robot_id", "ms", "winner"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = self._load()
        before = dict(now.live)
        out = now.expire(expiredTimerInfo.getExpiryTimeInMs())
        self._store(now, before)
        yield pd.DataFrame([(key[0], *change) for change in out], columns=["robot_id", "ms", "winner"])

    def close(self) -> None:
        pass


def arbitrate(activity: DataFrame, late: str = "1 second") -> DataFrame:
    """[R6] activity (robot_id, source, priority, timeout_ms, ms) -> changes of the winning source, null when none is left."""
    timed = activity.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", late)
    return _stateful(timed).groupBy("robot_id").transformWithStateInPandas(Arbiter(), "robot_id string, ms long, winner string", "Append", "EventTime")


def episode_reward(steps: DataFrame) -> DataFrame:
    """[R7] steps (episode, t, reward, violated) -> return and length of each episode up to its first violation."""
    cut = steps.where("violated").groupBy("episode").agg(F.min("t").alias("cut"))
    alive = steps.join(cut, "episode", "left").where("cut is null or t < cut")
    return alive.groupBy("episode").agg(F.sum("reward").alias("reward"), F.count("*").alias("steps"))


def illegal_transitions(modes: DataFrame, allowed: DataFrame, key: str, order: str) -> DataFrame:
    """[R8] Successive modes of a key that no allowed transition joins; staying is no transition."""
    from pyspark.sql import Window

    before = F.lag("mode").over(Window.partitionBy(key).orderBy(order))
    moves = modes.withColumn("before", before).where("before is not null and before <> mode")
    known = allowed.select(F.col("mode").alias("before"), F.col("next").alias("mode"))
    return moves.join(small(known.distinct()), ["before", "mode"], "left_anti")
