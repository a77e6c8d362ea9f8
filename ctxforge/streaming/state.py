"""State by key over event time: sessions, bounded history, expiring entries, savings credited to sessions.

Rows of a key wait in a list until the watermark has passed them and then take effect in order of time, so what becomes of them does not
depend on how they were dealt to batches, as long as they are not later than the watermark allows. Besides what is final,
sessions report the present view after every batch, with waiting rows counted in."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Idle time after which a session is dropped, life of an entry, and records that a session remembers.
IDLE_MS = 48 * 3600 * 1000
LIFE_MS = 300_000
HISTORY = 10_000
#: Buckets of session ids; each is state of its own, read and written as a whole.
BUCKETS = 512

SESSION_ROW = "session_id long, started_at timestamp, last_activity timestamp, saved long, requests long, active boolean, final boolean"
HISTORY_ROW = "session_id long, remembered long, saved long, oldest timestamp, newest timestamp"
ENTRY_ROW = "key string, value string, set_at timestamp, live boolean"
CREDIT_ROW = "project_id long, session_id long, saved long, savings long, last_credit timestamp"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Start queries with state by key inside: they need a store on disk."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _micros(times: pd.Series) -> list[int]:
    return (times.astype("datetime64[us]").astype("int64")).tolist()


def _frame(schema: str, rows: list[tuple]) -> pd.DataFrame:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    frame = pd.DataFrame(rows, columns=list(names), dtype=object)
    for name, kind in zip(names, kinds):
        if kind == "timestamp":
            frame[name] = pd.to_datetime(frame[name].astype("int64"), unit="us")
        elif kind != "string":
            frame[name] = frame[name].astype("Int64" if kind == "long" else "bool")
    return frame


class _InOrder(StatefulProcessor):
    """Subclasses: WAITING, the schema of what a row leaves behind, with its time (microseconds) first; OUT, the schema of what is given;
    taken(rows), tuples of WAITING; advance(key, rows, watermark), which takes rows in order of time and returns
    (rows that still wait, rows to give, when to look again, in milliseconds)."""

    WAITING = OUT = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._go(key, [t for part in rows for t in self.taken(part)], timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go(key, [], timerValues)

    def _go(self, key: tuple, new: list[tuple], timers) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        left, out, due = self.advance(key[0], sorted(held + new), timers.getCurrentWatermarkInMs(), bool(new))
        if left != held:
            self.waiting.put(left) if left else self.waiting.clear()
        set_ = set(self.handle.listTimers())
        for t in set_ - set(due):
            self.handle.deleteTimer(t)
        for t in set(due) - set_:
            self.handle.registerTimer(t)
        if out:
            yield _frame(self.OUT, out)

    def close(self) -> None:
        pass


class _Sessions(StatefulProcessor):
    """The sessions of a bucket of ids. What a bucket holds, of each id the session and the rows that wait, is one value and has one timer,
    for the id that is to be looked at first: a call costs a few requests to the store, however many ids it is for."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "due long, sessions string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict = {}
        for part in rows:
            taken = zip(_micros(part["ts"]), part["action"].fillna("").tolist(), part["saved"].fillna(0).astype("int64").tolist())
            for session, row in zip(part["session_id"].tolist(), taken):
                new.setdefault(None if session is None else int(session), []).append(row)
        yield from self._go(new, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go({}, timerValues)

    def _go(self, new: dict, timers) -> Iterator[pd.DataFrame]:
        before, text = tuple(self.held.get()) if self.held.exists() else (None, "[]")
        known = {session: (due, held and tuple(held), rows) for session, due, held, rows in json.loads(text)}
        watermark, out = timers.getCurrentWatermarkInMs(), []
        for session in {s for s, (due, _, _) in known.items() if due <= watermark} | new.keys():
            _, held, rows = known.pop(session, (0, None, []))
            rows = sorted([*map(tuple, rows), *new.get(session, [])])
            held, left, some, due = self.advance(session, held, rows, watermark, session in new)
            out += some
            if due:
                known[session] = due, held, left
        due = min((d for d, _, _ in known.values()), default=None)
        if known:
            self.held.update((due, json.dumps([(s, *x) for s, x in known.items()], separators=(",", ":"))))
        elif before is not None:
            self.held.clear()
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        if out:
            yield _frame(SESSION_ROW, out)

    def _step(self, held: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        """(session held after the row, session that ended before or with it)."""
        ts, action, saved = row
        ended = None
        if held and ts - held[1] > self.idle * 1000:
            held, ended = None, held
        if action == "detach":
            return None, held or ended
        if action == "reset" or not held:
            held = (ts, ts, 0, 0)
        return (held if action == "reset" else (held[0], ts, held[2] + saved, held[3] + 1)), ended

    def advance(self, session: int | None, held: tuple | None, rows: list[tuple], watermark: int, fresh: bool):
        """(session held, rows that still wait, rows to give, when to look again, in milliseconds, or none)."""
        n = next((i for i, r in enumerate(rows) if r[0] // 1000 >= watermark), len(rows))
        final, left = [], rows[n:]
        for row in rows[:n]:
            held, ended = self._step(held, row)
            final += [ended] if ended else []
        if held and held[1] // 1000 + self.idle < watermark:
            held, final = None, [*final, held]
        out = [(session, *s, False, True) for s in final]
        if fresh or final:
            now, last = held, None
            for row in left:
                now, ended = self._step(now, row)
                last = ended or last
            view = now or last or (final[-1] if final else None)
            out += [(session, *view, bool(now), False)] if view else []
        due = ([left[0][0] // 1000 + 1] if left else []) + ([held[1] // 1000 + self.idle + 1] if held else [])
        return held, left, out, min(due, default=None)

    def close(self) -> None:
        pass


def track_sessions(requests: DataFrame, idle_ms: int = IDLE_MS, late: str = "2 hours", buckets: int = BUCKETS) -> DataFrame:
    """Sessions by id: the first row attaches one, later ones renew it and add their savings; with a column action, "reset" starts its
    counts anew and "detach" ends it. A row that comes after more than the idle time finds the session dropped and starts another;
    one is dropped without a row once the watermark has passed its idle time. Rows given with final are sessions that ended, each
    once; the others are the present view of an id, of which the last one counts. Ids are dealt to buckets, whose number a stream keeps;
    more of them suit more ids. Output mode: update."""
    action = F.col("action") if "action" in requests.columns else F.lit(None).cast("string")
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket")
    # As text, since a column of numbers with nulls reaches pandas as doubles.
    session = F.col("session_id").cast("string").alias("session_id")
    timed = requests.select(bucket, session, "ts", "saved", action.alias("action")).withWatermark("ts", late)
    return timed.groupBy("bucket").transformWithStateInPandas(_Sessions(idle_ms), SESSION_ROW, "Update", "EventTime")


class _History(StatefulProcessor):
    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "ts long, event_id long, saved long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted(t for part in rows for t in zip(_micros(part["ts"]), part["event_id"].tolist(), part["saved"].tolist()))
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        late = bool(held) and new[0] < held[-1]
        kept = (sorted(held + new) if late else held + new)[-self.keep :]
        # Only appended to while there is room and nothing came late.
        self.held.appendList(new) if not late and len(held) + len(new) <= self.keep else self.held.put(kept)
        yield _frame(HISTORY_ROW, [(key[0], len(kept), sum(r[2] for r in kept), kept[0][0], kept[-1][0])])

    def close(self) -> None:
        pass


def bounded_history(requests: DataFrame, keep: int = HISTORY) -> DataFrame:
    """What each session still remembers after every batch, its last records by time and event: (session_id, remembered, saved, oldest,
    newest). Output mode: update."""
    rows = requests.select("session_id", "ts", "event_id", "saved")
    return rows.groupBy("session_id").transformWithStateInPandas(_History(keep), HISTORY_ROW, "Update", "None")


class _Entries(_InOrder):
    WAITING, OUT = "ts long, value string", ENTRY_ROW

    def __init__(self, life_ms: int):
        self.life = life_ms

    def taken(self, rows: pd.DataFrame) -> list[tuple]:
        return list(zip(_micros(rows["ts"]), rows["value"].tolist()))

    def advance(self, key: str, rows: list[tuple], watermark: int, fresh: bool):
        """Only the last value of a key waits: for its own end."""
        ts, value = rows[-1]
        if ts // 1000 + self.life < watermark:
            return [], [(key, value, ts, False)], []
        return rows[-1:], [(key, value, ts, True)] if fresh else [], [ts // 1000 + self.life + 1]

    def _go(self, key, new, timers):
        if new or self.waiting.exists():
            yield from super()._go(key, new, timers)


def expiring_entries(entries: DataFrame, life_ms: int = LIFE_MS, late: str = "2 hours") -> DataFrame:
    """A cache over a stream of entries (key, value, ts): (key, value, set_at, live) when a key is set, and once more, not live, when the
    watermark has passed its life. The last value by time counts. Output mode: update."""
    rows = entries.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "ts").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Entries(life_ms), ENTRY_ROW, "Update", "EventTime")


class _Credits(_InOrder):
    WAITING, OUT = "ts long, kind long, session_id long, saved long", CREDIT_ROW

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sessions = handle.getMapState("sessions", "session_id long", "last long")

    def taken(self, rows: pd.DataFrame) -> list[tuple]:
        return list(zip(_micros(rows["ts"]), *(rows[c].fillna(-1 if c == "session_id" else 0).astype("int64").tolist() for c in ("kind", "session_id", "saved"))))

    def advance(self, key: int, rows: list[tuple], watermark: int, fresh: bool):
        n = next((i for i, r in enumerate(rows) if r[0] // 1000 >= watermark), len(rows))
        left = rows[n:]
        due = [left[0][0] // 1000 + 1] if left else []
        if not n:
            return left, [], due
        before = {k[0]: v[0] for k, v in self.sessions.iterator()} if self.sessions.exists() else {}
        held, credits = dict(before), {}
        for ts, kind, session, saved in rows[:n]:
            if kind == 0:
                held[session] = ts
            elif kind == 2:
                held.pop(session, None)
            elif saved > 0:
                last, latest = max(((t, s) for s, t in held.items()), default=(0, None))
                if latest is not None and ts - last > self.idle * 1000:
                    held, latest = {}, None  # all others are idle for longer
                if latest is not None:
                    held[latest] = ts
                total, count, _ = credits.get(latest, (0, 0, 0))
                credits[latest] = (total + saved, count + 1, ts)
        # What has been idle for too long by the last row is of no more use.
        held = {s: t for s, t in held.items() if rows[n - 1][0] - t <= self.idle * 1000}
        for s in before.keys() - held.keys():
            self.sessions.removeKey((s,))
        for s, t in held.items():
            if before.get(s) != t:
                self.sessions.updateValue((s,), (t,))
        return left, [(key, s, *c) for s, c in credits.items()], due


def credit_savings(activity: DataFrame, savings: DataFrame, idle_ms: int = IDLE_MS, late: str = "2 hours") -> DataFrame:
    """Two streams, activity (project_id, session_id, ts; with a column action, "detach" ends a session) and savings (project_id, saved,
    ts): each saving of something goes to the session of its project that was active last, by then and within the idle time, and renews
    it; without one it counts for the project alone (session_id null). Gives increments (project_id, session_id, saved, savings,
    last_credit), each once, as the watermark passes. Of rows of the same time activity comes first. Output mode: update."""
    ended = F.col("action") == "detach" if "action" in activity.columns else F.lit(False)
    acts = activity.select("project_id", "ts", F.when(ended, 2).otherwise(0).cast("long").alias("kind"), "session_id", F.lit(0).cast("long").alias("saved")).withWatermark("ts", late)
    adds = savings.select("project_id", "ts", F.lit(1).cast("long").alias("kind"), F.lit(None).cast("long").alias("session_id"), F.col("saved").cast("long").alias("saved")).withWatermark("ts", late)
    return acts.unionByName(adds).groupBy("project_id").transformWithStateInPandas(_Credits(idle_ms), CREDIT_ROW, "Update", "EventTime")
