"""Streams in several batches: late rows, timeouts, resets, detached sessions, bounded history and upserts."""

import json
import os

import pytest

from ctxforge.operators import usage
from ctxforge.plans.inputs import derived
from ctxforge.sources import keyed
from ctxforge.sources.events import ingest_requests
from ctxforge.sources.scan import read_file
from ctxforge.streaming import rollups
from ctxforge.streaming import state as S
from ctxforge.streaming import usage as W

SCHEMA = "session_id long, event_id long, tool string, ts timestamp, original long, saved long, action string"


def day(n, hour=0):
    return f"2024-01-{n:02d}T{hour:02d}:00:00.000Z"


@pytest.fixture()
def stream(spark, tmp_path):
    """run(batches, build, mode): a batch's rows are one file, read in order, one a batch."""
    runs = []

    def run(batches, build, mode="update", sink=None):
        own = tmp_path / f"run{len(runs)}"
        runs.append(own)
        folder = own / "in"
        folder.mkdir(parents=True)
        for i, rows in enumerate(batches):
            file = folder / f"{i:03d}.json"
            file.write_text("\n".join(json.dumps({"original": 10, "tool": "t", "event_id": 0, "saved": 0, **r}) for r in rows))
            os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
        found, seen = build(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))), []

        def keep(batch, batch_id):
            seen.append([r.asDict() for r in batch.collect()])
            if sink:
                sink(batch, batch_id)

        with S.state_store(spark):
            found.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(own / "check")).trigger(availableNow=True).start().awaitTermination()
        return seen

    return run


def present(rows):
    """Of each session what ended for good, in order, and the last view."""
    out = {}
    for r in rows:
        ended, view = out.setdefault(r["session_id"], ([], None))
        row = (r["started_at"].day, r["saved"], r["requests"])
        out[r["session_id"]] = (ended + [row], view) if r["final"] else (ended, (*row, r["active"]))
    return {k: (sorted(e), v) for k, (e, v) in out.items()}


ACTIONS = [
    {"session_id": 1, "ts": day(1), "saved": 5}, {"session_id": 2, "ts": day(1), "saved": 1}, {"session_id": 3, "ts": day(1), "saved": 9}, {"session_id": 1, "ts": day(1, 5), "saved": 7},
    {"session_id": 2, "ts": day(1, 6), "saved": 0, "action": "reset"}, {"session_id": 3, "ts": day(1, 7), "saved": 0, "action": "detach"}, {"session_id": 2, "ts": day(2), "saved": 4}, {"session_id": 1, "ts": day(5), "saved": 2},
    {"session_id": 2, "ts": day(9), "saved": 2}, {"session_id": 4, "ts": day(9, 1), "saved": 3}, {"session_id": 2, "ts": day(9, 2), "saved": 2}, {"session_id": 5, "ts": day(9, 3), "saved": 1}, {"session_id": 5, "ts": day(9, 4), "saved": 0, "action": "detach"},
]


@pytest.mark.parametrize("cuts", [(13,), (1, 13), (4, 8, 13), (2, 5, 6, 7, 9, 11, 13)])
@pytest.mark.parametrize("late", [False, True])
def test_sessions_do_not_depend_on_batches(stream, cuts, late):
    """One batch, several, and rows that come late within the bound: a gap of over 48 hours begins another session."""
    rows = list(ACTIONS)
    if late:  # an hour behind the row after it
        for i in (8, 10):
            rows[i], rows[i + 1] = rows[i + 1], rows[i]
    seen = stream([rows[a:b] for a, b in zip((0, *cuts), cuts)], S.track_sessions)
    assert present([r for batch in seen for r in batch]) == {
        1: ([(1, 12, 2), (5, 2, 1)], (5, 2, 1, False)), 2: ([(1, 4, 1)], (9, 4, 2, True)), 3: ([(1, 9, 1)], (1, 9, 1, False)), 4: ([], (9, 3, 1, True)), 5: ([], (9, 1, 1, False)),
    }


def test_idle_time_counts_between_rows(stream):
    """Rows on three days of one session with 96 hours between them, dealt together with another's."""
    rows = [{"session_id": 1, "ts": day(d), "saved": d} for d in (1, 5, 9)]
    other = [{"session_id": 2, "ts": day(d), "saved": 1} for d in range(1, 10)]
    for batches in ([rows + other], [[rows[0]], other[:4], [rows[1]], other[4:8], [rows[2], other[8]]]):
        seen = present([r for batch in stream(batches, S.track_sessions) for r in batch])
        assert seen[1] == ([(1, 1, 1), (5, 5, 1)], (9, 9, 1, True)) and seen[2] == ([], (1, 9, 9, True))


def test_entries_expire(stream):
    batches = [
        [{"session_id": 1, "ts": day(1), "tool": "a"}, {"session_id": 2, "ts": day(1), "tool": "b"}], [{"session_id": 1, "ts": day(1, 1), "tool": "c"}, {"session_id": 1, "ts": day(1), "tool": "old"}],
        [{"session_id": 3, "ts": day(1, 9), "tool": "d"}],
    ]
    entries = lambda r: S.expiring_entries(r.select(r.session_id.alias("key"), r.tool.alias("value"), "ts"), 6 * 3600 * 1000 + 1800 * 1000)
    seen = [(r["key"], r["value"], r["live"]) for batch in stream(batches, entries) for r in batch]
    assert sorted(seen[:2]) == [("1", "a", True), ("2", "b", True)] and seen[2:] == [("1", "c", True), ("3", "d", True), ("2", "b", False)]


def test_savings_go_to_the_session_active_last(stream):
    """Project 1 has sessions 10 and 11; a saving within 48 hours of the last activity or saving renews the session."""
    rows = [
        ("act", 10, day(1), 0), ("save", 1, day(1, 1), 5), ("act", 11, day(1, 2), 0), ("save", 1, day(1, 3), 7), ("save", 1, day(3), 1), ("save", 1, day(4, 12), 2), ("save", 1, day(7), 4), ("act", 10, day(7, 5), 0),
        ("save", 1, day(7, 6), 8), ("detach", 10, day(7, 7), 0), ("save", 1, day(7, 8), 16), ("save", 1, day(9), 100), ("act", 12, day(9, 1), 0),
    ]
    made = [{"session_id": s if kind != "save" else None, "ts": ts, "saved": n, "action": kind, "tool": "x"} for kind, s, ts, n in rows]
    build = lambda r: S.credit_savings(r.where("action <> 'save'").selectExpr("1L AS project_id", "session_id", "ts", "action"), r.where("action = 'save'").selectExpr("1L AS project_id", "saved", "ts"))
    for cuts in ((13,), (3, 5, 13), tuple(range(1, 14))):
        sums = {}
        for batch in stream([made[a:b] for a, b in zip((0, *cuts), cuts)], build):
            for r in batch:
                sums[r["session_id"]] = sums.get(r["session_id"], 0) + r["saved"]
        assert sums == {10: 5 + 8, 11: 7 + 1 + 2, None: 4 + 16}  # the last rows have not passed the watermark


def test_late_rows_are_dropped(stream):
    batches = [
        [{"session_id": 1, "ts": day(1, 1), "saved": 1}], [{"session_id": 1, "ts": day(2, 1), "saved": 2}],
        [{"session_id": 1, "ts": day(2, 1), "saved": 3}], [{"session_id": 1, "ts": day(1, 1), "saved": 50}, {"session_id": 1, "ts": day(2, 1), "saved": 1}], [{"session_id": 1, "ts": day(5), "saved": 8}],
    ]
    rows = [r for batch in stream(batches, W.tumbling, "append") for r in batch]
    assert {(r["start"].day, r["saved"], r["requests"]) for r in rows} == {(1, 1, 1), (2, 6, 3)}


def test_history_is_bounded(stream):
    batches = [[{"session_id": 1, "ts": day(1 + b, h), "saved": 10 * b + h} for h in range(3)] for b in range(3)]
    seen = stream(batches, lambda r: S.bounded_history(r, 4))
    assert [[(r["remembered"], r["saved"], r["newest"].day) for r in batch] for batch in seen if batch] == [[(3, 3, 1)], [(4, 2 + 33, 2)], [(4, 12 + 63, 3)]]


def test_table_by_key_rewrites_what_a_batch_touches(spark, tmp_path):
    path = str(tmp_path / "table")
    write = keyed.merge_into(path, ["k"], keyed.latest(["k"], ["t"]), buckets=8, keep=2)
    frame = lambda rows: spark.createDataFrame(rows, "k long, t long, v string")
    write(frame([(k, 1, "a") for k in range(100)]), 0)
    parts = lambda v: {p.name for p in (tmp_path / "table/data" / v).glob("kept_in=*")}
    assert len(parts("v0")) == 8
    write(frame([(5, 2, "b"), (5, 0, "old"), (200, 1, "c")]), 1)
    assert 1 <= len(parts("v1")) <= 2  # buckets of keys 5 and 200 only
    before = sorted((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "table").rglob("*") if p.is_file())
    write(frame([(5, 9, "again")]), 1)  # a batch that is run again
    assert before == sorted((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "table").rglob("*") if p.is_file())
    rows = {r["k"]: (r["t"], r["v"]) for r in keyed.read_table(spark, path).collect()}
    assert rows == {k: (1, "a") for k in range(100)} | {5: (2, "b"), 200: (1, "c")}
    assert {r["k"] for r in keyed.read_table(spark, path, 0).collect()} == set(range(100))
    (tmp_path / "table/data/v2/kept_in=1").mkdir(parents=True)  # left by a run that was stopped
    for v in (2, 3, 4):
        write(frame([(k, v + 1, "d") for k in range(100)]), v)
    assert {r["v"] for r in keyed.read_table(spark, path).where("k < 100").collect()} == {"d"}
    assert sorted(p.name for p in (tmp_path / "table/manifests").glob("*.json")) == ["3.json", "4.json"]
    held = [p for v in (tmp_path / "table/data").iterdir() for p in v.glob("kept_in=*")]
    assert len(held) <= 8 + 8 + 1 and keyed.read_table(spark, str(tmp_path / "none")) is None


def test_empty_batches(spark, tmp_path):
    path = str(tmp_path / "table")
    write = keyed.merge_into(path, ["k"], keyed.sums(["k"], ["n"]), buckets=2)
    frame = lambda rows: spark.createDataFrame(rows, "k long, n long")
    for i, rows in enumerate(([], [(1, 2), (1, 3)], [], [(None, 4), (1, 1)])):
        write(frame(rows), i)
        assert keyed.read_table(spark, path).count() == (0, 1, 1, 2)[i]
    assert sorted(map(tuple, keyed.read_table(spark, path).collect()), key=repr) == [(1, 6), (None, 4)]


def test_reports_from_sums(spark, sf, tmp_path):
    """What a stream keeps gives the same totals as all requests do, and no old request is read for it."""
    from pyspark.sql import functions as F

    requests = derived(spark, sf, "requests").withColumn("ts", F.col("ts").cast("timestamp"))
    write = rollups.keep_usage(str(tmp_path), buckets=4, recent=3)
    for i in range(3):
        write(requests.where(F.col("event_id") % 3 == i), i)
    sums = keyed.read_table(spark, f"{tmp_path}/sums")
    whole = usage.session_stats(requests).drop("started_at")
    assert sorted(map(tuple, rollups.session_stats(sums).select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert sums.count() < requests.count() and all("/sums/data/" in f for f in sums.inputFiles())
    last = [r["event_id"] for r in keyed.read_table(spark, f"{tmp_path}/recent").orderBy("ts").collect()]
    assert last == [r["event_id"] for r in requests.orderBy(F.desc("ts")).limit(3).collect()][::-1]


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    row = {"session_id": 1, "tool": "t", "ts": day(1), "original": 10, "saved": 5}
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(row | {"event_id": i}) + "\n")
        ingest_requests(spark, source, target, state).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(target).collect()) == [0, 1, 2]
    (tmp_path / "one.py").write_text("import os\nx = 1\n")
    assert read_file(spark, str(tmp_path / "one.py")).first()["content"] == "import os\nx = 1\n"


def test_sessions_share_the_state_of_a_bucket(stream):
    """Forty ids and one that is null in one bucket or three: as many frames of rows as buckets, the same sessions."""
    ids = [*range(1, 39), 1 << 60, (1 << 60) + 1, None]
    rows = [{"session_id": i, "ts": day(d, (i or 0) % 5), "saved": d} for d in (1, 2, 6, 9) for i in ids]
    for buckets in (1, 3):
        seen = stream([rows[:41], rows[41:123], rows[123:]], lambda r: S.track_sessions(r, buckets=buckets))  # noqa: B023
        assert present([r for batch in seen for r in batch]) == {i: ([(1, 3, 2), (6, 6, 1)], (9, 9, 1, True)) for i in ids}
