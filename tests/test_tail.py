"""Tails of growing and replaced files: stopped, resumed, bounded; keyed state with timers."""

import json
import os

import pytest

from palimpsest.streaming.tail import Tail, line_tail, read_on


def put(path, text, mode="a"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def test_stopped_and_resumed_over_growing_and_replaced_files(spark, tmp_path):
    log, base, offsets = f"{tmp_path}/log", f"{tmp_path}/base", f"{tmp_path}/offsets/consumer.json"

    def lines():
        found = read_on(line_tail(spark, log, offsets, maxBatchBytes=40, maxFileBytes=24), base)
        return sorted((r.file, r.generation, r.start, r.line) for r in found.collect())

    put(f"{log}/a.ndjson", "".join(f"a{i}\n" for i in range(30)) + "half")
    put(f"{log}/deep/b.ndjson", "ñandú\r\n\nlast\n")
    put(f"{log}/_hidden", "no\n")
    first = lines()
    assert [x[3] for x in first if x[0] == "a.ndjson"] and sorted(x[3] for x in first) == sorted([*(f"a{i}" for i in range(30)), "ñandú", "", "last"])
    assert len({(f, g, s) for f, g, s, _ in first}) == 33
    assert lines() == first  # nothing new, nothing twice
    put(f"{log}/a.ndjson", " a line\nnext")
    put(f"{log}/c.ndjson", "c0\n")
    second = lines()
    assert sorted(set(second) - set(first)) == [("a.ndjson", 0, sum(len(f"a{i}\n") for i in range(30)), "half a line"), ("c.ndjson", 0, 0, "c0")]
    assert len(second) == 35
    put(f"{log}/a.ndjson", "new file\n", "w")  # shorter
    put(f"{log}/c.ndjson", "d0\nd1\n", "w")  # longer, other first bytes
    third = lines()
    assert sorted(set(third) - set(second)) == [("a.ndjson", 1, 0, "new file"), ("c.ndjson", 1, 0, "d0"), ("c.ndjson", 1, 3, "d1")]
    assert len(third) == 38
    assert json.load(open(offsets))["c.ndjson"][:2] == [6, 1]


def test_batches_are_bounded(tmp_path):
    put(f"{tmp_path}/log/a", "x" * 9 + "\n" + "y" * 9 + "\n" + "z" * 99 + "\n")
    put(f"{tmp_path}/log/b", "b\n" * 50)
    tail = Tail({"path": f"{tmp_path}/log", "offsets": f"{tmp_path}/o/c", "maxfilebytes": "25", "maxbatchbytes": "60", "maxlinebytes": "200"})
    at = {}
    sizes = []
    while True:
        end = tail.latestOffset()
        if end == at:
            break
        parts = tail.partitions(at, end)
        sizes.append(sum(p.end - p.start for p in parts))
        assert all(b"\n" == open(f"{tmp_path}/log/{p.file}", "rb").read()[p.end - 1 : p.end] for p in parts)
        # a batch that failed is planned again between the same offsets
        assert [(p.file, p.start, p.end) for p in tail.partitions(at, end)] == [(p.file, p.start, p.end) for p in parts]
        at = end
    assert sum(sizes) == 220 and max(sizes) <= 125 and len(sizes) >= 4  # one line is longer than a stretch
    again = Tail({"path": f"{tmp_path}/log", "offsets": f"{tmp_path}/o/c"})
    assert again.latestOffset() == at
    tail.line_bytes = 50
    tail.planned = {}
    tail.file_bytes = 1000
    put(f"{tmp_path}/log/a", "w" * 70, "w")
    with pytest.raises(ValueError, match="over 50 bytes"):
        tail.latestOffset()


def batch_answer(rows, idle_ms, watermark):
    """Sessions (session, n, last ms) that have ended before the watermark."""
    found = []
    for s in {r[2] for r in rows}:
        times = sorted(r[1] for r in rows if r[2] == s)
        parts = [[times[0]]]
        for a, b in zip(times, times[1:]):
            if b - a > idle_ms:
                parts.append([])
            parts[-1].append(b)
        found += [(s, len(p), p[-1]) for p in parts if p[-1] + idle_ms < watermark]
    return sorted(found)


def test_triggers_over_shuffled_files_with_state_evicted(spark, tmp_path):
    from palimpsest.streaming.flows import run_to_end
    from palimpsest.streaming.triggers import session_triggers

    import random

    rng = random.Random(2)
    # (event, ms, session, kind): sessions rest for hours, files are shuffled by less than the watermark's delay
    rows, at = [], 0
    for i in range(400):
        at += rng.choice([1, 5, 20, 200]) * 60_000 if i % 20 else 9 * 3_600_000
        rows.append((i, at, rng.randint(0, 3), rng.choice(["click", "purchase"])))
    files = [rows[i : i + 20] for i in range(0, 400, 20)]
    for k in range(0, len(files) - 1, 2):
        files[k], files[k + 1] = files[k + 1], files[k]
    for k, part in enumerate(files):
        df = spark.createDataFrame(part, "event_id long, ms long, session_id long, kind string").selectExpr("event_id", "timestamp_millis(ms) ts", "session_id", "kind")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/f{k:03}")
    spread = max(max(r[1] for r in files[k + 1] + files[k]) - min(r[1] for r in files[k + 1] + files[k]) for k in range(0, len(files) - 1, 2))
    stream = spark.readStream.schema("event_id long, ts timestamp, session_id long, kind string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/f*")
    got = run_to_end(session_triggers(stream, f"{spread // 1000 + 1} seconds"), "append").collect()
    assert sorted(r.n for r in got if r.trigger == "decision_landed") == [r[0] for r in rows if r[3] == "purchase"]
    for s in range(4):
        assert sum(r.trigger == "topic_due" and r.session_id == s for r in got) == sum(r[2] == s for r in rows) // 8
    ended = sorted((r.session_id, r.n, r.at_ms) for r in got if r.trigger == "session_end")
    assert ended == batch_answer(rows, 1_800_000, at - (spread // 1000 + 1) * 1000)
    assert ended


def test_merged_nodes_over_batches(spark, tmp_path):
    from palimpsest.streaming.triggers import merged_nodes

    rows = [(k % 7 if k % 7 else None, f"p{k % 3}", k, float(k)) for k in range(200)]
    for f in range(10):
        spark.createDataFrame(rows[f::10], "node long, prop string, seq long, value double").coalesce(1).write.parquet(f"{tmp_path}/in/f{f}")
    stream = spark.readStream.schema("node long, prop string, seq long, value double").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/f*")
    want = {}
    for r in rows:
        want[r[0], r[1]] = r
    got = merged_nodes(stream, ["node", "prop"], "seq", buckets=5).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == set(want.values())


class _State:
    """Value and list state of one key, timers as a set, and how often each was asked."""

    def __init__(self):
        self.rows, self.timers, self.calls = {}, set(), 0

    def getValueState(self, name, schema):
        return _Held(self, name, None)

    def getListState(self, name, schema):
        return _Held(self, name, [])

    def registerTimer(self, t):
        self.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.calls += 1
        self.timers.remove(t)


class _Held:
    def __init__(self, of, name, empty):
        self.of, self.name, self.empty = of, name, empty

    def exists(self):
        self.of.calls += 1
        return self.name in self.of.rows

    def get(self):
        self.of.calls += 1
        return self.of.rows.get(self.name, self.empty)

    def put(self, rows):
        self.of.calls += 1
        self.of.rows[self.name] = list(rows)

    update = put

    def clear(self):
        self.of.calls += 1
        self.of.rows.pop(self.name, None)


def test_a_session_of_many_spans_is_one_timer():
    from types import SimpleNamespace

    import pandas as pd

    from palimpsest.streaming.triggers import SessionTriggers

    state, at = _State(), lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    p = SessionTriggers("purchase", due=8, idle_ms=10)
    p.init(state)
    rows = pd.DataFrame({"event_id": range(100), "kind": "click", "ms": [i * 100 for i in range(100)]})
    list(p.handleInputRows((1,), iter([rows]), at(0)))
    assert state.timers == {11}
    out, watermark = [], 5_000
    while state.timers and min(state.timers) <= watermark:
        t = min(state.timers)
        state.timers.remove(t)
        out += list(p.handleExpiredTimer((1,), at(watermark), SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)))
    found = pd.concat(out)
    assert len(out) == 1 and sorted(found.at_ms) == [i * 100 for i in range(50)]  # the span at 4900 is over, that at 5000 is not
    assert state.timers == {5_011} and state.calls < 20
