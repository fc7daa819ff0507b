"""Stateful streams over files that arrive in batches, against plain folds."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.model import SEVERITY_RANK
from graphloom.operators import ingest
from graphloom.plans.queries import QUERIES
from graphloom.streaming import telemetry as T


@pytest.fixture
def streaming(spark):
    keys = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def run(spark, tmp_path, batches, schema, plan):
    """Rows of a plan over one file per batch, in the order of the batches they came in."""
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    import os

    for i, batch in enumerate(batches):
        at = folder / f"{i:03}.json"
        at.write_text("\n".join(json.dumps(r) for r in batch))
        os.utime(at, (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = plan(source).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return [r.asDict() for r in spark.read.parquet(str(out)).collect()]


def plain_retention(severities, quota):
    """The buffer written out as a scan of what is kept."""
    kept = []
    for i, s in enumerate(severities):
        mine = SEVERITY_RANK.get(s, 0)
        if s == "critical" or len(kept) < quota:
            kept.append(i)
            continue
        ranks = [SEVERITY_RANK.get(severities[j], 0) for j in kept]
        lower = [r for r in ranks if r < mine]
        if not lower or not mine:
            continue
        low = min(lower)
        if low == 0 and 1 in ranks and mine > 1 and ranks.index(1) < ranks.index(0):
            low = 1
        kept.pop(ranks.index(low))
        kept.append(i)
    return kept


@pytest.mark.parametrize("quota", [0, 1, 3, 10])
def test_buffer_matches_a_scan(quota):
    r = random.Random(quota)
    for _ in range(200):
        severities = [r.choice([*SEVERITY_RANK, "odd"]) for _ in range(r.randint(0, 40))]
        assert ingest.fold_retention(severities, quota) == plain_retention(severities, quota)


def test_retain_exact_query(spark):
    sf = "/root/testdata/sf0.001"
    from graphloom.plans import projection as P

    users = {}
    for e in sorted(P.session_events(spark, sf).select("user_id", "event_id", "severity").collect(), key=lambda e: e["event_id"]):
        users.setdefault(e["user_id"], []).append(e)
    want = Counter(e["event_id"] for es in users.values() for e in [es[i] for i in plain_retention([e["severity"] for e in es], 20)])
    assert Counter(r["event_id"] for r in QUERIES["w_retain_exact"](spark, sf).collect()) == want


def test_retention_emits_changes(streaming, tmp_path):
    r = random.Random(1)
    events = [{"session": f"s{i % 2}", "event_id": i, "severity": r.choice(list(SEVERITY_RANK))} for i in range(120)]
    batches = [events[i : i + 20] for i in range(0, 120, 20)]
    got = run(streaming, tmp_path, batches, "session string, event_id long, severity string", lambda s: T.retain_stream(s, 6))
    for session in ("s0", "s1"):
        mine = [e for e in events if e["session"] == session]
        kept = {x["event_id"] for x in got if x["session"] == session and x["change"] == "kept"}
        gone = [x["event_id"] for x in got if x["session"] == session and x["change"] == "evicted"]
        assert len(gone) == len(set(gone)) and set(gone) <= kept
        assert kept - set(gone) == {mine[i]["event_id"] for i in plain_retention([e["severity"] for e in mine], 6)}


def test_first_n(streaming, tmp_path):
    batches = [[{"k": f"k{(b + i) % 3}", "v": 10 * b + i} for i in range(10)] for b in range(4)]
    got = run(streaming, tmp_path, batches, "k string, v long", lambda s: T.first_n_stream(s, "k", 5))
    assert Counter(x["k"] for x in got) == {"k0": 5, "k1": 5, "k2": 5} and all(x["v"] < 20 for x in got)


def test_grounded_bits(streaming, tmp_path):
    bits = streaming.createDataFrame([("f", 1, "bit.one", "error")], "field string, bit int, ref string, severity string")
    batches = [[{"field": "f", "bit": 1}, {"field": "f", "bit": 2}], [{"field": "g", "bit": 1}]]
    got = run(streaming, tmp_path, batches, "field string, bit int", lambda s: T.grounded_bits(s, bits))
    assert sorted((x["field"], x["bit"], x["ontology_ref"] or "", x["severity"]) for x in got) == [("f", 1, "bit.one", "error"), ("f", 2, "", "unknown"), ("g", 1, "", "unknown")]


def test_windows_and_thresholds(streaming, tmp_path):
    at = lambda m: f"2024-01-01T00:{m:02}:00Z"
    batches = [[{"ts": at(m), "event_type": "a", "value": float(m)} for m in range(5)], [{"ts": at(30), "event_type": "a", "value": 1.0}], [{"ts": at(31), "event_type": "a", "value": 1.0}], [{"ts": at(1), "event_type": "a", "value": 100.0}, {"ts": at(59), "event_type": "a", "value": 9.0}]]
    got = run(streaming, tmp_path, batches, "ts timestamp, event_type string, value double", lambda s: T.window_counts(s, "10 minutes", "5 minutes"))
    assert sorted((x["n"], x["total"]) for x in got) == [(2, 2.0), (5, 10.0)]  # the late row dropped, the last window open
    limits = streaming.createDataFrame([("a", 2.0), ("b", 9.0)], "event_type string, value double")
    assert [r["value"] for r in T.thresholds(limits, {"a": 1.0, "b": 10.0}).collect()] == [2.0]


def plain_winners(rows, end):
    """The winner at every millisecond."""
    out, current = [], None
    for ms in range(end + 1):
        best = min(((-r["priority"], r["source"]) for r in rows if r["ms"] <= ms <= max(x["ms"] + x["timeout_ms"] for x in rows if x["source"] == r["source"] and x["ms"] <= ms)), default=(0, None))[1]
        if best != current:
            current = best
            out.append((ms, best))
    return out


ACTIVITY = [("app", 1, 100, 0), ("pad", 5, 50, 20), ("app", 1, 100, 60), ("pad", 5, 50, 90), ("app", 1, 100, 500)]


def test_arbitration_ends_silent_sources():
    now, out = T.Arbitration(), []
    rows = [dict(zip(("source", "priority", "timeout_ms", "ms"), r, strict=True)) for r in ACTIVITY]
    for r in rows:
        out += now.seen(r["source"], r["priority"], r["ms"], r["timeout_ms"])
    out += now.expire(1000)
    assert out == plain_winners(rows, 1000) == [(0, "app"), (20, "pad"), (71, "app"), (90, "pad"), (141, "app"), (161, None), (500, "app"), (601, None)]


def test_arbitration_timers(streaming, tmp_path):
    """The winner goes silent: later activity of another robot moves the watermark, and the timer fires."""
    base = 1_700_000_000_000
    rows = [{"robot_id": "r", "source": s, "priority": p, "timeout_ms": t, "ms": base + ms} for s, p, t, ms in ACTIVITY[:4]]
    other = [{"robot_id": "q", "source": "x", "priority": 1, "timeout_ms": 10, "ms": base + 100_000 * k} for k in (1, 2, 3)]
    got = run(streaming, tmp_path, [rows[:2], rows[2:], *[[o] for o in other]], "robot_id string, source string, priority long, timeout_ms long, ms long", lambda s: T.arbitrate(s, "0 seconds"))
    changes = sorted((x["ms"] - base, x["winner"]) for x in got if x["robot_id"] == "r")
    assert changes == [(0, "app"), (20, "pad"), (71, "app"), (90, "pad"), (141, "app"), (161, None)]
    assert (base + 100_011, None) in {(x["ms"], x["winner"]) for x in got if x["robot_id"] == "q"}


def test_streaming_gate(streaming, tmp_path):
    from pathlib import Path

    from graphloom.operators import gate
    from graphloom.sources import pack

    mini = pack.load(streaming, str(Path(__file__).parent / "packs" / "mini"))
    batches = [[{"robot_id": "mini", "action_id": "move_base", "p": '{"v":0.5}', "s": '{"mode":"WALK","battery":50}'}], [{"robot_id": "mini", "action_id": "fly", "p": "{}", "s": "{}"}]]

    def plan(s):
        calls = s.withColumns({"params": F.parse_json("p"), "state": F.parse_json("s")}).select("robot_id", "action_id", "params", "state")
        return gate.check(calls, mini).select("action_id", "ok")

    assert {x["action_id"]: x["ok"] for x in run(streaming, tmp_path, batches, "robot_id string, action_id string, p string, s string", plan)} == {"move_base": True, "fly": False}
