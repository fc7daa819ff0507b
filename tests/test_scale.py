"""Steps whose memory or time must not follow the input: sides of joins, the retention's cut, passes over documents, batches of a stream."""

import pytest
from pyspark.sql import functions as F

from graphloom.catalog import small
from graphloom.operators import ingest
from graphloom.plans import projection as P
from graphloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bits_are_broadcast_not_events(spark):
    """Rows of the program have no size for the optimiser, which took the events for the smaller side."""
    text = plan(QUERIES["a_nominal_bits"](spark, SF))
    assert "BuildRight" in text and "BuildLeft" not in text and "SortMergeJoin" not in text


def test_small_counts_rows_of_the_program_up_to_the_limit(spark):
    rows = spark.createDataFrame([(i,) for i in range(9)], "i long")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small(rows, 72)) and not hinted(small(rows, 71))
    assert not hinted(small(P.table(spark, SF, "events"), 10))


@pytest.mark.parametrize("quota", [0, 7, 60, 500])
def test_retention_sorts_no_whole_input(spark, monkeypatch, quota):
    """Each task holds the quota's rows; the cut by salts, for larger quotas, gives the same rows."""
    severity = F.element_at(F.array(*map(F.lit, ("error", "critical", "odd", "notice", "info"))), (F.col("id") * 7 % 5 + 1).cast("int"))
    events = spark.range(200).select("id", F.when(F.col("id") % 9 != 0, severity).alias("severity"))
    kept = ingest.retain_topk(events, quota, ["id"])
    assert "TakeOrderedAndProject" in plan(kept) or not 0 < quota < 200
    got = sorted(r["id"] for r in kept.collect())
    monkeypatch.setattr(ingest, "HEAP_ROWS", -1)
    assert got == sorted(r["id"] for r in ingest.retain_topk(events, quota, ["id"]).collect())


def test_walk_and_signals_read_documents_once(spark, tmp_path):
    """One pass for the entries and one for the fields, whatever the levels."""
    assert plan(QUERIES["a_field_counts"](spark, SF)).count("FileScan parquet") == 2
    payload = '{"a":1,"b":{"c":null,"d":[1],"gps":2},"e":[{"f":1}],"g":{},"h":null,"latitude":{"i":3}}'
    docs = spark.createDataFrame([("f", payload), ("g", "[1]"), ("h", "3"), ("i", None)], "file string, t string").select("file", F.parse_json("t").alias("payload"))
    got = ingest.signals(docs).select("file", "name", "field", F.to_json("value").alias("v")).collect()
    want = [("a", "a", "1"), ("b", "b", '{"c":null,"d":[1],"gps":2}'), ("c", "b.c", "null"), ("d", "b.d", "[1]"), ("e", "e", '[{"f":1}]'), ("g", "g", "{}"), ("h", "h", "null"), ("i", "latitude.i", "3")]
    assert sorted(map(tuple, got)) == [("f", *w) for w in want]
    walked = ingest.walk(docs, "payload", depth=2).where("file = 'f'").select("path", "key")
    paths = ["$.a", "$.b", "$.b.c", "$.b.d", "$.b.gps", "$.e", "$.e[0]", "$.g", "$.h", "$.latitude", "$.latitude.i"]
    assert sorted(map(tuple, walked.collect()), key=str) == sorted(((p, None if p.endswith("]") else p.split(".")[-1]) for p in paths), key=str)


class _State:
    """A state variable in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


class _Handle:
    getListState = getValueState = lambda self, *_: _State()


def test_retention_of_a_large_batch_takes_the_memory_of_a_run():
    import tracemalloc

    import pandas as pd

    from graphloom.streaming import telemetry

    n, size = 600_000, 10_000
    frames = (pd.DataFrame({"event_id": [(i * 7919) % n for i in range(at, at + size)], "severity": "critical"}) for at in range(0, n, size))
    keeper = telemetry.Retention(3)
    keeper.init(_Handle())
    tracemalloc.start()
    expected = 0
    for out in keeper.handleInputRows(("s",), frames, None):
        assert out["event_id"].tolist() == list(range(expected, expected + len(out)))
        expected += len(out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert expected == n and peak < 60 * 10**6


@pytest.mark.parametrize("run", [1, 3, 10, 1000])
def test_sorted_runs_keep_ties_and_nulls_in_order(run):
    import random

    import pandas as pd

    from graphloom.streaming import telemetry

    r = random.Random(run)
    rows = [(r.choice([None, *range(9), 2**62 + 1]), r.choice([None, "critical", f"s{i}"])) for i in range(100)]
    frames = [pd.DataFrame({"event_id": pd.Series([e for e, _ in rows[at : at + 8]], dtype="object"), "severity": [s for _, s in rows[at : at + 8]]}) for at in range(0, 100, 8)]
    assert list(telemetry._by_event(iter(frames), run)) == sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
