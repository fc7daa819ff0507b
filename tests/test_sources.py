"""Every reader and writer on files that the test makes."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

from graphloom import sinks
from graphloom.operators import audit, graph, rules
from graphloom.plans import projection as P
from graphloom.sources import imports, pack, session

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture(scope="module")
def bits(spark):
    return spark.createDataFrame([("pmu_bits", 1, "bit.hot", "critical"), ("pmu_bits", 0, "bit.ok", "nominal")], "name string, bit int, ref string, severity string")


@pytest.fixture
def folder(tmp_path):
    """A session with every format, a sliced log, a broken document of each kind and unsupported files."""
    for name in ("info", "log/deep", "bag", "elsewhere"):
        (tmp_path / name).mkdir(parents=True)
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8")
    put("info/state.yaml", "/bus/state: {stamp: {sec: 5, nanosec: 7}, pmu_bits: 7, motor_temp: 41.5, gps: 3, mode: WALK}\n---\n/bus/other: {speed: 2}\n")
    put("info/broken.yml", "a: [1\n")
    put("info/list.json", json.dumps([{"/bus/state": {"mode": "STAND"}}, {"std_msgs/msg/X": 1}]))
    put("info/broken.json", "{")
    put("bag/lines.jsonl", '{"/bus/line": {"voltage": 3}}\nnot json\n')
    put("log/run.log", "[2024-01-02 03:04:05] motor overcurrent\n\nwriteError quiet\nlink fault: code 7\r\nmode switch to WALK\n")
    put("log/deep/run.log_3", "Connection TIMEOUT to peer\n")
    put("log/cpu.atop", "CPU h 1 d t 10 100 8 5 6 0 0\nMEM h 1 d t 10 4096 1000 5 1\nRESET\n")
    put("log/core.bin", "x")
    put("bag/odd.bin", "x")
    put("elsewhere/x.log", "error: outside the session folders")
    (tmp_path / "log" / "bytes.txt").write_bytes(b"\xff broken bytes [error] here\n")
    return tmp_path


def test_session_run(spark, folder, bits):
    out = session.run(spark, str(folder), bits, quota=100)
    kinds = {r["kind"]: r["n"] for r in out["kinds"].collect()}
    assert kinds == {"log.protection_event": 1, "log.fault": 1, "log.mode_transition": 1, "log.communication_event": 1, "log.error": 1, "status_bit": 2, "mode_observed": 2}
    events = out["events"].collect()
    assert len(events) == 9 and {e["severity"] for e in events if e["kind"] == "status_bit"} == {"critical", "unknown"}
    assert {e["payload"]["line"] for e in events if e["source_file"] == "run.log"} == {"1", "4", "5"}
    assert [e["ts"] for e in events if e["kind"] == "log.protection_event"] == ["2024-01-02 03:04:05"]
    assert sorted(r["message"] for r in out["warnings"].collect()) == ["not valid JSON", "not valid YAML"]
    assert rows(out["skipped"]) == [(".bin", 2)]
    assert {r["directory"]: r["files"] for r in out["stats"].collect()} == {"info": 4, "log": 5, "bag": 2, "TOTAL": 11}
    assert sorted((r["series"], r["value"]) for r in out["scalars"].collect()) == [("/bus/line.voltage", 3.0), ("/bus/other.speed", 2.0), ("/bus/state.motor_temp", 41.5)]
    assert rows(out["topics"]) == [("/bus/line", 1), ("/bus/other", 1), ("/bus/state", 2)] and rows(out["msg_types"]) == [("std_msgs/msg/X", 1)]
    assert out["cpu"].count() == 1 and out["memory"].count() == 1
    kept = session.run(spark, str(folder), bits, quota=3)["events"].collect()
    assert len(kept) == 3 and sum(e["severity"] == "critical" for e in kept) == 2

    summary = json.loads(sinks.summary_document("r", str(folder), out).first()["summary"])
    assert (summary["schema_version"], summary["robot_id"], len(summary["events"]), len(summary["warnings"])) == ("0.2", "r", 9, 2)
    assert {s["series"]: s["samples_count"] for s in summary["scalars_timeseries"]}["/bus/state.motor_temp"] == 1
    sinks.session_summary(out["events"], out["scalars"], out["kinds"], str(folder / "out"))
    assert spark.read.parquet(str(folder / "out/events")).count() == 9 and spark.read.json(str(folder / "out/counts")).count() == 7
    sinks.stats_json(out["stats"], str(folder / "stats"))
    assert spark.read.json(str(folder / "stats")).count() == 4


def test_an_empty_session(spark, tmp_path, bits):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "empty.log").write_text("")
    out = session.run(spark, str(tmp_path), bits)
    assert out["events"].count() == 0 and out["kinds"].count() == 0 and out["warnings"].count() == 0


def test_log_lines_in_blocks(spark, tmp_path):
    text = [f"line {i}" if i % 5 else "" for i in range(1, 40_001)]
    (tmp_path / "a.log").write_text("\n".join(text))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert spark.read.text(str(tmp_path / "a.log")).rdd.getNumPartitions() > 1
        assert rows(session.log_lines(spark, str(tmp_path / "a.log")), "line") == [("a.log", i, t) for i, t in enumerate(text, 1) if t]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_messages(spark, tmp_path):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"i": {"j": 1}}}}}}}}}}
    lines = [{"topic": "/a/b", "msg_type": "m/msg/X", "log_time_ns": 5, "publish_time_ns": 6, "payload": {"l": list(range(50)), "d": deep}}, {"topic": "/a/c"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    got = session.message_lines(spark, str(tmp_path / "m.jsonl")).select("topic", "log_time_ns", F.to_json("payload").alias("p")).orderBy("topic").collect()
    assert [(r["topic"], r["log_time_ns"]) for r in got] == [("/a/b", 5), ("/a/c", None)]
    assert json.loads(got[0]["p"])["l"] == list(range(32)) and "<truncated>" in got[0]["p"]
    spark.dataSource.register(session.MessageSource)
    read = spark.read.format("robot_messages").option("path", str(tmp_path / "m.jsonl")).load()
    assert rows(read.select("topic", "msg_type", "publish_time_ns"), "topic") == [("/a/b", "m/msg/X", 6), ("/a/c", None, None)]

    class Bare:
        __slots__ = ("_x", "y")

    bare = Bare()
    bare._x, bare.y = b"abc", 1j
    assert session.flatten_message(bare) == {"x": {"length": 3}, "y": "1j"}


URDF = """<robot name="r"><link name="base"><inertial><mass value="2.5"/><origin xyz="0 0 1" rpy="0 0 0"/></inertial><visual><geometry><mesh filename="b.stl"/></geometry></visual></link><link name="arm"/><link name="cam"/><link name="w"/>
<joint name="j1" type="revolute"><parent link="base"/><child link="arm"/><origin xyz="0 1 2" rpy="0 0 0"/><axis xyz="0 1 0"/><limit lower="-1.23456" upper="2" velocity="3" effort="40"/></joint>
<joint name="j2" type="fixed"><parent link="arm"/><child link="cam"/></joint><joint name="j3" type="continuous"><parent link="arm"/><child link="w"/></joint></robot>"""


def test_urdf_merge_and_patch(spark, tmp_path):
    (tmp_path / "r.urdf").write_text(URDF)
    path = str(tmp_path / "r.urdf")
    links = {r["name_urdf"]: r for r in imports.urdf_links(spark, path).collect()}
    assert sorted(links) == ["arm", "base", "cam", "w"] and (links["base"]["mass"], links["base"]["mesh"], links["base"]["inertial_origin"], links["arm"]["mass"]) == (2.5, "b.stl", [0.0, 0.0, 1.0], None)
    revolute, fixed, others = imports.urdf_joints(spark, path)
    j = revolute.first()
    assert (j["urdf_name"], j["parent"], j["child"], j["dof_axis"], j["lo"], j["hi"], j["effort"]) == ("j1", "base", "arm", "pitch", -1.2346, 2.0, 40.0)
    assert rows(fixed.select("urdf_name", "child")) == [("j2", "cam")] and rows(others) == [("j3", "continuous")]

    existing = spark.createDataFrame([("r.joint.a", -1.0, 2.0, 120.0, "Arm", None, "n")], "id string, lo double, hi double, torque_peak double, name_human string, j_label string, notes string")
    names = spark.createDataFrame([("j1", "r.joint.a")], "urdf_name string, id string")
    patched, diffs = audit.merge_joints(revolute.select("urdf_name", "lo", "hi", "effort"), existing, names)
    assert sorted(r["kind"] for r in diffs.collect()) == ["effort", "position_limit"]
    report = sinks.diff_report(diffs)
    assert "## effort (1)" in report and "| r.joint.a | 120.0 | 40.0 |" in report
    patch = yaml.safe_load(sinks.joint_patch(patched))["objects"]
    assert patch == [{"type": "Joint", "id": "r.joint.a", "properties": {"urdf_name": "j1", "position_limit": {"min": -1.2346, "max": 2.0, "unit": "rad"}, "effort_limit": 40.0, "name_human": "Arm", "notes": "n"}}]
    mapping = spark.createDataFrame([("cam", None), ("nothing", "s")], "child string, sensor string")
    assert [r["kind"] for r in audit.mounts(fixed, mapping).collect()] == ["suggestion"]


def test_sdk_tree(spark, tmp_path):
    for name in ("pkg/msg", "pkg/srv", "demo"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "pkg/msg/State.msg").write_text("# head\nfloat64 speed = 1.5 # m/s\nstring[] names\n\n")
    (tmp_path / "pkg/srv/Set.srv").write_text("int32 mode\n---\nbool ok\n")
    (tmp_path / "demo/use.py").write_text("import x\np = n.create_publisher(\n  State, '/bus/state', q)\n# QoSDurabilityPolicy.VOLATILE QoSDurabilityPolicy.TRANSIENT_LOCAL\n")
    (tmp_path / "demo/__init__.py").write_text("n.create_client(Set, '/hidden/x')")
    (tmp_path / "demo/big.bin").write_bytes(b"\0" * 100)
    tables = imports.sdk_tree(spark, str(tmp_path))
    assert rows(tables["messages"].select("type", "name", "default", "comment"), "name") == [("string[]", "names", None, None), ("float64", "speed", "1.5", "m/s")]
    assert rows(tables["services"].select("name", "part"), "name") == [("mode", "request"), ("ok", "response")]
    assert rows(tables["topics"].select("topic", "msg_type", "line", "durability")) == [("/bus/state", "State", 2, "TRANSIENT_LOCAL")]
    document = json.loads(sinks.sdk_document(tables).first()["document"])
    assert document["msg_schemas"] == [{"name": "State", "package": "pkg", "fields": [{"name": "speed", "type": "float64"}, {"name": "names", "type": "string[]"}]}]
    assert document["srv_schemas"] == [{"name": "Set", "package": "pkg", "request_fields": [{"name": "mode", "type": "int32"}], "response_fields": [{"name": "ok", "type": "bool"}]}]
    assert document["topic_inferences"] == [{"topic": "/bus/state", "msg_type": "State", "from": "use.py"}]


def test_inventory_and_coverage(spark, tmp_path):
    c = P.catalog(spark, SF, P.union(P.nations(spark, SF), P.suppliers(spark, SF)), P.located(spark, SF))
    sinks.inventory(c, {"Mode": ["name", "mode_value"], "Sensor": ["name"]}, str(tmp_path / "inv"))
    modes = spark.read.option("header", True).csv(str(tmp_path / "inv/type=Mode"))
    assert modes.columns == ["robot_id", "id", "name", "mode_value"] and modes.count() == 25
    overview = {r["category"]: r["n"] for r in spark.read.option("header", True).csv(str(tmp_path / "inv/overview")).collect()}
    assert overview["TOTAL"] == str(25 + int(overview["hardware"]))
    table = lambda data, schema: spark.createDataFrame(data, schema)
    topics = table([(f"/t/{i:02}", i, "unregistered") for i in range(60)] + [("/u", 0, "unobserved"), ("/r", 5, "registered")], "topic string, n long, status string")
    text = sinks.coverage_report(topics, table([("m", 3)], "msg_type string, n long"), table([("log.error", 2)], "kind string, n long"), table([("bad file",)], "message string"))
    assert text.count("- /t/") == 50 and "- /t/59: 59" in text and "- /u\n" in text and "/r" not in text and "- bad file" in text


def test_build_log(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("x")
    log = audit.BuildLog(spark, str(tmp_path))
    assert not log.exists
    first = log.init()
    (tmp_path / "a.yaml").write_text("y")
    (tmp_path / "b.yaml").write_text("z")
    event = log.record("import", "cmd", 0, "note")
    assert [f["file"] for f in event["files_changed"]] == ["a.yaml", "b.yaml"] and event["files_changed"][1]["before"] is None
    assert event["inputs_hash"] == first["outputs_hash"] != event["outputs_hash"]
    log.record("check", exit_code=1)
    log.record("import")
    assert [r["step"] for r in log.tail(2).collect()] == ["check", "import"]
    assert [r["step"] for r in log.completed_steps().collect()] == ["import"] and log.events().count() == 4
    with pytest.raises(FileNotFoundError):
        audit.BuildLog(spark, str(tmp_path / "none"))


def test_profiles_and_report(spark):
    assert len(rules.load_profile("customer_v1")) == 31 and len(rules.load_profile("learning_v1")) == 25
    assert all(r.check in rules.CHECKS for n in ("customer_v1", "learning_v1") for r in rules.load_profile(n))
    from pathlib import Path

    c = pack.load(spark, str(Path(__file__).parent / "packs" / "mini"))
    results = rules.evaluate(c, rules.load_profile("customer_v1"))
    assert rules.grade(results).first()["grade"] == "fail" and "must loader.clean" in rules.report(spark, results)


def test_kinematic_tree(spark):
    links = spark.createDataFrame([("r", "parent_of", a, b) for a, b in (("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"))], "robot_id string, type string, source string, target string")

    class C:
        pass

    c = C()
    c.links, c.spark = links, spark
    got = rows(graph.kinematic_tree(c).select("top", "id", "depth"))
    assert got == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1), ("x", "y", 1)]
