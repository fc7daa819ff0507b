from pathlib import Path

import pytest

from graphloom.catalog import prop
from graphloom.operators import gate, graph, rules
from graphloom.sinks import graph_json
from graphloom.sources import pack
from pyspark.sql import functions as F

MINI = str(Path(__file__).parent / "packs" / "mini")


@pytest.fixture(scope="module")
def mini(spark):
    return pack.load(spark, MINI).cache()


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_first_duplicate_wins_and_issues(mini):
    cpu = graph.objects_of_type(mini, "ComputeUnit").select(prop("name").alias("name")).collect()
    assert [r["name"] for r in cpu] == ["main"]
    codes = sorted((r["code"], r["severity"]) for r in mini.issues.collect())
    want = [("bad_limit", "error"), ("dangling_ref", "error"), ("duplicate_id", "error"), ("missing_field", "error"), ("missing_invoker", "error"), ("missing_limit", "warning"), ("missing_shard", "error"), ("unknown_invoker", "error")]
    assert codes == want


def test_discovery(tmp_path):
    for name in ("a", "_b", ".c", "d"):
        (tmp_path / name).mkdir()
        if name != "d":
            (tmp_path / name / "ontology.yaml").write_text("robot: {id: x}")
    assert [p.name for p in pack.discover(str(tmp_path))] == ["a"]


def test_lookups(mini):
    assert ids(graph.joints(mini, axis="pitch", part="left")) == ["mini.joint.left_knee"]
    assert ids(graph.joints(mini, label="knee")) == ["mini.joint.left_knee", "mini.joint.right_knee"]
    assert ids(graph.status_bits(mini, severity="error", field="pmu_bits")) == ["mini.bit.hot"]
    assert ids(graph.actions_by_safety_class(mini, "INFO")) == ["get_state"]
    assert {r["mode_value"]: r["mode_id"] for r in graph.modes_by_value(mini).collect()} == {"WALK": "mini.mode.walk", "STAND": "mini.mode.stand"}
    assert graph.action_for_llm(mini).where("id = 'broken'").first()["preconditions"] == ["@state.x == 1"]
    assert [(r["kind"], r["id"]) for r in graph.explain(mini, "mini.joint.elbow").collect()] == [("affected_by", "move_base")]
    assert graph.explain(mini, "nowhere").first()["kind"] == "unknown"
    assert ids(graph.where(mini.objects, "Mode", name_human=None)) == ["mini.mode.stand", "mini.mode.walk2"]
    assert ids(graph.where(mini.objects, "PresetMotion", motion_value=3.0, area_value=True)) == ["mini.motion.wave"]


def test_capabilities(mini):
    s = {r["capability"]: r for r in graph.capability_summary(mini).collect()}
    nav = s["mini.cap.nav"]
    assert nav["providers"] == ["mini.cpu", "mini.cpu"]
    assert [a["interface"] for a in nav["actions"]] == ["get_state", "move_base"]
    assert nav["interfaces"][0]["schema"] == "mini/msg/State"
    assert s["mini.cap.talk"]["name"] == "mini.cap.talk"
    menu = graph.capability_summary(mini, kind="navigation", include_readonly=False).collect()
    assert [a["interface"] for a in menu[0]["actions"]] == ["move_base"]
    fit = {r["capability"]: r["reasons"] for r in graph.service_fit(mini, "mini.req.patrol").collect()}
    assert fit == {"mini.cap.nav": ["linked_by_satisfies_requirement", "capability_kind_required", "required_output_match"], "mini.cap.talk": ["linked_by_satisfies_requirement"]}
    assert ids(graph.find_capabilities(mini, detects="obstacle", provider="mini.cpu", exposed_via="move_base")) == ["mini.cap.nav"]
    assert ids(graph.find_capabilities(mini, requirement="interaction")) == ["mini.cap.talk"]


def test_modes_and_impact(mini):
    assert [tuple(r)[1:] for r in graph.actions_in_mode(mini).collect()] == [("mini.mode.walk", "move_base")]
    assert [tuple(r)[1:] for r in graph.actions_in_mode(mini, allowed=False).collect()] == [("mini.mode.stand", "move_base")]
    assert [tuple(r)[1:] for r in graph.transitions(mini).collect()] == [("mini.mode.stand", "WALK")]
    hits = graph.affecting(graph.affects(mini), mini.spark.createDataFrame([("mini.joint.neck",), ("mini.cpu",), ("mini.joint",), ("mini.jointx",)], "target string"))
    assert sorted((r["action_id"], r["target"]) for r in hits.collect()) == [("get_state", "mini.cpu"), ("get_state", "mini.joint.neck"), ("move_base", "mini.joint"), ("move_base", "mini.joint.neck")]


def test_wildcards_match_brute_force(spark):
    names = ["a", "a.b", "a.b.c", "ab", "a_b", "a.bx", "b"]
    patterns = [*names, *(n + ".*" for n in names)]
    df = spark.createDataFrame([(t, p) for t in names for p in patterns], "t string, p string")
    for r in df.withColumn("m", graph.wildcard_match(F.col("t"), F.col("p"))).collect():
        stem = r["p"].removesuffix(".*")
        assert r["m"] == (r["t"] == r["p"] or (r["p"].endswith(".*") and (r["t"] == stem or r["t"].startswith(stem + "."))))


def test_drafts_and_export(mini):
    objects, links = graph.infer_capabilities(mini)
    assert {r["id"]: r["actions"] for r in objects.collect()} == {"mini.cap.locomotion_control": ["move_base"], "mini.cap.motion_execution": ["broken"], "mini.cap.information_or_configuration": ["get_state"]}
    assert ("mini.cap.locomotion_control", "mini.topic.state") in {(r["source"], r["target"]) for r in links.collect()}
    assert '"nodes":16,"links":16' in graph_json(mini).first()["graph"]
    assert {(r["source"], r["target"]) for r in graph.graph_edges(mini, known_only=True).where("type = 'affects'").collect()} == {("get_state", "mini.joint.neck"), ("get_state", "mini.cpu")}


def test_rules(mini):
    checks = [
        ("robot_meta_field", {"field": "vendor"}, True), ("robot_meta_field", {"field": "nope"}, False), ("object_count", {"type": "Joint", "min": 3}, True), ("object_count", {"type": "Joint", "min": 4}, False),
        ("action_count", {"min": 3}, True), ("link_count", {"type": "allows"}, True), ("actions_have_field", {"field": "invoker"}, False), ("actions_have_field", {"field": "safety_class", "non_empty": True}, True),
        ("actions_have_field", {"field": "affects"}, False), ("objects_have_source", {"min_pct": 50}, False), ("objects_have_source", {"type": "Joint", "min_pct": 33}, True), ("joints_have_position_limit", {}, False),
        ("loader_clean", {}, False), ("capability_boundary", {"min_declarations": 2}, True), ("standard_mappings_count", {}, True), ("capabilities_have_link", {"link_type": "exposed_via"}, False),
        ("actions_exposed_by_capability", {"safety_classes": ["MOTION"]}, True), ("actions_exposed_by_capability", {}, False), ("action_invokers", {}, False), ("goals_defined", {}, True), ("policies_count", {"min": 2}, True), ("policies_have_code", {}, False), ("unheard_of", {}, False),
    ]
    rows = rules.evaluate(mini, [rules.Rule(str(i), "must", c, a) for i, (c, a, _) in enumerate(checks)]).collect()
    got = {int(r["rule_id"]): r["passed"] for r in rows}
    assert {i: got[i] for i in got} == {i: p for i, (_, _, p) in enumerate(checks)}


@pytest.mark.parametrize(("must", "should", "may", "want"), [((1, 0), (1,), (), "fail"), ((1,), (0, 0), (), "alpha"), ((1,), (1,) * 7 + (0,) * 3, (), "beta"), ((1,), (1, 1), (0,), "customer-ready"), ((1,), (), (0,), "customer-ready")])
def test_grades(spark, must, should, may, want):
    rows = [("r", str(i), s, bool(p)) for s, ps in (("must", must), ("should", should), ("may", may)) for i, p in enumerate(ps)]
    assert rules.grade(spark.createDataFrame(rows, "robot_id string, rule_id string, severity string, passed boolean")).first()["grade"] == want


def test_gate_on_pack(spark, mini):
    rows = [
        (1, "move_base", '{"v":0.5}', '{"mode":"WALK","battery":50}'), (2, "move_base", '{"v":1.5,"source":"app"}', '{"mode":"WALK","battery":10}'), (3, "move_base", "{}", '{"mode":"STAND"}'),
        (4, "move_base", '{"v":"fast","source":"2"}', '{"mode":"WALK","battery":50}'), (5, "fly", "{}", "{}"), (6, "broken", "{}", '{"x":1}'), (7, "move_base", '{"v":0,"source":"tv"}', '{"mode":"WALK","battery":21}'),
    ]
    calls = spark.createDataFrame(rows, "call long, action_id string, params string, state string").withColumns({"robot_id": F.lit("mini"), "params": F.parse_json("params"), "state": F.parse_json("state")})
    got = {r["call"]: r for r in gate.check(calls, mini).collect()}
    errors = {k: [f["error"] for f in r["failures"]] for k, r in got.items()}
    assert sorted(k for k, r in got.items() if r["ok"]) == [1, 6]
    assert errors[2] == ["'v'=1.5 exceeds max 1"] and [w["error"] for w in got[2]["warnings"]] == ["battery low"]
    assert errors[3] == ["required parameter 'v' missing", "not walking", "could not be evaluated"]
    assert errors[4] == ["'v'=fast is not numeric", "'source'=2 is reserved"]
    assert errors[5] == ["unknown action"] and errors[7] == ["'source'=tv not in enum"]


def test_grounding(spark):
    g = pack.grounding(spark, MINI)
    assert {(r["field"], r["bit"], r["severity"]) for r in g["bits"].collect()} == {("pmu_bits", 2, "error"), ("pmu_bits", 0, "nominal")}
    assert ids(g["topics"], "topic") == ["/mini/hal/state"] and g["actions"].count() == 3
