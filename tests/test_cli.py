"""Commands, their exit codes, and the tools over request lines."""

import io
import json
import shutil
from pathlib import Path

import pytest

from graphloom import cli
from graphloom.sources import pack

MINI = Path(__file__).parent / "packs" / "mini"


@pytest.fixture
def call(spark):
    def run(*arguments):
        out = io.StringIO()
        return cli.main(list(map(str, arguments)), spark, out), out.getvalue()

    return run


def test_exit_codes(call, tmp_path):
    code, text = call("validate", MINI)
    assert code == 1 and '"duplicate_id"' in text
    assert call("validate", tmp_path / "none")[0] == 2 and call("nonsense")[0] == 2 and call("query", MINI, "nonsense")[0] == 2
    assert call("readiness", MINI)[0] == 1 and call("readiness", MINI, "--require", "odd")[0] == 2
    code, text = call("check-action", MINI, "move_base", "--params", '{"v": 0.5}', "--state", '{"mode": "WALK", "battery": 50}')
    assert code == 0 and json.loads(text)["ok"] and call("check-action", MINI, "fly")[0] == 1 and call("check-action", MINI, "fly", "--params", "{")[0] == 2


def test_query_kinds(spark, call):
    c = pack.load(spark, str(MINI)).cache()
    ask = lambda kind, arg=None: cli.records(cli.KINDS[kind](c, arg))
    assert json.loads(call("query", MINI, "objects", "PresetMotion")[1]) == ask("objects", "PresetMotion")
    assert {r["id"] for r in ask("objects", "Mode")} == {"mini.mode.walk", "mini.mode.stand", "mini.mode.walk2"}
    assert [r["action"] for r in ask("actions-in-mode", "WALK")] == ["move_base"]
    assert {r["action_id"] for r in ask("actions-affecting", "mini.joint.neck")} == {"move_base", "get_state"}
    assert sorted(r["bit"] for r in ask("bits", "pmu_bits")) == [0, 2]
    assert ask("action-spec", "broken")[0]["preconditions"] == ["@state.x == 1"]
    assert [r["id"] for r in ask("capabilities", "navigation")] == ["mini.cap.nav"] and len(ask("agent-affordances")) == 2
    assert [r["id"] for r in ask("capabilities-for", "interaction")] == ["mini.cap.talk"]
    assert {r["capability"] for r in ask("service-fit", "mini.req.patrol")} == {"mini.cap.nav", "mini.cap.talk"}
    assert ask("events-on", "nowhere") == []


def test_other_commands(call, tmp_path):
    assert json.loads(call("demo", MINI)[1])["counts"][0]["actions"] == 3
    assert "mini.cap.locomotion_control" in call("infer-capabilities", MINI, "--yaml")[1]
    home = tmp_path / "mini"
    shutil.copytree(MINI, home)
    assert call("build", "status", home)[0] == 1 and call("build", "init", home)[0] == 0
    assert call("build", "run", home, "touch", "true")[0] == 0 and call("build", "run", home, "fail", "false")[0] == 1
    assert "done: touch" in call("build", "status", home)[1] and call("build", "log", home)[1].count("\n") == 3


def test_tools(spark):
    tools = cli.Tools(spark, str(MINI.parent))
    ask = lambda method, **params: tools.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))
    use = lambda name, **arguments: json.loads(ask("tools/call", name=name, arguments=arguments)["result"]["content"][0]["text"])
    assert ask("initialize")["result"]["serverInfo"]["name"] == "graphloom" and len(ask("tools/list")["result"]["tools"]) == 11
    assert use("list_robots") == ["mini"] and {a["id"] for a in use("list_actions")} == {"move_base", "get_state", "broken"}
    assert use("get_action", action_id="broken")[0]["id"] == "broken" and use("explain", id="nowhere")[0]["kind"] == "unknown"
    assert use("check_action", action_id="fly")["ok"] is False and len(use("query_objects", type="Mode")) == 3
    assert len(use("list_capabilities")) == 2 and len(use("agent_affordances", kind="navigation")) == 1 and len(use("infer_capabilities")) == 2
    assert len(use("explain_service_fit", required_outputs=["pose"])) == 1 and use("readiness")["robots"][0]["grade"] == "fail"
    assert ask("odd")["error"]["code"] == -32601 and ask("tools/call", name="odd")["error"]["code"] == -32602 and tools.answer("{")["error"]["code"] == -32700
    assert ask("tools/call", name="explain", arguments={"robot": "none", "id": "x"})["error"]["code"] == -32602
    assert tools.answer('{"jsonrpc": "2.0", "method": "notifications/initialized"}') is None
