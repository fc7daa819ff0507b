"""Command line and JSON-RPC tools over the same functions as everything else.

``python -m graphloom validate|query|check-action|demo|readiness|infer-capabilities|import|build|serve``.
Exit codes: 0 fine, 1 errors found or a grade missed, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .catalog import Catalog, prop
from .model import GRADE_RANK
from .operators import audit, gate, graph, rules
from .sources import imports, pack


def records(df: DataFrame) -> list[dict]:
    """Rows as plain data; a pack is small."""
    return [json.loads(r) for r in df.toJSON().collect()]


def _action(c: Catalog, id_: str | None) -> DataFrame:
    found = graph.action_for_llm(c)
    return found.where(F.col("id") == id_) if id_ else found


def _affecting(c: Catalog, target: str | None) -> DataFrame:
    return graph.affecting(graph.affects(c), c.spark.createDataFrame([(target or "",)], "target string"))


#: [X8] Kinds of queries: (catalog, argument or None) -> rows.
KINDS: dict[str, Callable[[Catalog, str | None], DataFrame]] = {
    "objects": lambda c, a: graph.list_objects(graph.objects_of_type(c, a) if a else c.objects),
    "actions-in-mode": lambda c, a: graph.actions_in_mode(c).join(graph.resolve_refs(c, c.robots.select("robot_id", F.lit(a or "").alias("ref")), "ref").select("robot_id", F.col("resolved").alias("mode")), ["robot_id", "mode"], "left_semi"),
    "actions-affecting": _affecting,
    "events-on": lambda c, a: graph.events_indicating(c).where(F.col("target") == (a or "")),
    "bits": lambda c, a: graph.status_bits(c, field=a).select("robot_id", "id", prop("carrier_field").alias("field"), prop("bit_index", "int").alias("bit"), prop("severity").alias("severity")),
    "action-spec": _action,
    "capabilities": lambda c, a: graph.find_capabilities(c, capability_kind=a).select("robot_id", "id", prop("capability_kind").alias("kind")),
    "agent-affordances": lambda c, a: graph.capability_summary(c, kind=a),
    "capabilities-for": lambda c, a: graph.find_capabilities(c, requirement=a).select("robot_id", "id"),
    "service-fit": lambda c, a: graph.service_fit(c, requirement=a or ""),
}


def check_action(c: Catalog, action: str, params: dict, state: dict) -> dict:
    row = c.robots.select("robot_id", F.lit(action).alias("action_id"), F.parse_json(F.lit(json.dumps(params))).alias("params"), F.parse_json(F.lit(json.dumps(state))).alias("state"))
    return records(gate.check(row, c).select("robot_id", "ok", "failures", "warnings", "summary"))[0]


def grades(c: Catalog, profile: str) -> dict:
    results = rules.evaluate(c, rules.load_profile(profile)).cache()
    return {"robots": records(rules.grade(results)), "results": records(results), "text": rules.report(c.spark, results)}


class Tools:
    """[X9] Tools by name: arguments as plain data -> plain data.  Every pack below the folder is one robot."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.packs, self.loaded = spark, {p.name: p for p in pack.discover(folder)}, {}
        self.calls: dict[str, Callable[[dict], object]] = {
            "list_robots": lambda a: sorted(self.packs),
            "list_actions": lambda a: records(graph.list_actions(self._pack(a))),
            "get_action": lambda a: records(_action(self._pack(a), a["action_id"])),
            "check_action": lambda a: check_action(self._pack(a), a["action_id"], a.get("params") or {}, a.get("state") or {}),
            "query_objects": lambda a: records(KINDS["objects"](self._pack(a), a.get("type"))),
            "list_capabilities": lambda a: records(KINDS["capabilities"](self._pack(a), a.get("kind"))),
            "agent_affordances": lambda a: records(KINDS["agent-affordances"](self._pack(a), a.get("kind"))),
            "infer_capabilities": lambda a: [records(t) for t in graph.infer_capabilities(self._pack(a))],
            "explain_service_fit": lambda a: records(graph.service_fit(self._pack(a), requirement=a.get("requirement"), required_capabilities=a.get("required_capabilities") or [], required_outputs=a.get("required_outputs") or [])),
            "explain": lambda a: records(graph.explain(self._pack(a), a["id"])),
            "readiness": lambda a: grades(self._pack(a), a.get("profile") or "customer_v1"),
        }

    def _pack(self, arguments: dict) -> Catalog:
        name = arguments.get("robot") or next(iter(sorted(self.packs)), None)
        if name not in self.packs:
            raise KeyError(f"no robot {name!r}")
        if name not in self.loaded:
            self.loaded[name] = pack.load(self.spark, str(self.packs[name])).cache()
        return self.loaded[name]

    def answer(self, line: str) -> dict | None:
        """The response to one request line; None for notifications."""
        try:
            request = json.loads(line)
        except ValueError as error:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(error)}}
        reply = {"jsonrpc": "2.0", "id": request.get("id")}
        method, params = request.get("method"), request.get("params") or {}
        if "id" not in request:
            return None
        if method == "initialize":
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "1"}}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": n, "inputSchema": {"type": "object"}} for n in self.calls]}}
        if method != "tools/call":
            return reply | {"error": {"code": -32601, "message": f"no method {method!r}"}}
        try:
            found = self.calls[params.get("name")](params.get("arguments") or {})
        except (KeyError, ValueError, FileNotFoundError) as error:
            return reply | {"error": {"code": -32602, "message": f"{type(error).__name__}: {error}"}}
        return reply | {"result": {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False)}]}}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments, parent=sub, **options):
        one = parent.add_parser(name)
        for a in arguments:
            one.add_argument(a)
        for flag, default in options.items():
            one.add_argument("--" + flag, **({"action": "store_true"} if default is False else {"default": default}))
        return one

    command("validate", "dir")
    query = command("query", "dir")
    query.add_argument("kind", choices=sorted(KINDS))
    query.add_argument("arg", nargs="?")
    command("check-action", "dir", "action", params="{}", state="{}")
    command("demo", "dir")
    command("readiness", "dir", profile="customer_v1", json=False, require="")
    command("infer-capabilities", "dir", yaml=False)
    kinds = command("import").add_subparsers(dest="what", required=True)
    command("urdf", "file", parent=kinds)
    command("sdk-code", "folder", parent=kinds)
    steps = command("build").add_subparsers(dest="what", required=True)
    for name in ("init", "status"):
        command(name, "dir", parent=steps)
    command("log", "dir", parent=steps, limit="50")
    run = command("run", "dir", "step", parent=steps, note="")
    run.add_argument("cmd", nargs=argparse.REMAINDER)
    command("serve", "dir")
    return p


def _build(spark: SparkSession, a, out) -> int:
    log = audit.BuildLog(spark, a.dir)
    if a.what == "init":
        log.init()
    elif a.what == "run":
        done = subprocess.run(a.cmd, check=False).returncode if a.cmd else 0
        log.record(a.step, " ".join(a.cmd), done, a.note)
        return done
    elif not log.exists:
        print("no build session", file=out)
        return 1
    elif a.what == "log":
        print(*records(log.tail(int(a.limit))), sep="\n", file=out)
    else:
        print(log.events().count(), "events; done:", ", ".join(r["step"] for r in log.completed_steps().collect()), file=out)
    return 0


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """[X7, X10] Run a command; the exit code."""
    out = out or sys.stdout
    try:
        a = _parser().parse_args(arguments)
    except SystemExit as stop:
        return int(stop.code or 0)
    folder = getattr(a, "dir", None)
    if folder and not Path(folder).is_dir():
        print(f"{folder} is no folder", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    show = lambda found: print(json.dumps(found, ensure_ascii=False, indent=2), file=out)
    if a.command == "build":
        return _build(spark, a, out)
    if a.command == "serve":
        tools = Tools(spark, folder)
        for line in sys.stdin:
            if (reply := tools.answer(line)) is not None:
                print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
        return 0
    if a.command == "import":
        if a.what == "sdk-code":
            print(sinks.sdk_document(imports.sdk_tree(spark, a.folder)).first()[0], file=out)
        else:
            show({"links": records(imports.urdf_links(spark, a.file)), "joints": records(imports.urdf_joints(spark, a.file)[0])})
        return 0
    c = pack.load(spark, folder)
    if a.command == "validate":
        found = records(c.issues.orderBy("severity", "code", "subject"))
        show(found)
        return int(any(i["severity"] == "error" for i in found))
    if a.command == "demo":
        show({"counts": records(graph.counts(c)), "types": records(graph.counts_by_type(c))})
    elif a.command == "query":
        show(records(KINDS[a.kind](c, a.arg)))
    elif a.command == "check-action":
        try:
            verdict = check_action(c, a.action, json.loads(a.params), json.loads(a.state))
        except ValueError as error:
            print(error, file=sys.stderr)
            return 2
        show(verdict)
        return int(not verdict["ok"])
    elif a.command == "infer-capabilities":
        objects, links = (records(t) for t in graph.infer_capabilities(c))
        print(yaml.safe_dump({"objects": objects, "links": links}, allow_unicode=True), file=out) if a.yaml else show({"objects": objects, "links": links})
    else:
        found = grades(c, a.profile)
        show({k: found[k] for k in ("robots", "results")}) if a.json else print(found["text"], file=out)
        if a.require and a.require not in GRADE_RANK:
            print(f"no grade {a.require!r}", file=sys.stderr)
            return 2
        reached = min((GRADE_RANK[r["grade"]] for r in found["robots"]), default=0)
        return int(reached < GRADE_RANK[a.require or "alpha"])
    return 0
