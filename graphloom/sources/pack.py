"""Ontology packs: folders of YAML shards -> a Catalog.

A pack is small by nature and parsed on the driver; its rows become DataFrames
with explicit schemas, free parts as VARIANT.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, first_wins, prop
from ..model import ACTIONS, ISSUES, LINKS, OBJECTS
from ..operators import graph

# How an action can be invoked.
INVOKERS = ("ros2_topic", "ros2_service", "cli", "compound", "dds_service", "dds_topic", "mujoco_torque", "mujoco_position")
_ACTION_TEXT = ("description", "safety_class")
_ACTION_FREE = ("invoker", "parameters", "preconditions", "affects", "affects_by_domain")


def _dump(value) -> str | None:
    return None if value is None else json.dumps(value, default=str, ensure_ascii=False)


def discover(folder: str) -> list[Path]:
    """[S7] Subfolders that hold a pack, without those that start with _ or a dot; by default of $GRAPHLOOM_PACKS."""
    root = Path(folder or os.environ.get("GRAPHLOOM_PACKS", "."))
    return sorted(p for p in root.iterdir() if p.name[0] not in "_." and (p / "ontology.yaml").is_file())


def _shards(path: Path, issues: list) -> tuple[dict, list[tuple[str, dict]]]:
    entry = yaml.safe_load((path / "ontology.yaml").read_text("utf-8")) or {}
    robot = entry.get("robot") or {}
    shards = []
    for name in entry.get("includes") or []:
        at = path / name
        if not at.is_file():
            issues.append((robot.get("id"), "error", "missing_shard", name, f"shard {name} does not exist"))
            continue
        shards.append((name, yaml.safe_load(at.read_text("utf-8")) or {}))
    return robot, shards


def load(spark: SparkSession, *folders: str) -> Catalog:
    """[S1-S6] Packs as one Catalog, with the loader's issues.

    Shards go in the listed order; of repeated ids the first wins and the others
    are issues; links are a bag; a missing shard is an issue and loading goes on.
    """
    objects, actions, links, issues, robots, policies = [], [], [], [], [], []
    for folder in map(Path, folders):
        robot, shards = _shards(folder, issues)
        rid, documents, ord_ = robot.get("id"), {}, 0
        for name, shard in shards:
            for key in ("goals", "standard_mappings"):
                if Path(name).stem == key:
                    documents[key] = shard
            for obj in shard.get("objects") or []:
                ord_ += 1
                if not obj.get("id") or not obj.get("type"):
                    issues.append((rid, "error", "missing_field", str(obj.get("id") or name), "object without id or type"))
                    continue
                objects.append((rid, ord_, obj["id"], obj["type"], _dump(obj.get("properties") or {}), _dump(obj.get("source") or None)))
            for act in shard.get("actions") or []:
                ord_ += 1
                if not act.get("type_id"):
                    issues.append((rid, "error", "missing_field", name, "action without type_id"))
                    continue
                actions.append((rid, ord_, act["type_id"], *(act.get(k) for k in _ACTION_TEXT), act.get("idempotent"), *(_dump(act.get(k)) for k in _ACTION_FREE), _dump(act)))
            for link in shard.get("links") or []:
                ord_ += 1
                links.append((rid, ord_, link.get("type"), link.get("source"), link.get("target"), _dump({k: v for k, v in link.items() if k not in ("type", "source", "target")})))
        boundary = folder / "capability_boundary.yaml"
        try:
            documents["boundary"] = yaml.safe_load(boundary.read_text("utf-8")) or {} if boundary.is_file() else {}
        except yaml.YAMLError:
            documents["boundary"] = {}
        robots.append((rid, _dump(robot), *(_dump(documents.get(k) or {}) for k in ("goals", "standard_mappings", "boundary"))))
        for at in sorted((folder / "policies").glob("*.yaml")):
            code = at.with_suffix(".py")
            policies.append((rid, at.stem, _dump(yaml.safe_load(at.read_text("utf-8")) or {}), str(code) if code.is_file() else None))

    variant = lambda df, *names: df.withColumns({n: F.parse_json(n) for n in names})
    all_objects = variant(spark.createDataFrame(objects, OBJECTS), "props", "source")
    all_actions = variant(spark.createDataFrame(actions, ACTIONS), *_ACTION_FREE, "body")
    kept_o, late_o = first_wins(all_objects, "robot_id", "id")
    kept_a, late_a = first_wins(all_actions, "robot_id", "id")
    found = spark.createDataFrame(issues, ISSUES)
    for late in (late_o, late_a):
        found = found.unionByName(_issue(late, "error", "duplicate_id", "id", "id appears again; the first one counts"))
    catalog = Catalog(kept_o, kept_a, variant(spark.createDataFrame(links, LINKS), "attrs"), None)
    catalog.robots = variant(spark.createDataFrame(robots, "robot_id string, meta string, goals string, standard_mappings string, boundary string"), "meta", "goals", "standard_mappings", "boundary")
    catalog.policies = variant(spark.createDataFrame(policies, "robot_id string, name string, params string, code_path string"), "params")
    catalog.issues = found.unionByName(validate(catalog))
    return catalog


def _issue(df: DataFrame, severity: str, code: str, subject: str, message: str) -> DataFrame:
    return df.select("robot_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"), F.lit(message).alias("message"))


def validate(c: Catalog) -> DataFrame:
    """[J15, J16, Q] The loader's checks as issue rows: references, id collisions, joint limits, invokers."""
    out = _issue(graph.dangling(c).withColumn("at", F.concat_ws(" ", "type", "side", "end")), "error", "dangling_ref", "at", "link end is unknown")
    out = out.unionByName(_issue(graph.collisions(c), "error", "id_collision", "id", "an object and an action share the id"))
    joints = graph.objects_of_type(c, "Joint").select("robot_id", "id", prop("position_limit.min", "double").alias("lo"), prop("position_limit.max", "double").alias("hi"))
    out = out.unionByName(_issue(joints.where("lo is null or hi is null"), "warning", "missing_limit", "id", "joint without position limit"))
    out = out.unionByName(_issue(joints.where("lo > hi"), "error", "bad_limit", "id", "minimum above maximum"))
    acts = c.actions.select("robot_id", "id", prop("type", "string", "invoker").alias("kind"), F.coalesce(prop("name", "string", "invoker"), prop("name_template", "string", "invoker")).alias("name"))
    out = out.unionByName(_issue(acts.where("kind is null"), "error", "missing_invoker", "id", "action without invoker"))
    out = out.unionByName(_issue(acts.where(F.col("kind").isNotNull() & ~F.col("kind").isin(*INVOKERS)), "error", "unknown_invoker", "id", "invoker type is unknown"))
    return out.unionByName(_issue(acts.where(F.col("kind").isin("ros2_topic", "ros2_service") & F.col("name").isNull()), "error", "invoker_without_name", "id", "ROS 2 invoker without name"))


def grounding(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """[S23] Dimensions that ground a session: topics, msg_types, bits, actions; from every YAML file of the folder."""
    topics, types, bits, acts = [], [], [], []
    for at in sorted(Path(folder).glob("*.yaml")):
        shard = yaml.safe_load(at.read_text("utf-8")) or {}
        for obj in shard.get("objects") or [] if isinstance(shard, dict) else []:
            p = obj.get("properties") or {}
            if obj.get("type") == "Topic" and p.get("name"):
                topics.append((p["name"], obj.get("id")))
                types += [(p["msg_type"],)] if p.get("msg_type") else []
            if obj.get("type") == "StatusBit" and p.get("carrier_field") and p.get("bit_index") is not None:
                bits.append((p["carrier_field"], int(p["bit_index"]), obj.get("id"), p.get("severity") or "unknown"))
        acts += [(a["type_id"],) for a in (shard.get("actions") or [] if isinstance(shard, dict) else []) if a.get("type_id")]
    make = spark.createDataFrame
    return {"topics": make(topics, "topic string, ref string"), "msg_types": make(types, "msg_type string").distinct(), "bits": make(bits, "field string, bit int, ref string, severity string").dropDuplicates(["field", "bit"]), "actions": make(acts, "action string").distinct()}
