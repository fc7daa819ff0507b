"""Data-quality rules: profiles of declarative rules, evaluated to rows and graded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Catalog, prop
from ..functions.scalars import is_placeholder
from .graph import RISKY, linked, objects_of_type

SEVERITIES = ("must", "should", "may")
RESULT = "robot_id string, rule_id string, severity string, passed boolean, observed double, detail string"


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    check: str
    args: dict = field(default_factory=dict)
    description: str = ""
    hint: str = ""

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity {self.severity!r} is none of {SEVERITIES}")


def load_profile(name: str, folder: str = "") -> list[Rule]:
    """[S24] A profile by path, or by name in a folder (that of the package by default)."""
    at = Path(name) if name.endswith((".yaml", ".yml")) else Path(folder or Path(__file__).parent.parent / "profiles") / f"{name}.yaml"
    keys = ("id", "severity", "check", "args", "description", "hint")
    rules = (yaml.safe_load(at.read_text("utf-8")) or {}).get("rules") or []
    return [Rule(**({"severity": "should"} | {k: r[k] for k in keys if r.get(k) is not None})) for r in rules]


def _robots(c: Catalog) -> DataFrame:
    ids = c.objects.select("robot_id").union(c.actions.select("robot_id"))
    return (ids.union(c.robots.select("robot_id")) if c.robots is not None else ids).distinct()


def _counted(c: Catalog, rows: DataFrame, passed, what: str) -> DataFrame:
    """A row per robot: count of rows, and the verdict on it."""
    n = rows.groupBy("robot_id").agg(F.count("*").alias("n"))
    out = _robots(c).join(n, "robot_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("robot_id", passed(F.col("n")).alias("passed"), F.col("n").cast("double").alias("observed"), F.concat(F.col("n").cast("string"), F.lit(f" {what}")).alias("detail"))


def _missing(c: Catalog, bad: DataFrame, what: str, shown: int = 5, none_fails: DataFrame | None = None) -> DataFrame:
    """A row per robot: ids of bad rows; the first ``shown`` by ord are named [W7]."""
    first = F.row_number().over(Window.partitionBy("robot_id").orderBy("ord", "id"))
    named = bad.select("robot_id", "ord", "id").withColumn("__rn", first).where(F.col("__rn") <= shown).groupBy("robot_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("ids"))
    out = _robots(c).join(bad.groupBy("robot_id").agg(F.count("*").alias("n")), "robot_id", "left").join(named, "robot_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    names = F.array_join(F.transform("ids", lambda i: i["id"]), ", ")
    passed = F.col("n") == 0
    if none_fails is not None:
        some = none_fails.select("robot_id").distinct().withColumn("some", F.lit(True))
        out = out.join(some, "robot_id", "left")
        passed = passed & F.coalesce("some", F.lit(False))
    return out.select("robot_id", passed.alias("passed"), F.col("n").cast("double").alias("observed"), F.when(F.col("n") == 0, f"no {what}").otherwise(F.concat(F.col("n").cast("string"), F.lit(f" {what}: "), names)).alias("detail"))


def _document(c: Catalog, passed, observed) -> DataFrame:
    return _robots(c).join(c.robots, "robot_id", "left").select("robot_id", F.coalesce(passed, F.lit(False)).alias("passed"), observed.cast("double").alias("observed"), F.lit("").alias("detail"))


def _at_least(args: dict, key: str = "min") -> Callable:
    return lambda n: n >= int(args.get(key, 1))


def robot_meta_field(c: Catalog, a: dict) -> DataFrame:
    value = prop(a.get("field", "id"), "string", "meta")
    return _document(c, ~is_placeholder(value), F.when(is_placeholder(value), 0).otherwise(1))


def object_count(c: Catalog, a: dict) -> DataFrame:
    return _counted(c, objects_of_type(c, a["type"]), _at_least(a), f"{a['type']} objects")


def action_count(c: Catalog, a: dict) -> DataFrame:
    return _counted(c, c.actions, _at_least(a), "actions")


def link_count(c: Catalog, a: dict) -> DataFrame:
    links = c.links.where(F.col("type") == a["type"]) if a.get("type") else c.links
    return _counted(c, links, _at_least(a), f"links of {a.get('type') or 'any type'}")


def actions_have_field(c: Catalog, a: dict) -> DataFrame:
    """Present, or with non_empty also true as a value; a JSON null is present."""
    value = F.try_variant_get("body", f"$.{a['field']}", "variant")
    bad = value.isNull()
    if a.get("non_empty"):
        text = F.to_json(value)
        bad = bad | text.isin("null", '""', "[]", "{}", "0", "0.0", "false")
    return _missing(c, c.actions.where(bad), f"actions without {a['field']}")


def objects_have_source(c: Catalog, a: dict) -> DataFrame:
    """[A17] Share of objects with a source, in percent; no objects: fails."""
    pool = objects_of_type(c, a["type"]) if a.get("type") else c.objects
    has = F.col("source").isNotNull() & ~F.is_variant_null("source") & (F.to_json("source") != "{}")
    n = pool.groupBy("robot_id").agg((100.0 * F.avg(F.coalesce(has, F.lit(False)).cast("double"))).alias("pct"))
    out = _robots(c).join(n, "robot_id", "left")
    return out.select("robot_id", F.coalesce(F.col("pct") >= float(a.get("min_pct", 80)), F.lit(False)).alias("passed"), F.coalesce(F.bround("pct", 1), F.lit(0.0)).alias("observed"), F.lit("percent with source").alias("detail"))


def joints_have_position_limit(c: Catalog, a: dict) -> DataFrame:
    joints = objects_of_type(c, "Joint")
    limit = F.try_variant_get("props", "$.position_limit", "variant")
    return _missing(c, joints.where(limit.isNull() | F.to_json(limit).isin("null", "{}", "[]")), "joints without position limit", none_fails=joints)


def loader_clean(c: Catalog, a: dict) -> DataFrame:
    return _counted(c, c.issues.where("severity = 'error'"), lambda n: n == 0, "loader errors")


def capability_boundary(c: Catalog, a: dict) -> DataFrame:
    size = lambda k: F.coalesce(F.size(prop(k, "array<variant>", "boundary")), F.lit(0))
    keys = F.coalesce(F.size(F.map_keys(prop("observability", "map<string,variant>", "boundary"))), F.size(prop("observability", "array<variant>", "boundary")), F.lit(0))
    n = size("declared_sensors") + size("declared_joint_groups") + size("log_sources") + keys
    filled = F.to_json("boundary") != "{}"
    return _document(c, filled & (n >= int(a.get("min_declarations", 1))), F.coalesce(n, F.lit(0)))


def standard_mappings_count(c: Catalog, a: dict) -> DataFrame:
    n = F.coalesce(F.size(prop("standards", "array<variant>", "standard_mappings")), F.lit(0))
    return _document(c, n >= int(a.get("min", 1)), n)


def capabilities_have_link(c: Catalog, a: dict) -> DataFrame:
    """[J27]"""
    caps = objects_of_type(c, "Capability")
    near = "target" if a.get("direction", "out") == "in" else "source"
    has = linked(c.links, a["link_type"], near).select("robot_id", F.col("near_id").alias("id"))
    return _missing(c, caps.join(has, ["robot_id", "id"], "left_anti"), f"capabilities without {a['link_type']}")


def actions_exposed_by_capability(c: Catalog, a: dict) -> DataFrame:
    """[J28]"""
    risky = c.actions.where(F.col("safety_class").isin(*a.get("safety_classes", RISKY)))
    caps = objects_of_type(c, "Capability").select("robot_id", F.col("id").alias("near_id"))
    exposed = linked(c.links, "exposed_via").join(caps, ["robot_id", "near_id"], "left_semi").select("robot_id", F.col("far_id").alias("id"))
    return _missing(c, risky.join(exposed, ["robot_id", "id"], "left_anti"), "actions without capability", 8)


def action_invokers(c: Catalog, a: dict) -> DataFrame:
    allowed = a.get("allowed", ["ros2_topic", "ros2_service", "cli", "compound"])
    bad = ~F.coalesce(prop("type", "string", "invoker").isin(*allowed), F.lit(False))
    return _missing(c, c.actions.where(bad), "bad invokers")


def goals_defined(c: Catalog, a: dict) -> DataFrame:
    have = [F.try_variant_get("goals", f"$.primary_goal.{k}", "variant").isNotNull() for k in ("metric", "direction")]
    return _document(c, have[0] & have[1], (have[0] & have[1]).cast("int"))


def policies_count(c: Catalog, a: dict) -> DataFrame:
    return _counted(c, c.policies, _at_least(a), "policies")


def policies_have_code(c: Catalog, a: dict) -> DataFrame:
    return _counted(c, c.policies.where("code_path is null"), lambda n: n == 0, "policies without code")


#: [Q1-Q16, X1] Checks by name: (catalog, args) -> robot_id, passed, observed, detail.
CHECKS: dict[str, Callable[[Catalog, dict], DataFrame]] = {
    f.__name__: f
    for f in (robot_meta_field, object_count, action_count, link_count, actions_have_field, objects_have_source, joints_have_position_limit, loader_clean, capability_boundary, standard_mappings_count, capabilities_have_link, actions_exposed_by_capability, action_invokers, goals_defined, policies_count, policies_have_code)
}


def evaluate(c: Catalog, rules: list[Rule]) -> DataFrame:
    """[Q0] A row per robot and rule; an unknown check, or arguments that a check cannot use, make a failed row."""
    out = c.spark.createDataFrame([], RESULT)
    for rule in rules:
        try:
            rows = CHECKS[rule.check](c, rule.args)
        except (KeyError, TypeError, ValueError, AnalysisException) as error:  # one broken rule must not end the others
            rows = _robots(c).select("robot_id", F.lit(False).alias("passed"), F.lit(None).cast("double").alias("observed"), F.lit(f"check {rule.check} failed: {type(error).__name__}").alias("detail"))
        out = out.unionByName(rows.select("robot_id", F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), "passed", "observed", "detail"))
    return out


def grade(results: DataFrame, beta_pct: float = 70.0, by: tuple[str, ...] = ("robot_id",)) -> DataFrame:
    """[A14-A16] Score and grade per robot.

    Score: 2, 1 and 0.5 points for must, should and may, in percent.  fail if a
    must fails; customer-ready with all shoulds (or none declared); beta from
    ``beta_pct`` percent of them on; else alpha.
    """
    sums = [F.count_if(F.col("severity") == s).alias(f"{s}_total") for s in SEVERITIES] + [F.count_if((F.col("severity") == s) & F.col("passed")).alias(f"{s}_passed") for s in SEVERITIES]
    out = results.groupBy(*by).agg(*sums) if by else results.agg(*sums)
    points = lambda kind: 2.0 * F.col(f"must_{kind}") + F.col(f"should_{kind}") + 0.5 * F.col(f"may_{kind}")
    score = F.when(points("total") > 0, 100.0 * points("passed") / points("total")).otherwise(0.0)
    share = 100.0 * F.col("should_passed") / F.nullif(F.col("should_total"), F.lit(0))
    ladder = F.when(F.col("must_passed") < F.col("must_total"), "fail").when(F.col("should_passed") == F.col("should_total"), "customer-ready").when(share >= beta_pct, "beta").otherwise("alpha")
    return out.withColumns({"score": score, "grade": ladder})


def readiness(c: Catalog, rules: list[Rule]) -> DataFrame:
    """[K9] Results and grades of all robots."""
    return grade(evaluate(c, rules))


def report(spark: SparkSession, results: DataFrame) -> str:
    """[K9] The results as text."""
    lines = []
    for g in grade(results).orderBy("robot_id").collect():
        lines.append(f"{g['robot_id']}: {g['grade']} ({g['score']:.1f})")
        for s in SEVERITIES:
            lines.append(f"  {s}: {g[s + '_passed']}/{g[s + '_total']}")
    lines += [f"  - {r['robot_id']} {r['severity']} {r['rule_id']}: {r['detail']}" for r in results.where("not passed").orderBy("robot_id", "rule_id").collect()]
    return "\n".join(lines)
