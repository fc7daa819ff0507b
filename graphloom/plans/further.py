"""Further registered queries: operators that the first module's queries do not call, each with DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

import yaml
from pyspark.sql import functions as F

from .. import sinks
from ..catalog import Catalog, prop
from ..functions import scalars as S
from ..model import TYPES, colour_of, layer_of
from ..operators import audit, gate, graph, ingest, rules
from ..sources import imports, pack, session
from ..storage import shared_dir
from ..streaming import telemetry
from . import projection as P
from .queries import ACTIVE_SQL, CLASS_SQL, LINES_SQL, PARAM_SQL, PRECONDITIONS, PRIVATE_SQL, RULES, RULES_SQL, query, _calls

NONE = "variant"
ROBOT = P.ROBOT


def _made(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def _text(column: str):
    return F.col(column).cast("string")


def _actions(df, id_, **fields):
    """Rows as actions of the catalog; fields not given are null."""
    kinds = {"description": "string", "safety_class": "string", "idempotent": "boolean", "invoker": NONE, "parameters": NONE, "preconditions": NONE, "affects": NONE, "affects_by_domain": NONE, "body": NONE}
    return df.select(F.lit(ROBOT).alias("robot_id"), F.lit(0).cast("long").alias("ord"), id_.alias("id"), *[(fields[n] if n in fields else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()])


# Lookups ---------------------------------------------------------------------
@query("SELECT 'part.7' AS id, CASE WHEN p_size <= 30 THEN 'Capability' ELSE 'Action' END AS type, CASE WHEN p_size <= 30 THEN 0 ELSE 1 END AS prec FROM part WHERE p_partkey = 7")
def f_get(spark, d):
    """One id among parts that are objects up to size 30; all parts are actions too."""
    parts = P.parts(spark, d)
    c = Catalog(parts.where("try_variant_get(props, '$.size', 'int') <= 30"), _actions(parts, F.col("id")), P.located(spark, d))
    return graph.get(c, "part.7").select("id", "type", "prec")


@query("SELECT 'act_' || lower(c_mktsegment) AS id FROM (SELECT DISTINCT c_mktsegment FROM customer) WHERE c_mktsegment = 'MACHINERY'")
def f_safety_class(spark, d):
    """[F8]"""
    return graph.actions_by_safety_class(P.catalog(spark, d, P.nations(spark, d), P.located(spark, d)), "MOTION").select("id")


def _bits(spark, d):
    severity = F.when(F.col("p_size") % 3 == 0, "error").when(F.col("p_size") % 3 == 1, "warning").otherwise("info")
    return P._objects(P.table(spark, d, "part"), "StatusBit", P.key("bit", "p_partkey"), "p_partkey", severity=severity, carrier_field=F.col("p_brand"), bit_index=F.col("p_size"))


@query("SELECT 'bit.' || p_partkey AS id, 'error' AS severity FROM part WHERE p_size % 3 = 0 AND p_brand = 'Brand#1' UNION ALL SELECT 'bit.' || p_partkey, 'info' FROM part WHERE p_size % 3 = 2")
def f_status_bits(spark, d):
    """[F9, F10]"""
    c = P.catalog(spark, d, _bits(spark, d), P.located(spark, d))
    return graph.status_bits(c, "error", "Brand#1").unionByName(graph.status_bits(c, "info")).select("id", prop("severity").alias("severity"))


def _joints(spark, d):
    axis = F.element_at(F.array(*map(F.lit, ("roll", "pitch", "yaw"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    limit = F.struct((F.col("s_suppkey") % 10).cast("double").alias("min"), (F.col("s_suppkey") % 10 + 20).cast("double").alias("max"))
    return P._objects(P.table(spark, d, "supplier"), "Joint", P.key("joint", "s_suppkey"), "s_suppkey", dof_axis=axis, joint_label=F.concat(F.lit("L"), (F.col("s_suppkey") % 7).cast("string")), position_limit=limit)


@query("SELECT 'axis' AS by, 'joint.' || s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT 'label', 'joint.' || s_suppkey FROM supplier WHERE s_suppkey % 7 = 3 AND contains('joint.' || s_suppkey, '1')")
def f_joints(spark, d):
    """[F11, F12]"""
    c = P.catalog(spark, d, _joints(spark, d), P.located(spark, d))
    return graph.joints(c, axis="pitch").select(F.lit("axis").alias("by"), "id").unionByName(graph.joints(c, label="L3", part="1").select(F.lit("label").alias("by"), "id"))


@query("SELECT 'part.' || p_partkey AS id, p_name AS description, 'a > 1|b == ' || p_size AS preconditions FROM part")
def f_action_for_agent(spark, d):
    """[F16] Preconditions as texts and as objects."""
    pre = F.parse_json(F.concat(F.lit('["a > 1", {"expr": "b == '), _text("p_size"), F.lit('"}]')))
    c = Catalog(P.nations(spark, d), _actions(P.table(spark, d, "part"), P.key("part", "p_partkey"), description=F.col("p_name"), preconditions=pre), P.located(spark, d))
    return graph.action_for_llm(c).select("id", "description", F.array_join("preconditions", "|").alias("preconditions"))


@query("SELECT 'std.' || r_regionkey AS standard, r_name AS name, t AS term, CASE t WHEN 'key' THEN CAST(r_regionkey AS VARCHAR) ELSE r_name END AS mapped FROM region, (VALUES ('key'), ('label')) AS x(t)")
def f_standard_terms(spark, d):
    """[F6]"""
    one = F.struct(P.key("std", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.struct(_text("r_regionkey").alias("key"), F.col("r_name").alias("label")).alias("mappings"))
    robots = P.table(spark, d, "region").agg(F.to_variant_object(F.struct(F.collect_list(one).alias("standards"))).alias("standard_mappings")).withColumn("robot_id", F.lit(ROBOT))
    return graph.standard_terms(Catalog(P.nations(spark, d), P.actions(spark, d), P.located(spark, d), robots=robots)).select("standard", "name", "term", "mapped")


@query(f"SELECT name, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN '/bus/state' WHEN 1 THEN 'stamp' WHEN 2 THEN 'Depth_Image' WHEN 3 THEN 'motor_temp' WHEN 4 THEN 'seq' ELSE event_type END AS name FROM events) WHERE name NOT LIKE '/%' AND name NOT IN {S.STOP_FIELDS} AND NOT regexp_matches(name, '(?i){PRIVATE_SQL}') GROUP BY name")
def f_coverage_fields(spark, d):
    """[F24]"""
    k = F.col("event_id") % 6
    name = F.when(k == 0, "/bus/state").when(k == 1, "stamp").when(k == 2, "Depth_Image").when(k == 3, "motor_temp").when(k == 4, "seq").otherwise(F.col("event_type"))
    return P.table(spark, d, "events").select(name.alias("name")).where(S.counts_for_coverage(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE left(text, 117) || '...' END AS cell FROM documents")
def f_clip_cell(spark, d):
    """[F26]"""
    return P.table(spark, d, "documents").select("doc_id", graph.clip_cell(F.col("text")).alias("cell"))


TYPES_SQL = ", ".join(f"('{t}', '{v[1]}', '{v[2]}')" for t, v in TYPES.items())


@query(f"SELECT coalesce(colour, '#888') AS colour, coalesce(layer, 'hardware') AS layer, count(*) AS n FROM (SELECT 'Mode' AS type FROM nation UNION ALL SELECT 'Customer' FROM customer UNION ALL SELECT 'Sensor' FROM supplier UNION ALL SELECT 'Topic' FROM orders) o LEFT JOIN (VALUES {TYPES_SQL}) AS t(type, colour, layer) USING (type) GROUP BY ALL")
def f_colours(spark, d):
    """[F28]"""
    objects = P.union(P.nations(spark, d), P.customers(spark, d), P.suppliers(spark, d), P.orders(spark, d))
    return objects.groupBy(colour_of(F.col("type")).alias("colour"), layer_of(F.col("type")).alias("layer")).agg(F.count("*").alias("n"))


# Joins ---------------------------------------------------------------------
@query(
    """SELECT capability, reasons FROM (SELECT 'part.' || p_partkey AS capability, concat_ws('|', CASE WHEN p_brand = 'Brand#2' OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7) THEN 'linked_by_satisfies_requirement' END,
CASE WHEN p_brand = 'Brand#2' THEN 'capability_kind_required' END, CASE WHEN p_type = 'ECONOMY' THEN 'required_output_match' END) AS reasons FROM part) WHERE reasons <> ''"""
)
def j_requirement_fit(spark, d):
    """[J8] Of a requirement object."""
    needs = P._objects(P.table(spark, d, "region").where("r_regionkey = 0"), "ServiceRequirement", P.key("req", "r_regionkey"), "r_regionkey", required_capabilities=F.array(F.lit("Brand#2")), required_outputs=F.array(F.lit("ECONOMY")))
    satisfied = P.links(P.table(spark, d, "lineitem").where("l_linenumber = 7"), "satisfies_requirement", P.key("part", "l_partkey"), F.lit("req.0"), "l_orderkey")
    fit = graph.service_fit(P.catalog(spark, d, P.union(P.parts(spark, d), needs), satisfied), "req.0")
    return fit.select("capability", F.array_join("reasons", "|").alias("reasons"))


@query("SELECT 'act_' || lower(c_mktsegment) AS action, count(*) AS topics FROM customer JOIN orders ON o_orderkey = c_custkey GROUP BY 1")
def j_invokes_via(spark, d):
    """[J29]"""
    via = P.links(P.table(spark, d, "customer"), "invokes_via", F.concat(F.lit("act_"), F.lower("c_mktsegment")), P.key("order", "c_custkey"), "c_custkey")
    return graph.neighbours(P.catalog(spark, d, P.orders(spark, d), via), "invokes_via", "source").groupBy(F.col("near_id").alias("action")).agg(F.count("*").alias("topics"))


@query("SELECT DISTINCT 'nation.' || n_nationkey AS event FROM nation WHERE n_regionkey = 1 AND n_nationkey IN (SELECT user_id % 40 FROM events)")
def j_findings_indicating(spark, d):
    """[J31]"""
    links = P.links(P.table(spark, d, "nation"), "indicates", P.key("nation", "n_nationkey"), P.key("region", "n_regionkey"), "n_nationkey")
    findings = P.table(spark, d, "events").select(F.lit(ROBOT).alias("robot_id"), F.concat(F.lit("nation."), (F.col("user_id") % 40).cast("string")).alias("event"))
    return graph.findings_indicating(P.catalog(spark, d, P.nations(spark, d), links), findings, "region.1").select("event")


@query("SELECT child, sensor, CASE WHEN sensor IS NULL THEN 'suggestion' ELSE 'mount' END AS kind FROM (SELECT 'c' || p_partkey AS child, CASE WHEN p_partkey % 4 <> 0 THEN 'sensor.' || p_size END AS sensor FROM part WHERE p_partkey % 2 = 0)")
def j_mounts(spark, d):
    """[J24]"""
    p = P.table(spark, d, "part")
    child = F.concat(F.lit("c"), _text("p_partkey")).alias("child")
    mapping = p.where("p_partkey % 2 = 0").select(child, F.when(F.col("p_partkey") % 4 != 0, P.key("sensor", "p_size")).alias("sensor"))
    return audit.mounts(p.select(child), mapping).select("child", "sensor", "kind")


@query("SELECT CASE WHEN type = 'affects' THEN type ELSE 'link' END AS type, known, count(*) AS n FROM (SELECT 'affects' AS type, false AS known FROM part UNION ALL SELECT 'affects', false FROM part UNION ALL SELECT 'affects', true FROM part WHERE p_size < 25 UNION ALL SELECT 'located_in', false FROM nation) GROUP BY ALL")
def u_graph_edges(spark, d):
    """[U6, U7] Actions that affect a nation (some unknown) and a wildcard; regions are no objects here."""
    wanted = F.parse_json(F.concat(F.lit('["nation.'), _text("p_size"), F.lit('", "region.*"]')))
    located = P.links(P.table(spark, d, "nation"), "located_in", P.key("nation", "n_nationkey"), P.key("region", "n_regionkey"), "n_nationkey")
    c = Catalog(P.nations(spark, d), _actions(P.table(spark, d, "part"), P.key("part", "p_partkey"), affects=wanted), located)
    both = graph.graph_edges(c).withColumn("known", F.lit(False)).unionByName(graph.graph_edges(c, known_only=True).withColumn("known", F.lit(True)))
    return both.groupBy(F.when(F.col("type") == "affects", "affects").otherwise("link").alias("type"), "known").agg(F.count("*").alias("n"))


# Gate ------------------------------------------------------------------------
ONTOLOGY_SQL = """SELECT CASE WHEN l_suppkey % 40 < 25 THEN 'PASS' ELSE 'FAIL' END AS object, CASE WHEN n_regionkey = l_partkey % 5 THEN 'PASS' ELSE 'FAIL' END AS link, CASE WHEN l_linenumber < 5 AND l_orderkey % 2 = 1 THEN 'PASS' ELSE 'FAIL' END AS motion,
CASE WHEN l_partkey % 30 < 25 AND l_quantity BETWEEN l_partkey % 30 % 10 AND l_partkey % 30 % 10 + 20 THEN 'PASS' ELSE 'FAIL' END AS joint FROM lineitem LEFT JOIN nation ON n_nationkey = l_suppkey % 40"""


@query(f"SELECT object, link, motion, joint, count(*) AS n FROM ({ONTOLOGY_SQL}) GROUP BY ALL")
def g_ontology(spark, d):
    """[G8, J19-J22] Predicates on a pack of nations (modes), their regions (links), motions and joints."""
    n, r = P.table(spark, d, "nation"), P.table(spark, d, "region")
    limit = F.struct((F.col("n_nationkey") % 10).cast("double").alias("min"), (F.col("n_nationkey") % 10 + 20).cast("double").alias("max"))
    joints = P._objects(n, "Joint", P.key("joint", "n_nationkey"), "n_nationkey", position_limit=limit)
    motions = P._objects(r, "PresetMotion", P.key("motion", "r_regionkey"), "r_regionkey", motion_value=F.col("r_regionkey"), area_value=F.col("r_regionkey") + 1)
    located = P.links(n, "located_in", P.key("nation", "n_nationkey"), P.key("region", "n_regionkey"), "n_nationkey")
    o = gate.Ontology.of(P.catalog(spark, d, P.union(P.nations(spark, d), joints, motions), located), ROBOT)
    li = P.table(spark, d, "lineitem")
    number = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    params = F.struct(number("nation.", F.col("l_suppkey") % 40).alias("ref"), number("region.", F.col("l_partkey") % 5).alias("target"), F.col("l_linenumber").alias("motion"), (F.col("l_linenumber") + F.col("l_orderkey") % 2).alias("area"), number("joint.", F.col("l_partkey") % 30).alias("joint"), F.col("l_quantity").alias("position"))
    texts = {"object": "@ontology.has_object('Mode', params.ref)", "link": "@ontology.has_link_from('located_in', params.ref, params.target)", "motion": "@ontology.has_preset_motion(params.motion, params.area)", "joint": "@ontology.joint_within_limit(params.joint, params.position)"}
    calls, bound = gate.bind(li.select(F.to_variant_object(params).alias("params"), F.lit(None).cast("variant").alias("state")), preconditions=list(texts.values()))
    return calls.select(*[gate.evaluate(t, o, bound=bound).alias(name) for name, t in texts.items()]).groupBy(*texts).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_quantity % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1")
def g_functions(spark, d):
    """[G11, X3] A registered function called by an expression."""
    gate.register("is_even", lambda n: n.num % 2 == 0)
    calls, bound = gate.bind(_calls(spark, d).where("l_linenumber <> 7"), preconditions=["@fn.is_even(params.quantity)"])
    return calls.select(gate.evaluate("@fn.is_even(params.quantity)", bound=bound).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


FAILED_SQL = f"({PARAM_SQL} + CASE WHEN l_linestatus = 'O' OR abs(l_discount) >= 0.03 THEN 0 ELSE 1 END)"


@query(f"SELECT CASE WHEN f = 0 THEN 'OK' ELSE 'BLOCKED' END AS verdict, CAST(f + w AS BIGINT) AS lines, count(*) AS n FROM (SELECT {FAILED_SQL} AS f, CASE WHEN l_linenumber IN (1, 2, 3) AND l_returnflag <> 'R' THEN 0 ELSE 1 END AS w FROM lineitem) GROUP BY ALL")
def g_summary(spark, d):
    """[G12] The verdict's text has a line per failure and warning."""
    import json

    from .queries import PARAMETERS

    row = (ROBOT, 1, "move", json.dumps(PARAMETERS), json.dumps([PRECONDITIONS[0], PRECONDITIONS[2]]))
    acts = spark.createDataFrame([row], "robot_id string, ord long, id string, parameters string, preconditions string").withColumns({"parameters": F.parse_json("parameters"), "preconditions": F.parse_json("preconditions")})
    found = gate.check(_calls(spark, d).withColumns({"robot_id": F.lit(ROBOT), "action_id": F.lit("move")}), Catalog(P.nations(spark, d), acts, P.located(spark, d)))
    parts = F.split("summary", "\n")
    return found.select(parts[0].alias("verdict"), (F.size(parts) - 1).cast("long").alias("lines")).groupBy("verdict", "lines").agg(F.count("*").alias("n"))


# Rules -----------------------------------------------------------------------
ROBOT_DOCUMENTS = {
    "meta": '{"id": "testbed", "vendor": "MY_VENDOR"}',
    "goals": '{"primary_goal": {"metric": "m", "direction": "max"}}',
    "standard_mappings": '{"standards": [{"id": "a"}, {"id": "b"}]}',
    "boundary": '{"declared_sensors": ["x"], "observability": {"k": 1}}',
}
MORE_RULES = [
    rules.Rule("meta", "must", "robot_meta_field", {"field": "id"}),
    rules.Rule("vendor", "must", "robot_meta_field", {"field": "vendor"}),
    rules.Rule("described", "must", "actions_have_field", {"field": "description", "non_empty": True}),
    rules.Rule("limits", "should", "joints_have_position_limit", {}),
    rules.Rule("clean", "must", "loader_clean", {}),
    rules.Rule("boundary", "should", "capability_boundary", {"min_declarations": 2}),
    rules.Rule("standards", "should", "standard_mappings_count", {"min": 3}),
    rules.Rule("invokers", "must", "action_invokers", {"allowed": ["cli"]}),
    rules.Rule("goals", "must", "goals_defined", {}),
    rules.Rule("policies", "must", "policies_count", {"min": 3}),
    rules.Rule("code", "must", "policies_have_code", {}),
]
MORE_RULES_SQL = """SELECT 'meta' AS rule_id, true AS passed, 1.0::DOUBLE AS observed UNION ALL SELECT 'vendor', false, 0 UNION ALL SELECT 'described', count(*) = 0, count(*) FROM part WHERE p_size % 5 = 0 UNION ALL SELECT 'limits', count(*) = 0, count(*) FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'clean', count(*) = 0, count(*) FROM nation WHERE n_nationkey + 7 NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'boundary', true, 2 UNION ALL SELECT 'standards', false, 2 UNION ALL SELECT 'invokers', count(*) = 0, count(*) FROM part WHERE p_size % 2 = 1
UNION ALL SELECT 'goals', true, 1 UNION ALL SELECT 'policies', count(*) >= 3, count(*) FROM region UNION ALL SELECT 'code', count(*) = 0, count(*) FROM region WHERE r_regionkey = 0"""


def _robot(spark):
    return spark.createDataFrame([(ROBOT, *ROBOT_DOCUMENTS.values())], "robot_id string, " + ", ".join(f"{k} string" for k in ROBOT_DOCUMENTS)).withColumns({k: F.parse_json(k) for k in ROBOT_DOCUMENTS})


@query(MORE_RULES_SQL)
def q_more_rules(spark, d):
    """[Q1, Q5, Q7-Q10, Q13-Q16]"""
    part, region = P.table(spark, d, "part"), P.table(spark, d, "region")
    body = F.to_variant_object(F.struct(F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_name")).alias("description")))
    acts = _actions(part, P.key("part", "p_partkey"), body=body, invoker=F.to_variant_object(F.struct(F.when(F.col("p_size") % 2 == 0, "cli").otherwise("odd").alias("type"))))
    limit = F.when(F.col("s_suppkey") % 4 != 0, F.struct(F.lit(0.0).alias("min"), F.lit(1.0).alias("max")))
    joints = P._objects(P.table(spark, d, "supplier"), "Joint", P.key("joint", "s_suppkey"), "s_suppkey", position_limit=limit)
    dangling = graph.dangling(P.catalog(spark, d, P.nations(spark, d), P.mode_links(spark, d))).select("robot_id", F.lit("error").alias("severity"))
    policies = region.select(F.lit(ROBOT).alias("robot_id"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") != 0, F.col("r_name")).alias("code_path"))
    c = Catalog(joints, acts, P.located(spark, d), dangling, _robot(spark), policies)
    return rules.evaluate(c, MORE_RULES).select("rule_id", "passed", "observed")


UNPROVIDED_SQL = "(SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7))"


@query(f"SELECT (SELECT count(*) FROM {UNPROVIDED_SQL}) || ' capabilities without provides_capability: ' || string_agg('part.' || k, ', ' ORDER BY k) AS detail FROM (SELECT k FROM {UNPROVIDED_SQL} ORDER BY k LIMIT 5)")
def q_missing_detail(spark, d):
    """[W7] The first five ids that a rule misses."""
    some = P.links(P.table(spark, d, "lineitem").where("l_linenumber = 7"), "provides_capability", P.key("supplier", "l_suppkey"), P.key("part", "l_partkey"), "l_orderkey")
    rule = rules.Rule("provided", "must", "capabilities_have_link", {"link_type": "provides_capability", "direction": "in"})
    return rules.evaluate(P.catalog(spark, d, P.parts(spark, d), some), [rule]).select("detail")


@query("SELECT id AS rule_id, severity FROM (VALUES " + ", ".join(f"('{r.id}', '{r.severity}')" for n in ("customer_v1", "learning_v1") for r in rules.load_profile(n)) + ") AS t(id, severity)")
def q_profiles(spark, d):
    """[S24] Every rule of both profiles gives a row for a catalog of nations."""
    c = P.catalog(spark, d, P.nations(spark, d), P.mode_links(spark, d))
    c.robots, c.issues = _robot(spark), spark.createDataFrame([], "robot_id string, severity string")
    c.policies = spark.createDataFrame([], "robot_id string, name string, code_path string")
    both = [rules.evaluate(c, rules.load_profile(n)).select("rule_id", "severity") for n in ("customer_v1", "learning_v1")]
    return both[0].unionByName(both[1])


@query(f"WITH r AS ({RULES_SQL}) SELECT CASE WHEN count(*) FILTER (severity = 'must' AND NOT passed) > 0 THEN 'fail' ELSE 'alpha' END AS grade, CAST(count(*) FILTER (passed) AS BIGINT) AS passed FROM r")
def k_readiness(spark, d):
    """[K9]"""
    c = P.catalog(spark, d, P.union(P.nations(spark, d), P.parts(spark, d)), P.provides(spark, d))
    return rules.readiness(c, RULES).select("grade", (F.col("must_passed") + F.col("should_passed") + F.col("may_passed")).alias("passed"))


# Counts ----------------------------------------------------------------------
@query("SELECT (SELECT count(*) FROM nation) AS objects, (SELECT count(*) FROM nation WHERE n_nationkey + 7 NOT IN (SELECT n_nationkey FROM nation)) + (SELECT count(DISTINCT c_mktsegment) FROM customer) AS errors")
def a_counts_errors(spark, d):
    """[A3] Errors of the loader's checks: dangling links, actions without invoker."""
    c = P.catalog(spark, d, P.nations(spark, d), P.mode_links(spark, d))
    return graph.counts(Catalog(c.objects, c.actions, c.links, pack.validate(c))).select("objects", "errors")


@query("SELECT 'k' AS field, 2 * count(*) AS n FROM events UNION ALL SELECT 'speed', 2 * count(*) FROM events UNION ALL SELECT 'mode', count(*) FROM events")
def a_field_counts(spark, d):
    """[A8] Scalar entries, and fields of scanned messages; private and stop words do not count."""
    head = F.regexp_replace("props", r"\}$", "")
    doc = F.parse_json(F.concat(F.lit('{"/bus/state":'), head, F.lit(',"speed":1.5,"gps":2},"mode":"x","id":3,"list":[1]}')))
    docs = P.table(spark, d, "events").select(F.lit("f").alias("file"), doc.alias("doc"))
    walked = ingest.walk(docs)
    return ingest.field_counts(docs, ingest.signals(ingest.messages(docs, walked)), walked)


@query("SELECT event_type AS step, min(event_id) AS first FROM events WHERE user_id % 3 = 0 GROUP BY 1")
def a_completed_steps(spark, d):
    """[A21]"""
    return audit.completed_steps(P.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("step"), (F.col("user_id") % 3).alias("exit_code")))


@query("SELECT event_id AS seq, event_type AS step FROM events ORDER BY event_id DESC LIMIT 10")
def w_tail(spark, d):
    """[W6]"""
    return audit.tail(P.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("step")))


@query("SELECT severity, count(*) AS n FROM (SELECT severity, row_number() OVER (ORDER BY r DESC, event_id) AS rn FROM (SELECT event_id, 'unknown' AS severity, 0 AS r FROM events UNION ALL SELECT event_id, 'error', 4 FROM events WHERE event_type = 'error')) WHERE rn <= (SELECT count(*) FROM events WHERE event_type = 'error') + 100 GROUP BY 1")
def w_mode_events(spark, d):
    """[W2] Observed modes rank last: they fill what errors leave of the quota, and displace nothing."""
    e = P.table(spark, d, "events")
    payload = F.parse_json(F.concat(F.lit('{"mode":"'), F.col("event_type"), F.lit('"}')))
    msgs = e.select("event_id", F.lit("/a/b").alias("topic"), F.lit("").alias("ts"), payload.alias("payload"))
    modes = ingest.mode_events(ingest.signals(msgs)).select("event_id", "severity")
    errors = e.where("event_type = 'error'").select("event_id", F.lit("error").alias("severity"))
    quota = errors.count() + 100
    return ingest.retain_topk(modes.unionByName(errors), quota, ["event_id"]).groupBy("severity").agg(F.count("*").alias("n"))


# Text and time ---------------------------------------------------------------
@query(f"SELECT line, regexp_extract(text, '\\[(\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d+)?)\\]', 1) AS ts FROM (SELECT *, {CLASS_SQL} AS kind FROM ({LINES_SQL})) WHERE kind IS NOT NULL")
def t_line_timestamp(spark, d):
    """[T2]"""
    return ingest.line_events(P.log_lines(spark, d)).select(F.col("seq.line").alias("line"), "ts")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id || '.7' WHEN 1 THEN 'at ' || user_id WHEN 2 THEN CAST(event_id AS VARCHAR) WHEN 3 THEN event_id || '.0' ELSE '' END AS ts FROM events")
def t_payload_timestamp(spark, d):
    """[T3]"""
    k, i = F.col("event_id") % 5, _text("event_id")
    text = F.when(k == 0, F.concat(F.lit('{"stamp":{"sec":'), i, F.lit(',"nanosec":7}}'))).when(k == 1, F.concat(F.lit('{"timestamp":"at '), _text("user_id"), F.lit('","ts":1}'))).when(k == 2, F.concat(F.lit('{"ts":'), i, F.lit("}"))).when(k == 3, F.concat(F.lit('{"time":{"sec":'), i, F.lit("}}"))).otherwise('{"value":1}')
    return P.table(spark, d, "events").select("event_id", S.payload_timestamp(F.parse_json(text)).alias("ts"))


@query("SELECT topic, msg_type, count(*) AS n FROM (SELECT k LIKE '/%/%' AS topic, NOT k LIKE '/%/%' AND contains(lower(k), 'msg/') AS msg_type FROM (SELECT CASE event_id % 5 WHEN 0 THEN '/bus/' || event_type WHEN 1 THEN '/bus' WHEN 2 THEN 'bus_msgs/Msg/' || event_type WHEN 3 THEN '/a/msg/b' ELSE event_type END AS k FROM events)) GROUP BY ALL")
def t_topic_keys(spark, d):
    """[T6]"""
    k = F.col("event_id") % 5
    key = F.when(k == 0, F.concat(F.lit("/bus/"), "event_type")).when(k == 1, "/bus").when(k == 2, F.concat(F.lit("bus_msgs/Msg/"), "event_type")).when(k == 3, "/a/msg/b").otherwise(F.col("event_type"))
    rows = P.table(spark, d, "events").select(key.alias("key"))
    return rows.select(S.is_topic(F.col("key")).alias("topic"), S.is_msg_type(F.col("key")).alias("msg_type")).groupBy("topic", "msg_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0) ELSE printf('%.1f TB', n / 1099511627776.0) END AS size FROM (SELECT event_id, CAST((2 * event_id + 1) * power(10, event_id % 5 * 2) AS BIGINT) + 2 AS n FROM events)")
def t_human_size(spark, d):
    """[T11]"""
    n = ((2 * F.col("event_id") + 1) * F.pow(F.lit(10.0), F.col("event_id") % 5 * 2)).cast("long") + 2
    return P.table(spark, d, "events").select("event_id", S.human_size(n).alias("size"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN round_even(radians(-p_size), 3) WHEN 1 THEN round_even(radians(-p_size), 3) END AS lo, CASE p_partkey % 3 WHEN 0 THEN round_even(radians(p_size + 10), 3) WHEN 1 THEN round_even(radians(p_size), 3) END AS hi, round_even(radians(p_size), 4) AS rad FROM part")
def t_degrees(spark, d):
    """[T13, T14]"""
    k, size = F.col("p_partkey") % 3, _text("p_size")
    text = F.when(k == 0, F.concat(F.lit("-"), size, F.lit("° ~ "), (F.col("p_size") + 10).cast("string"), F.lit("°"))).when(k == 1, F.concat(F.lit("±"), size, F.lit("°"))).otherwise("free")
    r = S.degree_range(text)
    return P.table(spark, d, "part").select("p_partkey", r["min"].alias("lo"), r["max"].alias("hi"), S.deg_to_rad(F.col("p_size")).alias("rad"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 0.0 ELSE p_size + 0.5 END AS total, CASE p_partkey % 5 WHEN 0 THEN 'roll' WHEN 1 THEN 'pitch' WHEN 2 THEN 'yaw' END AS axis FROM part")
def t_axes(spark, d):
    """[T15, T16]"""
    k = F.col("p_partkey") % 5
    origin = F.when(k != 4, F.concat(F.lit(" 0.5  0 "), _text("p_size")))
    axis = F.when(k == 0, "-1 0 0").when(k == 1, "0 1 0").when(k == 2, "0 0 1").otherwise("0 1 1")
    return P.table(spark, d, "part").select("p_partkey", F.aggregate(S.xyz(origin), F.lit(0.0), lambda a, x: a + x).alias("total"), S.axis_name(S.xyz(axis)).alias("axis"))


@query("SELECT count(*) AS n FROM part WHERE p_partkey % 4 <> 3")
def t_placeholder(spark, d):
    """[T20]"""
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, " ").when(k == 1, F.concat(F.lit("MY_"), "p_name")).when(k == 3, F.concat(F.lit("x"), "p_name"))
    return P.table(spark, d, "part").where(S.is_placeholder(text)).agg(F.count("*").alias("n"))


@query("SELECT event_id, round_even(greatest(-1, least(1, 0.5 * (0.8 * sin(2 * pi() * 2 * value / 100 + 0.3) + 2 * (0.1 - value / 100) - 0.5 * 0.2))), 6) AS a, round_even(greatest(-1, least(1, 0.5 * (1.5 * sin(2 * pi() * 2 * value / 100 + 1) + 2 * (0.4 - value / 50) - 0.5 * 0.1))), 6) AS b FROM events")
def t_controller(spark, d):
    """[T21] Two joints with correction."""
    t = F.col("value") / 100
    pull = S.pd_correction(F.array(F.lit(0.1), F.lit(0.4)), F.array(t, F.col("value") / 50), F.array(F.lit(0.2), F.lit(0.1)), F.lit(2.0), F.lit(0.5))
    out = S.controller(t, F.array(F.lit(0.8), F.lit(1.5)), F.lit(2.0), F.array(F.lit(0.3), F.lit(1.0)), pull, F.lit(0.5))
    return P.table(spark, d, "events").select("event_id", F.bround(out[0], 6).alias("a"), F.bround(out[1], 6).alias("b"))


@query("SELECT event_id, round_even(2 * value + event_id % 3, 6) AS action FROM events")
def x_policy(spark, d):
    """[X4] A policy as code over observations."""
    act = S.policy(lambda observation, parameters, t: [parameters["gain"] * observation[0] + t])
    rows = P.table(spark, d, "events").select("event_id", act(F.array("value"), F.lit('{"gain": 2}'), (F.col("event_id") % 3).cast("double")).alias("a"))
    return rows.select("event_id", F.bround(F.col("a")[0], 6).alias("action"))


# Sources ---------------------------------------------------------------------
@query("SELECT 'd' || doc_id AS file, count(*) FILTER (t <> '') AS lines, CAST(coalesce(sum(i) FILTER (t <> ''), 0) AS BIGINT) AS places FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id HAVING count(*) FILTER (t <> '') > 0")
def s_log_lines(spark, d):
    """[S12, S13] Texts as log files."""
    texts = P.table(spark, d, "documents").select(F.concat(F.lit("d"), _text("doc_id")).alias("file"), F.col("text").alias("value"))
    return session.log_lines(spark, text=texts).groupBy("file").agg(F.count("*").alias("lines"), F.sum("line").alias("places"))


@query(f"SELECT 'log.' || kind AS kind, count(*) AS n FROM (SELECT {CLASS_SQL} AS kind FROM ({LINES_SQL})) WHERE kind IS NOT NULL GROUP BY 1")
def s_session_run(spark, d):
    """[S8, S12] A session folder with one log, written to the shared folder and ingested by format."""
    root = _made(spark, "session")
    P.log_lines(spark, d).select("text").write.mode("overwrite").text(f"{root}/log")
    bits = spark.createDataFrame([], "field string, bit int, ref string, severity string")
    return session.run(spark, root, bits.withColumnRenamed("field", "name"))["kinds"]


@query("SELECT 'Sensor' AS type, count(*) AS n FROM supplier UNION ALL SELECT 'Mode', count(*) FROM nation UNION ALL SELECT 'dangling_ref', count(*) FROM nation WHERE n_nationkey + 7 NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'missing_shard', 1 UNION ALL SELECT 'duplicate_id', 1 UNION ALL SELECT 'links', count(*) FROM nation UNION ALL SELECT 'topics', 0")
def s_pack(spark, d):
    """[S1-S5, S7, S23, S25] A pack written from the tables (packs are folders of small files on the driver) and loaded."""
    root = Path(tempfile.mkdtemp(prefix="graphloom-pack-"))
    home = root / "bed"
    home.mkdir()
    nations = sorted(r["n_nationkey"] for r in P.table(spark, d, "nation").select("n_nationkey").collect())
    sensors = sorted(r["s_suppkey"] for r in P.table(spark, d, "supplier").select("s_suppkey").collect())
    shards = {
        "ontology.yaml": {"robot": {"id": "bed"}, "includes": ["hardware.yaml", "behaviors.yaml", "gone.yaml"]},
        "hardware.yaml": {"objects": [{"type": "Sensor", "id": f"s.{k}"} for k in [*sensors, sensors[0]]]},
        "behaviors.yaml": {"objects": [{"type": "Mode", "id": f"m.{k}"} for k in nations], "links": [{"type": "transitions_to", "source": f"m.{k}", "target": f"m.{k + 7}"} for k in nations]},
    }
    for name, shard in shards.items():
        (home / name).write_text(yaml.safe_dump(shard), "utf-8")
    c = pack.load(spark, *map(str, pack.discover(str(root))))
    found = c.objects.groupBy("type").agg(F.count("*").alias("n")).unionByName(c.issues.groupBy(F.col("code").alias("type")).agg(F.count("*").alias("n")))
    found = found.unionByName(c.links.agg(F.lit("links").alias("type"), F.count("*").alias("n")))
    return found.unionByName(pack.grounding(spark, str(home))["topics"].agg(F.lit("topics").alias("type"), F.count("*").alias("n")))


@query("SELECT count(*) AS frames, round_even(sum(l_quantity), 2) AS sys, round_even(max(l_extendedprice), 2) AS most, CAST((SELECT count(*) FROM lineitem WHERE l_linenumber = 2) AS BIGINT) AS memory FROM lineitem WHERE l_linenumber = 1")
def s_atop(spark, d):
    """[S16] atop's parseable output: CPU, MEM, short and foreign lines."""
    k, n = F.col("l_linenumber"), F.col("l_quantity").cast("string")
    text = F.when(k == 1, F.concat(F.lit("CPU host 17 2024/01/02 03:04:05 10 100 8 "), n, F.lit(" "), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit(" 0 0"))).when(k == 2, F.concat(F.lit("MEM host 17 2024/01/02 03:04:05 10 4096 1000 "), n, F.lit(" 1"))).when(k == 3, "CPU host 17").otherwise("RESET")
    cpu, memory = session.atop_frames(P.table(spark, d, "lineitem").select(text.alias("text")))
    return cpu.agg(F.count("*").alias("frames"), F.bround(F.sum("sys"), 2).alias("sys"), F.bround(F.max("user"), 2).alias("most")).crossJoin(memory.agg(F.count("*").alias("memory")))


def _definitions(spark, d):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(F.lit("float64 x_"), _text("p_size"), F.lit(" = 3  # of "), "p_name")).when(k == 1, "---").when(k == 2, "# comment only").when(k == 3, F.concat(F.lit("string[] names"), _text("p_size"))).otherwise("  geometry/Pose pose")
    return P.table(spark, d, "part").select(F.concat(F.lit("/sdk/pkg/srv/F"), (F.col("p_size") % 4).cast("string"), F.lit(".srv")).alias("file"), F.col("p_partkey").cast("long").alias("line"), text.alias("text"))


@query(
    """WITH l AS (SELECT p_size % 4 AS f, p_partkey AS line, p_partkey % 5 AS k, p_size, p_name FROM part), c AS (SELECT f, min(line) AS cut FROM l WHERE k = 1 GROUP BY f)
SELECT '/sdk/pkg/srv/F' || l.f || '.srv' AS file, line, CASE k WHEN 0 THEN 'float64' WHEN 3 THEN 'string[]' ELSE 'geometry/Pose' END AS type, CASE k WHEN 0 THEN 'x_' || p_size WHEN 3 THEN 'names' || p_size ELSE 'pose' END AS name, CASE WHEN k = 0 THEN '3' END AS "default", CASE WHEN k = 0 THEN 'of ' || p_name END AS comment,
CASE WHEN line > cut THEN 'response' ELSE 'request' END AS part, 'pkg' AS package FROM l LEFT JOIN c ON c.f = l.f WHERE k IN (0, 3, 4)"""
)
def s_service_fields(spark, d):
    """[S18, S19, S20]"""
    return imports.service_fields(_definitions(spark, d)).withColumn("package", imports.package_of(F.col("file")))


@query("SELECT 'f' || p_partkey AS file, '/bus/p' || p_size AS topic, 'State' || p_partkey % 3 AS msg_type, CAST(3 AS BIGINT) AS line, CASE WHEN p_partkey % 2 = 0 THEN 'BEST_EFFORT' END AS reliability FROM part")
def s_topic_uses(spark, d):
    """[T17, S21]"""
    qos = F.when(F.col("p_partkey") % 2 == 0, "\nq = QoSReliabilityPolicy.BEST_EFFORT").otherwise("")
    value = F.concat(F.lit("import x\n\nself.p = node.create_publisher(\n    State"), (F.col("p_partkey") % 3).cast("string"), F.lit(", '/bus/p"), _text("p_size"), F.lit("', 10)"), qos)
    return imports.topic_uses(P.table(spark, d, "part").select(F.concat(F.lit("f"), _text("p_partkey")).alias("file"), value.alias("value"))).select("file", "topic", "msg_type", "line", "reliability")


@query("SELECT 'f' || p_partkey AS file, CAST(0 AS INTEGER) AS row, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def s_markdown(spark, d):
    """[S22] A table per part, with a row of another width."""
    value = F.concat(F.lit("| Name | Size |\n|-|-|\n| "), "p_name", F.lit(" | "), _text("p_size"), F.lit(" |\n| odd |\n"))
    found = imports.markdown_table(P.table(spark, d, "part").select(F.concat(F.lit("f"), _text("p_partkey")).alias("file"), value.alias("value")))
    return found.select("file", "row", F.col("cells")["Name"].alias("name"), F.col("cells")["Size"].alias("size"))


@query("SELECT 'bed.joint.' || side || '_j' || k AS id, side, round_even(radians(-k * 10.0), 4) AS min, round_even(radians(k * 15.0), 4) AS max FROM (SELECT range AS k FROM range(1, 8)), (VALUES ('left'), ('right')) AS s(side)")
def s_joint_table(spark, d):
    """[S26] Joints of both sides."""
    return imports.joint_table(spark, "bed", [(f"j{k}", "pitch", -10.0 * k, 15.0 * k) for k in range(1, 8)]).select("id", "side", "min", "max")


# Streaming plans over bounded input -------------------------------------------
@query("SELECT CAST(epoch_us(date_trunc('hour', ts)) // 1000000 AS BIGINT) AS start, event_type, arg_min(value, ts) AS value FROM events GROUP BY 1, 2")
def r_downsample(spark, d):
    """[R3]"""
    return telemetry.downsample(P.session_events(spark, d), "event_type", "1 hour").select(F.unix_seconds("start").alias("start"), "event_type", "value")


@query(f"SELECT severity, CAST(bit AS INTEGER) AS bit, count(*) AS n FROM ({ACTIVE_SQL}) GROUP BY ALL")
def r_grounded_bits(spark, d):
    """[R5]"""
    k = F.get_json_object("props", "$.k").try_cast("long")
    rows = P.table(spark, d, "events").select("event_id", F.lit("k").alias("field"), F.explode(S.set_bits(k)).alias("bit"))
    return telemetry.grounded_bits(rows, P.bits_table(spark).withColumn("field", F.lit("k"))).groupBy("severity", "bit").agg(F.count("*").alias("n"))


# Readers and writers on files of the shared folder -------------------------------
def _file(spark, name: str, df) -> str:
    """The text column of df as files of the shared folder."""
    path = _made(spark, name)
    df.write.mode("overwrite").text(path)
    return path


@query("SELECT event_type AS kind, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1")
def s_json_lines(spark, d):
    """[S10] Events as JSON lines; every tenth line more is no JSON."""
    e = P.table(spark, d, "events")
    line = F.to_json(F.struct("event_type", "user_id"))
    rows = e.select(line.alias("value")).unionByName(e.where("event_id % 10 = 0").select(F.lit("{broken").alias("value")))
    doc = session.json_lines(spark, _file(spark, "lines", rows))
    return doc.groupBy(prop("event_type", "string", "doc").alias("kind")).agg(F.count("*").alias("n"), F.sum(prop("user_id", "long", "doc")).alias("total"))


@query("SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS key FROM nation UNION ALL SELECT 'not valid JSON', -1")
def s_json_documents(spark, d):
    """[S11] A list of nations as one document, and a broken one as an issue."""
    one = P.table(spark, d, "nation").agg(F.to_json(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("value"))
    docs, broken = session.json_documents(spark, _file(spark, "document", one), _file(spark, "broken", spark.createDataFrame([("{",)], "value string")))
    found = docs.select(prop("n_name", "string", "doc").alias("name"), prop("n_nationkey", "long", "doc").alias("key"))
    return found.unionByName(broken.where("file like '%.txt'").select(F.col("message").alias("name"), F.lit(-1).cast("long").alias("key")))


@query("SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS key FROM region")
def s_yaml_documents(spark, d):
    """[S9] A YAML document per region in one file."""
    text = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("name: "), "r_name", F.lit("\nkey: "), _text("r_regionkey")))), "\n---\n")
    docs = session.yaml_documents(spark, _file(spark, "yaml", P.table(spark, d, "region").agg(text.alias("value"))))
    return docs.where("doc is not null").select(prop("name", "string", "doc").alias("name"), prop("key", "long", "doc").alias("key"))


@query("SELECT '/bus/' || event_type AS topic, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ns, CAST(32 * count(*) AS BIGINT) AS items FROM events GROUP BY 1")
def s_messages(spark, d):
    """[S14, S15] Exported messages; lists are cut to 32 items."""
    payload = F.struct(F.sequence(F.lit(1), F.lit(40)).alias("values"))
    line = F.to_json(F.struct(F.concat(F.lit("/bus/"), "event_type").alias("topic"), F.col("event_id").alias("log_time_ns"), payload.alias("payload")))
    found = session.message_lines(spark, _file(spark, "messages", P.table(spark, d, "events").select(line.alias("value"))))
    return found.groupBy("topic").agg(F.count("*").alias("n"), F.sum("log_time_ns").alias("ns"), F.sum(F.size(F.try_variant_get("payload", "$.values", "array<int>"))).alias("items"))


@query("SELECT 'j' || n_nationkey AS urdf_name, 'l' || n_regionkey AS parent, CASE n_nationkey % 3 WHEN 0 THEN 'roll' WHEN 1 THEN 'pitch' ELSE 'yaw' END AS dof_axis, round_even(-n_nationkey / 7.0, 4) AS lo, CAST(n_nationkey AS DOUBLE) AS hi FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT 'l' || r_regionkey, NULL, NULL, r_regionkey + 0.5, NULL FROM region")
def s_urdf(spark, d):
    """[S17] A robot description of nations (joints, some fixed) and regions (links)."""
    n, k = _text("n_nationkey"), F.col("n_nationkey")
    axis = F.when(k % 3 == 0, "1 0 0").when(k % 3 == 1, "0 1 0").otherwise("0 0 1")
    joint = F.concat(F.lit('<joint name="j'), n, F.lit('" type="'), F.when(k % 4 != 0, "revolute").otherwise("fixed"), F.lit('"><parent link="l'), _text("n_regionkey"), F.lit('"/><child link="c"/><axis xyz="'), axis, F.lit('"/><limit lower="'), (-k / 7.0).cast("string"), F.lit('" upper="'), n, F.lit('" velocity="1" effort="2"/></joint>'))
    link = F.concat(F.lit('<link name="l'), _text("r_regionkey"), F.lit('"><inertial><mass value="'), _text("r_regionkey"), F.lit('.5"/></inertial></link>'))
    nations, regions = P.table(spark, d, "nation"), P.table(spark, d, "region")
    parts = nations.select(joint.alias("p")).unionByName(regions.select(link.alias("p")))
    path = _file(spark, "urdf", parts.agg(F.concat(F.lit("<robot>\n"), F.array_join(F.collect_list("p"), "\n"), F.lit("\n</robot>")).alias("value")))
    joints = imports.urdf_joints(spark, path)[0].select("urdf_name", "parent", "dof_axis", "lo", "hi")
    none = F.lit(None)
    links = imports.urdf_links(spark, path).select(F.col("name_urdf").alias("urdf_name"), none.cast("string").alias("parent"), none.cast("string").alias("dof_axis"), F.col("mass").alias("lo"), none.cast("double").alias("hi"))
    return joints.unionByName(links)


@query("SELECT 'nation.' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'TOTAL', CAST(count(*) AS VARCHAR) FROM nation")
def k_inventory(spark, d):
    """[K5] The written inventory, read back."""
    path = _made(spark, "inventory")
    sinks.inventory(P.catalog(spark, d, P.nations(spark, d), P.located(spark, d)), {"Mode": ["name"]}, path)
    read = spark.read.option("header", True).csv
    overview = read(f"{path}/overview").where("category = 'TOTAL'")
    return read(f"{path}/type=Mode").select("id", "name").unionByName(overview.select(F.col("category").alias("id"), F.col("n").alias("name")))


@query("SELECT '0.2' AS version, (SELECT count(*) FROM events WHERE event_type = 'error') AS events, least((SELECT count(*) FROM events), 201) AS samples, 1::BIGINT AS kinds")
def k_summary(spark, d):
    """[K1] The summary document of a session's tables."""
    e = P.table(spark, d, "events")
    none = F.lit(None).cast("string")
    events = e.where("event_type = 'error'").select(F.lit("").alias("ts"), F.lit("log.error").alias("kind"), F.lit("f").alias("source_file"), F.create_map(F.lit("n"), _text("event_id")).alias("payload"), none.alias("ontology_ref"), F.lit("error").alias("severity"), F.lit(0).cast("long").alias("epoch_ns"), F.col("event_id").alias("seq"))
    samples = e.select(F.lit("a.b").alias("series"), F.lit("").alias("ts"), "value", F.lit("f").alias("file"), _text("event_id").alias("path"))
    tables = {"events": events, "scalars": samples, "kinds": ingest.kind_counts(events), "warnings": spark.createDataFrame([], "file string, message string")}
    text = sinks.summary_document(ROBOT, d, tables)
    size = lambda path: F.size(F.try_variant_get("v", path, "array<variant>")).cast("long")
    doc = text.select(F.parse_json("summary").alias("v"))
    return doc.select(prop("schema_version", "string", "v").alias("version"), size("$.events").alias("events"), F.try_variant_get("v", "$.scalars_timeseries[0].samples_count", "long").alias("samples"), size("$.log_event_counts").alias("kinds"))


@query("SELECT count(DISTINCT p_size % 4) AS services, count(*) FILTER (p_partkey % 5 IN (0, 3, 4)) AS fields, (SELECT count(*) FROM region) AS topics FROM part")
def k_sdk_document(spark, d):
    """[K7] The extraction document of service definitions and topic uses."""
    services = imports.service_fields(_definitions(spark, d))
    topics = P.table(spark, d, "region").select(F.lit("/sdk/a.py").alias("file"), "r_name", F.col("r_name").alias("topic"), F.lit("T").alias("msg_type"))
    text = sinks.sdk_document({"messages": services.limit(0), "services": services, "topics": topics})
    schema = "struct<srv_schemas:array<struct<request_fields:array<struct<name:string>>,response_fields:array<struct<name:string>>>>,topic_inferences:array<struct<topic:string>>>"
    doc = text.select(F.from_json("document", schema).alias("v"))
    count = lambda s: F.size(s["request_fields"]) + F.size(s["response_fields"])
    return doc.select(F.size("v.srv_schemas").cast("long").alias("services"), F.aggregate("v.srv_schemas", F.lit(0), lambda a, s: a + count(s)).cast("long").alias("fields"), F.size("v.topic_inferences").cast("long").alias("topics"))


@query("SELECT event_type AS k, least(count(*), 7) AS n FROM events GROUP BY 1")
def r_first_n(spark, d):
    """[R2] The stateful operator over bounded input: the first seven rows per key, whichever arrive first."""
    rows = P.table(spark, d, "events").select(F.col("event_type").alias("k"), "event_id")
    return telemetry.first_n_stream(rows, "k", 7).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT event_type AS session, 'critical' AS severity, count(*) AS kept, CAST(0 AS BIGINT) AS evicted FROM events WHERE value > 10 GROUP BY 1 ")
def r_retention(spark, d):
    """[R1] The stateful buffer over bounded input: critical events always enter, whatever the quota."""
    rows = P.table(spark, d, "events").where("value > 10").select(F.col("event_type").alias("session"), "event_id", F.lit("critical").alias("severity"))
    changes = telemetry.retain_stream(rows, 3)
    return changes.groupBy("session", "severity").agg(F.count_if(F.col("change") == "kept").alias("kept"), F.count_if(F.col("change") == "evicted").alias("evicted"))
