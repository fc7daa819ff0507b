"""Registered queries of the graph, gate, ingestion, rule and streaming operators, each with DuckDB SQL.

Arrays and maps are shown as text or counts; counts are BIGINT; floats are
rounded half-even; limits only where they are the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import scalars as S
from ..operators import audit, gate, graph, ingest, rules
from ..sinks import graph_json
from ..streaming import telemetry
from . import projection as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Flagship --------------------------------------------------------------------
BITS_SQL = "(VALUES " + ", ".join(f"({b}, 'bit.{b}', '{s}')" for b, s in P.BITS.items()) + ") AS dim(bit, ref, sev)"
ACTIVE_SQL = f"""SELECT e.event_id, e.event_type, b.bit, dim.ref, coalesce(dim.sev, 'unknown') AS severity
FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events) e
CROSS JOIN (SELECT CAST(range AS INTEGER) AS bit FROM range(63)) b LEFT JOIN {BITS_SQL} ON dim.bit = b.bit WHERE (e.k >> b.bit) & 1 = 1"""
RANK_SQL = "CASE severity WHEN 'critical' THEN 5 WHEN 'error' THEN 4 WHEN 'warning' THEN 3 WHEN 'notice' THEN 2 WHEN 'info' THEN 1 WHEN 'nominal' THEN 1 ELSE 0 END"


@query(
    f"""WITH a AS ({ACTIVE_SQL}), e AS (SELECT * FROM a WHERE severity NOT IN ('info', 'nominal')),
r AS (SELECT *, row_number() OVER (ORDER BY {RANK_SQL} DESC, event_id, bit) AS rn, (SELECT count(*) FROM e WHERE severity = 'critical') AS c FROM e WHERE severity <> 'critical'),
kept AS (SELECT severity, bit FROM r WHERE rn <= 5000 - c UNION ALL SELECT severity, bit FROM e WHERE severity = 'critical')
SELECT severity, CAST(bit AS INTEGER) AS bit, count(*) AS n FROM kept GROUP BY ALL"""
)
def b1_session_findings(spark, d):
    """Bits -> grounding -> nominal ones drop -> severity-ranked retention -> counts."""
    events = ingest.bit_events(P.event_bits(spark, d))
    kept = ingest.retain_topk(events, 5000, ["event_id", "bit"])
    return kept.groupBy("severity", "bit").agg(F.count("*").alias("n"))


# Lookups ---------------------------------------------------------------------
@query("SELECT 'nation.' || n_nationkey AS id, n_name AS name FROM nation")
def f_objects_of_type(spark, d):
    c = P.catalog(spark, d, P.union(P.regions(spark, d), P.nations(spark, d)), P.located(spark, d))
    return graph.list_objects(graph.objects_of_type(c, "Mode")).select("id", "name")


@query("SELECT 'customer.' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def f_where_nullsafe(spark, d):
    objects = P.union(P.customers(spark, d), P.suppliers(spark, d))
    return graph.where(objects, "Customer", segment="BUILDING", nation=3, nickname=None).select("id")


@query("SELECT id, min(CASE WHEN p = 0 THEN 'Capability' ELSE 'Action' END) AS kind, count(*) AS n FROM (SELECT 'part.' || p_partkey AS id, 0 AS p FROM part WHERE p_size <= 30 UNION ALL SELECT 'part.' || p_partkey, 1 FROM part WHERE p_size > 30) GROUP BY id")
def f_get_precedence(spark, d):
    """Ids of parts that are objects up to size 30; all parts are actions too; objects win."""
    parts = P.parts(spark, d)
    none = F.lit(None).cast("variant")
    actions = parts.select("robot_id", "ord", "id", F.lit("x").alias("description"), F.lit("INFO").alias("safety_class"), F.lit(True).alias("idempotent"), *[none.alias(n) for n in ("invoker", "parameters", "preconditions", "affects", "affects_by_domain", "body")])
    c = Catalog(parts.where("try_variant_get(props, '$.size', 'int') <= 30"), actions, P.provides(spark, d).limit(0))
    return graph.resolve(c).groupBy("id").agg(F.min("type").alias("kind"), F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT 'part.' || (l_partkey * 2) AS id FROM lineitem) WHERE id IN (SELECT 'part.' || p_partkey FROM part)")
def f_exists(spark, d):
    ids = P.table(spark, d, "lineitem").select(F.lit(P.ROBOT).alias("robot_id"), F.concat(F.lit("part."), (F.col("l_partkey") * 2).cast("string")).alias("id")).distinct()
    return graph.exists(P.catalog(spark, d, P.parts(spark, d), P.located(spark, d)), ids).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'")
def f_optional_filters(spark, d):
    return graph.optional_filters(P.table(spark, d, "part"), p_brand="Brand#2", p_type="ECONOMY", p_size=None).select("p_partkey", "p_size")


@query("SELECT 'act_' || lower(c_mktsegment) AS id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'MOTION' WHEN 'BUILDING' THEN 'INFO' ELSE 'UNKNOWN' END AS safety_class, false AS idempotent, CAST(0 AS BIGINT) AS n_parameters FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def f_action_listing(spark, d):
    c = P.catalog(spark, d, P.regions(spark, d), P.located(spark, d))
    return graph.list_actions(c).select("id", "safety_class", "idempotent", F.size("parameters").cast("long").alias("n_parameters"))


@query("SELECT 'supplier.' || s_suppkey AS id, left(CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE s_name END, 50) AS label FROM supplier")
def f_label_coalesce(spark, d):
    return P.suppliers(spark, d).select("id", graph.label_of(F.col("type")).alias("label"))


@query("SELECT 'part.' || p_partkey AS id, k AS key, CASE k WHEN 'name_human' THEN p_name WHEN 'capability_kind' THEN p_brand WHEN 'produces_count' THEN '1' WHEN 'produces_sample' THEN left(p_type, 72) WHEN 'detects_count' THEN '1' WHEN 'detects_sample' THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS value FROM part, (VALUES ('name_human'), ('capability_kind'), ('produces_count'), ('produces_sample'), ('detects_count'), ('detects_sample'), ('size')) AS t(k)")
def f_flat_props(spark, d):
    return graph.flat_props(P.parts(spark, d)).select("id", "key", "value")


@query("SELECT mode_value, 'nation.' || min(n_nationkey) AS mode_id FROM (SELECT *, 'M' || (n_nationkey % 10) AS mode_value FROM nation) GROUP BY mode_value")
def f_mode_by_value(spark, d):
    c = P.catalog(spark, d, P.nations(spark, d), P.located(spark, d))
    return graph.modes_by_value(c).select("mode_value", "mode_id")


@query("SELECT DISTINCT 'M' || (c_custkey % 13) AS ref, CASE WHEN c_custkey % 13 < 10 THEN 'nation.' || (c_custkey % 13) ELSE 'M' || (c_custkey % 13) END AS resolved FROM customer")
def f_resolve_mode(spark, d):
    c = P.catalog(spark, d, P.nations(spark, d), P.located(spark, d))
    refs = P.table(spark, d, "customer").select(F.lit(P.ROBOT).alias("robot_id"), F.concat(F.lit("M"), (F.col("c_custkey") % 13).cast("string")).alias("ref")).distinct()
    return graph.resolve_refs(c, refs, "ref").select("ref", "resolved")


@query("SELECT 'nation.3' AS id, 'object' AS kind")
def f_explain(spark, d):
    return graph.explain(P.catalog(spark, d, P.nations(spark, d), P.located(spark, d)), "nation.3").select("id", "kind")


# Joins -----------------------------------------------------------------------
@query("SELECT 'part.' || l_partkey AS capability, count(*) AS links, count(DISTINCT l_suppkey) AS providers FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey")
def j_providers(spark, d):
    c = P.catalog(spark, d, P.suppliers(spark, d), P.provides(spark, d))
    return graph.capability_providers(c).groupBy("capability").agg(F.count("*").alias("links"), F.count_distinct("provider").alias("providers"))


@query("SELECT 'part.' || l_partkey AS capability, count(*) AS interfaces FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' GROUP BY l_partkey")
def j_interfaces(spark, d):
    c = P.catalog(spark, d, P.orders(spark, d, closed_only=True), P.exposed(spark, d))
    return graph.capability_interfaces(c).groupBy("capability").agg(F.count("*").alias("interfaces"))


@query("SELECT 'nation.' || n_nationkey AS capability, count(*) AS parameters FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def j_parameters(spark, d):
    has = P.links(P.table(spark, d, "customer"), "has_parameter", P.key("nation", "c_nationkey"), P.key("customer", "c_custkey"), "c_custkey")
    return graph.capability_parameters(P.catalog(spark, d, P.customers(spark, d), has)).groupBy("capability").agg(F.count("*").alias("parameters"))


@query(
    """WITH p AS (SELECT l_partkey AS k, string_agg('supplier.' || l_suppkey, ',' ORDER BY 'supplier.' || l_suppkey) AS providers, count(*) AS n_providers FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
i AS (SELECT l_partkey AS k, count(*) AS n_interfaces FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT 'part.' || p_partkey AS capability, p_name AS name, p_brand AS kind, coalesce(n_providers, 0) AS n_providers, coalesce(providers, '') AS providers, coalesce(n_interfaces, 0) AS n_interfaces
FROM part LEFT JOIN p ON p.k = p_partkey LEFT JOIN i ON i.k = p_partkey WHERE p_brand = 'Brand#2'"""
)
def j_affordance_menu(spark, d):
    c = P.catalog(spark, d, P.union(P.parts(spark, d), P.suppliers(spark, d), P.orders(spark, d)), P.union(P.provides(spark, d), P.exposed(spark, d)))
    menu = graph.capability_summary(c, kind="Brand#2", include_readonly=False)
    size = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
    return menu.select("capability", "name", "kind", size("providers").alias("n_providers"), F.coalesce(F.array_join("providers", ","), F.lit("")).alias("providers"), size("interfaces").alias("n_interfaces"))


@query(
    """SELECT capability, reasons FROM (SELECT 'part.' || p_partkey AS capability, concat_ws('|', CASE WHEN p_partkey = 5 THEN 'capability_id_required' END, CASE WHEN p_brand = 'Brand#2' THEN 'capability_kind_required' END, CASE WHEN p_type = 'ECONOMY' THEN 'required_output_match' END) AS reasons FROM part) WHERE reasons <> ''"""
)
def j_service_fit(spark, d):
    c = P.catalog(spark, d, P.parts(spark, d), P.located(spark, d))
    fit = graph.service_fit(c, required_capabilities=["Brand#2", "part.5"], required_outputs=["ECONOMY"])
    return fit.select("capability", F.array_join("reasons", "|").alias("reasons"))


@query("SELECT 'part.' || p_partkey AS id FROM part WHERE p_brand = 'Brand#3' AND p_size = 7 AND p_partkey IN (SELECT l_partkey FROM lineitem)")
def j_find_capabilities(spark, d):
    any_supplier = P.provides(spark, d).select("robot_id", "ord", "type", F.lit("supplier.0").alias("source"), "target", "attrs")
    c = P.catalog(spark, d, P.union(P.parts(spark, d), P.suppliers(spark, d)), any_supplier)
    return graph.find_capabilities(c, capability_kind="Brand#3", detects="7", provider="supplier.0").select("id")


@query("SELECT 'nation.' || c_nationkey AS mode, 'act_' || lower(c_mktsegment) AS action, count(*) AS n FROM customer GROUP BY ALL")
def j_mode_allowed(spark, d):
    return graph.actions_in_mode(P.catalog(spark, d, P.nations(spark, d), P.mode_links(spark, d))).groupBy("mode", "action").agg(F.count("*").alias("n"))


@query("SELECT 'nation.' || c_nationkey AS mode, 'act_' || lower(c_mktsegment) AS action, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY ALL")
def j_mode_forbidden(spark, d):
    return graph.actions_in_mode(P.catalog(spark, d, P.nations(spark, d), P.mode_links(spark, d)), allowed=False).groupBy("mode", "action").agg(F.count("*").alias("n"))


@query("SELECT 'nation.' || a.n_nationkey AS mode, 'M' || (b.n_nationkey % 10) AS next FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 7")
def j_transitions(spark, d):
    return graph.transitions(P.catalog(spark, d, P.nations(spark, d), P.mode_links(spark, d))).select("mode", "next")


@query("SELECT 'region.' || n_regionkey AS target, 'nation.' || n_nationkey AS event FROM nation")
def j_events_indicating(spark, d):
    n = P.links(P.table(spark, d, "nation"), "indicates", P.key("nation", "n_nationkey"), P.key("region", "n_regionkey"), "n_nationkey")
    return graph.events_indicating(P.catalog(spark, d, P.nations(spark, d), n)).select("target", "event")


@query(
    """WITH t AS (SELECT 'region.' || n_regionkey || '.nation.' || n_nationkey || '.customer.' || c_custkey AS target, n_regionkey AS r, n_nationkey AS n, c_custkey AS c FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT action_id, count(*) AS n FROM (SELECT 'all_' || r AS action_id, target FROM t UNION ALL SELECT 'nation_' || n, target FROM t WHERE n % 2 = 0 UNION ALL SELECT 'one_7', target FROM t WHERE c = 7) GROUP BY action_id"""
)
def j_wildcard_impact(spark, d):
    n = P.table(spark, d, "nation")
    nation = F.concat(F.lit("region."), F.col("n_regionkey").cast("string"), F.lit(".nation."), F.col("n_nationkey").cast("string"))
    target = P.table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat(nation, F.lit(".customer."), F.col("c_custkey").cast("string")).alias("target"), "c_custkey")
    row = lambda df, action, pattern: df.select(F.lit(P.ROBOT).alias("robot_id"), action.alias("action_id"), pattern.alias("pattern"))
    regions = P.table(spark, d, "region")
    patterns = row(regions, F.concat(F.lit("all_"), F.col("r_regionkey").cast("string")), F.concat(F.lit("region."), F.col("r_regionkey").cast("string"), F.lit(".*")))
    patterns = patterns.unionByName(row(n.where("n_nationkey % 2 = 0"), F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")), F.concat(nation, F.lit(".*"))))
    patterns = patterns.unionByName(row(target.where("c_custkey = 7"), F.lit("one_7"), F.col("target")))
    return graph.affecting(patterns, target.select("target")).groupBy("action_id").agg(F.count("*").alias("n"))


@query("SELECT 'transitions_to' AS type, 'target' AS side, 'nation.' || (n_nationkey + 7) AS \"end\" FROM nation WHERE n_nationkey + 7 NOT IN (SELECT n_nationkey FROM nation)")
def j_dangling(spark, d):
    c = P.catalog(spark, d, P.nations(spark, d), P.mode_links(spark, d))
    return graph.dangling(c).select("type", "side", "end")


@query("SELECT 'act_' || lower(c_mktsegment) AS id FROM (SELECT DISTINCT c_mktsegment FROM customer) WHERE c_mktsegment < 'C'")
def j_collision(spark, d):
    c = P.catalog(spark, d, P.regions(spark, d), P.located(spark, d))
    twice = c.actions.where("id < 'act_c'").select("robot_id", "ord", "id", F.lit("X").alias("type"), F.lit(None).cast("variant").alias("props"), F.lit(None).cast("variant").alias("source"))
    return graph.collisions(Catalog(P.union(c.objects, twice), c.actions, c.links)).select("id")


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN p_partkey IS NOT NULL AND p_size <= 40 AND l_quantity BETWEEN p_size AND p_size + 20 THEN 1 ELSE 0 END) AS BIGINT) AS within FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_returnflag")
def j_range_limit(spark, d):
    """Values within the limits of their joint; parts over size 40 have none."""
    limits = P.table(spark, d, "part").where("p_size <= 40").select("p_partkey", F.col("p_size").alias("lo"), (F.col("p_size") + 20).alias("hi"))
    rows = P.table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_returnflag").join(limits, F.col("p_partkey") == F.col("l_partkey"), "left")
    within = F.coalesce(F.col("l_quantity").between(F.col("lo"), F.col("hi")), F.lit(False))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(within).alias("within"))


@query(f"SELECT severity, CAST(bit AS INTEGER) AS bit, coalesce(ref, '') AS ontology_ref, count(*) AS n FROM ({ACTIVE_SQL}) GROUP BY ALL")
def j_bits_grounded(spark, d):
    return P.event_bits(spark, d).groupBy("severity", "bit", F.coalesce("ontology_ref", F.lit("")).alias("ontology_ref")).agg(F.count("*").alias("n"))


@query(f"SELECT CAST(bit AS INTEGER) AS bit, count(*) AS n FROM ({ACTIVE_SQL}) WHERE severity IN ('info', 'nominal') GROUP BY bit")
def a_nominal_bits(spark, d):
    return ingest.nominal_bits(P.event_bits(spark, d).withColumn("name", F.lit("k"))).select("bit", "n")


@query(f"SELECT event_id, dim.bit, ref FROM (SELECT *, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events) e, {BITS_SQL} WHERE (k >> dim.bit) & 1 = 1")
def j_bitmap_explain(spark, d):
    values = P.table(spark, d, "events").select("event_id", F.lit("k").alias("field"), F.get_json_object("props", "$.k").try_cast("long").alias("value"))
    return ingest.explain_bitmap(values, P.bits_table(spark).withColumn("field", F.lit("k"))).select("event_id", "bit", "ref")


REGISTERED = ("click", "view", "login", "logout")


@query(f"WITH o AS (SELECT event_type AS topic, count(*) AS n FROM events GROUP BY 1), r AS (SELECT unnest({list(REGISTERED)}) AS topic) SELECT coalesce(o.topic, r.topic) AS topic, coalesce(n, 0) AS n, CASE WHEN o.topic IS NULL THEN 'unobserved' WHEN r.topic IS NULL THEN 'unregistered' ELSE 'registered' END AS status FROM o FULL JOIN r ON o.topic = r.topic")
def j_coverage_full_outer(spark, d):
    seen = P.table(spark, d, "events").groupBy(F.col("event_type").alias("topic")).agg(F.count("*").alias("n"))
    return ingest.coverage(seen, spark.createDataFrame([(t,) for t in REGISTERED], "topic string"), "topic")


@query("SELECT n_nationkey AS k, 'left' AS side FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT DISTINCT l_suppkey, 'right' FROM lineitem WHERE l_suppkey NOT IN (SELECT n_nationkey FROM nation)")
def u_set_ops(spark, d):
    left = P.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    suppliers = P.table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    right = P.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"))
    a = audit.set_diff(left, suppliers, "k").where("side = 'left'")
    return a.unionByName(audit.set_diff(left, right, "k").where("side = 'right'"))


@query("SELECT 'objects' AS part, count(*) AS n FROM (SELECT 'n.' || n_nationkey AS id FROM nation UNION SELECT 'n.' || s_nationkey FROM supplier) UNION ALL SELECT 'both', count(*) FROM (SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier)")
def u_known_ids(spark, d):
    ids = lambda t, k: P.table(spark, d, t).select(F.lit(P.ROBOT).alias("robot_id"), P.key("n", k).alias("id"))
    c = Catalog(ids("nation", "n_nationkey"), ids("supplier", "s_nationkey").distinct(), P.located(spark, d))
    n = graph.known_ids(c).agg(F.lit("objects").alias("part"), F.count("*").alias("n"))
    return n.unionByName(graph.collisions(c).agg(F.lit("both").alias("part"), F.count("*").alias("n")))


@query(
    """WITH u AS (SELECT 'u' || p_partkey AS urdf_name, p_partkey AS k, p_size AS lo, p_size + 10 AS hi, p_size % 7 AS effort FROM part), e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS lo, p_size + 10 AS hi, p_size % 3 AS torque FROM part WHERE p_partkey % 2 = 0)
SELECT kind, count(*) AS n FROM (SELECT 'no_mapping' AS kind FROM u WHERE k % 3 = 0 UNION ALL SELECT 'position_limit' FROM u JOIN e ON u.k = e.k WHERE u.k % 3 <> 0 AND (u.lo <> e.lo OR u.hi <> e.hi) UNION ALL SELECT 'effort' FROM u JOIN e ON u.k = e.k WHERE u.k % 3 <> 0 AND abs(effort - torque) > 1) GROUP BY kind"""
)
def j_merge_diff(spark, d):
    p = P.table(spark, d, "part")
    dbl = lambda x: x.cast("double")
    imported = p.select(P.key("u", "p_partkey").alias("urdf_name"), dbl(F.col("p_size")).alias("lo"), dbl(F.col("p_size") + 10).alias("hi"), dbl(F.col("p_size") % 7).alias("effort"))
    imported = imported.withColumn("urdf_name", F.replace("urdf_name", F.lit("u."), F.lit("u")))
    existing = p.where("p_partkey % 2 = 0").select(P.key("joint", "p_partkey").alias("id"), dbl(F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).alias("lo"), dbl(F.col("p_size") + 10).alias("hi"), dbl(F.col("p_size") % 3).alias("torque_peak"), F.col("p_name").alias("name_human"))
    names = p.where("p_partkey % 3 <> 0").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("urdf_name"), P.key("joint", "p_partkey").alias("id"))
    return audit.diffs_by_kind(audit.merge_joints(imported, existing, names)[1])


@query(
    """WITH b AS (SELECT 'f' || item_id AS path, sha256(text) AS h FROM benchmark WHERE item_id % 4 <> 0), a AS (SELECT 'f' || item_id AS path, sha256(CASE WHEN item_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM benchmark WHERE item_id % 7 <> 0)
SELECT coalesce(b.path, a.path) AS path, b.h AS before, a.h AS after FROM b FULL JOIN a ON a.path = b.path WHERE b.h IS DISTINCT FROM a.h"""
)
def j_snapshot_diff(spark, d):
    t = P.table(spark, d, "benchmark")
    files = lambda df, text: audit.snapshot(df.select(F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("path"), text.cast("binary").alias("content")))
    after = F.when(F.col("item_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return audit.snapshot_diff(files(t.where("item_id % 4 <> 0"), F.col("text")), files(t.where("item_id % 7 <> 0"), after))


@query("SELECT sha256(string_agg('f' || item_id || sha256(text), '' ORDER BY 'f' || item_id)) AS pack_hash FROM benchmark")
def a_pack_hash(spark, d):
    t = P.table(spark, d, "benchmark").select(F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))
    return audit.pack_hash(audit.snapshot(t))


# Counts ----------------------------------------------------------------------
@query("SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS objects, CAST(2 AS BIGINT) AS types, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS actions, (SELECT count(*) FROM lineitem) AS links")
def a_counts(spark, d):
    c = P.catalog(spark, d, P.union(P.nations(spark, d), P.suppliers(spark, d)), P.provides(spark, d))
    return graph.counts(c).select("objects", "types", "actions", "links")


@query("SELECT 'Mode' AS type, count(*) AS n FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Capability', count(*) FROM part")
def a_counts_by_type(spark, d):
    c = P.catalog(spark, d, P.union(P.nations(spark, d), P.customers(spark, d), P.parts(spark, d)), P.provides(spark, d))
    return graph.counts_by_type(c).select("type", "n")


@query("WITH e AS (SELECT 'supplier.' || l_suppkey AS id FROM lineitem UNION ALL SELECT 'part.' || l_partkey FROM lineitem), g AS (SELECT id, count(*) AS n FROM e GROUP BY id), o AS (SELECT 'supplier.' || s_suppkey AS id FROM supplier UNION ALL SELECT 'part.' || p_partkey FROM part) SELECT o.id, coalesce(n, 0) AS degree FROM o LEFT JOIN g ON g.id = o.id")
def a_degree(spark, d):
    return graph.degrees(P.union(P.parts(spark, d), P.suppliers(spark, d)), P.provides(spark, d)).select("id", F.col("degree").cast("long").alias("degree"))


@query("WITH t AS (SELECT 'behavior' AS category, 'Mode' AS type, count(*) AS n FROM nation UNION ALL SELECT 'hardware', 'Sensor', count(*) FROM supplier UNION ALL SELECT 'hardware', 'Customer', count(*) FROM customer UNION ALL SELECT 'interface', 'Topic', count(*) FROM orders) SELECT category, CAST(sum(n) AS BIGINT) AS n, string_agg(type, ', ' ORDER BY type) AS types FROM t GROUP BY category UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), '' FROM t")
def a_rollup_total(spark, d):
    c = P.catalog(spark, d, P.union(P.nations(spark, d), P.suppliers(spark, d), P.customers(spark, d), P.orders(spark, d)), P.located(spark, d))
    return graph.category_rollup(c)


KIND_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(x, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{kind[0]}'" for words, kind in graph.KIND_RULES) + " WHEN s = 'MOTION' THEN 'motion_execution' ELSE 'information_or_configuration' END"


@query(f"SELECT {KIND_SQL} AS kind_id, count(*) AS n FROM (SELECT lower('act' || p_partkey || ' ' || CASE p_partkey % 8 WHEN 0 THEN 'set Velocity' WHEN 1 THEN 'joint state' WHEN 2 THEN 'gripper' WHEN 3 THEN 'mute' WHEN 4 THEN 'input_source' WHEN 5 THEN 'mode' ELSE p_name END) AS x, CASE WHEN p_size > 25 THEN 'MOTION' ELSE 'INFO' END AS s FROM part) GROUP BY 1")
def a_infer_kind(spark, d):
    words = F.when(F.col("p_partkey") % 8 == 0, "set Velocity")
    for k, w in enumerate(("joint state", "gripper", "mute", "input_source", "mode"), 1):
        words = words.when(F.col("p_partkey") % 8 == k, w)
    kind = graph.kind_of_action(F.concat(F.lit("act"), F.col("p_partkey").cast("string")), words.otherwise(F.col("p_name")), F.when(F.col("p_size") > 25, "MOTION").otherwise("INFO"))
    return P.table(spark, d, "part").select(kind.alias("k")).groupBy(F.col("k.kind_id").alias("kind_id")).agg(F.count("*").alias("n"))


FRAMES_SQL = "SELECT CASE WHEN l_linenumber = 7 THEN 200 ELSE 1 END AS i, 100 AS t, 8 AS c, l_quantity * 10 AS s, l_tax * 5000 AS u FROM lineitem"


@query(
    f"""WITH f AS (SELECT *, 100 * (s + u) / (t * i * c) AS b FROM ({FRAMES_SQL})), g AS (SELECT b, row_number() OVER (ORDER BY b) AS rn, count(*) OVER () AS n FROM f WHERE i <= 120 AND b BETWEEN 0 AND 100)
SELECT max(n) AS frames, round_even(max(b), 1) AS busy_max, round_even(avg(b), 1) AS busy_avg, count(*) FILTER (b > 80) AS high_frames, round_even(max(b) FILTER (rn = CAST(floor(n * 0.95) AS BIGINT) + 1), 1) AS busy_p95, (SELECT count(*) FROM f WHERE i > 120 OR b > 100 OR b < 0) AS skipped FROM g"""
)
def a_cpu_p95(spark, d):
    f = P.table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 7, 200).otherwise(1).alias("interval"), F.lit(100).alias("ticks"), F.lit(8).alias("cpus"), (F.col("l_quantity") * 10).alias("sys"), (F.col("l_tax") * 5000).alias("user"))
    return ingest.cpu_summary(f)


@query("SELECT count(*) AS frames, round_even(max(100 * (p_retailprice - p_size) / p_retailprice), 1) AS used_max, round_even(avg(100 * (p_retailprice - p_size) / p_retailprice), 1) AS used_avg FROM part")
def a_mem(spark, d):
    return ingest.memory_summary(P.table(spark, d, "part").select(F.col("p_retailprice").alias("total"), F.col("p_size").alias("free")))


@query("WITH t AS (SELECT event_type || CASE WHEN user_id % 5 = 0 THEN '/Image_raw' ELSE '/state' END AS topic, count(*) AS n FROM events GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS messages, count(*) AS topics, CAST(sum(CASE WHEN topic NOT LIKE '%/Image_raw' THEN least(n, 200) ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN topic LIKE '%/Image_raw' THEN 1 ELSE 0 END) AS BIGINT) AS private_topics, CAST(sum(CASE WHEN topic LIKE '%/Image_raw' THEN n ELSE 0 END) AS BIGINT) AS private_messages FROM t")
def a_message_stats(spark, d):
    topic = F.concat("event_type", F.when(F.col("user_id") % 5 == 0, "/Image_raw").otherwise("/state"))
    return ingest.message_stats(P.table(spark, d, "events").select(topic.alias("topic")))


@query("WITH f AS (SELECT source AS directory, octet_length(encode(text)) AS b, length(text) - length(replace(text, chr(10), '')) + 1 AS l FROM documents) SELECT directory, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(l) AS BIGINT) AS lines FROM f GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), CAST(sum(b) AS BIGINT), CAST(sum(l) AS BIGINT) FROM f")
def a_file_stats(spark, d):
    f = P.table(spark, d, "documents").select(F.col("source").alias("directory"), F.octet_length("text").cast("long").alias("bytes"), F.size(F.split("text", "\n")).cast("long").alias("lines"))
    return ingest.file_stats(f)


# Order and retention ---------------------------------------------------------
SESSION_SQL = "SELECT event_id, event_type, user_id, value, ts, CASE WHEN event_type = 'error' AND value > 20 THEN 'critical' ELSE CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'notice' WHEN 'signup' THEN 'warning' WHEN 'view' THEN 'info' ELSE 'unknown' END END AS severity FROM events"


@query(f"WITH e AS ({SESSION_SQL}), r AS (SELECT *, row_number() OVER (ORDER BY {RANK_SQL} DESC, event_id) AS rn, (SELECT count(*) FROM e WHERE severity = 'critical') AS c FROM e WHERE severity <> 'critical') SELECT event_id, severity FROM r WHERE rn <= 5000 - c UNION ALL SELECT event_id, severity FROM e WHERE severity = 'critical'")
def w_retain_topk(spark, d):
    return ingest.retain_topk(P.session_events(spark, d), 5000, ["event_id"]).select("event_id", "severity")


@query()
def w_retain_exact(spark, d):
    """The sequential buffer per user, 20 events each; held against a simple fold in the tests."""
    e = P.session_events(spark, d).select("user_id", "event_id", "severity")
    return ingest.retain_exact(e, 20, "event_id", "user_id")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 200")
def w_first_n(spark, d):
    return ingest.first_n(P.table(spark, d, "events").select("event_type", "event_id"), ["event_type"], ["event_id"])


@query("SELECT event_type AS series, least(count(*), 201) AS samples, count(*) >= 200 AS downsampled FROM events GROUP BY 1")
def w_series_cap(spark, d):
    samples = P.table(spark, d, "events").select(F.col("event_type").alias("series"), "event_id", "value")
    return ingest.series_cap(samples, ["event_id"])[1]


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, min(event_id) LIMIT 20")
def w_topk_common(spark, d):
    return ingest.top_k(P.table(spark, d, "events"), "user_id", "event_id", 20).select("user_id", "n")


# Text and time ---------------------------------------------------------------
TS_SQL = "'[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] '"
LINES_SQL = f"""SELECT event_id AS line, CASE event_id % 11 WHEN 0 THEN {TS_SQL} || 'motor overcurrent on axis ' || user_id WHEN 1 THEN 'Emergency-Stop pressed' WHEN 2 THEN {TS_SQL} || 'battery low ' || CAST(value AS DECIMAL(18,2)) WHEN 3 THEN 'link fault: code ' || user_id WHEN 4 THEN 'Connection TIMEOUT to peer' WHEN 5 THEN 'mode switch to ' || event_type WHEN 6 THEN {TS_SQL} || '[ERROR] ' || repeat('x', CAST(user_id % 9 * 1000 AS INTEGER)) WHEN 7 THEN 'level|warn: slow' WHEN 8 THEN 'writeError handled by fail_evt_hdlr' WHEN 9 THEN 'mode change from ' || repeat('y', CAST(user_id % 7 * 100 AS INTEGER)) ELSE {TS_SQL} || event_type END AS text FROM events"""
CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for p, k, *_ in S.LOG_PATTERNS) + " END"
SEVERITY_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{s}'" for _, k, s, _ in S.LOG_PATTERNS) + " END"


@query(f"SELECT 'log.' || kind AS kind, {SEVERITY_SQL} AS severity, count(*) AS n FROM (SELECT {CLASS_SQL} AS kind FROM ({LINES_SQL})) WHERE kind IS NOT NULL GROUP BY ALL")
def t_classify_lines(spark, d):
    return ingest.line_events(P.log_lines(spark, d)).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query(f"SELECT line, CASE WHEN length(text) < most THEN text ELSE left(text, most - 3) || '...' END AS clipped FROM (SELECT line, text, CASE WHEN kind = 'mode_transition' THEN 500 ELSE 4000 END AS most FROM (SELECT *, {CLASS_SQL} AS kind FROM ({LINES_SQL})) WHERE kind IS NOT NULL)")
def t_clip(spark, d):
    e = ingest.line_events(P.log_lines(spark, d))
    return e.select(F.col("payload")["line"].cast("long").alias("line"), F.col("payload")["text"].alias("clipped"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000000 WHEN 1 THEN epoch_us(ts) * 1000 WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000000 WHEN 3 THEN epoch_us(ts) // 1000 * 1000000 END AS ns FROM events")
def t_ts_normalise(spark, d):
    ts = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")).when(k == 2, F.unix_seconds(ts).cast("string")).when(k == 3, F.unix_millis(ts).cast("string")).otherwise("yesterday")
    return P.table(spark, d, "events").select("event_id", S.epoch_ns(text).alias("ns"))


PRIVATE_SQL = "|".join(S.PRIVATE_FIELDS)


@query(f"SELECT name, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'Front_Image' WHEN 1 THEN 'user_id' WHEN 2 THEN 'motor_temp' ELSE event_type END AS name FROM events) WHERE NOT regexp_matches(name, '(?i){PRIVATE_SQL}') GROUP BY name")
def t_privacy(spark, d):
    k = F.col("event_id") % 4
    name = F.when(k == 0, "Front_Image").when(k == 1, "user_id").when(k == 2, "motor_temp").otherwise(F.col("event_type"))
    return P.table(spark, d, "events").select(name.alias("name")).where(~S.is_private_field(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT path, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT '$./bus/state' AS path, CAST(NULL AS BIGINT) AS v FROM events UNION ALL SELECT '$./bus/state.k', CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) FROM events UNION ALL SELECT '$.ids', NULL FROM events UNION ALL SELECT '$.ids[0]', event_id FROM events UNION ALL SELECT '$.ids[1]', user_id FROM events) GROUP BY path")
def t_walk_document(spark, d):
    doc = F.parse_json(F.concat(F.lit('{"/bus/state":'), F.col("props"), F.lit(',"ids":['), F.col("event_id").cast("string"), F.lit(","), F.col("user_id").cast("string"), F.lit("]}")))
    walked = ingest.walk(P.table(spark, d, "events").select(doc.alias("doc")), depth=3)
    return walked.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.try_variant_get("value", "$", "long")).alias("total"))


@query("SELECT '/bus/state.motor.temp' AS series, count(*) AS n, round_even(avg(value), 4) AS mean FROM events UNION ALL SELECT '/bus/state.speed', count(*), round_even(avg(value), 4) FROM events")
def t_scan_signals(spark, d):
    value = F.col("value").cast("string")
    payload = F.parse_json(F.concat(F.lit('{"stamp":{"sec":5,"nanosec":7},"speed":'), value, F.lit(',"motor":{"temp":'), value, F.lit(',"user_id":3},"gps":1}')))
    msgs = P.table(spark, d, "events").select(F.lit("f").alias("file"), F.lit("/bus/state").alias("topic"), payload.alias("payload"), S.payload_timestamp(payload).alias("ts"))
    return ingest.scalar_series(ingest.signals(msgs)).groupBy("series").agg(F.count("*").alias("n"), F.bround(F.avg("value"), 4).alias("mean"))


# Gate ------------------------------------------------------------------------
PARAMETERS = [
    {"name": "quantity", "required": True, "constraints": [{"type": "range", "min": 2, "max": 45}]},
    {"name": "discount", "constraints": [{"type": "range", "max": 0.08}]},
    {"name": "flag", "type": "enum", "values": ["A", "R", "N"], "constraints": [{"type": "not_in", "values": ["N"]}]},
]
PRECONDITIONS = [
    {"expr": "@state.status == 'O' or abs(params.discount) >= 0.03", "error": "wrong status", "severity": "error"},
    {"expr": "params.quantity * 1 > 0", "severity": "warn"},
    {"expr": "@state.line in [1, 2, 3] and not params.flag contains 'R'", "error": "wrong line", "severity": "warn"},
    {"expr": "@state.missing.value > 3", "severity": "warn"},
]


def _calls(spark, d):
    li = P.table(spark, d, "lineitem")
    quantity = F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_quantity"))
    params = F.to_variant_object(F.struct(quantity.alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag")))
    state = F.to_variant_object(F.struct(F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line")))
    return li.select("l_orderkey", "l_linenumber", params.alias("params"), state.alias("state"))


def _none_as_zero(hits):
    return sum((h.isNotNull().cast("long") for h in hits), F.lit(0).cast("long"))


PARAM_SQL = "(CASE WHEN l_linenumber = 7 OR l_quantity < 2 OR l_quantity > 45 THEN 1 ELSE 0 END + CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END + CASE WHEN l_returnflag NOT IN ('A', 'R', 'N') THEN 1 ELSE 0 END + CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)"


@query(f"SELECT CAST({PARAM_SQL} AS BIGINT) AS failures, count(*) AS n FROM lineitem GROUP BY 1")
def g_param_checks(spark, d):
    calls, bound = gate.bind(_calls(spark, d), PARAMETERS)
    return calls.select(_none_as_zero(gate.parameter_failures(PARAMETERS, bound=bound)).alias("failures")).groupBy("failures").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_linestatus = 'O' OR abs(l_discount) >= 0.03 THEN 'PASS' ELSE 'FAIL' END AS first, 'EVAL_ERROR' AS second, CASE WHEN l_linenumber IN (1, 2, 3) AND NOT contains(l_returnflag, 'R') THEN 'PASS' ELSE 'FAIL' END AS third, 'EVAL_ERROR' AS fourth, count(*) AS n FROM lineitem GROUP BY ALL")
def g_preconditions(spark, d):
    calls, bound = gate.bind(_calls(spark, d), preconditions=PRECONDITIONS)
    verdicts = [gate.evaluate(p["expr"], bound=bound).alias(n) for p, n in zip(PRECONDITIONS, ("first", "second", "third", "fourth"), strict=True)]
    return calls.select(*verdicts).groupBy("first", "second", "third", "fourth").agg(F.count("*").alias("n"))


@query(f"SELECT ok, failures, warnings, count(*) AS n FROM (SELECT {PARAM_SQL} + CASE WHEN l_linestatus = 'O' OR abs(l_discount) >= 0.03 THEN 0 ELSE 1 END = 0 AS ok, CAST({PARAM_SQL} + CASE WHEN l_linestatus = 'O' OR abs(l_discount) >= 0.03 THEN 0 ELSE 1 END AS BIGINT) AS failures, CAST(CASE WHEN l_linenumber IN (1, 2, 3) AND l_returnflag <> 'R' THEN 0 ELSE 1 END AS BIGINT) AS warnings FROM lineitem) GROUP BY ALL")
def g_verdict(spark, d):
    import json

    row = (P.ROBOT, 1, "move", json.dumps(PARAMETERS), json.dumps([PRECONDITIONS[0], PRECONDITIONS[2]]))
    acts = spark.createDataFrame([row], "robot_id string, ord long, id string, parameters string, preconditions string").withColumns({"parameters": F.parse_json("parameters"), "preconditions": F.parse_json("preconditions")})
    calls = _calls(spark, d).withColumns({"robot_id": F.lit(P.ROBOT), "action_id": F.lit("move")})
    found = gate.check(calls, Catalog(P.nations(spark, d), acts, P.located(spark, d)))
    return found.select("ok", F.size("failures").cast("long").alias("failures"), F.size("warnings").cast("long").alias("warnings")).groupBy("ok", "failures", "warnings").agg(F.count("*").alias("n"))


# Rules -----------------------------------------------------------------------
RULES = [
    rules.Rule("modes", "must", "object_count", {"type": "Mode", "min": 20}),
    rules.Rule("actions", "must", "action_count", {"min": 3}),
    rules.Rule("links", "should", "link_count", {"type": "provides_capability", "min": 100_000_000}),
    rules.Rule("provided", "should", "capabilities_have_link", {"link_type": "provides_capability", "direction": "in"}),
    rules.Rule("exposed", "may", "actions_exposed_by_capability", {}),
    rules.Rule("sources", "may", "objects_have_source", {"min_pct": 10}),
    rules.Rule("odd", "may", "no_such_check", {}),
]
MISSING_SQL = "(SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem))"


def _results(spark, d):
    c = P.catalog(spark, d, P.union(P.nations(spark, d), P.parts(spark, d)), P.provides(spark, d))
    return rules.evaluate(c, RULES)


RULES_SQL = f"""SELECT 'modes' AS rule_id, 'must' AS severity, count(*) >= 20 AS passed, CAST(count(*) AS DOUBLE) AS observed FROM nation UNION ALL SELECT 'actions', 'must', count(DISTINCT c_mktsegment) >= 3, count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'links', 'should', false, count(*) FROM lineitem
UNION ALL SELECT 'provided', 'should', {MISSING_SQL} = 0, {MISSING_SQL} UNION ALL SELECT 'exposed', 'may', false, 1 UNION ALL SELECT 'sources', 'may', false, 0 UNION ALL SELECT 'odd', 'may', false, NULL"""


@query(RULES_SQL)
def q_rules(spark, d):
    return _results(spark, d).select("rule_id", "severity", "passed", "observed")


@query(f"WITH r AS ({RULES_SQL}), s AS (SELECT count(*) FILTER (severity = 'must') AS mt, count(*) FILTER (severity = 'must' AND passed) AS mp, count(*) FILTER (severity = 'should') AS st, count(*) FILTER (severity = 'should' AND passed) AS sp, count(*) FILTER (severity = 'may') AS yt, count(*) FILTER (severity = 'may' AND passed) AS yp FROM r) SELECT round_even(100 * (2 * mp + sp + 0.5 * yp) / (2 * mt + st + 0.5 * yt), 4) AS score, CASE WHEN mp < mt THEN 'fail' WHEN sp = st THEN 'customer-ready' WHEN 100 * sp / st >= 70 THEN 'beta' ELSE 'alpha' END AS grade FROM s")
def q_grade(spark, d):
    return rules.grade(_results(spark, d)).select(F.bround("score", 4).alias("score"), "grade")


# Streaming plans over bounded input -------------------------------------------
@query("SELECT CAST(epoch_us(date_trunc('hour', ts)) // 1000000 AS BIGINT) AS start, event_type, count(*) AS n, round_even(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def r_window_counts(spark, d):
    return telemetry.window_counts(P.session_events(spark, d)).select(F.unix_seconds("start").alias("start"), "event_type", "n", "total")


@query("WITH w AS (SELECT *, epoch_us(ts) // 60000000 - s.i AS m FROM events, (SELECT range AS i FROM range(5)) s) SELECT CAST(m * 60 AS BIGINT) AS start, event_type, round_even(arg_max(value, ts) - arg_min(value, ts), 2) AS rise, count(*) AS n FROM w GROUP BY m, event_type")
def r_rise_rate(spark, d):
    return telemetry.rise_rate(P.session_events(spark, d), "event_type").select(F.unix_seconds("start").alias("start"), "event_type", "rise", "n")


@query("WITH m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT before, event_type AS mode, count(*) AS n FROM m WHERE before IS NOT NULL AND before <> event_type AND NOT (before = 'view' AND event_type = 'click') AND NOT (before = 'signup' AND event_type = 'purchase') GROUP BY ALL")
def r_illegal_transition(spark, d):
    modes = P.session_events(spark, d).select("user_id", "event_id", F.col("event_type").alias("mode"))
    allowed = spark.createDataFrame([("view", "click"), ("signup", "purchase")], "mode string, next string")
    return telemetry.illegal_transitions(modes, allowed, "user_id", "event_id").groupBy("before", "mode").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT user_id, min(event_id) AS cut FROM events WHERE event_type = 'error' GROUP BY 1) SELECT e.user_id AS episode, round_even(sum(value), 2) AS reward, count(*) AS steps FROM events e LEFT JOIN c ON c.user_id = e.user_id WHERE cut IS NULL OR event_id < cut GROUP BY 1")
def r_episode_reward(spark, d):
    steps = P.session_events(spark, d).select(F.col("user_id").alias("episode"), F.col("event_id").alias("t"), F.col("value").alias("reward"), (F.col("event_type") == "error").alias("violated"))
    return telemetry.episode_reward(steps).select("episode", F.bround("reward", 2).alias("reward"), "steps")


@query("SELECT event_id, event_type, value FROM events WHERE (event_type = 'error' AND value > 15) OR (event_type = 'view' AND value > 25)")
def r_thresholds(spark, d):
    return telemetry.thresholds(P.session_events(spark, d), {"error": 15.0, "view": 25.0}).select("event_id", "event_type", "value")


@query("SELECT (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM nation) AS links")
def k_graph_json(spark, d):
    c = P.catalog(spark, d, P.nations(spark, d), P.links(P.table(spark, d, "nation"), "located_in", P.key("nation", "n_nationkey"), P.key("region", "n_regionkey"), "n_nationkey"))
    text = graph_json(c)
    return text.select(F.get_json_object("graph", "$.stats.nodes").cast("long").alias("nodes"), F.get_json_object("graph", "$.stats.links").cast("long").alias("links"))

from . import further  # noqa: E402, F401  registers its queries
