"""The test tables seen as a robot catalog, a session and gate calls.

Regions, nations, customers, suppliers, parts and orders are objects; what
connects them are links; customer segments are actions; events are a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.scalars import set_bits
from ..operators import ingest

ROBOT = "testbed"
#: Severity of a known bit of the field k; bit 5 is in no table.
BITS = {0: "info", 1: "nominal", 2: "warning", 3: "error", 4: "critical", 6: "notice"}
#: Severity of an event by its type.
EVENT_SEVERITY = {"error": "error", "purchase": "notice", "signup": "warning", "view": "info"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix + "."), F.col(column).cast("string"))


def _objects(df: DataFrame, type_: str, id_: Column, ord_: str, **props: Column) -> DataFrame:
    fields = F.struct(*[v.alias(k) for k, v in props.items()])
    return df.select(F.lit(ROBOT).alias("robot_id"), F.col(ord_).cast("long").alias("ord"), id_.alias("id"), F.lit(type_).alias("type"), F.to_variant_object(fields).alias("props"), F.lit(None).cast("variant").alias("source"))


def regions(spark, d):
    return _objects(table(spark, d, "region"), "Region", key("region", "r_regionkey"), "r_regionkey", name=F.col("r_name"))


def nations(spark, d):
    return _objects(table(spark, d, "nation"), "Mode", key("nation", "n_nationkey"), "n_nationkey", name=F.col("n_name"), mode_value=F.concat(F.lit("M"), (F.col("n_nationkey") % 10).cast("string")))


def customers(spark, d):
    return _objects(table(spark, d, "customer"), "Customer", key("customer", "c_custkey"), "c_custkey", name=F.col("c_name"), segment=F.col("c_mktsegment"), nation=F.col("c_nationkey"), balance=F.col("c_acctbal"))


def suppliers(spark, d):
    return _objects(table(spark, d, "supplier"), "Sensor", key("supplier", "s_suppkey"), "s_suppkey", name=F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")), nation=F.col("s_nationkey"))


def parts(spark, d):
    return _objects(table(spark, d, "part"), "Capability", key("part", "p_partkey"), "p_partkey", name_human=F.col("p_name"), capability_kind=F.col("p_brand"), produces=F.array("p_type"), detects=F.array(F.col("p_size").cast("string")), size=F.col("p_size"))


def orders(spark, d, closed_only: bool = False):
    o = table(spark, d, "orders")
    o = o.where("o_orderstatus = 'F'") if closed_only else o
    return _objects(o, "Topic", key("order", "o_orderkey"), "o_orderkey", name=F.col("o_orderpriority"), msg_type=F.col("o_orderstatus"))


def actions(spark, d) -> DataFrame:
    segments = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("ord"))
    none = F.lit(None).cast("variant")
    return segments.select(F.lit(ROBOT).alias("robot_id"), F.col("ord"), F.concat(F.lit("act_"), F.lower("c_mktsegment")).alias("id"), F.concat(F.lit("serve "), F.lower("c_mktsegment"), F.lit(" joint mode")).alias("description"), F.when(F.col("c_mktsegment") == "MACHINERY", "MOTION").when(F.col("c_mktsegment") == "BUILDING", "INFO").alias("safety_class"), F.lit(None).cast("boolean").alias("idempotent"), none.alias("invoker"), none.alias("parameters"), none.alias("preconditions"), none.alias("affects"), none.alias("affects_by_domain"), none.alias("body"))


def links(df: DataFrame, type_: str, source: Column, target: Column, ord_: str) -> DataFrame:
    return df.select(F.lit(ROBOT).alias("robot_id"), F.col(ord_).cast("long").alias("ord"), F.lit(type_).alias("type"), source.alias("source"), target.alias("target"), F.lit(None).cast("variant").alias("attrs"))


def provides(spark, d):
    return links(table(spark, d, "lineitem"), "provides_capability", key("supplier", "l_suppkey"), key("part", "l_partkey"), "l_orderkey")


def exposed(spark, d):
    return links(table(spark, d, "lineitem"), "exposed_via", key("part", "l_partkey"), key("order", "l_orderkey"), "l_orderkey")


def located(spark, d):
    n = links(table(spark, d, "nation"), "located_in", key("nation", "n_nationkey"), key("region", "n_regionkey"), "n_nationkey")
    return n.unionByName(links(table(spark, d, "customer"), "located_in", key("customer", "c_custkey"), key("nation", "c_nationkey"), "c_custkey")).unionByName(links(table(spark, d, "supplier"), "located_in", key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "s_suppkey"))


def mode_links(spark, d):
    c = table(spark, d, "customer")
    act = F.concat(F.lit("act_"), F.lower("c_mktsegment"))
    n = table(spark, d, "nation")
    moves = links(n, "transitions_to", key("nation", "n_nationkey"), F.concat(F.lit("nation."), (F.col("n_nationkey") + 7).cast("string")), "n_nationkey")
    return links(c, "allows", key("nation", "c_nationkey"), act, "c_custkey").unionByName(links(c.where("c_acctbal < 0"), "forbidden_in", act, key("nation", "c_nationkey"), "c_custkey")).unionByName(moves)


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def catalog(spark, d, objects, links_) -> Catalog:
    return Catalog(objects, actions(spark, d), links_)


def bits_table(spark) -> DataFrame:
    return spark.createDataFrame([(b, f"bit.{b}", s) for b, s in BITS.items()], "bit int, ref string, severity string")


def event_bits(spark, d) -> DataFrame:
    """Set bits of props.k, grounded: event_id, event_type, bit, ontology_ref, severity."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    rows = table(spark, d, "events").select("event_id", "event_type", F.explode(set_bits(k)).alias("bit"))
    return ingest.ground_bits(rows, bits_table(spark), ["bit"])


def session_events(spark, d) -> DataFrame:
    """event_id, event_type, severity, value, ts of a session."""
    e = table(spark, d, "events")
    severity = F.coalesce(F.create_map(*[F.lit(x) for kv in EVENT_SEVERITY.items() for x in kv])[F.col("event_type")], F.lit("unknown"))
    severity = F.when((F.col("event_type") == "error") & (F.col("value") > 20), "critical").otherwise(severity)
    return e.select("event_id", "event_type", "user_id", severity.alias("severity"), "value", F.col("ts").cast("timestamp").alias("ts"))


def log_lines(spark, d) -> DataFrame:
    """Log lines made of events: file, line, text."""
    e = table(spark, d, "events")
    head = F.concat(F.lit("["), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit("] "))
    k = F.col("event_id") % 11
    text = (
        F.when(k == 0, F.concat(head, F.lit("motor overcurrent on axis "), F.col("user_id").cast("string")))
        .when(k == 1, F.lit("Emergency-Stop pressed"))
        .when(k == 2, F.concat(head, F.lit("battery low "), F.col("value").cast("decimal(18,2)").cast("string")))
        .when(k == 3, F.concat(F.lit("link fault: code "), F.col("user_id").cast("string")))
        .when(k == 4, F.lit("Connection TIMEOUT to peer"))
        .when(k == 5, F.concat(F.lit("mode switch to "), F.col("event_type")))
        .when(k == 6, F.concat(head, F.lit("[ERROR] "), F.repeat(F.lit("x"), (F.col("user_id") % 9 * 1000).cast("int"))))
        .when(k == 7, F.lit("level|warn: slow"))
        .when(k == 8, F.lit("writeError handled by fail_evt_hdlr"))
        .when(k == 9, F.concat(F.lit("mode change from "), F.repeat(F.lit("y"), (F.col("user_id") % 7 * 100).cast("int"))))
        .otherwise(F.concat(head, F.col("event_type")))
    )
    return e.select(F.lit("session.log").alias("file"), F.col("event_id").alias("line"), text.alias("text"))
