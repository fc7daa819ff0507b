"""Sinks: summaries, coverage, graphs and inventories."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog, prop
from .operators import audit, graph, ingest
from .sources.imports import package_of


def session_summary(events: DataFrame, samples: DataFrame, counts: DataFrame, path: str) -> None:
    """[K1] events and samples as Parquet, counts as JSON, below ``path``."""
    events.write.mode("overwrite").parquet(f"{path}/events")
    samples.write.mode("overwrite").parquet(f"{path}/scalars")
    counts.write.mode("overwrite").json(f"{path}/counts")


def summary_document(robot_id: str, root: str, tables: dict[str, DataFrame], shown: int = 200) -> DataFrame:
    """[K1] The summary of a session run as one JSON document: retained events, series of ``shown`` samples, counts, warnings.

    Its size is bounded by the retention's quota (critical events besides) and by
    ``shown`` samples per series.
    """
    kept, counts = ingest.series_cap(tables["scalars"], ["ts", "file", "path"], shown)
    series = kept.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ts", "value"))), lambda s: F.struct(s["ts"].alias("ts"), s["value"].alias("value"))).alias("samples"))
    series = counts.withColumnRenamed("samples", "samples_count").join(series, "series")
    one = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    events = tables["events"].select("seq", "ts", "kind", "source_file", F.to_json("payload").alias("payload"), "ontology_ref", "severity", "epoch_ns")
    parts = [one(events, "events"), one(series, "scalars_timeseries"), one(tables["kinds"], "log_event_counts"), one(tables["warnings"], "warnings")]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out.select(F.to_json(F.struct(F.lit("0.2").alias("schema_version"), F.lit(robot_id).alias("robot_id"), F.lit(root).alias("session"), *[c for c in out.columns])).alias("summary"))


def coverage_report(topics: DataFrame, msg_types: DataFrame, kinds: DataFrame, issues: DataFrame) -> str:
    """[K2] Markdown of the coverage: top 50 unregistered topics, first 20 unobserved, top 20 message types, kinds, first 50 warnings."""
    out = ["# Coverage", "", "## Unregistered topics"]
    rows = lambda df, order, n: df.orderBy(*order).limit(n).collect()
    out += [f"- {r['topic']}: {r['n']}" for r in rows(topics.where("status = 'unregistered'"), (F.desc("n"), "topic"), 50)]
    out += ["", "## Unobserved topics", *(f"- {r['topic']}" for r in rows(topics.where("status = 'unobserved'"), ("topic",), 20))]
    out += ["", "## Message types", *(f"- {r['msg_type']}: {r['n']}" for r in rows(msg_types, (F.desc("n"), "msg_type"), 20))]
    out += ["", "## Events", *(f"- {r['kind']}: {r['n']}" for r in rows(kinds, (F.desc("n"), "kind"), 100))]
    out += ["", "## Warnings", *(f"- {r['message']}" for r in issues.limit(50).collect())]
    return "\n".join(out) + "\n"


def stats_json(stats: DataFrame, path: str) -> None:
    """[K3]"""
    stats.write.mode("overwrite").json(path)


def graph_json(c: Catalog) -> DataFrame:
    """[K4] One row per robot: nodes, links and stats as JSON text. A pack is small, so its arrays are."""
    nodes = graph.graph_nodes(c).groupBy("robot_id").agg(F.collect_list(F.struct("id", "type", "category", "layer", "label")).alias("nodes"))
    links = graph.graph_edges(c).groupBy("robot_id").agg(F.collect_list(F.struct("type", "source", "target")).alias("links"))
    return nodes.join(links, "robot_id", "full").select("robot_id", F.to_json(F.struct("nodes", "links", F.struct(F.size("nodes").alias("nodes"), F.size("links").alias("links")).alias("stats"))).alias("graph"))


def inventory(c: Catalog, columns: dict[str, list[str]], path: str) -> None:
    """[K5, F26] A folder per type with its columns as CSV, by id; and an overview with a TOTAL row."""
    for type_, names in columns.items():
        cells = [graph.clip_cell(prop(n)).alias(n) for n in names]
        graph.objects_of_type(c, type_).select("robot_id", "id", *cells).orderBy("robot_id", "id").write.mode("overwrite").option("header", True).csv(f"{path}/type={type_}")
    graph.category_rollup(c).write.mode("overwrite").option("header", True).csv(f"{path}/overview")


def joint_patch(patched: DataFrame) -> str:
    """[K6] YAML of merged joints as objects of a pack: limits and effort of the import, names and notes of the pack. A pack is small."""
    objects = []
    for r in patched.orderBy("id").collect():
        properties = {"urdf_name": r["urdf_name"], "position_limit": {"min": r["lo"], "max": r["hi"], "unit": "rad"}, "effort_limit": r["effort"]}
        properties |= {f: r[f] for f in audit.KEPT_FIELDS if f in patched.columns and r[f] is not None}
        objects.append({"type": "Joint", "id": r["id"], "properties": properties})
    return yaml.safe_dump({"objects": objects}, sort_keys=False, allow_unicode=True)


def sdk_document(tables: dict[str, DataFrame]) -> DataFrame:
    """[K7] One JSON document of what an SDK folder declares: messages, services and topic uses."""
    name = F.regexp_extract("file", r"([^/]+)\.[^.]*$", 1).alias("name")
    listed = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("line", F.col("name").alias("n"), "type")))), lambda f: F.struct(f["n"].alias("name"), f["type"].alias("type")))
    always = F.lit(True)
    messages = tables["messages"].groupBy("file").agg(listed(always).alias("fields")).select(name, package_of(F.col("file")).alias("package"), "fields")
    services = tables["services"].groupBy("file").agg(listed(F.col("part") == "request").alias("request_fields"), listed(F.col("part") == "response").alias("response_fields")).select(name, package_of(F.col("file")).alias("package"), "request_fields", "response_fields")
    topics = tables["topics"].select("topic", "msg_type", F.element_at(F.split("file", "/"), -1).alias("from"))
    one = lambda df, key: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(key))
    out = one(messages, "msg_schemas").crossJoin(one(services, "srv_schemas")).crossJoin(one(topics, "topic_inferences"))  # one row each
    return out.select(F.to_json(F.struct("msg_schemas", "srv_schemas", "topic_inferences")).alias("document"))


def diff_report(diffs: DataFrame) -> str:
    """[K6, A19] Markdown of an import's differences, grouped by kind."""
    out = ["# Import differences"]
    for k in diffs.groupBy("kind").count().orderBy("kind").collect():
        out += ["", f"## {k['kind']} ({k['count']})", "", "| joint | old | new |", "|-|-|-|"]
        out += [f"| {r['joint']} | {r['old']} | {r['new']} |" for r in diffs.where(F.col("kind") == k["kind"]).orderBy("joint").collect()]
    return "\n".join(out) + "\n"
