"""Importers: URDF, interface definitions (.msg, .srv), example code, Markdown tables, generated joints."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import axis_name, deg_to_rad, xyz

_XYZ = "struct<_xyz:string,_rpy:string>"
LINK_XML = f"_name string, inertial struct<mass:struct<_value:double>,origin:{_XYZ},inertia:struct<_ixx:double,_ixy:double,_ixz:double,_iyy:double,_iyz:double,_izz:double>>, visual struct<geometry:struct<mesh:struct<_filename:string>>>"
JOINT_XML = f"_name string, _type string, parent struct<_link:string>, child struct<_link:string>, origin {_XYZ}, axis struct<_xyz:string>, limit struct<_lower:double,_upper:double,_velocity:double,_effort:double>"


def urdf_links(spark: SparkSession, path: str) -> DataFrame:
    """[S17] One row per link: name_urdf, mass, inertial_origin, inertia, mesh; each optional."""
    x = spark.read.format("xml").option("rowTag", "link").schema(LINK_XML).load(path)
    origin = F.when(F.col("inertial.origin").isNotNull(), xyz(F.col("inertial.origin._xyz")))
    return x.select(F.col("_name").alias("name_urdf"), F.col("inertial.mass._value").alias("mass"), origin.alias("inertial_origin"), F.col("inertial.inertia").alias("inertia"), F.col("visual.geometry.mesh._filename").alias("mesh"))


def urdf_joints(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """[S17] Revolute joints (limits with four decimals), fixed joints (mount hints), and the names of other kinds."""
    x = spark.read.format("xml").option("rowTag", "joint").schema(JOINT_XML).load(path)
    common = [F.col("_name").alias("urdf_name"), F.col("parent._link").alias("parent"), F.col("child._link").alias("child"), xyz(F.col("origin._xyz")).alias("origin_xyz"), xyz(F.col("origin._rpy")).alias("origin_rpy")]
    axis = xyz(F.col("axis._xyz"))
    revolute = x.where("_type = 'revolute'").select(*common, axis.alias("axis"), axis_name(axis).alias("dof_axis"), F.bround("limit._lower", 4).alias("lo"), F.bround("limit._upper", 4).alias("hi"), F.col("limit._velocity").alias("velocity"), F.col("limit._effort").alias("effort"))
    return revolute, x.where("_type = 'fixed'").select(*common), x.where("_type not in ('revolute', 'fixed')").select(F.col("_name").alias("urdf_name"), F.col("_type").alias("kind"))


# Fixed value: a field line of an interface definition: type, name, default, comment.
FIELD_LINE = r"^\s*([a-zA-Z_][\w/]*(?:\[\]|[<][^>]*[>])?)\s+([a-zA-Z_]\w*)(?:\s*=\s*([^#\n]+))?\s*(?:#\s*(.*))?\s*$"


def fields(lines: DataFrame) -> DataFrame:
    """[S18] lines (file, line, text) -> file, line, type, name, default, comment of those that declare a field."""
    part = lambda i: F.nullif(F.trim(F.regexp_extract("text", FIELD_LINE, i)), F.lit(""))
    found = lines.where(F.col("text").rlike(FIELD_LINE))
    return found.select("file", "line", part(1).alias("type"), part(2).alias("name"), part(3).alias("default"), part(4).alias("comment"))


def service_fields(lines: DataFrame) -> DataFrame:
    """[S19] Fields with part request or response, by the first --- line of the file; without one all are of the request."""
    cut = lines.where(F.col("text").rlike(r"^---\s*$")).groupBy("file").agg(F.min("line").alias("cut"))
    return fields(lines).join(cut, "file", "left").withColumn("part", F.when(F.col("line") > F.col("cut"), "response").otherwise("request")).drop("cut")


def package_of(path: Column) -> Column:
    """[S20] The folder above msg, srv or action; else the file's folder."""
    named = F.regexp_extract(path, r"([^/]+)/(?:msg|srv|action)/[^/]*$", 1)
    return F.when(named != "", named).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1))


# How example code names a topic, and its quality of service.
TOPIC_CALL = r"(?:create_publisher|create_subscription|create_client)\s*\(\s*(\w+)\s*,\s*'(/[^']+)'"
QOS_CALL = r"QoS(Reliability|Durability)Policy\.(\w+)"


def topic_uses(texts: DataFrame) -> DataFrame:
    """[T17, S21] texts (file, value) -> file, topic, msg_type, line, reliability, durability.

    Calls may span lines; the quality of service is looked for within 300
    characters, the last mention of each kind counting.  Offsets need Python.
    """
    call, qos = re.compile(TOPIC_CALL, re.DOTALL), re.compile(QOS_CALL)

    def find(batches):
        for pdf in batches:
            rows = []
            for file, value in zip(pdf["file"], pdf["value"].fillna(""), strict=True):
                for m in call.finditer(value):
                    near = value[max(0, m.start() - 300) : m.end() + 300]
                    said = {k: v for k, v in qos.findall(near)}
                    rows.append((file, m[2], m[1], value.count("\n", 0, m.start()) + 1, said.get("Reliability"), said.get("Durability")))
            yield pd.DataFrame(rows, columns=["file", "topic", "msg_type", "line", "reliability", "durability"])

    return texts.mapInPandas(find, "file string, topic string, msg_type string, line long, reliability string, durability string")


def sdk_tree(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """[S21] Messages, services and topic uses of an SDK folder; Python files that start with __ are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{msg,srv,py}").load(root).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("value"))
    lines = raw.where(~F.endswith("file", F.lit(".py"))).select("file", F.posexplode(F.split("value", "\n")).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("line"), "text")
    python = raw.where(F.endswith("file", F.lit(".py")) & ~F.col("file").rlike("/__[^/]*$"))
    return {"messages": fields(lines.where(F.endswith("file", F.lit(".msg")))), "services": service_fields(lines.where(F.endswith("file", F.lit(".srv")))), "topics": topic_uses(python)}


def markdown_table(texts: DataFrame) -> DataFrame:
    """[S22] texts (file, value), each a Markdown table -> file, row, cells (map header -> cell); rows of another width drop."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    lines = F.filter(F.split("value", "\n"), lambda t: F.trim(t) != "")
    rows = texts.select("file", cells(F.get(lines, F.lit(0))).alias("h"), F.posexplode(F.slice(lines, F.lit(3), F.greatest(F.size(lines), F.lit(1)))).alias("row", "text"))
    rows = rows.withColumn("c", cells(F.col("text"))).where("size(c) = size(h)")
    return rows.select("file", "row", F.map_from_arrays("h", "c").alias("cells"))


def joint_table(spark: SparkSession, robot: str, rows: list[tuple[str, str, float, float]]) -> DataFrame:
    """[S26] Generated joints: (label, axis, min deg, max deg) for both sides, limits in radians with four decimals."""
    base = spark.createDataFrame(rows, "joint_label string, dof_axis string, lo double, hi double")
    sides = spark.createDataFrame([("left",), ("right",)], "side string")
    both = base.join(F.broadcast(sides))
    return both.select(F.concat_ws(".", F.lit(robot), F.lit("joint"), F.concat_ws("_", "side", "joint_label")).alias("id"), "side", "joint_label", "dof_axis", deg_to_rad(F.col("lo")).alias("min"), deg_to_rad(F.col("hi")).alias("max"))
