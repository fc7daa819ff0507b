"""Schemas and dimension tables of the robot knowledge model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTS = "robot_id string, ord long, id string, type string, props string, source string"
ACTIONS = "robot_id string, ord long, id string, description string, safety_class string, idempotent boolean, invoker string, parameters string, preconditions string, affects string, affects_by_domain string, body string"
LINKS = "robot_id string, ord long, type string, source string, target string, attrs string"
ISSUES = "robot_id string, severity string, code string, subject string, message string"

# Object type -> (category, colour, layer); types not listed are ("hardware", "#888", "hardware").
TYPES = {
    "ComputeUnit": ("hardware", "#ff6b6b", "compute"),
    "SoftwareComponent": ("hardware", "#888", "compute"),
    "Process": ("hardware", "#888", "compute"),
    "ROSNode": ("hardware", "#888", "compute"),
    "PowerSubsystem": ("hardware", "#ff6b6b", "hardware"),
    "Sensor": ("hardware", "#ff6b6b", "hardware"),
    "RobotBody": ("hardware", "#ff6b6b", "hardware"),
    "ProtectionThreshold": ("hardware", "#ff6b6b", "hardware"),
    "EndEffector": ("hardware", "#888", "hardware"),
    "Joint": ("hardware", "#ff6b6b", "hardware"),
    "VirtualEndpoint": ("hardware", "#888", "hardware"),
    "Link": ("hardware", "#ff6b6b", "kinematics"),
    "CoordinateFrame": ("hardware", "#888", "kinematics"),
    "StatusBit": ("event", "#ff9800", "events"),
    "FaultCode": ("event", "#ff9800", "events"),
    "TouchEvent": ("event", "#ff9800", "events"),
    "Mode": ("behavior", "#ffd54f", "behaviors"),
    "PresetMotion": ("behavior", "#ffd54f", "behaviors"),
    "ControlLoop": ("behavior", "#ffd54f", "behaviors"),
    "InputSource": ("meta", "#90a4ae", "behaviors"),
    "PriorityLevel": ("meta", "#90a4ae", "behaviors"),
    "Topic": ("interface", "#4dd0e1", "interfaces"),
    "Service": ("interface", "#4dd0e1", "interfaces"),
    "MsgSchema": ("interface", "#4dd0e1", "interfaces"),
    "SrvSchema": ("hardware", "#888", "interfaces"),
    "Action": ("hardware", "#888", "actions"),
    "Capability": ("hardware", "#888", "capabilities"),
    "CapabilityParameter": ("hardware", "#888", "capabilities"),
    "ServiceRequirement": ("hardware", "#888", "requirements"),
}

# Rank of a severity in event retention; others rank 0.
SEVERITY_RANK = {"critical": 5, "error": 4, "warning": 3, "notice": 2, "info": 1, "nominal": 1, "unknown": 0}
# Rank of a readiness grade.
GRADE_RANK = {"fail": 0, "alpha": 1, "beta": 2, "customer-ready": 3}


def _lookup(key: Column, table: dict, default) -> Column:
    """A constant map with a default; no join, as the table is fixed and small."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def category_of(type_: Column) -> Column:
    return _lookup(type_, {t: v[0] for t, v in TYPES.items()}, "hardware")


def colour_of(type_: Column) -> Column:
    return _lookup(type_, {t: v[1] for t, v in TYPES.items()}, "#888")


def layer_of(type_: Column) -> Column:
    return _lookup(type_, {t: v[2] for t, v in TYPES.items()}, "hardware")


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_RANK, 0)


def grade_rank(grade: Column) -> Column:
    return _lookup(grade, GRADE_RANK, -1)


def types_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, *v) for t, v in TYPES.items()], "type string, category string, colour string, layer string")
