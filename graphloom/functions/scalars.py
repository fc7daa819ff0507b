"""Scalar functions on log lines, timestamps, texts and numbers, as Column expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# A line's event kind is that of the first pattern it contains -> (kind, severity, keep the full line).
LOG_PATTERNS = (
    (r"(?i)\b(overcurrent|overvoltage|over[_\s-]?temperature|overtemp)\b", "protection_event", "critical", True),
    (r"(?i)\b(short[_\s-]?circuit|emergency[_\s-]?stop|estop|e[_\s-]stop)\b", "safety_event", "critical", True),
    (r"(?i)\bbattery\b\s+(low|critical|dead|empty)", "battery_event", "warning", True),
    (r"(?i)\b(fault|failure)\b\s*[: ]", "fault", "error", True),
    (r"(?i)\bconnection\s+(lost|timeout|reset|failed)\b", "communication_event", "warning", True),
    (r"(?i)mode\s+(?:switch|change|transition)\s*(?:from|to)?\s*[\"']?(\w+)", "mode_transition", "notice", False),
    (r"(?i)(?:^|\s|\[|\|)(error|err)\s*[\]:|]", "error", "error", True),
    (r"(?i)(?:^|\s|\[|\|)(warning|warn)\s*[\]:|]", "warning", "warning", True),
)
# Parts of field names whose values are dropped, and of topic names whose messages are.
PRIVATE_FIELDS = ("image", "image_raw", "compressed_image", "depth_image", "point_cloud", "pointcloud", "lidar_data", "audio", "audio_raw", "gps", "latitude", "longitude", "altitude", "user_id", "username", "operator_id", "face_embedding", "biometric")
PRIVATE_TOPICS = ("image", "pointcloud", "point_cloud", "depth", "audio", "video", "compressed", "raw")
# Field names that coverage does not count, and parts of names of scalar series.
STOP_FIELDS = ("type", "id", "name", "value", "data", "header", "stamp", "sec", "nsec", "frame_id", "seq")
SCALAR_FIELDS = ("temp", "voltage", "current", "velocity", "speed", "rpm", "force", "torque", "battery", "position")
# Where a line's timestamp is, in order.
TIMESTAMPS = (r"\[(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)\]", r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)", r"\[(\d+\.\d+)\]")


def once(value: Column, use) -> Column:
    """use(value) with the value computed once per row, however often ``use`` names it.

    A plain Column is an expression: named twice in a condition or a lambda, it
    is evaluated twice.
    """
    return F.transform(F.array(value), use)[0]


def log_class(line: Column) -> Column:
    """[T4, W8] Number of the first pattern in the line, else null."""
    out = F.when(line.rlike(LOG_PATTERNS[0][0]), 0)
    for i, (pattern, *_) in enumerate(LOG_PATTERNS[1:], 1):
        out = out.when(line.rlike(pattern), i)
    return out


def class_value(number: Column, which: int) -> Column:
    """Of a pattern by number: 1 its kind, 2 its severity, 3 whether the full line is kept."""
    return F.get(F.array(*[F.lit(p[which]) for p in LOG_PATTERNS]), number)


def clip(text: Column, full: Column) -> Column:
    """[T5] Text under 4000 (full) or 500 characters stays; longer ones end in three dots."""
    most = F.when(full, 4000).otherwise(500)
    return F.when(F.length(text) < most, text).otherwise(F.concat(F.left(text, most - 3), F.lit("...")))


def line_timestamp(line: Column) -> Column:
    """[T2] The first of the timestamp forms, else ''."""
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in TIMESTAMPS], F.lit(""))


def epoch_ns(ts: Column, default_year: int = 2026) -> Column:
    """[T1] Nanoseconds since the epoch of a timestamp text, in the session's time zone; null if it has no known form.

    Digits with a point are seconds, digits alone ns above 1e15, ms above 1e12,
    else seconds; ISO forms; ``Mon d hh:mm:ss`` with the default year.
    """
    one_point = ts.rlike(r"^[0-9.]+$") & F.contains(ts, F.lit("."))
    digits, value = ts.rlike(r"^[0-9]+$"), ts.try_cast("decimal(38,0)")
    iso = F.try_to_timestamp(F.replace(ts, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"))
    syslog = F.regexp_replace(F.regexp_extract(ts, r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})", 1), r"\s+", " ")
    named = F.try_to_timestamp(F.concat(F.lit(f"{default_year} "), syslog), F.lit("yyyy MMM d HH:mm:ss"))
    whole = F.when(value > F.lit(10**15), value).when(value > F.lit(10**12), value * 10**6).otherwise(value * 10**9)
    out = F.when(one_point, (ts.try_cast("double") * 1e9).try_cast("long")).when(digits, whole.try_cast("long"))
    return out.when(iso.isNotNull(), F.unix_micros(iso) * 1000).when(syslog != "", F.unix_micros(named) * 1000)


def payload_timestamp(payload: Column, padded: bool = False) -> Column:
    """[T3] The payload's timestamp, stamp, time or ts as text; {sec, nanosec|nsec} as 'sec.nanosec', zero-padded only if asked."""

    def of(key: str) -> Column:
        v = F.try_variant_get(payload, f"$.{key}", "variant")
        kind = F.schema_of_variant(v)
        sec, nano = F.try_variant_get(v, "$.sec", "string"), F.coalesce(F.try_variant_get(v, "$.nanosec", "string"), F.try_variant_get(v, "$.nsec", "string"), F.lit("0"))
        both = F.concat(sec, F.lit("."), F.lpad(nano, 9, "0") if padded else nano)
        return F.when(kind.startswith("OBJECT"), both).when(~kind.rlike("^(ARRAY|VOID)"), F.try_variant_get(v, "$", "string"))

    return F.coalesce(*[of(k) for k in ("timestamp", "stamp", "time", "ts")], F.lit(""))


def _any_of(words: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(words)


def is_private_field(name: Column) -> Column:
    """The name contains a private word, in any case."""
    return name.rlike(_any_of(PRIVATE_FIELDS))


def is_private_topic(name: Column) -> Column:
    """[F23]"""
    return name.rlike(_any_of(PRIVATE_TOPICS))


def counts_for_coverage(name: Column) -> Column:
    """Neither a path, a stop word nor private."""
    return ~F.startswith(name, F.lit("/")) & ~name.isin(*STOP_FIELDS) & ~is_private_field(name)


def is_scalar_field(name: Column) -> Column:
    """[T10]"""
    return name.rlike(_any_of(SCALAR_FIELDS))


def is_bitmap_field(name: Column) -> Column:
    """[T9]"""
    return name.rlike("(_bits|_bitmap)$") | (name == "pmu_bool_status")


def is_topic(key: Column) -> Column:
    """[T6] Starts with / and has another one."""
    return key.rlike("^/.*/")


def is_msg_type(key: Column) -> Column:
    """[T6]"""
    return ~is_topic(key) & F.contains(F.lower(key), F.lit("msg/"))


def set_bits(value: Column) -> Column:
    """[T9] Positions of the set bits, 0 to 63; none for values that are not positive."""
    return once(value, lambda v: F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: (v > 0) & (F.getbit(v, i) == 1)))


def human_size(n: Column) -> Column:
    """[T11] Bytes as B, KB, MB, GB or TB with one decimal."""
    out = F.format_string("%.1f TB", n / 2.0**40)
    for power, unit in ((30, "GB"), (20, "MB"), (10, "KB"), (0, "B")):
        out = F.when(n < 2.0 ** (power + 10), F.format_string(f"%.1f {unit}", n / 2.0**power)).otherwise(out)
    return out


def degree_range(text: Column) -> Column:
    """[T13] 'a~b°' or '±a°' as struct(min, max) in radians, three decimals half-even; else null."""
    number = r"([+-]?\d+(?:\.\d+)?)"
    lo, hi = F.regexp_extract(text, number + r"\s*°?\s*~\s*" + number, 1), F.regexp_extract(text, number + r"\s*°?\s*~\s*" + number, 2)
    both = F.regexp_extract(text, r"±\s*(\d+(?:\.\d+)?)", 1)
    rad = lambda x: F.bround(F.radians(x.try_cast("double")), 3)
    return F.when(both != "", F.struct((-rad(both)).alias("min"), rad(both).alias("max"))).when(lo != "", F.struct(rad(lo).alias("min"), rad(hi).alias("max")))


def deg_to_rad(degrees: Column) -> Column:
    """[T14] Four decimals, half-even."""
    return F.bround(F.radians(degrees), 4)


def xyz(text: Column) -> Column:
    """[T15] 'x y z' as an array; null: zeros."""
    return F.coalesce(F.transform(F.split(F.trim(text), r"\s+"), lambda p: p.try_cast("double")), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def axis_name(axis: Column) -> Column:
    """[T16] roll, pitch or yaw for a unit axis, else null."""
    size = F.transform(axis, F.abs)
    unit = lambda i: F.array(*[F.lit(float(i == k)) for k in range(3)])
    return F.when(size == unit(0), "roll").when(size == unit(1), "pitch").when(size == unit(2), "yaw")


def is_placeholder(text: Column) -> Column:
    """[T20] Missing, blank or still MY_…"""
    return F.coalesce((F.trim(text) == "") | F.startswith(text, F.lit("MY_")), F.lit(True))


def controller(t: Column, amplitude: Column, frequency: Column, phase: Column, correction: Column | None = None, scale: Column | None = None) -> Column:
    """[T21, X4] Sine per joint, with a correction added and scaled if given, clipped to [-1, 1]; all but t, frequency and scale are arrays."""
    raw = F.zip_with(amplitude, phase, lambda a, p: a * F.sin(2 * math.pi * frequency * t + p))
    if correction is not None:
        raw = F.zip_with(raw, correction, lambda x, y: x + y)
    factor = F.lit(1.0) if scale is None else scale
    return F.transform(raw, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * factor)))


def pd_correction(targets: Column, positions: Column, velocities: Column, kp: Column, kd: Column) -> Column:
    """[T21] kp times the way to the target less kd times the velocity, per joint."""
    pull = F.zip_with(targets, positions, lambda q, p: kp * (q - p))
    return F.zip_with(pull, velocities, lambda x, v: x - kd * v)


def policy(function: Callable[[list[float], dict, float], list[float]]):
    """[X4] A policy as code, (observation, parameters, t) -> action, as a function of columns: array, JSON text, number -> array."""

    def act(observations: pd.Series, parameters: pd.Series, times: pd.Series) -> pd.Series:
        read = {p: json.loads(p) for p in parameters.unique()}
        return pd.Series([[float(x) for x in function(list(o), read[p], t)] for o, p, t in zip(observations, parameters, times, strict=True)])

    return F.pandas_udf(act, "array<double>")
