"""Session folders: logs, YAML and JSON documents, message streams, atop exports.

Files are listed and read by Spark, so a session may be in any store that
Spark reads.  Unreadable documents become issue rows, never exceptions.
"""

from __future__ import annotations

import json

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scalars as S
from ..operators import ingest
from ..storage import materialize

#: [S8] Folders of a session in the order they are read.
FOLDERS = ("info", "log", "bag")
LOG_NAME = r"(?i)\.(?:log|txt)$|\.log_\d+$"
DOCUMENT_NAME = r"(?i)\.(?:yaml|yml|json|jsonl|mcap|atop)$"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """[S8, S13] path, directory, name, bytes, format of all files below the session's folders; format null is unsupported."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    rel = F.regexp_extract("path", "(?:^|/)(info|log|bag)/.*$", 1)
    name = F.element_at(F.split("path", "/"), -1)
    fmt = F.when(name.rlike(LOG_NAME), "log").when(name.rlike(DOCUMENT_NAME), F.regexp_extract(F.lower(name), r"\.([a-z]+)$", 1))
    return files.select("path", rel.alias("directory"), name.alias("name"), "bytes", fmt.alias("format")).where("directory <> ''")


def skipped(files: DataFrame) -> DataFrame:
    """[S8] Unsupported files per extension."""
    return files.where("format is null").groupBy(F.regexp_extract("name", r"(\.[^.]*)$", 1).alias("extension")).agg(F.count("*").alias("n"))


def log_lines(spark: SparkSession, *paths: str, text: DataFrame | None = None) -> DataFrame:
    """[S12, S13] file, line (from 1), text; blank lines are numbered but dropped, broken bytes replaced.

    Files are read in blocks, so they may be of any size: a line's number is its
    place in its block plus the lines of the blocks before.  ``text`` (file,
    value) takes whole texts from elsewhere.
    """
    if text is not None:
        lines = text.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "text"))
        return lines.where("text <> ''").select("file", (F.col("pos") + 1).cast("long").alias("line"), "text")
    raw = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("text")).withColumn("at", F.monotonically_increasing_id())
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = raw.groupBy("path", "block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    placed = raw.withColumn("place", F.row_number().over(Window.partitionBy("path", "block").orderBy("at"))).where("text <> ''")
    return placed.join(before, ["path", "block"]).select(_name("path").alias("file"), (F.col("before") + F.col("place")).alias("line"), "text")


def _name(path: str):
    return F.element_at(F.split(F.col(path), "/"), -1)


def json_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """[S10] file, doc (VARIANT) per line; lines that are no JSON are skipped."""
    lines = spark.read.text(list(paths)).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.try_parse_json("value").alias("doc"))
    return lines.where("doc is not null")


def json_documents(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """[S11] (file, doc) and (file, message): a list gives a document per element, anything else one; broken files are issues."""
    whole = spark.read.text(list(paths), wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.try_parse_json("value").alias("doc"))
    good = whole.where("doc is not null")
    many = F.try_variant_get("doc", "$", "array<variant>")
    docs = good.select("file", F.explode(F.when(F.schema_of_variant("doc").startswith("ARRAY"), many).otherwise(F.array("doc"))).alias("doc"))
    return docs, whole.where("doc is null").select("file", F.lit("not valid JSON").alias("message"))


def yaml_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """[S9] file, doc of every document of multi-document YAML files; a broken rest gives doc null."""
    raw = spark.read.text(list(paths), wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")

    def parse(batches):
        for pdf in batches:
            rows = []
            for file, value in zip(pdf["file"], pdf["value"], strict=True):
                try:
                    rows += [(file, json.dumps(d, default=str)) for d in yaml.safe_load_all(value) if d is not None]
                except yaml.YAMLError:
                    rows.append((file, None))
            yield pd.DataFrame(rows, columns=["file", "doc"])

    return raw.mapInPandas(parse, "file string, doc string").select("file", F.try_parse_json("doc").alias("doc"))


def flatten_message(value, depth: int = 8, items: int = 32):
    """[S15] A message as plain data: deeper than ``depth`` cut, lists cut to ``items``, bytes to their length, others to 200 characters of text."""
    if depth < 0:
        return "<truncated>"
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if isinstance(value, bytes | bytearray):
        return {"length": len(value)}
    if isinstance(value, dict):
        return {str(k): flatten_message(v, depth - 1, items) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [flatten_message(v, depth - 1, items) for v in value[:items]]
    fields = getattr(value, "__slots__", None) or list(getattr(value, "__dict__", {}))
    if fields:
        return {f.lstrip("_"): flatten_message(getattr(value, f), depth - 1, items) for f in fields}
    return str(value)[:200]


def message_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """[S14] Exported message lines in any store that Spark reads: topic, msg_type, log_time_ns, publish_time_ns, payload (VARIANT)."""
    of = lambda key, kind: F.try_variant_get("doc", f"$.{key}", kind).alias(key)
    shown = F.pandas_udf(lambda texts: texts.map(lambda t: t if t is None else json.dumps(flatten_message(json.loads(t)))), "string")
    payload = F.try_parse_json(shown(F.to_json(F.try_variant_get("doc", "$.payload", "variant")))).alias("payload")
    return json_lines(spark, *paths).select("file", of("topic", "string"), of("msg_type", "string"), of("log_time_ns", "long"), of("publish_time_ns", "long"), payload)


class MessageSource(DataSource):
    """[S14, X5] Message streams: topic, msg_type, log_time_ns, publish_time_ns, payload (JSON text).

    ``path`` names exported message lines, one file per partition; with the
    optional bag library, .mcap files too.
    """

    @classmethod
    def name(cls):
        return "robot_messages"

    def schema(self):
        return "topic string, msg_type string, log_time_ns long, publish_time_ns long, payload string"

    def reader(self, schema):
        return MessageReader(self.options["path"].split(","))


class MessageReader(DataSourceReader):
    def __init__(self, paths):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        if partition.value.endswith(".mcap"):
            from mcap.reader import make_reader
            from mcap_ros2.decoder import DecoderFactory

            with open(partition.value, "rb") as f:
                for schema, channel, message, decoded in make_reader(f, decoder_factories=[DecoderFactory()]).iter_decoded_messages():
                    yield channel.topic, schema.name, message.log_time, message.publish_time, json.dumps(flatten_message(decoded), default=str)
            return
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                try:
                    m = json.loads(line)
                except ValueError:
                    continue
                yield m.get("topic"), m.get("msg_type"), m.get("log_time_ns"), m.get("publish_time_ns"), json.dumps(flatten_message(m.get("payload")))


def atop_frames(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[S16] lines (text) of parseable atop output -> CPU frames and MEM frames; short or broken lines drop.

    Commands are not run here: ``atop -P CPU,MEM`` writes the text.
    """
    p = lines.select(F.split(F.trim("text"), r"\s+").alias("p"))
    num = lambda i: F.get("p", F.lit(i)).try_cast("double")
    cpu = p.where("p[0] = 'CPU' and size(p) >= 12").select(*[num(i).alias(n) for n, i in (("interval", 5), ("ticks", 6), ("cpus", 7), ("sys", 8), ("user", 9))])
    mem = p.where("p[0] = 'MEM' and size(p) >= 10").select(num(7).alias("total"), num(8).alias("free"))
    return cpu.na.drop(), mem.na.drop()


# A whole session ----------------------------------------------------------------
EVENT = ("ts", "kind", "source_file", "payload", "ontology_ref", "severity", "epoch_ns", "seq")


def _event(df: DataFrame, kind: str, ref, place) -> DataFrame:
    """Signals (file, topic, ts, field, …) as events in the form of log events."""
    payload = F.create_map(F.lit("topic"), F.col("topic"), F.lit("field"), F.col("field"), F.lit("value"), place)
    seq = F.struct(F.col("file").alias("file"), F.lit(0).cast("long").alias("line"), F.concat_ws(".", "path", "field", place).alias("part"))
    return df.select("ts", F.lit(kind).alias("kind"), F.col("file").alias("source_file"), payload.alias("payload"), ref.alias("ontology_ref"), "severity", S.epoch_ns(F.col("ts")).alias("epoch_ns"), seq.alias("seq"))


def run(spark: SparkSession, root: str, bits: DataFrame, quota: int = 10_000) -> dict[str, DataFrame]:
    """[S8, W2] A session folder: every file goes to the reader of its format, and all become one set of tables.

    events (retained, critical ones and the ``quota``'s worth), kinds (counts
    before retention), scalars, fields, topics, msg_types, cpu and memory frames,
    skipped (files per unsupported extension), stats (per folder) and warnings.
    Broken files and message files without the bag library are warnings; the
    other files go on.  bits: (field, bit, ref, severity).
    """
    files = listing(spark, root)
    paths: dict[str, list[str]] = {}
    for r in files.where("format is not null").select("path", "format").orderBy("path").collect():  # names of files, as the reader lists them itself
        paths.setdefault(r["format"], []).append(r["path"])
    docs = spark.createDataFrame([], "file string, doc variant")
    warnings = spark.createDataFrame([], "file string, message string")
    if yamls := paths.get("yaml", []) + paths.get("yml", []):
        found = yaml_documents(spark, *yamls)
        docs, warnings = docs.unionByName(found.where("doc is not null")), warnings.unionByName(found.where("doc is null").select("file", F.lit("not valid YAML").alias("message")))
    if "json" in paths:
        found, broken = json_documents(spark, *paths["json"])
        docs, warnings = docs.unionByName(found), warnings.unionByName(broken)
    if "jsonl" in paths:
        docs = docs.unionByName(json_lines(spark, *paths["jsonl"]))
    if "mcap" in paths:
        spark.dataSource.register(MessageSource)
        try:
            import mcap_ros2  # noqa: F401  optional

            bags = spark.read.format("robot_messages").option("path", ",".join(paths["mcap"])).load()
            docs = docs.unionByName(bags.select(F.col("topic").alias("file"), F.try_parse_json(F.concat(F.lit("{"), F.to_json(F.struct("topic")), F.lit(":"), F.col("payload"), F.lit("}"))).alias("doc")))
        except ImportError:
            names = spark.createDataFrame([(p.rsplit("/", 1)[-1], "no library for message files") for p in paths["mcap"]], "file string, message string")
            warnings = warnings.unionByName(names)
    lines = log_lines(spark, *paths["log"]) if "log" in paths else spark.createDataFrame([], "file string, line long, text string")
    cpu, memory = atop_frames(log_lines(spark, *paths["atop"]) if "atop" in paths else spark.createDataFrame([], "text string"))

    formats = {"yaml", "yml", "json", "jsonl", "mcap"}
    if formats & paths.keys():
        walked, _ = materialize(ingest.walk(docs), "walked")  # every table below reads it
    else:
        walked = spark.createDataFrame([], "file string, path string, key string, value variant")
    messages = ingest.messages(docs, walked)
    signals = ingest.signals(messages)
    active = ingest.active_bits(signals, bits)
    none = F.lit(None).cast("string")
    from_lines = ingest.line_events(lines).withColumn("seq", F.struct(F.col("seq.file").alias("file"), F.col("seq.line").alias("line"), F.lit("").alias("part")))
    events = from_lines.select(*EVENT)
    events = events.unionByName(_event(ingest.bit_events(active), "status_bit", F.col("ontology_ref"), F.col("bit").cast("string")))
    events = events.unionByName(_event(ingest.mode_events(signals), "mode_observed", none, F.col("mode")))
    stats = files.select("directory", "bytes", F.lit(0).cast("long").alias("lines"))
    return {
        "events": ingest.retain_topk(events, quota, ["seq"]),
        "kinds": ingest.kind_counts(events),
        "scalars": ingest.scalar_series(signals).select("series", "ts", "value", "file", "path"),
        "fields": ingest.field_counts(docs, signals, walked),
        "topics": ingest.topic_counts(docs, walked),
        "msg_types": ingest.msg_type_counts(docs, walked),
        "cpu": cpu,
        "memory": memory,
        "skipped": skipped(files),
        "stats": ingest.file_stats(stats).drop("lines"),
        "warnings": warnings,
    }
