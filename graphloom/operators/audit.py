"""Diffs, merges and audit logs."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT_FIELDS = ("name_human", "j_label", "notes")


def snapshot(files: DataFrame) -> DataFrame:
    """[A20] files (path, content) -> path, hash."""
    return files.select("path", F.sha2("content", 256).alias("hash"))


def pack_hash(snap: DataFrame) -> DataFrame:
    """[A20] One hash over all paths and hashes, in path order."""
    ordered = F.array_sort(F.collect_list(F.struct("path", "hash")))
    return snap.agg(F.sha2(F.array_join(F.transform(ordered, lambda r: F.concat(r["path"], r["hash"])), ""), 256).alias("pack_hash"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """[J26] path, before, after of changed, added and removed files."""
    both = before.select("path", F.col("hash").alias("before")).join(after.select("path", F.col("hash").alias("after")), "path", "full")
    return both.where("not (before <=> after)")


def set_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """[J25, U3] Keys in one table only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def merge_joints(imported: DataFrame, existing: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[J23] (patched joints, diffs).

    imported (urdf_name, lo, hi, effort) win over existing (id, lo, hi,
    torque_peak and the human fields), which are kept; names (urdf_name, id) maps.
    Diffs: position_limit if a bound differs, effort if the values differ by more
    than 1, no_mapping for names without id.
    """
    human = [F.col(f) for f in KEPT_FIELDS if f in existing.columns]
    old = existing.select("id", F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"), "torque_peak", *human, F.lit(True).alias("known"))
    both = imported.join(names, "urdf_name", "left")
    mapped = both.where("id is not null").join(old, "id", "left")
    text = lambda a, b: F.concat(F.lit("["), F.coalesce(F.col(a).cast("string"), F.lit("None")), F.lit(", "), F.coalesce(F.col(b).cast("string"), F.lit("None")), F.lit("] rad"))
    limits = mapped.where("known and not (old_lo <=> lo and old_hi <=> hi)").select(F.col("id").alias("joint"), F.lit("position_limit").alias("kind"), text("old_lo", "old_hi").alias("old"), text("lo", "hi").alias("new"), "urdf_name")
    efforts = mapped.where("abs(torque_peak - effort) > 1").select(F.col("id").alias("joint"), F.lit("effort").alias("kind"), F.col("torque_peak").cast("string").alias("old"), F.col("effort").cast("string").alias("new"), "urdf_name")
    unmapped = both.where("id is null").select(F.col("urdf_name").alias("joint"), F.lit("no_mapping").alias("kind"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"), "urdf_name")
    patched = mapped.select("id", "urdf_name", "lo", "hi", "effort", *[f for f in KEPT_FIELDS if f in existing.columns])
    return patched, limits.unionByName(efforts).unionByName(unmapped)


def mounts(fixed: DataFrame, mapping: DataFrame) -> DataFrame:
    """[J24] fixed joints (child) ⟕ mapping (child, sensor): mounts; a null sensor is a suggestion; unmapped children give nothing."""
    return fixed.join(mapping, "child").withColumn("kind", F.when(F.col("sensor").isNull(), "suggestion").otherwise("mount"))


def diffs_by_kind(diffs: DataFrame) -> DataFrame:
    """[A19]"""
    return diffs.groupBy("kind").agg(F.count("*").alias("n"))


def tail(events: DataFrame, n: int = 10) -> DataFrame:
    """[W6] The last n events, in order."""
    return events.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def completed_steps(events: DataFrame) -> DataFrame:
    """[A21] Distinct steps that ended well, in the order first seen."""
    return events.where("exit_code = 0 and step <> 'init'").groupBy("step").agg(F.min("seq").alias("first")).orderBy("first")


class BuildLog:
    """[D14, K8, W6, A21] Append-only JSON lines beside a pack, and its file snapshot."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)
        if not self.folder.is_dir():
            raise FileNotFoundError(folder)
        self.dir = self.folder / ".build"

    @property
    def exists(self) -> bool:
        return (self.dir / "log.jsonl").is_file()

    def files(self) -> DataFrame:
        rows = [(p.relative_to(self.folder).as_posix(), p.read_bytes()) for p in sorted(self.folder.rglob("*")) if p.is_file() and ".build" not in p.parts]
        return self.spark.createDataFrame(rows, "path string, content binary")

    def init(self) -> dict:
        self.dir.mkdir(exist_ok=True)
        return self._append("init", "", 0, {}, self._snap())

    def record(self, step: str, command: str = "", exit_code: int = 0, note: str = "") -> dict:
        """An event with the files changed since the last one."""
        before = json.loads((self.dir / "manifest.json").read_text()) if (self.dir / "manifest.json").is_file() else {}
        return self._append(step, command, exit_code, before, self._snap(), note)

    def _snap(self) -> dict[str, str]:
        return {r["path"]: r["hash"] for r in snapshot(self.files()).collect()}

    def _append(self, step, command, exit_code, before, after, note=""):
        frame = lambda s: self.spark.createDataFrame(sorted(s.items()), "path string, hash string")
        changed = [] if step == "init" else [{"file": r["path"], "before": r["before"], "after": r["after"]} for r in snapshot_diff(frame(before), frame(after)).orderBy("path").collect()]
        digest = lambda s: pack_hash(frame(s)).first()[0]
        event = {"ts": time.time(), "step": step, "command": command, "exit_code": exit_code, "note": note, "files_changed": changed, "inputs_hash": digest(after if step == "init" else before), "outputs_hash": digest(after)}
        with (self.dir / "log.jsonl").open("a", encoding="utf-8") as out:
            out.write(json.dumps(event, ensure_ascii=False) + "\n")
        (self.dir / "manifest.json").write_text(json.dumps(after))
        return event

    def events(self) -> DataFrame:
        lines = (self.dir / "log.jsonl").read_text("utf-8").splitlines() if self.exists else []
        rows = [(i, x["step"], x["command"], x["exit_code"], x["note"], json.dumps(x["files_changed"]), x["inputs_hash"], x["outputs_hash"]) for i, x in enumerate(map(json.loads, lines))]
        return self.spark.createDataFrame(rows, "seq long, step string, command string, exit_code long, note string, files_changed string, inputs_hash string, outputs_hash string")

    def tail(self, n: int = 10) -> DataFrame:
        """[W6]"""
        return tail(self.events(), n)

    def completed_steps(self) -> DataFrame:
        """[A21]"""
        return completed_steps(self.events())
