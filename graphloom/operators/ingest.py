"""Session ingestion: lines and documents -> events, scalar series, coverage, statistics."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import small
from ..functions import scalars as S
from ..model import SEVERITY_RANK, severity_rank
from ..storage import materialize, release

#: Largest quota whose rows a task holds in memory while it reads.
HEAP_ROWS = 1 << 16
EVENT = "ts string, kind string, source_file string, payload map<string,string>, ontology_ref string, severity string, epoch_ns long"


def line_events(lines: DataFrame) -> DataFrame:
    """[T4, T5, W8] lines (file, line, text) -> one event per line that matches a pattern, in arrival order ``seq``."""
    # A generator instead of a filter: a filter would be pushed below the class and match every pattern again.
    found = lines.select("*", F.explode(F.array_compact(F.array(S.log_class(F.col("text"))))).alias("c")).withColumn("ts", S.line_timestamp(F.col("text")))
    of = lambda which: S.class_value(F.col("c"), which)
    payload = F.create_map(F.lit("line"), F.col("line").cast("string"), F.lit("text"), S.clip(F.col("text"), of(3)))
    return found.select("ts", F.concat(F.lit("log."), of(1)).alias("kind"), F.col("file").alias("source_file"), payload.alias("payload"), F.lit(None).cast("string").alias("ontology_ref"), of(2).alias("severity"), S.epoch_ns(F.col("ts")).alias("epoch_ns"), F.struct("file", "line").alias("seq"))


def kind_counts(events: DataFrame) -> DataFrame:
    """[A7] Events per kind, before any retention."""
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def walk(docs: DataFrame, column: str = "doc", depth: int | None = None) -> DataFrame:
    """[T7] Every entry of nested documents: doc columns with path, key and value (VARIANT).

    One lateral explode per level, up to four levels in one pass over the documents.
    Without ``depth`` the levels go on until the frontier is empty: after every
    four the containers left are written to the shared folder, which also cuts
    their lineage; ``depth`` is for documents known to be flatter.
    """
    spark, keep = docs.sparkSession, [c for c in docs.columns if c != column]
    level = docs.select(*keep, F.lit("$").alias("path"), F.col(column).alias("value"))
    out, done = None, 0
    while done != depth:
        upto = done + 4 if depth is None else min(done + 4, depth)
        found = _levels(level, keep, upto - done)
        out, done = found if out is None else out.unionByName(found), upto
        if done == depth:
            break
        level, path = materialize(_containers(level, keep, 4), "walk")
        if level.isEmpty():
            release(spark, path)
            break
    return out


def _step(key: Column, pos: Column) -> Column:
    return F.when(key.isNull(), F.concat(F.lit("["), pos.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), key))


def _levels(level: DataFrame, keep: list[str], n: int) -> DataFrame:
    """The entries of n levels below, in one pass: each entry of the last level goes on as itself and as its own entries."""
    spark = level.sparkSession
    rows = level.select(*keep, F.col("path").alias("__path"), F.lit(None).cast("string").alias("key"), F.col("value").alias("__v"), F.lit(0).alias("__level"))
    for i in range(n):
        # An entry of an earlier level has ended: it is no part of what is opened here.
        both = F.when(F.col("__level") == i, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        rows = rows.withColumn("__open", F.explode(both if i else F.array(F.lit(True))))
        inner = spark.tvf.variant_explode_outer(F.when(F.col("__open"), F.col("__v")).outer()).toDF("__pos", "__key", "__value")
        rows = rows.lateralJoin(inner).where("not __open or __value is not null")
        of = lambda opened, kept: F.when(F.col("__open"), opened).otherwise(kept)
        path = F.concat("__path", _step(F.col("__key"), F.col("__pos")))
        rows = rows.select(*keep, of(path, F.col("__path")).alias("__path"), of(F.col("__key"), F.col("key")).alias("key"), of(F.col("__value"), F.col("__v")).alias("__v"), of(F.lit(i + 1), F.col("__level")).alias("__level"))
    return rows.select(*keep, F.col("__path").alias("path"), "key", F.col("__v").alias("value"))


def _containers(level: DataFrame, keep: list[str], n: int) -> DataFrame:
    """The objects and arrays n levels below; opening anything else gives no rows."""
    for _ in range(n):
        inner = level.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("__pos", "__key", "__value")
        path = F.concat("path", _step(F.col("__key"), F.col("__pos"))).alias("path")
        level = level.lateralJoin(inner).select(*keep, path, F.col("__value").alias("value"))
    return level.where(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)"))


def messages(docs: DataFrame, walked: DataFrame | None = None) -> DataFrame:
    """[T6] docs (file, doc) -> (file, topic, payload, ts) of every topic key at any depth.

    ``walked``, here and below: the documents' walk where it has been made already.
    """
    found = (walk(docs) if walked is None else walked).where(F.col("key").isNotNull() & S.is_topic(F.col("key")))
    return found.select("file", F.col("key").alias("topic"), F.col("value").alias("payload"), S.payload_timestamp(F.col("value")).alias("ts"), "path")


def signals(msgs: DataFrame) -> DataFrame:
    """[T8, F22] Fields of a message and of the objects in it: (file, topic, ts, field, name, value); private ones drop."""
    spark = msgs.sparkSession
    keep = [c for c in msgs.columns if c != "payload"]
    first = msgs.lateralJoin(spark.tvf.variant_explode(F.col("payload").outer())).where("key is not null").select(*keep, F.col("key").alias("__sub"), F.col("value").alias("__v"))
    # Each field goes on as itself and opened, so that messages are read once.
    both = first.withColumn("__open", F.explode(F.array(F.lit(False), F.lit(True))))
    both = both.lateralJoin(spark.tvf.variant_explode_outer(F.when(F.col("__open"), F.col("__v")).outer())).where("not __open or key is not null")
    of = lambda opened, kept: F.when(F.col("__open"), opened).otherwise(kept)
    found = both.select(*keep, of(F.col("key"), F.col("__sub")).alias("name"), of(F.concat_ws(".", "__sub", "key"), F.col("__sub")).alias("field"), of(F.col("value"), F.col("__v")).alias("value"))
    return found.where(~S.is_private_field(F.col("name")))


def active_bits(sig: DataFrame, bits: DataFrame) -> DataFrame:
    """[T9, J17] Set bits of bitmap fields, grounded: (…, name, bit, ontology_ref, severity); unknown where the dimension has none."""
    value = F.try_variant_get("value", "$", "long")
    integer = F.schema_of_variant("value") == "BIGINT"
    found = sig.where(S.is_bitmap_field(F.col("name")) & integer).withColumn("bit", F.explode(S.set_bits(value)))
    return ground_bits(found.drop("value"), bits.withColumnRenamed("field", "name"), ["name", "bit"])


def ground_bits(found: DataFrame, bits: DataFrame, on: list[str]) -> DataFrame:
    """[J17] Left join with the bit dimension."""
    dim = bits.select(*on, F.col("ref").alias("ontology_ref"), F.col("severity").alias("__s"))
    return found.join(small(dim), on, "left").withColumn("severity", F.coalesce("__s", F.lit("unknown"))).drop("__s")


def nominal_bits(active: DataFrame) -> DataFrame:
    """[A9] Counts of set bits that are no events."""
    return active.where("severity in ('nominal', 'info')").groupBy("name", "bit").agg(F.count("*").alias("n"))


def bit_events(active: DataFrame) -> DataFrame:
    return active.where("severity not in ('nominal', 'info')")


def mode_events(sig: DataFrame) -> DataFrame:
    """[W2] Observed modes: text values of the mode fields.

    Their severity is unknown, so they rank last: they are kept while there is
    room and displace nothing, in :func:`retain_topk` as in the buffer.
    """
    text = F.try_variant_get("value", "$", "string")
    return sig.where(F.col("name").isin("mc_action", "mode", "current_mode") & (F.schema_of_variant("value") == "STRING") & (text != "")).withColumn("mode", text).withColumn("severity", F.lit("unknown")).drop("value")


def scalar_series(sig: DataFrame) -> DataFrame:
    """[T10] (…, series, value) of numeric fields with a telling name."""
    kind = F.schema_of_variant("value")
    numeric = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    taken = S.is_bitmap_field(F.col("name")) | F.col("name").isin("mc_action", "mode", "current_mode")
    return sig.where(numeric & S.is_scalar_field(F.col("name")) & ~taken).withColumn("series", F.concat_ws(".", "topic", "field")).withColumn("value", F.try_variant_get("value", "$", "double"))


def first_n(df: DataFrame, key: list[str], order: list[str], n: int = 200) -> DataFrame:
    """[W3] The first n rows per key; the plan keeps n per task before its shuffle."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")


def series_cap(samples: DataFrame, order: list[str], n: int = 200) -> tuple[DataFrame, DataFrame]:
    """[W4] (samples kept, series with counts): n samples are shown, n + 1 counted, downsampled from n on."""
    ranked = samples.withColumn("seq", F.row_number().over(Window.partitionBy("series").orderBy(*order))).where(F.col("seq") <= n + 1)
    counts = ranked.groupBy("series").agg(F.count("*").alias("samples")).withColumn("downsampled", F.col("samples") >= n)
    return ranked.where(F.col("seq") <= n), counts


def top_k(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """[W5] The k most common keys; ties to the one first seen."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def retain_topk(events: DataFrame, quota: int, order: list[str], session: list[str] = ()) -> DataFrame:
    """[W1] The intended retention, set-based: critical events, and the quota's worth by rank, then arrival.

    Two-stage: a row among the first ``quota`` of its part can be among the first
    overall; so a huge session is cut in parallel before its rows meet.  Without
    sessions each task holds the first ``quota`` rows it has seen, so nothing is
    sorted whole; with them, and for quotas over ``HEAP_ROWS``, parts are salts.
    """
    rank = severity_rank(F.col("severity"))
    rest = events.where("not (severity <=> 'critical')")
    by = [F.desc(rank), *order]
    if session or quota > HEAP_ROWS:
        salt = F.pmod(F.xxhash64(*order), F.lit(64))
        near = rest.withColumn("__rn", F.row_number().over(Window.partitionBy(*session, salt).orderBy(*by))).where(F.col("__rn") <= quota).drop("__rn")
    else:
        near = rest.orderBy(*by).limit(max(0, quota))
    critical = events.where("severity = 'critical'")
    held = F.row_number().over(Window.partitionBy(*session, F.lit(0)).orderBy(*by))
    n = critical.groupBy(*session).agg(F.count("*").alias("__c")) if session else critical.agg(F.count("*").alias("__c"))
    ranked = near.withColumn("__rn", held)
    ranked = ranked.join(small(n), list(session), "left") if session else ranked.crossJoin(F.broadcast(n))  # without sessions one row
    kept = ranked.where(F.col("__rn") <= quota - F.coalesce("__c", F.lit(0))).drop("__rn", "__c")
    return kept.unionByName(critical)


class RankedBuffer:
    """[W1, W2] The sequential buffer: arrivals fill the quota, critical ones always enter, a later one takes the place of one of lower rank.

    The one that goes is the first of the lowest rank; but a rank 1 that arrived
    before any rank 0 goes before these.  Each rank is a queue, so an arrival
    takes the same time at any quota.  Rank 0 (such as mode observations) never
    displaces anything.
    """

    def __init__(self, quota: int):
        self.quota, self.size, self.number = quota, 0, 0
        self.queues: dict[int, deque] = {r: deque() for r in sorted(set(SEVERITY_RANK.values()))}

    def put(self, item, severity: str) -> None:
        """Keep an item whatever the quota."""
        self.queues[SEVERITY_RANK.get(severity, 0)].append((self.number, item))
        self.number, self.size = self.number + 1, self.size + 1

    def _victim(self, rank: int) -> deque | None:
        lower = [r for r, q in self.queues.items() if r < rank and q]
        if not lower:
            return None
        low = lower[0]
        if low == 0 and 1 in lower and self.queues[1][0][0] < self.queues[0][0][0]:
            low = 1
        return self.queues[low]

    def offer(self, item, severity: str, tested: str | None = None) -> tuple[bool, object]:
        """(whether the item is kept, the item that went for it or None); ``tested``: the severity that decides on entry, if another."""
        asked, gone = severity if tested is None else tested, None
        if asked != "critical" and self.size >= self.quota:
            queue = self._victim(SEVERITY_RANK.get(asked, 0))
            if queue is None:
                return False, None
            gone, self.size = queue.popleft()[1], self.size - 1
        self.put(item, severity)
        return True, gone

    def kept(self) -> list:
        """Items in order of arrival."""
        return [item for _, item in sorted((x for q in self.queues.values() for x in q), key=lambda x: x[0])]


def fold_retention(severities: list[str], quota: int, tested: list[str] | None = None) -> list[int]:
    """[W1, W2] Positions that a :class:`RankedBuffer` keeps of arrivals in this order."""
    buffer = RankedBuffer(quota)
    for i, severity in enumerate(severities):
        buffer.offer(i, severity, tested[i] if tested else None)
    return buffer.kept()


def retain_exact(events: DataFrame, quota: int, order: str, session: str) -> DataFrame:
    """[W1] The sequential buffer per session, for parity; a session is one task's rows by definition of the fold."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.iloc[fold_retention(pdf["severity"].fillna("").tolist(), quota)]

    return events.groupBy(session).applyInPandas(fold, events.schema)


# Coverage and statistics -----------------------------------------------------
def field_counts(docs: DataFrame, sig: DataFrame, walked: DataFrame | None = None) -> DataFrame:
    """[A8, F24] Field counters: scalar entries of the documents, and scanned fields; a field can count in both."""
    scalar = (walk(docs) if walked is None else walked).where(F.col("key").isNotNull() & ~F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)") & ~S.is_topic(F.col("key")))
    one = scalar.where(S.counts_for_coverage(F.col("key"))).select(F.col("key").alias("field"))
    return one.unionByName(sig.select("field")).groupBy("field").agg(F.count("*").alias("n"))


def topic_counts(docs: DataFrame, walked: DataFrame | None = None) -> DataFrame:
    return (walk(docs) if walked is None else walked).where(F.col("key").isNotNull() & S.is_topic(F.col("key"))).groupBy(F.col("key").alias("topic")).agg(F.count("*").alias("n"))


def msg_type_counts(docs: DataFrame, walked: DataFrame | None = None) -> DataFrame:
    return (walk(docs) if walked is None else walked).where(F.col("key").isNotNull() & S.is_msg_type(F.col("key"))).groupBy(F.col("key").alias("msg_type")).agg(F.count("*").alias("n"))


def coverage(observed: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """[J18, U4] key, n, status: registered (in both), unregistered or unobserved."""
    reg = registered.select(key, F.lit(True).alias("__r")).distinct()
    out = observed.join(reg, key, "full")
    status = F.when(F.col("__r") & F.col("n").isNotNull(), "registered").when(F.col("__r"), "unobserved").otherwise("unregistered")
    return out.select(key, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def message_stats(stream: DataFrame, cap: int = 200) -> DataFrame:
    """[A10, F23] One row: messages, kept under the cap per topic, private topics and their messages."""
    per = stream.groupBy("topic").agg(F.count("*").alias("n")).withColumn("private", S.is_private_topic(F.col("topic")))
    open_ = ~F.col("private")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), F.count("*").alias("topics"), F.coalesce(F.sum(F.when(open_, F.least("n", F.lit(cap)))), F.lit(0)).alias("kept"), F.count_if("private").alias("private_topics"), F.coalesce(F.sum(F.when(F.col("private"), F.col("n"))), F.lit(0)).alias("private_messages"))


def file_stats(files: DataFrame) -> DataFrame:
    """[A11] files (directory, bytes, lines) -> per directory and a total row."""
    sums = [F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")]
    return files.groupBy("directory").agg(*sums).unionByName(files.agg(F.lit("TOTAL").alias("directory"), *sums))


def cpu_summary(frames: DataFrame) -> DataFrame:
    """[A12] frames (interval, ticks, cpus, sys, user) -> frames, skipped, max, avg, p95 (index int(n*0.95)), above 80 %.

    The 95th is found through counts: of hundredths, then of parts of the one
    hundredth that holds it, then of the values in that part.  So only a bounded
    number of rows is ever ordered in one task.
    """
    total = F.col("ticks") * F.col("interval") * F.col("cpus")
    busy = 100 * (F.col("sys") + F.col("user")) / F.nullif(total, F.lit(0))
    reset = (F.col("interval") <= 0) | (F.col("interval") > 120)
    marked = frames.withColumn("busy", F.when(~reset & (total > 0), busy)).withColumn("skipped", reset | (F.col("busy") < 0) | (F.col("busy") > 100))
    fine = marked.where("busy between 0 and 100")
    stats = fine.agg(F.count("*").alias("frames"), F.bround(F.max("busy"), 1).alias("busy_max"), F.bround(F.avg("busy"), 1).alias("busy_avg"), F.count_if(F.col("busy") > 80).alias("high_frames"))
    level = fine.groupBy("busy").agg(F.count("*").alias("n")).crossJoin(F.broadcast(stats.select(F.floor(F.col("frames") * 0.95).alias("rank"))))
    for part in (F.floor(F.col("busy") * 100), F.floor(F.col("busy") * 1_000_000), F.col("busy")):
        level = level.withColumn("part", part)
        upto = level.groupBy("part", "rank").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("part")))
        at = upto.where("upto > rank").agg(F.min_by(F.struct("part", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank")), "part").alias("at"))
        level = level.drop("rank").crossJoin(F.broadcast(at)).where("part = at.part").select("busy", "n", F.col("at.rank").alias("rank"))
    p95 = level.agg(F.bround(F.min("busy"), 1).alias("busy_p95"))
    skipped = marked.agg(F.count_if("skipped").alias("skipped"))
    return stats.crossJoin(F.broadcast(p95)).crossJoin(F.broadcast(skipped))


def memory_summary(frames: DataFrame) -> DataFrame:
    """[A13] frames (total, free) -> used % max and mean."""
    used = 100 * (F.col("total") - F.col("free")) / F.nullif(F.col("total"), F.lit(0))
    return frames.select(used.alias("used")).where("used is not null").agg(F.count("*").alias("frames"), F.bround(F.max("used"), 1).alias("used_max"), F.bround(F.avg("used"), 1).alias("used_avg"))


def explain_bitmap(values: DataFrame, bits: DataFrame) -> DataFrame:
    """[J30] values (field, value) -> the field's known bits that are set; bits without index are skipped."""
    dim = bits.where("bit is not null")
    return values.join(small(dim), "field").where((F.col("value") >= 0) & (F.getbit(F.col("value"), F.col("bit")) == 1))
