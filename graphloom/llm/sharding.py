"""Sharding by extendible hashing; DataFrame functions only.

The directory is indexed by the leading bits of a key's hash.  It starts as
one bucket; only buckets over the byte limit split on one more bit.  One scan
of the table writes bytes per hash; the directory is computed from sums of
these per fine hash cell, so no bucket is ever gathered.  Rows that no bit
tells apart (those of one key) are paged by running sums of their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import small
from .common import materialize, release

#: Bits of the hash that a directory may use.
MOST_BITS = 48
#: Bits of fine cells beyond what equal buckets would need; cells of one prefix that meet in one task have at most 2 ** TASK_BITS members.
SPARE_BITS, TASK_BITS = 6, 8


def key_bits(key: Column) -> Column:
    """The first 48 bits of the key's SHA-256 as a long; a null key hashes like ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.sha2(text, 256), 1, MOST_BITS // 4), 16, 10).cast("long")


def directory(cells: DataFrame, limit: int, bits: int) -> DataFrame:
    """(cell, depth): of each fine cell (cell, bytes) the bits that its bucket uses.

    A bucket of d bits exists if all shorter prefixes of it are over the limit;
    so a cell's depth is one more than the greatest d whose prefix is over it,
    and at most ``bits``.  Short prefixes have many cells: these meet their
    prefix's sum in salted parts.
    """
    steps = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("d"))
    steps = steps.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - d)"))
    over = steps.groupBy("d", "prefix").agg(F.sum("bytes").alias("held")).where(F.col("held") > limit).select("d", "prefix")
    salts = F.expr(f"cast(shiftleft(1, greatest({bits - TASK_BITS} - d, 0)) as int)")
    over = over.select("d", "prefix", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salted = steps.where(F.col("d") < bits).select("cell", "d", "prefix", F.pmod(F.xxhash64("cell"), salts).cast("int").alias("salt"))
    deepest = salted.join(over, ["d", "prefix", "salt"], "left_semi").groupBy("cell").agg((F.max("d") + 1).alias("depth"))
    return cells.select("cell").join(deepest, "cell", "left").select("cell", F.coalesce("depth", F.lit(0)).alias("depth"))


def cell_of(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, MOST_BITS - depth)


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """rows of overfull cells with __page, so that a cell's page holds at most ``limit`` bytes; a larger row has a page of its own.

    The rows are written once with their task and place in it, so that pages do
    not change when a task runs again.  Running sums have two levels, tasks and
    rows of a task, so no cell is gathered.  A page holds the rows that begin in
    a stretch of bytes so wide that the last of them still fits: rows of one size
    fill pages wholly, others more than half.
    """
    rows, _ = materialize(rows.withColumns({"__task": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "overfull")
    large = 2 * F.col("n_bytes") > limit
    # Small rows count by bytes; large ones have a page each, after those of the small rows.
    sizes = {"__small": F.when(large, 0).otherwise(F.col("n_bytes")), "__large": large.cast("long")}
    rows = rows.withColumns(sizes)
    small = F.when(F.col("__large") == 0, F.col("n_bytes"))
    tasks = rows.groupBy("__cell", "__task").agg(F.sum("__small").alias("__s"), F.sum("__large").alias("__l"), F.max(small).alias("__max"), F.min(small).alias("__min"))
    ahead = Window.partitionBy("__cell").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    most = F.greatest(F.coalesce(F.max("__max"), F.lit(0)), F.lit(1))
    width = F.when(F.min("__min") == F.max("__max"), F.floor(F.lit(limit) / most) * most).otherwise(F.lit(limit) - most + 1)
    pages = tasks.groupBy("__cell").agg(F.sum("__s").alias("__all"), width.alias("__width")).withColumn("__first", F.floor(F.col("__all") / F.col("__width")) + 1).drop("__all")
    starts = tasks.select("__cell", "__task", zero(F.sum("__s").over(ahead)).alias("__s0"), zero(F.sum("__l").over(ahead)).alias("__l0")).join(pages, "__cell")
    before = Window.partitionBy("__cell", "__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__sb": zero(F.sum("__small").over(before)), "__lb": zero(F.sum("__large").over(before))}).join(starts, ["__cell", "__task"])
    page = F.when(F.col("__large") == 0, F.floor((F.col("__s0") + F.col("__sb")) / F.col("__width"))).otherwise(F.col("__first") + F.col("__l0") + F.col("__lb"))
    return rows.withColumn("__page", page.cast("long"))


def shard(df: DataFrame, key_col: str, size: Column, limit: int) -> DataFrame:
    """df with n_bytes, shard (the bucket's bits as text, '' for the whole table) and depth.

    ``limit``: bytes of a shard.  Rows of one key share a bucket however large,
    as no bit tells them apart: such rows, and single rows over the limit, are in
    buckets at the greatest depth with overflow pages, ``shard`` then ending in
    ``+page``; a page keeps to the limit but for a row that alone is over it.
    Null sizes are 0, a null key hashes like an empty one; clashing columns are
    replaced; an empty table stays empty.
    """
    names = ("n_bytes", "shard", "depth")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    sized = df.select(*kept, F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("n_bytes"), key_bits(F.col(key_col)).alias("__bits"))
    spark = df.sparkSession
    hashes, path = materialize(sized.groupBy("__bits").agg(F.sum("n_bytes").alias("bytes"), F.max("n_bytes").alias("largest")), "hashes")
    total = hashes.agg(F.sum("bytes")).first()[0] or 0
    bits = min(MOST_BITS, max(1, -(-total // limit)).bit_length() + SPARE_BITS)
    while True:
        cells = hashes.groupBy(cell_of(F.col("__bits"), bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("keys"), F.max("largest").alias("largest"))
        # A cell of one key, or one that a row fills, cannot shrink by more bits.
        over = cells.where((F.col("bytes") > limit) & (F.col("keys") > 1) & (F.col("largest") < F.col("bytes"))).limit(1).count()
        if not over or bits == MOST_BITS:
            break
        bits = min(MOST_BITS, bits + 8)
    full = (F.col("bytes") > limit) & (F.col("largest") < F.col("bytes"))
    found, _ = materialize(directory(cells, limit, bits).join(cells.select("cell", full.alias("__full")), "cell").select(F.col("cell").alias("__cell"), "depth", "__full"), "directory")
    release(spark, path)
    # A directory of checked size goes to the rows, so that they stay where they are; a larger one meets them in a shuffled join.
    placed = lambda cells: sized.join(small(cells), cell_of(F.col("__bits"), bits) == F.col("__cell"))
    bucket = F.substring(F.lpad(F.bin("__bits"), MOST_BITS, "0"), F.lit(1), F.col("depth"))
    last = lambda rows, name: rows.select(*kept, "n_bytes", name.alias("shard"), F.col("depth").cast("int").alias("depth"))
    if not found.where("__full").limit(1).count():
        return last(placed(found), bucket)
    paged = _paged(placed(found.where("__full")), limit)
    return last(placed(found.where("not __full")), bucket).unionByName(last(paged, F.concat(bucket, F.lit("+"), F.col("__page").cast("string"))))
