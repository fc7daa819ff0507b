"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..storage import materialize, release

__all__ = ["CACHE_WORDS", "TEXT_BATCH_BYTES", "TEXT_BATCH_ROWS", "WordHashes", "bounded_batches", "materialize", "mix64", "partition_id", "release", "shingles", "table", "text_slices", "words_of"]

#: Rows, and bytes of text, that an operator on whole texts works on at once.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 256, 4 << 20
#: Bytes of an Arrow batch on its way to a Python worker; Spark's own bound is 64 MiB, of which JVM and worker hold copies.
SENT_BYTES = 8 << 20
#: A word cache is emptied at this size, so a worker's memory stays bounded.
CACHE_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's bound of an Arrow batch to SENT_BYTES for the session, if it is higher.

    Plans run after they are built, so the value cannot be restored; it is always
    the same one and bounds bytes, so neither results nor other plans' memory
    depend on the order in which plans are built.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)b?", spark.conf.get(key).strip().lower()).groups()
    now = int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    if now <= 0 or now > SENT_BYTES:
        spark.conf.set(key, f"{SENT_BYTES}b")


def text_slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = TEXT_BATCH_ROWS, most: int = TEXT_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut (without copying) to at most ``rows`` rows and ``most`` bytes of a text or binary column.

    What is sent at once is bounded by :func:`bounded_batches`, what an operator
    makes of it at once is bounded here.  A longer text is a slice by itself.  Empty batches pass.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            yield batch
            continue
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            held = upto[at - 1] if at else 0
            end = min(max(int(np.searchsorted(upto, held + most, "right")), at + 1), at + rows, n)
            yield batch.slice(at, end - at)
            at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on a uint64 array."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII blanks, A-Z in lower case; null: none.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is the rule.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """The set of 64-bit shingle hashes, sorted.

    Fewer words than ``width``: the whole sequence is one shingle, kept apart
    from longer ones by its length; no words: empty.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix64(out * np.uint64(0x100000001B3) + h[k : n - width + 1 + k])
    return np.unique(out)


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0
