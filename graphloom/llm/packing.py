"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut into whole windows; what is left of each goes
to a buffer.  A full buffer is packed: every piece starts as a partition of k
windows of which one holds it; the two partitions with the largest imbalance
are merged, the fullest windows of one with the emptiest of the other, until
one is left.  Its windows are near-equal.  k starts at the least possible
number and rises whenever a window exceeds the capacity.

One pass over the input without a shuffle; a buffer is the only state.
"""

from __future__ import annotations

import heapq
import json
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partition_id, text_slices

CAPACITY = 1024
#: Pieces in a buffer, and the longest piece there: shorter pieces balance better, at the price of more cuts.
BUFFER = 256
LONGEST = 256
#: Texts that both forms of a vocabulary must encode alike before the faster one is used.
PROBES = 3000
#: A word or blank run this long goes to the tokenizer, as merging takes the faster form quadratic time there; the ids are the same.
LONG_RUN = 5000
# Fixed value: how a byte-level tokenizer cuts text before merging.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG = re.compile(rf"(?<!\S)\S{{{LONG_RUN}}}|(?<!\s)\s{{{LONG_RUN}}}")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k windows of near-equal sums."""
    heap, made = [], 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        sums = np.zeros(k, np.int64)
        sums[0] = sizes[i]
        heap.append((-sizes[i], made, sums, [[i], *([] for _ in range(k - 1))]))
        made += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)  # sums in falling order
        _, _, b, right = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        joined = [x + y if x and y else x or y for x, y in zip(left, reversed(right), strict=True)]
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), made, sums, [joined[i] for i in order]))
        made += 1
    return heap[0][3] if heap else []


def balance(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``: the least k from the bound up that differencing can fill."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("a piece exceeds the capacity")
    k = -(-sum(sizes) // capacity)
    while True:
        windows = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        k += 1


def probe_texts(seed: int = 5, n: int = PROBES) -> list[str]:
    """Fixed texts of all sorts of characters and blanks, to hold two encoders against each other."""
    r = random.Random(seed)
    blanks = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\x0b", "\x1f", "\x85", "\u200b"]
    words = ["the", "don't", "I'll", "we've", "it's", "THE", "'s", "x'", "straße", "naïve", "École", "año", "Ünder", "12", "3.14", "2024-01-02", "a@b.cd", "+1 (377) 555", "foo_bar", "Ⅷ", "½", "٣٤", "日本語", "한국어", "русский", "עברית", "e\u0301", "𝄞", "👩\u200d💻", "\ufffd", "…", "--", "?!", "«»", "\\n", "<b>", "\x00", "\x7f"]

    def piece():
        k = r.randrange(6)
        if k <= 2:
            return r.choice(words)
        if k == 3:
            return "".join(r.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(r.randint(1, 14)))
        if k == 4:
            return "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x250), r.randrange(0x370, 0x600), r.randrange(0x4E00, 0x5000), r.randrange(0x1F300, 0x1F600)])) for _ in range(r.randint(1, 6)))
        return r.choice(blanks) * r.randint(1, 3)

    return ["".join(piece() + r.choice(["", " ", r.choice(blanks)]) for _ in range(r.randint(0, 12))) for _ in range(n)]


class Tokens:
    """text -> token ids.

    Texts go to a faster form of the tokenizer's vocabulary where there is one;
    those that might hold a special token or have a very long word or blank run
    go to the tokenizer itself.  :meth:`verify` holds both against each other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.model = path, Tokenizer.from_file(path)
        self.ranks, self.special = self._ranks(path)

    @staticmethod
    def _ranks(path: str):
        """The same vocabulary as merge ranks, and its special tokens; no ranks if the file is not a byte-level BPE whose ids are in merge order."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        if spec["model"].get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            return None, special
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        named = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(named[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        import tiktoken

        return tiktoken.Encoding("pieces", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={}), special

    def verify(self) -> None:
        """Raise if the faster form gives other ids than the tokenizer for any of the fixed probe texts."""
        if self.ranks:
            texts = [t for t in probe_texts() if self._plain(t)]
            for text, ids in zip(texts, self._exact(texts), strict=True):
                if self.ranks.encode_ordinary(text) != ids.tolist():
                    raise ValueError(f"{self.path}: its merge ranks give other ids than the tokenizer for {text!r}")

    def _plain(self, text: str) -> bool:
        return not any(s in text for s in self.special) and (len(text) < LONG_RUN or not _LONG.search(text))

    def _exact(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        return [self.ranks.encode_to_numpy(t, disallowed_special=()).astype("<u4") if self.ranks and self._plain(t) else self._exact([t])[0] for t in texts]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, buffer: int = BUFFER, longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document is the tokenizer's ids of its text (null: none) and ``end_id``;
    its whole windows come first, the rest is cut into pieces of at most
    ``longest`` that share windows.  A row gets its pieces even if its id is
    null or repeated.  Windows have gapless offsets from 0; sequence_id is
    unique and the same when a task is run again.  ``with_ids``: the ids too.
    Raises before any work if the two encoders of :class:`Tokens` differ.
    """
    Tokens(tokenizer).verify()
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]
    fields = fields if with_ids else fields[:-1]

    def run(batches):
        tokens, waiting, base = Tokens(tokenizer), [], partition_id() << 33
        made = 0

        def row(out, piece, sequence, offset):
            doc, start, ids, total = piece
            values = (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + sequence, offset, ids.astype(np.int32))
            for column, value in zip(out, values, strict=False):
                column.append(value)

        def flush(out):
            nonlocal made
            for window in balance([len(p[2]) for p in waiting], capacity):
                offset = 0
                for i in window:
                    row(out, waiting[i], made, offset)
                    offset += len(waiting[i][2])
                made += 1
            waiting.clear()

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], names=[f[0] for f in fields])

        for batch in text_slices(batches, 1):
            out = [[] for _ in fields]
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, ids in zip(ids_of, tokens.encode(texts), strict=True):
                ids = np.append(ids, np.array([end_id], "<u4"))
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    row(out, (doc, start, ids[start : start + capacity], len(ids)), made, 0)
                    made += 1
                rest = len(ids) - whole
                parts = -(-rest // longest)
                for k in range(parts):
                    start, end = whole + rest * k // parts, whole + rest * (k + 1) // parts
                    waiting.append((doc, start, ids[start:end], len(ids)))
                if len(waiting) >= buffer:
                    flush(out)
            yield batch_of(out)
        out = [[] for _ in fields]
        flush(out)
        yield batch_of(out)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.mapInArrow(run, schema)


def padding(lengths, capacity: int = CAPACITY) -> int:
    """Padding of windows of these lengths; a power of two needs none."""
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)
