"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence gets a logistic score, a
document is toxic if at least one sentence is: p = 1 - prod(1 - p_sentence)
(noisy-or).  Only documents are labelled; the gradient of the noisy-or finds
the sentences that carry the label.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, bounded_batches, text_slices

SENTENCE = re.compile(r"[^.!?\n]+")
#: Letters at a word's start that are features besides the word.
STARTS = (4, 5, 6)
#: Hash cells in which features are counted before the telling ones are kept by name, and how many are weighed at once.
CELLS, CELL_BLOCK = 1 << 22, 1 << 16


def features(chunk: str) -> list[str]:
    """Features of a blank-delimited chunk in lower case: the word within its punctuation and its starts."""
    word = chunk.strip("\"'.,;:!?()[]{}<>|*#%&$@-_/\\=+~`")
    if not word:
        return []
    return [word, *("^" + word[:n] for n in STARTS if len(word) >= n)]


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text)] or [(0, 0)]


@dataclass
class ToxicModel:
    """weights of kept features; bias of an empty sentence."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0

    def scorer(self):
        """text -> (score, [(start, end, sentence score), ...] of all sentences)."""
        weights, bias, known = self.weights, self.bias, {}

        def of(chunk: str) -> float:
            if len(known) >= CACHE_WORDS:
                known.clear()
            value = known[chunk] = sum(weights.get(f, 0.0) for f in features(chunk))
            return value

        def score(text: str | None):
            text = text or ""
            spans, low = sentences(text), text.lower()
            if len(low) != len(text):  # some letters change length; offsets are those of the text
                parts = [text[a:b].lower() for a, b in spans]
            else:
                parts = [low[a:b] for a, b in spans]
            z = np.fromiter((bias + sum([known[c] if c in known else of(c) for c in set(p.split())]) for p in parts), float, len(parts))
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), spans, p

        return score


def fit(texts: list[str], labels: list[int], least_gain: float = 16.0, epochs: int = 400, rate: float = 0.1, ridge: float = 1e-3, clean_weight: float = 3.0) -> ToxicModel:
    """Train on documents in memory; the caller bounds their number.

    Keeps features whose document counts differ between labels by a likelihood
    ratio of ``least_gain``, then fits their weights and the bias by Adam on
    the noisy-or's log loss.  One class only, or no rows: a constant score.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return ToxicModel({}, 3.0 if len(y) and y.min() == 1 else -8.0)
    totals = np.array([len(y) - y.sum(), y.sum()])

    def gain(n: np.ndarray) -> np.ndarray:
        """Likelihood ratio of counts per label (2 x features) against equal rates."""
        out = np.zeros(n.shape[1])
        for cells in (n, totals[:, None] - n):
            expected = cells.sum(0) * totals[:, None] / totals.sum()
            with np.errstate(divide="ignore", invalid="ignore"):
                out += 2 * np.nan_to_num(cells * np.log(cells / expected)).sum(0)
        return out

    def of_document(text: str) -> set[str]:
        return {f for c in set(text.lower().split()) for f in features(c)}

    # First by hash cells, in arrays of fixed size; then the features of telling cells by name.
    cells, open_ = np.zeros((2, CELLS), np.int32), np.empty(CELLS, bool)
    for text, label in zip(texts, labels, strict=True):
        hit = np.fromiter((zlib.crc32(f.encode()) % CELLS for f in of_document(text)), np.int64)
        cells[label, np.unique(hit)] += 1
    for at in range(0, CELLS, CELL_BLOCK):
        block = cells[:, at : at + CELL_BLOCK]
        open_[at : at + CELL_BLOCK] = (block.sum(0) >= 3) & (gain(block) >= least_gain / 2)
    seen = [Counter(), Counter()]
    for text, label in zip(texts, labels, strict=True):
        seen[label].update(f for f in of_document(text) if open_[zlib.crc32(f.encode()) % CELLS])
    del cells, open_
    names = sorted(seen[0] | seen[1])
    counts = np.array([[s[f] for f in names] for s in seen], float).reshape(2, -1)
    good = (counts.sum(0) >= 3) & (gain(counts) >= least_gain)
    names = [f for f, g in zip(names, good, strict=True) if g]
    ids = {f: i for i, f in enumerate(names)}
    doc_of, cell_s, cell_f = [], [], []
    for d, text in enumerate(texts):
        for start, end in sentences(text):
            hit = [ids[f] for f in {f for c in set(text[start:end].lower().split()) for f in features(c)} if f in ids]
            cell_s += [len(doc_of)] * len(hit)
            cell_f += hit
            doc_of.append(d)
    doc_of, cell_s, cell_f = np.array(doc_of), np.array(cell_s, int), np.array(cell_f, int)
    weight = np.where(y == 1, 1.0, clean_weight) / len(y)
    theta = np.append(np.zeros(len(names)), -8.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, epochs + 1):
        z = theta[-1] + np.bincount(cell_s, theta[cell_f], len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0) * weight
        g = pull[doc_of] * p
        grad = np.append(np.bincount(cell_f, g[cell_s], len(names)), g.sum()) + ridge * np.append(theta[:-1], 0) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return ToxicModel({f: float(w) for f, w in zip(names, theta, strict=False) if abs(w) > 1e-3}, float(theta[-1]))


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learnt from: crc32 of the id's text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = 1500, longest: int = 200_000, **options) -> ToxicModel:
    """Fit on at most ``rows_per_label`` labelled documents of each label, the first by a hash of the id.

    Documented bounds: these rows, and texts up to ``longest`` characters, so
    the sample fits the driver.  Rows for which :func:`held_out` holds, null
    ids and null labels teach nothing; of several labels of an id the largest
    counts, of several texts of an id the least; equal hashes go by id.
    """
    labels = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__y"))
    picked = [r for y in (0, 1) for r in labels.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_label).collect()]
    if not picked:
        return fit([], [], **options)
    bounded = docs.sparkSession.createDataFrame([(r["doc_id"], r["__y"]) for r in picked], "__id long, __y int")
    found = docs.where(F.length("text") <= longest).join(F.broadcast(bounded), docs["doc_id"] == F.col("__id"))
    rows = sorted(found.groupBy("__id").agg(F.min("text").alias("text"), F.first("__y").alias("y")).collect(), key=lambda r: r["__id"])
    return fit([r["text"] for r in rows], [r["y"] for r in rows], **options)


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, offending: float = 0.5) -> DataFrame:
    """docs with score (0 to 1), predicted (1 from ``threshold`` on) and offending sentences.

    offending: start, end (code points, end exclusive) and score of sentences
    with at least ``offending``.  Null and empty texts score as one empty
    sentence.  Clashing columns of docs are replaced; no row is dropped.
    """
    bounded_batches(docs.sparkSession)
    out = {"score", "predicted", "offending"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in out])
    at = docs.columns.index("text")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        of = model.scorer()
        for batch in text_slices(batches, at):
            scores, found = [], []
            for text in batch.column(at).to_pylist():
                value, spans, p = of(text)
                scores.append(value)
                found.append([{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= offending)])
            new = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found, span)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "score", "predicted", "offending"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")
