"""Approximate nearest neighbours by additive quantisation.

Every vector is the sum of M codewords, each of full dimension, one from each
codebook.  Codebooks are learnt on residuals and refined by least squares;
vectors are encoded by beam search and stored as M bytes and the squared norm
of the sum.  A query's inner products with all codewords (its lookup table)
give |q - x|^2 = |q|^2 + norm - 2 * (sum of M table cells).

A vector's cell is its nearest word of the first codebook.  Cells are laid out
in groups of bounded size: small cells share a group, a large one is dealt over
several.  A query goes to the groups of its nearest cells only, so a group is
read once and meets the queries that ask for it, as a stream.  Of the rows of a
group that a query asks for, a fixed share with the least table distance is
reranked on the original vectors; so the recall is the same at every size, for
any batch size and any partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BOOKS, WORDS, BEAM = 8, 256, 4
#: Rows of a group, and the share of its rows that is reranked.
GROUP, RERANK = 16_384, 1 / 6
#: Share of the non-empty cells that a query asks for; on vectors without any clusters, recall needs most of them.
PROBES = 0.8
#: Vectors that codebooks are fitted on (the index holds every vector), queries of one step.
SAMPLE, STEP = 16_384, 32


def usable(column):
    """Neither null nor empty nor zero, all components finite."""
    value = F.col(column).cast("array<double>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.when(value.isNotNull(), fine & F.exists(value, lambda x: x != 0)), F.lit(False))


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * x @ words.T).argmin(1)


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x books): the best of ``beam`` partial sums kept after each codebook."""
    n, (m, k, d) = len(x), books.shape
    rest, error, codes = x[:, None, :], (x**2).sum(1)[:, None], np.zeros((n, 1, 0), np.uint8)
    for b in range(m):
        words = books[b]
        dist = error[:, :, None] - 2 * (rest.reshape(-1, d) @ words.T).reshape(n, -1, k) + (words**2).sum(1)
        flat = dist.reshape(n, -1)
        keep = min(beam, flat.shape[1]) if b < m - 1 else 1
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        error = np.take_along_axis(flat, best, 1)
        parent, word = best // k, best % k
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - words[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    return codes[:, 0]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[b][codes[:, b]] for b in range(len(books)))


def fit_codebooks(x: np.ndarray, m: int = BOOKS, k: int = WORDS, rounds: int = 6, refine: int = 1, seed: int = 3) -> np.ndarray:
    """Residual k-means per codebook, then ``refine`` rounds of encoding and joint least squares."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    k = max(1, min(k, len(x)))
    rest, books = x.copy(), []
    for _ in range(m):
        words = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            near = _nearest(rest, words)
            size = np.bincount(near, minlength=k)
            sums = np.zeros_like(words)
            np.add.at(sums, near, rest)
            words[size > 0] = sums[size > 0] / size[size > 0, None]
        books.append(words)
        rest = rest - words[_nearest(rest, words)]
    books = np.stack(books)
    for _ in range(refine):
        gram, right = np.eye(m * k, dtype=np.float32), books.reshape(m * k, -1).copy()
        for at in range(0, len(x), 2048):  # in blocks, so that the indicator matrix stays small
            part = x[at : at + 2048]
            hot = np.zeros((len(part), m * k), np.float32)
            hot[np.arange(len(part))[:, None], beam_encode(part, books) + np.arange(m) * k] = 1
            gram += hot.T @ hot
            right += hot.T @ part
        books = np.linalg.solve(gram, right).reshape(m, k, -1).astype(np.float32)
    return books


@dataclass
class Index:
    """rows: (vec_id, pos, cell, codes, norm, embedding), all usable vectors, pos telling rows apart; books: the codebooks."""

    rows: DataFrame
    books: np.ndarray
    dimension: int
    path: str = ""


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, **options) -> Index:
    """Encode every usable vector; codebooks come from the ``sample`` vectors first by a hash of the id, then by id.

    Null ids and unusable vectors take no part, nor do vectors whose dimension is
    not the sample's most common one.  Vectors keep their type, float or double.
    An empty table gives an empty index.
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0)
    size = pc.list_value_length(picked).to_numpy()
    d = int(max(zip(*np.unique(size, return_counts=True)[::-1], strict=True))[1]) if len(size) else 0
    alike = picked.filter(pa.array(size == d)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    books = fit_codebooks(alike.reshape(-1, d).astype(np.float32), **options) if d else np.zeros((1, 1, 0), np.float32)
    names = ["vec_id", "pos", "cell", "codes", "norm", "embedding"]

    def encode(batches):
        for batch in batches:
            if len(batch):
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(np.float32)
                codes = beam_encode(x, books)
                norm = (decode(codes, books) ** 2).sum(1)
                columns = [batch.column(0), batch.column(2), pa.array(_nearest(x, books[0]), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm, pa.float32()), batch.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = rows.where(F.size("embedding") == d).withColumn("pos", F.monotonically_increasing_id())
    coded, path = materialize(rows.mapInArrow(encode, f"vec_id long, pos long, cell int, codes binary, norm float, embedding array<{kind}>"), "index")
    return Index(coded, books, d, path)


def layout(sizes: dict[int, int], group: int = GROUP) -> dict[int, tuple[int, int]]:
    """cell -> (first group, number of groups): small cells fill a group up to its size, a larger one gets groups of its own."""
    out, now, held = {}, 0, 0
    for cell, n in sorted(sizes.items()):
        if n > group:
            continue
        if held and held + n > group:
            now, held = now + 1, 0
        out[cell] = (now, 1)
        held += n
    now += bool(held)
    for cell, n in sorted(sizes.items()):
        if n > group:
            out[cell] = (now, -(-n // group))
            now += -(-n // group)
    return out


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least (distance, id) per row."""
    return np.lexsort((ids, dist), axis=-1)[:, :k]


def _vectors(column, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _prober(words: np.ndarray, places: dict[int, tuple[int, int]], probes: float):
    """(id, v) -> (id, v, cells asked for as a bit set, groups that hold them)."""
    cells = np.array(sorted(places), np.int64)
    first, many = (np.array([places[c][i] for c in cells.tolist()], np.int64) for i in (0, 1))
    asked = max(1, int(np.ceil(probes * len(cells))))

    def probe(batches):
        for batch in batches:
            if not len(batch):
                continue
            q = _vectors(batch.column(1), len(batch))
            dist = (words[cells].astype(np.float64) ** 2).sum(1) - 2 * q @ words[cells].T
            near = np.sort(np.argsort(dist, axis=1, kind="stable")[:, :asked], axis=1)
            bits, groups = [], []
            for row in near:
                mask = np.zeros(-(-len(words) // 8) * 8, np.uint8)
                mask[cells[row]] = 1
                bits.append(np.packbits(mask).tobytes())
                groups.append(np.unique(np.concatenate([np.arange(a, a + n) for a, n in zip(first[row], many[row], strict=True)])).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array(groups, pa.list_(pa.int64()))], names=["id", "v", "bits", "groups"])

    return probe


def _scanner(books: np.ndarray, k: int, rerank: float):
    """Rows sorted by group and kind: a group's vectors (kind 0), then its queries (kind 1) -> each query's k best of the group."""
    m = len(books)

    def best_of(ids, q, bits, rows):
        vec, cell, codes, norm, x = rows
        asked = np.unpackbits(bits, axis=1)[:, cell].astype(bool)
        score = np.broadcast_to(norm, (len(ids), len(vec))).copy()
        for b in range(m):
            score -= 2 * (q.astype(np.float32) @ books[b].T)[:, codes[:, b]]
        score[~asked] = np.inf
        share = min(len(vec), max(4 * k, int(rerank * len(vec)) + k))
        # Ties at the edge of the share go to smaller ids: rows are in id order and the sort is stable.
        edge = np.partition(score, share - 1, axis=1)[:, share - 1 : share]
        near = np.argsort(np.where(score < edge, 0, np.where(score == edge, 1, 2)), axis=1, kind="stable")[:, :share]
        dist = np.sqrt(((x[near] - q[:, None, :]) ** 2).sum(2))
        found = vec[near]
        dist = np.where((found == ids[:, None]) | np.isinf(np.take_along_axis(score, near, 1)), np.inf, dist)
        best = _best(dist, found, k)
        dist, found = np.take_along_axis(dist, best, 1), np.take_along_axis(found, best, 1)
        at, r = np.nonzero(np.isfinite(dist))
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found[at, r]), pa.array(dist[at, r])], names=["query_id", "vec_id", "score"])

    def gathered(parts):
        vec = np.concatenate([p.column(2).to_numpy(zero_copy_only=False) for p in parts])
        order = np.argsort(vec, kind="stable")
        cell = np.concatenate([p.column(3).to_numpy(zero_copy_only=False) for p in parts])[order]
        codes = np.frombuffer(b"".join(b for p in parts for b in p.column(4).to_pylist()), np.uint8).reshape(-1, m)[order]
        norm = np.concatenate([p.column(5).to_numpy(zero_copy_only=False) for p in parts])[order]
        return vec[order], cell, codes, norm, np.concatenate([_vectors(p.column(6), len(p)) for p in parts])[order]

    def scan(batches):
        now, parts, rows = None, [], None
        for batch in batches:
            group, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if a == b:
                    continue
                part = batch.slice(int(a), int(b - a))
                if group[a] != now:
                    now, parts, rows = group[a], [], None
                if kind[a] == 0:
                    parts.append(part)
                elif parts:
                    rows = rows or gathered(parts)
                    for at in range(0, len(part), STEP):
                        some = part.slice(at, STEP)
                        bits = np.frombuffer(b"".join(some.column(7).to_pylist()), np.uint8).reshape(len(some), -1)
                        yield best_of(some.column(2).to_numpy(zero_copy_only=False), _vectors(some.column(6), len(some)), bits, rows)

    return scan


def search(index: Index, queries: DataFrame, k: int = 10, rerank: float = RERANK, probes: float = PROBES, group: int = GROUP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found, by distance, then id.

    score is the Euclidean distance of the original vectors in double
    precision; a query's own id is no candidate.  Queries are never gathered:
    each is sent to the groups of its cells.  Repeated ids of indexed rows can
    both be found, a repeated query id gives the neighbours of each of its rows
    once; unusable queries have no rows.
    """
    spark = queries.sparkSession
    sizes = {r["cell"]: r["count"] for r in index.rows.groupBy("cell").count().collect()}  # at most as many as a codebook has words
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    places = layout(sizes, group)
    kind = index.rows.schema["embedding"].dataType.simpleString()
    where = spark.createDataFrame([(c, a, n) for c, (a, n) in places.items()], "cell int, first long, many long")
    rows = index.rows.join(F.broadcast(where), "cell").select((F.col("first") + F.pmod(F.xxhash64("pos"), F.col("many"))).alias("grp"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "cell", "codes", "norm", F.col("embedding").alias("v"), F.lit(None).cast("binary").alias("bits"))
    asked = queries.where(F.col(id_col).isNotNull() & usable(vector_col) & (F.size(vector_col) == index.dimension)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    asked = asked.mapInArrow(_prober(index.books[0], places, probes), f"id long, v {kind}, bits binary, groups array<long>").withColumn("grp", F.explode("groups"))
    none = F.lit(None)
    asked = asked.select("grp", F.lit(1).alias("kind"), "id", none.cast("int").alias("cell"), none.cast("binary").alias("codes"), none.cast("float").alias("norm"), "v", "bits")
    dealt = rows.unionByName(asked).repartition("grp").sortWithinPartitions("grp", "kind")
    found = dealt.mapInArrow(_scanner(index.books, k, rerank), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
