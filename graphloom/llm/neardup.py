"""MinHash near-duplicates with SuperMinHash signatures.

Steps: shingle sets -> classes of equal sets -> SuperMinHash signatures of one
text per class -> bands -> candidate pairs -> exact check on full sets ->
union-find groups.

SuperMinHash gives every shingle a random permutation of the signature slots
and stores ``rank + uniform`` in each, so the slots of one shingle are
correlated and the estimate varies less than with independent hashes.  A set
fills all slots after few ranks; as soon as no slot can fall any more the loop
stops.

No pairs of a bucket are listed as such.  First every member of a bucket is
checked against the bucket's smallest member (a star).  Groups of copies become
one component there.  Only buckets that then still hold several components get
a second round: their members are compared block by block on signatures, and
only the members with a partner there are sent again with their full sets for
the exact check.  So every pair that shares a
bucket is either in one component or has been tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, bounded_batches, materialize, mix64, release, shingles, text_slices, words_of
from .components import connected_components

SLOTS = 96
BANDS = 24
#: Rows of a block in the second round, and texts that share one copy of the centre in a check.
BLOCK = 256
CHUNK = 64
#: Standard deviations below the threshold at which a pair of signatures is still checked on full sets.
SLACK = 5.5


def superminhash(x: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signature of a set of 64-bit hashes: ``slots`` floats, inf for the empty set."""
    h = np.full(slots, np.inf)
    n = len(x)
    if not n:
        return h
    rows, perm, first = np.arange(n), None, None
    with np.errstate(over="ignore"):
        for j in range(slots):
            z = mix64(x ^ mix64(np.full(1, j, np.uint64)))
            k = j + (((z & np.uint64(0xFFFFFF)) * np.uint64(slots - j)) >> np.uint64(24)).astype(np.int64)
            value = j + (z >> np.uint64(24)).astype(np.float64) * 2.0**-40
            if j == 0:
                slot = first = k
            else:
                if perm is None:
                    perm = np.tile(np.arange(slots, dtype=np.int16), (n, 1))
                    perm[rows, first] = 0
                slot = perm[rows, k]
                perm[rows, k] = perm[:, j]
            np.minimum.at(h, slot, value)
            if h.max() <= j + 1:
                break
    return h


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    v = signature.view(np.uint64).reshape(bands, -1)
    out = mix64(np.arange(bands, dtype=np.uint64))
    with np.errstate(over="ignore"):
        for k in range(v.shape[1]):
            out = mix64(out ^ v[:, k])
    return out.view(np.int64)


def set_class(x: np.ndarray) -> bytes:
    """128-bit name of a shingle set."""
    return xxhash.xxh3_128_digest(x.tobytes())


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y|, exactly; x, y sorted and distinct."""
    if not len(x) or not len(y):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _signer(width: int, slots: int, bands: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), {}
        for batch in text_slices(batches, 1):
            n, names, keys, signs = [], [], [], []
            for text in batch.column(1).to_pylist():
                x = shingles(words_of(text), width, hashes)
                n.append(len(x))
                if not len(x):
                    names.append(None), keys.append(None), signs.append(None)
                    continue
                name = set_class(x)
                if name not in known:
                    if len(known) > 4096:
                        known.clear()
                    s = superminhash(x, slots)
                    known[name] = band_keys(s, bands), (mix64(s.view(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()
                names.append(name), keys.append(known[name][0]), signs.append(known[name][1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                names=["doc_id", "n_shingles", "node", "keys", "sign"],
            )

    return sign


def _sets(width: int):
    """(node, text) -> (node, set): only texts whose set is the node's, for ids that several texts share."""

    def run(batches):
        hashes = WordHashes()
        for batch in text_slices(batches, 1):
            nodes, out = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = shingles(words_of(text), width, hashes)
                if set_class(x) == node:
                    nodes.append(node), out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.binary())], names=["node", "set"])

    return run


def _checker(percent: int):
    """Rows sorted by (centre, salt, kind): a centre's set, then the sets to check against it."""

    def check(batches):
        at, centre = None, None
        for batch in text_slices(batches, 4):
            a, b = [], []
            for left, salt, kind, right, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                x = np.frombuffer(data, np.uint64)
                if kind == 0:
                    at, centre = (left, salt), x
                elif at == (left, salt) and similar(centre, x, percent):
                    a.append(left), b.append(right)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return check


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Each b's set moves once; a's set moves once for every CHUNK of its pairs,
    so an a with many pairs is spread over many tasks.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("salts"))
    pairs = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    members = pairs.join(sets.select(F.col("node").alias("b"), "set"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "set")
    centres = salts.join(sets.select(F.col("node").alias("a"), "set"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"), "set")
    dealt = centres.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return dealt.mapInArrow(_checker(percent), "a binary, b binary")


def _groups(batches: Iterator[pa.RecordBatch], columns: int, sized: int) -> Iterator[list[tuple]]:
    """Rows with equal first three columns (key, i, j), which come one after the other; groups of one row are left out."""
    group, rows = None, []
    for batch in text_slices(batches, sized):
        for row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
            if row[:3] != group:
                if len(rows) > 1:
                    yield rows
                group, rows = row[:3], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


class _Block:
    """A group of rows (key, i, j, own, node, comp, n, band, keys, sign, ...) and which pairs of it may be similar.

    A pair is looked at in the first band that it shares only, between different
    components, and in two different blocks if the group is of two.
    """

    def __init__(self, rows: list[tuple], percent: int, slots: int):
        self.percent, self.rows = percent, rows
        self.least = slots * percent / 100 - SLACK * (slots * percent / 100 * (1 - percent / 100)) ** 0.5
        self.own = np.array([r[3] for r in rows], np.int64)
        self.sizes = np.array([r[6] for r in rows], np.int64)
        self.comps = np.unique([r[5].hex() for r in rows], return_inverse=True)[1]
        self.keys = np.array([r[8] for r in rows], np.int64)
        self.signs = np.frombuffer(b"".join(r[9] for r in rows), np.uint16).reshape(len(rows), -1)
        self.band, self.crossing = rows[0][7], rows[0][1] != rows[0][2]

    def partners(self, p: int) -> np.ndarray:
        fit = (self.comps != self.comps[p]) & (100 * np.minimum(self.sizes, self.sizes[p]) >= self.percent * np.maximum(self.sizes, self.sizes[p]))
        fit[: p + 1] = False
        if self.crossing:
            fit &= self.own != self.own[p]
        q = np.flatnonzero(fit)
        if self.band:
            q = q[~(self.keys[q, : self.band] == self.keys[p, : self.band]).any(1)]
        return q[(self.signs[q] == self.signs[p]).sum(1) >= self.least]


def _survivors(percent: int, slots: int):
    """Of each group the rows that have a partner by signature; only these need their sets."""

    def run(batches):
        for rows in _groups(batches, 10, 9):
            block, alive = _Block(rows, percent, slots), set()
            for p in range(len(rows) - 1):
                q = block.partners(p)
                if len(q):
                    alive |= {p, *q.tolist()}
            if alive:
                kept = [rows[i] for i in sorted(alive)]
                types = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], t) for i, t in enumerate(types)], names=["key", "i", "j", "own", "node", "comp", "n", "band", "keys", "sign"])

    return run


def _linker(percent: int, slots: int):
    """Links between components of the groups' surviving rows, which have their sets as the eleventh column.

    Components that a link joins are one from then on, so a group yields fewer
    links than it has components.
    """

    def within(rows):
        block = _Block(rows, percent, slots)
        sets: dict[int, np.ndarray] = {}
        of = lambda i: sets[i] if i in sets else sets.setdefault(i, np.frombuffer(rows[i][10], np.uint64))
        for p in range(len(rows) - 1):
            for k in block.partners(p):
                if block.comps[k] != block.comps[p] and similar(of(p), of(k), percent):
                    yield rows[p][5], rows[k][5]
                    block.comps[block.comps == block.comps[k]] = block.comps[p]

    def link(batches):
        for rows in _groups(batches, 11, 10):
            yield _links(within(rows))

    return link


def _links(found) -> pa.RecordBatch:
    found = list(found)
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _blocks(found: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, one row for each group of two blocks to compare.

    A component with more than BLOCK members of a bucket has blocks of its own,
    which are never compared with each other; the others share blocks.
    """
    parts = found.groupBy("key", "comp").agg(F.count("*").alias("c")).withColumn("own_blocks", F.when(F.col("c") > BLOCK, F.ceil(F.col("c") / BLOCK)).otherwise(0))
    keys = parts.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("size"), F.sum(F.when(F.col("own_blocks") == 0, F.col("c")).otherwise(0)).alias("small")).where("comps > 1")
    keys = keys.select("key", F.ceil(F.col("small") / BLOCK).alias("shared"))
    large = parts.where("own_blocks > 0").join(keys, "key").select("key", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("own_blocks") - 1), lambda i: F.struct(F.xxhash64("comp", i).alias("id"), F.col("comp").alias("comp")))).alias("block"))
    mixed = keys.where("shared > 0").select("key", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("shared") - 1), lambda i: F.struct(i.alias("id"), F.lit(None).cast("binary").alias("comp")))).alias("block"))
    all_blocks = large.unionByName(mixed).groupBy("key").agg(F.collect_list("block").alias("blocks"))
    rows = found.join(keys, "key").join(parts.select("key", "comp", "own_blocks"), ["key", "comp"]).join(all_blocks, "key")
    own = F.when(F.col("own_blocks") > 0, F.xxhash64("comp", F.pmod(F.xxhash64("node"), F.col("own_blocks")))).otherwise(F.pmod(F.xxhash64("comp"), F.col("shared")))
    others = F.filter("blocks", lambda b: b["comp"].isNull() | (b["comp"] != F.col("comp")))
    rows = rows.withColumn("own", own).withColumn("b", F.explode(others))
    return rows.select("key", F.least("own", F.col("b.id")).alias("i"), F.greatest("own", F.col("b.id")).alias("j"), "own", "node", "comp", "n", "band")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept, for every row.

    Null or blank texts: n_shingles 0, their own component.  Equal texts (or
    equal sets) are one class and always linked.  A repeated id gets a row per
    row; its smallest component stands for each text.  A null id: component_id
    null and kept true, as nothing names it a copy.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed, _ = materialize(source.mapInArrow(_signer(width, slots, bands), "doc_id long, n_shingles long, node binary, keys array<long>, sign binary"), "signed")
    classes, _ = materialize(
        signed.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sign").alias("sign")), "classes"
    )

    keyed = classes.select("node", "rep", "n", F.posexplode("keys").alias("band", "key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("centre")).where("members > 1")
    members, m_path = materialize(keyed.join(buckets, "key"), "members")
    needed = members.groupBy("node").agg(F.first("rep").alias("doc_id"))
    sets, t_path = materialize(needed.join(source, "doc_id").select("node", "text").mapInArrow(_sets(width), "node binary, set binary").dropDuplicates(["node"]), "sets")

    sizes = members.groupBy("node").agg(F.first("n").alias("n"))
    star = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"), "n").distinct()
    star = star.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").where(f"100 * least(n, n_a) >= {percent} * greatest(n, n_a)")
    links, l_path = materialize(_verified(star.select("a", "b"), sets, percent), "links")
    first, f_path = connected_components(links)

    # Second round: what the stars left in several components of one bucket.  Pairs with the centre have been tested.
    found = members.join(first, "node", "left").select("key", "band", "node", "n", F.coalesce("comp", "node").alias("comp"), (F.col("node") == F.col("centre")).alias("is_centre"))
    group = ["key", "i", "j"]
    columns = [*group, "own", "node", "comp", "n", "band", "keys", "sign"]
    rest = _blocks(found.where("not is_centre")).join(classes.select("node", "keys", "sign"), "node")
    rest = rest.select(*columns).repartition(*group).sortWithinPartitions(*group)
    alive, alive_path = materialize(rest.mapInArrow(_survivors(percent, slots), "key long, i long, j long, own long, node binary, comp binary, n long, band int, keys array<long>, sign binary"), "alive")
    rest = alive.join(sets, "node").select(*columns, "set").repartition(*group).sortWithinPartitions(*group)
    late, late_path = materialize(rest.mapInArrow(_linker(percent, slots), "a binary, b binary").distinct(), "late")
    second, s_path = connected_components(late)

    groups = first.join(second.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    only = second.join(first, "node", "left_anti").select("node", "comp")  # classes that only the second round links
    groups = groups.unionByName(only)
    named = classes.select("node", "rep").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    names, _ = materialize(named.join(smallest, "comp").select("node", "component_id"), "names")
    release(spark, m_path, t_path, l_path, f_path, alive_path, late_path, s_path)

    out = signed.select("doc_id", "n_shingles", "node").join(names, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the near-duplicates: of each group the row with the smallest id stays.

    Repeated rows of one id count as copies of each other; one of them stays,
    the smallest by its other columns' text.  Rows without id stay.
    """
    verdict = near_duplicates(docs, id_col, **options).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("__component"))
    verdict = verdict.where("doc_id = __component").select(F.col("doc_id").alias("__id"))
    kept = docs.join(verdict, docs[id_col].cast("long") == F.col("__id"), "left_semi")
    order = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    kept = kept.withColumn("__rn", F.row_number().over(Window.partitionBy(id_col).orderBy(order))).where("__rn = 1").drop("__rn")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
