"""Mixing sources to target weights with soft membership.

A word-level classifier, fitted on a labelled table, gives each document a
posterior over domains (the mean posterior of its words, so a text in two
languages belongs to both).  Nonnegative rates per document are then fitted by
projected gradient least squares, so that the expected tokens of each domain
meet their targets.

A rate after s steps is a fixed fold of the document's posterior over the s
error vectors so far.  So no rates are stored between steps: each step is one
aggregation to K sums.  The fold is run in numpy over Arrow batches of (tokens,
membership); the final rates use the same fold as a Spark expression.  Where
the steps end short of the targets, Newton steps on the optimum's K unknowns
finish the same fit.
"""

from __future__ import annotations

import warnings
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHE_WORDS, bounded_batches, materialize, text_slices

#: Distance to a target, as a part of it, that is reported.
TOLERANCE = 0.01
#: Steps of a membership within a cell of alike documents, the most cells that a fit is finished on, and its last steps over all documents.
GRID, MOST_CELLS, POLISH = 256, 200_000, 2
#: Windows that a domain's labelled rows are dealt over, step by step, before the last choice; each number divides the one before.
SALTS = (64, 8)
STRIP = "\"'.,;:!?()[]{}<>|*#%&$@-_/\\=+~`0123456789"


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


@dataclass
class DomainModel:
    """log-likelihoods per domain: rows of known words, then of letter trigrams, then one of zeros."""

    domains: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    rows: np.ndarray

    def posteriors(self, chunks: list[str]) -> np.ndarray:
        """One row per chunk: of the word if known, else of its trigrams, else equal shares."""
        hits, starts, nothing = [], [], len(self.rows) - 1
        words, grams = self.words, self.grams
        for chunk in chunks:
            starts.append(len(hits))
            word = chunk.strip(STRIP)
            if word in words:
                hits.append(words[word])
            else:
                hits += [grams[g] for g in trigrams(word) if g in grams] if word else ()
                if len(hits) == starts[-1]:
                    hits.append(nothing)
        z = np.add.reduceat(self.rows[hits], starts, axis=0)
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def members(self):
        """text -> (tokens, posterior); no words: 0 tokens, equal shares."""
        known: dict[str, int] = {}
        table = np.zeros((1024, len(self.domains)))

        def of(text: str | None):
            nonlocal table
            words = (text or "").lower().split()
            if not words or not self.domains:
                return len(words), np.full(len(self.domains), 1 / max(1, len(self.domains)))
            if len(known) > CACHE_WORDS:
                known.clear()
            new = [w for w in dict.fromkeys(words) if w not in known]
            if new:
                while len(known) + len(new) > len(table):
                    table = np.vstack([table, np.zeros_like(table)])
                table[len(known) : len(known) + len(new)] = self.posteriors(new)
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            p = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
            return len(words), np.round(p / p.sum(), 6)

        return of


def fit_domains(texts: list[str], domains: list[str], most_words: int = 50_000) -> DomainModel:
    """Word and trigram frequencies by domain, add-one-half smoothed; keeps words seen at least 3 times."""
    names = sorted(set(domains))
    seen = {d: Counter() for d in names}
    for text, d in zip(texts, domains, strict=True):
        seen[d].update(w for w in (c.strip(STRIP) for c in text.lower().split()) if w)
    grams = {d: Counter() for d in names}
    for d in names:
        for w, n in seen[d].items():
            for g in trigrams(w):
                grams[d][g] += n

    def rows(counts, least, most):
        total = {d: sum(counts[d].values()) + 1.0 for d in names}
        keys = Counter()
        for d in names:
            keys.update(counts[d])
        kept = [x for x, n in sorted(keys.items(), key=lambda i: (-i[1], i[0])) if n >= least][:most]
        return {x: [np.log((counts[d][x] + 0.5) / total[d]) for d in names] for x in kept}

    words, parts = rows(seen, 3, most_words), rows(grams, 1, most_words)
    table = np.array([*words.values(), *parts.values(), [0.0] * len(names)]).reshape(len(words) + len(parts) + 1, len(names))
    return DomainModel(names, {w: i for i, w in enumerate(words)}, {g: len(words) + i for i, g in enumerate(parts)}, table)


def train_domains(docs: DataFrame, ids: DataFrame | None = None, rows_per_domain: int = 300, longest: int = 100_000) -> DomainModel:
    """Fit on (doc_id, text, domain) of the ids in ``ids`` (default: all): the first ``rows_per_domain`` by a hash of the id, texts up to ``longest``.

    Both are documented bounds of the classifier's sample only.  Null domains,
    ids and texts teach nothing; of several texts of an id and domain the least does.  One scan picks the ids, a second fetches their
    texts by a broadcast of at most ``rows_per_domain`` ids per domain, so no
    text is shuffled before that; salted windows keep a domain's rows apart
    until few are left.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "domain").where(F.col("text").isNotNull() & F.col("domain").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= longest))
    rows = docs.select("doc_id", "domain")
    if ids is not None:
        rows = rows.join(ids.select("doc_id"), "doc_id", "left_semi")
    rows = rows.withColumn("h", F.xxhash64("doc_id"))
    for keys in (*(["domain", F.pmod(F.col("h"), F.lit(n))] for n in SALTS), ["domain"]):
        rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))).where(F.col("rn") <= rows_per_domain).drop("rn")
    picked = [(r["doc_id"], r["domain"]) for r in rows.select("doc_id", "domain").distinct().collect()]
    if not picked:
        return fit_domains([], [])
    bounded = spark.createDataFrame(picked, docs.select(F.col("doc_id").alias("__id"), F.col("domain").alias("__domain")).schema)
    same = (F.col("doc_id") == F.col("__id")) & (F.col("domain") == F.col("__domain"))
    found = docs.join(F.broadcast(bounded), same, "left_semi").groupBy("doc_id", "domain").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["domain"], r["doc_id"]))
    return fit_domains([r["text"] for r in found], [r["domain"] for r in found])


def with_membership(docs: DataFrame, model: DomainModel) -> DataFrame:
    """docs with tokens (words) and membership (posterior by domain, in the model's order)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("tokens", "membership")])
    at = docs.columns.index("text")

    def run(batches):
        of = model.members()
        for batch in text_slices(batches, at):
            found = [of(t) for t in batch.column(at).to_pylist()]
            new = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "tokens", "membership"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, tokens long, membership array<double>")


@dataclass
class RateFit:
    """errors: one vector per step; a document's rate is their fold over its membership."""

    errors: list[list[float]]
    step: float
    ridge: float
    low: float
    high: float
    totals: list[float]
    targets: list[float]

    def distance(self) -> list[float]:
        """By domain, tokens over (or below 0: under) the target as a part of it; of all targets where it is 0."""
        whole = sum(self.targets)
        return [(n - t) / (t or whole) if whole else 0.0 for n, t in zip(self.totals, self.targets, strict=True)]

    def rate(self, membership="membership"):
        p, r = F.col(membership), F.lit(1.0)
        if not self.errors:
            return r
        past = F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in self.errors])

        def fold(rate, e):
            g = sum((p[k] * e[k] for k in range(len(self.targets))), F.lit(0.0))
            return F.greatest(F.lit(self.low), F.least(F.lit(self.high), rate - self.step * (g + self.ridge * (rate - 1.0))))

        return F.aggregate(past, r, fold)

    def rates(self, p: np.ndarray) -> np.ndarray:
        """The same for rows of memberships."""
        r = np.ones(len(p))
        for e in self.errors:
            g = p @ np.array(e)
            r = np.clip(r - self.step * (g + self.ridge * (r - 1)), self.low, self.high)
        return r


def domain_sums(members: DataFrame, k: int, fit: RateFit | None = None) -> list[float]:
    """Tokens per domain of (tokens, membership), each row times its rate: one sum per batch, then added up."""

    def run(batches):
        for batch in batches:
            tokens = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(tokens), k)
            held = (tokens * fit.rates(p) if fit else tokens) @ p
            yield pa.RecordBatch.from_arrays([pa.array([held.tolist()], pa.list_(pa.float64()))], names=["held"])

    rows = members.where("tokens > 0").select("tokens", "membership").mapInArrow(run, "held array<double>")
    return [float(x or 0) for x in rows.agg(*[F.sum(F.col("held")[i]) for i in range(k)]).first()] if k else []


def domain_moments(members: DataFrame, k: int, fit: RateFit) -> tuple[np.ndarray, np.ndarray]:
    """Sums as of :func:`domain_sums`, and tokens times the products of two memberships over rows whose rate is between its bounds."""

    def run(batches):
        for batch in batches:
            tokens = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(tokens), k)
            r = fit.rates(p)
            free = p[(r > fit.low) & (r < fit.high)]
            held = np.concatenate([(tokens * r) @ p, ((free * tokens[(r > fit.low) & (r < fit.high), None]).T @ free).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([held.tolist()], pa.list_(pa.float64()))], names=["held"])

    rows = members.where("tokens > 0").select("tokens", "membership").mapInArrow(run, "held array<double>")
    found = np.array([float(x or 0) for x in rows.agg(*[F.sum(F.col("held")[i]) for i in range(k + k * k)]).first()])
    return found[:k], found[k:].reshape(k, k)


def compact(members: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(tokens, mean membership) of documents with about the same membership (to 1 / GRID), or None if these are more than MOST_CELLS."""
    p = [F.col("membership")[i] for i in range(k)]
    cells = members.where("tokens > 0").groupBy(*[F.round(x * GRID).alias(f"g{i}") for i, x in enumerate(p)]).agg(F.sum("tokens").cast("double").alias("t"), *[F.sum(F.col("tokens") * x).alias(f"s{i}") for i, x in enumerate(p)])
    found = cells.select("t", *[f"s{i}" for i in range(k)]).limit(MOST_CELLS + 1).toArrow()
    if found.num_rows > MOST_CELLS:
        return None
    t, *sums = (found.column(i).to_numpy() for i in range(k + 1))
    return t, np.stack(sums, 1) / t[:, None] if len(t) else np.zeros((0, k))


def settle(members: DataFrame, fit: RateFit, share: np.ndarray, total: float, within: float) -> None:
    """Finish a fit: at its optimum a rate is 1 - membership . c within its bounds, with c the errors over the ridge.

    So only K unknowns are sought, by damped Newton steps; the fit then holds
    one error vector, whose fold is that rate.  The steps, and rounds with less
    ridge while that brings a domain nearer to its target, go over cells of
    documents with about the same membership; the totals, and up to POLISH
    further steps, over all documents.  Without cells (too many) all steps do.
    """
    k, target, alive = len(share), np.array(fit.targets), share > 1e-9
    cells = compact(members, k)

    def at(c, ridge, exact):
        trial = RateFit([[float(x) for x in c * (1 + ridge)]], 1 / (1 + ridge), ridge, fit.low, fit.high, fit.totals, fit.targets)
        if exact or cells is None:
            now, moments = domain_moments(members, k, trial)
        else:
            t, p = cells
            r = trial.rates(p)
            free = p * ((r > fit.low) & (r < fit.high))[:, None]
            now, moments = (t * r) @ p, (free * t[:, None]).T @ free
        trial.totals = now.tolist()
        miss = np.where(alive, ridge * share * c - (now - target) / total, 0)
        return trial, moments / total, miss

    def steps(c, ridge, exact, most):
        best, moments, miss = at(c, ridge, exact)
        for _ in range(most):
            if np.abs(miss[alive] / share[alive]).max() < within / 100:
                break
            slope = np.where(np.outer(alive, alive), moments, 0) + np.diag(np.where(alive, ridge * share, 1.0))
            move, part = np.linalg.solve(slope, -miss), 1.0
            while part >= (0.25 if exact else 1e-6):
                found = at(c + part * move, ridge, exact)
                if np.linalg.norm(found[2]) < np.linalg.norm(miss) * (1 - part / 1000):
                    break
                part /= 2
            else:
                break
            c = c + part * move
            best, moments, miss = found
        return c, best

    ridge = fit.ridge
    c, best = steps(np.zeros(k), ridge, False, 200)
    while (off := np.abs(best.distance())).max() > TOLERANCE and ridge > 1e-9:
        ridge /= 10
        c, best = steps(c, ridge, False, 200)
        if (np.abs(best.distance()) > 0.9 * off)[off > TOLERANCE].all():
            break
    if cells is not None:
        c, best = steps(c, ridge, True, POLISH)
    fit.errors, fit.totals, fit.ridge, fit.step = best.errors, best.totals, best.ridge, best.step


def fit_rates(members: DataFrame, weights: list[float] | None, low: float = 0.0, high: float = float("inf"), temper: float | None = None, budget: float = 1.0, ridge: float = 1e-3, steps: int = 40, within: float = 1e-4) -> RateFit:
    """Rates in [low, high] for (tokens, membership) so that domain tokens meet their targets.

    Targets are ``weights`` of ``budget`` times all tokens; with ``temper``
    instead, shares to that power, with the budget raised until no domain has to
    lose tokens.  Minimises sum_k ((tokens_k - target_k) / total)^2 / share_k plus
    a small ridge towards rate 1.  Domains without tokens are left out.
    Rates have no upper bound unless one is given.  ``steps`` are those of the
    gradient only: if they end unfinished, or off a target by more than
    TOLERANCE, :func:`settle` finishes the fit.
    """
    k = len(weights) if weights is not None else len((members.select("membership").first() or [[]])[0] or [])
    now = domain_sums(members, k)
    total = sum(now)
    if not total:
        return RateFit([], 0.0, ridge, low, high, now, now)
    share = np.array(now) / total
    if temper is not None:
        w = share**temper / (share**temper).sum()
        budget = float(np.max(share / np.where(w > 0, w, 1)))
    else:
        w = np.array(weights, float) / sum(weights)
    target = w * total * budget
    fit = RateFit([], 1 / (1 + ridge), ridge, low, high, now, target.tolist())
    for _ in range(steps):
        e = np.where(share > 1e-9, (np.array(now) - target) / total / np.maximum(share, 1e-9), 0)
        done = np.abs(e).max() < within or fit.errors and np.abs(e - fit.errors[-1]).max() < within / 100
        if done:
            break
        fit.errors.append([round(float(x), 12) for x in e])
        now = domain_sums(members, k, fit)
    else:
        done = False
    fit.totals = now
    if not done or np.abs(fit.distance()).max() > TOLERANCE:
        settle(members, fit, share, total, within)
    return fit


def copies(rate, id_col: str = "doc_id", seed: int = 9):
    """Whole copies of a row: the rate rounded up or down by a hash of the id, right on average."""
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, model: DomainModel, weights: dict[str, float] | None = None, keep: list[str] | None = None, **options) -> tuple[DataFrame, RateFit]:
    """docs (or only the columns ``keep``) with tokens, membership, rate and copies.

    Every row gets a rate; a null or empty text has no tokens and the rate of
    equal shares.  A null id rounds like any other.  Null lang or source play
    no part.  An empty table stays empty.  A warning names the domains that end
    off their target by more than TOLERANCE; the fit has every distance.
    """
    columns = keep if keep is not None else [c for c in docs.columns if c not in ("tokens", "membership", "rate", "copies")]
    members, _ = materialize(with_membership(docs, model).select(*[F.col(f"`{c}`") for c in columns], "tokens", "membership"), "members")
    fit = fit_rates(members, None if weights is None else [weights.get(d, 0.0) for d in model.domains], **options)
    off = {d: round(x, 4) for d, x in zip(model.domains, fit.distance(), strict=False) if abs(x) > TOLERANCE}
    if off:
        warnings.warn(f"tokens off their targets, as parts of these: {off}", stacklevel=2)
    out = members.withColumn("rate", fit.rate())
    return out.withColumn("copies", copies(F.col("rate")) if "doc_id" in columns else F.lit(None).cast("int")), fit
