import random

import numpy as np
import pytest

from graphloom.llm import neardup as N
from graphloom.llm.common import WordHashes, shingles, words_of
from graphloom.llm.components import connected_components


def brute(docs, width, percent):
    """doc_id -> (set size, smallest id reachable) from all pairs."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(docs)}


def corpus(seed=1, groups=12, copies=14):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    docs, n = [], 0
    for g in range(groups):
        base = [word() for _ in range(r.choice([3, 8, 40, 90, 200]))]
        for _ in range(r.randint(1, copies)):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                text[r.randrange(len(text))] = word()
            docs.append((n := n + 1, " ".join(text)))
    docs += [(n + 1, None), (n + 2, ""), (n + 3, " \t\n"), (n + 4, "one two"), (n + 5, "ONE  two"), (n + 6, "x " * 30000)]
    return docs


@pytest.mark.parametrize("width", [4, 5])
def test_matches_all_pairs(spark, width):
    docs = corpus()
    got = {r["doc_id"]: r for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=width).collect()}
    want = brute(docs, width, 80)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_second_round_links_what_stars_miss(spark, monkeypatch):
    """A chain in which neighbours link but few link with the smallest; small blocks force crossing groups."""
    monkeypatch.setattr(N, "BLOCK", 4)
    r = random.Random(5)
    words = [f"w{r.random()}" for _ in range(420)]
    docs = [(i, " ".join(words[6 * i : 6 * i + 120])) for i in range(50)]
    want = brute(docs, 4, 80)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4).collect()}
    assert got == want


def test_buckets_of_three_lose_no_link(spark):
    """Families of texts around the threshold: two that are alike often share their buckets with one unlike text only."""
    r, docs = random.Random(5), []
    for g in range(900):
        base = [f"g{g}w{i}" for i in range(120)]
        for v in range(r.choice([3, 4, 5])):
            docs.append((len(docs), g, " ".join(base[r.randint(0, 18) :] + [f"g{g}v{v}x{i}" for i in range(r.randint(4, 24))])))
    want = {}
    for g in range(900):
        want |= brute([(d, t) for d, h, t in docs if h == g], 4, 80)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in N.near_duplicates(spark.createDataFrame([(d, t) for d, _, t in docs], "doc_id long, text string"), width=4).collect()}
    assert got == want


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", None), (2, None, None), (2, "p q r s t u v", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = N.near_duplicates(df).collect()
    assert len(got) == 5
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    kept = N.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "None"]
    assert N.near_duplicates(df.limit(0)).collect() == []


def test_signature_is_unbiased_and_less_variable():
    rng = np.random.default_rng(0)
    same = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = a.copy()
        b[:33] = rng.integers(0, 2**63, 33)
        same.append((N.superminhash(np.unique(a)) == N.superminhash(np.unique(b))).mean())
    assert abs(np.mean(same) - 267 / 333) < 0.02
    assert np.std(same) < (0.8 * 0.2 / N.SLOTS) ** 0.5 * 1.1


def test_shingles():
    h = WordHashes()
    assert len(shingles(words_of("A b C"), 4, h)) == 1
    assert set(shingles(words_of("A b C"), 4, h)) == set(shingles(words_of("a  B\tc"), 4, h))
    assert len(shingles(words_of(" "), 4, h)) == 1 and len(shingles([], 4, h)) == 0


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    found, _ = connected_components(spark.createDataFrame(links, "a long, b long"))
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert {r["node"]: r["comp"] for r in found.collect()} == {x: root(x) for x in list(parent)}
