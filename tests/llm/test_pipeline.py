"""Stages of the corpus pipeline against plain in-memory versions, and the whole run."""

import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline as cp
from graphloom.llm import toxicity
from graphloom.llm.queries import TOKENIZER, train_languages

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def pieces_of(rows):
    return Counter((p["doc_id"], p["start"], tuple(p["ids"])) for p in rows)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        docs = out[name] = stage(spark, docs, SF).cache()
    return out


def test_toxicity_keeps_what_a_plain_score_keeps(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{LARGER}/labels.parquet"))

    def score(text):
        clean = 1.0
        for a, b in toxicity.sentences(text):
            z = model.bias + sum(model.weights.get(f, 0.0) for w in set(text[a:b].lower().split()) for f in toxicity.features(w))
            clean *= 1 - min(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), 1 - 1e-12)
        return 1 - clean

    scores = {r["doc_id"]: score(r["text"] or "") for r in docs.collect()}
    sure = {d for d, s in scores.items() if abs(s - 0.7) > 1e-6}
    left = Counter(r["doc_id"] for r in cp.drop_toxic(spark, docs, LARGER).collect())
    assert {d: n for d, n in left.items() if d in sure} == {d: 1 for d in sure if scores[d] < 0.7} and 0 < len(left) < len(scores)


def test_mixing_makes_the_plain_copies(spark, stages):
    clean = stages["personal_data"].collect()
    model = train_languages(spark, stages["personal_data"], SF)
    words = [(r["text"] or "").lower().split() for r in clean]
    k = len(model.domains)
    p = np.array([model.posteriors(w).mean(0) if w else np.full(k, 1 / k) for w in words])
    w = np.array([len(x) for x in words], float)
    w /= w.sum()
    share = w @ p
    goal = share**cp.TEMPER / (share**cp.TEMPER).sum()
    goal, rate = goal * (share / goal).max(), np.ones(len(p))
    for _ in range(20_000):
        e = ((w * rate) @ p - goal) / share
        rate = np.clip(rate - (p @ e + 1e-3 * (rate - 1)) / 1.001, 1.0, cp.MOST)
    got = Counter(r["doc_id"] for r in stages["mixing"].collect())
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert set(got) == set(texts) and all(r["text"] == texts[r["doc_id"]] for r in stages["mixing"].collect())
    sure = 0
    for row, x in zip(clean, rate, strict=True):
        h = xxhash.xxh64_intdigest(struct.pack("<i", 9), seed=xxhash.xxh64_intdigest(struct.pack("<q", row["doc_id"]), seed=42))
        u = h % (1 << 20) / (1 << 20)
        if min(abs(u - (x - math.floor(x))), abs(x - round(x)) if x > 1 else 1) > 0.01:
            sure += 1
            assert got[row["doc_id"]] == math.floor(x) + (u < x - math.floor(x))
    assert sure > 0.8 * len(clean)


def test_packing_has_every_token_of_every_row(stages):
    model, windows = Tokenizer.from_file(TOKENIZER), {}
    want, whole = Counter(), Counter()
    for r in stages["mixing"].collect():
        want[r["doc_id"], tuple(model.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)] += 1
    parts = {}
    for (d, start, ids), n in pieces_of(stages["packing"].collect()).items():
        parts.setdefault(d, []).append((start, ids, n))
    for d, found in parts.items():
        assert len({n for _, _, n in found}) == 1
        whole[d, sum((ids for _, ids, _ in sorted(found)), ())] = found[0][2]
    assert whole == want
    for p in stages["packing"].collect():
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for found in windows.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_is_all_stages(spark, stages):
    got = cp.run(spark, SF).collect()
    assert pieces_of(got) == pieces_of(stages["packing"].collect()) and got
    assert not any(re.search(r"[a-z]@[a-z-]+\.[a-z]", r["text"] or "") for r in stages["mixing"].collect())


def test_edge_rows_of_every_stage(spark):
    """Null ids, texts and languages, empty texts, repeated rows, an extra column whose name clashes, and no rows at all."""
    good = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first = good[min(good)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, tokens string"
    odd = [(None, "one two three four five six", None, None, None, "s", None), (9001, None, "en", "x", None, "s", "t"), (9002, "", None, "x", 0, None, "t"), (9003, "a b c", "xx", None, 5, "s", "t"), (9003, "a b c", "xx", None, 5, "s", "t")]
    rows = odd + [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "s", "t") for r in good.values()]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in cp.STAGES:
        left = stage(spark, docs, SF)
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and none.columns == left.columns, name
        if name == "packing":
            assert sum(p["doc_id"] == 9001 and p["doc_tokens"] == 1 for p in left.collect()) == 1
            continue
        got = [tuple(r) for r in left.collect()]
        assert left.columns == docs.columns and {r[0] for r in got} >= {None, 9001, 9002, 9003, first["doc_id"]}, name
        assert [r for r in got if r[0] == 9001][0] == odd[1] and [r for r in got if r[0] is None][0] == odd[0][:4] + (27 if name == "personal_data" else None,) + odd[0][5:], name
        assert sum(r[0] == 9003 for r in got) >= (1 if name == "near_duplicates" else 2), name
