import random

import pytest

from graphloom.llm import toxicity as T
from graphloom.llm.queries import op8_toxicity

SF = "/root/testdata/sf0.01"


def made(n=600, seed=4):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [[r.choice(words) for _ in range(r.randint(3, 12))] for _ in range(r.randint(1, 15))]
        bad = i % 5 == 0
        if bad:
            r.choice(text).insert(1, r.choice(["zork", "blarg", "zorkish"]))
        docs.append(". ".join(" ".join(s) for s in text) + ".")
        labels.append(int(bad))
    return docs, labels


def test_held_out_accuracy_and_sentences():
    docs, labels = made()
    model = T.fit(docs[:400], labels[:400])
    of = model.scorer()
    right = 0
    for text, y in zip(docs[400:], labels[400:], strict=True):
        score, spans, p = of(text)
        right += (score >= 0.7) == y
        if y and score >= 0.7:
            a, b = spans[int(p.argmax())]
            assert "zork" in text[a:b] or "blarg" in text[a:b]
    assert right / 200 >= 0.97


def test_one_label_or_none():
    assert T.fit(["a", "b"], [0, 0]).scorer()("a")[0] < 0.5
    assert T.fit(["a"], [1]).scorer()("")[0] > 0.5
    assert T.fit([], []).scorer()(None)[0] < 0.5


def test_operator_edges(spark):
    rows = [(1, None, "x"), (2, "", None), (None, "idiot. fine.", "y"), (2, "w " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = T.ToxicModel({"idiot": 12.0}, -6.0)
    got = T.score(df, model).collect()
    assert len(got) == 4 and [r["predicted"] for r in got] == [0, 0, 1, 0]
    assert [tuple(s)[:2] for s in got[2]["offending"]] == [(0, 5)]
    assert T.score(df.limit(0), model).collect() == []
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert T.train(df, labels).weights == {}


def test_query_on_held_out_rows(spark):
    import zlib

    got = {r["doc_id"]: r for r in op8_toxicity(spark, SF).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    pairs = [(r["predicted"], labels[d]) for d, r in got.items() if r["held_out"] and d in labels]
    assert sum(p == y for p, y in pairs) / len(pairs) > 0.94
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("text", ["", "...", "a. B! c?\nd", "İstanbul. x"])
def test_spans_are_offsets_of_the_text(text):
    _, spans, p = T.ToxicModel().scorer()(text)
    assert len(spans) == len(p) and all(0 <= a <= b <= len(text) for a, b in spans)
