"""Documents are walked to their last level."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import ingest


def entries(doc, path="$"):
    pairs = [(f"{path}.{k}", k, v) for k, v in doc.items()] if isinstance(doc, dict) else [(f"{path}[{i}]", None, v) for i, v in enumerate(doc)] if isinstance(doc, list) else []
    for p, k, v in pairs:
        yield p, k
        yield from entries(v, p)


def nested(levels):
    doc = {"/deep/topic": {"x": 1}, "last": levels}
    for i in range(levels - 2):
        doc = {f"k{i}": doc} if i % 3 else [doc, i]
    return doc


@pytest.mark.parametrize("levels", [2, 8, 9, 20])
def test_walk_has_no_last_level(spark, levels):
    texts = [json.dumps(nested(levels)), json.dumps({"a": [1, {}]}), "3"]
    docs = spark.createDataFrame([("f", t) for t in texts], "file string, t string").select("file", F.parse_json("t").alias("doc"))
    want = sorted(str(e) for t in texts for e in entries(json.loads(t)))
    assert sorted(str((r["path"], r["key"])) for r in ingest.walk(docs).select("path", "key").collect()) == want
    assert [r["topic"] for r in ingest.messages(docs).collect()] == ["/deep/topic"]
    assert {r["topic"]: r["n"] for r in ingest.topic_counts(docs).collect()} == {"/deep/topic": 1}
