"""Cleaning a corpus in five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each as Parquet in the shared folder and rereads it for the next.  All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import mixing, neardup, packing, pii, toxicity
from graphloom.llm.common import table
from graphloom.llm.queries import TOKENIZER, train_languages
from graphloom.storage import mark, materialize, release, release_since

#: Languages get their share of tokens to this power, by repeating documents up to MOST times.
TEMPER, MOST = 0.7, 4.0


def _apart(docs: DataFrame, new: tuple[str, ...]):
    """docs without the names that an operator adds, and what gives its result the columns of docs back (with those replaced that are named)."""
    away = {c: f"__own_{c}" for c in docs.columns if c in new}

    def back(result: DataFrame, **replaced) -> DataFrame:
        return result.select(*[replaced.get(c, F.col(f"`{away.get(c, c)}`")).alias(c) for c in docs.columns])

    return docs.withColumnsRenamed(away), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.7 or more go.

    Null and empty texts score as one empty sentence and stay; repeated rows get
    equal scores; an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    bare, back = _apart(docs, ("score", "predicted", "offending"))
    return back(toxicity.score(bare, model).where("predicted = 0"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, Jaccard 0.8).

    That of the smallest id; texts without words and rows without id stay, rows
    of one id count as copies of each other.
    """
    return neardup.keep_first(docs, width=5, percent=80)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows; a null text stays null with n_chars null."""
    bare, back = _apart(docs, ("pii_base", "pii_added", "pii_redacted"))
    return back(pii.find(bare), text=F.col("pii_redacted"), n_chars=F.length("pii_redacted").cast(docs.schema["n_chars"].dataType))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates of 1 to MOST, so no clean document goes; a document with copies n has n rows.

    A text without words has the rate of equal shares; without labelled
    documents there is one domain less, without any all rates are 1.
    """
    model = train_languages(spark, docs, sf_dir)
    bare, back = _apart(docs, ("tokens", "membership", "rate", "copies"))
    mixed, _ = mixing.mix(bare, model, temper=TEMPER, low=1.0, high=MOST)
    return back(mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens; a null text is its end mark only."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("personal_data", redact_private), ("mixing", mix_languages), ("packing", pack_windows)]

#: Classifiers, sketches and windows are not SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        point = mark()
        docs, path = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release_since(spark, point, path)  # what the stage wrote besides
        if before:
            release(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
