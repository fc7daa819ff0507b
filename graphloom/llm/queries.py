"""The registered queries of the training-data operators: thin views of their results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, mixing, neardup, packing, pii, sharding, toxicity, transport, urls
from .common import table

#: Production parameters.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = [urls.Rule("allow", "org"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]
#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20
MIX_WEIGHTS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), "page_id", "url", URL_RULES)


def op2_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = transport.store(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    back = transport.read(media)
    tail = F.expr("substring(payload, greatest(length(payload) - 63, 1), 64)")
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("units").alias("n_units"),
        "faults",
    )


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(vectors), vectors.where("vec_id % 100 = 0"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    done = chat.format_rows(rows.unionByName(planted))
    back = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return sharding.shard(docs, "doc_id", size, SHARD_BYTES).select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), "shard", "depth")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def train_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> mixing.DomainModel:
    """The labelled table of domains: the language of documents that labels covers."""
    return mixing.train_domains(docs.select("doc_id", "text", F.col("lang").alias("domain")), table(spark, sf_dir, "labels").select("doc_id").distinct())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_<domain>: the posterior; off_<domain>: how far the fitted tokens of all documents are from the domain's target, as a part of it."""
    docs = table(spark, sf_dir, "documents")
    model = train_languages(spark, docs, sf_dir)
    mixed, fit = mixing.mix(docs.select("doc_id", "text"), model, MIX_WEIGHTS, keep=["doc_id"])
    at = {d: i for i, d in enumerate(model.domains)}
    off = dict(zip(model.domains, fit.distance(), strict=False))
    shares = [(F.col("membership")[at[d]] if d in at else F.lit(0.0)).alias(f"p_{d}") for d in MIX_WEIGHTS]
    distances = [F.lit(round(float(off.get(d, -1.0)), 6)).alias(f"off_{d}") for d in MIX_WEIGHTS]
    return mixed.select("doc_id", "tokens", *shares, F.round("rate", 6).alias("rate"), "copies", *distances)


def _joined(*columns: str):
    spans = F.concat(*columns)
    order = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in pii.ALL_KINDS]), s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("pii_base"), 256).alias("base_sha256"), _joined("pii_base", "pii_added").alias("spans"), *[F.size(F.filter("pii_added", lambda s: s["kind"] == k)).cast("long").alias(f"n_added_{k}") for k in pii.ALL_KINDS], (F.size("pii_base") + F.size("pii_added")).cast("long").alias("n_spans"))


def queries() -> dict:
    import sys

    here = sys.modules[__name__]
    names = [n for n in dir(here) if n.startswith("op") and n[2].isdigit()]
    return {n: getattr(here, n) for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))}


_SAID = "\\### Assistant: </turn> ok"
_IN_ORDER = "ORDER BY turn NULLS FIRST, role, text"


def _escaped(text: str, marks: str) -> str:
    """SQL for the length of an escaped text: every mark takes one character more."""
    return f"length({text})" + "".join(f" + length({text}) - length(replace({text}, {m}, ''))" for m in marks.split("|"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLES = {
    "op4_chat_formatting": f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {_IN_ORDER}) AS said, coalesce(string_agg(text, '' {_IN_ORDER}) FILTER (role = 'assistant'), '') AS loss,
sum({len(chat.OPEN) + len(chat.COLON) + len(chat.CLOSE)} + {_escaped("role", "chr(92)|'<'|'#'|':'|chr(10)")} + {_escaped("text", "chr(92)|'<'|'#'")}) AS chars FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g""",
    "op6_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS sh FROM w),
one AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.root)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id, s.doc_id = c AS kept FROM s JOIN (SELECT doc_id, min(root) AS c FROM reach GROUP BY doc_id) USING (doc_id)""",
    "op7_sharding": f"""WITH s AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, CAST('0x' || left(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 12) AS BIGINT) AS b FROM documents),
o AS (SELECT d, b >> (48 - d) AS prefix FROM s, (SELECT CAST(range AS INTEGER) AS d FROM range(48)) GROUP BY ALL HAVING sum(n_bytes) > {SHARD_BYTES}),
t AS (SELECT doc_id, max(d) + 1 AS depth FROM s JOIN o ON prefix = b >> (48 - d) GROUP BY doc_id)
SELECT s.doc_id, n_bytes, left(lpad(bin(b), 48, '0'), coalesce(depth, 0)) AS shard, CAST(coalesce(depth, 0) AS INTEGER) AS depth FROM s LEFT JOIN t USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
