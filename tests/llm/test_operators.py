"""Round trips, brute force and edge rows of the other operators."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, chat, mixing, packing, pii, sharding, transport, urls
from graphloom.llm.queries import MIX_WEIGHTS, SHARD_BYTES, TOKENIZER, URL_RULES, queries

SF = "/root/testdata/sf0.001"
Q = queries()


# 1 URLs ------------------------------------------------------------------------
def test_urls_match_brute_force(spark):
    rows = [(1, None, "h"), (2, "no scheme", "h"), (None, "http://A.Example.ORG/en/1?x", None), (4, "http://b.com#f", "x"), (5, "http://b.com/de/" + "x" * 50_000, "x"), (6, "https://x.example.org/es/9", ""), (6, "https://x.example.org/es/9", ""), (7, "a://b://c/d", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.judge(pages, "page_id", "url", URL_RULES).collect()
    assert len(got) == len(rows)

    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    want = sorted((str(i), *parts(u)) for i, u, _ in rows)
    assert sorted((str(r["page_id"]), r["host"], r["path"]) for r in got) == want
    for r in got:
        fits = [x for x in URL_RULES if (r["host"] == x.host or r["host"].endswith("." + x.host)) and r["path"].startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert r["rule"] == (best.text if best else None)
        assert r["verdict"] == best.verdict if best else r["verdict"] in ("allow", "block")
    assert urls.judge(pages.limit(0), "page_id", "url", URL_RULES).collect() == []


def test_templates_generalise_merge_and_reject(spark):
    rows = [(f"http://h.net/{s}/{i}", y) for s, y in (("good", 0), ("fine", 0), ("bad", 1)) for i in range(40)]
    pages = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)] + [(1000 + i, f"http://h.net/bad/z{i}", None) for i in range(5)], "page_id long, url string, y int")
    parsed = pages.select("page_id", "url", "y")
    labels = F.when(F.col("path").startswith("/bad/z"), None).when(F.col("path").startswith("/bad"), 1).otherwise(0)
    got = {r["page_id"]: r for r in urls.judge(parsed, "page_id", "url", [], labels).collect()}
    assert got[1000]["verdict"] == "block" and got[1000]["template"] == "/bad/*"
    assert got[0]["verdict"] == "allow" and len(got) == 125


def test_siblings_merge_at_every_level(spark):
    """Sparse bad branches below the first segment, and pages told apart after the sixth."""
    bad, good = [f"b{c}" for c in "pqrstuvw"], [f"g{c}" for c in "pqrs"]
    rows = [(f"http://h.net/top/{s}/x", int(s in bad)) for s in bad + good] + [(f"http://h.net/top/g{c}/{i}", 0) for c in "pqrs" for i in range(30)]
    deep = [(f"http://d.net/1/a/b/c/d/e/f/{'bad' if y else 'good'}/{i}", y) for y in (0, 1) for i in range(20)]
    pages = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows + deep)], "page_id long, url string, y int")
    label = F.when(F.col("path").rlike("/(b[a-z]/|bad/)"), 1).otherwise(0)
    got = {r["page_id"]: r for r in urls.judge(pages, "page_id", "url", [], label).collect()}
    assert [got[i]["verdict"] for i in range(len(rows + deep))] == ["block" if y else "allow" for _, y in rows + deep]
    assert len({got[i]["template"] for i in range(8)}) == 1 and got[len(rows)]["template"] == "/*/a/b/c/d/e/f/good/*"
    assert urls.judge(spark.createDataFrame([(1, "http://h.net/" + "a/" * 3000)], "page_id long, url string"), "page_id", "url", []).first()["template"].count("/") == 3001


def test_sibling_names():
    assert urls.sibling_names(["a", "b", "c"], [40, 40, 40], [0, 40, 0]) == ["{a|c}", "b", "{a|c}"]
    assert urls.sibling_names(["*", "a", "b"], [40, 40, 0], [0, 40, 0]) == ["*", "a", "*"]
    assert urls.sibling_names(["a", "b"], [1, 0], [1, 0]) == ["*", "*"]
    assert urls.sibling_names(list("abcdef"), [1] * 3 + [9] * 3, [1] * 3 + [0] * 3) == ["{a|b|c}"] * 3 + ["{d|e|f}"] * 3


# 2 Transport streams -----------------------------------------------------------
@pytest.mark.parametrize("size", [0, 1, 100, 161, 162, 163, 175, 176, 183, 184, 345, 346, 347, 5000, 32_767, 32_768, 32_769, 100_001])
def test_stream_round_trip(size):
    data = bytes(random.Random(size).randrange(256) for _ in range(size))
    s = transport.demux(transport.mux(data))
    assert s.payload == data and sum(s.faults.values()) == 0
    assert s.programs == [{"program": 1, "pmt_pid": 0x1000, "pid": 0x100, "stream_type": 6}]
    assert [u["pts"] for u in s.units] == [3600 * i for i in range(max(1, -(-size // 32_768)))]
    assert all(u["random_access"] for u in s.units)
    assert transport.seek(s.units, 3600 * len(s.units) + 5)["pts"] == 3600 * (len(s.units) - 1)


def test_stream_faults():
    rows = np.frombuffer(transport.mux(bytes(range(256)) * 40), np.uint8).reshape(-1, 188)
    assert transport.demux(np.delete(rows, 5, 0).tobytes()).faults["continuity"] == 1
    assert transport.demux(np.insert(rows, 5, rows[5], 0).tobytes()).faults["repeated"] == 1
    broken = rows.copy()
    broken[0, 8] ^= 1
    assert transport.demux(broken.tobytes()).faults["table"] == 1
    assert transport.demux(None).payload == b"" and transport.demux(b"x").faults["sync"] == 1


def test_transport_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in Q["op2_transport_streams"](spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        full = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["faults"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), 0)
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "y")], "doc_id long, text string, media string")
    assert [len(r["payload"]) for r in transport.read(transport.store(odd)).collect()] == [64, 64]


# 3 Nearest neighbours ----------------------------------------------------------
def test_ann_recall_and_edges(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 16)).astype("float32")
    x[5] = x[400] = x[401]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0]), (None, [1.0] * 16), (5400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for row in ann.search(ann.build_index(df), df.where("vec_id % 100 = 0")).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    assert sorted(got) == list(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        hits += len({v for _, v, _ in found} & set(want.tolist()))
        assert [f[0] for f in sorted(found)] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in found)
    assert hits / (10 * len(got)) >= 0.9
    assert [v for _, v, _ in sorted(got[400])][:2] == [5, 401]
    assert ann.search(ann.build_index(df.limit(0)), df).collect() == []


# 4 Chat ------------------------------------------------------------------------
LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("user", "a"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"value": "r", "from": "gpt"}]}, "conversations", [("user", "q"), ("assistant", "r")]),
    ({"chat": {"turns": [{"speaker": "bot", "utterance": "x"}]}}, "nested_chat", [("assistant", "x")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"output": "o", "input": None, "instruction": "i"}, "instruction_input", [("user", "i"), ("assistant", "o")]),
    ({"system": "s", "prompt": "p", "response": "r"}, "system_prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ({"other": 1}, None, []),
]


def test_layouts(spark):
    df = spark.createDataFrame([(i, json.dumps(x), "t") for i, (x, _, _) in enumerate(LAYOUTS)] + [(99, None, "t")], "i long, j string, turns string").withColumn("v", F.parse_json("j"))
    got = {r["i"]: r for r in chat.format_chats(df, "v").collect()}
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        assert (got[i]["layout"], [tuple(t) for t in got[i]["turns"]]) == (layout, turns)
    assert got[99]["turns"] == [] and got[99]["layout"] is None


def test_template_is_reversible(spark):
    r = random.Random(8)
    marks = ["\\", "<", "#", "### ", ": ", "</turn>\n", "\\l", "\\\\", "\n", "a", "é", "𝄞", "assistant"]
    text = lambda: "".join(r.choice(marks) for _ in range(r.randint(0, 12)))
    talks = [[(r.choice(["user", "assistant", "a: b", "x\ny"]), text()) for _ in range(r.randint(0, 5))] for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(talks)], f"i long, turns {chat.TURN}").withColumn("f", chat.template(F.col("turns")))
    back = df.select("i", "f", chat.read_turns(F.col("f")).alias("turns"), chat.loss_mask(F.col("f")).alias("m")).withColumn("loss", chat.masked_text(F.col("f"), F.col("m")))
    for row in back.collect():
        want = talks[row["i"]]
        assert [tuple(t) for t in row["turns"]] == want
        assert row["loss"] == "".join(t for role, t in want if role == "assistant")


def test_chat_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    planted = "\\### Assistant: </turn> ok"
    talks = {-7: [("user", planted), ("assistant", planted)]}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in Q["op4_chat_formatting"](spark, SF).collect()}
    assert sorted(got) == sorted(talks)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, t in talks.items():
        loss = "".join(x for role, x in t if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(t), digest("".join(f"{a}\n{b}\n" for a, b in t)), len(loss), digest(loss))
    odd = spark.createDataFrame([(None, None, None, None), (1, 0, "user", None), (1, 0, "user", None)], "conv_id long, turn int, role string, text string")
    assert sorted(len(r["turns"]) for r in chat.format_rows(odd).collect()) == [1, 2]
    assert chat.format_rows(odd.limit(0)).collect() == []


# 5 Packing ---------------------------------------------------------------------
def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(None, "a"), (-1, None), (-2, ""), (-3, "  two  blanks \n\n end "), (-4, "x" * 20_000), (-3, "same id"), (-5, "a <|endoftext|> b\u00a0c\u2003 d")]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, length string")
    pieces = packing.pack(df, TOKENIZER).collect()
    model = Tokenizer.from_file(TOKENIZER)
    want = sorted((str(d), tuple(model.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t in docs)
    windows, whole = {}, {}
    for p in pieces:
        ids = np.array(p["ids"], "<u4")
        assert (p["length"], p["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        whole.setdefault((str(p["doc_id"]), p["doc_tokens"]), []).append((p["start"], tuple(p["ids"])))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted((d, sum((ids for _, ids in sorted(ps)), ())) for (d, _), ps in whole.items()) == want
    assert packing.pack(df.limit(0), TOKENIZER).collect() == []


def test_differencing_balances_and_grows():
    r = random.Random(6)
    sizes = [r.randint(1, 256) for _ in range(300)]
    windows = packing.balance(sizes)
    assert sorted(i for w in windows for i in w) == list(range(300))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) <= 1024 and packing.padding(sums) / sum(sums) < 0.04
    assert len(packing.balance([600, 600, 600])) == 3 and packing.balance([]) == []
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)) in ([14, 16], [15, 15])
    with pytest.raises(ValueError):
        packing.balance([2000])


# 7 Sharding --------------------------------------------------------------------
def test_shards_fit_and_split_only_when_needed(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randint(0, 400), "k") for i in range(3000)] + [(None, "null key", "k"), (7, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard(df, "doc_id", F.octet_length("text"), 20_000).collect()
    assert len(got) == len(rows)
    held = {}
    for x in got:
        held[x["shard"]] = held.get(x["shard"], 0) + x["n_bytes"]
        bits = f"{int(hashlib.sha256(str(x['doc_id'] if x['doc_id'] is not None else '').encode()).hexdigest()[:12], 16):048b}"
        assert x["shard"] == bits[: x["depth"]]
    assert max(held.values()) <= 20_000
    for s in held:
        if s:
            assert sum(b for t, b in held.items() if t.startswith(s[:-1])) > 20_000
    same = spark.createDataFrame([(1, "x" * 100)] * 50, "doc_id long, text string")
    pages = {}
    for x in sharding.shard(same, "doc_id", F.octet_length("text"), 1000).collect():
        pages[x["shard"]] = pages.get(x["shard"], 0) + 1
    assert sum(pages.values()) == 50 and len(pages) == 5
    assert sharding.shard(df.limit(0), "doc_id", F.octet_length("text"), 10).collect() == []


# 9 Mixing ----------------------------------------------------------------------
def test_rates_match_brute_force(spark):
    r = np.random.default_rng(3)
    t = r.integers(1, 500, 400)
    p = np.round(r.dirichlet([0.3] * 3, 400), 6)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "tokens long, membership array<double>")
    fit = mixing.fit_rates(df, [0.5, 0.3, 0.2])
    rate, share, total = np.ones(400), (t[:, None] * p).sum(0) / t.sum(), t.sum()
    target = np.array([0.5, 0.3, 0.2]) * (t[:, None] * p).sum()
    for e in fit.errors:
        now = (rate * t) @ p
        assert np.allclose(e, (now - target) / (t[:, None] * p).sum() / share, atol=1e-6)
        rate = np.clip(rate - fit.step * (p @ e + fit.ridge * (rate - 1)), 0, 4)
    got = np.array([x[0] for x in df.withColumn("rate", fit.rate()).select("rate").collect()])
    assert np.allclose(np.sort(got), np.sort(rate), atol=1e-9)
    assert np.abs((rate * t) @ p / target - 1).max() < 0.01 and total


@pytest.mark.parametrize("rare", [0.02, 0.002])
def test_rare_domain_reaches_its_target(spark, rare):
    r = np.random.default_rng(4)
    home = r.choice(4, 4000, p=[0.15, 0.7 - rare, rare, 0.15])
    p = np.full((4000, 4), 0.03)
    p[np.arange(4000), home] = 0.91
    t = r.integers(50, 500, 4000)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "tokens long, membership array<double>")
    weights = np.array([0.2, 0.4, 0.2, 0.2])
    fit = mixing.fit_rates(df, weights.tolist())
    rows = df.withColumn("rate", fit.rate()).collect()
    held = sum(x["tokens"] * x["rate"] * np.array(x["membership"]) for x in rows)
    assert min(x["rate"] for x in rows) >= 0 and max(x["rate"] for x in rows) > 4
    assert np.abs(held / (weights * t.sum()) - 1).max() < 0.01 and np.abs(fit.distance()).max() < 0.01


def test_unreachable_target_is_reported(spark):
    model = mixing.fit_domains(["aa bb aa bb aa bb", "cc dd cc dd cc dd"], ["x", "y"])
    docs = spark.createDataFrame([(i, "aa bb") for i in range(20)], "doc_id long, text string")
    with pytest.warns(UserWarning, match="'y'"):
        _, fit = mixing.mix(docs, model, {"x": 0.1, "y": 0.9})
    assert fit.distance()[1] < -0.5


def test_mixing_query_and_edges(spark):
    got = Q["op9_mixing"](spark, "/root/testdata/sf0.01").collect()
    held = {d: sum(x["tokens"] * x["rate"] * x[f"p_{d}"] for x in got) for d in MIX_WEIGHTS}
    assert all(abs(held[d] / sum(held.values()) - w) < 0.01 for d, w in MIX_WEIGHTS.items())
    assert all(0 <= x["rate"] <= 4 and abs(x["copies"] - x["rate"]) < 1 for x in got)
    model = mixing.fit_domains(["aa bb", "cc dd"], ["x", "y"])
    odd = spark.createDataFrame([(None, None, "l"), (1, "", None), (1, "aa", None), (1, "aa", None)], "doc_id long, text string, rate string")
    out, _ = mixing.mix(odd, model, {"x": 0.5, "y": 0.5})
    assert [x["tokens"] for x in out.orderBy("tokens").collect()] == [0, 0, 1, 1]
    assert mixing.mix(odd.limit(0), model, {"x": 1.0})[0].collect() == []
    assert mixing.train_domains(spark.createDataFrame([], "doc_id long, text string, domain string")).domains == []


# 10 Personal data --------------------------------------------------------------
BRUTE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    out = []
    for kind, pattern in BRUTE.items():
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            odd = d[-1::-2] if d else ""
            luhn = (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(c)))) for c in d[-2::-2])) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("alphabet", ["a@.b-", "1.2@a", "12345 -+().", "a1@.%+ -", "4 -0"])
def test_base_spans_match_plain_patterns(alphabet):
    r = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
        assert pii.base_spans(text) == brute_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1 " * 100_000):
        pii.base_spans(text)


def test_field_decodes_held_out_sentences_and_best_paths():
    field = pii.fit(pii.labelled_table())
    finder = pii.Finder(field)
    test = pii.labelled_table(150, seed=123)
    paths = pii.viterbi([finder.emissions([t for t, _ in row]) for row in test], field.moves, field.starts)
    cells = [(pii.LABELS[q], y) for row, path in zip(test, paths, strict=True) for (_, y), q in zip(row, path, strict=True)]
    assert sum(a == b for a, b in cells) / len(cells) > 0.97
    r = np.random.default_rng(5)
    from itertools import product

    for n in (1, 2, 4):
        e = r.normal(size=(n, 5))
        best = max(product(range(5), repeat=n), key=lambda s: field.starts[s[0]] + sum(e[i, k] for i, k in enumerate(s)) + sum(field.moves[a, b] for a, b in zip(s, s[1:], strict=False)))
        assert tuple(pii.viterbi([e, r.normal(size=(3, 5))], field.moves, field.starts)[0]) == best


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("call (377) 555-0271 (378) 555-0272 now", "call [PHONE] [PHONE] now"),
        ("call 377-555-0271, 377-555-0272 now", "call [PHONE], [PHONE] now"),
        ("call 377-555-0271, 377-555-0272, 377-555-0273 or 377.555.0274 now", "call [PHONE], [PHONE], [PHONE] or [PHONE] now"),
        ("call +1 (377) 555-0271 (378) 555-0272 now", "call [PHONE] [PHONE] now"),
        ("call 377-555-0271 +1 377-555-0272 now", "call [PHONE] [PHONE] now"),
        ("pay 4111.1111.1111.1111 4012-8888-8888-1881 now", "pay [CARD] [CARD] now"),
        ("pay 4111-1111-1111-1111, 4012.8888.8888.1881 now", "pay [CARD], [CARD] now"),
        ("pay 4111 1111 1111 1111 4012 8888 8888 1881 now", "pay [CARD] [CARD] now"),
    ],
)
def test_adjacent_numbers_are_split(text, clean):
    finder = pii.Finder(pii.fit(pii.labelled_table()))
    base = pii.base_spans(text)
    added = finder.added([text], [base])[0]
    assert pii.redact(text, base + added) == clean
    assert not any(a < y and x < b for _, a, b in added for _, x, y in base)


def test_split_keeps_to_plausible_parts():
    cut = lambda kind, text, taken=(): [text[a:b] for a, b in pii._split(kind, text, list(taken))]
    assert cut("phone", "377 555 0271 378 555 0272") == ["377 555 0271", "378 555 0272"]
    assert cut("phone", "12 377-555-0271,377-555-0272. 1234567890123456") == ["12 377-555-0271", "377-555-0272"]
    assert cut("phone", "377-555-0271 +1 377-555-0272", [(13, 28)]) == ["377-555-0271"]
    assert cut("card", "4111 1111 1111 1111 1234 4012 8888 8888 1881") == ["4111 1111 1111 1111", "4012 8888 8888 1881"]
    assert sum(len(x.split()) for x in cut("phone", "1 " * 50_000)) == 50_000


def test_shape_sees_the_whole_token():
    assert pii.shape("x" * 79 + "1.2@y") == "a91.91@a" and pii.shape("+12-(3)") == "+92-(91)"
    long = "ab1-" * 40
    assert pii.shape(long + "@") == pii.shape(long[:-4] + "@") == "a91-" * 8 + "@"
    assert len(pii.shape("1." * 150_000)) < 80 and pii.shape("-1" * 40 + "@a") != pii.shape("-1" * 40)


def test_pii_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in Q["op10_personal_data"](spark, SF).collect():
        spans = brute_spans(texts[r["doc_id"]])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(said.split(",")) <= set(r["spans"].split(","))
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (2, "mail a@b.cd, (377) 555-0271", "c")], "doc_id long, text string, pii_base string")
    got = pii.find(odd).collect()
    assert [r["pii_redacted"] for r in got] == [None, "", "mail [EMAIL], [PHONE]"]
    assert pii.find(odd.limit(0)).collect() == [] and SHARD_BYTES


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    larger = "/root/testdata/sf0.01"  # the smallest tables label too few toxic documents to learn from
    all_docs = spark.read.parquet(f"{larger}/documents.parquet")
    left = cp.drop_toxic(spark, all_docs, larger)
    assert left.columns == columns and 0.8 * all_docs.count() < left.count() < 0.97 * all_docs.count()
    clean = cp.drop_toxic(spark, docs, SF).cache()
    kept = cp.drop_copies(spark, clean, SF).cache()
    assert kept.columns == columns
    from tests.llm.test_neardup import brute

    want = brute([(r["doc_id"], r["text"]) for r in clean.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if d == c)
    hidden = cp.redact_private(spark, kept, SF).cache()
    assert hidden.columns == columns and not any(brute_spans(r["text"]) for r in hidden.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in hidden.collect())
    mixed = cp.mix_languages(spark, hidden, SF)
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in hidden.collect()}
    assert sum(p["length"] for p in cp.pack_windows(spark, mixed, SF).collect()) > 0


# Bounds that batches, partitions and long values must not move -------------------
def test_nearest_does_not_depend_on_batches_or_partitions(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = []
    for rows, parts in ((10_000, 1), (64, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        v = table.repartition(parts, "vec_id")
        got.append(sorted(map(tuple, ann.search(ann.build_index(v, k=32, m=4), v.where("vec_id % 100 = 0"), group=50, probes=0.5).collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] and [r[:2] for r in got[0]] == [r[:2] for r in got[1]]


def test_nearest_query_has_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = {}
    for r in Q["op3_nearest"](spark, sf).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, near in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(near & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert sorted(found) == sorted(i for i in ids if i % 100 == 0) and hits / (10 * len(found)) >= 0.9


def test_nearest_keeps_double_vectors(spark):
    x = [[1.0 + 1e-9 * i, 2.0] for i in range(30)]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = ann.search(ann.build_index(df), df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 11)) and abs(got[0]["score"] - 1e-9) < 1e-13


def test_layout_bounds_groups():
    places = ann.layout({0: 5, 1: 90, 2: 250, 3: 20, 4: 7}, 100)
    assert places == {0: (0, 1), 1: (0, 1), 3: (1, 1), 4: (1, 1), 2: (2, 3)} and ann.layout({}) == {}


def test_pages_of_one_key_keep_the_limit(spark):
    r = random.Random(3)
    rows = [(1, "x" * r.choice([0, 10, 100, 300, 900, 1500])) for _ in range(300)] + [(2, "y" * 2770)] * 3 + [(None, "z" * 100)] * 50
    held = {}
    for x in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", F.octet_length("text"), 2000).collect():
        held.setdefault(x["shard"], []).append(x["n_bytes"])
    assert sum(map(len, held.values())) == len(rows)
    assert all(sum(v) <= 2000 or v == [2770] for v in held.values())
    assert sum(len(v) == 20 for v in held.values() if v[0] == 100) >= 2 and len(held) < 2.5 * sum(map(sum, held.values())) / 2000


def test_lost_first_table_costs_itself_only():
    rows = np.frombuffer(transport.mux(b"abc" * 5000), np.uint8).reshape(-1, 188)
    broken = rows[0].copy()
    broken[8] ^= 1
    s = transport.demux(np.vstack([broken[None], rows[:1], rows[1:2], rows[1:]]).tobytes())
    assert s.payload == b"abc" * 5000 and s.faults["table"] == 1 and len(s.programs) == 1


def test_secrets_are_found_and_digests_left():
    finder = pii.Finder(pii.fit_secrets())
    secret, digest = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    text = f'der token = "{secret}" und\ncommit {digest} of 2024-01-02\nTOKEN = "{secret.upper()}"!! x\napi_key={secret} see https://a.bc/{digest}'
    assert [text[a:b] for _, a, b in finder.secrets([text], [[]])[0]] == [secret, secret.upper(), secret]
    assert finder.secrets([text], [[("card", 0, len(text))]]) == [[]]
    test = pii.secret_table(150, seed=77)
    paths = pii.viterbi([finder.emissions([t for t, _ in row]) for row in test], finder.field.moves, finder.field.starts)
    cells = [(pii.SECRET_LABELS[q], y) for row, path in zip(test, paths, strict=True) for (_, y), q in zip(row, path, strict=True)]
    assert sum(a == b for a, b in cells) / len(cells) > 0.98


def test_long_lines_are_decoded_alone():
    finder = pii.Finder(pii.fit(pii.labelled_table(60), epochs=30))
    long = "ab 12 " * 60_000 + "call (377) 555-0271 now"
    whole = finder.added([long, "call (377) 555-0271 now"] + ["x 1"] * 200, [[]] * 202)
    assert [long[a:b] for _, a, b in whole[0][-1:]] == ["(377) 555-0271"] and len(whole[1]) == 1


def test_encoders_are_held_against_each_other():
    tokens = packing.Tokens(TOKENIZER)
    tokens.verify()

    class Other:
        encode_ordinary = staticmethod(lambda t: [1])

    tokens.ranks = Other()
    with pytest.raises(ValueError):
        tokens.verify()


def test_templates_back_off_to_other_hosts(spark):
    rows = [(f"http://h{i}.com/{'bad' if i % 2 else 'good'}/{i}", i % 2) for i in range(20)]
    free = ["http://new.net/bad/77", "http://new.net/good/78", "http://sub.h1.com/bad/79"]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] + [(100 + i, u) for i, u in enumerate(free)], "page_id long, url string")
    label = F.when(F.col("host").rlike(r"^h[0-9]+\.com"), F.col("path").startswith("/bad").cast("int"))
    got = {r["page_id"]: r for r in urls.judge(pages, "page_id", "url", [], label).collect()}
    assert [got[100 + i]["verdict"] for i in range(3)] == ["block", "allow", "block"]


def test_template_verdicts_match_a_plain_tree(spark):
    """Counts, back-off and smoothing of templates that neither widen nor merge, in plain Python."""
    r = random.Random(12)
    seen = [(f"{h}.{d}.org", f"/{s}") for h in "ab" for d in ("x", "y") for s in ("p", "q", "r") for _ in range(r.randint(1, 9))]
    labels = [r.choice([0, 1, None]) for _ in seen]
    pages = spark.createDataFrame([(i, f"http://{h}{p}?{'bad' if y else 'ok' if y == 0 else ''}", y) for i, ((h, p), y) in enumerate(zip(seen, labels, strict=True))], "page_id long, url string, y int")
    by_page = F.create_map(*[F.lit(x) for i, y in enumerate(labels) for x in (i, y if y is not None else -1)])
    label = F.when(by_page[F.col("page_id").cast("int")] >= 0, by_page[F.col("page_id").cast("int")])
    got = urls.judge(pages, "page_id", "url", [], label, similar=-1.0).collect()

    def counts(match):
        ys = [y for (h, p), y in zip(seen, labels, strict=True) if match(h, p) and y is not None]
        return len(ys), sum(ys)

    n, bad = counts(lambda h, p: True)
    base = bad / n
    for row in got:
        if row["template"] != row["path"]:
            continue  # merged with a sibling for lack of evidence
        rate = base
        for match in (lambda h, p: True, lambda h, p: h.split(".", 1)[1] == row["host"].split(".", 1)[1], lambda h, p: h == row["host"]):
            n, bad = counts(lambda h, p, m=match: m(h, p) and p == row["path"])
            rate = (bad + urls.PSEUDO * rate) / (n + urls.PSEUDO)
        assert abs(row["purity"] - rate) < 1e-9 and row["verdict"] == ("block" if rate >= urls.PURE else "allow")


@pytest.mark.parametrize("name", ["toxicity", "pii", "transport", "mixing", "neardup", "packing"])
def test_very_long_texts(spark, name):
    text = "one two three 4 five. " * 250_000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    run = {
        "toxicity": lambda: __import__("graphloom.llm.toxicity", fromlist=["x"]).score(df, __import__("graphloom.llm.toxicity", fromlist=["x"]).ToxicModel({}, -4.0)).select("score"),
        "pii": lambda: pii.find(df).select(F.size("pii_added")),
        "transport": lambda: transport.read(transport.store(df).drop("text")).select("n_bytes"),
        "mixing": lambda: mixing.with_membership(df, mixing.fit_domains(["one two", "five three"], ["a", "b"])).select("tokens"),
        "neardup": lambda: __import__("graphloom.llm.neardup", fromlist=["x"]).near_duplicates(df).select("n_shingles"),
        "packing": lambda: packing.pack(df, TOKENIZER, with_ids=False).where("start = 0 or doc_id = 2").select("length"),
    }[name]
    assert run().count() == 2
