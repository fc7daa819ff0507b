"""The compiled expressions against a plain interpreter, on fixed and random trees."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import gate

PARAMS = {"x": 3, "s": "abc", "t": True, "l": [1, 2, "a"], "z": 0, "n": None, "f": 2.5}
STATE = {"a": {"b": 5, "c": "q"}, "m": "WALK", "e": [], "d": {"k": 1}}


def interpret(tree):
    op = tree[0]
    if op == "lit":
        return tree[1]
    if op == "list":
        return [interpret(x) for x in tree[1]]
    if op == "ref":
        at, path = (STATE, tree[1][7:].split(".")) if tree[1].startswith("@state") else (PARAMS, [tree[1][7:]])
        for p in path:
            at = at.get(p) if isinstance(at, dict) else None
        return at
    if op == "call":
        return abs(interpret(tree[2][0]))
    if op == "not":
        return not interpret(tree[1])
    if op == "neg":
        return -interpret(tree[1])
    if op == "and":
        return interpret(tree[1]) and interpret(tree[2])
    if op == "or":
        return interpret(tree[1]) or interpret(tree[2])
    a, b = interpret(tree[1]), interpret(tree[2])
    if "contains" in op:
        a, b, op = b, a, op.replace("contains", "in")
    return {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "in": lambda: a in b, "not in": lambda: a not in b}[op]()


def lists_ordered(tree):
    """The language has no order on lists: comparing two is an error here."""
    if isinstance(tree, tuple) and tree[0] in ("<", "<=", ">", ">="):
        return all(isinstance(interpret(x), list) for x in tree[1:])
    return isinstance(tree, tuple | list) and any(lists_ordered(x) for x in tree)


def verdict(text):
    try:
        return "PASS" if interpret(gate.parse(text)) else "FAIL"
    except Exception:
        return "EVAL_ERROR"


def evaluated(spark, texts):
    one = spark.createDataFrame([(json.dumps(PARAMS), json.dumps(STATE))], "params string, state string").select(F.parse_json("params").alias("params"), F.parse_json("state").alias("state"))
    row = one.select(*[gate.evaluate(t).alias(f"c{i}") for i, t in enumerate(texts)]).first()
    return list(row)


FIXED = [
    "params.x == 3", "params.x != 3", "params.x > 2.5 and params.x <= 3", "params.s in ['abc', 'd']", "params.s not in ['abc']", "'b' in params.s", "params.l contains 'a'", "params.l not contains 2",
    "not params.n", "params.n == null", "params.n < 3", "params.n in [1]", "1 in params.n", "params.t == 1", "params.s == 3", "params.s < 3", "@state.a.b - 0 > 1", "@state.a.b == 5 or params.gone > 1", "params.gone > 1 or @state.a.b == 5",
    "@state.e or @state.d", "@state.e", "'k' in @state.d", "abs(-2) == 2", "abs(params.s) > 1", "(params.x == 3 or params.x == 4) and not (params.z)", "params.l == [1, 2, 'a']", "1 < params.x < 5", "params.t and 'and' == 'and'", "-params.f < 0", "@ontology.nope(1)", "@state.a.c == \"q\"",
]


def test_fixed(spark):
    want = ["EVAL_ERROR" if "@ontology" in t else verdict(t) for t in FIXED]
    assert dict(zip(FIXED, evaluated(spark, FIXED), strict=True)) == dict(zip(FIXED, want, strict=True))


def unordered(text):
    try:
        return lists_ordered(gate.parse(text))
    except Exception:
        return False


def test_random_trees(spark):
    r = random.Random(11)

    def value(depth):
        if depth and r.random() < 0.15:
            return f"abs({value(depth - 1)})"
        return r.choice(["params.x", "params.s", "params.t", "params.z", "params.n", "params.f", "params.gone", "@state.a.b", "@state.m", "@state.a.c", "1", "2.5", "'abc'", "'q'", "true", "null", "[1, 'abc']", "params.l"])

    def tree(depth):
        k = r.random()
        if depth and k < 0.25:
            return f"({tree(depth - 1)}) {r.choice(['and', 'or'])} ({tree(depth - 1)})"
        if depth and k < 0.35:
            return f"not ({tree(depth - 1)})"
        return f"{value(1)} {r.choice(['==', '!=', '<', '<=', '>', '>=', 'in', 'not in', 'contains'])} {value(1)}" if k < 0.9 else value(1)

    texts = [t for t in (tree(2) for _ in range(70)) if not unordered(t)][:60]
    got = [v for i in range(0, 60, 20) for v in evaluated(spark, texts[i : i + 20])]
    assert dict(zip(texts, got, strict=True)) == {t: verdict(t) for t in texts}


def test_unreadable():
    for bad in ("params.", "1 +", "(1", "params.x = 3", "abs(1", ""):
        with pytest.raises(gate.GateError):
            gate.compile_tree(gate.parse(bad), gate.Ontology())


def test_predicates(spark):
    o = gate.Ontology(types={"Mode": {"m.walk"}, "Joint": {"j"}}, modes={"WALK": "m.walk"}, links={"allows": {("m.walk", "act")}}, motions={(3.0, 1.0)}, limits={"j": (-1.0, 1.0)}, ids={"m.walk", "j", "act"})
    texts = ["@ontology.has_object('Mode', 'WALK')", "@ontology.has_object('Joint', 'WALK')", "@ontology.has_link_from('allows', @state.m, 'act')", "@ontology.has_preset_motion(params.x, 1)", "@ontology.joint_within_limit('j', 1)", "@ontology.joint_within_limit('j', 1.1)", "@ontology.joint_within_limit('k', 0)"]
    one = spark.createDataFrame([(json.dumps(PARAMS), json.dumps(STATE))], "params string, state string").select(F.parse_json("params").alias("params"), F.parse_json("state").alias("state"))
    assert list(one.select(*[gate.evaluate(t, o).alias(f"c{i}") for i, t in enumerate(texts)]).first()) == ["PASS", "FAIL", "PASS", "PASS", "PASS", "FAIL", "FAIL"]
