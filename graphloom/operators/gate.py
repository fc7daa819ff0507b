"""Precondition gate: an expression language compiled to Columns.

Expressions are data: a tokenizer and a precedence parser make a tree, and the
tree becomes Columns over a table of candidate calls, batch or stream.  Every
node carries its value and whether evaluating it fails, so missing values,
mixed types and short-circuiting keep the language's meaning instead of SQL's
three-valued logic.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, prop, small
from . import graph

TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<ref>@state(?:\.[A-Za-z_]\w*)+|params\.[A-Za-z_]\w*)|(?P<fn>@ontology\.\w+|@fn\.\w+)
    |(?P<op>==|!=|<=|>=|<|>|\(|\)|\[|\]|,|-)|(?P<word>[A-Za-z_]\w*))""",
    re.X,
)


class GateError(ValueError):
    """The expression cannot be read."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise GateError(f"cannot read {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


# Trees: ("lit", value) ("ref", path) ("list", [..]) ("call", name, [..]) ("not", x) ("neg", x) (op, a, b)
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=", "in", "not in", "contains", "not contains")


def parse(text: str):
    """Expression text -> tree.  Precedence: or, and, not, comparison (chains are conjunctions), unary minus."""
    rest = tokens(text)[::-1]
    peek = lambda: rest[-1] if rest else ("end", "")

    def take(value: str):
        if peek()[1] != value:
            raise GateError(f"expected {value!r} in {text!r}")
        rest.pop()

    def disjunction():
        left = conjunction()
        while peek() == ("word", "or"):
            rest.pop()
            left = ("or", left, conjunction())
        return left

    def conjunction():
        left = negation()
        while peek() == ("word", "and"):
            rest.pop()
            left = ("and", left, negation())
        return left

    def negation():
        if peek() == ("word", "not"):
            rest.pop()
            return ("not", negation())
        return comparison()

    def operator() -> str | None:
        kind, value = peek()
        if kind == "op" and value in COMPARISONS or (kind, value) in (("word", "in"), ("word", "contains")):
            rest.pop()
            return value
        if (kind, value) == ("word", "not") and len(rest) > 1 and rest[-2] in (("word", "in"), ("word", "contains")):
            rest.pop()
            return "not " + rest.pop()[1]
        return None

    def comparison():
        left = unary()
        parts = []
        while op := operator():
            right = unary()
            parts.append((op, left, right))
            left = right
        return reduce(lambda a, b: ("and", a, b), parts) if parts else left

    def unary():
        if peek() == ("op", "-"):
            rest.pop()
            return ("neg", unary())
        return atom()

    def listed(end: str) -> list:
        items = []
        while peek()[1] != end:
            items.append(disjunction())
            if peek()[1] != end:
                take(",")
        take(end)
        return items

    def atom():
        kind, value = rest.pop() if rest else ("end", "")
        if kind == "num":
            return ("lit", float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "ref":
            return ("ref", value)
        if (kind, value) == ("op", "("):
            inner = disjunction()
            take(")")
            return inner
        if (kind, value) == ("op", "["):
            return ("list", listed("]"))
        if kind == "fn" or (kind, value) == ("word", "abs"):
            take("(")
            return ("call", value, listed(")"))
        if kind == "word" and value.lower() in ("true", "false", "null", "none"):
            return ("lit", {"true": True, "false": False}.get(value.lower()))
        raise GateError(f"unexpected {value!r} in {text!r}")

    tree = disjunction()
    if rest:
        raise GateError(f"unexpected {peek()[1]!r} in {text!r}")
    return tree


@dataclass
class Node:
    """A value as columns: its kind (null, bool, num, str, list, dict), number, text and items; and err.

    ``value``: of a node that is always a boolean, that boolean, never null.
    ``const``: of a literal number or text, the literal; both save expressions.
    """

    kind: Column
    num: Column
    text: Column
    err: Column
    items: list | None = None
    raw: Column | None = None
    value: Column | None = None
    const: float | str | None = None

    @property
    def truth(self) -> Column:
        if self.value is not None:
            return self.value
        number = self.num != 0
        size = F.lit(bool(self.items)) if self.items is not None else F.coalesce(F.size(self.elements()) > 0, F.lit(True)) if self.raw is not None else F.lit(True)
        return F.coalesce(F.when(self.kind.isin("bool", "num"), number).when(self.kind == "str", self.text != "").when(self.kind == "list", size).when(self.kind == "dict", self.text != "{}"), F.lit(False))

    def elements(self) -> Column:
        return F.try_variant_get(self.raw, "$", "array<variant>")

    @property
    def numeric(self) -> Column:
        return self.kind.isin("bool", "num")




def _lit(value) -> Node:
    no = F.lit(False)
    null_num, null_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if value is None:
        return Node(F.lit("null"), null_num, null_text, no)
    if isinstance(value, bool):
        return Node(F.lit("bool"), F.lit(float(value)), null_text, no)
    if isinstance(value, int | float):
        return Node(F.lit("num"), F.lit(float(value)), null_text, no, const=float(value))
    return Node(F.lit("str"), null_num, F.lit(value), no, const=value)


def _bool(value: Column, err: Column) -> Node:
    known = F.coalesce(value, F.lit(False))
    return Node(F.lit("bool"), known.cast("double"), F.lit(None).cast("string"), err, value=known)


def _kind(v: Column, schema: Column) -> Column:
    return F.when(v.isNull() | F.is_variant_null(v), "null").when(schema == "BOOLEAN", "bool").when(schema == "STRING", "str").when(schema.startswith("ARRAY"), "list").when(schema.startswith("OBJECT"), "dict").otherwise("num")


def _num(v: Column, kind: Column) -> Column:
    return F.when(kind.isin("bool", "num"), F.try_variant_get(v, "$", "double"))


def _text(v: Column, kind: Column) -> Column:
    return F.when(kind == "str", F.try_variant_get(v, "$", "string")).when(kind == "dict", F.to_json(v))


def of_variant(v: Column) -> Node:
    """A VARIANT value as a node; SQL null and JSON null are null."""
    kind = _kind(v, F.schema_of_variant(v))
    return Node(kind, _num(v, kind), _text(v, kind), F.lit(False), raw=v)


def reference_of(path: str, params: str = "params", state: str = "state") -> Column:
    """The VARIANT that @state.a.b or params.x names."""
    column, _, rest = path.partition(".")
    return F.try_variant_get(F.col(state if column == "@state" else params), f"$.{rest}", "variant")


class Bound(dict):
    """References whose value, kind, number and text are columns of a table; others are expressions."""

    def node(self, path: str, params: str, state: str) -> Node:
        if path not in self:
            return of_variant(reference_of(path, params, state))
        at = self[path]
        return Node(F.col(f"__kind{at}"), F.col(f"__num{at}"), F.col(f"__text{at}"), F.lit(False), raw=F.col(f"__value{at}"))


def references(tree) -> set[str]:
    """The references of an expression's tree."""
    if isinstance(tree, tuple) and len(tree) == 2 and tree[0] == "ref":
        return {tree[1]}
    return set().union(*map(references, tree)) if isinstance(tree, tuple | list) else set()


def bind(calls: DataFrame, specs: list[dict] = (), preconditions: list = (), params: str = "params", state: str = "state") -> tuple[DataFrame, Bound]:
    """calls with each reference of the rules read once per row, for the rule functions' ``bound``.

    The columns are made in steps.  As each is named several times by the next
    step, the optimiser keeps the steps apart instead of repeating their
    expressions in every rule.
    """
    paths = {f"params.{s['name']}" for s in specs or []}
    for pre in preconditions or []:
        try:
            paths |= references(parse(pre if isinstance(pre, str) else pre["expr"]))
        except GateError:
            continue
    bound = Bound({p: i for i, p in enumerate(sorted(paths))})
    value = lambda i: F.col(f"__value{i}")
    kind = lambda i: F.col(f"__kind{i}")
    out = calls.withColumns({f"__value{i}": reference_of(p, params, state) for p, i in bound.items()})
    out = out.withColumns({f"__schema{i}": F.schema_of_variant(value(i)) for i in bound.values()})
    out = out.withColumns({f"__kind{i}": _kind(value(i), F.col(f"__schema{i}")) for i in bound.values()})
    out = out.withColumns({f"__num{i}": _num(value(i), kind(i)) for i in bound.values()} | {f"__text{i}": _text(value(i), kind(i)) for i in bound.values()})
    return out.drop(*[f"__schema{i}" for i in bound.values()]), bound


def unbind(df: DataFrame, bound: Bound) -> DataFrame:
    return df.drop(*[f"__{name}{i}" for i in bound.values() for name in ("value", "kind", "num", "text")])


def _equal(a: Node, b: Node) -> Column:
    if a.const is not None and b.const is None:
        a, b = b, a
    if b.const is not None and a.items is None:
        same = (a.kind == "str") & (a.text == b.const) if isinstance(b.const, str) else a.numeric & (a.num == b.const)
        return F.coalesce(same, F.lit(False))
    nan = F.isnan(F.coalesce(a.num, F.lit(0.0))) | F.isnan(F.coalesce(b.num, F.lit(0.0)))
    if a.items is not None and b.items is not None:
        same = F.lit(len(a.items) == len(b.items))
        return reduce(lambda c, xy: c & _equal(*xy), zip(a.items, b.items, strict=False), same)
    both = F.when((a.kind == "null") & (b.kind == "null"), True).when(a.numeric & b.numeric, (a.num == b.num) & ~nan).when((a.kind == "str") & (b.kind == "str"), a.text == b.text)
    if a.raw is not None and b.raw is not None:
        both = both.when((a.kind == b.kind) & a.kind.isin("list", "dict"), F.to_json(a.raw) == F.to_json(b.raw))
    if (a.items is None) != (b.items is None):
        listed, other = (a, b) if a.items is not None else (b, a)
        if other.raw is not None:
            pairs = [_equal(of_variant(F.get(other.elements(), F.lit(i))), x) for i, x in enumerate(listed.items)]
            both = both.when(other.kind == "list", reduce(lambda c, d: c & d, pairs, F.size(other.elements()) == len(listed.items)))
    return F.coalesce(both, F.lit(False))


def _ordered(op: str, a: Node, b: Node) -> tuple[Column, Column]:
    nan = F.isnan(F.coalesce(a.num, F.lit(0.0))) | F.isnan(F.coalesce(b.num, F.lit(0.0)))
    compare = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    numbers, texts = a.numeric & b.numeric, (a.kind == "str") & (b.kind == "str")
    return F.when(numbers, compare(a.num, b.num) & ~nan).when(texts, compare(a.text, b.text)), ~(numbers | texts)


def _member(x: Node, within: Node) -> tuple[Column, Column]:
    """x in within: items of a list, keys of an object, part of a text; else an error."""
    if within.items is not None:
        fixed = [i.const for i in within.items]
        if fixed and x.items is None and None not in fixed:
            numbers, texts = [i for i in fixed if not isinstance(i, str)], [i for i in fixed if isinstance(i, str)]
            return F.coalesce(x.numeric & _in(x.num, numbers) | (x.kind == "str") & _in(x.text, texts), F.lit(False)), F.lit(False)
        return reduce(lambda c, y: c | _equal(x, y), within.items, F.lit(False)), F.lit(False)
    inside = F.when((within.kind == "str") & (x.kind == "str"), F.contains(within.text, x.text))
    ok = (within.kind == "str") & (x.kind == "str")
    if within.raw is not None:
        inside = inside.when(within.kind == "list", F.exists(within.elements(), lambda e: _equal(x, of_variant(e))))
        inside = inside.when(within.kind == "dict", (x.kind == "str") & F.array_contains(F.map_keys(F.try_variant_get(within.raw, "$", "map<string,variant>")), F.coalesce(x.text, F.lit(""))))
        ok = ok | within.kind.isin("list", "dict")
    return inside, ~ok


@dataclass
class Ontology:
    """What predicates may ask of a pack, gathered once on the driver: packs are small."""

    types: dict[str, set[str]] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    links: dict[str, set[tuple[str, str]]] = field(default_factory=dict)
    motions: set[tuple[float, float]] = field(default_factory=set)
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)
    ids: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, c: Catalog, robot_id: str, most: int = 100_000) -> Ontology:
        here = F.col("robot_id") == robot_id
        if c.objects.where(here).limit(most + 1).count() > most or c.links.where(here).limit(most + 1).count() > most:
            raise ValueError(f"a pack of more than {most} objects or links is no pack for expressions")
        out = cls()
        for r in c.objects.where(here).select("id", "type").collect():
            out.types.setdefault(r["type"], set()).add(r["id"])
            out.ids.add(r["id"])
        out.ids |= {r["id"] for r in c.actions.where(here).select("id").collect()}
        out.modes = {r["mode_value"]: r["mode_id"] for r in graph.modes_by_value(c).where(here).collect()}
        for r in c.links.where(here).select("type", "source", "target").collect():
            out.links.setdefault(r["type"], set()).add((r["source"], r["target"]))
        out.motions = {(r[0], r[1]) for r in graph.objects_of_type(c, "PresetMotion").where(here).select(prop("motion_value", "double"), prop("area_value", "double")).collect()}
        out.limits = {r[0]: (r[1], r[2]) for r in graph.objects_of_type(c, "Joint").where(here).select("id", prop("position_limit.min", "double"), prop("position_limit.max", "double")).collect() if r[1] is not None and r[2] is not None}
        return out

    def resolved(self, ref: Column) -> Column:
        """A known id, else the mode of that value, else the input."""
        if not self.modes:
            return ref
        pairs = F.create_map(*[F.lit(x) for kv in self.modes.items() for x in kv])
        return F.when(ref.isin(*self.ids), ref).otherwise(F.coalesce(pairs[ref], ref)) if self.ids else F.coalesce(pairs[ref], ref)


def _in(value: Column, values) -> Column:
    values = list(values)
    return F.coalesce(value.isin(*values), F.lit(False)) if values else F.lit(False)


def has_object(o: Ontology, type_: Node, ref: Node) -> Column:
    """[J21]"""
    out = F.lit(False)
    for name, ids in o.types.items():
        out = F.when(type_.text == name, _in(ref.text, ids) | _in(o.resolved(ref.text), ids)).otherwise(out)
    return out


def has_link_from(o: Ontology, type_: Node, source: Node, target: Node) -> Column:
    """[J19]"""
    out = F.lit(False)
    ends = F.concat_ws("\x01", o.resolved(source.text), o.resolved(target.text))
    for name, pairs in o.links.items():
        out = F.when(type_.text == name, _in(ends, [f"{a}\x01{b}" for a, b in pairs])).otherwise(out)
    return out


def has_preset_motion(o: Ontology, motion: Node, area: Node) -> Column:
    """[J20]"""
    return reduce(lambda c, m: c | ((motion.num == m[0]) & (area.num == m[1])), [m for m in o.motions if None not in m], F.lit(False))


def joint_within_limit(o: Ontology, joint: Node, position: Node) -> Column:
    """[J22] Inclusive; an unknown joint or limit: false."""
    out = F.lit(False)
    for name, (lo, hi) in o.limits.items():
        out = F.when(joint.text == name, position.num.between(lo, hi) & ~F.isnan(position.num)).otherwise(out)
    return out


#: [X2] Predicates by name: (ontology, *argument nodes) -> boolean Column.
PREDICATES = {f.__name__: f for f in (has_object, has_link_from, has_preset_motion, joint_within_limit)}
#: [G11, X3] Functions that expressions may call as @fn.name(...): (*argument nodes) -> boolean Column.
FUNCTIONS: dict = {}


def register(name: str, function: Callable[..., Column]) -> None:
    """[G11, X3] Let expressions call ``function`` as @fn.name(...); it gets a Node per argument and gives a boolean Column, from built-ins or a pandas UDF."""
    FUNCTIONS[name] = function


def compile_tree(tree, o: Ontology, params: str = "params", state: str = "state", bound: Bound | None = None) -> Node:
    bound = Bound() if bound is None else bound

    def go(t) -> Node:
        op = t[0]
        if op == "lit":
            return _lit(t[1])
        if op == "list":
            items = [go(x) for x in t[1]]
            return Node(F.lit("list"), F.lit(None).cast("double"), F.lit(None).cast("string"), reduce(lambda c, n: c | n.err, items, F.lit(False)), items=items)
        if op == "ref":
            return bound.node(t[1], params, state)
        if op == "call":
            args = [go(x) for x in t[2]]
            err = reduce(lambda c, n: c | n.err, args, F.lit(False))
            if t[1] == "abs":
                if len(args) != 1:
                    raise GateError("abs takes one value")
                return Node(F.lit("num"), F.abs(args[0].num), F.lit(None).cast("string"), err | ~args[0].numeric)
            name = t[1].split(".", 1)[1]
            known = PREDICATES if t[1].startswith("@ontology") else FUNCTIONS
            if name not in known:
                raise GateError(f"{t[1]} is not known")
            return _bool(known[name](o, *args) if known is PREDICATES else known[name](*args), err)
        if op == "not":
            x = go(t[1])
            return _bool(~x.truth, x.err)
        if op == "neg":
            x = go(t[1])
            return Node(F.lit("num"), -x.num, F.lit(None).cast("string"), x.err | ~x.numeric)
        a, b = go(t[1]), go(t[2])
        if op in ("and", "or"):
            if a.value is not None and b.value is not None:
                return _bool(a.value & b.value if op == "and" else a.value | b.value, a.err | ((a.value if op == "and" else ~a.value) & b.err))
            use_b = a.truth if op == "and" else ~a.truth
            pick = lambda x, y: F.when(use_b, y).otherwise(x)
            return Node(pick(a.kind, b.kind), pick(a.num, b.num), pick(a.text, b.text), a.err | (use_b & b.err))
        err = a.err | b.err
        if op in ("==", "!="):
            same = _equal(a, b)
            return _bool(same if op == "==" else ~same, err)
        if op in ("<", "<=", ">", ">="):
            value, bad = _ordered(op, a, b)
            return _bool(value, err | bad)
        x, within = (a, b) if op.endswith("in") and "contains" not in op else (b, a)
        value, bad = _member(x, within)
        value = F.coalesce(value, F.lit(False))
        return _bool(~value if op.startswith("not") else value, err | bad)

    return go(tree)


def evaluate(text: str, o: Ontology | None = None, params: str = "params", state: str = "state", bound: Bound | None = None) -> Column:
    """[G6-G10] PASS, FAIL or EVAL_ERROR of an expression; one that cannot be read is EVAL_ERROR."""
    try:
        node = compile_tree(parse(text), o or Ontology(), params, state, bound)
    except GateError:
        return F.lit("EVAL_ERROR")
    return F.when(node.err, "EVAL_ERROR").when(node.truth, "PASS").otherwise("FAIL")


FAILURE = "struct<expr:string,error:string,severity:string>"


def _failure(expr, error, severity="error") -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(expr).alias("expr"), as_column(error).alias("error"), as_column(severity).alias("severity"))


def parameter_failures(specs: list[dict], params: str = "params", bound: Bound | None = None) -> list[Column]:
    """[G2-G5] One nullable failure per rule of the declared parameters."""
    out, bound = [], Bound() if bound is None else bound
    for spec in specs or []:
        name = spec["name"]
        v = bound.node(f"params.{name}", params, "state")
        given = v.kind != "null"
        shown = F.coalesce(F.try_variant_get(v.raw, "$", "string"), F.lit("null"))
        if spec.get("required"):
            out.append(F.when(~given, _failure(f"params.{name}", f"required parameter '{name}' missing")))
        if spec.get("type") == "enum":
            inside, _ = _member(v, Node(F.lit("list"), v.num, v.text, F.lit(False), items=[_lit(x) for x in spec.get("values") or []]))
            out.append(F.when(given & ~inside, _failure(f"params.{name}", F.concat(F.lit(f"'{name}'="), shown, F.lit(" not in enum")))))
        for rule in spec.get("constraints") or []:
            if rule.get("type") == "range":
                number = F.coalesce(v.num, F.trim(v.text).try_cast("double"))
                ok = given & number.isNotNull()
                out.append(F.when(given & number.isNull(), _failure(f"range({name})", F.concat(F.lit(f"'{name}'="), shown, F.lit(" is not numeric")))))
                lo, hi = rule.get("min"), rule.get("max")
                if lo is not None:
                    out.append(F.when(ok & (number < lo), _failure(f"{name} >= {lo}", F.concat(F.lit(f"'{name}'="), number.cast("string"), F.lit(f" below min {lo}")))))
                if hi is not None:
                    out.append(F.when(ok & (number > hi) & ~F.isnan(number), _failure(f"{name} <= {hi}", F.concat(F.lit(f"'{name}'="), number.cast("string"), F.lit(f" exceeds max {hi}")))))
            elif rule.get("type") == "not_in":
                inside, _ = _member(v, Node(F.lit("list"), v.num, v.text, F.lit(False), items=[_lit(x) for x in rule.get("values") or []]))
                out.append(F.when(given & inside, _failure(f"{name} not in {rule.get('values')}", F.concat(F.lit(f"'{name}'="), shown, F.lit(" is reserved")))))
    return out


def precondition_failures(preconditions: list, o: Ontology, params: str = "params", state: str = "state", bound: Bound | None = None) -> list[Column]:
    """[G6-G10] One nullable failure per precondition; one that cannot be evaluated is an error whatever its severity."""
    out = []
    for pre in preconditions or []:
        pre = {"expr": pre} if isinstance(pre, str) else pre
        verdict = evaluate(pre["expr"], o, params, state, bound)
        failed = _failure(pre["expr"], pre.get("error") or f"precondition failed: {pre['expr']}", pre.get("severity") or "error")
        out.append(F.when(verdict == "EVAL_ERROR", _failure(pre["expr"], "could not be evaluated")).when(verdict == "FAIL", failed))
    return out


def sorted_failures(preconditions: list, o: Ontology, bound: Bound, params: str = "params", state: str = "state") -> tuple[list[Column], list[Column]]:
    """The hits of :func:`precondition_failures`, those that block apart from those that warn.

    What a rule's failure counts as is known before any row is read; only an
    evaluation error, which always blocks, depends on the row.
    """
    hard, soft = [], []
    for pre in preconditions or []:
        pre = {"expr": pre} if isinstance(pre, str) else pre
        severity, broken = pre.get("severity") or "error", _failure(pre["expr"], "could not be evaluated")
        failed = _failure(pre["expr"], pre.get("error") or f"precondition failed: {pre['expr']}", severity)
        try:
            node = compile_tree(parse(pre["expr"]), o, params, state, bound)
        except GateError:
            hard.append(broken)
            continue
        if severity in ("error", "fatal"):
            hard.append(F.when(node.err, broken).when(~node.truth, failed))
        else:
            hard.append(F.when(node.err, broken))
            soft.append(F.when(~node.err & ~node.truth, failed))
    return hard, soft


def check(calls: DataFrame, c: Catalog) -> DataFrame:
    """[G1, G12] calls (robot_id, action_id, params, state) with ok, failures, warnings, summary.

    Actions with the same rules share one compiled rule set, whatever their
    number; only rules that ask the ontology are compiled per robot.  Calls meet
    the number of their rule set in a join; the batch or stream is read once and
    every reference once per row.  An unknown action is not ok.
    """
    rows = c.actions.select("robot_id", "id", F.to_json("parameters").alias("p"), F.to_json("preconditions").alias("e")).collect()
    sets: dict[tuple, int] = {}
    number = [(r["robot_id"], r["id"], sets.setdefault((r["p"], r["e"], r["robot_id"] if "@ontology" in (r["e"] or "") else None), len(sets))) for r in rows]
    loaded = {key: (json.loads(key[0] or "null") or [], json.loads(key[1] or "null") or []) for key in sets}
    calls_, bound = bind(calls, [s for p, _ in loaded.values() for s in p], [x for _, e in loaded.values() for x in e])
    robots = {robot: Ontology.of(c, robot) for _, _, robot in sets if robot is not None}
    none = F.array().cast(f"array<{FAILURE}>")
    listed = lambda hits: F.array_compact(F.array(*hits)) if hits else none
    failures, warnings = F.array(_failure(F.col("action_id"), "unknown action")), none
    for key, i in sets.items():
        specs, preconditions = loaded[key]
        hard, soft = sorted_failures(preconditions, robots.get(key[2], Ontology()), bound)
        here = F.col("__rules") == i
        failures = F.when(here, listed(parameter_failures(specs, bound=bound) + hard)).otherwise(failures)
        warnings = F.when(here, listed(soft)).otherwise(warnings) if soft else warnings
    known = c.spark.createDataFrame(number, "robot_id string, action_id string, __rules int")
    out = calls_.join(small(known), ["robot_id", "action_id"], "left")
    out = unbind(out.withColumns({"failures": failures.cast(f"array<{FAILURE}>"), "warnings": warnings.cast(f"array<{FAILURE}>")}).drop("__rules"), bound)
    summary = F.concat(F.when(F.size("failures") == 0, "OK").otherwise("BLOCKED"), F.array_join(F.transform(F.concat("failures", "warnings"), lambda f: F.concat(F.lit("\n- "), f["error"])), ""))
    return out.withColumn("ok", F.size("failures") == 0).withColumn("summary", summary).select(*calls.columns, "failures", "warnings", "ok", "summary")
