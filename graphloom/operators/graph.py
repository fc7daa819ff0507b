"""Graph queries over a Catalog: lookups, joins, counts and set operations.

Tags in brackets name the operators of the coverage list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, prop, small
from ..model import category_of, layer_of

ENTITY = ["robot_id", "id"]


# Filters and lookups -------------------------------------------------------
def objects_of_type(c: Catalog, type_: str) -> DataFrame:
    """[F1, F3a] Objects of exactly this type."""
    return c.objects.where(F.col("type") == type_)


def get(c: Catalog, id_: str) -> DataFrame:
    """The entity of an id per robot; an object before an action."""
    found = c.entities().where(F.col("id") == id_)
    return found.groupBy("robot_id", "id").agg(F.min_by("type", "prec").alias("type"), F.min("prec").alias("prec"))


def resolve(c: Catalog) -> DataFrame:
    """One row per id: objects, and actions whose id no object has."""
    actions = c.entities().where("prec = 1").join(c.objects.select(*ENTITY), ENTITY, "left_anti")
    return c.entities().where("prec = 0").unionByName(actions)


def exists(c: Catalog, ids: DataFrame) -> DataFrame:
    """Rows of ids (robot_id, id) that an object or action has."""
    return ids.join(c.entities().select(*ENTITY), ENTITY, "left_semi")


def where(df: DataFrame, type_: str, column: str = "props", **props) -> DataFrame:
    """Objects of a type whose properties equal all given ones; a missing key equals None.

    Numbers compare by value and True equals 1, as the caller's language has it.
    """
    out = df.where(F.col("type") == type_)
    for key, value in props.items():
        if value is None:
            out = out.where(prop(key, "string", column).isNull())
        elif isinstance(value, bool | int | float):
            kind = F.schema_of_variant(F.try_variant_get(column, f"$.{key}", "variant"))
            out = out.where(prop(key, "double", column).eqNullSafe(F.lit(float(value))) & (kind != "STRING"))
        else:
            kind = F.schema_of_variant(F.try_variant_get(column, f"$.{key}", "variant"))
            out = out.where(prop(key, "string", column).eqNullSafe(F.lit(value)) & (kind == "STRING"))
    return out


def optional_filters(df: DataFrame, **equal) -> DataFrame:
    """Stacked equality filters on columns; falsy values are no filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]) if kv[1] else d, equal.items(), df)


def actions_by_safety_class(c: Catalog, safety: str) -> DataFrame:
    """[F7, F8]"""
    return c.actions.where(F.col("safety_class") == safety)


def status_bits(c: Catalog, severity: str | None = None, field: str | None = None) -> DataFrame:
    """Status bits by severity and carrier field."""
    bits = objects_of_type(c, "StatusBit")
    bits = bits.where(prop("severity") == severity) if severity else bits
    return bits.where(prop("carrier_field") == field) if field else bits


def joints(c: Catalog, axis: str | None = None, label: str | None = None, part: str | None = None) -> DataFrame:
    """Joints by axis and by label; ``part`` is a substring of the id."""
    found = objects_of_type(c, "Joint")
    found = found.where(prop("dof_axis") == axis) if axis else found
    found = found.where(prop("joint_label") == label) if label else found
    return found.where(F.col("id").contains(part)) if part else found


def modes_by_value(c: Catalog) -> DataFrame:
    """mode_value -> the first mode in load order, per robot."""
    modes = objects_of_type(c, "Mode").withColumn("mode_value", prop("mode_value")).where("mode_value is not null")
    return modes.groupBy("robot_id", "mode_value").agg(F.min_by("id", "ord").alias("mode_id"))


def resolve_refs(c: Catalog, refs: DataFrame, column: str) -> DataFrame:
    """refs with ``resolved``: a known id stays, else the mode of that value, else the input."""
    known = c.entities().select("robot_id", F.col("id").alias(column), F.lit(True).alias("__known")).distinct()
    modes = modes_by_value(c).withColumnRenamed("mode_value", column)
    out = refs.join(small(known), ["robot_id", column], "left").join(small(modes), ["robot_id", column], "left")
    return out.withColumn("resolved", F.when(F.col("__known"), F.col(column)).otherwise(F.coalesce("mode_id", column))).drop("__known", "mode_id")


def action_for_llm(c: Catalog) -> DataFrame:
    """[F16] The seven fields an agent needs; preconditions as their expressions, bare strings included."""
    pre = F.try_variant_get("preconditions", "$", "array<variant>")
    expr = F.transform(F.coalesce(pre, F.array().cast("array<variant>")), lambda p: F.coalesce(F.try_variant_get(p, "$.expr", "string"), F.try_variant_get(p, "$", "string")))
    return c.actions.select("robot_id", "id", "description", "safety_class", "parameters", expr.alias("preconditions"), "affects", "invoker")


def list_actions(c: Catalog) -> DataFrame:
    """Listing with defaults."""
    params = F.coalesce(F.try_variant_get("parameters", "$", "array<variant>"), F.array().cast("array<variant>"))
    shown = F.transform(params, lambda p: F.struct(F.try_variant_get(p, "$.name", "string").alias("name"), F.coalesce(F.try_variant_get(p, "$.type", "string"), F.lit("any")).alias("type"), F.coalesce(F.try_variant_get(p, "$.required", "boolean"), F.lit(False)).alias("required")))
    return c.actions.select("robot_id", "id", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("safety_class", F.lit("UNKNOWN")).alias("safety_class"), F.coalesce("idempotent", F.lit(False)).alias("idempotent"), shown.alias("parameters"))


def list_objects(df: DataFrame) -> DataFrame:
    """id, type, name (the id where there is none)."""
    return df.select("robot_id", "id", "type", F.coalesce(prop("name"), "id").alias("name"))


def explain(c: Catalog, id_: str) -> DataFrame:
    """What an id is: an object, else an action, else the actions that affect it, else one row of kind 'unknown'."""
    found = c.objects.where(F.col("id") == id_).select(F.lit(0).alias("prec"), F.lit("object").alias("kind"), "robot_id", "id")
    acts = c.actions.where(F.col("id") == id_).select(F.lit(1).alias("prec"), F.lit("action").alias("kind"), "robot_id", "id")
    hits = affecting(affects(c), c.spark.createDataFrame([(id_,)], "target string")).select(F.lit(2).alias("prec"), F.lit("affected_by").alias("kind"), "robot_id", F.col("action_id").alias("id"))
    none = c.spark.createDataFrame([(3, "unknown", None, id_)], "prec int, kind string, robot_id string, id string")
    everything = found.unionByName(acts).unionByName(hits).unionByName(none)
    best = everything.agg(F.min("prec").alias("best"))
    return everything.crossJoin(F.broadcast(best)).where("prec = best").select("kind", "robot_id", "id")


def label_of(type_: Column, props: str = "props", id_: str = "id") -> Column:
    """First non-empty of the name fields, else the id's last part; at most 50 characters."""
    named = [F.nullif(prop(k, "string", props), F.lit("")) for k in ("name_human", "name", "bit_name", "name_urdf", "joint_label")]
    return F.left(F.coalesce(*named, F.element_at(F.split(F.col(id_), r"\."), -1)), F.lit(50))


def flat_props(df: DataFrame, column: str = "props") -> DataFrame:
    """One row per shown property (key, value): scalars as text; lists as key_count, and key_sample of a scalar first item; objects and nulls dropped."""
    parts = df.select("robot_id", "id", F.col(column).alias("__v")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    kind = F.schema_of_variant("value")
    listed = F.try_variant_get("value", "$", "array<variant>")
    first = F.get(listed, F.lit(0))
    first_kind = F.schema_of_variant(first)
    text = F.try_variant_get("value", "$", "string")
    rows = F.when(kind.startswith("ARRAY"), F.array(F.struct(F.concat("key", F.lit("_count")).alias("key"), F.size(listed).cast("string").alias("value")), F.when(~first_kind.rlike("^(ARRAY|OBJECT|BOOLEAN|VOID)"), F.struct(F.concat("key", F.lit("_sample")).alias("key"), F.left(F.try_variant_get(first, "$", "string"), F.lit(72)).alias("value")))))
    rows = rows.when(~kind.rlike("^(OBJECT|VOID)"), F.array(F.struct(F.col("key"), text.alias("value"))))
    return parts.select("robot_id", "id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("robot_id", "id", "r.key", "r.value")


def clip_cell(text: Column, most: int = 120) -> Column:
    """Text of at most ``most`` characters, the last three being dots if it was longer."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 3)), F.lit("...")))


# Wildcards -----------------------------------------------------------------
def wildcard_match(target: Column, pattern: Column) -> Column:
    """Equal, or pattern p.* and target p or below it."""
    stem = F.regexp_replace(pattern, r"\.\*$", "")
    return (target == pattern) | (F.endswith(pattern, F.lit(".*")) & ((target == stem) | F.startswith(target, F.concat(stem, F.lit(".")))))


def ancestors(id_: Column) -> Column:
    """a.b.c -> [a, a.b, a.b.c]."""
    parts = F.split(id_, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def affects(c: Catalog) -> DataFrame:
    """[J14] (robot_id, action_id, ord, pattern): ``affects``, or where empty the flattened ``affects_by_domain``."""
    own = F.coalesce(F.try_variant_get("affects", "$", "array<string>"), F.array().cast("array<string>"))
    domains = F.flatten(F.map_values(F.coalesce(F.try_variant_get("affects_by_domain", "$", "map<string,array<string>>"), F.expr("cast(map() as map<string,array<string>>)"))))
    return c.actions.select("robot_id", F.col("id").alias("action_id"), "ord", F.explode(F.when(F.size(own) > 0, own).otherwise(domains)).alias("pattern"))


def affecting(patterns: DataFrame, targets: DataFrame) -> DataFrame:
    """[J14, F29] (robot_id, action_id, target), each once: an equi-join of patterns with the targets and their ancestors, no nested loop."""
    keys = patterns.withColumn("key", F.regexp_replace("pattern", r"\.\*$", "")).withColumn("wild", F.endswith("pattern", F.lit(".*")))
    exact = targets.select("target", F.col("target").alias("key"), F.lit(False).alias("wild"))
    above = targets.select("target", F.explode(ancestors(F.col("target"))).alias("key"), F.lit(True).alias("wild"))
    return keys.join(exact.unionByName(above), ["key", "wild"]).select("robot_id", "action_id", "target").distinct()


# Joins ---------------------------------------------------------------------
def linked(links: DataFrame, type_: str, near: str = "source") -> DataFrame:
    """Links of a type as (robot_id, near_id, far_id), seen from ``near``."""
    far = "target" if near == "source" else "source"
    return links.where(F.col("type") == type_).select("robot_id", F.col(near).alias("near_id"), F.col(far).alias("far_id"))


def neighbours(c: Catalog, type_: str, near: str, resolved: DataFrame | None = None) -> DataFrame:
    """[J1-J3, J10-J13, J29] Links of a type with the far entity; unresolved ones drop, repeated ones stay."""
    far = (resolve(c) if resolved is None else resolved).select("robot_id", F.col("id").alias("far_id"), F.col("type").alias("far_type"), F.col("props").alias("far_props"))
    return linked(c.links, type_, near).join(far, ["robot_id", "far_id"])


def capability_providers(c: Catalog) -> DataFrame:
    """[J1] (robot_id, capability, provider)"""
    return neighbours(c, "provides_capability", "target").select("robot_id", F.col("near_id").alias("capability"), F.col("far_id").alias("provider"), "far_type")


def capability_interfaces(c: Catalog) -> DataFrame:
    """[J2] (robot_id, capability, interface), objects or actions"""
    return neighbours(c, "exposed_via", "source").select("robot_id", F.col("near_id").alias("capability"), F.col("far_id").alias("interface"), "far_type", "far_props")


def capability_parameters(c: Catalog) -> DataFrame:
    """[J3] (robot_id, capability, parameter), objects only"""
    objects = c.entities().where("prec = 0")
    return neighbours(c, "has_parameter", "source", objects).select("robot_id", F.col("near_id").alias("capability"), F.col("far_id").alias("parameter"), "far_props")


def capability_summary(c: Catalog, kind: str | None = None, include_readonly: bool = True) -> DataFrame:
    """[J4, J5] One row per capability with arrays of providers, parameters, actions and interfaces.

    The links of all sides are read in one pass, kept only for the capabilities
    asked for, resolved once and grouped once; a link is on one side, so sides do
    not multiply.  ``include_readonly`` False hides actions of safety class INFO.
    """
    caps = objects_of_type(c, "Capability").withColumn("kind", prop("capability_kind"))
    caps = optional_filters(caps, kind=kind)
    key = ["robot_id", "capability"]
    at_target = F.col("type") == "provides_capability"
    sides = c.links.where(F.col("type").isin("provides_capability", "has_parameter", "exposed_via")).select("robot_id", F.col("type").alias("side"), F.when(at_target, F.col("target")).otherwise(F.col("source")).alias("capability"), F.when(at_target, F.col("source")).otherwise(F.col("target")).alias("far_id"))
    asked = caps.select("robot_id", F.col("id").alias("capability"))
    sides = sides.join(small(asked) if kind else asked, key, "left_semi")
    objects = c.objects.select("robot_id", F.col("id").alias("far_id"), F.col("type").alias("far_type"), F.when(F.col("type").isin("Topic", "Service"), F.coalesce(prop("msg_type"), prop("srv_type"))).alias("schema"), F.lit(None).cast("string").alias("safety_class"), F.lit(True).alias("is_object"))
    acts = c.actions.select("robot_id", F.col("id").alias("far_id"), F.lit("Action").alias("far_type"), F.lit(None).cast("string").alias("schema"), "safety_class", F.lit(False).alias("is_object")).join(c.objects.select("robot_id", F.col("id").alias("far_id")), ["robot_id", "far_id"], "left_anti")
    far = sides.join(objects.unionByName(acts), ["robot_id", "far_id"])
    listed = lambda when, item: F.when(F.count_if(when) > 0, F.array_sort(F.collect_list(F.when(when, item))))
    side, action = F.col("side"), (F.col("side") == "exposed_via") & ~F.col("is_object")
    shown = action if include_readonly else action & ~F.col("safety_class").eqNullSafe("INFO")
    grouped = far.groupBy(*key).agg(
        listed(side == "provides_capability", F.col("far_id")).alias("providers"),
        listed((side == "has_parameter") & F.col("is_object"), F.col("far_id")).alias("parameters"),
        listed(shown, F.struct(F.col("far_id").alias("interface"), "safety_class")).alias("actions"),
        listed((side == "exposed_via") & F.col("far_type").isin("Topic", "Service"), F.struct(F.col("far_id").alias("id"), F.col("far_type").alias("type"), "schema")).alias("interfaces"),
    )
    out = caps.select("robot_id", F.col("id").alias("capability"), F.coalesce(prop("name_human"), "id").alias("name"), "kind", F.coalesce(prop("description"), F.lit("")).alias("description"), prop("detects", "array<string>").alias("detects"), prop("produces", "array<string>").alias("produces"), prop("boundaries", "array<string>").alias("boundaries"))
    return out.join(grouped, key, "left")


def find_capabilities(c: Catalog, capability_kind: str | None = None, detects: str | None = None, provider: str | None = None, exposed_via: str | None = None, requirement: str | None = None) -> DataFrame:
    """[F21, J6-J8] Capabilities by any of the conditions; falsy ones are no filter."""
    caps = objects_of_type(c, "Capability").withColumn("capability", F.col("id"))
    key = ["robot_id", "capability"]
    if capability_kind:
        caps = caps.where(prop("capability_kind") == capability_kind)
    if detects:
        listed = caps.where(F.array_contains(prop("detects", "array<string>"), detects)).select(*key)
        linked_ = linked(c.links, "detects").where(F.col("far_id") == detects).select("robot_id", F.col("near_id").alias("capability"))
        caps = caps.join(listed.unionByName(linked_).distinct(), key, "left_semi")
    if provider:
        caps = caps.join(capability_providers(c).where(F.col("provider") == provider), key, "left_semi")
    if exposed_via:
        caps = caps.join(capability_interfaces(c).where(F.col("interface") == exposed_via), key, "left_semi")
    if requirement:
        caps = caps.join(service_fit(c, requirement=requirement).where(F.size("reasons") > 0), key, "left_semi")
    return caps


def service_fit(c: Catalog, requirement: str | None = None, required_capabilities: list[str] = (), required_outputs: list[str] = ()) -> DataFrame:
    """[J8, J9] Capabilities that fit a requirement, with ordered reasons.

    ``requirement``: the id of a ServiceRequirement; an unknown string asks for a
    capability of that id or kind.  Else the lists given are the requirement.
    """
    caps = objects_of_type(c, "Capability").select("robot_id", F.col("id").alias("capability"), prop("capability_kind").alias("kind"), F.coalesce(prop("produces", "array<string>"), F.array().cast("array<string>")).alias("produces"))
    needs_caps, needs_outputs = list(required_capabilities), list(required_outputs)
    if requirement:
        row = objects_of_type(c, "ServiceRequirement").where(F.col("id") == requirement).select(prop("required_capabilities", "array<string>"), prop("required_outputs", "array<string>")).limit(1).collect()
        needs_caps, needs_outputs = ((row[0][0] or []), (row[0][1] or [])) if row else ([requirement], [])
    asked, outputs = F.array(*map(F.lit, needs_caps)).cast("array<string>"), F.array(*map(F.lit, needs_outputs)).cast("array<string>")
    links = linked(c.links, "satisfies_requirement").where(F.col("far_id") == (requirement or "")).select("robot_id", F.col("near_id").alias("capability"), F.lit(True).alias("linked")).distinct()
    out = caps.join(links, ["robot_id", "capability"], "left")
    by_id, by_kind = F.array_contains(asked, F.col("capability")), F.coalesce(F.array_contains(asked, F.col("kind")), F.lit(False))
    fits = F.coalesce("linked", F.lit(False)) | by_id | by_kind if requirement else F.lit(False)
    reasons = F.array_compact(F.array(F.when(fits, "linked_by_satisfies_requirement"), F.when(by_id, "capability_id_required"), F.when(by_kind, "capability_kind_required"), F.when(F.arrays_overlap("produces", outputs), "required_output_match")))
    return out.select("robot_id", "capability", reasons.alias("reasons")).where(F.size("reasons") > 0)


def actions_in_mode(c: Catalog, allowed: bool = True) -> DataFrame:
    """[J10, J11] (robot_id, mode, action): ``allows`` runs from mode to action, ``forbidden_in`` from action to mode."""
    found = linked(c.links, "allows", "source") if allowed else linked(c.links, "forbidden_in", "target")
    actions = c.actions.select("robot_id", F.col("id").alias("far_id"))
    return found.join(actions, ["robot_id", "far_id"]).select("robot_id", F.col("near_id").alias("mode"), F.col("far_id").alias("action"))


def events_indicating(c: Catalog) -> DataFrame:
    """[J12] (robot_id, target, event)"""
    return neighbours(c, "indicates", "target").select("robot_id", F.col("near_id").alias("target"), F.col("far_id").alias("event"))


def findings_indicating(c: Catalog, findings: DataFrame, target: str) -> DataFrame:
    """[J31] Of the events that indicate a target, those among the active findings (robot_id, event)."""
    known = events_indicating(c).where(F.col("target") == target)
    return known.join(findings.select("robot_id", "event").distinct(), ["robot_id", "event"], "left_semi").select("robot_id", "target", "event")


def standard_terms(c: Catalog) -> DataFrame:
    """One row per mapped term of the standards registry: robot_id, standard, name, term, mapped (text)."""
    registry = F.explode(prop("standards", "array<variant>", "standard_mappings"))
    rows = c.robots.select("robot_id", registry.alias("s"))
    pairs = F.explode(F.map_entries(F.try_variant_get("s", "$.mappings", "map<string,variant>")))
    rows = rows.select("robot_id", prop("id", "string", "s").alias("standard"), prop("name", "string", "s").alias("name"), pairs.alias("p"))
    return rows.select("robot_id", "standard", "name", F.col("p.key").alias("term"), F.try_variant_get("p.value", "$", "string").alias("mapped"))


def transitions(c: Catalog) -> DataFrame:
    """[J13] (robot_id, mode, next): the next mode's value, else its id; dangling links drop."""
    return neighbours(c, "transitions_to", "source").select("robot_id", F.col("near_id").alias("mode"), F.coalesce(prop("mode_value", "string", "far_props"), "far_id").alias("next"))


def kinematic_tree(c: Catalog, link_type: str = "parent_of", depth: int = 64) -> DataFrame:
    """Closure of a link type: (robot_id, top, id, depth)."""
    edges = c.links.where(F.col("type") == link_type).select("robot_id", "source", "target").distinct()
    sql = "WITH RECURSIVE t(robot_id, top, id, depth) AS (SELECT robot_id, source, target, 1 FROM {edges} UNION ALL SELECT t.robot_id, t.top, e.target, t.depth + 1 FROM t JOIN {edges} e ON t.robot_id = e.robot_id AND t.id = e.source WHERE t.depth < {depth}) SELECT * FROM t"
    return c.spark.sql(sql, edges=edges, depth=depth)


# Counts and sets -----------------------------------------------------------
def counts(c: Catalog) -> DataFrame:
    """[A1, A3] Objects, actions, links and distinct types per robot, and errors among the issues."""
    o = c.objects.groupBy("robot_id").agg(F.count("*").alias("objects"), F.count_distinct("type").alias("types"))
    a = c.actions.groupBy("robot_id").agg(F.count("*").alias("actions"))
    ln = c.links.groupBy("robot_id").agg(F.count("*").alias("links"))
    out = o.join(a, "robot_id", "full").join(ln, "robot_id", "full")
    if c.issues is not None:
        out = out.join(c.issues.where("severity = 'error'").groupBy("robot_id").agg(F.count("*").alias("errors")), "robot_id", "left")
    return out.na.fill(0)


def counts_by_type(c: Catalog) -> DataFrame:
    """[A2]"""
    return c.objects.groupBy("robot_id", "type").agg(F.count("*").alias("n")).orderBy("robot_id", "type")


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """[A4] Links per node, both directions; a self-loop counts twice, nodes without links 0."""
    ends = links.select("robot_id", F.explode(F.array("source", "target")).alias("id"))
    found = ends.groupBy("robot_id", "id").agg(F.count("*").alias("degree"))
    return nodes.select(*ENTITY).join(found, ENTITY, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def category_rollup(c: Catalog) -> DataFrame:
    """[A5, A6] Objects per category with its types, and a TOTAL row."""
    per = c.objects.groupBy(category_of(F.col("type")).alias("category"), "type").agg(F.count("*").alias("n"))
    cats = per.groupBy("category").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("types"))
    return cats.unionByName(per.agg(F.lit("TOTAL").alias("category"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.lit("").alias("types")))


def known_ids(c: Catalog) -> DataFrame:
    """[U1]"""
    return c.objects.select(*ENTITY).union(c.actions.select(*ENTITY)).distinct()


def collisions(c: Catalog) -> DataFrame:
    """[J16, U2] Ids that an object and an action share."""
    return c.objects.select(*ENTITY).intersect(c.actions.select(*ENTITY))


def dangling(c: Catalog) -> DataFrame:
    """[J15] (robot_id, ord, type, side, end): ends that no entity has; ends with * are exempt, null ends are not."""
    sides = c.links.select("robot_id", "ord", "type", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("end")), F.struct(F.lit("target").alias("side"), F.col("target").alias("end")))).alias("e")).select("robot_id", "ord", "type", "e.side", "e.end")
    sides = sides.where("end is null or not contains(end, '*')")
    return sides.join(known_ids(c).withColumnRenamed("id", "end"), ["robot_id", "end"], "left_anti")


def graph_edges(c: Catalog, known_only: bool = False) -> DataFrame:
    """[U6, U7] Links and the edges made of ``affects``; ``known_only``: both ends known, wildcards dropped."""
    edges = c.links.select("robot_id", "type", "source", "target").unionByName(affects(c).select("robot_id", F.lit("affects").alias("type"), F.col("action_id").alias("source"), F.col("pattern").alias("target")))
    if known_only:
        for end in ("source", "target"):
            edges = edges.join(known_ids(c).withColumnRenamed("id", end), ["robot_id", end], "left_semi")
    return edges.select("robot_id", "type", "source", "target")


def graph_nodes(c: Catalog) -> DataFrame:
    """[K4, F28] Nodes for export: id, type, category, layer, label."""
    return c.objects.select("robot_id", "id", "type", category_of(F.col("type")).alias("category"), layer_of(F.col("type")).alias("layer"), label_of(F.col("type")).alias("label"))


# Drafts --------------------------------------------------------------------
# Words of an action's id and description, first match first -> (id, name, kind).
KIND_RULES = (
    (("velocity", "locomotion"), ("locomotion_control", "Locomotion control", "navigation")),
    (("joint",), ("joint_control", "Joint control", "actuation")),
    (("hand", "gripper"), ("hand_manipulation", "Hand manipulation", "manipulation")),
    (("tts", "media", "volume", "mute"), ("speech_output", "Speech and media output", "interaction")),
    (("input_source", "source"), ("input_source_arbitration", "Input source arbitration", "communication")),
    (("mode", "mc_action"), ("mode_management", "Mode management", "planning")),
)
RISKY = ("MOTION", "POWER", "IRREVERSIBLE")
RISKY_KIND = ("motion_execution", "Motion execution", "actuation")
OTHER_KIND = ("information_or_configuration", "Information and configuration", "diagnosis")


def kind_of_action(id_: Column, description: Column, safety: Column) -> Column:
    """[A18] The capability an action belongs to: the first rule whose word it contains, then its safety class."""
    text = F.lower(F.concat(id_, F.lit(" "), F.coalesce(description, F.lit(""))))
    as_struct = lambda k: F.struct(*[F.lit(v).alias(n) for n, v in zip(("kind_id", "name", "capability_kind"), k, strict=True)])
    out = F.when(F.lit(False), as_struct(OTHER_KIND))
    for words, kind in KIND_RULES:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), as_struct(kind))
    return out.when(safety.isin(*RISKY), as_struct(RISKY_KIND)).otherwise(as_struct(OTHER_KIND))


def infer_capabilities(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """[A18, J29] Draft capabilities and their exposed_via links (action, then what it is invoked through)."""
    kinds = c.actions.withColumn("k", kind_of_action(F.col("id"), F.col("description"), F.col("safety_class")))
    cap = F.concat("robot_id", F.lit(".cap."), F.col("k.kind_id"))
    objects = kinds.groupBy("robot_id", cap.alias("id")).agg(F.first("k.name").alias("name_human"), F.first("k.capability_kind").alias("capability_kind"), F.array_sort(F.collect_list("id")).alias("actions"))
    direct = kinds.select("robot_id", cap.alias("source"), F.col("id").alias("target"))
    via = direct.join(linked(c.links, "invokes_via").select("robot_id", F.col("near_id").alias("target"), "far_id"), ["robot_id", "target"]).select("robot_id", "source", F.col("far_id").alias("target"))
    links = direct.unionByName(via).select("robot_id", F.lit("exposed_via").alias("type"), "source", "target")
    return objects, links
