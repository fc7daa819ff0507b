"""URL filter: explicit rules, and a path-template tree per host.

The tree is built level by level from counts of distinct paths: a segment with
digits, or a rare one under a node with many children, becomes a wildcard.
From the deepest level up, siblings (templates that differ in one segment)
whose labelled rates do not differ significantly merge.

The evidence on a template is its labelled pages on the host; where there are
none, those of the same template on the parent domain, else on all hosts.  Its
purity is smoothed the same way: the rate of all hosts towards that of the
table, the domain's towards that, the host's towards the domain's.  A template
is rejected if its purity is high enough.  Only counts are shuffled per level;
no host's rows ever meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import small
from .common import materialize, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Children from which on rare ones are variable, and the share that makes one common.
FANOUT, COMMON = 12, 0.05
#: Standard errors within which siblings count as similar; pseudo-count of the parent's rate; purity of a rejected template.
SIMILAR, PSEUDO, PURE = 2.0, 4.0, 0.6
#: Labelled pages from which on two groups of siblings can differ.
LEAST = 4


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z in lower case; else empty."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.coalesce(F.when(at > 0, F.translate(host, UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(at > 0, path), F.lit(""))


def apply_rules(pages: DataFrame, rules: list[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """pages with rule and rule_verdict of the longest rule that fits (ties: the longer host, then the first), or null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: (len(r.text), len(r.host))):
        fits = ((F.col(host) == r.host) | F.endswith(F.col(host), F.lit("." + r.host))) & F.startswith(F.col(path), F.lit(r.path))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def template_tree(paths: DataFrame, fanout: int = FANOUT, common: float = COMMON) -> tuple[DataFrame, str, int]:
    """Distinct (host, path, n) with its template; where the table is; and the number of levels that paths share.

    A path that is alone under its node has no siblings further down, so the
    rest of its template is written at once.
    """
    variable = lambda part: part.rlike("[0-9]")
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    now = paths.withColumn("parts", parts).withColumn("template", F.lit("")).withColumn("done", F.lit(False))
    now, at = materialize(now, "paths")
    level = 0
    while now.where(~F.col("done") & (F.size("parts") > level)).limit(1).count():
        part = F.when(~F.col("done"), F.get("parts", F.lit(level)))
        here = now.withColumn("part", part)
        child = here.where("part is not null").groupBy("host", "template", "part").agg(F.sum("n").alias("n_child"), F.count("*").alias("n_paths"))
        node = child.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n_child").alias("n_node"), F.sum("n_paths").alias("paths"))
        grown = here.join(child, ["host", "template", "part"], "left").join(node, ["host", "template"], "left")
        rare = (F.col("children") > fanout) & (F.col("n_child") < common * F.col("n_node"))
        name = F.when(variable(F.col("part")) | rare, "*").otherwise(F.col("part"))
        alone = F.col("part").isNotNull() & (F.col("paths") == 1)
        rest = F.array_join(F.transform(F.expr(f"slice(parts, {level + 1}, greatest(size(parts) - {level}, 0))"), lambda p: F.concat(F.lit("/"), F.when(variable(p), "*").otherwise(p))), "")
        grown = grown.withColumn("done", F.col("done") | F.coalesce(alone, F.lit(False)))
        grown = grown.withColumn("template", F.when(F.col("part").isNull(), F.col("template")).when(alone, F.concat("template", rest)).otherwise(F.concat("template", F.lit("/"), name)))
        nxt, path = materialize(grown.select(*now.columns), "paths")
        release(paths.sparkSession, at)
        now, at, level = nxt, path, level + 1
    return now.drop("parts", "done"), at, level


def sibling_names(names: list[str], labelled: list[int], bad: list[int], similar: float = SIMILAR) -> list[str]:
    """New names of a node's children: nearest labelled groups merge while their rates do not differ significantly.

    A difference counts only if both groups together have LEAST labelled pages.
    One group of all is *; a smaller one names its members, or is * if it holds
    the wildcard.  Unlabelled children go to *.
    """
    groups = sorted(([[n], y, b] for n, y, b in zip(names, labelled, bad, strict=True) if y), key=lambda g: (g[2] / g[1], g[0]))
    while len(groups) > 1:

        def apart(i):
            (_, m, a), (_, n, b) = groups[i : i + 2]
            rate = (a + b) / (m + n)
            error = (rate * (1 - rate) * (1 / m + 1 / n)) ** 0.5
            return (b / n - a / m) / error if error and b / n > a / m and m + n >= LEAST else 0.0

        at = min(range(len(groups) - 1), key=apart)
        if apart(at) > similar:
            break
        groups[at : at + 2] = [[sum((g[k] for g in groups[at : at + 2]), [] if k == 0 else 0) for k in range(3)]]
    new = dict.fromkeys(names, "*")
    if len(groups) > 1:
        for members, _, _ in groups:
            if "*" not in members:
                new |= dict.fromkeys(members, members[0] if len(members) == 1 else "{" + "|".join(sorted(members)) + "}")
    return [new[n] for n in names]


def domain_of(host: Column) -> Column:
    """The host without its first label, if at least two are left; else the host itself."""
    return F.when(F.size(F.split(host, r"\.")) > 2, F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host)


def with_evidence(leaves: DataFrame) -> DataFrame:
    """leaves (host, template, labelled, bad) with the counts of the same template on the parent domain (d_) and on all hosts (a_).

    ``e_labelled`` and ``e_bad`` are those of the first of the three that has any.
    """
    leaves = leaves.withColumn("domain", domain_of(F.col("host")))
    sums = lambda p: [F.sum(c).alias(f"{p}_{c}") for c in ("labelled", "bad")]
    domains = leaves.groupBy("domain", "template").agg(*sums("d"))
    everywhere = domains.groupBy("template").agg(*[F.sum(f"d_{c}").alias(f"a_{c}") for c in ("labelled", "bad")])
    domains = domains.join(small(everywhere), "template")
    out = leaves.join(small(domains), ["domain", "template"])
    first = lambda c: F.when(F.col("labelled") > 0, F.col(c)).when(F.col("d_labelled") > 0, F.col(f"d_{c}")).otherwise(F.col(f"a_{c}"))
    return out.withColumns({"e_labelled": first("labelled"), "e_bad": first("bad")}).drop("domain")


def merge_siblings(leaves: DataFrame, levels: int, similar: float = SIMILAR) -> DataFrame:
    """leaves (host, template, e_labelled, e_bad) with merged, from the deepest shared level up.

    Siblings agree in all segments but that of the level.  A node has at most
    FANOUT literal children, or 1 / COMMON of them, so its list is short.
    """
    rename = F.udf(lambda found: [(n, m) for n, m in zip([c["seg"] for c in found], sibling_names([c["seg"] for c in found], [c["labelled"] for c in found], [c["bad"] for c in found], similar), strict=True)], "array<struct<seg:string,name:string>>")
    now = leaves.withColumn("segs", F.split(F.regexp_replace("template", "^/", ""), "/"))
    now, at = materialize(now, "leaves")
    for level in range(levels - 1, -1, -1):
        keyed = now.select("*", F.slice("segs", 1, level).alias("__head"), F.get("segs", F.lit(level)).alias("seg"), F.expr(f"slice(segs, {level + 2}, greatest(size(segs) - {level + 1}, 0))").alias("__tail"))
        key = ["host", "__head", "__tail"]
        child = keyed.where("seg is not null").groupBy(*key, "seg").agg(F.sum("e_labelled").alias("labelled"), F.sum("e_bad").alias("bad"))
        nodes = child.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seg", "labelled", "bad"))).alias("found")).where(F.size("found") > 1)
        named = nodes.select(*key, F.explode(rename("found")).alias("new")).select(*key, F.col("new.seg").alias("seg"), F.col("new.name").alias("__name"))
        grown = keyed.join(named, [*key, "seg"], "left")
        segs = F.when(F.col("__name").isNull(), F.col("segs")).otherwise(F.concat("__head", F.array("__name"), "__tail"))
        nxt, path = materialize(grown.select(*[c for c in now.columns if c != "segs"], segs.alias("segs")), "leaves")
        release(leaves.sparkSession, at)
        now, at = nxt, path
    merged = F.when(F.col("template") == "", "").otherwise(F.concat(F.lit("/"), F.array_join("segs", "/")))
    return now.withColumn("merged", merged).drop("segs")


def judge(pages: DataFrame, id_col: str, url_col: str, rules: list[Rule], label: Column | None = None, similar: float = SIMILAR, pseudo: float = PSEUDO, pure: float = PURE) -> DataFrame:
    """id, host, path, rule, verdict, template, purity for every row of pages.

    ``label``: 1 bad, 0 good, null unknown, over columns host, path, rule and
    rule_verdict too; by default the rules' verdicts are the labels.  A null url
    has empty host and path and is judged like any other; repeated rows count
    and stay; a null id stays null.
    """
    parsed = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parsed = apply_rules(parsed, rules)
    label = label if label is not None else F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0)
    counts = parsed.withColumn("__y", label.cast("int")).groupBy("host", "path").agg(F.count("*").alias("n"), F.count("__y").alias("labelled"), F.coalesce(F.sum("__y"), F.lit(0)).cast("long").alias("bad"))
    tree, tree_path, levels = template_tree(counts)

    whole = tree.agg(F.sum("labelled"), F.sum("bad")).first()
    base = float(whole[1] or 0) / whole[0] if whole[0] else 0.0
    leaves = with_evidence(tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    leaves = merge_siblings(leaves, levels, similar)
    levels_of = [("a_", F.lit(base)), ("d_", F.col("a_rate")), ("", F.col("d_rate"))]
    merged = leaves.groupBy("host", "merged").agg(*[F.sum(f"{p}{c}").alias(f"{p}{c}") for p, _ in levels_of for c in ("labelled", "bad")])
    for p, towards in levels_of:
        merged = merged.withColumn(f"{p}rate", (F.col(f"{p}bad") + pseudo * towards) / (F.col(f"{p}labelled") + pseudo))  # pseudo > 0
    rated, _ = materialize(leaves.select("host", "template", "merged").join(merged.select("host", "merged", F.col("rate").alias("purity")), ["host", "merged"]), "rated")
    by_path, _ = materialize(tree.select("host", "path", "template").join(small(rated), ["host", "template"]).select("host", "path", F.col("merged").alias("template"), "purity"), "by_path")
    release(pages.sparkSession, tree_path)
    out = parsed.join(small(by_path), ["host", "path"])
    own_verdict = F.when(F.col("purity") >= pure, "block").otherwise("allow")
    return out.select(F.col(id_col), "host", "path", "rule", F.coalesce("rule_verdict", own_verdict).alias("verdict"), "template", "purity")
