"""Catalog: the tables of one or many packs, keyed by robot_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of its plan's statistics, that is broadcast on purpose.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if the optimiser's size of it is at most ``most``; else as it is, for a shuffled join.

    The optimiser has no size of rows that the program made (``createDataFrame``)
    and takes them for endless: these alone are counted, up to the limit.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size > most and not df.isStreaming and _made_here(plan):
        rows = most // max(1, sum(f.dataType().defaultSize() for f in df._jdf.schema().fields()))
        size = 0 if df.limit(rows + 1).count() <= rows else size
    return F.broadcast(df) if size <= most else df


def _made_here(plan) -> bool:
    """Whether a plan reads nothing but rows of the program."""
    leaves = plan.collectLeaves()
    names = [leaves.apply(i).nodeName() for i in range(leaves.size())]
    return bool(names) and all(n in ("LogicalRDD", "Scan ExistingRDD", "LocalRelation", "OneRowRelation") for n in names)


@dataclass
class Catalog:
    """objects, actions, links, issues, robots, policies.

    objects: robot_id, ord, id, type, props, source (VARIANT both).  actions:
    robot_id, ord, id and its fields, the free ones VARIANT.  links: robot_id,
    ord, type, source, target, attrs; a bag.  robots: robot_id and the
    documents meta, goals, standard_mappings, boundary (VARIANT).
    """

    objects: DataFrame
    actions: DataFrame
    links: DataFrame
    issues: DataFrame | None = None
    robots: DataFrame | None = None
    policies: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.objects.sparkSession

    def entities(self) -> DataFrame:
        """Objects and actions by id; prec 0 for objects, which win."""
        o = self.objects.select("robot_id", "id", "type", "props", F.lit(0).alias("prec"), "ord")
        a = self.actions.select("robot_id", "id", F.lit("Action").alias("type"), F.lit(None).cast("variant").alias("props"), F.lit(1).alias("prec"), "ord")
        return o.unionByName(a)

    def views(self, prefix: str = "") -> None:
        """Temporary views of all tables, for SQL."""
        for name in ("objects", "actions", "links", "issues", "robots", "policies"):
            table = getattr(self, name)
            if table is not None:
                table.createOrReplaceTempView(prefix + name)

    def cache(self) -> Catalog:
        for table in (self.objects, self.actions, self.links):
            table.cache()
        return self


def prop(path: str, kind: str = "string", column: str = "props") -> Column:
    """A property by path, null if absent or of another type."""
    return F.try_variant_get(F.col(column), "$." + path, kind)


def first_wins(df: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key appears first by ord, the later ones)."""
    from pyspark.sql import Window

    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy("ord")))
    return ranked.where("__rn = 1").drop("__rn"), ranked.where("__rn > 1").drop("__rn")
