"""Connected components by alternating stars: joins and minimum aggregates only, no group is ever collected.

`components` labels all nodes of a graph at once. `ComponentStore` keeps labels of a graph that grows: a delivery of links only
touches the components its links meet.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficloom.plans.lookup import lookup
from trafficloom.plans.pinning import pin


def _star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return both, lowest


def _large(edges: DataFrame, size: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both, lowest = _star(edges)
    met = lookup(both.where("v > u"), lowest, "u", "n", "v", total=2 * size)
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, size: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    met = lookup(down, lowest, "u", "n", "v", total=size)
    moved = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str, rows: int | None = None) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Each round either moves an edge to a smaller end or ends the loop, so no cap on rounds is needed; the number of
    rounds grows with the logarithm of the longest path. Rows with a null end and loops are no edges. Edges of a node that
    has a thousandth of all edges or more are dealt over many tasks, whatever Spark's settings for skewed joins. `rows`, where
    known that there are no more edges, keeps them in few files.
    """
    now = pin(
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct(),
        rows,
    )
    print_of = F.struct(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v")))
    before = None
    while True:
        state = tuple(now.agg(print_of.alias("p")).first()["p"])
        if state == before or state[0] == 0:
            return now.groupBy("u").agg(F.min("v").alias("component")).select(
                F.col("u").alias("node"), "component"
            ).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        # the steps that follow have at most as many edges, and one more per node
        now = pin(_small(_large(now, state[0]), state[0]), 3 * state[0])


class ComponentStore:
    """Components of a graph whose links arrive in deliveries, kept in a folder.

    Every node is written once, with the component it had on arrival; a table of merged components, rewritten by each
    delivery, leads from there to the component of today. So a delivery writes its new nodes and one row per component that was ever
    merged into another, and reads of the stored nodes no more than the join with its own ends. A component is its smallest node.

    A delivery counts once its number is written. Readers go by the last number, so what a failed delivery left is not
    seen, and is replaced when the delivery is repeated. One delivery runs at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def last(self) -> int | None:
        """Number of the last delivery that is complete."""
        found = self._read("deliveries", "number long")
        return None if found is None else found.agg(F.max("number")).first()[0]

    def _nodes(self, last: int | None) -> DataFrame:
        found = None if last is None else self._read("nodes", "node long, component long, number long")
        empty = self.spark.createDataFrame([], "node long, component long")
        return empty if found is None else found.where(F.col("number") <= last).drop("number")

    def _merged(self, last: int | None) -> DataFrame:
        """(component, now) of the components that are part of another one today."""
        found = None if last is None else self._read(f"merged/number={last}", "component long, now long")
        return self.spark.createDataFrame([], "component long, now long") if found is None else found

    @staticmethod
    def _today(nodes: DataFrame, merged: DataFrame) -> DataFrame:
        met = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        table = pin(merged.join(met, "component"))
        found = lookup(nodes, table, "component", "n", "node", how="left")
        return found.select("node", F.coalesce("now", "component").alias("component"))

    def labels(self) -> DataFrame:
        """(node, component) after the last complete delivery."""
        last = self.last()
        return self._today(self._nodes(last), self._merged(last))

    def add(self, links: DataFrame, left: str, right: str, number: int) -> None:
        """Take in a delivery; one whose number is not above the last one's is skipped. Links with a null end are left out.

        A link of a node with itself makes the node known without joining it to another.
        """
        last = self.last()
        if last is not None and number <= last:
            return
        edges = pin(
            links.where(F.col(left).isNotNull() & F.col(right).isNotNull())
            .select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
            .distinct()
        )
        ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node")))
        ends = pin(ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
        stored, merged = self._nodes(last), self._merged(last)
        met = pin(self._today(stored.join(ends.select("node"), "node", "left_semi"), merged))
        known = pin(
            ends.join(met, "node", "left").select(
                "node", "n", F.coalesce("component", "node").alias("label"), F.col("component").isNull().alias("new")
            )
        )
        table = known.select(F.col("node").alias("u"), F.col("label").alias("a"), "n")
        half = lookup(edges, table, "u", "n", "v").select("a", "v")
        table = known.select(F.col("node").alias("v"), F.col("label").alias("b"), "n")
        joined = lookup(half, table, "v", "n", "a").where("a <> b").select("a", "b")
        found = pin(components(joined, "a", "b").select(F.col("node").alias("now"), F.col("component").alias("next")))
        arrived = known.where("new").select("node", "label")
        fresh = arrived.join(found, arrived["label"] == found["now"], "left").select(
            "node", F.coalesce("next", "label").alias("component")
        )
        fresh.write.mode("overwrite").parquet(f"{self.path}/nodes/number={number}")
        # components merged before follow where they were led to; those merged now had stored nodes
        table = pin(found.where("now <> next").join(merged.groupBy("now").agg(F.count(F.lit(1)).alias("n")), "now"))
        moved = lookup(merged, table, "now", "n", "component", how="left").select(
            "component", F.coalesce("next", "now").alias("now")
        )
        roots = met.select("component").distinct().join(
            found.where("now <> next").select(F.col("now").alias("component"), F.col("next").alias("now")), "component"
        )
        moved.unionByName(roots).write.mode("overwrite").parquet(f"{self.path}/merged/number={number}")
        self.spark.range(1).select(F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("append").parquet(
            f"{self.path}/deliveries"
        )
