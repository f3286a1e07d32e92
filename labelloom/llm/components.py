"""Connected components of an edge table, by rounds of hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.scale.staging import StagingScope


def connected_components(edges: DataFrame, scope: StagingScope, label: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round points every node at its smallest neighbour, follows pointers twice, and contracts the edges
    to what still joins different roots. A round at least halves the nodes of every unfinished component, so
    their number is logarithmic. Only aggregated minima and narrow joins are shuffled; nothing is collected
    but whether edges are left. Self edges and repeated edges do no harm; null ends take no part.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select("a", "b")
    left = scope.stage(edges.distinct(), f"{label}-edges-0")
    labels = scope.stage(
        left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")),
        f"{label}-labels-0",
    )
    turn = 0
    while not left.isEmpty():
        turn += 1
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to"))
        hooked = scope.stage(hooked, f"{label}-hooked-{turn}")
        roots = scope.stage(_follow(_follow(hooked)), f"{label}-roots-{turn}")
        labels = scope.stage(
            labels.join(roots.select(F.col("a").alias("component"), "to"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            ),
            f"{label}-labels-{turn}",
        )
        ends = left.join(roots.select("a", F.col("to").alias("ra")), "a").join(
            roots.select(F.col("a").alias("b"), F.col("to").alias("rb")), "b"
        )
        shorter = ends.filter(F.col("ra") != F.col("rb")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        left = scope.stage(shorter.distinct(), f"{label}-edges-{turn}")
    return labels


def _follow(pointers: DataFrame) -> DataFrame:
    """Replace every pointer by the pointer of what it points at."""
    onward = pointers.select(F.col("a").alias("to"), F.col("to").alias("next"))
    return pointers.join(onward, "to").select("a", F.col("next").alias("to"))
