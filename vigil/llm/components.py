"""Connected components of a graph given by its links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least neighbour: of the larger ones (``large``) or of the node and its smaller ones.

    The least neighbour is a partial aggregate, so the centre of a large star
    is no hot key there; the join back can be split where it is.
    """
    if large:
        near = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("least"))
    both = near.join(least, "a").withColumn("least", F.least("a", "least"))
    if large:
        out = both.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = both.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; component: the smallest node it can reach.

    Alternates large and small stars; every round writes the links to the
    shared folder, so lineage stays short, and stops when they no longer change.
    Links with a null end or from a node to itself are left out.
    """
    now = stored(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select("b", "b").distinct())
        before = mark
        now = stored(_stars(_stars(now, True), False), "links")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
