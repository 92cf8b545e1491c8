"""Connected components of a link table, by alternating star contractions.

Each round links every node's larger neighbours to its smallest one (large
star) and then its smaller neighbours and itself to the smallest (small star).
Minima are combined before each exchange and joined back, so no task gathers a
node's neighbours, however many it has.  Rounds grow with the logarithm of the
components' size; each round's links are written to the shared folder.

Cases: links of a node with itself and repeated links change nothing; rows
with a null end are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import discard, staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    return both.where("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("least").alias("low"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    rest = links.join(least, "high").where("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return least.select("high", F.col("least").alias("low")).union(rest).distinct()


def _is_stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or only larger ones."""
    ends = links.select(F.col("high").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("root")).union(
        links.select(F.col("low"), F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("root").alias("root"))
    return nodes.where("ups > 1 or (ups = 1 and root = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (two long columns); the component is its smallest node."""
    a, b = links.columns
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    links = staged(links, "links")
    while not _is_stars(links):
        earlier, links = links, staged(_small_star(_large_star(links).distinct()), "links")
        discard(earlier)
    members = links.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return members.union(links.select(F.col("low"), F.col("low")).distinct())
