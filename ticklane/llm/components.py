"""Connected components by randomised contraction.

Each round every node picks the neighbour (or itself) with the smallest hash under that round's seed, and
edges are rewritten to the picks. The expected number of nodes falls by a constant factor a round, whatever
the shape of the graph, so chains need logarithmically many rounds too. Only hash aggregates with partial
sums and joins with one row per node on one side are used, so a node with a third of all edges is no
bottleneck: aggregates combine before the shuffle and the joins can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.shared import stored


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node``, ``root`` (longs) for every node that has an edge to another node.

    ``root`` is one node of the component, the same for all its nodes. Null ends and loops are ignored; an
    empty table gives no rows.
    """
    current = stored(edges.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v"))
                     .filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    picks = []
    while not current.isEmpty():
        seed = F.lit(len(picks))
        both = current.union(current.select("v", "u"))
        chosen = (both.groupBy("u")
                  .agg(F.min_by("v", F.xxhash64("v", seed)).alias("best"), F.min(F.xxhash64("v", seed)).alias("rank"))
                  .select(F.col("u").alias("node"),
                          F.when(F.xxhash64("u", seed) < F.col("rank"), F.col("u")).otherwise(F.col("best")).alias("pick")))
        chosen = stored(chosen)
        picks.append(chosen)
        current = stored(
            current.join(chosen.select(F.col("node").alias("u"), F.col("pick").alias("pu")), "u")
            .join(chosen.select(F.col("node").alias("v"), F.col("pick").alias("pv")), "v")
            .filter(F.col("pu") != F.col("pv"))
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    if not picks:
        return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    result = picks[-1].select("node", F.col("pick").alias("root"))
    for chosen in reversed(picks[:-1]):
        later = result.select(F.col("node").alias("pick"), "root")
        result = chosen.join(later, "pick", "left").select("node", F.coalesce("root", "pick").alias("root"))
    return stored(result)
