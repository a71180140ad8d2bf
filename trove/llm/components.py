"""Connected components by alternating stars, as DataFrame joins.

Each round re-hangs every node on the smallest neighbour it knows (large star,
then small star) and writes the edges to the shared folder, so the lineage
stays short and a lost executor repeats one round at most. Edges never reach
the driver: it sees two numbers per round, a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch, write_scratch

#: Edges in one file of a round.
FILE_EDGES = 1 << 12


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of orderable keys -> (node, root) for every node with an
    edge to a smaller one; root is the smallest node it can reach."""
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last = write_scratch(now, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or (mark["n"], mark["h"]) == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = (mark["n"], mark["h"])
        # a round writes files in proportion to its edges, however many partitions a shuffle has
        before, now = now, write_scratch(_small_star(_large_star(now)).coalesce(1 + mark["n"] // FILE_EDGES), "edges")
        drop_scratch(before)
