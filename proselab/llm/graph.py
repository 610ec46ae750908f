"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable, for every id of ``edges``
    (a, b: bigint).  Alternates two star contractions until nothing changes;
    each round is a few joins over the edges, written to the shared folder.
    Both stars take a minimum per id, which combines before the shuffle."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = saved(e, "edges")
    mark = None
    while True:
        # every larger neighbour is tied to the smallest id around
        both = e.union(e.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("i"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("i")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # then every id and its smaller neighbours to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("i"), "m")
        tied = large.join(low, F.col("a") == F.col("i")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = saved(tied.union(low.select(F.col("i").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
