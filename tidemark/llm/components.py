"""Connected components of an edge table, by alternating large and small stars.

Both steps are one aggregation and one equi-join; labels and links stay distributed.
A node with very many neighbours, such as the smallest copy of a large group, is joined
apart (``join_counted``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, join_counted, scope, table


#: Links in a file of a round's table.
FILE_LINKS = 500_000


def _large(edges: DataFrame, files: int | None) -> DataFrame:
    """Link the larger neighbours of a node to its smallest neighbour or itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = table(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k"), files=files)
    return join_counted(both.filter("v > u"), least, ["u"], "k").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of these; after the large step these are few."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").union(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` longs -> ``id, component``: every node that has an edge to another, and the smallest id it reaches."""
    spark = edges.sparkSession
    now = table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark, files = None, None
    while True:
        old = now
        with scope(spark) as kept:
            now = table(_small(_large(old, files)), files=files)
            kept.append(now)
        drop(spark, old)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark, files = seen, seen[0] // FILE_LINKS + 1
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
