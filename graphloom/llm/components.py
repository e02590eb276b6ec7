"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v), long; root is the component's smallest node.  Reruns agree.

    Loops and repeated edges do no harm; without edges there are no rows.  Every round is written to the shared folder, and the
    round before it deleted.  The number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    schema = "u long, v long"
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = write_table(e, "edges")
    state = None
    while True:
        e = spark.read.schema(schema).parquet(path)
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        new = write_table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_table(spark, path)
        path = new
    stars = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
