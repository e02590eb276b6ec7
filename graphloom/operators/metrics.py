"""Ranking and classification quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query, recall, ap, ndcg, mrr) of ranked (query, id, rank) against relevant (query, id); queries without relevant ids have none."""
    from pyspark.sql import Window

    n = relevant.groupBy("query").agg(F.count("*").alias("n_relevant"))
    hit = relevant.select("query", "id", F.lit(1).alias("hit"))
    rows = ranked.join(hit, ["query", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    so_far = F.sum("hit").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far)
    within = F.col("rank") <= k
    agg = rows.groupBy("query").agg(
        F.sum(F.when(within, F.col("hit")).otherwise(0)).alias("hits_k"), F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.sum(F.when(within, F.col("hit") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    joined = n.join(agg, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select("query", zero(F.col("hits_k") / F.col("n_relevant")).alias("recall"), zero(F.col("ap_sum") / F.col("n_relevant")).alias("ap"), zero(F.col("dcg") / ideal).alias("ndcg"), zero(1 / F.col("first")).alias("mrr"))


def classification(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(precision, recall, f1) of ids, each matched once; nothing found or nothing expected counts as 1."""
    f, e = found.select("id").distinct(), expected.select("id").distinct()
    one = f.agg(F.count("*").alias("nf")).crossJoin(e.agg(F.count("*").alias("ne"))).crossJoin(f.join(e, "id", "left_semi").agg(F.count("*").alias("tp")))
    p, r = F.when(F.col("nf") == 0, 1.0).otherwise(F.col("tp") / F.col("nf")), F.when(F.col("ne") == 0, 1.0).otherwise(F.col("tp") / F.col("ne"))
    return one.select(p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def completeness(found: DataFrame, expected: DataFrame) -> DataFrame:
    cols = expected.columns
    return expected.distinct().join(found.select(*cols).distinct().withColumn("__hit", F.lit(1)), cols, "left").agg(F.when(F.count("*") == 0, 1.0).otherwise(F.count("__hit") / F.count("*")).alias("completeness"))
