"""Hybrid search: keyword and semantic candidates, merged, scored on four signals and cut to the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scoring as S
from graphloom.functions import text as X
from graphloom.model import WEIGHTS
from graphloom.operators import graph
from graphloom.operators.store import equals
from graphloom.sources.text_index import TextIndex

OVERFETCH = 3


def keyword_search(objects: DataFrame, query: str, kind: str = "", project: str = "", limit: int = 20, stemmed: bool = False, index: TextIndex | None = None) -> DataFrame:
    """(id, raw, kw, kw_rank): best first; kw is the share of the best score.  With a stored index only its terms' rows are read, else all texts."""
    scores = X.bm25(objects, query, stemmed=stemmed) if index is None else index.search(X.search_terms(query, index.manifest["stemmed"]), limit, type=kind, project=project)
    if index is None and (kind or project):
        scores = scores.join(equals(objects, type=kind, project=project).select("id"), "id", "left_semi")
    top = scores.orderBy(F.desc("raw"), "id").limit(limit)
    everything = Window.partitionBy(F.lit(1))  # at most `limit` rows
    best = F.max("raw").over(everything)
    share = F.when(best > 0, F.least(F.greatest("raw", F.lit(0.0)) / best, F.lit(1.0))).otherwise(1 - (F.row_number().over(everything.orderBy(F.desc("raw"), "id")) - 1) / F.count("*").over(everything))
    return top.select("id", "raw", share.alias("kw"), F.row_number().over(everything.orderBy(F.desc("raw"), "id")).alias("kw_rank"))


def semantic_search(vectors: DataFrame, query: list[float], limit: int = 20) -> DataFrame:
    """(id, sem, sem_rank) of the vectors nearest to the query."""
    top = vectors.select("id", S.cosine_to(F.col("embedding"), query).alias("sem")).orderBy(F.desc("sem"), "id").limit(limit)
    return top.withColumn("sem_rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("sem"), "id")))


def search(
    objects: DataFrame, vectors: DataFrame | None, edges: DataFrame, query: str, as_of: Column, query_vector: list[float] | None = None, mentions: DataFrame | None = None, entities: DataFrame | None = None, kind: str = "",
    project: str = "", entity: str = "", limit: int = 20, min_relevance: float = 0.0, weights: dict[str, float] = WEIGHTS, strict_entity: bool = False, prefilter: bool = False, stemmed: bool = False, index: TextIndex | None = None,
) -> DataFrame:
    """(id, title, type, project, created_at, score, keyword, semantic, graph, recency), best first.

    Both legs fetch OVERFETCH times the limit.  The semantic leg is cut before the filters unless `prefilter`.  An unknown
    entity filters nothing unless `strict_entity`.  The candidates are at most 6 * limit rows, so all that follows the two
    legs is broadcast by size; ties are ordered by keyword rank, then semantic rank, then id.
    """
    n = limit * OVERFETCH
    kw = keyword_search(objects, query, kind, project, n, stemmed, index).drop("raw")
    if vectors is not None and query_vector is not None and query.strip():
        own = vectors.join(equals(objects, type=kind, project=project).select("id"), "id", "left_semi") if prefilter else vectors
        sem = semantic_search(own, query_vector, n)
    else:
        sem = kw.select("id", F.lit(0.0).alias("sem"), F.lit(0).alias("sem_rank")).limit(0)
    merged = graph.cut(kw.join(sem, "id", "full_outer"))  # a few rows, used three times
    found = F.broadcast(merged).join(equals(objects, type=kind, project=project).drop("content"), "id")
    if entity:
        known = entities.where(F.lower("name") == entity.lower()).select(F.col("id").alias("entity_id"))
        if strict_entity or not known.isEmpty():
            found = found.join(mentions.join(known, "entity_id", "left_semi").select(F.col("obj_id").alias("id")), "id", "left_semi")
    # Both ends of every edge in one pass; only those of the few candidates are counted.
    ends = edges.where("rel_type <> 'mentions'").select(F.explode(F.array("src", "dst")).alias("id")).join(F.broadcast(merged.select("id")), "id").groupBy("id").agg(F.count("*").alias("degree"))
    found = found.join(ends, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    signals = {"keyword": zero(F.col("kw")), "semantic": zero(F.col("sem")), "graph": S.graph_score(F.col("degree")), "recency": S.recency(F.col("created_at"), as_of)}
    scored = found.select("id", "title", "type", "project", "tags", "tier", "summary", "created_at", S.combined(signals, weights).alias("score"), *(F.round(c, 4).alias(k) for k, c in signals.items()), F.coalesce("kw_rank", F.col("sem_rank") + n).alias("origin"))
    if min_relevance > 0:
        scored = scored.where(F.col("score") >= min_relevance)
    return scored.orderBy(F.desc("score"), "origin", "id").limit(limit).drop("origin")


def log_row(spark, query: str, result_ids: list[str], at: Column, tool: str = "hybrid_search", **params) -> DataFrame:
    """One row for the query log."""
    ids = F.array(*map(F.lit, result_ids)) if result_ids else F.array().cast("array<string>")
    values = F.create_map(*[F.lit(str(x)) for kv in ({"query": query} | params).items() for x in kv])
    return spark.range(1).select(at.alias("timestamp"), F.lit(tool).alias("tool"), F.to_json(values).alias("params"), F.to_json(ids).alias("result_ids"))
