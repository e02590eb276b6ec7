"""Detectors: contradictions, repeated problems, gaps and staleness, as joins and grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.store import newest, since


def contradictions(objects: DataFrame, edges: DataFrame, max_objects: int | None = None) -> DataFrame:
    """(id, n_dependents, dependents): superseded objects that others still depend on."""
    ids = newest(objects, max_objects).select("id")
    superseded = edges.where("rel_type = 'supersedes'").select(F.col("dst").alias("id")).distinct()
    deps = edges.where("rel_type = 'dependsOn'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_dependents"), F.array_sort(F.collect_list("src")).alias("dependents"))
    return deps.join(superseded, "id", "left_semi").join(ids, "id", "left_semi")


def patterns(fixes: DataFrame, mentions: DataFrame, as_of: Column, window_days: int = 14, threshold: int = 3) -> DataFrame:
    """(entity_id, n, ids): entities that `threshold` fixes or more of the window mention."""
    recent = since(fixes, as_of, window_days).where("type = 'fix'")
    hits = mentions.distinct().join(recent.select(F.col("id").alias("obj_id")), "obj_id")
    return hits.groupBy("entity_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("obj_id")).alias("ids")).where(F.col("n") >= threshold)


def gaps(rows: DataFrame, group: str, has: str, lacks: str) -> DataFrame:
    """(group, n): groups with an object of type `has` and none of type `lacks`."""
    out = rows.where(F.col(group) != "").groupBy(group).agg(F.count_if(F.col("type") == has).alias("n"), F.bool_or(F.col("type") == lacks).alias("covered"))
    return out.where((F.col("n") > 0) & ~F.col("covered")).select(group, "n")


def stale_dependencies(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, title): dependencies on superseded objects, one hop, with what they depend on."""
    superseded = edges.where("rel_type = 'supersedes'").select("dst").distinct()
    deps = edges.where("rel_type = 'dependsOn'").select("src", "dst").join(superseded, "dst", "left_semi")
    return deps.join(objects.select(F.col("id").alias("dst"), "title"), "dst", "left").select("src", "dst", "title")


def archived_dependencies(objects: DataFrame, edges: DataFrame, max_objects: int | None = None) -> DataFrame:
    """(id, title, target, target_title): dependencies of objects on archived ones."""
    own = newest(objects, max_objects).select("id", "title")
    target = objects.where("tier = 'archive'").select(F.col("id").alias("dst"), F.col("title").alias("target_title"))
    e = edges.where("rel_type = 'dependsOn'").select("src", "dst")
    return own.join(e, own.id == e.src).join(target, "dst").select("id", "title", F.col("dst").alias("target"), "target_title")


def staleness(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, staleness): half a point for each dependency on a superseded object, at most one."""
    bad = objects.where("pipeline_stage = 'superseded'").select(F.col("id").alias("dst"))
    n = edges.where("rel_type = 'dependsOn'").join(bad, "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return objects.select("id").join(n, "id", "left").select("id", F.least(F.lit(1.0), 0.5 * F.coalesce("n", F.lit(0))).alias("staleness"))


def run_all(objects: DataFrame, edges: DataFrame, mentions: DataFrame, as_of: Column, **options) -> DataFrame:
    """(category, subject, message) of every detector."""
    short = lambda c: F.substring(c, 1, 8)
    found = contradictions(objects, edges).select(F.lit("contradiction").alias("category"), F.col("id").alias("subject"), F.format_string("%s is superseded but %d objects depend on it", short(F.col("id")), "n_dependents").alias("message"))
    p = patterns(objects, mentions, as_of, **options).select(F.lit("pattern").alias("category"), F.col("entity_id").alias("subject"), F.format_string("%d recent fixes mention %s", "n", "entity_id").alias("message"))
    typed = objects.select("project", "type")
    d = gaps(typed, "project", "session", "decision").select(F.lit("missing_decisions").alias("category"), F.col("project").alias("subject"), F.format_string("%s has %d sessions and no decision", "project", "n").alias("message"))
    named = mentions.join(objects.select(F.col("id").alias("obj_id"), "type"), "obj_id").select("entity_id", "type")
    g = gaps(named, "entity_id", "fix", "lesson").select(F.lit("missing_lessons").alias("category"), F.col("entity_id").alias("subject"), F.format_string("%s has %d fixes and no lesson", "entity_id", "n").alias("message"))
    s = stale_dependencies(objects, edges).select(F.lit("staleness").alias("category"), F.col("src").alias("subject"), F.format_string("%s depends on superseded %s", short(F.col("src")), short(F.col("dst"))).alias("message"))
    return found.unionByName(p).unionByName(d).unionByName(g).unionByName(s)
