"""Presenters: tables shaped for reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import detect, graph
from graphloom.operators.store import adjacency, canonical_pairs, equals, since, with_entities, with_relationships


def summary(objects: DataFrame) -> DataFrame:
    return objects.select("id", "title", "type", "project", "created_at")


def briefing(rows: DataFrame) -> DataFrame:
    keep = [c for c in ("id", "title", "type", "tags", "project", "tier", "score") if c in rows.columns]
    return rows.select(*keep, F.coalesce(F.nullif("summary", F.lit("")), "title").alias("summary"))


def document(objects: DataFrame, edges: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    return with_entities(with_relationships(objects, edges), mentions, entities)


def dossier(topic: str, objects: DataFrame, edges: DataFrame, mentions: DataFrame, entities: DataFrame, limit: int = 20, listed: int = 10, index=None) -> dict[str, DataFrame]:
    """All about an entity, or where there is none about the best `limit` texts: objects (the `listed` newest), timeline, contradictions among them, entities."""
    known = entities.where(F.lower("name") == topic.lower()).select(F.col("id").alias("entity_id"))
    by_entity = objects.join(mentions.join(known, "entity_id", "left_semi"), objects.id == F.col("obj_id"), "left_semi")
    if known.isEmpty():
        scores = (X.bm25(objects, topic) if index is None else index.search(X.search_terms(topic, index.manifest["stemmed"]), limit)).orderBy(F.desc("raw"), "id").limit(limit)
        own = objects.join(scores.select("id"), "id", "left_semi")
    else:
        own = by_entity
    ids = own.select("id")
    pairs = canonical_pairs(edges, "contradicts").join(ids, F.col("a") == ids.id, "left_semi").join(ids, F.col("b") == ids.id, "left_semi")
    seen = mentions.join(ids, mentions.obj_id == ids.id, "left_semi").select("entity_id")
    timeline = own.select("id", "title", "type", "created_at").orderBy(F.desc("created_at"), "id")
    return {"objects": timeline.limit(listed), "timeline": timeline, "contradictions": pairs, "entities": entities.join(seen, entities.id == seen.entity_id, "left_semi")}


def narrative(sources: DataFrame, told: int = 20) -> DataFrame:
    """(narrative): one line for each of the `told` newest of a few sources, type and title; a line that says so where there are none."""
    lines = sources.orderBy(F.desc("created_at"), "id").limit(told).select(F.struct((-F.unix_micros("created_at")).alias("at"), "id", F.concat(F.lit("- ["), "type", F.lit("] "), "title").alias("line")).alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n")
    return lines.agg(F.when(F.count("*") > 0, text).otherwise("No knowledge in this period.").alias("narrative"))


def dossier_connections(listed: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, direction, rel_type, other, title): relationships of a dossier's first object - the newest of the listed ones - with the others of the dossier."""
    few = listed.select("id", "title", "created_at")  # as many as a dossier lists
    first = few.orderBy(F.desc("created_at"), "id").limit(1).select("id")
    own = adjacency(edges).join(F.broadcast(first), "id", "left_semi")
    return own.join(F.broadcast(few.select(F.col("id").alias("other"), "title")), "other").select("id", "direction", "rel_type", "other", "title")


def linked_files(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, rel_type, target): an exported note's links by the file names that the export gives, without folder and ending; targets that are not exported are left out."""
    paths = file_paths(objects)
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    out = edges.where("rel_type <> 'mentions'").join(paths.select(F.col("id").alias("src"), "path"), "src").join(paths.select(F.col("id").alias("dst"), name.alias("target")), "dst")
    return out.select("path", "rel_type", "target").distinct()


def synthesis(objects: DataFrame, as_of: Column, period_days: int = 7, project: str = "", listed: int = 30) -> dict[str, DataFrame]:
    """Themes of the period (count by type) and its newest sources."""
    recent = equals(since(objects, as_of, period_days), project=project)
    sources = recent.orderBy(F.desc("created_at"), "id").limit(listed)
    return {"narrative": narrative(sources), "themes": recent.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type"), "sources": sources}


def alerts(objects: DataFrame, edges: DataFrame, mentions: DataFrame, as_of: Column, window_days: int = 14, threshold: int = 3) -> DataFrame:
    """(kind, severity, subject, message)."""
    c = graph.contradiction_map(edges, objects).select(F.lit("contradiction").alias("kind"), F.lit("high").alias("severity"), F.col("a").alias("subject"), F.concat(F.coalesce("a_title", F.substring("a", 1, 8)), F.lit(" contradicts "), F.coalesce("b_title", F.substring("b", 1, 8))).alias("message"))
    p = detect.patterns(objects, mentions, as_of, window_days, threshold).select(F.lit("pattern").alias("kind"), F.lit("medium").alias("severity"), F.col("entity_id").alias("subject"), F.format_string("%d fixes in %d days", F.col("n"), F.lit(window_days)).alias("message"))
    s = detect.archived_dependencies(objects, edges).select(F.lit("staleness").alias("kind"), F.lit("low").alias("severity"), F.col("id").alias("subject"), F.concat(F.col("title"), F.lit(" depends on archived "), F.col("target_title")).alias("message"))
    return c.unionByName(p).unionByName(s)


def project_rollup(objects: DataFrame) -> DataFrame:
    return objects.where("project <> ''").groupBy("project").agg(F.count("*").alias("n_docs"), F.max("created_at").alias("last_activity")).orderBy(F.desc("n_docs"), "project")


def hubs(objects: DataFrame) -> DataFrame:
    """One text per project: its objects by type, each type's titles in order of id."""
    by_type = objects.where("project <> ''").groupBy("project", "type").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    block = F.concat(F.lit("## "), F.col("type"), F.lit("\n"), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("- [["), i, F.lit("]]"))), "\n"))
    blocks = by_type.select("project", F.struct("type", block.alias("block")).alias("b"))
    return blocks.groupBy("project").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"])).alias("hub"))


def markdown(objects: DataFrame, edges: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, markdown) with frontmatter, text, relationships and entities."""
    d = document(objects, edges, mentions, entities)
    lines = F.transform(F.coalesce("relationships", F.array().cast("array<struct<direction:string,rel_type:string,other:string>>")), lambda r: F.concat(F.lit("- "), r["direction"], F.lit(" "), r["rel_type"], F.lit(" [["), r["other"], F.lit("]]")))
    front = F.concat(F.lit("---\ntitle: "), "title", F.lit("\ntype: "), "type", F.lit("\n---\n"))
    related = F.when(F.size(lines) > 0, F.concat(F.lit("\n## Related\n"), F.array_join(lines, "\n")))
    tags = F.when(F.size("entities") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("entities", lambda e: F.concat(F.lit("#"), F.replace(e, F.lit(" "), F.lit("_")))), " ")))
    return d.select("id", F.concat_ws("\n", front, X.without_related(F.col("content")), related, tags).alias("markdown"))


def file_paths(objects: DataFrame) -> DataFrame:
    """(id, path): project folder and title, told apart regardless of case: the first id keeps its name, later ones take part of theirs."""
    from pyspark.sql import Window

    base = F.concat(F.when(F.col("project") == "", "unsorted").otherwise(X.safe_filename(F.col("project"))), F.lit("/"), X.safe_filename(F.col("title")))
    rows = objects.select("id", base.alias("base")).withColumn("n", F.row_number().over(Window.partitionBy(F.lower("base")).orderBy(F.length("id"), "id")))
    return rows.select("id", F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.substring("id", 1, 8), F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit(".md")).alias("path"))
