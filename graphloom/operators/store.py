"""Scans, filters and mutations over the object, edge and log tables.  Mutations return the new table; writing it is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import EDITABLE, MAX_CONTENT_BYTES, REL_TYPES, known_type


def equals(rows: DataFrame, **filters: str) -> DataFrame:
    """Conjunction of equality filters; an empty value is no filter."""
    for c, v in filters.items():
        if v:
            rows = rows.where(F.col(c) == v)
    return rows


def get(objects: DataFrame, obj_id: str) -> DataFrame:
    return objects.where(F.col("id") == obj_id)


def list_objects(objects: DataFrame, kind: str = "", project: str = "", limit: int | None = 100, offset: int = 0, stage: str = "", newest: bool = True) -> DataFrame:
    out = equals(objects, type=known_type(kind), project=project, pipeline_stage=stage)
    out = out.orderBy(F.desc("created_at") if newest else F.asc("created_at"), "id").offset(max(offset, 0))
    return out if limit is None else out.limit(limit)


def newest(rows: DataFrame, n: int | None, at: str = "created_at") -> DataFrame:
    """The n newest rows, all for None."""
    return rows if n is None else rows.orderBy(F.desc(at), "id").limit(n)


def triples(objects: DataFrame, columns: tuple[str, ...] = ("type", "title", "project", "tags", "tier")) -> DataFrame:
    """(s, p, o) of non-empty properties."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o")) for c in columns])).alias("x")
    return objects.select(F.col("id").alias("s"), pairs).select("s", "x.p", "x.o").where("o <> ''")


def read_subject(triple: DataFrame) -> DataFrame:
    """One map of properties per subject, each with its values in order: a predicate may have several."""
    values = triple.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("o"))
    return values.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o")))).alias("properties"))


def pattern(edges: DataFrame, src: str | None = None, rel: str | None = None, dst: str | None = None) -> DataFrame:
    """Triple pattern; None is a variable."""
    return equals(edges, src=src or "", rel_type=rel or "", dst=dst or "")


def resolve_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    """At most 11 ids that start with prefix (wildcards are ordinary letters), an equal one alone."""
    hits = objects.select("id").where(F.col("id").startswith(prefix)).orderBy("id").limit(11)
    exact = objects.select("id").where(F.col("id") == prefix)
    return exact.union(hits.join(exact.limit(1).select(F.lit(1).alias("__found")), how="left").where("__found IS NULL").select("id"))


def since(rows: DataFrame, as_of: Column, days: int, at: str = "created_at") -> DataFrame:
    return rows.where(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str = "updated_at") -> DataFrame:
    """Last write wins; of equal times the new table's."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = both.groupBy(key).agg(F.max_by(F.struct(*old.columns), F.struct(order, "__new")).alias("__row"))
    return last.select("__row.*")


def insert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows whose key is not there yet, the first of each key."""
    first = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("__row")).select(key, "__row.*").select(*new.columns)
    return old.unionByName(first.join(old.select(key), key, "left_anti"))


def rejected(new: DataFrame) -> DataFrame:
    """Rows that may not be stored, with the reason."""
    reason = F.when(F.octet_length("content") > MAX_CONTENT_BYTES, "content too large").when(F.coalesce("title", F.lit("")) == "", "no title")
    return new.withColumn("reason", reason).where("reason IS NOT NULL")


def update(objects: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Partial update: non-empty values of editable columns replace old ones and bump updated_at.

    With a column `seq` the last non-empty value of each column by it counts, else, as nothing tells an order, the greatest; an id that
    is not there changes nothing.  `temporal.fold` keeps a version of every change besides.
    """
    ordered = "seq" in changes.columns
    cols = [c for c in changes.columns if c not in ("id", "seq")]
    if bad := [c for c in cols if c not in EDITABLE]:
        raise ValueError(f"not editable: {', '.join(bad)}")
    filled = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    given = [(F.max_by(filled(c), F.when(filled(c).isNotNull(), F.col("seq"))) if ordered else F.max(filled(c))).alias(f"__{c}") for c in cols]
    new = changes.groupBy("id").agg(F.lit(True).alias("__hit"), *given)
    joined = objects.join(new, "id", "left")
    value = lambda c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in cols else F.coalesce(F.when(F.col("__hit"), at), F.col(c)) if c == "updated_at" else F.col(c)
    return joined.select(*(value(c).alias(c) for c in objects.columns))


def delete(objects: DataFrame, edges: DataFrame, mentions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects, edges and mentions without the objects of `gone` (id)."""
    ids = gone.select("id").distinct()
    left = edges.join(ids, edges.src == ids.id, "left_anti").join(ids, F.col("dst") == ids.id, "left_anti")
    return objects.join(ids, "id", "left_anti"), left, mentions.join(ids, mentions.obj_id == ids.id, "left_anti")


def link(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges plus new ones: no loops, known types, and an edge that is there keeps its provenance."""
    kept = new.where((F.col("src") != F.col("dst")) & F.col("rel_type").isin(*REL_TYPES))
    kept = kept.groupBy("src", "rel_type", "dst").agg(F.min(F.struct("confidence", "inferred_by")).alias("p")).select("src", "rel_type", "dst", "p.*")
    return edges.unionByName(kept.join(edges, ["src", "rel_type", "dst"], "left_anti"))


def unlink(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "rel_type", "dst"), ["src", "rel_type", "dst"], "left_anti")


def valid_edges(found: DataFrame, objects: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """Proposed edges that hold: known type, two different existing ends, confident enough."""
    ids = objects.select("id")
    out = found.where(F.col("rel_type").isin(*REL_TYPES) & (F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")) & (F.col("confidence") > least_confidence))
    return out.join(ids, out.src == ids.id, "left_semi").join(ids, F.col("dst") == ids.id, "left_semi")


def new_entities(entities: DataFrame, found: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """found (seq, name, type): the first of each name in any case that is not there yet; an unknown type becomes concept."""
    first = found.groupBy(F.lower("name").alias("__key")).agg(F.min_by(F.struct(*found.columns), "seq").alias("__row")).select("__row.*")
    first = first.withColumn("type", F.when(F.col("type").isin(*known), F.col("type")).otherwise("concept"))
    have = entities.select(F.lower("name").alias("__name")).distinct()
    return first.join(have, F.lower("name") == F.col("__name"), "left_anti")


def resolve_entity(entities: DataFrame, names: DataFrame) -> DataFrame:
    """names (name) to (name, entity_id) regardless of case; of several the smallest id."""
    ids = entities.groupBy(F.lower("name").alias("__name")).agg(F.min("id").alias("entity_id"))
    return names.join(ids, F.lower("name") == F.col("__name"), "left").drop("__name")


def unseen(incoming: DataFrame, hashes: DataFrame, others: DataFrame, other: str) -> DataFrame:
    """Import dedup: rows (seq, hash, other) whose hash or `other` was not seen before, the first of each hash within the batch."""
    first = incoming.groupBy("hash").agg(F.min_by(F.struct(*incoming.columns), "seq").alias("__row")).select("__row.*")
    return first.join(hashes.select("hash"), "hash", "left_anti").join(others.select(other), other, "left_anti")


def adjacency(edges: DataFrame, mentions: bool = False) -> DataFrame:
    """(id, direction, rel_type, other) both ways, without mentions."""
    e = edges if mentions else edges.where("rel_type <> 'mentions'")
    out = e.select(F.col("src").alias("id"), F.lit("outgoing").alias("direction"), "rel_type", F.col("dst").alias("other"))
    return out.unionByName(e.select(F.col("dst").alias("id"), F.lit("incoming").alias("direction"), "rel_type", F.col("src").alias("other")))


def degree(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("id").agg(F.count("*").alias("degree"))


def with_relationships(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects with their relationships as a sorted array."""
    rel = adjacency(edges).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("direction", "rel_type", "other"))).alias("relationships"))
    return objects.join(rel, "id", "left")


def with_entities(objects: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    named = mentions.join(entities.withColumnRenamed("id", "entity_id"), "entity_id").groupBy(F.col("obj_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("entities"))
    return objects.join(named, "id", "left")


def canonical_pairs(edges: DataFrame, rel: str) -> DataFrame:
    """Each pair of a symmetric relationship once."""
    return edges.where(F.col("rel_type") == rel).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def page_graph(nodes: DataFrame, edges: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends among nodes, each once, and mentions of nodes."""
    ids = nodes.select("id")
    inner = edges.join(ids, edges.src == ids.id, "left_semi").join(ids, F.col("dst") == ids.id, "left_semi").select("src", "rel_type", "dst").distinct()
    return inner, mentions.join(ids, mentions.obj_id == ids.id, "left_semi").distinct()


def status(objects: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of counts."""
    one = objects.agg(F.count("*").alias("objects"), F.count_distinct("type").alias("types"))
    return one.crossJoin(edges.agg(F.count("*").alias("relationships"))).crossJoin(entities.agg(F.count("*").alias("entities")))


def index_differences(postings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows that a stored index and one made anew do not share; none when the index is whole."""
    return postings.exceptAll(fresh).withColumn("side", F.lit("stored")).unionByName(fresh.exceptAll(postings).withColumn("side", F.lit("fresh")))
