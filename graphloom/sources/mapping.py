"""Model tables derived from the sample tables, in SQL that Spark and DuckDB both read.

`{ts:seconds}` stands for the engine's timestamp of epoch seconds.  Every table is lazy; only what a query uses is read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import OBJECT_TYPES

_TYPE = "CASE CAST(d.doc_id % 8 AS INT) " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(OBJECT_TYPES)) + " END"

#: Letters of a text that are its title.
TITLE = 60
#: name -> (tables it reads, SQL)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "objects": (
        ("documents", "labels"),
        f"""SELECT CAST(d.doc_id AS STRING) AS id, {_TYPE} AS type, substring(d.text, 1, 60) AS title, d.text AS content,
  CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE substring(d.text, 1, 20) END AS summary, CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE d.source END AS project,
  d.lang || ', ' || d.source AS tags, CASE CAST(d.doc_id % 3 AS INT) WHEN 0 THEN 'archive' WHEN 1 THEN 'recall' ELSE 'reflex' END AS tier,
  coalesce(CAST(l.quality AS DOUBLE), CAST(0.5 AS DOUBLE)) AS confidence, CASE WHEN d.doc_id % 6 = 0 THEN 'import-v1' ELSE 'user' END AS captured_by,
  CASE WHEN d.doc_id % 7 = 0 THEN 'superseded' WHEN d.doc_id % 4 = 0 THEN 'ingest' WHEN d.doc_id % 4 = 1 THEN 'normalized' ELSE 'enriched' END AS pipeline_stage,
  {{ts:1704067200 + d.doc_id * 2580}} AS created_at, {{ts:1704067200 + d.doc_id * 2580 + 60 * (d.doc_id % 50)}} AS updated_at
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "supersedes": (("documents",), "SELECT CAST(doc_id AS STRING) AS src, CAST(older AS STRING) AS dst FROM (SELECT doc_id, lag(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS older FROM documents) x WHERE older IS NOT NULL"),
    "edges": (
        ("documents", "labels", "conversations", "supersedes"),
        """SELECT src, 'supersedes' AS rel_type, dst, CAST(1.0 AS DOUBLE) AS confidence, '' AS inferred_by FROM supersedes
UNION ALL SELECT CAST(doc_id AS STRING), 'dependsOn', CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING), CAST(0.9 AS DOUBLE), 'user' FROM documents WHERE doc_id > 1
UNION ALL SELECT CAST(doc_id AS STRING), 'contradicts', CAST(other AS STRING), CAST(0.7 AS DOUBLE), 'llm' FROM (
  SELECT l.doc_id, l.quality, lag(l.doc_id) OVER (PARTITION BY d.source ORDER BY l.doc_id) AS other, lag(l.quality) OVER (PARTITION BY d.source ORDER BY l.doc_id) AS q FROM labels l JOIN documents d ON d.doc_id = l.doc_id) x WHERE q <> quality
UNION ALL SELECT CAST(doc_id AS STRING), 'ledTo', CAST(doc_id + 7 AS STRING), CAST(0.6 AS DOUBLE), 'llm' FROM documents WHERE doc_id % 10 = 3
UNION ALL SELECT CAST(doc_id AS STRING), 'supports', CAST(doc_id - 2 AS STRING), CAST(0.8 AS DOUBLE), 'user' FROM documents WHERE doc_id % 9 = 4
UNION ALL SELECT 'c' || CAST(conv_id * 100 + turn AS STRING), 'causedBy', 'c' || CAST(conv_id * 100 + turn - 1 AS STRING), CAST(1.0 AS DOUBLE), '' FROM conversations WHERE turn > 0""",
    ),
    "entities": (("documents",), "SELECT 'e:' || name AS id, name, type FROM (SELECT DISTINCT source AS name, 'technology' AS type FROM documents UNION SELECT DISTINCT lang, 'concept' FROM documents) x"),
    "mentions": (("documents",), "SELECT CAST(doc_id AS STRING) AS obj_id, 'e:' || source AS entity_id FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT CAST(doc_id AS STRING), 'e:' || lang FROM documents WHERE doc_id % 4 = 0"),
    "turns": (("conversations",), "SELECT 'c' || CAST(conv_id * 100 + turn AS STRING) AS id, 'session' AS type, role AS title, {ts:1704067200 + conv_id * 86400 + turn * 60} AS created_at FROM conversations"),
    "vectors": (("embeddings",), "SELECT CAST(vec_id AS STRING) AS id, embedding, 'model-' || CAST(label % 2 AS STRING) AS model FROM embeddings"),
    "fixes": (("events",), "SELECT CAST(event_id AS STRING) AS id, 'fix' AS type, CAST(user_id AS STRING) AS entity_id, CAST(ts AS TIMESTAMP) AS created_at FROM events WHERE event_type = 'error'"),
    "coverage": (("events",), "SELECT CAST(event_id AS STRING) AS id, CASE event_type WHEN 'error' THEN 'fix' WHEN 'purchase' THEN 'lesson' WHEN 'view' THEN 'decision' ELSE 'session' END AS type, CAST(user_id AS STRING) || '/' || substring(CAST(ts AS STRING), 1, 10) AS grp FROM events"),
    "access_log": (("events",), "SELECT CAST(user_id AS STRING) AS obj_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'view'"),
    "query_log": (("events",), "SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_type = 'click' THEN 'hybrid_search' ELSE 'list' END AS tool, props FROM events WHERE event_type IN ('click', 'signup')"),
    "reads": (("events",), "SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, CAST(floor(value) AS BIGINT) AS obj FROM events WHERE event_type = 'view'"),
    "requests": (("events",), "SELECT event_id, user_id AS client, CAST(ts AS TIMESTAMP) AS ts FROM events"),
    "changes": (("orders",), "SELECT CAST(o_custkey AS STRING) AS doc_id, o_orderkey AS seq, CAST(o_orderdate AS TIMESTAMP) AS updated_at, o_totalprice AS price, o_orderstatus AS status FROM orders"),
    "captures": (("documents",), "SELECT CAST(doc_id AS STRING) AS id, substring(text, 1, 40) AS symptom, CASE WHEN doc_id % 2 = 0 THEN substring(text, 41, 40) ELSE '' END AS root_cause, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS severity FROM documents"),
    "notes": (("documents",), "SELECT doc_id, source || '/' || lang || '/2024-01-15-' || CAST(doc_id % 40 AS STRING) || '.md' AS path, '---' || chr(10) || 'title: T' || CAST(doc_id % 50 AS STRING) || chr(10) || '---' || chr(10) || 'See [[T' || CAST(doc_id % 7 AS STRING) || ']] and [[2024-01-15 t' || CAST(doc_id % 50 AS STRING) || '!]] or [[T' || CAST(doc_id % 7 AS STRING) || ']]. ' || substring(text, 1, 50) AS raw, 'T' || CAST(doc_id % 50 AS STRING) AS title FROM documents"),
}


def _render(sql: str, stamp: str) -> str:
    return re.sub(r"\{ts:([^}]*)\}", lambda m: stamp.format(m[1]), sql)


def duckdb_sql(body: str) -> str:
    """`body` with the model tables it names as common table expressions."""
    need: list[str] = []

    def visit(name: str) -> None:
        for x in TABLES[name][0]:
            if x in TABLES:
                visit(x)
        if name not in need:
            need.append(name)

    for name in TABLES:
        if re.search(rf"\b{name}\b", body):
            visit(name)
    ctes = [f"{n} AS ({_render(TABLES[n][1], 'make_timestamp(({}) * 1000000)')})" for n in need]
    recursive = bool(re.match(r"\s*WITH RECURSIVE", body))
    body = re.sub(r"^\s*WITH( RECURSIVE)?\s", "", body) if (more := re.match(r"\s*WITH\b", body)) else body
    start = f"WITH {'RECURSIVE ' if recursive else ''}"
    return (start + ",\n".join(ctes) + (",\n" if more else "\n") if ctes else start if more else "") + body


class Sample:
    """The model tables over a folder of sample tables: `sample.objects`, `sample.edges` and so on, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str, letters: int | None = None):
        self.spark, self.sf_dir, self.letters = spark, sf_dir, letters

    def titled(self) -> Sample:
        """The same tables for what takes no more of a text than its title: texts end there before a join moves them."""
        return Sample(self.spark, self.sf_dir, TITLE)

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return rows.withColumn("text", F.substring("text", 1, self.letters)) if self.letters and name == "documents" else rows

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        uses, sql = TABLES[name]
        frames = {u: getattr(self, u) if u in TABLES else self.table(u) for u in uses}
        found = _render(sql, "timestamp_seconds({})")
        for u in uses:
            found = re.sub(rf"\b(FROM|JOIN) {u}\b", rf"\1 {{{u}}}", found)
        out = self.spark.sql(found, **{u: f for u, f in frames.items() if f"{{{u}}}" in found})
        setattr(self, name, out)
        return out
