"""The data model: knowledge objects, typed edges, entities and mentions, with their enumerations and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that results depend on.
OBJECT_TYPES = ("decision", "lesson", "fix", "session", "research", "source", "synthesis", "idea")
REL_TYPES = ("causedBy", "contradicts", "supports", "supersedes", "dependsOn", "ledTo", "implements", "mentions")
ENTITY_TYPES = ("technology", "project", "pattern", "concept")
TIERS = ("archive", "recall", "reflex")
WEIGHTS = {"keyword": 0.4, "semantic": 0.3, "graph": 0.2, "recency": 0.1}
FIELD_WEIGHTS = {"title": 10.0, "content": 1.0, "tags": 5.0}
TECHNOLOGIES = (
    "python", "javascript", "typescript", "rust", "go", "java", "react", "fastapi", "django", "flask", "express", "node", "docker", "kubernetes", "postgresql", "mysql", "sqlite", "redis", "mongodb", "neo4j",
    "elasticsearch", "kafka", "git", "github", "linux", "graphql", "pytorch", "tensorflow", "anthropic", "openai", "langchain", "oxigraph", "sparql", "nginx", "aws", "gcp", "azure", "terraform",
)
ENTITY_STOPWORDS = (
    "fix", "bug", "error", "issue", "problem", "solution", "test", "code", "change", "update", "feature", "function", "file", "folder", "directory", "module", "class", "method", "server", "client",
    "request", "response", "command", "terminal", "console", "log", "output", "input", "data", "config", "setting", "option", "parameter", "user", "admin", "system", "app", "application", "task", "work",
    "item", "object", "thing", "api", "url", "endpoint", "route", "path", "build", "deploy", "run", "start", "stop", "version", "release", "branch", "commit", "merge",
)
V1_TYPES = {"capture": "idea", "note": "idea", "fix": "fix", "session": "session", "decision": "decision", "lesson": "lesson", "research": "research", "source": "source", "synthesis": "synthesis", "idea": "idea", "guide": "research", "workflow": "session"}
TEMPLATES = {
    "session": (("goal",), ("worked", "failed", "next_steps")),
    "fix": (("symptom",), ("root_cause", "resolution", "severity", "files_affected")),
    "decision": (("chosen",), ("rationale", "alternatives", "decision_status")),
    "lesson": (("cause",), ("impact", "prevention")),
    "research": (("question",), ("findings", "sources")),
    "idea": ((), ("feasibility", "idea_status", "dependencies")),
}
MAX_CONTENT_BYTES = 10 * 1024 * 1024

_s, _d, _t = T.StringType(), T.DoubleType(), T.TimestampType()
OBJECTS = T.StructType([T.StructField(c, _s) for c in ("id", "type", "title", "content", "summary", "project", "tags", "tier")] + [T.StructField("confidence", _d), T.StructField("captured_by", _s), T.StructField("pipeline_stage", _s), T.StructField("created_at", _t), T.StructField("updated_at", _t)])
EDGES = T.StructType([T.StructField(c, _s) for c in ("src", "rel_type", "dst")] + [T.StructField("confidence", _d), T.StructField("inferred_by", _s)])
ENTITIES = T.StructType([T.StructField(c, _s) for c in ("id", "name", "type")])
MENTIONS = T.StructType([T.StructField(c, _s) for c in ("obj_id", "entity_id")])
#: Algebra of the relationships, as the ontology states it.
SYMMETRIC, TRANSITIVE, INVERSE = ("contradicts",), ("supersedes",), (("causedBy", "ledTo"),)
EDITABLE = ("type", "title", "content", "summary", "project", "tags", "tier", "confidence", "captured_by", "pipeline_stage")


def known_type(kind: str, allowed: tuple[str, ...] = OBJECT_TYPES) -> str:
    """An empty string (no filter) or one of `allowed`; anything else raises."""
    if kind and kind not in allowed:
        raise ValueError(f"unknown type {kind!r}; known: {', '.join(allowed)}")
    return kind
