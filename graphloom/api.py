"""The tool functions of a knowledge base, over immutable tables: reads return DataFrames, writes return a new Engine."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import model
from graphloom.functions import scoring
from graphloom.functions.embed import Provider, embed, hashing_provider
from graphloom.operators import detect, graph, ingest, learn, present, store, temporal
from graphloom.plans import hybrid, pipeline
from graphloom.session import stored
from graphloom.sources.text_index import TextIndex

MOST = 1000


@dataclass(frozen=True)
class Engine:
    """Tables of one knowledge base.  `now` is the time of the call, never the clock's, so calls can be repeated."""

    objects: DataFrame
    edges: DataFrame
    entities: DataFrame
    mentions: DataFrame
    vectors: DataFrame | None = None
    query_log: DataFrame | None = None
    access_log: DataFrame | None = None
    history: DataFrame | None = None
    weights: dict[str, float] = field(default_factory=lambda: dict(model.WEIGHTS))
    provider: Provider = field(default_factory=hashing_provider)
    index: TextIndex | None = None
    quarantine: DataFrame | None = None

    # -- public

    def search(self, query: str, now: Column, kind: str = "", project: str = "", entity: str = "", limit: int = 20, min_relevance: float = 0.0, **options) -> DataFrame:
        """Hybrid search with the weights that the engine holds; `adapted` and `stored_weights` change them."""
        vector = [float(x) for x in self.provider([query])[0]] if self.vectors is not None else None
        return hybrid.search(self.objects, self.vectors, self.edges, query, now, vector, self.mentions, self.entities, model.known_type(kind), project, entity, limit, min_relevance, self.weights, index=self.index, **options)

    def context(self, topic: str, now: Column, limit: int = 10) -> DataFrame:
        return present.briefing(self.search(topic, now, limit=limit))

    def dossier(self, topic: str) -> dict[str, DataFrame]:
        return present.dossier(topic, self.objects, self.edges, self.mentions, self.entities, index=self.index)

    def read(self, prefix: str) -> DataFrame:
        """The document of an id or an unambiguous prefix; several rows where it is ambiguous."""
        ids = store.resolve_prefix(self.objects, prefix)
        return present.document(self.objects.join(ids, "id", "left_semi"), self.edges, self.mentions, self.entities)

    def open(self, prefix: str, now: Column) -> tuple[DataFrame, Engine]:
        """`read`, with what it leaves behind: an access of the document and, where the last logged call was a search that did not return it, a changed weight."""
        ids = self.objects.join(store.resolve_prefix(self.objects, prefix), "id", "left_semi").select("id")
        read = ids.select(F.col("id").alias("obj_id"), now.alias("ts"))
        after = replace(self, access_log=read if self.access_log is None else self.access_log.unionByName(read))
        return self.read(prefix), after.adapted(read)

    def adapted(self, reads: DataFrame) -> Engine:
        """Weights after the misses among reads (obj_id, ts): one of the 50 best by keyword boosts the keyword signal, else semantic gains.

        All misses are diagnosed in one pass; rows of one time go by id and, in the log, by a hash of what they hold, so reruns agree.
        """
        if self.query_log is None:
            return self
        log = self.query_log.select(F.col("timestamp").alias("ts"), F.xxhash64("tool", "params", "result_ids").alias("event_id"), "tool", "params", F.from_json("result_ids", "array<string>").alias("result_ids"))
        asked = reads.select(F.col("obj_id").alias("obj"), "ts", F.xxhash64("obj_id").alias("event_id"))
        missed = learn.misses(temporal.latest_before(asked, log, None)).select(F.col("obj").alias("id"), "ts", F.get_json_object("prev.params", "$.query").alias("query"))
        told = learn.diagnose_all(missed, self.index or TextIndex.of(self.objects))
        return replace(self, weights=learn.adapt_runs(dict(self.weights), learn.boost_runs(told, ["ts", "id"])))

    def stored_weights(self, text: str | None) -> Engine:
        """The engine with weights read back from the configuration's text; broken ones give the defaults."""
        return replace(self, weights=scoring.valid_weights(text))

    def capture(self, rows: DataFrame, template: str, fields: dict[str, Column], now: Column, found: DataFrame | None = None) -> Engine:
        """Store captures (id, title, ...) and run the whole pipeline over the new objects: normalise, link, enrich, reason.

        Captures that may not be stored, for want of a title or for size, are left out.
        """
        made = pipeline.capture(rows, template, fields, now)
        full = made.select("id", "type", "title", "content", *(F.lit("").alias(c) for c in ("summary", "project", "tags")), F.lit("archive").alias("tier"), F.lit(1.0).alias("confidence"), F.lit("user").alias("captured_by"), F.lit("ingest").alias("pipeline_stage"), "created_at", F.col("created_at").alias("updated_at"))
        fit = full.join(store.rejected(full).select("id"), "id", "left_anti").join(self.objects.select("id"), "id", "left_anti")
        new, _ = replace(self, objects=fit).pipeline(found)
        return replace(new, objects=store.insert(self.objects, new.objects), index=self.index and self.index.apply(new.objects))

    def link(self, new: DataFrame) -> Engine:
        return replace(self, edges=store.link(self.edges, new))

    def feedback(self, rows: DataFrame) -> Engine:
        """rows (obj_id, ts, relevant): what was relevant counts as an access."""
        hits = rows.where("relevant").select("obj_id", "ts")
        return replace(self, access_log=hits if self.access_log is None else self.access_log.unionByName(hits))

    def graph(self, obj_id: str, max_depth: int = 10) -> dict[str, DataFrame]:
        start = self.objects.where(F.col("id") == obj_id).select("id")
        return {"causal_chain": graph.causal_chain(self.edges, self.objects, start, max_depth), "evolution": graph.evolution(self.edges, self.objects, start), "contradictions": graph.contradiction_map(self.edges, self.objects, start)}

    def graph_entity(self, name: str, max_hops: int = 2) -> DataFrame:
        ids = self.entities.where(F.lower("name") == name.lower()).select(F.col("id").alias("entity_id"))
        return graph.neighbourhood(ids, self.mentions, self.edges, max_hops)

    def list(self, kind: str = "", project: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
        return present.summary(store.list_objects(self.objects, kind, project, limit, offset))

    def pipeline(self, found: DataFrame | None = None) -> tuple[Engine, dict[str, str]]:
        """Normalise, link by tags, enrich, infer.  A row that fails is left as it was and quarantined, a stage that fails leaves what was there."""
        stages = [("normalize", lambda o, _: pipeline.normalize(o, found)), ("enrich", lambda o, every: pipeline.enrich(o, self.edges, every).drop("degree", "staleness"))]
        objects, status, bad = pipeline.run_isolated(stages, self.objects)
        new = replace(self, objects=objects, quarantine=bad if self.quarantine is None else self.quarantine.unionByName(bad))
        for name, stage in (("link", new._linked), ("reason", new._reasoned)):
            try:
                new, status[name] = replace(new, **stage()), "ok"
            except Exception as e:
                status[name] = f"failed: {str(e)[:200]}"
        status["pipeline"] = "complete" if all(s == "ok" for k, s in status.items() if k != "pipeline") else "partial"
        return new, status

    def _linked(self) -> dict[str, DataFrame]:
        e, m = ingest.tag_entities(self.objects)
        return {"entities": stored(store.insert(self.entities, e), "entities"), "mentions": stored(self.mentions.unionByName(m).distinct(), "mentions")}

    def _reasoned(self) -> dict[str, DataFrame]:
        return {"edges": stored(pipeline.reason(self.edges), "edges")}

    def classify(self, rows: DataFrame, now: Column) -> Engine:
        """Given classifications replace non-empty fields, with confidence 0.9."""
        kind, _ = scoring.classified(F.col("type"), F.lit(0.9))
        return replace(self, objects=store.update(self.objects, rows.withColumn("type", kind).withColumn("confidence", F.lit(0.9)), now))._reindexed(rows)

    # -- administration

    def status(self) -> DataFrame:
        return store.status(self.objects, self.edges, self.entities)

    def synthesize(self, now: Column, period_days: int = 7, project: str = "") -> dict[str, DataFrame]:
        return present.synthesis(self.objects, now, period_days, project)

    def alerts(self, now: Column) -> DataFrame:
        return present.alerts(self.objects, self.edges, self.mentions, now)

    def delete(self, ids: DataFrame, now: Column | None = None) -> Engine:
        """Objects with their edges and mentions go; the rows as they were go to the history first."""
        return self.kept_versions(ids, F.current_timestamp() if now is None else now)._without(ids)

    def kept_versions(self, ids: DataFrame, now: Column) -> Engine:
        """The engine with the present rows of ids in its history, each with the next version number of its object."""
        old = self.objects.join(ids.select("id").distinct(), "id", "left_semi")
        seen = None if self.history is None else self.history.groupBy("id").agg(F.max("version_num").alias("__n"))
        numbered = old.withColumn("__n", F.lit(0)) if seen is None else old.join(seen, "id", "left")
        made = numbered.select(*old.columns, (F.coalesce("__n", F.lit(0)) + 1).alias("version_num"), now.alias("replaced_at"))
        return replace(self, history=made if self.history is None else self.history.unionByName(made))

    def _without(self, ids: DataFrame) -> Engine:
        o, e, m = store.delete(self.objects, self.edges, self.mentions, ids)
        return replace(self, objects=o, edges=e, mentions=m, vectors=self.vectors and self.vectors.join(ids.select("id"), "id", "left_anti"), index=self.index and self.index.apply(gone=ids))

    def delete_entity(self, ids: DataFrame) -> Engine:
        gone = ids.select("id")
        return replace(self, entities=self.entities.join(gone, "id", "left_anti"), mentions=self.mentions.join(gone, self.mentions.entity_id == gone.id, "left_anti"))

    def update(self, changes: DataFrame, now: Column) -> Engine:
        """Partial update; the rows as they were go to the history with a version number.

        With a column `seq` several changes of an object are applied one after another: each makes a version, and the last values stay.
        """
        if "seq" in changes.columns:
            log = changes.join(self.objects.select("id"), "id", "left_semi").withColumns({"at": now, "op": F.lit("set")})
            objects, old = temporal.fold(self.objects, log, model.EDITABLE)
            seen = None if self.history is None else self.history.groupBy("id").agg(F.max("version_num").alias("__n"))
            numbered = old.withColumn("__n", F.lit(0)) if seen is None else old.join(seen, "id", "left")
            made = numbered.select(*self.objects.columns, (F.coalesce("__n", F.lit(0)) + F.col("version_num")).alias("version_num"), F.col("valid_to").alias("replaced_at"))
            return replace(self, objects=objects, history=made if self.history is None else self.history.unionByName(made))._reindexed(changes)
        return replace(self.kept_versions(changes, now), objects=store.update(self.objects, changes, now))._reindexed(changes)

    def _reindexed(self, ids: DataFrame) -> Engine:
        """The engine with its index told of the present rows of ids."""
        if self.index is None:
            return self
        return replace(self, index=self.index.apply(self.objects.join(ids.select("id").distinct(), "id", "left_semi")))

    def with_index(self) -> Engine:
        """Keep a stored text index from now on; searches read it, and every change of objects is applied to it."""
        return replace(self, index=TextIndex.of(self.objects))

    def unlink(self, gone: DataFrame) -> Engine:
        return replace(self, edges=store.unlink(self.edges, gone))

    def export(self, obj_id: str = "") -> DataFrame:
        return present.markdown(store.equals(self.objects, id=obj_id), self.edges, self.mentions, self.entities)

    def debug_sessions(self, limit: int = 20) -> DataFrame:
        """The newest sessions, with what they led to."""
        own = store.newest(self.objects.where("type = 'session'"), max(0, min(limit, MOST)))
        return store.with_relationships(present.summary(own), self.edges)

    def debug_memory(self) -> DataFrame:
        """Rows of each table that the engine holds."""
        held = {"objects": self.objects, "edges": self.edges, "entities": self.entities, "mentions": self.mentions, "vectors": self.vectors, "query_log": self.query_log, "access_log": self.access_log, "history": self.history}
        counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in held.items() if t is not None]
        return functools.reduce(DataFrame.unionAll, counts)

    def reason(self, now: Column) -> DataFrame:
        return detect.run_all(self.objects, self.edges, self.mentions, now)

    def list_entities(self, kind: str = "") -> DataFrame:
        return store.equals(self.entities, type=model.known_type(kind, model.ENTITY_TYPES)).orderBy("name")

    def query_trail(self, limit: int = 100) -> DataFrame:
        return self.query_log.orderBy(F.desc("timestamp")).limit(max(0, min(limit, MOST)))

    def graph_data(self, kind: str = "", project: str = "", limit: int = MOST, offset: int = 0) -> dict[str, DataFrame]:
        nodes = store.list_objects(self.objects, kind, project, max(0, min(limit, MOST)), offset)
        edges, mentions = store.page_graph(nodes, self.edges, self.mentions)
        return {"nodes": nodes.select("id", F.substring("title", 1, 40).alias("label"), "type"), "edges": edges, "mentions": mentions}

    def safety_check(self, rows: DataFrame) -> DataFrame:
        return store.rejected(rows)

    def import_notes(self, notes: DataFrame, imported: DataFrame | None = None) -> DataFrame:
        """New notes (path, raw) as objects, by hash and path."""
        parsed = ingest.parse_notes(notes).withColumn("seq", F.monotonically_increasing_id())
        seen = parsed.select("hash", "path").limit(0) if imported is None else imported
        return store.unseen(parsed, seen, seen, "path").drop("seq")

    def log(self, query: str, result_ids: list[str], now: Column, **params) -> Engine:
        row = hybrid.log_row(self.objects.sparkSession, query, result_ids, now, **params)
        return replace(self, query_log=row if self.query_log is None else self.query_log.unionByName(row))

    def adjust_tiers(self, now: Column, inactivity_days: int = 30) -> DataFrame:
        return learn.adjust_tiers(self.objects, learn.access_stats(self.access_log), now, F.make_dt_interval(F.lit(inactivity_days)))

    def at(self, when: Column, versions: DataFrame, current: DataFrame) -> DataFrame:
        return temporal.state_at(versions, current, when)

    def with_vectors(self) -> Engine:
        """Embed all objects with the engine's provider."""
        return replace(self, vectors=self.objects.select("id", embed(F.col("title"), F.col("content"), self.provider).alias("embedding")))
