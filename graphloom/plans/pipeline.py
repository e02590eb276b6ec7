"""Capture pipeline: normalise, link, enrich, reason; each a table-to-table step over a whole batch."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scoring as S
from graphloom.functions import text as X
from graphloom.operators import detect, graph, store
from graphloom.session import stored


def normalize(objects: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Take over classifications (id, type, summary, tags, project, confidence): an object with a summary keeps its own; the type
    changes only on confidence; tags and project only fill what is empty.  Without one: idea-like fallback, summary from the title."""
    if found is None:
        found = objects.select("id", "type", F.col("title").alias("summary"), F.lit("").alias("tags"), F.lit("").alias("project"), F.lit(0.0).alias("confidence"))
    kind, confidence = S.classified(F.col("type"), F.col("confidence"))
    new = found.select("id", kind.alias("n_type"), F.col("summary").alias("n_summary"), F.col("tags").alias("n_tags"), F.col("project").alias("n_project"), confidence.alias("n_confidence"))
    best = F.max(F.struct("n_confidence", *[c for c in new.columns if c not in ("id", "n_confidence")])).alias("n")  # of several for one object the surest
    new = new.groupBy("id").agg(best).select("id", "n.*")
    j = objects.join(new, "id", "left")
    take = (F.col("summary") == "") & F.col("n_type").isNotNull()
    fill = lambda c: F.when(take & (F.col(c) == ""), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    made = {
        "type": F.when(take & (F.col("n_confidence") > 0), F.col("n_type")).otherwise(F.col("type")), "summary": F.when(take, F.col("n_summary")).otherwise(F.col("summary")),
        "confidence": F.when(take, F.col("n_confidence")).otherwise(F.col("confidence")), "pipeline_stage": F.lit("normalized"),
    }
    return j.select(*(fill(c) if c in ("tags", "project") else made[c].alias(c) if c in made else F.col(c) for c in objects.columns))


def enrich(objects: DataFrame, edges: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Objects with tier, degree and staleness; `every` holds what they may depend on, if that is more than the objects."""
    out = objects.withColumn("tier", S.tier(F.col("tier"), F.col("summary"), F.col("confidence"))).withColumn("pipeline_stage", F.lit("enriched"))
    out = out.join(store.degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.join(detect.staleness(objects if every is None else every, edges), "id", "left")


def capture(rows: DataFrame, template: str, fields: dict[str, Column], at: Column) -> DataFrame:
    """Objects from captures (id, title, ...): the template gives properties; own content, where there is one, stands above the template's."""
    content, properties = X.render_template(template, fields)
    own = F.coalesce("content", F.lit("")) if "content" in rows.columns else F.lit("")
    return rows.select("id", F.lit(template).alias("type"), "title", F.when(own != "", own).otherwise(content).alias("content"), properties.alias("properties"), at.alias("created_at"))


def run(stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], objects: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Stages in order; one that fails leaves its input as it was.  Returns the result and each stage's status."""
    status = {}
    for name, stage in stages:
        try:
            new = stage(objects)
            new.schema  # noqa: B018  analysis errors show here, run-time errors when the result is written
            objects, status[name] = new, "ok"
        except Exception as e:
            status[name] = f"failed: {str(e)[:200]}"
    status["pipeline"] = "partial" if any(s.startswith("failed") for s in status.values()) else "complete"
    return objects, status


#: Parts that a failed set of rows is tried again in, and rows of a stage that may fail alone before the stage counts as failed.
PARTS, MOST_BAD = 4, 100
#: Column of a stage's result that holds the error of a row that it could not work, null for all others.
ERROR = "stage_error"


def guarded(work: Callable, returns: str = "string") -> Callable[..., Column]:
    """work over columns, row by row in the tasks: a struct of `value` and of `error`, what work raised for the row.  A stage that puts `error` into the column ERROR isolates rows in its one pass."""

    def one(*values):
        try:
            return work(*values), None
        except Exception as e:
            return None, (str(e).strip() or type(e).__name__)[:300]

    return F.udf(one, f"value {returns}, error string")


def isolated(stage: Callable[[DataFrame, DataFrame], DataFrame], objects: DataFrame, most_bad: int = MOST_BAD) -> tuple[DataFrame, DataFrame | None, int]:
    """(the stage's result for all rows that it can work, (id, error) of those that fail at run time - None where there are none -, their number).

    stage: (rows, all objects) to rows, each worked for itself.  Rows whose errors the stage tells in ERROR are taken out of its result, in no more jobs
    for many of them than for one.  An error that it does not catch fails the job; then the rows are dealt out by a hash of
    their id into PARTS sets, and each is tried again, down to the ids that fail alone: about PARTS log n small jobs for each of them
    and none where all is well.  More than most_bad such ids, or a part of a first split that fails like all others, mean that the stage itself is broken: it raises.
    """
    every = stored(objects, "stage-input")
    done: list[DataFrame] = []
    bad: list[tuple[str, str]] = []

    def attempt(rows: DataFrame, level: int) -> str | None:
        try:
            done.append(stored(stage(rows, every), "stage-output"))
            return None
        except Exception as e:
            error = str(e).strip().splitlines()[0][:300] if str(e).strip() else type(e).__name__
        ids = [r.id for r in rows.select("id").distinct().limit(2).collect()]
        if len(ids) < 2:
            bad.extend((i, error) for i in ids)
            if len(bad) > most_bad:
                raise RuntimeError(f"more than {most_bad} rows fail, the first: {bad[0][1]}")
            return error
        part = F.pmod(F.xxhash64(F.lit(level), "id"), F.lit(PARTS))
        before = len(done)
        for k in range(PARTS):
            own = rows.where(part == k)
            if not own.isEmpty():
                attempt(own, level + 1)
        if level == 0 and len(done) == before:
            raise RuntimeError(error)
        return error

    attempt(every, 0)
    spark = objects.sparkSession
    alone = spark.createDataFrame(bad, "id string, error string") if bad else None
    result = functools.reduce(DataFrame.unionByName, done) if done else stage(every.limit(0), every)
    n = len(bad)
    if ERROR in result.columns:
        told = result.where(F.col(ERROR).isNotNull()).groupBy("id").agg(F.min(ERROR).alias("error"))
        n_told = told.count()
        if n + n_told > most_bad:
            raise RuntimeError(f"more than {most_bad} rows fail, one: {told.first().error}")
        if n_told:
            told = stored(told, "told")
            result = result.join(told.select("id"), "id", "left_anti").select(*result.columns)  # all rows of an id that fails
            if n_told > 1 and result.isEmpty():
                raise RuntimeError(told.first().error)
            alone = told if alone is None else alone.unionByName(told)
        result, n = result.drop(ERROR), n + n_told
    return result, alone, n


def run_isolated(stages: list[tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]], objects: DataFrame, most_bad: int = MOST_BAD) -> tuple[DataFrame, dict[str, str], DataFrame]:
    """Stages in order over all rows: (objects, status of each stage, quarantine of (id, stage, error)).

    A row that a stage cannot work is left as it was before it, takes no part in later stages and is quarantined; a stage that fails altogether
    leaves all rows as they were.
    """
    status: dict[str, str] = {}
    held = objects.sparkSession.createDataFrame([], "id string, stage string, error string")
    aside: list[DataFrame] = []
    for name, stage in stages:
        try:
            new, bad, n = isolated(stage, objects, most_bad)
        except Exception as e:
            status[name] = f"failed: {str(e)[:200]}"
            continue
        if bad is not None:
            aside.append(stored(objects.join(bad.select("id"), "id", "left_semi").select(*objects.columns), "quarantined"))
            held = held.unionByName(bad.select("id", F.lit(name).alias("stage"), "error"))
        objects, status[name] = new, f"partial: {n} quarantined" if n else "ok"
    status["pipeline"] = "complete" if all(s == "ok" for s in status.values()) else "partial"
    for rows in aside:
        objects = objects.unionByName(rows, allowMissingColumns=True)
    return objects, status, held


def reason(edges: DataFrame, **options) -> DataFrame:
    """edges plus all that the rules infer."""
    made, _ = graph.infer(edges, **options)
    return edges.unionByName(made.select("src", "rel_type", "dst", F.lit(1.0).alias("confidence"), "inferred_by"))
