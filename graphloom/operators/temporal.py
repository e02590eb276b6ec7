"""Versions and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.ranges import carry


def versions(changes: DataFrame, key: str = "doc_id", at: str = "updated_at", tie: str = "seq") -> DataFrame:
    """changes plus version_num and the half-open interval [valid_from, valid_to); the last one is open.  A key with very many changes is not one task's."""
    names = changes.columns
    numbered = carry(changes, [key], [F.col(at), F.col(tie)], [at]).select(*names, F.col("nth").cast("int").alias("version_num"))
    following = carry(numbered, [key], [F.col("version_num").desc()], [at], exclusive=True)
    return following.select(*names, "version_num", F.col(at).alias("valid_from"), F.col(f"carried.{at}").alias("valid_to"))


def fold(objects: DataFrame, log: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(objects as they are after the log, versions): changes (id, seq, at, op and some of `columns`) applied one after another by seq.

    op is `set` or `delete`.  In a set a null or empty value leaves the column as it is; what follows a deletion starts from nothing.  versions: every
    state that was replaced or deleted, with version_num and [valid_from, valid_to), from the object's updated_at or the change's time on.
    An object without changes has no versions.
    """
    given = [c for c in columns if c in log.columns]
    blank = lambda c: F.when(F.col(c).cast("string") == "", None).otherwise(F.col(c))
    touched = objects.join(log.select("id").distinct(), "id", "left_semi")
    first = touched.select("id", F.lit(None).cast("long").alias("seq"), F.col("updated_at").alias("at"), F.lit("set").alias("op"), *given, F.struct(*objects.columns).alias("base"))
    later = log.select("id", F.col("seq").cast("long").alias("seq"), F.col("at").cast(objects.schema["updated_at"].dataType).alias("at"), "op", *(blank(c).cast(objects.schema[c].dataType).alias(c) for c in given), F.lit(None).cast(first.schema["base"].dataType).alias("base"))
    # A deletion ends a life; values are carried within one life only.
    steps = first.unionByName(later).withColumn("died", F.when(F.col("op") == "delete", F.struct("seq")))
    order = [F.col("seq").asc_nulls_first()]
    lives = carry(steps, ["id"], order, ["died"], exclusive=True).select("id", "seq", "at", "op", *given, "base", "nth", F.col("carried.died.seq").alias("life"))
    state = carry(lives.withColumnRenamed("nth", "step"), ["id", "life"], order, [*given, "base"]).select("id", "seq", "at", "op", "step", "carried")
    ended = _next_at(state)
    alive = ended.where("op = 'set'")
    full = [F.col("id") if c == "id" else F.col("at").alias(c) if c == "updated_at" else F.col(f"now.{c}").alias(c) if c in given else F.col(f"now.base.{c}").alias(c) for c in objects.columns]
    current = alive.where("valid_to IS NULL").select(*full)
    old = alive.where("valid_to IS NOT NULL").select(*full, F.col("step").cast("int").alias("version_num"), F.col("at").alias("valid_from"), "valid_to")
    return objects.join(log.select("id").distinct(), "id", "left_anti").unionByName(current), old


def _next_at(state: DataFrame) -> DataFrame:
    """state with `now`, what it carried, and `valid_to`, the time of the next step of the id."""
    named = state.withColumnRenamed("carried", "now")
    return carry(named, ["id"], [F.col("step").desc()], ["at"], exclusive=True).withColumn("valid_to", F.col("carried.at")).drop("carried", "nth")


def state_at(version: DataFrame, current: DataFrame, when: Column, key: str = "doc_id") -> DataFrame:
    """The version of each key that holds at `when` (the newest of several); else the current row if it was there by then.

    version and current have the same columns besides version_num, valid_from, valid_to and created_at.
    """
    cols = [c for c in version.columns if c not in (key, "version_num", "valid_from", "valid_to")]
    hit = version.where((F.col("valid_from") <= when) & (when < F.col("valid_to")))
    best = hit.groupBy(key).agg(F.max(F.struct("version_num", *cols)).alias("v")).select(key, "v.version_num", *(F.col(f"v.{c}").alias(c) for c in cols))
    rest = current.where(F.col("created_at") <= when).join(best, key, "left_anti").select(key, F.lit(None).cast("int").alias("version_num"), *cols)
    return best.unionByName(rest)


def latest_before(events: DataFrame, log: DataFrame, key: str | None, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """events with `prev`, the last row of log (a struct) before or at the event, of the same key or, without one, of the whole log.

    No range join: both sides are dealt out by ranges of (key, time, tie) and walked once, and a partition's last row of the log is carried to
    those after it, so neither a busy key nor one second that holds all rows is one task's.  Of equal times the log's rows come first.
    """
    keys = ["__key"] if key else []
    packed = F.struct(*[c for c in log.columns if c != key])
    own = [F.col(key).alias("__key")] if key else []
    left = events.select(*own, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.col(tie).alias("__tie"), F.struct(*events.columns).alias("__event"), F.lit(None).cast(log.select(packed.alias("p")).schema["p"].dataType).alias("prev"))
    right = log.select(*own, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(left.schema["__event"].dataType).alias("__event"), packed.alias("prev"))
    told = carry(left.unionByName(right), keys, [F.col("__at"), F.col("__side"), F.col("__tie")], ["prev"])
    return told.where("__side = 1").select("__event.*", F.col("carried.prev").alias("prev"))


def rate_limit(requests: DataFrame, seconds: int = 60, most: int = 100) -> DataFrame:
    """requests (client, ts) with the number in the window up to each, and whether it is allowed."""
    w = Window.partitionBy("client").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    out = requests.withColumn("n", F.count("*").over(w))
    return out.withColumn("allowed", F.col("n") <= most)
