"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, exact cuts.

Every document gets a hash-random key.  Keys are uniform, so equal slices of their range are even: a source is dealt
into range buckets in key order, bucket totals are summed into offsets, and each bucket is sorted on its own.  The
offset plus the running sum inside the bucket is a document's exact place in its source's random order.  A source is
taken whole as often as its budget allows (epochs), and the rest of the budget cuts the random order at one place.

Defined results: a null text, and one without words, has size 0 and is never taken; a null source is a source of its
own, last in order; equal rows are counted once with a multiplicity and dealt out again at the end; a document's repeats never exceed `max_epochs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lookup_join, materialize, n_words, small_rows

#: Rows to a range bucket, at most about so many.
BUCKET_ROWS = 2_000


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, 0 first: code-point order, null last.  A range sort and per-partition counts; no task sees all sources."""
    rows = sources.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    return sources.sparkSession.createDataFrame(rows, sources.schema.add("rank", "long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, rows) with target: `share` of all sizes dealt by weight, each at most max_epochs of its size.

    The excess of a source that is full is dealt again by weight until none is above its limit.  The level only rises, so
    the loop ends, as a rule after a few aggregations over one row per source.
    """
    ranked = _ranked(sizes)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * max_epochs).cast("double")), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("limit") < F.lit(level) * F.col("weight")
        r = ranked.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("limit"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if r.n == full or not r.w:
            break
        full, level = r.n, (total * share - (r.held or 0.0)) / r.w
    return ranked.select("source", "source_size", "n", F.least("limit", F.lit(level) * F.col("weight")).alias("target"))


def _name(source: Column) -> Column:
    """A key for every source; null has its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _key(id_: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, **targets) -> DataFrame:
    """One row per document: id, source, name, size, source_size, target, key, epochs, extra (words beyond whole epochs)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    # Equal rows become one with a multiplicity, before anything is dealt out by key.
    rows = materialize(rows.groupBy("id", "source", "size").agg(F.count("*").alias("copies")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n"))
    known = materialize(source_targets(sizes, **targets), "mix-targets")
    known = known.withColumn("name", _name(F.col("source"))).drop("source")
    told = lookup_join(rows.withColumn("name", _name(F.col("source"))), known.withColumn("weigh", F.col("n")), "name", "weigh").withColumn("key", _key(F.col("id"), seed))
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    unit = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    told = told.withColumn("bucket", F.least(F.floor(unit * buckets), buckets - 1))
    run = Window.partitionBy("name", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = told.withColumn("inside", F.sum(F.col("size") * F.col("copies")).over(run) - F.col("size") * F.col("copies"))
    totals = told.groupBy("name", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("total"))
    # One row per bucket: BUCKET_ROWS times fewer than documents.
    before = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("name", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    if small_rows(offsets, BROADCAST_ROWS):
        offsets = F.broadcast(offsets)
    placed = placed.join(offsets, ["name", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    start = F.col("offset") + F.col("inside") + F.col("copy") * F.col("size")
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return each.select("id", "source", "name", "size", "source_size", "target", "key", epochs.cast("long").alias("epochs"), extra.cast("long").alias("extra"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **targets) -> DataFrame:
    """One row per document: id, size (words), source_size, target, taken (words, repeats counted).

    A source's taken words sum to its target, rounded down.  The order is by MD5 of seed and id, then size, so reruns agree.
    """
    placed = _placed(docs, id_col, text_col, source_col, seed, **targets)
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **targets) -> DataFrame:
    """docs with each row as often as the mix takes it whole, the partly taken document rounded to the nearer whole number.

    The cut of a source is one place in its order, so a document is told by its own key: texts are not shuffled, and one row
    per source goes to them.  Equal rows at the cut are taken alike.
    """
    order = F.struct("key", "id", "size")
    whole = (F.col("size") > 0) & (2 * F.col("extra") >= F.col("size"))
    cuts = _placed(docs, id_col, text_col, source_col, seed, **targets).groupBy("name").agg(F.max("epochs").alias("epochs"), F.max(F.when(whole, order)).alias("cut"), F.count("*").alias("weigh"))
    cuts = materialize(cuts, "mix-cuts")
    keyed = docs.withColumn("name__mix", _name(F.col(source_col))).withColumn("order__mix", F.struct(_key(F.col(id_col), seed).alias("key"), F.col(id_col).alias("id"), n_words(F.col(text_col)).alias("size")))
    told = lookup_join(keyed.withColumnRenamed("name__mix", "__name"), cuts.select(F.col("name").alias("__name"), F.col("epochs").alias("__epochs"), F.col("cut").alias("__cut"), "weigh"), "__name", "weigh")
    times = F.when(F.col("order__mix.size") > 0, F.col("__epochs") + F.coalesce(F.col("order__mix") <= F.col("__cut"), F.lit(False)).cast("long")).otherwise(0).cast("int")
    return told.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
