"""Running values over rows in order, by ranges: neither a busy key nor one second that holds all rows is one task's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.graph import cut


def _same(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before it; null equals null."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] == codes[:-1]


def carry(rows: DataFrame, keys: list[str], order: list, values: list[str], exclusive: bool = False) -> DataFrame:
    """rows with `carried`, a struct of the last non-null of each of `values` at or before the row, and `nth`, its number from 1 up, among the rows of its keys in `order`.

    exclusive: of rows before the row only.  order: names or sort columns that leave no ties, or ties that do not matter.  The rows
    are dealt out by sampled ranges of (keys, order) and walked once where they lie.  What a key brings from the partitions before is one row a
    partition, joined to the rows of the partition's first key; those rows are marked while they are walked.
    """
    spark = rows.sparkSession
    by = [*map(F.col, keys), *order]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    value_type = T.StructType([rows.schema[v] for v in values])
    row_type = rows.schema
    out = T.StructType([T.StructField("row", row_type), T.StructField("carried", value_type), T.StructField("nth", T.LongType()), T.StructField("open", T.BooleanType()), T.StructField("last", T.BooleanType()), T.StructField("single", T.BooleanType())])
    packed = ordered.select(F.struct(*rows.columns).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the row before, with what it carries on
        count, first_key = 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            row = batch.column("row")
            before = 0 if held is None else 1
            whole = row if held is None else pa.concat_arrays([held["row"], row])
            same = np.ones(n + before, bool)
            same[0] = before == 1
            if len(whole) > 1:
                same[1:] = np.logical_and.reduce([_same(whole.field(k)) for k in keys]) if keys else True
            at = np.arange(n + before)
            begins = np.where(same, 0, at)
            start = np.maximum.accumulate(begins)  # where the key of each row begins; 0 also for the held one's key
            nth = at - start + 1 + np.where(start == 0, count - 1 if before else 0, 0)
            fields = []
            for v in values:
                own = whole.field(v)
                if before:  # the held row's place takes what it carries
                    own = pa.concat_arrays([held["carried"].field(v), row.field(v)])
                found = np.maximum.accumulate(np.where(np.asarray(own.is_valid()), at, -1))
                if exclusive:
                    found = np.concatenate([[0 if before else -1], found[:-1]])
                inside = found >= start
                fields.append(own.take(pa.array(np.where(inside, found, 0), mask=~inside)))
            carried = pa.StructArray.from_arrays(fields, [f.name for f in value_type.fields])
            opened = (start == 0) & first_key
            tail = slice(before, None)
            yield pa.RecordBatch.from_arrays(
                [row, carried.slice(before), pa.array(nth[tail].astype(np.int64)), pa.array(opened[tail]), pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, bool))], ["row", "carried", "nth", "open", "last", "single"]
            )
            first_key = first_key and bool(start[-1] == 0)
            count = int(nth[-1])
            kept = []
            for v, f in zip(values, fields, strict=True):  # what goes on to the next row: its own value too
                mine = row.field(v).slice(n - 1)
                kept.append(mine if mine[0].is_valid else f.slice(len(f) - 1))
            held = {"row": row.slice(n - 1), "carried": pa.StructArray.from_arrays(kept, [f.name for f in value_type.fields])}
        if held is not None:
            ends = [held["row"], held["carried"], pa.array([count], pa.int64()), pa.array([False]), pa.array([True]), pa.array([first_key])]
            yield pa.RecordBatch.from_arrays(ends, ["row", "carried", "nth", "open", "last", "single"])

    walked = cut(packed.mapInArrow(run, out).withColumn("part", F.spark_partition_id()))
    # One row a partition: its last key with what it carries on and its number of rows, and whether the whole partition is that key.
    ends = walked.where("last").select("part", *(F.col(f"row.{k}").alias(f"k{i}") for i, k in enumerate(keys)), F.col("carried").alias("c"), "nth", "single").collect()
    coming: list[tuple] = []
    key, state, total = None, None, 0
    for r in sorted(ends, key=lambda r: r.part):
        if state is not None:
            coming.append((r.part, list(key), tuple(state), total))
        own = tuple(r[f"k{i}"] for i in range(len(keys)))
        on = r.single and state is not None and own == key
        state = [new if new is not None else (old if on else None) for new, old in zip(r.c, state or r.c, strict=True)]
        total = r.nth + (total if on else 0)
        key = own
    if not coming:
        return walked.where("NOT last").select("row.*", "carried", "nth")
    key_type = T.StructType([T.StructField(f"k{i}", rows.schema[k].dataType) for i, k in enumerate(keys)] or [T.StructField("none", T.BooleanType())])
    table = spark.createDataFrame([(p, tuple(k) or (None,), c, n) for p, k, c, n in coming], T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", key_type), T.StructField("brought", value_type), T.StructField("so_far", T.LongType())]))
    told = walked.where("NOT last").join(F.broadcast(table), "part", "left")
    meets = F.col("open") & F.col("so_far").isNotNull()
    for i, k in enumerate(keys):
        meets &= F.col(f"row.{k}").eqNullSafe(F.col(f"key.k{i}"))
    filled = F.struct(*(F.when(meets, F.coalesce(F.col(f"carried.{v}"), F.col(f"brought.{v}"))).otherwise(F.col(f"carried.{v}")).alias(v) for v in values))
    return told.select("row.*", filled.alias("carried"), (F.col("nth") + F.when(meets, F.col("so_far")).otherwise(0)).alias("nth"))
