"""Sharding by Karmarkar-Karp differencing: near-equal bytes for groups that may not be split.

Rows of equal text are one group and stay together.  Groups are dealt into blocks of bounded size; each block is
differenced into a partial partition of m sums where it lies, and the partial partitions are differenced again, level
by level, at most FAN of them in one task, until one is left.  A group's shard is followed down the levels by joins.

Defined results: size is the UTF-8 bytes of the text plus ROW_BYTES, for a null text ROW_BYTES; null and empty
texts are one group; equal rows count once with a multiplicity and get slots of their own; extra columns are
not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kk
from .common import lookup_join, materialize, small_rows

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Groups to a block, about; partial partitions to a task of the next level, at most.
BLOCK_GROUPS, FAN = 20_000, 500
#: Rows to a slice of a shard within which slots are counted, about.
SLICE_ROWS = 50_000


def _blocks(groups: DataFrame, shards: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(group -> block, slot) and (block -> sums by slot)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True])
        slot, sums = kk.split(pdf["bytes"].to_numpy(np.int64), shards)
        return pd.DataFrame({"group": pdf["group"].to_numpy(), "block": pdf["block"].to_numpy(), "slot": slot.astype(np.int32), "bytes": pdf["bytes"].to_numpy(), "n": pdf["n"].to_numpy()})

    dealt = groups.withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks)))
    solved = dealt.groupBy("block").applyInPandas(solve, "group string, block long, slot int, bytes long, n long")
    solved = materialize(solved, "shard-groups")
    sums = solved.groupBy("block", "slot").agg(F.sum("bytes").alias("bytes"))
    return solved, sums.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bytes"))).alias("sums"))


def _merge(shards: int):
    """Difference the partial partitions of one parent: where each slot of each child goes, and the parent's sums."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        sums, nodes = [], []
        forest = kk.Forest(len(pdf) * shards)
        for i, own in enumerate(pdf["sums"]):
            s = np.zeros(shards, np.int64)
            for k, v in dict(own).items():
                s[k] = v
            order = np.argsort(-s, kind="stable")
            sums.append(s[order])
            nodes.append(i * shards + order)
        total, roots = kk.difference(sums, nodes, forest)
        to = np.empty(len(pdf) * shards, np.int32)
        for j, root in enumerate(roots):
            to[forest.items(int(root))] = j
        return pd.DataFrame({
            "block": pdf["block"].to_numpy(), "parent": pdf["parent"].to_numpy(), "to": list(to.reshape(len(pdf), shards)),
            "sums": [{j: int(v) for j, v in enumerate(total)} if i == 0 else None for i in range(len(pdf))],
        })

    return solve


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law (`bytes`), shard, slot (gapless from 0 in its shard), grown_shard (null)."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("group"),
    )
    rows = materialize(rows.groupBy("id", "size", "text_crc32", "group").agg(F.count("*").alias("copies")), "shard-rows")
    groups = rows.groupBy("group").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.count("*").alias("n"))
    blocks = max(1, rows.count() // BLOCK_GROUPS)
    solved, level = _blocks(groups, shards, blocks)
    solved = solved.withColumnRenamed("slot", "place")
    while True:
        parents = -(-blocks // FAN)
        up = level.withColumn("parent", F.col("block") % parents)
        merged = up.groupBy("parent").applyInPandas(_merge(shards), "block long, parent long, to array<int>, sums map<int,long>")
        merged = materialize(merged, "shard-level")
        step = merged.select("block", "parent", "to")
        step = F.broadcast(step) if small_rows(step, 10_000) else step  # 10,000 rows of `shards` ints
        solved = solved.join(step, "block").select("group", "n", F.col("parent").alias("block"), F.element_at("to", F.col("place") + 1).alias("place"))
        if parents == 1:
            break
        blocks, level = parents, merged.where(F.col("sums").isNotNull()).select(F.col("parent").alias("block"), "sums")
    where = materialize(solved.select("group", F.col("place").alias("shard"), "n"), "shard-where")
    placed = lookup_join(rows, where, "group", "n")
    slices = max(1, rows.count() // (SLICE_ROWS * shards))
    placed = materialize(placed.withColumn("slice", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(slices))), "shard-placed")
    counts = placed.groupBy("shard", "slice").agg(F.sum("copies").alias("total"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    offsets = F.broadcast(offsets) if small_rows(offsets) else offsets
    run = Window.partitionBy("shard", "slice").orderBy("id", "group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.sum("copies").over(run) - F.col("copies")
    each = placed.withColumn("first", first).join(offsets, ["shard", "slice"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("first") + F.col("copy")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
