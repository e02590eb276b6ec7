"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  Of two fingerprints that differ in at most two bits, some
segment agrees (pigeonhole), and of the two others one has at most one error, so that its Golay keys meet.  A
fingerprint's keys are therefore (exact segment, other segment's codeword index): six combinations with one or six indices
each, about 32 keys of 37 bits.  Rows are joined on the key and verified on all 64 bits, so no link is lost and
none is wrong.

Equal fingerprints are one class before any of this, and a key's rows are only walked along (sorted, streamed):
up to BUCKET of them are linked by a nearest-neighbour tree, which spans the same components as all pairs would.  Beyond
that the exact other way is taken: fingerprints within two bits share a vector at distance at most one from both, so
the members are dealt to their 65 such vectors, where at most 65 can ever meet.

Defined results: null and empty texts have fingerprint zero and link like any other; a text of fewer words than a shingle is
one shingle; repeated rows stay and share their component; null ids are ignored for component_id, which is null where a
component has no other; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import lookup_join, materialize
from .components import components

SEED = 42
#: Segments of a fingerprint: (lowest bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints of one key that are compared with each other where they lie.
BUCKET = 512
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of all k-word shingles, repeats included; of the whole sequence when it is shorter; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    text, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(text, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.array([h(text[s:e], SEED) for s, e in zip(starts[: 1 - k].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """docs without the text, plus fp (long)."""
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            fps = [fold(shingle_hashes((t.as_py() or "").encode().lower().split(), shingle)) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fps, pa.int64())], [*rest, "fp"])

    schema = docs.select(*rest).schema.add("fp", "long")
    return docs.mapInArrow(run, schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        parts = [((fp >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
        code = 0
        for i in range(3):
            for j in range(3):
                if i != j:
                    at, key = golay.keys(parts[j], SEGMENTS[j][1])
                    yield pa.RecordBatch.from_arrays([pa.array((code << 34) | (parts[i][at] << 12) | key), pa.array(fp[at].view(np.int64))], ["key", "fp"])
                    code += 1


def nearest_tree(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (places) of a minimum spanning forest under Hamming distance, none longer than radius."""
    n = len(fps)
    left = np.arange(1, n)
    near = np.bitwise_count(fps[1:] ^ fps[0]).astype(np.int64)
    by = np.zeros(n - 1, np.int64)
    edges = []
    while len(left):
        k = int(near.argmin())
        at = int(left[k])
        if near[k] <= radius:
            edges.append((int(by[k]), at))
        left, near, by = (np.delete(x, k) for x in (left, near, by))
        d = np.bitwise_count(fps[left] ^ fps[at])
        closer = d < near
        near[closer], by[closer] = d[closer], at
    return edges


def bucket_edges(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], link, bucket: int, carry: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Walk rows that are sorted by `key`; yield (rows, rows) of int64 columns that are linked inside each key.

    link(rows) gives the links of 2 to `bucket` rows of one key.  carry None: the rows of a larger key come out as
    (rows, None).  Otherwise a larger key is linked block by block, `carry` rows of each block going on to the next.
    """
    key, held, over = None, [], False

    def close():
        if not over and sum(map(len, held)) > 1:
            yield from link(np.concatenate(held))

    for batch in batches:
        keys = batch.column("key").to_numpy()
        if not len(keys):
            continue
        rows = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        sizes = np.diff(starts)
        last = len(sizes) - 1
        for g in np.flatnonzero((sizes > 1) | (np.arange(last + 1) % max(1, last) == 0)).tolist():  # alone, and not at an end: nothing to link
            s, e = int(starts[g]), int(starts[g + 1])
            if keys[s] != key:
                yield from close()
                key, held, over = keys[s], [], False
            for at in range(s, e, bucket):
                if over:
                    yield rows[at : min(e, at + bucket)], None
                    continue
                held.append(rows[at : min(e, at + bucket)])
                if sum(map(len, held)) > bucket:
                    block = np.concatenate(held)
                    if carry is None:
                        yield block, None
                        held, over = [], True
                    else:
                        yield from link(block)
                        held = [block[:: max(1, len(block) // carry)]]
    yield from close()


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints `fp` within `radius` (at most 2) bits of each other, by components."""
    if radius > 2:
        raise ValueError("the keys hold for at most two differing bits")

    def tree(rows: np.ndarray):
        values = rows[:, 0].copy()
        fps = values.view(np.uint64)
        if len(fps) == 2 and np.bitwise_count(fps[0] ^ fps[1]) > radius:
            return
        if edges := nearest_tree(fps, radius):
            a, b = np.array(edges).T
            yield values[a], values[b]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in bucket_edges(batches, ("fp",), tree, BUCKET):
            a = a.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], ["u", "v"])

    keyed = classes.select("fp").mapInArrow(_keys, "key long, fp long")
    found = materialize(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(walk, "u long, v long"), "simhash-links")
    crowded = found.where("v IS NULL").select("u").distinct()
    around = F.array(F.col("u"), *[F.col("u").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])
    met = crowded.select("u", F.explode(around).alias("middle")).groupBy("middle").agg(F.collect_list("u").alias("us")).where(F.size("us") > 1)  # at most 65
    star = met.select(F.array_min("us").alias("v"), F.explode("us").alias("u")) if radius == 2 else met.limit(0).select(F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("u"))
    return found.where("v IS NOT NULL").unionByName(star.where("u <> v").select("u", "v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links)."""
    marked = materialize(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle), "simhash-docs")
    classes = materialize(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    roots = materialize(components(links(classes, radius)).withColumn("one", F.lit(1).cast("long")), "simhash-roots")
    rooted = lookup_join(classes, roots.withColumnRenamed("node", "fp"), "fp", "one").withColumn("root", F.coalesce("root", "fp"))
    linked = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")).where("m > 1"), "simhash-least")
    named = lookup_join(rooted, linked, "root", "m").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    out = lookup_join(marked, materialize(named, "simhash-named"), "fp", "n")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
