"""Near duplicates among vectors by an epsilon grid order join: all pairs of a label with a cosine of `min_cosine` or more.

Unit vectors with a cosine of c or more lie within eps = sqrt(2 - 2c) of each other, and so do their projections on any orthonormal
directions.  The leading principal directions are fitted to all distinct vectors; a grid of cells with sides eps over them gives an
order (label, cell, cell, ...) by which Spark sorts all vectors over range partitions.  The sequence is cut into blocks of consecutive
vectors.  Intervals of blocks are joined recursively from the whole sequence down: a pair of intervals whose labels don't overlap or whose
boxes are further than eps apart is skipped with everything in it, the others are replaced by the pairs of their parts, one equi-join a
level.  A task gets the pairs of blocks that are left, goes on in the same way inside them, and multiplies what remains.

Only counts and spanning edges leave a task, never the pairs themselves.  Equal vectors of a label are one class with a count from the start,
aggregated before the shuffle, so copies cost nothing however many there are; near copies that differ are compared, in blocks over many tasks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
nothing; vectors of unequal length never link.  Rows with one id are vectors of their own; a null id is never the smallest, and its row is not kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, lookup_join, materialize, numbered, tidy, write_table
from .components import components

MIN_COSINE = 0.98
#: Principal directions of the grid.
GRID_DIMS = 6
#: Components of a vector to which the directions are fitted; a projection of fewer components is no longer than that of all.
FIT_COMPONENTS = 256
#: Vectors of a block, and bytes that a block has at most.
BLOCK_ROWS, BLOCK_BYTES = 2048, 4 << 20
#: Parts of an interval of the recursion.
FAN = 8
#: Vectors of a side that are multiplied without going on.
LEAF = 128
#: What rounding may take from a distance or add to a cosine.
SLACK = 1e-9


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the lists of each length; null components become NaN."""
    lens = np.asarray(column.value_lengths().fill_null(0))
    ends = np.cumsum(lens)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for n in np.unique(lens[lens > 0]):
        at = np.flatnonzero(lens == n)
        yield at, flat[(ends[at] - n)[:, None] + np.arange(n)]


def _usable(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have only finite components and not only zeros; the rows, scaled by powers of two where squares would leave the range."""
    m = m + 0.0  # no negative zero
    top = np.abs(m).max(axis=1)
    good = np.isfinite(m).all(axis=1) & (top > 0)
    if m.dtype == np.float64 and good.any():
        far = good & ((top > 1e100) | (top < 1e-100))
        m[far] = np.ldexp(m[far], -np.frexp(top[far])[1][:, None])
    return good, m


def _classes(payload: bool) -> Callable:
    """(id, label, vector) to (id, label, digest, size, vec): digest tells equal vectors of a label, null where a vector links with nothing."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest: list[bytes | None] = [None] * batch.num_rows
            sizes: list[int | None] = [None] * batch.num_rows
            vecs: list[bytes | None] = [None] * batch.num_rows
            labels = batch.column("tag").to_pylist()
            for at, m in _rows(batch.column("vector")):
                good, m = _usable(m)
                for i, fine, v in zip(at, good, m, strict=True):
                    if fine and labels[i] is not None:
                        raw = v.tobytes()
                        digest[i], sizes[i] = hashlib.sha256(f"{len(labels[i])}:{labels[i]}:".encode() + raw).digest(), len(v)
                        vecs[i] = raw if payload else None
            out = {"id": batch.column("id"), "tag": batch.column("tag"), "digest": pa.array(digest, pa.binary()), "size": pa.array(sizes, pa.int32())}
            yield pa.RecordBatch.from_pydict(out | ({"vec": pa.array(vecs, pa.binary())} if payload else {}))

    return run


def _matrix(vecs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _fitted(m: np.ndarray, width: int) -> np.ndarray:
    """The unit vectors' first `width` components, shorter ones filled with zeros."""
    u = _units(m)[:, :width]
    return np.pad(u, ((0, 0), (0, width - u.shape[1])))


def _by_size(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.asarray(batch.column("size"))
    vecs = batch.column("vec").to_pylist()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, _matrix([vecs[i] for i in at], kind)


def _directions(classes: DataFrame, kind: str) -> np.ndarray:
    """The leading principal directions (components x dims) of all distinct vectors, from sums that the tasks make.

    The driver gets one number for each pair of at most FIT_COMPONENTS components.
    """
    width = min(classes.agg(F.max("size")).first()[0] or 1, FIT_COMPONENTS)
    upper = np.triu_indices(width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, n = np.zeros(width), np.zeros((width, width)), 0
        for batch in batches:
            for _, m in _by_size(batch, kind):
                u = _fitted(m, width)
                first, second, n = first + u.sum(axis=0), second + u.T @ u, n + len(u)
        if n:
            values = np.concatenate([[n], first, second[upper]])
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(values)), pa.int32()), "value": pa.array(values)})

    found = classes.select("size", "vec").mapInArrow(tidy(sums), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(1 + width + len(upper[0]))
    for r in found:
        values[r.place] = r.value
    n, mean = max(values[0], 1), values[1 : 1 + width] / max(values[0], 1)
    second = np.zeros((width, width))
    second[upper] = values[1 + width :] / n
    cov = second + np.triu(second, 1).T - np.outer(mean, mean)
    return np.linalg.eigh(cov)[1][:, ::-1][:, :GRID_DIMS]


def _boxes(axis: int) -> list[str]:
    return [f"lo{i}" for i in range(axis)] + [f"hi{i}" for i in range(axis)]


def _blocks(classes: DataFrame, kind: str, basis: np.ndarray, eps: float) -> tuple[DataFrame, list[str]]:
    """Blocks of consecutive vectors of one label and length in epsilon grid order, with their boxes; `block` numbers them along the order."""
    width, axis = basis.shape
    cells = [f"c{i}" for i in range(axis)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros((batch.num_rows, axis), np.int32)
            for at, m in _by_size(batch, kind):
                cell[at] = np.floor(_fitted(m, width) @ basis / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cell[:, i]) for i in range(axis))], [*batch.schema.names, *cells])

    schema = "tag string, size int, node long, n long, vec binary"
    placed = classes.select("tag", "size", "node", "n", "vec").mapInArrow(tidy(place), f"{schema}, {', '.join(f'{c} int' for c in cells)}")
    order = ["tag", "size", *cells, "node"]  # the node last: a cell that holds very many vectors goes to many partitions
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("tag", "size", "node", "n", "vec")
    boxes = _boxes(axis)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int, int, bytes]] = []

        def block() -> pa.RecordBatch:
            at = _fitted(_matrix([r[4] for r in held], kind), width) @ basis
            row = {"tag": held[0][0], "size": held[0][1]} | dict(zip(boxes, [*at.min(axis=0), *at.max(axis=0)], strict=True))
            row |= {"nodes": np.array([r[2] for r in held], np.int64).tobytes(), "counts": np.array([r[3] for r in held], np.int64).tobytes(), "vecs": b"".join(r[4] for r in held)}
            return pa.RecordBatch.from_pylist([row], out)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (held[0][:2] != row[:2] or len(held) >= BLOCK_ROWS or len(held) * len(row[4]) >= BLOCK_BYTES):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    out = pa.schema([("tag", pa.string()), ("size", pa.int32()), *((b, pa.float64()) for b in boxes), ("nodes", pa.binary()), ("counts", pa.binary()), ("vecs", pa.binary())])
    made = ordered.mapInArrow(tidy(cut), f"tag string, size int, {', '.join(f'{b} double' for b in boxes)}, nodes binary, counts binary, vecs binary")
    return numbered(made, "ego-blocks", "block"), boxes


def _block_pairs(blocks: DataFrame, axis: int, eps: float) -> DataFrame:
    """(a, b), a <= b: pairs of blocks that may hold a link, by joining intervals from the whole sequence down.

    Every level is one table of intervals with boxes and one of pairs; a pair of intervals leads to at most FAN * FAN pairs of parts.
    """
    boxes = _boxes(axis)
    level = materialize(blocks.select(F.col("block").alias("at"), F.col("tag").alias("tag0"), F.col("tag").alias("tag1"), *boxes), "ego-intervals")
    levels = [level]
    last = level.agg(F.max("at")).first()[0] or 0
    while last:
        grown = [F.min("tag0").alias("tag0"), F.max("tag1").alias("tag1"), *(F.min(c).alias(c) if c.startswith("lo") else F.max(c).alias(c) for c in boxes)]
        level = materialize(level.groupBy(F.floor(F.col("at") / FAN).alias("at")).agg(*grown), "ego-intervals")
        levels.append(level)
        last //= FAN
    pairs = levels[-1].select(F.col("at").alias("a"), F.col("at").alias("b"))
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"x.lo{i}") - F.col(f"y.hi{i}"), F.col(f"y.lo{i}") - F.col(f"x.hi{i}"))
    for below in levels[-2::-1]:
        part = below.withColumn("up", F.floor(F.col("at") / FAN))
        near = sum((gap(i) * gap(i) for i in range(axis)), F.lit(0.0)) <= eps * eps
        near &= (F.col("x.tag0") <= F.col("y.tag1")) & (F.col("y.tag0") <= F.col("x.tag1"))
        met = pairs.join(part.alias("x"), F.col("a") == F.col("x.up")).join(part.alias("y"), F.col("b") == F.col("y.up"))
        pairs = materialize(met.where((F.col("x.at") <= F.col("y.at")) & near).select(F.col("x.at").alias("a"), F.col("y.at").alias("b")), "ego-pairs")
    return pairs


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    dot = lambda x, y: math.fsum((x * y).tolist())
    return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))


def _linked(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, least: float) -> np.ndarray:
    """Which pairs have a cosine of `least` or more; those at the border are told by exact sums, so that no layout changes a link."""
    cos = ua @ ub.T
    found = cos >= least
    for i, j in zip(*np.nonzero(np.abs(cos - least) <= 1e-12), strict=True):
        found[i, j] = _exact(a[i], b[j]) >= least
    return found


def _join(a: np.ndarray, b: np.ndarray, basis: np.ndarray, eps: float, least: float, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row of a, first row of b, matrix of links) of all parts of two sequences that are not provably distant.  same: b is a; each pair of rows comes once."""
    ua, ub = _units(a), _units(b)
    width = basis.shape[0]
    pa_, pb = (np.pad(u[:, :width], ((0, 0), (0, width - min(width, u.shape[1])))) @ basis for u in (ua, ub))
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        i, k, j, m = open_.pop()
        if same and i >= m:
            continue  # below the diagonal
        x, y = pa_[i:k], pb[j:m]
        gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
        if gap @ gap > eps * eps:
            continue
        if k - i <= LEAF and m - j <= LEAF:
            found = _linked(a[i:k], b[j:m], ua[i:k], ub[j:m], least)
            if same:
                found &= np.arange(i, k)[:, None] < np.arange(j, m)[None, :]
            if found.any():
                yield i, j, found
        elif k - i >= m - j:
            half = (i + k) // 2
            open_ += [(i, half, j, m), (half, k, j, m)]
        else:
            half = (j + m) // 2
            open_ += [(i, k, j, half), (i, k, half, m)]


class _Forest:
    """Union by least root over the rows of a pair of blocks."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def _stars(found: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows, columns) of each component of a matrix of links."""
    rest = found.any(axis=1)
    while rest.any():
        first = int(np.argmax(rest))
        rows = np.zeros(len(found), bool)
        rows[first] = True
        while True:
            cols = found[rows].any(axis=0)
            more = found[:, cols].any(axis=1)
            if (more == rows).all():
                break
            rows = more
        rest &= ~rows
        yield first, np.flatnonzero(rows), np.flatnonzero(cols)


def _links(pairs: DataFrame, blocks: DataFrame, kind: str, basis: np.ndarray, eps: float, least: float) -> DataFrame:
    """(node, links, root): for both sides of every pair of blocks the links that rows found there, and a row of the same component."""
    sides = pairs.select(F.xxhash64("a", "b").alias("deal"), "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    both = sides.join(blocks.select("block", "nodes", "counts", "vecs", "size"), "block").drop("block")
    # Blocks of a pair meet in one task as rows that follow each other; a pair is at most two blocks.
    dealt = both.repartition("deal").sortWithinPartitions("deal", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            x, y = held[0], held[-1]
            m = [np.frombuffer(r["vecs"], kind).reshape(-1, r["size"]).astype(np.float64) for r in (x, y)]
            nodes, counts = ([np.frombuffer(r[c], np.int64) for r in (x, y)] for c in ("nodes", "counts"))
            same = len(held) == 1
            shift = 0 if same else len(m[0])
            got, forest = [np.zeros(len(v), np.int64) for v in m], _Forest(shift + len(m[1]))
            got[1] = got[0] if same else got[1]
            if x["size"] == y["size"]:
                for i, j, found in _join(*m, basis, eps, least, same):
                    k, n = i + found.shape[0], j + found.shape[1]
                    got[0][i:k] += found @ counts[1][j:n]
                    got[1][j:n] += found.T @ counts[0][i:k]
                    for first, rows, cols in _stars(found):
                        for r in rows:
                            forest.join(i + first, i + int(r))
                        for c in cols:
                            forest.join(i + first, shift + j + int(c))
            links = got[0] if same else np.concatenate(got)
            every = nodes[0] if same else np.concatenate(nodes)
            some = np.flatnonzero(links)
            roots = every[[forest.root(int(s)) for s in some]] if len(some) else every[:0]
            return pa.RecordBatch.from_pydict({"node": pa.array(every[some]), "links": pa.array(links[some]), "root": pa.array(roots)})

        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["a"], held[0]["b"]) != (row["a"], row["b"]):
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    return dealt.mapInArrow(tidy(run), "node long, links long, root long")


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", min_cosine: float = MIN_COSINE, columns: list[str] | None = None) -> DataFrame:
    """Rows of `vectors` (or their `columns`) with n_links, component_id and kept; results replace columns of the same names.

    n_links: other rows of the label with a cosine of `min_cosine` or more; component_id: the smallest id reachable by links;
    kept: whether that is the row's own.  min_cosine is above -1; any lower one would link all.
    """
    spark = vectors.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * min_cosine)) + SLACK
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    kept = [c for c in (columns or vectors.columns) if c not in ("n_links", "component_id", "kept")]
    id_type = vectors.schema[id].dataType
    short = vectors.select(F.col(id).alias("id"), F.col(label).cast("string").alias("tag"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vector"))
    marks = f"id {id_type.simpleString()}, tag string, digest binary, size int"
    told = short.mapInArrow(_classes(True), f"{marks}, vec binary").where(F.col("digest").isNotNull())
    grouped = told.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("tag").alias("tag"), F.first("size").alias("size"), F.first("vec").alias("vec"))
    path = write_table(grouped.withColumn("node", F.monotonically_increasing_id()), "ego-classes")
    classes = spark.read.schema(f"digest binary, least {id_type.simpleString()}, n long, tag string, size int, vec binary, node long").parquet(path)
    basis = _directions(classes, kind)
    blocks, boxes = _blocks(classes, kind, basis, eps)
    pairs = _block_pairs(blocks, len(boxes) // 2, eps)
    links = materialize(_links(pairs, blocks, kind, basis, eps, min_cosine), "ego-links")
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    of = classes.select("digest", "least", "n", "node").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("least").alias("component"))
    told = materialize(of.join(least, "root").select("digest", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "n"), "ego-result")
    drop_table(spark, path)
    # The rows' own digests are worked out again where the rows lie; a class with very many rows is joined without moving them to one task.
    whole = vectors.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(id).alias("id"), F.col(label).cast("string").alias("tag"), short_vector(vector, single))
    schema = T.StructType([T.StructField("row", T.StructType([vectors.schema[c] for c in kept])), T.StructField("id", id_type), T.StructField("digest", T.BinaryType())])
    rows = whole.mapInArrow(_digests, schema)
    out = lookup_join(rows, told, "digest", "n")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select("row.*", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def short_vector(vector: str, single: bool) -> F.Column:
    return F.col(vector).cast("array<float>" if single else "array<double>").alias("vector")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, tag, vector) to (row, id, digest)."""
    for batch in batches:
        short = pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "tag", "vector")], ["id", "tag", "vector"])
        (found,) = _classes(False)(iter([short]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), found.column("digest")], ["row", "id", "digest"])
