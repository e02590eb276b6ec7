"""Chroma audio fingerprints and the alignment of recordings.

Samples are cut into overlapping windows; a Fourier transform's power is gathered into twelve pitch classes, and each
frame scaled to length one.  Sixteen filters, each the ratio of two rectangles' sums over a few frames and pitch classes,
are read from an integral image and quantised to two bits in Gray code: one 32-bit integer per frame, the sixteen bits that tell the
upper half of a filter's values before the sixteen others.  The image holds whole numbers, so a recording's integers do not depend
on what is computed beside it.  The steps of the quantiser are the quartiles of at most FIT_FRAMES frames of each of about FIT recordings.

Search: recordings with equal fingerprints are one class.  A token are the upper halves of two integers STEP apart, at every place; two places
agree if the tokens are equal and of the 64 bits behind them, four more upper halves, at most LOOSE differ.  Blocks of queries of bounded size, their places
in order of the tokens, meet all classes, in cells; there every class looks its own tokens up, its agreeing places are gathered by query and offset, and at every
bin of this histogram with enough frames in common the share of differing bits over the whole overlap decides, which is `align` for
all pairs.  Only matches leave a task: what moves are the integers of every class once for each block of queries, neither tokens nor pairs.  A
pair without agreeing places is lost (the README has the recall against all offsets of all pairs).

Defined results: recordings too short for an integer match nothing and are classes by their bytes, null and empty ones together;
repeated rows are one class; extra columns are not read.  Data is RIFF/WAVE (PCM, 8 or 16 bits, channels averaged) or
else taken for unsigned 8-bit mono samples; damaged headers too.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, materialize, sample_rows, tidy

WINDOW, HOP = 128, 32
#: Frequencies from LOW to HIGH, as shares of the sampling rate, count for the pitch classes.
LOW, HIGH = 0.01, 0.45
#: Fixed values, the filters: kind (0 sum, 1 early against late, 2 low against high, 3 crossed, 4 middle frames against outer), first pitch class, pitch classes, frames.
FILTERS = (
    (0, 0, 3, 8), (0, 3, 3, 8), (0, 6, 3, 8), (0, 9, 3, 8), (1, 0, 4, 8), (1, 4, 4, 8), (1, 8, 4, 8), (1, 0, 12, 6),
    (2, 0, 6, 8), (2, 3, 6, 8), (2, 6, 6, 8), (2, 0, 12, 4), (3, 0, 6, 8), (3, 6, 6, 8), (4, 0, 6, 6), (4, 6, 6, 6),
)
FRAMES = 8
#: A whole one in the integral image.
ONE = 32_768
#: Between these ratios lie the four steps of every filter where none are fitted.
STEPS = np.tile(np.array([[0.8], [1.0], [1.25]]), (1, len(FILTERS)))
#: Recordings, about, and frames of each to which the steps are fitted.
FIT, FIT_FRAMES = 400, 64
#: Frames between the halves of a token and those behind it, bits in which agreeing places may differ there; what a match needs: frames of overlap, share of bits that differ.
STEP, LOOSE, OVERLAP, ERRORS = 3, 14, 32, 0.15
#: An overlap that leaves out more than 1 - MOST of the shorter recording needs PARTIAL frames: ends of different recordings may sound alike for a note or two.
MOST, PARTIAL = 0.9, 64
#: Bytes of integers of a block of queries, recordings at least to a cell, samples, integers or places that are worked on at once, equal tokens likewise.
QUERY_BYTES, CELL_ROWS, BLOCK, MATCHES = 1 << 25, 1_000, 1 << 21, 1 << 19


def samples(data: bytes) -> np.ndarray:
    """Mono samples in -1 to 1."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        at, channels, bits = 12, 1, 8
        while at + 8 <= len(data):
            name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            if name == b"fmt " and size >= 16 and at + 24 <= len(data):
                channels, bits = struct.unpack("<H", data[at + 10 : at + 12])[0] or 1, struct.unpack("<H", data[at + 22 : at + 24])[0]
            if name == b"data" and bits in (8, 16):
                raw = data[at + 8 : at + 8 + size]
                raw = raw[: len(raw) // (channels * bits // 8) * (channels * bits // 8)]
                x = (np.frombuffer(raw, np.uint8) - 128.0) / 128 if bits == 8 else np.frombuffer(raw, "<i2") / 32768
                return x.reshape(-1, channels).mean(axis=1).astype(np.float32)
            at += 8 + size + size % 2
    return ((np.frombuffer(data, np.uint8) - 128.0) / 128).astype(np.float32)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(frequencies in order of their pitch class, twelve to an octave; where each class starts)."""
    f = np.arange(WINDOW // 2 + 1) / WINDOW
    used = np.flatnonzero((f >= LOW) & (f <= HIGH))
    own = np.round(12 * np.log2(f[used] / LOW)).astype(int) % 12
    order = np.argsort(own, kind="stable")
    return used[order], np.searchsorted(own[order], np.arange(12))


(_BINS, _STARTS), _HANN = _classes(), np.hanning(WINDOW).astype(np.float32)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the groups of these sizes."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def chroma(recordings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """((frames, 12) of whole numbers, each frame of length ONE or zero where it is silent; frames of each recording)."""
    sizes = np.array([len(x) for x in recordings], np.int64)
    frames = np.maximum(0, (sizes - WINDOW) // HOP + 1)
    out = np.zeros((frames.sum(), 12), np.int64)
    starts = np.repeat(np.cumsum(sizes) - sizes, frames) + HOP * _within(frames)
    if len(starts):
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate(recordings), WINDOW)
    for at in range(0, len(starts), 8_192):
        own = windows[starts[at : at + 8_192]]
        spectrum = np.fft.rfft((own - own.mean(axis=1, keepdims=True)) * _HANN, axis=1)
        power = np.add.reduceat((spectrum.real**2 + spectrum.imag**2)[:, _BINS], _STARTS, axis=1)
        norm = np.sqrt((power * power).sum(axis=1, keepdims=True))
        out[at : at + 8_192] = np.where(norm > 1e-6, power / np.maximum(norm, 1e-6), 0) * ONE
    return out, frames


def ratios(recordings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """((filters, integers) of the filters' ratios, integers of each recording): one where a whole filter fits."""
    c, frames = chroma(recordings)
    counts = np.maximum(0, frames - FRAMES + 1)
    image = np.zeros((len(c) + 1, 13), np.int64)
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    t = np.repeat(np.cumsum(frames) - frames, counts) + _within(counts)

    def box(start: int, frames: int, low: int, classes: int) -> np.ndarray:
        a, b = t + start, t + start + frames
        return image[b, low + classes] - image[a, low + classes] - image[b, low] + image[a, low]

    out = np.zeros((len(FILTERS), len(t)))
    for i, (kind, y, h, w) in enumerate(FILTERS):
        s = (FRAMES - w) // 2
        if kind == 0:
            a, b = box(s, w, y, h), (box(s, w, 0, 12) - box(s, w, y, h)) * h / (12 - h)
        elif kind == 1:
            a, b = box(s, w // 2, y, h), box(s + w // 2, w // 2, y, h)
        elif kind == 2:
            a, b = box(s, w, y, h // 2), box(s, w, y + h // 2, h // 2)
        elif kind == 3:
            a = box(s, w // 2, y, h // 2) + box(s + w // 2, w // 2, y + h // 2, h // 2)
            b = box(s + w // 2, w // 2, y, h // 2) + box(s, w // 2, y + h // 2, h // 2)
        else:
            a, b = 2 * box(s + w // 3, w // 3, y, h), box(s, w // 3, y, h) + box(s + 2 * w // 3, w // 3, y, h)
        out[i] = (ONE + a) / (ONE + b)
    return out, counts


def prints_of(data: list[bytes], steps: np.ndarray = STEPS) -> list[np.ndarray]:
    """The packed integers of every recording, in blocks of bounded size (a longer recording is a block of its own)."""
    out, block, size = [], [], 0

    def flush() -> None:
        r, counts = ratios(block)
        upper, lower = np.zeros(r.shape[1], np.uint32), np.zeros(r.shape[1], np.uint32)
        for row, (a, b, c) in zip(r, steps.T, strict=True):
            upper = (upper << np.uint32(1)) | (row >= b)
            lower = (lower << np.uint32(1)) | ((row >= a) & (row < c))
        out.extend(np.split((upper << np.uint32(16)) | lower, np.cumsum(counts)[:-1]))
        block.clear()

    for x in map(samples, data):
        if block and size + len(x) > BLOCK:
            flush()
            size = 0
        block.append(x)
        size += len(x)
    if block:
        flush()
    return out


def fingerprint(data: bytes, steps: np.ndarray = STEPS) -> np.ndarray:
    return prints_of([data], steps)[0]


def fit(media: DataFrame, data_col: str) -> np.ndarray:
    """(3, filters): quartiles of each filter's ratio over a bounded sample; STEPS if it has no integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("data"):
                r = ratios([samples(x.as_py() or b"")])[0]
                r = r[:, np.unique(np.linspace(0, r.shape[1] - 1, FIT_FRAMES).astype(int))] if r.shape[1] else r
                yield pa.RecordBatch.from_arrays([pa.array(list(r.T), pa.list_(pa.float64()))], ["r"])

    sample = sample_rows(media.select(F.col(data_col).cast("binary").alias("data")), ["data"], FIT)
    found = sample.mapInArrow(tidy(run), "r array<double>").toArrow().column("r").to_pylist()  # at most FIT * FIT_FRAMES rows
    return np.quantile(np.array(found), [0.25, 0.5, 0.75], axis=0) if found else STEPS


def tokens(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, bits behind it) at every place that has integers enough behind it."""
    n = max(0, len(prints) - 5 * STEP)
    upper = prints.astype(np.uint64) >> np.uint64(16)
    token, beside = np.zeros(n, np.uint32), np.zeros(n, np.uint64)
    for k in range(2):
        token |= upper[k * STEP : k * STEP + n].astype(np.uint32) << np.uint32(16 * k)
    for k in range(4):
        beside |= upper[(k + 2) * STEP : (k + 2) * STEP + n] << np.uint64(16 * k)
    return token, beside


def offsets(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The histogram: (offsets of b in a, agreeing places of each); places are matched BLOCK pairs at a time, or one place against all."""
    (s, x), (t, y) = tokens(a), tokens(b)
    order = np.argsort(t, kind="stable")
    low, high = np.searchsorted(t[order], s, "left"), np.searchsorted(t[order], s, "right")
    votes, at = np.zeros(len(s) + len(t), np.int64), np.flatnonzero(high > low)
    ends = np.cumsum((high - low)[at])
    for own in np.split(at, np.flatnonzero(np.diff(ends // BLOCK)) + 1):
        n = (high - low)[own]
        i, j = np.repeat(own, n), order[np.repeat(low[own], n) + _within(n)]
        near = np.bitwise_count(x[i] ^ y[j]) <= LOOSE
        votes += np.bincount((i - j)[near] + len(t), minlength=len(votes))
    found = np.flatnonzero(votes)
    return found - len(t), votes[found]


def differing(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits that differ over the overlap at each of the offsets of b in a."""
    none, n = np.zeros(len(b), np.uint32), len(b)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([none, a, none]), n)
    inside = np.lib.stride_tricks.sliding_window_view(np.concatenate([none, np.full(len(a), 0xFFFFFFFF, np.uint32), none]), n)
    out = np.zeros(len(at), np.int64)
    for k in range(0, len(at), step := max(1, BLOCK // 8 // max(1, n))):
        own = at[k : k + step] + n
        out[k : k + step] = np.bitwise_count((windows[own] ^ b) & inside[own]).sum(axis=1, dtype=np.int64)
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float] | None:
    """(offset of b in a, overlap, share of differing bits) at the bin of least errors, then longest overlap, then least offset; None without a bin of enough frames."""
    at = offsets(a, b)[0]
    overlap = np.minimum(len(a), len(b) + at) - np.maximum(0, at)
    enough = overlap >= max(OVERLAP, min(PARTIAL, MOST * min(len(a), len(b))))
    at, overlap = at[enough], overlap[enough]
    if not len(at):
        return None
    errors = differing(a, b, at) / (32 * overlap)
    best = np.lexsort((at, -overlap, errors))[0]
    return int(at[best]), int(overlap[best]), float(errors[best])


def fingerprints(media: DataFrame, id_col: str, data_col: str, steps: np.ndarray = STEPS) -> DataFrame:
    """(id, class, prints): class is a 64-bit hash of the integers, or of the bytes where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x or b"" for x in batch.column("data").to_pylist()]
            own = prints_of(data, steps)
            cls = [xxhash.xxh64_intdigest(p.tobytes(), 42) if len(p) else xxhash.xxh64_intdigest(x, 43) for p, x in zip(own, data, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array([p.tobytes() for p in own], pa.binary())], ["id", "class", "prints"])

    rows = media.select(F.col(id_col).alias("id"), F.col(data_col).cast("binary").alias("data"))
    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, class long, prints binary")


class _Queries:
    """A block of queries, joined end to end, with all their places in order of the tokens."""

    def __init__(self, cls: list[int], prints: list[bytes]):
        self.cls = np.array(cls, np.int64)
        self.prints, self.sizes, self.starts, rec, place, token, beside = _joined([np.frombuffer(p, np.uint32) for p in prints])
        order = np.argsort(token, kind="stable")
        self.token, self.rec, self.place, self.beside = token[order], rec[order], place[order], beside[order]
        self.longest = int(self.sizes.max())

    def _agreeing(self, at: np.ndarray, low: np.ndarray, n: np.ndarray, beside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, place of the queries) that agree, of the places `at`, whose tokens are the n ones from low on; MATCHES equal tokens at a time."""
        at = at[n[at] > 0]
        low, ends = low[at], np.cumsum(n[at])
        begins = ends - n[at]
        for first in range(0, int(ends[-1]) if len(ends) else 0, MATCHES):
            k = slice(np.searchsorted(ends, first, "right"), np.searchsorted(begins, first + MATCHES, "left"))
            own = np.minimum(ends[k], first + MATCHES) - np.maximum(begins[k], first)
            x, y = np.repeat(at[k], own), np.repeat(low[k] + np.maximum(first - begins[k], 0), own) + _within(own)
            near = np.bitwise_count(beside[x] ^ self.beside[y]) <= LOOSE
            yield x[near], y[near]

    def links(self, cls: np.ndarray, own: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, recording, errors, overlap, offset of the query in the recording) of every query and other recording that match: `align` of all pairs with an agreeing place."""
        prints, sizes, starts, rec, place, token, beside = _joined(own)
        low = np.searchsorted(self.token, token, "left")
        n = np.searchsorted(self.token, token, "right") - low
        sums = np.bincount(rec, n, len(own))
        for v in np.flatnonzero(sums > MATCHES):  # pair by pair, as places of one offset are too many to be kept together
            found = [np.unique(self.rec[y]) for _, y in self._agreeing(np.flatnonzero(rec == v), low, n, beside)]
            rows = []
            for u in np.unique(np.concatenate(found)):
                got = align(own[v], self.prints[self.starts[u] : self.starts[u] + self.sizes[u]]) if self.cls[u] != cls[v] else None
                if got and got[2] <= ERRORS:
                    rows.append((u, v, got[2], got[1], got[0]))
            if rows:
                yield tuple(map(np.array, zip(*rows, strict=True)))
        sums[sums > MATCHES] = 0
        light = np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(sums) // MATCHES)) + 1)
        width = int(sizes.max()) + self.longest + 1
        for some in light:
            at = np.arange(*np.searchsorted(rec, (some[0], some[-1] + 1)))
            bins = [np.zeros(0, np.int64)]
            for x, y in self._agreeing(at[sums[rec[at]] > 0], low, n, beside):
                bins.append(np.unique((rec[x] * len(self.cls) + self.rec[y]) * width + (place[x] - self.place[y] + self.longest)))
            bins = np.unique(np.concatenate(bins))
            pair, offset = bins // width, bins % width - self.longest
            v, u = pair // len(self.cls), pair % len(self.cls)
            overlap = np.minimum(sizes[v], self.sizes[u] + offset) - np.maximum(0, offset)
            k = (cls[v] != self.cls[u]) & (overlap >= np.maximum(OVERLAP, np.minimum(PARTIAL, MOST * np.minimum(sizes[v], self.sizes[u]))))
            v, u, offset, overlap = v[k], u[k], offset[k], overlap[k]
            errors = self._differing(prints, starts[v] + np.maximum(0, offset), self.starts[u] + np.maximum(0, -offset), overlap) / (32 * overlap)
            order = np.lexsort((offset, -overlap, errors, u, v))
            order = order[errors[order] <= ERRORS]
            best = order[np.r_[True, (np.diff(v[order]) != 0) | (np.diff(u[order]) != 0)][: len(order)]]
            yield u[best], v[best], errors[best], overlap[best], offset[best]

    def _differing(self, prints: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bits that differ between the n integers from a on of other recordings' and those from b on of the queries'."""
        out, ends = np.zeros(len(n), np.int64), np.cumsum(n)
        for k in np.split(np.arange(len(n)), np.flatnonzero(np.diff(ends // MATCHES)) + 1) if len(n) else ():
            own = _within(n[k])
            bits = np.bitwise_count(prints[np.repeat(a[k], n[k]) + own] ^ self.prints[np.repeat(b[k], n[k]) + own])
            out[k] = np.add.reduceat(bits, np.cumsum(n[k]) - n[k], dtype=np.int64)
        return out


def _joined(own: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Recordings end to end: integers, sizes, starts; of each place with integers enough behind it: recording, place in it, token, bits behind it."""
    prints, sizes = np.concatenate(own), np.array([len(p) for p in own], np.int64)
    starts, counts = np.cumsum(sizes) - sizes, np.maximum(0, sizes - 5 * STEP)
    rec, place = np.repeat(np.arange(len(own)), counts), _within(counts)
    token, beside = tokens(prints)
    at = starts[rec] + place
    return prints, sizes, starts, rec, place, token[at], beside[at]


def _dealt(sound: DataFrame) -> DataFrame:
    """(cell, is_other, class, least, prints): queries in blocks of about QUERY_BYTES, every block with every other recording in cells that take no more of queries than of others, about.

    Of a recording the integers travel once for each block of queries, and none for a pair.
    """
    told = sound.agg(F.count("*").alias("n"), F.sum(F.length("prints")).alias("all"), F.count_if("asked").alias("q"), F.sum(F.when(F.col("asked"), F.length("prints"))).alias("own")).first()
    own = max(1, told.own or 0)
    blocks = -(-own // QUERY_BYTES)
    cells = max(1, min((told["all"] or 0) * blocks // own, -(-told.n // CELL_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    at = lambda n: F.pmod(F.xxhash64("class"), F.lit(n).cast("long"))
    asks = sound.where("asked").withColumns({"block": at(blocks), "part": every(cells), "is_other": F.lit(False)})
    others = sound.withColumns({"block": every(blocks), "part": at(cells), "is_other": F.lit(True)})
    return asks.unionByName(others).select((F.col("block") * cells + F.col("part")).alias("cell"), "is_other", "class", "least", "prints")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of the queries of each cell, whose rows come first, with its other recordings."""
    cell, heads, queries = None, [], None
    for batch in batches:
        cells, other, cls = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "is_other", "class"))
        least, size = batch.column("least"), np.cumsum([len(x) for x in batch.column("prints").to_pylist()])
        # Rows of one cell and kind, of bounded size.
        for k in np.split(np.arange(len(cells)), np.flatnonzero((np.diff(cells) != 0) | (np.diff(other) != 0) | (np.diff(size // BLOCK) != 0)) + 1):
            if not len(k):
                continue
            if cells[k[0]] != cell:
                cell, heads, queries = cells[k[0]], [], None
            rows = batch.column("prints")[k[0] : k[-1] + 1].to_pylist()
            if not other[k[0]]:
                heads += zip(cls[k].tolist(), rows, strict=True)
                continue
            if queries is None and heads:
                queries, heads = _Queries(*map(list, zip(*heads, strict=True))), []
            if queries is not None:
                for u, v, errors, overlap, offset in queries.links(cls[k], [np.frombuffer(x, np.uint32) for x in rows]):
                    yield pa.RecordBatch.from_arrays([pa.array(queries.cls[u]), pa.array(cls[k][v]), pa.array(errors), pa.array(-overlap), least.take(pa.array(k[v])), pa.array(offset)], ["class", "v", "errors", "o", "least", "offset"])


def search(media: DataFrame, is_query: F.Column, id_col: str, data_col: str) -> DataFrame:
    """One row per query row: id, n_prints, class_id (smallest id of its class), n_classes (other classes that match) and the best match: its smallest id, offset of the query in it, overlap, errors.

    is_query is a condition on the id, named `id`.  Best: least errors, then longest overlap, then smallest id.
    """
    made = materialize(fingerprints(media, id_col, data_col, fit(media, data_col)), "chroma-prints")
    classes = made.groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("prints").alias("prints"), F.max(F.coalesce(is_query, F.lit(False))).alias("asked"))
    classes = materialize(classes, "chroma-classes")
    id_type = classes.schema["least"].dataType.simpleString()
    sound = classes.where((F.length("prints") >= 4 * OVERLAP) & F.col("least").isNotNull()).select("class", "least", "asked", "prints")
    dealt = _dealt(sound).repartition("cell").sortWithinPartitions("cell", "is_other")
    links = dealt.mapInArrow(tidy(_compare), f"class long, v long, errors double, o long, least {id_type}, offset long")
    best = links.groupBy("class").agg(F.count("*").alias("n_classes"), F.min(F.struct("errors", "o", "least", "offset")).alias("b"))
    out = classes.where("asked").select("class", F.col("least").alias("class_id"), F.col("n")).join(best, "class", "left")
    out = materialize(out, "chroma-best")
    rows = lookup_join(made.where(is_query).select("id", "class", (F.length("prints") / 4).cast("long").alias("n_prints")), out, "class", "n")
    return rows.select(
        F.col("id").alias(id_col), "n_prints", "class_id", F.coalesce("n_classes", F.lit(0)).alias("n_classes"), F.col("b.least").alias("match_id"),
        F.col("b.offset").alias("match_offset"), (-F.col("b.o")).alias("match_overlap"), F.col("b.errors").alias("match_errors"),
    )
