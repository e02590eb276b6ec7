"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights, scored per token.

The model has two levels above the unknown word.  A seen bigram (v, w) has d(c) c(v, w) / c(v), with Good-Turing
discounts d for counts up to CUT; an unseen one backs off to a(v) P(w), where a(v) hands out exactly what the context's
seen followers leave: (1 - sum of their discounted shares) / (1 - sum of their unigram probabilities).  P(w) is discounted
the same way, and what it leaves belongs to the one unknown word.  Each text starts in the context of the end token.

Everything is counted over all training texts and moves in packed columns, so a token costs a few bytes:
  1. `_chunks`: a batch of texts is a chunk with a vocabulary of its own (hashes in order) and tokens as places in it.
  2. `_vocabulary`: hash ranges sum the chunks' word counts and give every word a number; each chunk gets back numbers and totals.
  3. `_bigrams`: a chunk's distinct bigrams, with training counts and the texts that hold them, go to their context's bucket.
     Contexts with over 1/(4 buckets) of all tokens - at most 4 per bucket - are dealt by the whole bigram instead.
  4. `_merge`: a bucket sums its bigrams; the table of buckets is written, with the counts of counts.
  5. `_hot_sums`, `_shares`: discounts known, each bucket works out its contexts' weights and the log probability of every
     bigram in it, and adds them up per text; texts gather their shares.
Chunks are made anew in steps 2 and 3, which needs rows that a second reading gives in the same batches, as files do; their
content is part of their name, so anything else fails loudly.

Defined results: null and empty texts are the end token alone; a null id counts as the empty text for the split; repeated rows
are texts of their own and count as often; without training texts every token is the unknown word; extra columns are
not read.  Words are told apart by 64-bit XXH64.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SEED = 42
#: Counts up to this one are discounted.
CUT = 5
#: Bytes of text to a chunk (a longer text is one of its own); vocabulary entries to a hash range and bigrams to a bucket, about.
CHUNK_BYTES, RANGE_WORDS, BUCKET_BIGRAMS = 8_000_000, 700_000, 1_500_000
#: The end token's name; no word holds a line end.
_END = xxhash.xxh64_intdigest(b"\n", SEED)


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integer or float arrays, byte planes apart, compressed."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head = np.array([len(a), ord(a.dtype.kind), a.dtype.itemsize], "<u8").tobytes()
        parts += [head, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, kind, size = (int(x) for x in np.frombuffer(raw, "<u8", 3, at))
        planes = np.frombuffer(raw, np.uint8, n * size, at + 24).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{size}"))
        at += 24 + n * size
    return out


def is_held_out(id_: object) -> bool:
    return zlib.crc32(("" if id_ is None else str(id_)).encode()) % 7 == 2


class Chunk:
    """ids, held (per text), lengths (tokens per text), vocabulary (sorted hashes), tokens (places in it)."""

    def __init__(self, ids: pa.Array, words: pa.Array, lengths: np.ndarray, place: int):
        coded = words.dictionary_encode()
        hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()] + [_END], np.uint64)
        self.vocabulary, old = np.unique(hashes, return_inverse=True)
        self.ids, self.lengths = ids, lengths + 1
        self.held = np.array([is_held_out(i) for i in ids.to_pylist()], bool)
        ends = np.cumsum(self.lengths) - 1
        self.tokens = np.full(int(self.lengths.sum()), old[-1], np.uint32)
        inner = np.ones(len(self.tokens), bool)
        inner[ends] = False
        self.tokens[inner] = old[coded.indices.to_numpy(zero_copy_only=False)]
        self.text = np.repeat(np.arange(len(ids), dtype=np.uint32), self.lengths)
        name = xxhash.xxh64(self.vocabulary.tobytes(), place)
        name.update(self.lengths.tobytes())
        self.name = int(np.uint64(name.intdigest()).astype(np.int64))


def _chunk(ids: pa.Array, texts: pa.Array, place: int) -> Chunk:
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = split.offsets.to_numpy()
    return Chunk(ids, words.filter(full), np.diff(before[offsets - offsets[0]]), place)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    place = TaskContext.get().partitionId() << 24
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, "right")))
            texts = pa.concat_arrays([batch.column("text").slice(at, to - at)])  # a cast misreads the offsets of a slice
            texts = pc.fill_null(texts, "").cast(pa.large_string())
            yield _chunk(batch.column("id").slice(at, to - at), texts, place)
            place, at = place + 1, to
            pa.default_memory_pool().release_unused()


def _count_words(ranges: int):
    """(range, chunk, words): a chunk's hashes and training counts, cut by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            train = np.bincount(c.tokens[~c.held[c.text]], minlength=len(c.vocabulary)).astype(np.uint64)
            cuts = np.searchsorted(c.vocabulary, [(i << 64) // ranges for i in range(1, ranges)]) if ranges > 1 else []
            cuts = [0, *map(int, cuts), len(c.vocabulary)]
            blobs = [pack(c.vocabulary[a:b], train[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([c.name] * ranges, pa.int64()), pa.array(blobs, pa.binary())], ["range", "chunk", "words"])

    return run


def _vocabulary(pdf: pd.DataFrame) -> pd.DataFrame:
    """Number the words of one hash range: per chunk places and totals, and one row (chunk null) of tokens, types and counts of counts."""
    pdf = pdf.sort_values("chunk", kind="stable")
    parts = [unpack(b) for b in pdf["words"]]
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    totals = np.bincount(at, np.concatenate([p[1] for p in parts]).astype(np.float64), minlength=len(words)).astype(np.uint64)
    sizes = np.cumsum([len(p[0]) for p in parts])[:-1]
    blobs = [pack(np.diff(own, prepend=0).astype(np.uint32), totals[own]) for own in np.split(at, sizes)]
    stats = np.concatenate([[totals.sum(), (totals > 0).sum()], np.bincount(np.minimum(totals, CUT + 2).astype(np.int64), minlength=CUT + 3)[1 : CUT + 2]]).astype(np.uint64)
    range_ = int(pdf["range"].iloc[0])
    return pd.DataFrame({"range": range_, "chunk": pd.array([*pdf["chunk"], None], "Int64"), "known": [*blobs, pack(stats)]})


class Discounts:
    """Good-Turing factors for counts 1 to CUT from the counts of counts; absolute discounting where those don't fall in (0, 1)."""

    def __init__(self, counts: np.ndarray):
        n = np.concatenate([[0], counts.astype(np.float64)])
        r = np.arange(1, CUT + 1)
        self.factors = np.ones(CUT + 1)
        with np.errstate(all="ignore"):
            tail = (CUT + 1) * n[CUT + 1] / n[1]
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        if not (np.isfinite(d).all() and (d > 0).all() and (d < 1).all()):
            share = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            d = 1 - share / r
        self.factors[1:] = d

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > CUT, 1.0, self.factors[np.minimum(counts, CUT).astype(np.int64)])


class Unigrams:
    """Probability of a word by its training count; count 0 is the unknown word, which has all that the discounts leave."""

    def __init__(self, tokens: int, counts: np.ndarray):
        self.tokens, self.discounts = tokens, Discounts(counts)
        r = np.arange(1, CUT + 1)
        left = float((counts[:CUT] * r * (1 - self.discounts.factors[1:])).sum())
        self.scale = tokens if left > 0 else tokens + 1.0  # nothing rare to discount: one more token, unknown
        self.unknown = (left if left > 0 else 1.0) / self.scale if tokens else 1.0

    def of(self, totals: np.ndarray) -> np.ndarray:
        t = totals.astype(np.float64)
        return np.where(totals > 0, self.discounts.of(totals) * t / max(self.scale, 1.0), self.unknown)


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1]).astype(np.int64) if len(x) else np.zeros(0, np.int64)


def _bigrams(buckets: int, hot: int) -> Callable:
    """A chunk and what is known of its words to one row per bucket, and one (bucket -1 - chunk) of its texts."""

    def rows(name: int, lengths: np.ndarray, held: np.ndarray, tokens: np.ndarray, known: list[tuple[int, bytes]]) -> tuple[list, np.ndarray, np.ndarray]:
        parts = [(r, *unpack(b)) for r, b in sorted(known)]
        number = np.concatenate([(np.uint64(r) << np.uint64(32)) | np.cumsum(d, dtype=np.uint64) for r, d, _ in parts])
        total = np.concatenate([t for _, _, t in parts])
        ends = np.cumsum(lengths) - 1
        text = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
        before = np.empty_like(tokens)
        before[1:], before[0] = tokens[:-1], tokens[-1]  # what stands before a text is an end token
        size, texts = np.uint64(len(number)), np.uint64(len(lengths))
        if int(size) ** 2 * int(texts) >= 1 << 64:
            raise ValueError("a chunk is too large")
        key = before.astype(np.uint64)
        key *= size
        key += tokens
        key *= texts
        key += text
        key.sort()
        del before, text
        each = _runs(key)  # a bigram in a text
        times = np.diff(each, append=len(key)).astype(np.uint32)
        key = key[each]
        pair, text = key // texts, (key % texts).astype(np.uint32)
        del key
        own = _runs(pair)
        n_texts = np.diff(own, append=len(pair)).astype(np.uint32)
        count = np.add.reduceat(np.where(held[text], 0, times).astype(np.uint64), own) if len(own) else np.zeros(0, np.uint64)
        v, w = (pair[own] // size).astype(np.int64), (pair[own] % size).astype(np.int64)
        mix = number[v] * np.uint64(0x9E3779B97F4A7C15)
        mix = np.where(total[v] > hot, (mix ^ number[w]) * np.uint64(0xBF58476D1CE4E5B9), mix)
        bucket = ((mix >> np.uint64(33)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        made = []
        for b in range(buckets):
            mine = order[cuts[b] : cuts[b + 1]]
            if len(mine):
                at = np.repeat(own[mine] - np.concatenate([[0], np.cumsum(n_texts[mine])[:-1]]).astype(np.int64), n_texts[mine]) + np.arange(int(n_texts[mine].sum()))
                starts = _runs(v[mine])
                first = v[mine][starts]
                step = np.diff(number[w[mine]].view(np.int64), prepend=0)
                step[starts] = number[w[mine][starts]].view(np.int64)
                made.append((b, name, pack(number[first], total[first], np.diff(starts, append=len(mine)).astype(np.uint32), step.view(np.uint64), total[w[mine]], count[mine], n_texts[mine], text[at], times[at])))
        log = np.log10(total[tokens].astype(np.float64) + 1)
        return made, np.add.reduceat(log, np.concatenate([[0], ends[:-1] + 1])), np.add.reduceat((total[tokens] > 0).astype(np.int64), np.concatenate([[0], ends[:-1] + 1]))

    return rows


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket's bigrams summed.  Rows of texts (bucket below 0) pass."""
    if int(pdf["bucket"].iloc[0]) < 0:
        return pdf.assign(stats=None)[["bucket", "chunk", "data", "stats"]]
    pdf = pdf.sort_values("chunk", kind="stable")
    parts = [unpack(b) for b in pdf["data"]]
    vs, ws, tv, tw, counts = [], [], [], [], []
    for first, total, run, step, to, count, *_ in parts:
        starts = np.concatenate([[0], np.cumsum(run)[:-1]]).astype(np.int64)
        sums = np.cumsum(step.view(np.int64))
        sums -= np.repeat(sums[starts] - step.view(np.int64)[starts], run)
        vs.append(np.repeat(first, run))
        tv.append(np.repeat(total, run))
        ws.append(sums.view(np.uint64))
        tw.append(to)
        counts.append(count)
    v, w, tv, tw, counts = (np.concatenate(x) for x in (vs, ws, tv, tw, counts))
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    at = np.empty(len(v), np.int64)
    at[order] = np.cumsum(new) - 1
    own = np.flatnonzero(new)
    count = np.add.reduceat(counts[order], own)
    contexts = _runs(v[own])
    stats = np.bincount(np.minimum(count, CUT + 2).astype(np.int64), minlength=CUT + 3)[1 : CUT + 2].tolist()
    merged = [v[own][contexts], tv[order][own][contexts], np.diff(contexts, append=len(own)).astype(np.uint32), tw[order][own], count]
    held = []
    for place, (*_, n_texts, text, times) in zip(np.split(at, np.cumsum([len(x) for x in ws])[:-1]), parts, strict=True):
        held += [place.astype(np.uint32), n_texts, text, times]
    names = pdf["chunk"].to_numpy(np.int64).view(np.uint64)
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "chunk": [0], "data": [pack(names, *merged, *held)], "stats": [stats]})


def _sums(data: list[np.ndarray], unigrams: Unigrams, discounts: Discounts):
    """Of a bucket: contexts, their totals, run of each, shares and unigram probabilities of its bigrams, sums of both over seen ones."""
    _, v, tv, run, tw, count = data[:6]
    starts = np.concatenate([[0], np.cumsum(run)[:-1]]).astype(np.int64)
    share = discounts.of(count) * count / np.maximum(np.repeat(tv, run).astype(np.float64), 1.0)
    uni = unigrams.of(tw)
    seen = count > 0
    return v, tv, run, share, uni, seen, np.add.reduceat(np.where(seen, share, 0.0), starts), np.add.reduceat(np.where(seen, uni, 0.0), starts)


def _shares(unigrams: Unigrams, discounts: Discounts, hot: int, hot_names: np.ndarray, hot_shares: np.ndarray, hot_unis: np.ndarray):
    """Per bucket and chunk the sums of log10 probabilities by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, blobs = [], []
            for blob in batch.column("data"):
                data = unpack(blob.as_py())
                v, tv, run, share, uni, seen, s, u = _sums(data, unigrams, discounts)
                is_hot = np.flatnonzero(tv > hot)
                if len(is_hot):
                    at = np.searchsorted(hot_names, v[is_hot])
                    s[is_hot], u[is_hot] = hot_shares[at], hot_unis[at]
                full = s > 1 - 1e-12  # no count that is discounted: the context gives up one more token instead
                scale = np.where(full, tv / (tv + 1.0), 1.0)
                with np.errstate(divide="ignore"):
                    back = np.where(tv > 0, np.log10((1 - s * scale) / (1 - u)), 0.0)
                    logs = np.where(seen, np.log10(share * np.repeat(scale, run)), np.repeat(back, run) + np.log10(uni))
                for i, name in enumerate(data[0].view(np.int64).tolist()):
                    place, n_texts, text, times = data[6 + 4 * i : 10 + 4 * i]
                    each = np.bincount(text, np.repeat(logs[place], n_texts) * times)
                    which = np.unique(text)
                    chunks.append(name)
                    blobs.append(pack(which, each[which]))
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "data"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (Katz)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    tokens_about = rows.select(F.sum(F.length("text") / 5)).first()[0] or 0.0
    ranges = int(tokens_about / 8 // RANGE_WORDS) + 1
    buckets = int(tokens_about // BUCKET_BIGRAMS) + 1
    counted = rows.mapInArrow(_count_words(ranges), "range int, chunk long, words binary")
    known = materialize(counted.groupBy("range").applyInPandas(_vocabulary, "range int, chunk long, known binary"), "lm-words")
    stats = [unpack(bytes(r.known))[0] for r in known.where("chunk IS NULL").select("known").collect()]  # a few numbers a range
    stats = sum(stats) if stats else np.zeros(CUT + 3, np.uint64)
    tokens, types = int(stats[0]), int(stats[1])
    unigrams = Unigrams(tokens, stats[2:].astype(np.int64))
    hot = tokens // (4 * buckets) + 1

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            data = pack(c.lengths.astype(np.uint32), c.held.astype(np.uint8), c.tokens)
            ids = pa.ListArray.from_arrays(pa.array([0, len(c.ids)], pa.int32()), c.ids)
            yield pa.RecordBatch.from_arrays([pa.array([c.name], pa.int64()), ids, pa.array([data], pa.binary())], ["chunk", "ids", "data"])

    chunk_rows = _bigrams(buckets, hot)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                lengths, held, coded = unpack(batch.column("data")[r].as_py())
                words = batch.column("known")[r].as_py()
                if words is None:
                    raise RuntimeError("the rows of the input came in other batches when read again; write them to a table first")
                made, logs, n_known = chunk_rows(batch.column("chunk")[r].as_py(), lengths.astype(np.int64), held.astype(bool), coded, [(x["range"], x["known"]) for x in words])
                name = batch.column("chunk")[r].as_py()
                of_texts = pack(lengths, held, n_known.astype(np.uint32), logs)
                cols = [[-1, *(m[0] for m in made)], [name, *(m[1] for m in made)], [of_texts, *(m[2] for m in made)]]
                none = pa.array([batch.column("ids")[r].as_py(), *[None] * len(made)], batch.column("ids").type)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), none], ["bucket", "chunk", "data", "ids"])

    by_chunk = known.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("range", "known")).alias("known"))  # one row of each range
    coded = rows.mapInArrow(texts_of, f"chunk long, ids array<{id_type}>, data binary").join(by_chunk, "chunk", "left")
    paired = coded.mapInArrow(pairs, f"bucket int, chunk long, data binary, ids array<{id_type}>")
    # Rows of texts form groups of their own, one per chunk, so that they spread.
    group = F.when(F.col("bucket") < 0, F.struct(F.lit(-1).alias("b"), F.col("chunk").alias("c"))).otherwise(F.struct(F.col("bucket").alias("b"), F.lit(0).cast("long").alias("c")))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["ids"] if int(pdf["bucket"].iloc[0]) < 0 else None
        out = _merge(pdf)
        return out.assign(ids=list(ids) if ids is not None else [None] * len(out))

    table = paired.withColumn("group", group).groupBy("group").applyInPandas(lambda pdf: merge(pdf), f"bucket int, chunk long, data binary, stats array<long>, ids array<{id_type}>")
    table = materialize(table, "lm-bigrams")
    bigrams = table.where("bucket >= 0").select("bucket", "data")
    seen = table.where("bucket >= 0").select([F.sum(F.get("stats", F.lit(i))).alias(f"n{i}") for i in range(CUT + 1)]).first()
    discounts = Discounts(np.array([x or 0 for x in seen], np.int64))

    def hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("data"):
                v, tv, _, _, _, _, s, u = _sums(unpack(blob.as_py()), unigrams, discounts)
                is_hot = tv > hot
                yield pa.RecordBatch.from_arrays([pa.array(v[is_hot].view(np.int64)), pa.array(s[is_hot]), pa.array(u[is_hot])], ["v", "s", "u"])

    # Fewer than 4 * buckets contexts have more than tokens / (4 * buckets) tokens each.
    of_hot = bigrams.select("data").mapInArrow(hot_sums, "v long, s double, u double").groupBy("v").agg(F.sum("s"), F.sum("u")).collect()
    of_hot = sorted((int(np.int64(v).view(np.uint64)), s, u) for v, s, u in of_hot)
    hot_names = np.array([x[0] for x in of_hot], np.uint64)
    hot_shares, hot_unis = (np.array([x[k] for x in of_hot], np.float64) for k in (1, 2))
    shares = bigrams.select("data").mapInArrow(_shares(unigrams, discounts, hot, hot_names, hot_shares, hot_unis), "chunk long, data binary")
    base = np.log10(tokens + types + 1.0)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["ids"].notna()].iloc[0]
        lengths, held, n_known, logs = unpack(own["data"])
        total = np.zeros(len(lengths))
        for blob in pdf[pdf["ids"].isna()]["data"]:
            which, part = unpack(blob)
            total[which] += part
        n = lengths.astype(np.int64)
        return pd.DataFrame({"id": list(own["ids"]), "held_out": held.astype(bool), "n_tokens": n, "n_known": n_known.astype(np.int64), "train_tokens": tokens, "base_score": logs - n * base, "score": total})

    of_texts = table.where("bucket < 0").select("chunk", "data", "ids")
    gathered = shares.withColumn("ids", F.lit(None).cast(f"array<{id_type}>")).unionByName(of_texts).groupBy("chunk")
    out = gathered.applyInPandas(gather, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
