"""Importance resampling towards a target: documents drawn without replacement by hashed n-gram weights and Gumbel noise.

Runs of words fall into buckets by CRC-32.  A bucket's gain compares its share of the target's features with that of all documents; the
gains are one array of a fixed length, which scores every document where it lies.  The draw takes the k highest scores.  The k-th key is
found without a sort: the composite of score and id is read as digits, most significant first, and each round counts the rows that agree
with the digits found so far by their next digit (2^DIGIT_BITS counts at most reach the driver).  Only drawn rows are sorted by range and ranked.

Defined results: a null text has no features and weighs 0; a null id is hashed as an empty string and comes last among equal scores; rows with
equal score and id are drawn in an order of n_features and weight, and those that are equal in these too can't be told apart.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, tidy, write_table

BUCKETS, MAX_RUN, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Bits of a digit of the selection.
DIGIT_BITS = 12
#: Bytes of text that are split into words at a time, and of words whose buckets a task remembers.
SLICE_BYTES, MEMORY_BYTES = 1 << 20, 32 << 20

#: Bytes in lower case; those that no word has become spaces: ASCII but letters and digits.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Buckets(dict):
    """Feature to bucket; forgets all when it holds MEMORY_BYTES."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets, self.size = buckets, 0

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        self.size += len(feature) + 150
        if self.size > MEMORY_BYTES:
            self.clear()
            self.size = 0
        if len(feature) < 1000:
            self[feature] = bucket
        return bucket


def _slices(text: str) -> Iterator[list[bytes]]:
    """The words of a text, in slices of whole words."""
    raw = text.encode().translate(_TABLE)
    at = 0
    while at < len(raw):
        end = at + SLICE_BYTES
        if end < len(raw):
            near = raw.rfind(b" ", at, end)
            near = raw.find(b" ", end) if near < 0 else near
            end = len(raw) if near < 0 else near + 1
        yield raw[at:end].split()
        at = end


def features(text: str | None, buckets: _Buckets, max_run: int) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to max_run consecutive words of a text, repeats included, in parts."""
    before: list[bytes] = []
    for words in _slices(text or ""):
        yield np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
        if max_run > 1:
            whole = before + words
            for n in range(2, max_run + 1):
                first = max(0, len(before) - n + 1)  # runs that end in this part
                found = [buckets[b" ".join(whole[i : i + n])] for i in range(first, len(whole) - n + 1)]
                yield np.array(found, np.int64)
            before = whole[-(max_run - 1) :]


def bucket_counts(texts: DataFrame, text: str, buckets: int, max_run: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks make one array each, and `buckets` sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sums = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                for part in features(x.as_py(), cache, max_run):
                    sums += np.bincount(part, minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(sums[some])})

    found = texts.select(F.col(text).cast("string")).mapInArrow(tidy(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, in doubles."""
    n, (all_s, all_t) = len(source), (int(source.sum()), int(target.sum()))
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (all_s + n) / ((int(s) + 1) * (all_t + n)))) for s, t in zip(source, target, strict=True)], np.int64)


def noise(id: object, seed: str) -> int:
    """Gumbel noise of an id in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, id: str, text: str, max_run: int, seed: str, columns: list[str]) -> DataFrame:
    """Columns of docs with n_words, n_features, weight and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(gain)  # one number a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, table = _Buckets(len(shared.value)), shared.value
        for batch in batches:
            n, words, weights = [], [], []
            for x in batch.column("__text"):
                value, total, weight = x.as_py(), 0, 0
                single = 0
                for k, part in enumerate(features(value, cache, max_run)):
                    total, weight = total + len(part), weight + int(table[part].sum())
                    single += len(part) if k % max_run == 0 else 0
                n.append(total)
                words.append(single)
                weights.append(weight)
            scores = [w + noise(i.as_py(), seed) for w, i in zip(weights, batch.column("__id"), strict=True)]
            numbers = {"n_words": words, "n_features": n, "weight": weights, "score": scores}
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(v, pa.int64()) for v in numbers.values())], ["row", *numbers])

    row = T.StructType([docs.schema[c] for c in columns])
    schema = T.StructType([T.StructField("row", row), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(id).cast("string").alias("__id"), F.col(text).cast("string").alias("__text"))
    return whole.mapInArrow(tidy(score), schema)


def _kth(rows: DataFrame, part: str, k: int) -> tuple[int, int]:
    """The k-th smallest value (k from 1) of a non-negative long column, and how many rows are below it; by radix, digits from the top."""
    top = rows.agg(F.max(part)).first()[0]
    digits = -(-max(1, int(top).bit_length()) // DIGIT_BITS)
    found, below = 0, 0
    for d in range(digits - 1, -1, -1):
        shift = d * DIGIT_BITS
        same = rows if d == digits - 1 else rows.where(F.shiftright(part, shift + DIGIT_BITS) == found)
        counts = same.groupBy(F.shiftright(part, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).alias("digit")).count().collect()
        for digit, n in sorted(tuple(r) for r in counts):
            if below + n >= k:
                found = found << DIGIT_BITS | digit
                break
            below += n
    return found, below


def _drawn(scored: DataFrame, parts: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """(the first k rows in the order of `parts`, all others): each part is selected among rows that are equal in the parts before it.

    Rows that are equal in all parts are told apart by a number in the order of the written table's files.
    """
    taken, left, open_rows = [], [], scored
    for part in parts:
        if k <= 0:
            break
        value, below = _kth(open_rows, part, k)
        taken.append(open_rows.where(F.col(part) < value))
        left.append(open_rows.where(F.col(part) > value))
        open_rows, k = open_rows.where(F.col(part) == value), k - below
        if open_rows.count() == k:
            taken.append(open_rows)
            return _union(taken, scored), _union(left, scored)
    if k > 0:  # rows that can't be told apart
        path_order = numbered(open_rows, "equal-rows", "__at")
        taken.append(path_order.where(F.col("__at") < k).drop("__at"))
        left.append(path_order.where(F.col("__at") >= k).drop("__at"))
    else:
        left.append(open_rows)
    return _union(taken, scored), _union(left, scored)


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.limit(0) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", columns: list[str] | None = None, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_run: int = MAX_RUN, seed: str = SEED) -> DataFrame:
    """Rows of docs (or their `columns`) with n_features, weight, score and rank: 1, 2, 3, ... in the order of the draw, null where not drawn.

    Of the N rows with at least min_words words, floor(percent N / 100) with the highest scores are drawn, of equal scores those with the
    smaller id, a whole number.  Results replace columns of the same names.
    """
    spark: SparkSession = docs.sparkSession
    results = ["n_features", "weight", "score", "rank"]
    kept = [c for c in (columns or docs.columns) if c not in results]
    if id not in kept:
        raise ValueError(f"the columns must hold the id {id}")
    gain = gains(bucket_counts(docs, text, buckets, max_run), bucket_counts(target, target_text, buckets, max_run))
    rows = weighed(docs, gain, id, text, max_run, seed, kept)
    path = write_table(rows, "resample-scored")
    scored = spark.read.schema(rows.schema).parquet(path).withColumn("__id", F.col(f"row.`{id}`").cast("long"))
    eligible = scored.where(F.col("n_words") >= min_words)
    seen = eligible.agg(F.count("*").alias("n"), F.max("score").alias("score"), F.min("__id").alias("low"), F.max("n_features").alias("features"), F.max("weight").alias("weight")).first()
    k = percent * seen.n // 100
    if not k:
        return scored.select("row.*", *results[:3], F.lit(None).cast("long").alias("rank"))
    # Parts of the composite key, all from 0 up in the order of the draw; an id may be any long, so it has a sign and a lower part.
    keyed = eligible.withColumns({
        "k0": F.lit(seen.score) - F.col("score"), "k1": F.when(F.col("__id").isNull(), 2).when(F.col("__id") >= 0, 1).otherwise(0).cast("long"),
        "k2": F.coalesce(F.col("__id").bitwiseAND(F.lit((1 << 63) - 1)), F.lit(0)), "k3": F.lit(seen.features) - F.col("n_features"), "k4": F.lit(seen.weight) - F.col("weight"),
    })
    order = ["k0", "k1", "k2", "k3", "k4"]
    drawn, others = _drawn(keyed, order, k)
    ranked = numbered(drawn.repartitionByRange(*order).sortWithinPartitions(*order), "resample-drawn", "at")
    names = ["row", *results[:3]]
    out = ranked.select(*names, (F.col("at") + 1).alias("rank"))
    none = F.lit(None).cast("long").alias("rank")
    rest = others.select(*names, none).unionAll(scored.where(F.col("n_words") < min_words).select(*names, none))
    return out.unionAll(rest).select("row.*", *results)
