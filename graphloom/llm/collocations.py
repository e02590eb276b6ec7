"""Phrase collocation mining: phrases that occur much more often than their parts would by chance, per language.

Chunks of texts are tokenised where they lie; a chunk keeps its words by numbers of its own.  Words that are frequent in their language get
numbers in one dictionary, which reaches the chunks by an equi-join on (language, word), one row for each chunk and word - it is not
broadcast, so it may be of any size.  All other words break their pieces.  Runs of m numbers are packed into keys of fixed width, sorted by
radix and counted by run length inside the chunk; the sorted keys are cut into ranges of the key space, which Spark deals out, and a task
sorts and counts one range at a time.  A key arrives once from each chunk that has it, so neither a common phrase nor a common line is a hot key.

Longer runs are packed only where both runs of m - 1 words inside them may be frequent, told by a filter of fixed size; what passes it is counted exactly.

Defined results: a null text is empty, a null language is `und`; repeated rows count as often as they are there; the result has at most `top` rows a language.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FILTER_BITS, bitmap, drop_table, materialize, numbered, tidy, write_table

MAX_WORDS, MIN_COUNT, CONTAINED_PERCENT, TOP = 3, 10, 50, 2000
#: Bytes of text that a chunk has before it is cut at the next break, and that are split into words at a time.
CHUNK_BYTES, SLICE_BYTES = 4 << 20, 1 << 20
#: Keys that a range of the key space shall have; most ranges there are (their bounds go to every task).
RANGE_KEYS, MAX_RANGES = 1 << 21, 1 << 18
#: Chunks and keys of each from which the ranges' bounds are taken.  They decide how even the ranges are, and no result.
BOUND_CHUNKS, BOUND_KEYS = 64, 4096

_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bytes in lower case, every break as a full stop, tabs as spaces.
_TABLE = bytes(0x2E if c in _BREAKS else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Numbers(dict):
    """Word to number, from 1 in order of appearance; the full stop is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: str) -> Iterator[list[bytes]]:
    """The words of a text in lower case, with a full stop wherever a piece ends; in slices that hold whole words."""
    raw = text.encode().translate(_TABLE)
    at = 0
    while at < len(raw):
        end = at + SLICE_BYTES
        if end < len(raw):
            near = max(raw.rfind(b" ", at, end), raw.rfind(b".", at, end))
            if near < 0:  # a word longer than a slice
                later = [x for x in (raw.find(b" ", end), raw.find(b".", end)) if x >= 0]
                near = min(later, default=len(raw) - 1)
            end = near + 1
        yield raw[at:end].replace(b".", b" . ").split()
        at = end


class _Chunk:
    def __init__(self) -> None:
        self.numbers, self.parts, self.bytes = _Numbers({b".": 0}), [], 0

    def add(self, text: str) -> None:
        for words in tokens(text):
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.bytes += len(text)

    def row(self, lang: str) -> dict:
        ids = np.concatenate(self.parts)
        words = list(self.numbers)[1:]
        counts = np.bincount(ids, minlength=len(self.numbers))[1:]
        wide = len(self.numbers) > 0xFFFF
        return {"lang": lang, "wide": wide, "tokens": ids.astype("<u4" if wide else "<u2").tobytes(), "total": int(counts.sum()), "words": words, "counts": counts}


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to chunks of one language; a chunk ends at the end of a text."""

    def out(lang: str, chunk: _Chunk) -> pa.RecordBatch:
        row = chunk.row(lang)
        n = len(row["words"])
        lists = lambda values: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)
        words = pa.array(row["words"], pa.binary()).cast(pa.string())
        columns = [pa.array([row["lang"]]), pa.array([row["wide"]]), pa.array([row["tokens"]], pa.binary()), pa.array([row["total"]], pa.int64()), lists(words), lists(pa.array(row["counts"], pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "wide", "tokens", "total", "words", "counts"])

    held: dict[str, _Chunk] = {}
    size = 0
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text")
        for i, lang in enumerate(langs):
            text = texts[i].as_py()
            if not text:
                continue
            chunk = held.setdefault(lang, _Chunk())
            size -= chunk.bytes
            chunk.add(text)
            size += chunk.bytes
            if chunk.bytes >= CHUNK_BYTES:
                size -= chunk.bytes
                yield out(lang, held.pop(lang))
            elif size >= 2 * CHUNK_BYTES:  # very many languages in one task
                for x in list(held):
                    yield out(x, held.pop(x))
                size = 0
    for lang in list(held):
        yield out(lang, held.pop(lang))


def _renumbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their frequent words' numbers (places, ids) to (chunk, ids): the dictionary's numbers in text order, 0 where a piece breaks."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pydict()
            raw = np.frombuffer(row["tokens"][0], "<u4" if row["wide"][0] else "<u2")
            to = np.zeros(int(row["size"][0]) + 1, np.int64)
            to[np.asarray(row["places"][0] or [], np.int64)] = np.asarray(row["ids"][0] or [], np.int64)
            ids = to[raw]
            some = (ids > 0) | (np.concatenate([[0], ids[:-1]]) > 0)  # one break after another says nothing
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(row["chunk"], pa.int64()), "ids": pa.array([ids[some].astype("<u4").tobytes()], pa.binary())})


def mixed(parts: list, modulus: int = FILTER_BITS) -> object:
    """A hash of numbers, the same for columns and for arrays, below `modulus`."""
    h = parts[0] % modulus
    for p in parts[1:]:
        h = (h * 1_000_003 + p) % modulus
    return h


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The order of keys of one or more 64-bit words, the first one counts most: least digit first, 16 bits at a time, each pass a stable radix sort."""
    order = None
    for word in reversed(words):
        top = int(word.max(initial=0))
        for shift in range(0, max(1, top.bit_length()), 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            step = np.argsort(digit if order is None else digit[order], kind="stable")
            order = step if order is None else order[step]
    return order


def runs(words: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys in order, each once, with the sum of its counts (1 where none are given)."""
    n = len(words[0])
    if not n:
        return words, np.zeros(0, np.int64)
    order = radix_order(words)
    words = [w[order] for w in words]
    new = np.ones(n, bool)
    new[1:] = np.any([w[1:] != w[:-1] for w in words], axis=0)
    starts = np.flatnonzero(new)
    sums = np.diff(np.append(starts, n)) if counts is None else np.add.reduceat(counts[order], starts)
    return [w[starts] for w in words], sums


class Packing:
    """Fixed-width keys of m numbers, each of `bits` bits, in as few 64-bit words as they need."""

    def __init__(self, m: int, top: int) -> None:
        self.m, self.bits = m, max(1, top.bit_length())
        self.per = min(m, 64 // self.bits)
        self.n_words = -(-m // self.per)

    def pack(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for w in range(0, self.m, self.per):
            key = np.zeros(len(columns[0]), np.uint64)
            for c in columns[w : w + self.per]:
                key = (key << np.uint64(self.bits)) | c.astype(np.uint64)
            out.append(key)
        return out

    def unpack(self, words: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for w, word in enumerate(words):
            n = min(self.per, self.m - w * self.per)
            mask = np.uint64((1 << self.bits) - 1)
            out += [((word >> np.uint64(self.bits * (n - 1 - i))) & mask).astype(np.int64) for i in range(n)]
        return out


def _planes(values: np.ndarray) -> bytes:
    """A column's bytes plane by plane; in sorted keys the upper planes hardly change, which Spark's compression then finds."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _keys(raw: bytes, packing: Packing, found: bytes | None) -> list[np.ndarray]:
    """Packed keys of all runs of m numbers without a break whose parts of m - 1 numbers are in the filter."""
    ids = np.frombuffer(raw, "<u4").astype(np.int64)
    n, m = len(ids) - packing.m + 1, packing.m
    if n <= 0:
        return [np.zeros(0, np.uint64) for _ in range(packing.n_words)]
    whole = np.ones(n, bool)
    for k in range(m):
        whole &= ids[k : k + n] > 0
    if found is not None:
        shorter = mixed([ids[k : k + n + 1] for k in range(m - 1)])
        listed = (np.frombuffer(found, np.uint8)[shorter >> 3] >> (shorter & 7).astype(np.uint8) & 1).astype(bool)
        whole &= listed[:-1] & listed[1:]
    at = np.flatnonzero(whole)
    return packing.pack([ids[at + k] for k in range(m)])


def _counted(encoded: DataFrame, m: int, top_id: int, n_tokens: int, n_chunks: int, found: bytes | None, least: int) -> DataFrame:
    """(ids array, n): runs of m frequent words that occur `least` times or more."""
    spark = encoded.sparkSession
    packing = Packing(m, top_id)
    shared = spark.sparkContext.broadcast(found)  # 8 MB

    def of(raw: bytes) -> tuple[list[np.ndarray], np.ndarray]:
        return runs(_keys(raw, packing, shared.value), None)

    def bounding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                words, _ = of(raw)
                some = slice(None, None, max(1, -(-len(words[0]) // BOUND_KEYS)))
                yield pa.RecordBatch.from_pydict({f"k{i}": pa.array(w[some].astype(np.int64)) for i, w in enumerate(words)})

    names = [f"k{i}" for i in range(packing.n_words)]
    sample = encoded.where(F.pmod(F.xxhash64("chunk"), F.lit(max(1, n_chunks // BOUND_CHUNKS))) == 0)
    seen = sorted(tuple(x % (1 << 64) for x in r) for r in sample.mapInArrow(tidy(bounding), ", ".join(f"{n} long" for n in names)).collect())
    ranges = min(MAX_RANGES, max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_tokens // RANGE_KEYS))
    bounds = sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                words, counts = of(raw)
                if not len(counts):
                    continue
                if packing.n_words == 1:
                    cuts = np.searchsorted(words[0], np.array([b[0] for b in bounds], np.uint64))
                else:
                    cuts = np.array([bisect.bisect_left(_Rows(words), b) for b in bounds], np.int64)
                edges = np.concatenate([[0], cuts, [len(counts)]]).astype(np.int64)
                rows = [(r, edges[r], edges[r + 1]) for r in np.flatnonzero(edges[1:] > edges[:-1])]
                part = {"range": pa.array([int(r) for r, _, _ in rows], pa.int32()), "n": pa.array([_planes(counts[i:j]) for _, i, j in rows], pa.binary())}
                yield pa.RecordBatch.from_pydict(part | {n: pa.array([_planes(w[i:j]) for _, i, j in rows], pa.binary()) for n, w in zip(names, words, strict=True)})

    dealt = encoded.mapInArrow(tidy(deal), f"range int, n binary, {', '.join(f'{n} binary' for n in names)}")
    ordered = dealt.repartition("range").sortWithinPartitions("range")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0

        def one(parts: list) -> tuple[list[np.ndarray], np.ndarray]:
            words = [np.concatenate([p[0][i] for p in parts]) for i in range(packing.n_words)]
            return runs(words, np.concatenate([p[1] for p in parts]))

        def flush(parts: list) -> pa.RecordBatch:
            words, sums = one(parts)
            some = sums >= least
            return pa.RecordBatch.from_pydict({f"i{k}": pa.array(c) for k, c in enumerate(packing.unpack([w[some] for w in words]))} | {"n": pa.array(sums[some].astype(np.int64))})

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if held and row["range"] != at:
                    yield flush(held)
                    held, size = [], 0
                at = row["range"]
                counts = _unplaned(row["n"]).astype(np.int64)
                held.append(([_unplaned(row[n]) for n in names], counts))
                size += len(counts)
                if size > 4 * RANGE_KEYS:  # what repeats is put together before more is taken
                    held = [one(held)]
                    size = len(held[0][1])
        if held:
            yield flush(held)

    ids = [f"i{k}" for k in range(m)]
    return ordered.mapInArrow(tidy(merge), f"{', '.join(f'{i} long' for i in ids)}, n long").select(F.array(*ids).alias("ids"), "n")


class _Rows:
    """Keys of several words as a sequence of tuples, for bisection."""

    def __init__(self, words: list[np.ndarray]) -> None:
        self.words = words

    def __len__(self) -> int:
        return len(self.words[0])

    def __getitem__(self, i: int) -> tuple[int, ...]:
        return tuple(int(w[i]) for w in self.words)


def _part(ids: Column, first: int, n: int) -> Column:
    return F.slice(ids, first, n)


def scored(grams: DataFrame) -> DataFrame:
    """(ids, a, l, r, score) of all phrases of two words and more: the cut with the lowest floor(1000000 a a / (l r)), the first of equal ones.

    grams: (ids, n) of all frequent runs, single words among them.  Decimals of 38 digits hold the products exactly up to counts of 10^16.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda k: F.struct(k.alias("k"), _part(F.col("ids"), 1, k).alias("first"), _part(F.col("ids"), k + 1, F.size("ids") - k).alias("rest")))
    cut = grams.where(F.size("ids") > 1).select("ids", F.col("n").alias("a"), F.explode(cuts).alias("c")).select("ids", "a", "c.*")
    with_l = cut.join(grams.select(F.col("ids").alias("first"), F.col("n").alias("l")), "first")
    both = with_l.join(grams.select(F.col("ids").alias("rest"), F.col("n").alias("r")), "rest")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    best = F.min(F.struct("score", "k", "l", "r"))
    return both.withColumn("score", _floor_ratio(wide("a"), wide("l"), wide("r"))).groupBy("ids", "a").agg(best.alias("b")).select("ids", "a", "b.l", "b.r", "b.score")


def _floor_ratio(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), exact."""
    top = (a * a).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, (l * r).cast("decimal(38,0)"))


def _survivors(phrases: DataFrame, percent: int) -> DataFrame:
    """Without those whose words lie inside a longer phrase that occurs at least percent/100 times as often."""
    n = F.size("ids")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: _part(F.col("ids"), i, m))))
    around = phrases.where(n > 2).select(F.explode(inner).alias("ids"), F.col("a").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    return phrases.join(around, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, percent: int = CONTAINED_PERCENT, top: int = TOP) -> DataFrame:
    """Each language's first `top` phrases of 2 to max_words words: lang, rank, phrase, a, l, r, n, score.

    a, l, r: occurrences of the phrase and of the parts of its cut, n: words of the language.  Order: score and a descending, phrase ascending by bytes.
    """
    spark = docs.sparkSession
    short = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    cut_path = write_table(short.mapInArrow(tidy(_chunked), "lang string, wide boolean, tokens binary, total long, words array<string>, counts array<long>").withColumn("chunk", F.monotonically_increasing_id()), "phrase-chunks")
    chunks = spark.read.parquet(cut_path)
    totals = materialize(chunks.groupBy("lang").agg(F.sum("total").alias("total"), F.count("*").alias("chunks")), "phrase-totals")
    seen = totals.agg(F.sum("total").alias("n"), F.sum("chunks").alias("chunks")).first()
    n_tokens, n_chunks = seen.n or 0, seen.chunks or 0
    listed = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    dictionary = materialize(numbered(listed.where(F.col("n") >= min_count), "phrase-words", "id").withColumn("id", F.col("id") + 1), "phrase-dictionary")
    top_id = dictionary.agg(F.max("id")).first()[0] or 0
    if top_id >= 1 << 32:
        raise ValueError("the dictionary's numbers have 32 bits")
    own = chunks.select("chunk", "lang", F.posexplode("words").alias("place", "word")).join(dictionary.select("lang", "word", "id"), ["lang", "word"])
    maps = own.groupBy("chunk").agg(F.collect_list(F.struct((F.col("place") + 1).alias("place"), "id")).alias("m")).select("chunk", F.col("m.place").alias("places"), F.col("m.id").alias("ids"))
    told = chunks.select("chunk", "wide", "tokens", F.size("words").alias("size")).join(maps, "chunk")
    code_path = write_table(told.mapInArrow(tidy(_renumbered), "chunk long, ids binary"), "phrase-ids")
    drop_table(spark, cut_path)
    encoded = spark.read.schema("chunk long, ids binary").parquet(code_path)
    grams, found = [dictionary.select(F.array("id").alias("ids"), "n")], None
    for m in range(2, max_words + 1):
        counted = materialize(_counted(encoded, m, top_id, n_tokens, n_chunks, found, min_count), "phrase-grams")
        grams.append(counted)
        if m < max_words:
            found = bitmap(counted, mixed([F.col("ids")[k] for k in range(m)]))
    drop_table(spark, code_path)
    every = grams[0]
    for g in grams[1:]:
        every = every.unionAll(g)
    left = _survivors(scored(every), percent)
    of = dictionary.select(F.col("id").alias("first_id"), "lang")
    left = materialize(left.withColumn("first_id", F.col("ids")[0]).join(of, "first_id").drop("first_id"), "phrase-scored")
    by = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    near = left.withColumn("place", F.rank().over(by)).where(F.col("place") <= top).drop("place")
    words = near.select("ids", F.posexplode("ids").alias("k", "id")).join(dictionary.select("id", "word"), "id")
    phrase = words.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("w")).select("ids", F.array_join(F.col("w.word"), " ").alias("phrase"))
    exact = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = near.join(phrase, "ids").withColumn("rank", F.row_number().over(exact).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals.select("lang", F.col("total").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
