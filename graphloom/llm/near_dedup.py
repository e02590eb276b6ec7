"""Near-duplicate removal: texts whose five-word shingles are alike by 0.8 or more, every such pair found.

Two ways find candidates, and every link is verified on all shingles of both texts before components are formed.

First the SimHash operator: texts whose fingerprints link by their Golay keys, and with them every text is tried against the
one text that has one of its early shingles earliest.  This joins copies, of large groups too, by as many tries as texts.
Fingerprints alone would miss many pairs at 0.8 (they differ in some ten bits of 64), so the exact way handles the rest: in one order of all
shingles, two sets of n and m shingles that are alike by t share one among the first n - ceil(tn) + 1 of the one and
m - ceil(tm) + 1 of the other.  Shingles that a sample finds common come last in that order; any order loses no pair, this
one keeps keys small.  All pairs of such a key that are still in different components are compared, in cells where the
key is a hot one, and the join itself leaves out pairs whose parities show that they differ in too many shingles, and those of a key that lies too far
behind in either set to be the first one that alike sets share, or that follows another key of both: of an alike pair the first
shared key remains.  A pair's sketches must reach t too: counts of the shingles by
hash, about two to a byte, whose smaller ones add up to at least what the sets have in common.  Only pairs that pass are compared shingle by shingle.

Texts are not shuffled for this: the shingle sets that are to be compared are made where the text lies, told by a filter of bounded
size over their classes, and the rows to remove are told by the same kind of filter before an exact join.

Defined results: texts with equal words (A-Z in lower case, white space aside) are one class from the start, empty and null
texts too; the document with the smallest id of a component stays; of repeated rows with one id and equal words one stays; rows with
a null id are compared among themselves only, as whole texts; extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import or_
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, bitmap, in_bitmap, lookup_join, materialize, parted, sample_rows, tidy
from .components import components
from .simhash import SEED, fold, links, shingle_hashes

#: Documents, about, whose shingles are counted for the order, and how many of the most common ones the order knows.
SAMPLE, COMMON = 4_000, 500_000
#: Texts of a key in one cell.
CELL = 1_000
#: Turns in which every component is tried against a larger one before pairs are formed.
TURNS = 1
#: Shared early shingles before each in its set that the join looks at: a pair that has one of them in common meets there.
BEFORE = 3
#: 64-bit words of parity that every set of shingles has for the join's own test.
PARITY = 4


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _class(words: list[bytes]) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))


def _set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes).view(np.int64)


def sketch(own: np.ndarray) -> bytes | None:
    """Counts of a set's hashes by their low bits, a byte each, half as many or more as hashes; None if a byte is too small."""
    counts = np.bincount(own & ((1 << (len(own) // 2).bit_length()) - 1), minlength=1 << (len(own) // 2).bit_length())
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def parity(own: np.ndarray) -> np.ndarray:
    """PARITY words of bits, each told by whether an odd number of the set's hashes fall on it: two sets differ in at least as many members as bits."""
    counts = np.bincount((own.view(np.uint64) >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def most_common(a: bytes, b: bytes) -> tuple[int, int]:
    """(the most shingles that two sets can have in common, the number of both together), by their sketches."""
    x, y = sorted((np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)), key=len)
    return int(np.minimum(x, y.reshape(-1, len(x)).sum(axis=0)).sum()), int(x.sum() + y.sum())


def early(n: int, similarity: float) -> int:
    """Shingles of a set of n, the first in order, of which one is shared with every set alike by `similarity`."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _order(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ranks) of the shingles that stand in two or more documents of a sample: the commoner, the later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(_set(shingle_hashes(_words(t.as_py()), shingle)), pa.int64())], ["s"])

    counted = sample_rows(rows, ["text"], SAMPLE).mapInArrow(tidy(run), "s long").groupBy("s").agg(F.count("*").alias("n"))
    found = counted.where("n > 1").orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    s, n = found.column("s").to_numpy(), found.column("n").to_numpy()
    at = np.argsort(s)
    return s[at], n[at]


def _marks(shingle: int, similarity: float, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = order.value
        for batch in batches:
            cls, fps, sizes, firsts, sketches, bits = [], [], [], [], [], []
            for t in batch.column("text"):
                words = _words(t.as_py())
                hashes = shingle_hashes(words, shingle)
                own = _set(hashes)
                fps.append(fold(hashes))
                rank = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, ranks[at], 0)
                cls.append(_class(words))
                sizes.append(len(own))
                sketches.append(sketch(own))
                bits.append(parity(own))
                firsts.append(own[np.lexsort((own, rank))][: early(len(own), similarity)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cls, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], ["id", "class", "fp", "size", "firsts", "sketch", "bits"])

    return run


def _shingles(shingle: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = wanted.value
        for batch in batches:
            cls, sets = [], []
            for t in batch.column("text"):
                words = _words(t.as_py())
                c = _class(words)
                if in_bitmap(found, c):
                    cls.append(c)
                    sets.append(_set(shingle_hashes(words, shingle)))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["class", "shingles"])

    return run


def _enough(met: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of pairs (u, v, a, b: sizes), a row to each early shingle in common, that can be alike: all other common shingles lie behind the early ones of one side."""
    rest = lambda n: F.ceil(similarity * F.col(n) - 1e-9) - 1
    sums = met.groupBy("u", "v").agg(F.count("*").alias("c"), F.first("a").alias("a"), F.first("b").alias("b"))
    return sums.where(F.col("c") + F.greatest(rest("a"), rest("b")) >= similarity / (1 + similarity) * (F.col("a") + F.col("b")) - 1e-6).select("u", "v")


def _possible(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = a.as_py(), b.as_py()
                common, both = most_common(a, b) if a is not None and b is not None else (1, 1)
                keep.append(common >= similarity / (1 + similarity) * both - 1e-6)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(rows: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the written pairs (u, v) whose shingles are alike."""

    def ends(pairs: DataFrame, table: DataFrame, c: str) -> DataFrame:
        return pairs.join(table.select(F.col("class").alias("u"), F.col(c).alias("a")), "u").join(table.select(F.col("class").alias("v"), F.col(c).alias("b")), "v")

    pairs = materialize(ends(pairs, classes, "sketch").mapInArrow(tidy(_possible(similarity)), "u long, v long"), "near-possible")
    nodes = pairs.select(F.col("u").alias("class")).union(pairs.select("v"))
    wanted = rows.sparkSession.sparkContext.broadcast(bitmap(nodes, F.col("class")))
    sets = rows.select("text").mapInArrow(tidy(_shingles(shingle, wanted)), "class long, shingles array<long>")
    sets = materialize(sets.join(nodes.distinct(), "class", "left_semi").dropDuplicates(["class"]), "near-shingles")
    both = ends(pairs, sets, "shingles")
    common = F.size(F.array_intersect("a", "b"))
    return materialize(both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v"), "near-links")


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """(u, v) of classes to try: those with one fingerprint against the least of them, and these where their fingerprints link."""
    heads = materialize(classes.groupBy("fp").agg(F.min("class").alias("head"), F.count("*").alias("n")), "near-heads")
    same = lookup_join(classes.select("class", "fp"), heads, "fp", "n").where("class <> head").select(F.col("head").alias("u"), F.col("class").alias("v"))
    near = links(heads)
    ends = near.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("b")), "v")
    return same.unionByName(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def _turn(shared: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """(u, v): for every component one text of it against one of the largest other component that it shares an early shingle with, another one each turn.

    As many tries as components; large groups of texts that are alike grow together by them, so that few pairs are left to compare.
    """
    rooted = shared.join(roots, "class", "left").select("key", "class", F.coalesce("root", "class").alias("root"))
    of = rooted.groupBy("key", "root").agg(F.count("*").alias("m"), F.min_by("class", F.xxhash64("class", F.lit(turn))).alias("text"))
    top = of.groupBy("key").agg(F.max_by(F.struct("root", "text", "m"), F.struct("m", "root")).alias("top"), F.count("*").alias("n")).where("n > 1")
    other = of.join(top, "key").where(F.col("root") != F.col("top.root"))
    tried = other.groupBy("root").agg(F.max_by(F.struct("text", F.col("top.text").alias("to")), F.struct(F.col("top.m"), F.xxhash64("key", F.lit(turn)))).alias("t"))
    return tried.select(F.least("t.text", "t.to").alias("u"), F.greatest("t.text", "t.to").alias("v"))


def _met(open_: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of classes in different components that meet at a key of open_ (key, n: its classes, class, size, place, root) and may be alike, mostly once."""
    # The sets' order is one, so a key that stands before another in two sets is the earlier one of both.
    cells = F.ceil(F.col("n") / CELL)
    words, lags = [F.col("bits")[i].alias(f"b{i}") for i in range(PARITY)], Window.partitionBy("class").orderBy("place")
    told = open_.withColumns({f"k{i}": F.lag("key", i + 1).over(lags) for i in range(BEFORE)}).join(classes.select("class", *words), "class")
    own = told.withColumn("block", F.pmod(F.xxhash64("class"), cells)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)))
    dealt = own.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "n", "several")
    # The join itself leaves out pairs that cannot be alike: sets alike by s differ in at most (1 - s) / (1 + s) of their sizes' sum, and in no fewer members than bits of parity.
    dealt = materialize(dealt, "near-cells")
    x, y = dealt.alias("x"), dealt.alias("y")
    long, short = F.greatest("x.size", "y.size"), F.least("x.size", "y.size")
    least = F.ceil(similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-6)
    met_before = [F.coalesce(F.col(f"x.k{i}") == F.col(f"y.k{j}"), F.lit(False)) for i in range(BEFORE) for j in range(BEFORE)]
    apart = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(PARITY)), F.lit(0))
    meet = (
        (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.root") != F.col("y.root"))
        & (F.least("x.block", "y.block") == F.col("x.i")) & (F.greatest("x.block", "y.block") == F.col("x.j")) & (short >= similarity * long - 1e-9)
        # All that alike sets share, at least `least`, lies at their first shared key or behind it.
        & (F.col("x.place") <= F.col("x.size") - least) & (F.col("y.place") <= F.col("y.size") - least) & ~reduce(or_, met_before)
        & (apart <= (1 - similarity) / (1 + similarity) * (F.col("x.size") + F.col("y.size")) + 1e-6)
    )
    return x.join(y, meet).select(F.col("x.class").alias("u"), F.col("y.class").alias("v"))


def _links(rows: DataFrame, marked: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Verified links (u, v) of classes that connect all that are alike, by components."""
    keyed = marked.dropDuplicates(["class"]).select("class", "size", F.posexplode("firsts").alias("place", "key"))
    # A shingle that very many texts begin with is counted before the shuffle and split off by lookup_join; no key is one task's.
    centre = F.min_by(F.struct("class", "size"), F.struct("place", "class")).alias("centre")
    keys = materialize(keyed.groupBy("key").agg(centre, F.count("*").alias("n")).where("n > 1").withColumn("m", F.col("n")), "near-keys")
    shared = materialize(lookup_join(keyed.select("key", "class", "size", "place"), keys, "key", "m").where("n IS NOT NULL"), "near-shared")
    turned = F.col("class") > F.col("centre.class")
    tries = shared.where(F.col("class") != F.col("centre.class")).select(
        F.least("class", "centre.class").alias("u"), F.greatest("class", "centre.class").alias("v"),
        F.when(turned, F.col("centre.size")).otherwise(F.col("size")).alias("a"), F.when(turned, F.col("size")).otherwise(F.col("centre.size")).alias("b"),
    )
    # Besides, every text is tried against the centre that it has most shingles in common with, whatever that number shows.
    met = shared.where(F.col("class") != F.col("centre.class")).groupBy("class", F.col("centre.class").alias("centre")).agg(F.count("*").alias("c"))
    nearest = met.groupBy("class").agg(F.max_by("centre", F.struct("c", "centre")).alias("centre")).select(F.least("class", "centre").alias("u"), F.greatest("class", "centre").alias("v"))
    tries = materialize(_enough(tries, similarity).unionByName(_by_fingerprint(classes)).unionByName(nearest).distinct(), "near-tries")
    first = _verified(rows, classes, tries, shingle, similarity)
    roots = materialize(components(first).withColumnRenamed("node", "class"), "near-first")
    for turn in range(TURNS):
        more = _verified(rows, classes, materialize(_turn(shared, roots, turn), "near-turn"), shingle, similarity)
        first = materialize(first.unionByName(more), "near-links")
        roots = materialize(components(first).withColumnRenamed("node", "class"), "near-roots")
    rooted = shared.join(roots, "class", "left").select("key", "class", "size", "place", "n", F.coalesce("root", "class").alias("root"))
    rooted = materialize(rooted, "near-rooted")
    several = rooted.groupBy("key").agg((F.min("root") != F.max("root")).alias("several"), F.count("*").alias("m")).where("several")
    open_ = lookup_join(rooted, materialize(several, "near-several"), "key", "m").where("several")
    met = _met(open_, classes, similarity).distinct()
    rest = _verified(rows, classes, materialize(met, "near-pairs"), shingle, similarity)
    return materialize(first.unionByName(rest), "near-all-links")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, keep) of every document with an id: keep is the smallest id of its component."""
    return _groups(docs, id_col, text_col, shingle, similarity).select("id", F.col("keep.id").alias("keep"))


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, class, keep) of every document with an id: keep is the least (id, class) of its component."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = rows.sparkSession.sparkContext.broadcast(_order(rows, shingle))
    marked = materialize(rows.mapInArrow(tidy(_marks(shingle, similarity, order)), f"id {rows.schema['id'].dataType.simpleString()}, class long, fp long, size int, firsts array<long>, sketch binary, bits array<long>"), "near-marks")
    classes = materialize(marked.groupBy("class").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"), F.count("*").alias("n")), "near-classes")
    alike = _links(rows, marked, classes, shingle, similarity)
    roots = materialize(components(alike).withColumn("one", F.lit(1).cast("long")), "near-roots")
    rooted = lookup_join(classes.select("class", "least", "n"), roots.withColumnRenamed("node", "class"), "class", "one").withColumn("root", F.coalesce("root", "class"))
    own = F.struct(F.col("least").alias("id"), "class")
    linked = materialize(rooted.groupBy("root").agg(F.min(own).alias("keep"), F.count("*").alias("m")).where("m > 1"), "near-least")
    named = materialize(lookup_join(rooted, linked, "root", "m").select("class", F.coalesce("keep", own).alias("keep"), "n"), "near-named")
    return lookup_join(marked.select("id", "class"), named, "class", "n").select("id", "class", "keep")


def _class_of(text: Column) -> Column:
    """_class as an expression; Spark's hash is the same XXH64, with the same seed."""
    low = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.xxhash64(F.trim(F.regexp_replace(low, WS, " ")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each group of near duplicates."""
    groups = _groups(docs, id_col, text_col, **options)
    gone = groups.where((F.col("id") != F.col("keep.id")) | (F.col("class") != F.col("keep.class"))).select(F.col("id").alias("__id"), F.col("class").alias("__class"))
    # Rows that share an id, and repeated ones of which one stays, are settled by id and class together, beside those that go.
    twice = groups.groupBy("id").count().where("count > 1").select(F.col("id").alias("__id"))
    gone, twice = materialize(gone.distinct(), "near-gone"), materialize(twice, "near-twice")
    apart, some = parted(docs, F.col(id_col), gone.select("__id").unionByName(twice), F.col("__id"))
    classed = some.where(F.col(id_col).isNotNull()).withColumn("__class", _class_of(F.col(text_col)))
    stay = classed.join(gone, (F.col(id_col) == F.col("__id")) & classed["__class"].eqNullSafe(gone["__class"]), "left_anti")
    stay = stay.dropDuplicates([id_col, "__class"]).select(*docs.columns)
    nameless = docs.where(F.col(id_col).isNull()).dropDuplicates([text_col])
    return apart.where(F.col(id_col).isNotNull()).unionByName(stay).unionByName(nameless)
