"""A stored inverted index: immutable segments of postings in blocks, deletion vectors, merges by size, one manifest per version.

A segment numbers its documents from 0.  `docs` is its forward table (number, id, attributes, length, terms with their counts by field).
`postings` has a row for each term and block of BLOCK document numbers: the documents with their counts and lengths, and what bounds
their contribution - the largest count of each field and the least length.  Rows lie in folders by hash of the term, sorted by term and block,
so a query reads its terms' rows and nothing else, whatever the corpus holds.

Blocks of all terms cover the same document numbers, so a conjunction meets block by block, and the sum of the terms' bounds bounds every
score of a block.  A search for the best k scores a few blocks with the highest bounds first; blocks whose bound is below the k-th score found
there are skipped, all others are scored.  Results equal a scan's: the statistics count live documents only.

Changes make a new segment; documents that it replaces or that go are marked in deletion vectors of their segments.  Segments of like size are
merged from their forward tables without their deleted rows.  A version becomes visible when its manifest is renamed into place, with the
numbers of the batches that it holds, so a batch that comes again changes nothing.  One writer at a time; readers keep the version they opened.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.model import FIELD_WEIGHTS
from graphloom.session import work_dir
from graphloom.sources.files import commit, listed, located, read_text

#: Document numbers of a block; blocks that a search scores first.
BLOCK, FIRST_BLOCKS = 4096, 64
#: Postings that a folder of terms shall hold, and how many folders a segment has at least and at most.
BUCKET_POSTINGS, LEAST_BUCKETS, MOST_BUCKETS = 8 << 20, 32, 4096
#: Postings that a task of the writer shall sort, and blocks of a folder that are dealt to one task.
TASK_POSTINGS, GROUP_BLOCKS = 2 << 20, 16
#: Segments of one size class that are merged, and the factor between classes.
MERGE_AT = 4
#: Rows that are looked up by listed numbers instead of a join.
LISTED = 2000
#: Added to a bound for rounding.
SLACK = 1 + 1e-9
_FORMAT = 1


def forward(objects: DataFrame, fields: tuple[str, ...], attributes: tuple[str, ...], stemmed: bool) -> DataFrame:
    """(id, attributes, len, terms, n0, n1, ...): each document's distinct terms with their counts by field.  Texts are split by Spark and counted in batches of so many tokens, whatever a batch of rows holds."""
    split = X.stems if stemmed else X.tokens
    counts = [f"n{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in X.by_tokens(whole, [f"t{i}" for i in range(len(fields))])):
            lists = [batch.column(f"t{i}") for i in range(len(fields))]
            sizes = [c.value_lengths().to_numpy(zero_copy_only=False) for c in lists]
            flat = pa.concat_arrays([c.flatten() for c in lists])
            coded = flat.dictionary_encode()
            n_codes = max(1, len(coded.dictionary))
            row = np.concatenate([np.repeat(np.arange(batch.num_rows), s) for s in sizes])
            pairs, at = np.unique(row * n_codes + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            edges = np.cumsum([0, *(int(s.sum()) for s in sizes)])
            by_field = [np.bincount(at[i:j], minlength=len(pairs)) for i, j in zip(edges, edges[1:], strict=False)]
            offsets = pa.array(np.searchsorted(pairs // n_codes, np.arange(batch.num_rows + 1)), pa.int32())
            terms = coded.dictionary.take(pa.array(pairs % n_codes)).cast(pa.string())
            made = [pa.ListArray.from_arrays(offsets, v) for v in (terms, *(pa.array(c, pa.int32()) for c in by_field))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", *attributes)), pa.array(sum(sizes), pa.int32()), *made], ["id", *attributes, "len", "terms", *counts])

    # Adaptive execution deals the texts out evenly; a few large files would be a few tasks.
    spread = objects.select("id", *attributes, *fields).hint("rebalance")
    rows = spread.select("id", *attributes, *(split(F.col(f)).alias(f"t{i}") for i, f in enumerate(fields)))
    return rows.mapInArrow(run, f"id string, {''.join(f'{a} string, ' for a in attributes)}len int, terms array<string>, {', '.join(f'{c} array<int>' for c in counts)}")


def _blocked(counts: list[str]) -> Callable:
    """Entries sorted by (bucket, term, block, no) to one row a block, with what bounds it."""
    columns = ["no", *counts, "len"]

    def rows(table: pa.Table) -> pa.RecordBatch:
        term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        block = table["block"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
        at = pa.array(first)
        values = {c: table[c].to_numpy() for c in columns}
        made = {"bucket": table["bucket"].take(at), "term": table["term"].take(at), "block": table["block"].take(at), "n": pa.array(np.diff(np.append(first, len(term))).astype(np.int32))}
        made |= {"least": pa.array(np.minimum.reduceat(values["len"], first))} | {f"most_{c}": pa.array(np.maximum.reduceat(values[c], first)) for c in counts}
        entries = pa.StructArray.from_arrays([pa.array(values[c]) for c in columns], columns)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(term)).astype(np.int32)), entries)
        whole = {k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for k, v in made.items()}
        return pa.RecordBatch.from_arrays([*whole.values(), lists], [*whole, "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            term, block = table["term"], table["block"].to_numpy()
            n = table.num_rows
            # The last block may go on in the next batch: at most BLOCK entries are held back.
            same = np.flatnonzero(block[max(0, n - BLOCK - 1) :] != block[-1])
            cut = max(0, n - BLOCK - 1) + (int(same[-1]) + 1 if len(same) else 0)
            while cut < n and term[cut].as_py() != term[n - 1].as_py():
                later = term.slice(cut).index(term[n - 1])
                cut += later.as_py()
            if cut:
                yield rows(table.slice(0, cut).combine_chunks())
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield rows(held.combine_chunks())

    return run


def _last(changes: DataFrame, order: str | None) -> DataFrame:
    """Of several rows of an id the last one by `order`."""
    if order is None:
        return changes
    return changes.groupBy("id").agg(F.max_by(F.struct(*changes.columns), order).alias("r")).select("r.*")


@dataclass(frozen=True)
class TextIndex:
    """One version of an index.  Methods that change it return the next version."""

    spark: SparkSession
    path: str
    manifest: dict

    # -- versions

    @staticmethod
    def create(spark: SparkSession, path: str, fields: tuple[str, ...] = tuple(FIELD_WEIGHTS), attributes: tuple[str, ...] = ("type", "project"), stemmed: bool = False) -> TextIndex:
        empty = {"format": _FORMAT, "version": 0, "fields": list(fields), "attributes": list(attributes), "stemmed": stemmed, "next": 0, "segments": [], "batches": {}}
        return TextIndex(spark, path, empty)._committed(empty)

    @staticmethod
    def open(spark: SparkSession, path: str) -> TextIndex | None:
        """The newest version, None where there is none."""
        found = sorted(n for n in listed(spark, f"{path}/manifests") if n.startswith("v"))
        return TextIndex(spark, path, json.loads(read_text(spark, f"{path}/manifests/{found[-1]}"))) if found else None

    @staticmethod
    def of(objects: DataFrame, stemmed: bool = False) -> TextIndex:
        """The index of a table of files, kept in the shared folder under a name that its files, their sizes and times and its plan make; built where it is not there.

        A table without files has no such name, so each call builds one.
        """
        spark = objects.sparkSession
        files = sorted(objects.inputFiles())
        if not files:
            return TextIndex.create(spark, f"{work_dir(spark)}/text-index-{uuid.uuid4().hex}", stemmed=stemmed).apply(objects)
        marks = [str(objects.select(*objects.columns).semanticHash())]
        for f in files:
            p, fs = located(spark, f)
            s = fs.getFileStatus(p)
            marks.append(f"{f}:{s.getLen()}:{s.getModificationTime()}")
        name = hashlib.sha256(json.dumps([_FORMAT, stemmed, objects.columns, *marks]).encode()).hexdigest()[:24]
        path = f"{work_dir(spark)}/text-index-{name}"
        found = TextIndex.open(spark, path)
        if found is not None and found.manifest["segments"]:
            return found
        return (found or TextIndex.create(spark, path, stemmed=stemmed)).apply(objects)

    def _committed(self, manifest: dict) -> TextIndex:
        commit(self.spark, f"{self.path}/manifests", f"v{manifest['version']:012d}", json.dumps(manifest))
        return TextIndex(self.spark, self.path, manifest)

    # -- tables

    @property
    def _counts(self) -> list[str]:
        return [f"n{i}" for i in range(len(self.manifest["fields"]))]

    @property
    def _entry(self) -> str:
        return f"struct<no:int, {', '.join(f'{c}:int' for c in self._counts)}, len:int>"

    def _docs(self, columns: str, segments: list[dict] | None = None) -> DataFrame | None:
        """Rows of the forward tables, deleted ones too; columns by name, `seg` and `no` among them."""
        own = self.manifest["segments"] if segments is None else segments
        if not own:
            return None
        kinds = {"id": "string", "len": "int", "no": "int", "seg": "int", "terms": "array<string>"} | dict.fromkeys(self.manifest["attributes"], "string") | dict.fromkeys(self._counts, "array<int>")
        schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
        return self.spark.read.option("basePath", f"{self.path}/docs").schema(schema).parquet(*(f"{self.path}/docs/seg={s['id']}" for s in own)).select(*columns.split())

    def _gone(self, segments: list[dict] | None = None) -> DataFrame | None:
        """(seg, no, len) of deleted rows."""
        own = self.manifest["segments"] if segments is None else segments
        paths = [p for s in own for p in s["gone"]]
        return self.spark.read.schema("seg int, no int, len int").parquet(*(f"{self.path}/{p}" for p in paths)) if paths else None

    def _live(self, rows: DataFrame, segments: list[dict] | None = None) -> DataFrame:
        gone = self._gone(segments)
        return rows if gone is None else rows.join(gone.select("seg", "no"), ["seg", "no"], "left_anti")

    def _postings(self, terms: list[str] | None = None) -> DataFrame | None:
        """Rows of the postings; of `terms` only, read from their folders."""
        paths = []
        for s in self.manifest["segments"]:
            wanted = s["folders"] if terms is None else sorted({self._folder(t, s["buckets"]) for t in terms} & set(s["folders"]))
            paths += [f"{self.path}/postings/seg={s['id']}/bucket={b}" for b in wanted]
        if not paths:
            return None
        schema = f"seg int, bucket int, term string, block int, n int, least int, {', '.join(f'most_{c} int' for c in self._counts)}, entries array<{self._entry}>"
        rows = self.spark.read.option("basePath", f"{self.path}/postings").schema(schema).parquet(*paths)
        return rows if terms is None else rows.where(F.col("term").isin(terms))

    def _folder(self, term: str, buckets: int) -> int:
        """The folder of a term; the same hash in the writer, by MD5's first digits."""
        return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % buckets

    # -- writing

    def _segment(self, rows: DataFrame, number: int) -> dict | None:
        """Write a segment of forward rows; None where there are none."""
        spark, docs_path = self.spark, f"{self.path}/docs/seg={number}"
        names = ["id", *self.manifest["attributes"], "len", "terms", *self._counts]
        at = F.monotonically_increasing_id()
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.select(*names).withColumn("__part", F.shiftright(at, 33)).withColumn("__seq", at.bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(staged)
        told = spark.read.parquet(staged)
        parts = sorted(tuple(r) for r in told.groupBy("__part").agg(F.count("*"), F.sum("len"), F.sum(F.size("terms"))).collect())  # one row a partition
        if not parts:
            return None
        starts, total = [], 0
        for part, n, _, _ in parts:
            starts.append((part, total))
            total += n
        before = spark.createDataFrame(starts, "__part long, __start long")
        numbered = told.join(F.broadcast(before), "__part").withColumn("no", (F.col("__start") + F.col("__seq")).cast("int"))
        numbered.select("no", *names).sortWithinPartitions("no").write.parquet(docs_path)
        n_postings = sum(p[3] for p in parts)
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (n_postings // BUCKET_POSTINGS).bit_length()))
        docs = self._docs(f"no len terms {' '.join(self._counts)}", [{"id": number}])
        bucket = F.pmod(F.conv(F.substring(F.md5("p.terms"), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
        columns = [bucket.alias("bucket"), F.col("p.terms").alias("term"), F.floor(F.col("no") / BLOCK).cast("int").alias("block"), "no", *(F.col(f"p.{c}") for c in self._counts), "len"]
        entry = docs.select("no", "len", F.explode(F.arrays_zip("terms", *self._counts)).alias("p")).select(*columns)
        # Blocks of one term are dealt out too: the commonest term has a row for every block.  As many tasks as keep each one's sort small.
        n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_postings // TASK_POSTINGS))
        dealt = entry.repartition(n_tasks, "bucket", F.floor(F.col("block") / GROUP_BLOCKS)).sortWithinPartitions("bucket", "term", "block", "no")
        most = ", ".join(f"most_{c} int" for c in self._counts)
        blocks = dealt.mapInArrow(_blocked(self._counts), f"bucket int, term string, block int, n int, least int, {most}, entries array<{self._entry}>")
        blocks.write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(f"{self.path}/postings/seg={number}")
        folders = sorted(int(n.partition("=")[2]) for n in listed(spark, f"{self.path}/postings/seg={number}") if n.startswith("bucket="))
        p, fs = located(spark, staged)
        fs.delete(p, True)
        return {"id": number, "docs": total, "length": sum(x[2] for x in parts), "buckets": buckets, "folders": folders, "gone": [], "n_gone": 0, "length_gone": 0}

    def apply(self, changes: DataFrame | None = None, gone: DataFrame | None = None, batch: tuple[str, int] | None = None, order: str | None = None) -> TextIndex:
        """The next version: `changes` (id, fields, attributes) are new or replace what has their id, ids in `gone` (id) leave.

        batch: (source, number); a number that the index has already, or a lower one of the source, changes nothing.  order: the
        column by which the last of several rows of an id is taken; without it ids must differ.  An id in both leaves first and comes anew.
        """
        old = self.manifest
        if batch is not None and old["batches"].get(batch[0], -1) >= batch[1]:
            return self
        new = json.loads(json.dumps(old)) | {"version": old["version"] + 1}
        if batch is not None:
            new["batches"][batch[0]] = batch[1]
        if changes is not None:
            kept = _last(changes, order)
            made = self._segment(forward(kept, tuple(old["fields"]), tuple(old["attributes"]), old["stemmed"]), new["next"])
            if made:
                new["segments"].append(made)
            new["next"] += 1
        ids = None if gone is None else gone.select("id")
        if changes is not None and new["segments"] and new["segments"][-1]["id"] == new["next"] - 1:
            own = self._docs("id", [new["segments"][-1]])
            ids = own if ids is None else ids.unionAll(own)
        if ids is not None and old["segments"]:
            self._mark(new, ids)
        return self._merged(new)._committed_next()

    def _mark(self, new: dict, ids: DataFrame) -> None:
        """Write the deletion vectors of older segments' rows with one of ids, and count them in the manifest."""
        rows = self._live(self._docs("seg no len id")).join(ids.distinct(), "id", "left_semi").select("seg", "no", "len")
        name = f"gone/{uuid.uuid4().hex}"
        rows.withColumn("part", F.col("seg")).write.partitionBy("part").parquet(f"{self.path}/{name}")
        written = self.spark.read.schema("seg int, no int, len int").parquet(f"{self.path}/{name}")
        for seg, n, length in written.groupBy("seg").agg(F.count("*"), F.sum("len")).collect():  # a row a segment
            (s,) = (s for s in new["segments"] if s["id"] == seg)
            s["gone"].append(f"{name}/part={seg}")
            s["n_gone"] += n
            s["length_gone"] += length

    def _merged(self, new: dict) -> _Pending:
        """Segments of one size class are put together while MERGE_AT of them are there; empty ones go."""
        held = TextIndex(self.spark, self.path, new)
        while True:
            new["segments"] = [s for s in new["segments"] if s["docs"] > s["n_gone"]]
            classes: dict[int, list[dict]] = {}
            for s in new["segments"]:
                classes.setdefault((s["docs"] - s["n_gone"]).bit_length() // 2, []).append(s)
            full = next((c for c in classes.values() if len(c) >= MERGE_AT), None)
            if full is None:
                return _Pending(self, new)
            columns = f"seg no id {' '.join(new['attributes'])} len terms {' '.join(self._counts)}"
            rows = held._live(held._docs(columns, full), full)
            made = held._segment(rows, new["next"])
            new["next"] += 1
            ids = {s["id"] for s in full}
            new["segments"] = [s for s in new["segments"] if s["id"] not in ids] + ([made] if made else [])

    def sink(self, source: str, gone: Callable[[DataFrame], DataFrame] | None = None, order: str | None = None) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function that keeps the newest version of this index in step with a stream of changes; `gone` tells its deletions.

        Of several rows of an id in a batch the last by `order` counts, deletions included.
        """

        def run(batch: DataFrame, number: int) -> None:
            index = TextIndex.open(self.spark, self.path)
            if index.manifest["batches"].get(source, -1) >= number:
                return
            last = _last(batch, order)
            deleted = None if gone is None else gone(last).select("id")
            index.apply(last if deleted is None else last.join(deleted, "id", "left_anti"), deleted, (source, number))

        return run

    # -- reading

    def statistics(self) -> tuple[int, int]:
        """(live documents, their length)."""
        own = self.manifest["segments"]
        return sum(s["docs"] - s["n_gone"] for s in own), sum(s["length"] - s["length_gone"] for s in own)

    def _hits(self, rows: DataFrame, weights: dict[str, float]) -> DataFrame:
        """(seg, no, term, tf, len) of live entries of postings rows."""
        flat = rows.select("seg", "term", F.explode("entries").alias("e"))
        tf = sum((F.lit(float(weights[f])) * F.col(f"e.{c}") for f, c in zip(self.manifest["fields"], self._counts, strict=True)), F.lit(0.0))
        return self._live(flat.select("seg", F.col("e.no").alias("no"), "term", tf.alias("tf"), F.col("e.len").alias("len"))).where("tf > 0")

    def search(self, terms: list[str], k: int | None = None, weights: dict[str, float] = FIELD_WEIGHTS, **filters: str) -> DataFrame:
        """(id, raw): BM25 of live documents that hold every term; with k at least the best k by (raw descending, id) and all that tie with the last.

        filters: attributes that must be equal; an empty value is none.
        """
        terms, filters = list(dict.fromkeys(terms)), {c: v for c, v in filters.items() if v}
        rows = self._postings(terms) if terms else None
        nothing = self.spark.createDataFrame([], "id string, raw double")
        if rows is None:
            return nothing
        n_docs, length = self.statistics()
        found = self._frequencies(terms, weights)
        if len(found) < len(terms):
            return nothing
        score = lambda t, tf, size: _part(n_docs, length, found[t], tf, size)

        def scored(blocks: DataFrame) -> DataFrame:
            hits = self._hits(blocks, weights)
            by_term = [F.max(F.when(F.col("term") == t, score(t, F.col("tf"), F.col("len")))).alias(f"s{i}") for i, t in enumerate(terms)]
            sums = hits.groupBy("seg", "no").agg(*by_term).where(" AND ".join(f"s{i} IS NOT NULL" for i in range(len(terms))))
            out = sums.select("seg", "no", sum((F.col(f"s{i}") for i in range(len(terms))), F.lit(0.0)).alias("raw"))
            if filters:
                of = self._docs(f"seg no {' '.join(filters)}")
                for c, v in filters.items():
                    of = of.where(F.col(c) == v)
                out = out.join(of.select("seg", "no"), ["seg", "no"], "left_semi")
            return out

        n_blocks = sum(-(-s["docs"] // BLOCK) for s in self.manifest["segments"])
        if k is None or n_blocks <= FIRST_BLOCKS:
            return self._with_ids(scored(rows))
        most = sum((F.lit(float(weights[f])) * F.col(f"most_{c}") for f, c in zip(self.manifest["fields"], self._counts, strict=True)), F.lit(0.0))
        bound = F.lit(0.0)
        for t in terms:
            bound = F.when(F.col("term") == t, score(t, most, F.col("least"))).otherwise(bound)
        bounds = rows.select("seg", "block", "term", bound.alias("bound")).groupBy("seg", "block").agg(F.count("*").alias("n"), (F.sum("bound") * SLACK).alias("bound")).where(F.col("n") == len(terms))
        first = [(r.seg, r.block) for r in bounds.orderBy(F.desc("bound"), "seg", "block").limit(FIRST_BLOCKS).collect()]
        if not first:
            return nothing
        in_first = F.concat_ws(":", "seg", "block").isin([f"{s}:{b}" for s, b in first])
        head = rows.where(F.col("block").isin(sorted({b for _, b in first})) & in_first)
        best = [r.raw for r in scored(head).orderBy(F.desc("raw")).limit(k).select("raw").collect()]
        least = best[-1] if len(best) == k else -1.0
        open_ = bounds.where((F.col("bound") >= least) & ~in_first).select("seg", "block")
        rest = rows.join(open_, ["seg", "block"], "left_semi")
        return self._with_ids(scored(head).unionAll(scored(rest)).where(F.col("raw") >= least))

    def _frequencies(self, terms: list[str], weights: dict[str, float]) -> dict[str, int]:
        """Live documents of each term that has any.  Without deletions the blocks' numbers say it; fields of weight 0 do not count."""
        rows = self._postings(terms)
        whole = all(weights.get(f) for f in self.manifest["fields"])
        if whole and not any(s["n_gone"] for s in self.manifest["segments"]):
            counted = rows.groupBy("term").agg(F.sum("n").alias("df"))
        else:
            counted = self._hits(rows, weights).groupBy("term").agg(F.count("*").alias("df"))
        return {r.term: r.df for r in counted.collect()}  # a row a term of the query

    def _with_ids(self, hits: DataFrame) -> DataFrame:
        return hits.join(self._docs("seg no id"), ["seg", "no"]).select("id", "raw")

    def search_many(self, queries: DataFrame, k: int = 50, weights: dict[str, float] = FIELD_WEIGHTS, places: int | None = None) -> DataFrame:
        """(query_id, id, raw, rank): the best k of every query (query_id, terms) in one pass; queries without terms or hits have no rows.

        places: scores that agree to so many decimal places are ties, which go by id; without it only equal ones are.
        Queries that ask the same are one.  Their terms meet the postings by an equi-join, and a task keeps k rows of a query, and those that
        tie with the last, before a query's rows are brought together and get their ids.  No job is run for each query.
        """
        asked = queries.select("query_id", F.array_join(F.array_sort(F.array_distinct("terms")), " ").alias("asked")).where("asked <> ''")
        distinct = asked.select("asked").distinct()
        wanted = distinct.select("asked", F.split("asked", " ").alias("terms")).select("asked", F.size("terms").alias("m"), F.explode("terms").alias("term"))
        some = [r.term for r in wanted.select("term").distinct().limit(LISTED + 1).collect()]
        rows = self._postings(some) if 0 < len(some) <= LISTED else self._postings()
        if rows is None or not some:
            return queries.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("raw"), F.lit(0).alias("rank")).limit(0)
        if len(some) > LISTED:
            rows = rows.join(wanted.select("term").distinct(), "term", "left_semi")
        n_docs, length = self.statistics()
        hits = self._hits(rows, weights)
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        parts = hits.join(F.broadcast(df) if len(some) <= LISTED else df, "term").select("seg", "no", "term", _part(n_docs, length, F.col("df"), F.col("tf"), F.col("len")).alias("part"))
        met = parts.join(wanted, "term")
        several = met.where("m > 1").groupBy("asked", "m", "seg", "no").agg(F.array_sort(F.collect_list(F.struct("term", "part"))).alias("p")).where(F.size("p") == F.col("m"))
        summed = several.select("asked", "seg", "no", F.aggregate("p", F.lit(0.0), lambda s, x: s + x["part"]).alias("raw"))
        raw = met.where("m = 1").select("asked", "seg", "no", F.col("part").alias("raw")).unionAll(summed)
        best_first = F.desc("raw") if places is None else F.round(F.col("raw") * 10.0**places).desc()
        near = raw.withColumn("near", F.rank().over(Window.partitionBy("asked").orderBy(best_first))).where(F.col("near") <= k)
        named = near.join(self._docs("seg no id"), ["seg", "no"])
        best = named.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(best_first, "id"))).where(F.col("rank") <= k)
        return asked.join(best, "asked").select("query_id", "id", "raw", "rank")

    def postings(self) -> DataFrame:
        """(id, term, n0, n1, ...) of all live documents."""
        rows = self._postings()
        if rows is None:
            return self.spark.createDataFrame([], f"id string, term string, {', '.join(f'{c} int' for c in self._counts)}")
        flat = rows.select("seg", "term", F.explode("entries").alias("e")).select("seg", F.col("e.no").alias("no"), "term", *(F.col(f"e.{c}") for c in self._counts))
        return self._live(flat).join(self._docs("seg no id"), ["seg", "no"]).select("id", "term", *self._counts)

    def check(self, objects: DataFrame) -> DataFrame:
        """(id, fault) where the stored postings differ from an index made anew: `missing`, `surplus`, `differs` or `twice`."""
        mark = lambda *extra: F.bit_xor(F.xxhash64("term", *self._counts, *extra)).alias("mark")
        made = forward(objects, tuple(self.manifest["fields"]), tuple(self.manifest["attributes"]), self.manifest["stemmed"])
        exploded = made.select("id", "len", F.explode_outer(F.arrays_zip("terms", *self._counts)).alias("p")).select("id", "len", F.col("p.terms").alias("term"), *(F.col(f"p.{c}") for c in self._counts))
        fresh = exploded.groupBy("id").agg(F.count("term").alias("n"), mark("len"))
        docs, rows = self._docs("seg no id len"), self._postings()
        if docs is None:
            return fresh.select("id", F.lit("missing").alias("fault"))
        flat = rows.select("seg", "term", F.explode("entries").alias("e")).select("seg", F.col("e.no").alias("no"), "term", *(F.col(f"e.{c}") for c in self._counts), F.col("e.len").alias("own")) if rows is not None else None
        of = self._live(docs)
        told = of.join(flat.groupBy("seg", "no").agg(F.count("term").alias("n"), mark("own")), ["seg", "no"], "left") if flat is not None else of.withColumn("n", F.lit(0)).withColumn("mark", F.lit(None).cast("long"))
        stored = told.groupBy("id").agg(F.count("*").alias("rows"), F.max(F.coalesce("n", F.lit(0))).alias("n"), F.max("mark").alias("mark"))
        both = fresh.alias("f").join(stored.alias("s"), "id", "full_outer")
        same = (F.col("f.n") == F.col("s.n")) & ((F.col("f.n") == 0) | F.col("f.mark").eqNullSafe(F.col("s.mark")))
        fault = F.when(F.col("s.rows").isNull(), "missing").when(F.col("f.n").isNull(), "surplus").when(F.col("s.rows") > 1, "twice").when(~same, "differs")
        return both.select("id", fault.alias("fault")).where("fault IS NOT NULL")


@dataclass(frozen=True)
class _Pending:
    index: TextIndex
    manifest: dict

    def _committed_next(self) -> TextIndex:
        return self.index._committed(self.manifest)


def _part(n_docs: int, length: int, df: int | Column, tf: Column, size: Column) -> Column:
    """A term's part of the score, as in `text.bm25`."""
    df = F.lit(df) if isinstance(df, int) else df
    idf = F.greatest(F.log((F.lit(n_docs) - df + 0.5) / (df + 0.5)), F.lit(X.LEAST_IDF))
    return idf * tf * (X.K1 + 1) / (tf + X.K1 * (1 - X.B + X.B * size / (F.lit(length) / F.lit(n_docs))))
