"""Markdown vaults and backups: a data source that reads and writes folders of notes in parallel, and snapshots with a manifest."""

from __future__ import annotations

import contextlib
import fnmatch
import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as afs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from graphloom.operators import present
from graphloom.sources.files import commit, located, read_text

#: Bytes of notes that one task reads.
PARTITION_BYTES = 32 << 20


def _store(folder: str) -> tuple[afs.FileSystem, str]:
    """(file system, path in it) of a folder: a local path or any address that Arrow knows (file, s3, gs, hdfs)."""
    store, path = afs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (afs.LocalFileSystem(), folder)
    return store, path.rstrip("/")


def safe_path(path: str) -> str:
    """A note's path inside its vault; one that leads out of it raises."""
    clean = posixpath.normpath(path or "")
    if not path or clean in (".", "..") or clean.startswith(("/", "../")) or "\0" in path or clean.split("/")[0].startswith(".staging-"):
        raise ValueError(f"not a path inside the vault: {path!r}")
    return clean


class _Notes(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.value = names


class VaultReader(DataSourceReader):
    """Notes in parts of about PARTITION_BYTES; the driver lists names and sizes, the tasks read."""

    def __init__(self, folder: str, pattern: str) -> None:
        self.folder, self.pattern = folder, pattern

    def partitions(self) -> list[InputPartition]:
        store, root = _store(self.folder)
        found = sorted((f.path[len(root) + 1 :], f.size or 0) for f in store.get_file_info(afs.FileSelector(root, recursive=True)) if f.type == afs.FileType.File)
        parts, names, size = [], [], 0
        for name, n in found:
            if name.startswith(".staging-") or not fnmatch.fnmatch(name, self.pattern):
                continue
            names.append(name)
            size += n
            if size >= PARTITION_BYTES:
                parts.append(_Notes(names))
                names, size = [], 0
        return [*parts, _Notes(names)] if names or not parts else parts

    def read(self, partition: _Notes) -> Iterator[tuple]:
        store, root = _store(self.folder)
        for name in partition.value:
            with store.open_input_stream(f"{root}/{name}") as f:
                yield name, f.read().decode("utf-8", "replace")


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class VaultWriter(DataSourceWriter):
    """Each row (path, raw) a file.  Tasks write into a folder beside the notes; the driver moves the files into place when all have ended.

    Only names reach the driver.  A path that two rows have, that leads out of the vault, or, unless overwriting, that is there already fails
    the write; a write that fails leaves the vault as it was.
    """

    def __init__(self, folder: str, overwrite: bool, columns: list[str]) -> None:
        self.folder, self.overwrite, self.columns = folder, overwrite, columns
        self.staging = f".staging-{uuid.uuid4().hex}"
        store, root = _store(folder)
        store.create_dir(f"{root}/{self.staging}", recursive=True)  # made here only: once it is gone, a task that is still running fails

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, root = _store(self.folder)
        context = TaskContext.get()
        own, at = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}", self.columns.index("path")
        text, names, made = 1 - at, [], {self.staging}

        def folder(name: str) -> None:
            if name not in made:
                folder(posixpath.dirname(name))
                store.create_dir(f"{root}/{name}", recursive=False)
                made.add(name)

        for row in iterator:
            name = f"{own}/{safe_path(row[at])}"
            folder(posixpath.dirname(name))
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write((row[text] or "").encode())
            names.append(name)
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.folder)
        moves = [(n, n.split("/", 2)[2]) for m in messages if m is not None for n in m.names]
        targets = [t for _, t in moves]
        try:
            if len({t for t in targets}) < len(targets):
                raise ValueError("several rows have the same path")
            there = {f.path[len(root) + 1 :] for f in store.get_file_info(afs.FileSelector(root, recursive=True, allow_not_found=True)) if f.type == afs.FileType.File}
            if not self.overwrite and (clash := sorted(there & set(targets))):
                raise FileExistsError(f"{len(clash)} files are there already, {clash[0]!r} among them")
            self._moved(store, root, moves, there)
        finally:
            self._clear(store, root)

    def _moved(self, store: afs.FileSystem, root: str, moves: list[tuple[str, str]], there: set[str]) -> None:
        """Put the files into place; after a failure all that was there before is put back."""
        done: list[tuple[str, str]] = []
        try:
            for parent in sorted({posixpath.dirname(t) for _, t in moves} - {""}):
                store.create_dir(f"{root}/{parent}", recursive=True)
            for source, target in moves:
                if target in there:
                    kept = f"{self.staging}/replaced/{target}"
                    store.create_dir(f"{root}/{posixpath.dirname(kept)}", recursive=True)
                    store.move(f"{root}/{target}", f"{root}/{kept}")
                    done.append((kept, target))
                store.move(f"{root}/{source}", f"{root}/{target}")
                done.append(("", target))
        except Exception:
            for kept, target in reversed(done):
                if kept:
                    store.move(f"{root}/{kept}", f"{root}/{target}")
                else:
                    store.delete_file(f"{root}/{target}")
            raise

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_store(self.folder))

    def _clear(self, store: afs.FileSystem, root: str) -> None:
        for wait in (0.0, 0.1, 0.5, 2.0):  # a task that was not stopped yet may add a file meanwhile
            time.sleep(wait)
            if store.get_file_info(f"{root}/{self.staging}").type != afs.FileType.Directory:
                return
            with contextlib.suppress(OSError):
                store.delete_dir(f"{root}/{self.staging}")


class VaultSource(DataSource):
    """`spark.read.format("vault").load(folder)` and `df.write.format("vault").mode("append").save(folder)`, both of (path, raw); option `pattern` for reading."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "path string, raw string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return VaultReader(self.options["path"], self.options.get("pattern", "*.md"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if sorted(schema.names) != ["path", "raw"]:
            raise ValueError("a vault takes the columns path and raw")
        return VaultWriter(self.options["path"], overwrite, schema.names)


def read_vault(spark: SparkSession, folder: str) -> DataFrame:
    """(path, raw) of all markdown files by Spark's own reader, which reaches every store that Spark does; paths are relative to the folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    inside = F.substring_index(F.col("_metadata.file_path"), folder.rstrip("/").split("://")[-1] + "/", -1)
    return files.select(F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("raw"))


def read_v1(spark: SparkSession, url: str, table: str = "documents", **options: str) -> DataFrame:
    """An old store's table over JDBC (its driver must be on the class path), or a Parquet folder."""
    if url.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return spark.read.parquet(f"{url.rstrip('/')}/{table}")


def vault_files(objects: DataFrame, edges: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(path, text) of an exported vault: a file per object and a hub per project."""
    files = present.markdown(objects, edges, mentions, entities).join(present.file_paths(objects), "id").select("path", F.col("markdown").alias("text"))
    return files.unionByName(present.hubs(objects).select(F.concat(F.lit("hubs/"), "project", F.lit(".md")).alias("path"), F.col("hub").alias("text")))


def write_vault(files: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Each row (path, text) to its own file under `folder`, by the tasks; all of them or none."""
    files.sparkSession.dataSource.register(VaultSource)
    files.select("path", F.col("text").alias("raw")).write.format("vault").mode("overwrite" if overwrite else "append").save(folder)


# -- backups


def _digest(df: DataFrame) -> tuple[int, str]:
    """(rows, sum of the rows' hashes): the same for any order and layout."""
    hashed = F.xxhash64(*(F.col(f"`{c}`") if not c.startswith("__") else F.col(c) for c in df.columns)).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.sum(hashed).alias("h")).first()
    return r.n, str(r.h)


def snapshot(tables: dict[str, DataFrame], folder: str, exclude: tuple[str, ...] = ()) -> dict[str, int]:
    """Write all tables but those that a pattern of `exclude` names, with a manifest of their schemas, row counts and digests; returns the counts.

    What was written is read again and compared with the tables.  The folder appears by one rename at the end: a backup that fails leaves nothing.
    """
    names = [n for n in tables if not any(fnmatch.fnmatch(n, x) for x in exclude)]
    for n in names:
        _table_name(n)
    spark = next(iter(tables.values())).sparkSession
    folder = folder.rstrip("/")
    final, store = located(spark, folder)
    if store.exists(final):
        raise FileExistsError(folder)
    staged = f"{posixpath.dirname(folder)}/.{posixpath.basename(folder)}-{uuid.uuid4().hex}"
    at, _ = located(spark, staged)
    try:
        manifest = {}
        for n in names:
            df = tables[n]
            df.write.parquet(f"{staged}/{n}")
            rows, mark = _digest(spark.read.schema(df.schema).parquet(f"{staged}/{n}"))
            if (rows, mark) != _digest(df):
                raise RuntimeError(f"the snapshot of {n} differs from the table")
            manifest[n] = {"rows": rows, "digest": mark, "schema": df.schema.jsonValue()}
        commit(spark, staged, "manifest.json", json.dumps(manifest))
        if not store.rename(at, final):
            raise RuntimeError(f"cannot rename the snapshot to {folder}")
    except Exception:
        store.delete(at, True)
        raise
    return {n: m["rows"] for n, m in manifest.items()}


def _table_name(name: str) -> str:
    if not name or "/" in name or name.startswith(".") or name == "manifest.json":
        raise ValueError(f"not a table's name: {name!r}")
    return name


def restore(spark: SparkSession, folder: str, names: list[str] | None = None, check: bool = True) -> dict[str, DataFrame]:
    """The tables of a snapshot, all of them or `names`; with `check` their rows are compared with the manifest first."""
    folder = folder.rstrip("/")
    manifest = json.loads(read_text(spark, f"{folder}/manifest.json"))
    out = {}
    for n in manifest if names is None else names:
        m = manifest[_table_name(n)]
        out[n] = spark.read.schema(StructType.fromJson(m["schema"])).parquet(f"{folder}/{n}")
        if check and _digest(out[n]) != (m["rows"], m["digest"]):
            raise RuntimeError(f"the backup of {n} is damaged")
    return out


def restore_into(spark: SparkSession, folder: str, live: str) -> dict[str, int]:
    """Put a checked snapshot in the place of the tables under `live`; if that fails, what was there is put back.  Returns row counts."""
    tables = restore(spark, folder)
    live = live.rstrip("/")
    mark = uuid.uuid4().hex
    old, new = f"{live}-before-{mark}", f"{live}-restored-{mark}"
    here, store = located(spark, live)
    (old_path, _), (new_path, _) = located(spark, old), located(spark, new)
    moved = False
    try:
        for n, df in tables.items():
            df.write.parquet(f"{new}/{n}")
        if store.exists(here):
            moved = store.rename(here, old_path)
        if not store.rename(new_path, here):
            raise RuntimeError(f"cannot rename the restored tables to {live}")
    except Exception:
        store.delete(new_path, True)
        if moved and not store.exists(here):
            store.rename(old_path, here)
        raise
    if moved:
        store.delete(old_path, True)
    return {n: df.count() for n, df in tables.items()}
