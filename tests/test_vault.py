"""Vaults written by tasks and read in parts, and backups that are whole or not there."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.sources import vault


def _tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(folder) for f in fs}


def _files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string").repartition(4)


def test_a_vault_is_written_and_read_in_parts(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "v")
    rows = [(f"p{i % 3}/n {i}.md", f"text {i}\né") for i in range(40)] + [("top.md", ""), ("other.txt", "not a note"), ("deep/a/b/c.md", "x")]
    vault.write_vault(_files(spark, rows), folder)
    assert _tree(folder) == dict(rows)
    monkeypatch.setattr(vault, "PARTITION_BYTES", 60)
    spark.dataSource.register(vault.VaultSource)
    for address in (folder, f"file://{folder}"):
        read = spark.read.format("vault").load(address)
        assert {r.path: r.raw for r in read.collect()} == {p: t for p, t in rows if p.endswith(".md")}
    assert len(vault.VaultReader(folder, "*.md").partitions()) > 5
    assert {r.path for r in spark.read.format("vault").option("pattern", "p1/*").load(folder).collect()} == {p for p, _ in rows if p.startswith("p1/")}
    (tmp_path / "none").mkdir()
    assert spark.read.format("vault").load(str(tmp_path / "none")).count() == 0


def test_a_write_that_fails_leaves_the_vault_as_it_was(spark, tmp_path):
    folder = str(tmp_path / "v")
    vault.write_vault(_files(spark, [("a.md", "old"), ("b/c.md", "old")]), folder)
    before = _tree(folder)
    bad = [[("new.md", "x"), ("../out.md", "x")], [("new.md", "x"), ("/abs.md", "x")], [("new.md", "x"), (None, "x")], [("new.md", "x"), ("new.md", "y")], [("new.md", "x"), ("a.md", "clash")]]
    for rows in bad:
        with pytest.raises(Exception, match="vault|same path|already|failed"):
            vault.write_vault(_files(spark, rows), folder)
        assert _tree(folder) == before and not [d for d in os.listdir(folder) if d.startswith(".staging")], rows
    failing = spark.range(50).repartition(4).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken row"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="broken row"):
        vault.write_vault(failing, folder)
    assert _tree(folder) == before
    vault.write_vault(_files(spark, [("a.md", "new"), ("d.md", "new")]), folder, overwrite=True)
    assert _tree(folder) == before | {"a.md": "new", "d.md": "new"}


def test_what_was_moved_is_put_back(tmp_path, monkeypatch):
    folder = str(tmp_path)
    writer = vault.VaultWriter(folder, True, ["path", "raw"])
    for name, text in ((f"{writer.staging}/0-1/a.md", "new"), (f"{writer.staging}/0-1/b.md", "new"), ("a.md", "old")):
        os.makedirs(os.path.dirname(f"{folder}/{name}") or folder, exist_ok=True)
        (tmp_path / name).write_text(text)
    names = [f"{writer.staging}/0-1/a.md", f"{writer.staging}/0-1/b.md", f"{writer.staging}/0-1/missing.md"]
    with pytest.raises(FileNotFoundError):
        writer.commit([vault._Written(names)])
    assert _tree(folder) == {"a.md": "old"}


def test_backups(spark, tmp_path):
    tables = {"objects": spark.range(100).withColumn("t", F.concat(F.lit("é"), "id")), "edges": spark.createDataFrame([], "src string, dst string"), "cache_x": spark.range(3)}
    folder = f"file://{tmp_path}/backup"
    assert vault.snapshot(tables, folder, exclude=("cache_*",)) == {"objects": 100, "edges": 0}
    with pytest.raises(FileExistsError):
        vault.snapshot(tables, folder)
    back = vault.restore(spark, folder)
    assert set(back) == {"objects", "edges"} and back["objects"].exceptAll(tables["objects"]).count() == 0 and back["edges"].schema == tables["edges"].schema
    with pytest.raises(ValueError, match="name"):
        vault.restore(spark, folder, ["../objects"])
    live = f"file://{tmp_path}/live"
    spark.range(5).write.parquet(f"{live}/objects")
    assert vault.restore_into(spark, folder, live) == {"objects": 100, "edges": 0}
    assert spark.read.parquet(f"{live}/objects").count() == 100 and sorted(os.listdir(tmp_path)) == ["backup", "live"]
    spark.range(7).withColumn("t", F.lit("x")).write.mode("append").parquet(f"{folder}/objects")
    with pytest.raises(RuntimeError, match="damaged"):
        vault.restore_into(spark, folder, live)
    assert spark.read.parquet(f"{live}/objects").count() == 100
    broken = {"ok": spark.range(3), "bad": spark.range(3).withColumn("x", F.raise_error(F.lit("no")))}
    with pytest.raises(Exception, match="no"):
        vault.snapshot(broken, f"file://{tmp_path}/second")
    assert sorted(os.listdir(tmp_path)) == ["backup", "live"]
