"""Sessions with the settings that results depend on (UTC) and those that plans profit from (adaptive execution)."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable: the folder that spark.checkpoint.dir names, or in local mode a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(folder)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for stored tables: spark.checkpoint.dir, or in local mode the temporary one that `shared_dir` sets."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    shared_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_stored: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and a lost executor costs no recomputation.  The table goes with the session."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_stored() -> None:
    for spark, path in _stored:
        try:
            if spark.sparkContext._jsc is not None:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; the folder then stays for the cluster's own cleaning
            return
