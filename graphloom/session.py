"""Session helpers: a tuned builder, shared work folders and importable workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20  # of rows that a Python worker gets at once; texts are long
TASK_ROWS = 500_000  # of a shuffle whose tasks hold their rows in memory
ROW_GROUP_BYTES = 16 << 20  # of intermediate tables, which a task holds in memory while it writes


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own settings."""
    ready_path()
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ready_path() -> None:
    """Puts the repository root on PYTHONPATH, so that workers started later import the package."""
    have = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])


def ready_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a session that is already running import the package, and bounds what they are sent at once."""
    if int(spark.conf.get(BATCH_SETTING, "67108864b").rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (local sessions only)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
        if found is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
            sc.setCheckpointDir(found)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of df by a table in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_shared(*tables: DataFrame) -> None:
    """Deletes tables of write_shared that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.shared_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts_for(rows: DataFrame) -> int:
    """How many parts a shuffle of these rows gets, so that a task's share does not grow with them: adaptive execution joins small parts, but cuts no large ones."""
    return parts_of(rows.sparkSession, rows.count())


def parts_of(spark: SparkSession, n: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
