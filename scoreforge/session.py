"""Session helpers: a local session for tests and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "scoreforge") -> SparkSession:
    """Session for tests and local benchmarks; clusters pass their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> None:
    """Settings every query relies on: UTC session time and a checkpoint folder."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may go without one, as in tests: it then gets a
    temporary folder.  Elsewhere that folder would be another one on each machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="scoreforge-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path under the shared checkpoint folder for written tables and models."""
    base = checkpoint_dir(spark).rstrip("/")
    name = "/".join(parts)
    if unique:
        name = f"{name}-{uuid.uuid4().hex[:12]}"
    return f"{base}/scoreforge/{name}"


def work_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, asked of the file system Spark itself uses for it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def written(df: DataFrame, name: str, dealt_by: str | None = None, parted_by: str | None = None) -> DataFrame:
    """``df`` written once to the shared work folder and read back: every reader sees the same rows.

    ``dealt_by`` deals the rows by that column into a file per core: small files of rows that are
    dear to work on would otherwise come as one task.  ``parted_by``, the last column, gets a folder per value."""
    path = work_path(df.sparkSession, "tables", name)
    if dealt_by is not None:
        df = df.repartition(df.sparkSession.sparkContext.defaultParallelism, dealt_by)
    df.write.parquet(path, partitionBy=parted_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def storage_memory(spark: SparkSession) -> int:
    """Bytes that the executors have for cached rows, as Spark reports them now."""
    known = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().toSeq()
    return sum(known.apply(i)._1() for i in range(known.size()))


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for the Python side of local tests."""
    return path[5:] if path.startswith("file:") else path


def cores() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))
