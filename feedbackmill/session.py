"""Session settings and the shared staging folder."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("feedbackmill")
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is made only for a local master; on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="feedbackmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Keep what is staged inside the block in one folder, and delete it at the end.

    Results that are still to be computed read staged tables, so act on them inside the block.
    """
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        remove_path(spark, folder)


def hadoop_path(spark: SparkSession, name: str):
    """A path and the file system it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_path(spark: SparkSession, folder: str) -> None:
    path, files = hadoop_path(spark, folder)
    files.delete(path, True)


def stored_bytes(staged: DataFrame) -> int:
    """Size of the files behind a staged table."""
    folder = staged.inputFiles()[0].rsplit("/", 1)[0]
    path, files = hadoop_path(staged.sparkSession, folder)
    return files.getContentSummary(path).getLength()


def stage(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder per value of the columns ``by``, and read it back.

    Cuts the lineage, fixes non-deterministic columns, and gives later joins a table whose size is
    known from its files.
    """
    spark = df.sparkSession
    path = f"{_scratch.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
