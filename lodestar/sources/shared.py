"""The folder that the driver and all executors see, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)
SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder given to ``SparkContext.setCheckpointDir``.

    Only a local master may have neither, as in tests: it gets a temporary folder,
    the same for the whole process.  A cluster without one is an error, since its
    executors could not write where the driver reads.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = given.get() if given.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        path = _local[0]
    return path.rstrip("/")


def materialise(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Later jobs reread the files, so a lost executor costs no recomputation of
    what stands above, and the shuffles that made them are removed at once.  Inside
    ``passing_tables`` the files go at its end, if they are not ``lasting``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}"
    written, before = _passing.get(), spark.conf.get(SHUFFLES, None)
    if written is not None and not lasting:
        written.append(path)
    spark.conf.set(SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES) if before is None else spark.conf.set(SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside are deleted at the end, but for lasting ones; nothing read from them may be left lazy."""
    written: list[str] = []
    token = _passing.set(written)
    try:
        yield
    finally:
        _passing.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in written:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
