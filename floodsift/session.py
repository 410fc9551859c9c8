"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Session settings that suit these queries.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="floodsift-")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside are removed when it ends.

    Otherwise they stay until the driver collects its garbage, so a job of many steps holds the
    shuffles of all of them, and the more the longer it takes.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage; for narrow tables read several times."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a query keeps the setting that it was made with


def stage(df: DataFrame) -> DataFrame:
    """Like :func:`settle` but columnar, for large tables whose readers prune columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def release(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read any more, nor what was made of them and is not staged."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
