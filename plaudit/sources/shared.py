"""The folder that all executors can reach, and tables kept there for one application."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Whether the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder; a cluster must name its own,
    since executors cannot read each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    named = tempfile.mkdtemp(prefix="plaudit-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


_scope: contextvars.ContextVar[str] = contextvars.ContextVar("scope", default="")


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/plaudit-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{_app_dir(spark)}{_scope.get()}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once and read from there ever after.

    Unlike a cached frame it outlives lost executors, and its size is known to the planner.
    """
    return stored(df, fresh_path(df.sparkSession, "table"))


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read from there; for what outlives the tables of a ``scratch``.

    What was shuffled for it goes at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is kept in here is deleted at the end; frames that live outside stay as they are."""
    token = _scope.set(f"{_scope.get()}/scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, _app_dir(spark) + _scope.get())
        _scope.reset(token)


def drop_saved(spark: SparkSession) -> None:
    """Delete what this application kept in the shared folder; its frames are void then."""
    _delete(spark, _app_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
