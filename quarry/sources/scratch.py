"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir).

Who makes tables within :func:`scope` knows which are its own and may remove them when their last reader is done, whatever other
threads store meanwhile.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths stored by this thread inside the block, and not removed; those of a block within it, too."""
    made: list[str] = []
    before = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(before)


def root(spark: SparkSession) -> str:
    """The shared folder; one of our own only where none is set and all of Spark runs in this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quarry-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def folder(spark: SparkSession) -> str:
    """A new path for what is stored."""
    path = f"{root(spark)}/{uuid.uuid4().hex}"
    for made in _scopes.get():
        made.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back: what is used several times is computed once and survives lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes stored tables that nothing will read again."""
    for path in list(paths):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        for made in _scopes.get():
            if path in made:
                made.remove(path)
