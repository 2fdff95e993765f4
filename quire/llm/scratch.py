"""Tables that cut lineage, in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder, else the checkpoint folder that the session was given. A temporary one is
made only in local mode, where driver and executors are one process; elsewhere a missing
folder raises. Files are written by Spark's own Parquet writer, so a lost executor costs at most the tasks it was running.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_open: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` or of ``setCheckpointDir``; in local mode without either, one temporary folder per application."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    sc = spark.sparkContext
    if (given := sc._jsc.sc().getCheckpointDir()).isDefined():
        return given.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, _own_dirs[sc.applicationId], ignore_errors=True)
    return _own_dirs[sc.applicationId]


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Removes, at its end, the tables that were written within and that no lazy result reads any more."""
    before = list(_open)
    yield
    for s in [s for s in _open if s not in before]:
        s.close()


class Scratch:
    """Writes DataFrames to tables of their own and reads them back.

    ``drop`` removes tables that no later plan reads. What is left, because a lazily returned
    result still reads it, goes at the end of a ``released`` block around it, else when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.held: dict[int, str] = {}
        _open.append(self)
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(where := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(where)
        self.held[id(out)] = where
        return out

    def delete(self, where: str) -> None:
        with contextlib.suppress(Exception):  # a session that has ended, or a file already gone
            path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if where := self.held.pop(id(t), None):
                self.delete(where)

    def close(self) -> None:
        if self in _open:
            _open.remove(self)
            atexit.unregister(self.close)
        if self.spark.sparkContext._jsc is not None:
            self.delete(self.root)
