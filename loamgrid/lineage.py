"""Tables in the folder that driver and executors share: a frame's rows, fixed once and for all."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from loamgrid.errors import DataError

_local: dict[str, str] = {}
#: The open scopes, innermost last; each lists the tables written in it.
_scopes: list[list[Table]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``, else the context's own checkpoint
    folder.  Only a local master, which has no other machines, falls back to a
    temporary folder that goes when Python ends; any other master is refused.  No
    setting is changed.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise DataError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="loamgrid-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return "file://" + _local[app]


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/loamgrid-{uuid.uuid4().hex}"


class Table:
    """A frame written to the shared folder and read back: lineage ends there."""

    def __init__(self, frame: DataFrame):
        self.spark, self.path = frame.sparkSession, new_path(frame.sparkSession)
        frame.write.parquet(self.path)
        self.frame = self.spark.read.schema(frame.schema).parquet(self.path)
        if _scopes:
            _scopes[-1].append(self)

    def drop(self) -> None:
        """Delete the files; no later plan may read them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self) -> DataFrame:
        """The frame; its files outlive the scope they were written in."""
        for scope in _scopes[-1:]:
            scope.remove(self)
            if len(_scopes) > 1:
                _scopes[-2].append(self)
        return self.frame


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are used up at the end and deleted, but for those that ``keep`` hands to the scope around."""
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            table.drop()


def fixed(frame: DataFrame) -> DataFrame:
    """The frame written as Parquet and read back: what depends on sampling or partitions is the same for every reader."""
    return Table(frame).frame
