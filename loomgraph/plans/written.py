"""Tables written to the folder that all executors share, so that lost executors cost no recomputation before them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[str] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one on a single machine, as in tests; a cluster must
    name one, as its executors do not see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="loomgraph-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted by `release`."""
    _paths.append(f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written and read again. The table stays until `release`."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def paths() -> set[str]:
    """Where the tables lie that were written in this process and not released."""
    return set(_paths)


def release(spark: SparkSession, keep: set[str] = frozenset()) -> int:
    """Delete what was written in this process, but for the paths of keep, once no result that reads it is needed; how many tables
    that were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = [p for p in _paths if p not in keep]
    _paths[:] = [p for p in _paths if p in keep]
    for where in gone:
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)
