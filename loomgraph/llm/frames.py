"""Spark helpers: shared folder, cut lineage, checked broadcasts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.partitions import balanced
from ..plans.written import shared_dir

#: Rows and bytes of a record batch that a Python worker gets at once; the kernels cut it further.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20


_written: list[str] = []


def written() -> int:
    """How many tables `cut` has written and not released in this process."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep_last: bool = False, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables that `cut` wrote in this process, from the `since`th on, all but the last if that is kept and those of
    keep, once no result that reads them is needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kept = {t.cut_path for t in keep}
    gone = [w for w in _written[since : len(_written) - keep_last] if w not in kept]
    _written[:] = [w for w in _written if w not in gone]
    for where in gone:
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(conf).delete(path, True)


def one_process(master: str) -> bool:
    """Whether driver and tasks share a process; those of local-cluster do not."""
    return re.match(r"local(\[|$)", master) is not None


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df in the shared folder and read it again: lost executors cost no recomputation before this.
    The tables stay until `release` or `forget`. What was shuffled to write them is not needed any more: the driver's
    collector is asked to let Spark delete it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    if not one_process(spark.sparkContext.master):  # its collector would stop the tasks too
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of `cut` that nothing reads any more, neither a result nor a table still to be written."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if t.cut_path in _written:
            _written.remove(t.cut_path)


def arrow_rows(spark: SparkSession) -> None:
    """Bound the record batches sent to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return balanced(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n

