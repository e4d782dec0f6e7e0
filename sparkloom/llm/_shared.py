"""Tables that cut lineage, and small helpers that several operators use."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
#: Tables written inside open ``scratch`` blocks, innermost last.
_SCRATCH: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where it is unset, a temporary one in local mode
    (tests); on a cluster that is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
    return _OWN[0]


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._sparkloom_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(back)
    return back


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables written inside, but for those that the block appends to what it gets; frees finished shuffles."""
    kept: list[DataFrame] = []
    _SCRATCH.append([])
    try:
        yield kept
    finally:
        inside = _SCRATCH.pop()
        if _SCRATCH:
            _SCRATCH[-1].extend(x for x in inside if any(x is k for k in kept))
        drop(*(x for x in inside if not any(x is k for k in kept)))
        release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose plans are no longer in use; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_sparkloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made of the given ones."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_total(df: DataFrame, order: list[str], amount: str, out: str, name: str) -> DataFrame:
    """``out``: the sum of ``amount`` over all earlier rows in ``order``; the keys in ``order`` are distinct.

    Rows are range-partitioned and summed in two levels, so that no task sees more than its own range; only one sum a
    partition meets in one place.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, name)
    cols = ", ".join(f"`{c}`" for c in order)
    local = ranged.withColumn(
        "__local", F.expr(f"sum({amount}) over (partition by __part order by {cols} rows between unbounded preceding and current row) - {amount}")
    )
    sums = ranged.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    offsets = sums.withColumn("__before", F.expr("sum(__sum) over (order by __part rows between unbounded preceding and current row) - __sum")).drop("__sum")
    result = local.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__local") + F.col("__before")).drop("__part", "__local", "__before")
    result._sparkloom_path = ranged._sparkloom_path
    return result
