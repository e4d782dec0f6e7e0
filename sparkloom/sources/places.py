"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which Spark's checkpoints use from then on.  Where it is unset, a temporary folder in local mode
    (tests); on a cluster, whose machines do not see each other's folders, that is an error."""
    context = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    defined = context._jsc.sc().getCheckpointDir()
    if not there and defined.isDefined():
        return defined.get()
    if not there:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        there = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    if not defined.isDefined():
        context.setCheckpointDir(there)
    return there.rstrip("/")
