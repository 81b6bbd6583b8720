"""Reading the given tables, and tables that an operator writes on its way.

Written tables go below the folder that the session names in spark.checkpoint.dir; where none is named (as in tests) below the
warehouse, which all machines share as well. They are removed when the driver ends.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Read by the C library and by Arrow when a worker starts.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "4194304"}


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it (elsewhere ship it with --py-files), and give large
    buffers back to the machine once they are free, as idle workers stay."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    held = spark.sparkContext.environment
    paths = [p for p in held.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        held["PYTHONPATH"] = os.pathsep.join([*paths, root])
    for name, value in WORKER_MEMORY.items():
        held.setdefault(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, computed once, from a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str) -> int:
    """Bytes of text in the whole table; one aggregate over one column."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts(total: int, each: int, least: int = 64) -> int:
    """How many parts of about `each` bytes; grows with the data."""
    return max(least, -(-total // each))
