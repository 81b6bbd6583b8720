"""Extract readers, the read-through table cache and result export."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.watch import Watch
from .dta import DtaSource
from .xlsx import XlsxSource

CHECKPOINT_DIR = "spark.checkpoint.dir"


def read_extract(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Delimited extract with every column as text, so no id loses a zero and no pass infers types.

    ``columns`` gives the layout; without it only the header line is read to learn the names.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def read_forced(spark: SparkSession, path: str, text_positions: Sequence[int]) -> DataFrame:
    """Delimited extract in which the columns at the given places (from 1) are text, the rest inferred.

    Inference reads the whole extract, so that a late odd cell cannot turn into a null.  Where a
    second read is too much, give ``read_csv`` a schema.
    """
    options = {"header": True, "quote": '"', "escape": '"'}
    names = spark.read.options(**options).csv(path).columns
    guess = spark.read.options(**options, inferSchema=True).csv(path).schema
    forced = {names[p - 1] for p in text_positions}
    schema = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in forced else f.dataType) for f in guess.fields]
    )
    return spark.read.options(**options).schema(schema).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, null: str = "NA") -> DataFrame:
    """CSV with a header, quoted commas and a null mark; types inferred unless a schema is given."""
    reader = spark.read.options(header=True, nullValue=null, quote='"', escape='"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), watch: Watch | None = None) -> None:
    """Overwrite a table.  Panels are partitioned by year; rows are clustered on it before the write
    so that each task writes few files, and AQE splits a year that is too large for one task.

    The checks of ``watch`` are counted on the rows as they are written, after the last shuffle.
    """
    df = watch.prepare(df) if watch else df
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    df = watch.count(df) if watch else df
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_dta(spark: SparkSession, path: str, **options) -> DataFrame:
    """A Stata table, one file or a folder of parts, with its labels; see ``sources.dta``."""
    spark.dataSource.register(DtaSource)
    return spark.read.format("dta").options(**options).load(path)


def write_dta(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """A folder of Stata files with the labels of columns and values; published when all of it is written."""
    df.sparkSession.dataSource.register(DtaSource)
    df.write.format("dta").mode(mode).options(**options).save(path)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of a workbook, or of each workbook of a folder, every cell as text and the first row as names; see ``sources.xlsx``.

    Without a name it is the first sheet; ``*`` reads all sheets, which must have the same columns.
    """
    spark.dataSource.register(XlsxSource)
    reader = spark.read.format("xlsx")
    return (reader if sheet is None else reader.option("sheet", sheet)).load(path)


def write_sheet(df: DataFrame, path: str, sheet: str = "Sheet1", mode: str = "overwrite", **options) -> None:
    """Result table as a folder of workbooks, names in the first row; one workbook where the table is small."""
    df.sparkSession.dataSource.register(XlsxSource)
    df.hint("rebalance").write.format("xlsx").mode(mode).options(sheet=sheet, **options).save(path)


def _files(spark: SparkSession, path: str):
    """Hadoop path and file system of a path."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, path: str) -> bool:
    marker, files = _files(spark, f"{path}/_SUCCESS")
    return files.exists(marker)


def publish(spark: SparkSession, beside: str, path: str) -> bool:
    """Give a finished folder its name.  False if a finished table has the name already: that one stays and this one goes."""
    there, files = _files(spark, path)
    own, _ = _files(spark, beside)
    if files.exists(there) and not _finished(spark, path):
        files.delete(there, True)
    jvm = spark.sparkContext._jvm
    plain = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        # unlike a file system's own rename this one does not move into a folder that is there
        context.rename(files.makeQualified(own), files.makeQualified(there), plain)
    except Exception:
        if not _finished(spark, path):
            raise
        files.delete(own, True)
        return False
    return True


def materialize(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()
) -> DataFrame:
    """The table at ``path`` if a finished copy is there, otherwise build it, write it and read it back.

    The table is built beside its place and gets its name when it is complete, so nobody reads half of it.  Of two builders of one
    path the first one's copy stays, and both read that.
    """
    if not _finished(spark, path):
        beside = f"{path.rstrip('/')}._{uuid.uuid4().hex}"
        write_table(build(), beside, partition_by)
        publish(spark, beside, path)
    return read_table(spark, path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str] = ("YEAR",)) -> None:
    """Write the rows of some partitions, such as one year of a panel, and leave the files of all others as they are."""
    df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel by year whose years may have different columns; a column that a year lacks is null there."""
    return spark.read.option("mergeSchema", True).parquet(path)


def write_bucketed(df: DataFrame, table: str, by: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """A table dealt into buckets by ``by`` and sorted in them; merges and roll-ups on a key that holds ``by`` need no shuffle.

    Tables that are to meet take one number of buckets.  Rows are dealt before the write, so each bucket is one file.
    """
    by = list(by)
    dealt = df.repartition(buckets, *[F.col(c) for c in by])
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*by)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return df.sparkSession.table(table)


def export_table(df: DataFrame, path: str) -> None:
    """Result table as CSV with a header.

    No forced single partition: the rebalance lets AQE put a small result into one file and a large
    one into as many as it needs.
    """
    df.hint("rebalance").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def sort_panel(df: DataFrame, keys: Sequence[str] = ("LEAID", "YEAR")) -> DataFrame:
    """Total order by range partitions, each sorted: the layout a sorted table is written in."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def shared_dir(spark: SparkSession, name: str) -> str:
    """Fresh folder for a written table, below the folder the cluster names for such data.

    Where that setting is absent it is below the warehouse, which all machines share as well.  The
    session's settings stay as they are; the folder goes when the driver ends.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    there, files = _files(spark, path)
    files.mkdirs(there)
    files.deleteOnExit(there)
    return path


def state_dimension(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows of a dimension's columns."""
    return df.select(*columns).distinct()

