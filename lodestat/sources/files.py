"""CSV sources and sinks, literal tables, and stored intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _clean(df: DataFrame) -> DataFrame:
    """Trim text, turn empty text and NaN into null."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = F.nullif(F.trim(c), F.lit(""))
        elif isinstance(field.dataType, T.DoubleType):
            c = F.nanvl(c, F.lit(None).cast("double"))
        columns.append(c.alias(field.name))
    return df.select(*columns)


def read_measurements(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and declared types; 'NA' and empty cells are null, text is trimmed."""
    return _clean(spark.read.csv(path, schema=schema, header=True, nullValue="NA",
                                 enforceSchema=False, ignoreLeadingWhiteSpace=True,
                                 ignoreTrailingWhiteSpace=True))


def read_lookup(spark: SparkSession, path: str, names) -> DataFrame:
    """CSV without a header; all columns are text with the supplied names."""
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    return _clean(spark.read.csv(path, schema=schema, header=False, nullValue="NA"))


def drop_index(df: DataFrame, name: str = "X1") -> DataFrame:
    """Drop the row-index column some exports carry."""
    return df.drop(name)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; null is written as NA."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def literal_table(spark: SparkSession, rows, schema) -> DataFrame:
    """Small table written in the program text, stored so that joins know its size."""
    return stored(spark.createDataFrame(rows, schema))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            configured = tempfile.mkdtemp(prefix="lodestat-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and continue from the files.

    Used for aggregates that are read several times or joined back to rows. The files cut the
    lineage, survive lost executors, and give the optimizer a measured size: a join with them is
    a broadcast only below ``spark.sql.autoBroadcastJoinThreshold`` and a shuffle join beyond it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, parts: int) -> DataFrame:
    """Like ``stored``, with the rows dealt to ``parts`` buckets by a column: a join on it shuffles the other side only.

    ``df`` should be partitioned by the column into as many parts, so that a bucket is one file. The
    table's name is dropped at once, its files stay like those of ``stored``.
    """
    spark = df.sparkSession
    name = f"lodestat_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, column).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
