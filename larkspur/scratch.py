"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a table may be broadcast after its values were summed.
BROADCAST_BYTES = 32 << 20
_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir. Only a local master may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="larkspur-"))
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compact: bool = False) -> DataFrame:
    """The table written to the shared folder and read back: computed once, read by column, and safe when executors are lost. compact: in Zstandard, for wide rows of texts."""
    path = scratch_path(df.sparkSession, label)
    (df.write.option("compression", "zstd") if compact else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """With a broadcast hint if the table's values take few bytes; else as it is, for a shuffled join."""

    def held(c, kind: T.DataType):
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.greatest(F.size(c), F.lit(0)) * 16, F.lit(0))
        return sum((held(c.getField(f.name), f.dataType) for f in kind), F.lit(16 * len(kind))) if isinstance(kind, T.StructType) else F.lit(0)

    total = F.lit(16 * (len(df.columns) + 1)).cast("long")
    for f in df.schema:
        total = total + held(F.col(f"`{f.name}`"), f.dataType)
    return F.broadcast(df) if (df.agg(F.sum(total).alias("b")).first()["b"] or 0) <= limit else df


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if it isn't there; by the file system that the path names."""
    there, fs = _file(spark, path)
    if not fs.exists(there):
        return None
    stream = fs.open(there)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside the path and puts it there in one step: readers see the old text or the new one."""
    there, fs = _file(spark, path)
    beside, _ = _file(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(over, 1)
    options[0] = over.OVERWRITE
    hadoop.FileContext.getFileContext(fs.makeQualified(there).toUri(), spark._jsc.hadoopConfiguration()).rename(beside, there, options)


def _file(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


#: Parts that a table is spread over, for each core; more than one, as rows take different times.
SPREAD = 3


def spread(df: DataFrame) -> DataFrame:
    """df, rows of files, over all cores, for costly expressions on a table that is read in fewer parts, or less even ones, than there are cores.

    The rows of each part are counted, as splits of a file say little: those without the middle of a row group read
    nothing. Nothing but footers is read for that. Tables whose rows lie even over the cores stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.count("n").alias("parts")).first()  # one row
    rounds = -(-held["parts"] // cores)
    return df.repartition(SPREAD * cores) if rounds * (held["most"] or 0) * cores > 1.25 * (held["all"] or 0) else df
