"""Tables that cut lineage, in the folder that all executors of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a new temporary one only where none is set and
    the session runs in this process's machine alone (local mode, as in tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet, with the writer's options, to the shared folder and read it back: later steps,
    retries and lost executors start from these files. The caller's cluster clears the folder."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            session = table.sparkSession
            folder = session._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or what its first underscores make of it that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_fields(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    """A new schema with further nullable fields (StructType.add would change the given one)."""
    return T.StructType([*schema.fields, *(T.StructField(name, kind) for name, kind in kinds.items())])


def arrow_function(run, kind: str):
    """A column function of one column, from Arrow arrays to Arrow arrays of the Spark type kind."""

    def call(column: pa.Array) -> pa.Array:
        return run(column)

    return F.arrow_udf(call, kind)


#: Rows of an Arrow batch that goes to Python; texts are a few KB on average.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows: both sides of a Python worker's pipe hold
    whole batches, and Spark bounds them by rows only, of which 10,000 texts are many MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
