"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the text contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new one where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not at and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not at:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        at = spark.sparkContext.getCheckpointDir()
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: a cut in the lineage that survives lost executors.

    Unlike checkpoint(), it also gives the planner the true size: sizes guessed from the plan multiply in a loop of joins.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again, and lets Spark delete the shuffle files of finished jobs.

    Spark drops those once the driver's collector has seen that their plans are gone, which a large heap puts off.
    """
    spark = tables[0].sparkSession
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone.  lower() is the fast form where the text is pure ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def with_outputs(row: str, df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """Expands the struct column `row` and adds outputs; an input column named like an output gives way to it."""
    low = {name.lower() for name in outputs}
    kept = [F.col(row)[f.name].alias(f.name) for f in df.schema[row].dataType.fields if f.name.lower() not in low]
    return df.select(*kept, *[c.alias(name) for name, c in outputs.items()])


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds the rows that Spark sends to Python at once, so that a batch of long texts fits in a worker's memory.

    The setting stays lowered, as Spark reads it when the returned table is run.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


#: What a Python worker keeps across tasks: the model of one operator at a time, as Spark uses a worker for all of them.
HELD: dict = {}


def held(kind: str, key: object, make):
    """The worker's own make(), made once; what it kept for another operator or model is let go."""
    if (kind, key) not in HELD:
        HELD.clear()
        gc.collect()
        HELD[kind, key] = make()
    return HELD[kind, key]
