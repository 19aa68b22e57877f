"""Tables in the folder that driver and executors share: results that cut a lineage, and tables in buckets that batches merge into."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a new one in local mode, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: lost executors cost a task, and joins see true sizes."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task where keys are made distinct or counted: keys are short and compress so well that a partition of the bytes
#: that Spark aims at has many millions, all of which a task would hold.
TASK_ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *keys: str, task_rows: int | None = None) -> DataFrame:
    """The rows dealt out by key to as many tasks as so many rows need; few are left to Spark's own dealing."""
    parts = -(-rows // (task_rows or TASK_ROWS))
    return df.repartition(parts, *keys) if parts > 4 else df


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def open_buckets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a table in buckets, with column `bucket`, which prunes the scan; none where nothing is written yet."""
    whole = T.StructType([*[f for f in schema.fields if f.name != BUCKET], T.StructField(BUCKET, T.IntegerType())])
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def overwrite_buckets(rows: DataFrame, touched: list[int], path: str) -> None:
    """Writes each of the touched buckets anew, from rows, which may have been read from path; an emptied bucket keeps one
    file without rows.

    The new rows are stored first, and a bucket is then swapped as a whole, so that a run that broke off can be run again.
    """
    spark = rows.sparkSession
    safe = stored(rows)
    emptied = sorted(set(touched) - {r[0] for r in safe.select(BUCKET).distinct().collect()})  # a row a bucket
    safe.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    for b in emptied:
        spark.createDataFrame([], rows.drop(BUCKET).schema).write.mode("overwrite").parquet(f"{path}/{BUCKET}={b}")


def merge_rows(path: str, new: DataFrame, keys: list[str], order: str, buckets: int = 64, props: str | None = None) -> list[int]:
    """Merges new rows into the table at path by key, and returns the buckets that were written.

    A key's last row by `order` stays; of equals, the one there already, and of equal rows of one batch the largest by its
    other columns.  props names a map column that merges property by property instead.  Only buckets in which a row changes
    are rewritten, so that a batch that was merged before rewrites none.  Null keys are a key like others.
    """
    spark = new.sparkSession
    rest = [c for c in new.columns if c not in (*keys, order, BUCKET)]
    old = open_buckets(spark, path, new.schema)
    batch = stored(bucketed(new, keys, buckets))
    near = [r[0] for r in batch.select(BUCKET).distinct().collect()]  # at most a row a bucket
    old = old.where(F.col(BUCKET).isin(near))
    rows = old.select(*keys, order, *rest, BUCKET, F.lit(1).alias("held")).unionByName(batch.select(*keys, order, *rest, BUCKET, F.lit(0).alias("held")))
    plain = [c for c in rest if c != props]
    tie = F.struct(F.col(order), F.col("held"), *[F.col(c) for c in plain if comparable(new.schema[c].dataType)])
    merged = rows.groupBy(*keys, BUCKET).agg(F.max_by(F.struct(order, *plain), tie).alias("row"))
    merged = merged.select(*keys, BUCKET, f"row.{order}", *[F.col("row")[c].alias(c) for c in plain])
    if props:
        each = rows.select(*keys, order, "held", F.explode(props).alias("name", "value")).groupBy(*keys, "name").agg(F.max_by("value", F.struct(order, "held", "value")).alias("value"))
        maps = each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(props))  # a row a property
        on = [F.col(f"m.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys]
        merged = merged.alias("m").join(maps.alias("x"), on, "left").select("m.*", F.coalesce(f"x.{props}", F.create_map().cast(new.schema[props].dataType)).alias(props))
    merged = stored(merged)
    as_held = lambda df: df.select(BUCKET, F.xxhash64(*keys, order, *[F.to_json(F.struct(props)) if c == props else c for c in rest]).alias("h"))
    before = as_held(sorted_map(old, props)).groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(h)").alias("x"))
    after = as_held(merged).groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n2"), F.expr("bit_xor(h)").alias("x2"))
    changed = after.join(before, BUCKET, "left").where(~(F.col("n").eqNullSafe(F.col("n2")) & F.col("x").eqNullSafe(F.col("x2"))))
    touched = sorted(r[0] for r in changed.select(BUCKET).collect())  # at most a row a bucket
    if touched:
        overwrite_buckets(merged.where(F.col(BUCKET).isin(touched)).select(*new.drop(BUCKET).columns, BUCKET), touched, path)
    return touched


def sorted_map(df: DataFrame, props: str | None) -> DataFrame:
    return df.withColumn(props, F.map_from_entries(F.array_sort(F.map_entries(props)))) if props else df


def comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return comparable(kind.elementType)
    return all(comparable(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else not isinstance(kind, (T.MapType, T.VariantType))


def purge_rows(spark: SparkSession, path: str, schema: T.StructType, goes: Column) -> list[int]:
    """Deletes the rows for which a condition is true, and returns the buckets that were written: those that had any."""
    rows = open_buckets(spark, path, schema)
    gone = F.coalesce(goes, F.lit(False))
    touched = sorted(r[0] for r in rows.where(gone).select(BUCKET).distinct().collect())  # at most a row a bucket
    if touched:
        overwrite_buckets(rows.where(F.col(BUCKET).isin(touched) & ~gone), touched, path)
    return touched
