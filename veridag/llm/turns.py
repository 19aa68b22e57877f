"""Turns of conversations in order, whatever share of all turns one conversation has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridag.llm.common import small_batches, stored


def numbered(rows: DataFrame, key: str, ranges: list, order: list) -> DataFrame:
    """rows, stored, with `pos`: the place from 0 of a row among those of its key, in the given order, nulls first.

    ranges deal rows into partitions and must agree with `order`, so that one key's rows may lie in many; a partition
    numbers its own runs of a key, and the few runs that go on from another partition are moved by what came before.
    """
    small_batches(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            runs = []
            for k in b.column(key).to_pylist():
                last, n = k, n + 1 if k == last else 0
                runs.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(runs), pa.int32()), pa.array(runs, pa.int64())], names=[*b.schema.names, "part", "run"])

    runs = stored(rows.repartitionByRange(key, *ranges).sortWithinPartitions(key, *order).mapInArrow(count, schema))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    moved = runs.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).where("before is not null")
    moved = F.broadcast(moved.select(F.col(key).alias("moved_key"), F.col("part").alias("moved_part"), "before"))  # a row a partition at most
    joined = runs.join(moved, F.col(key).eqNullSafe(F.col("moved_key")) & (F.col("part") == F.col("moved_part")), "left")
    return joined.select(*rows.columns, (F.col("run") + F.coalesce("before", F.lit(0))).alias("pos"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text) by turn, null first; rows of one turn by role and text; null role and text are empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), empty("role"), empty("text"))
    return numbered(rows, "conv_id", ["turn", "role", F.substring("text", 1, 32)], ["turn", "role", "text"]).drop("turn")
