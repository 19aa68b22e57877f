"""Tabular sources and sinks: CSV with typed columns, JSON runs, and node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridag.functions.numbers import plain_number


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as trimmed strings; empty is null; a byte-order mark before the first name is no part of it."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=True)
    return raw.select(*[F.nullif(F.trim(F.regexp_replace(c, "^﻿", "")), F.lit("")).alias(c) for c in columns])


def coerced(c: Column, kind: str) -> Column:
    """A string as a declared kind: boolean (yes, true, no, false), long, double or string; what doesn't fit is null."""
    if kind == "boolean":
        low = F.lower(F.trim(c))
        return F.when(low.isin("yes", "true"), True).when(low.isin("no", "false"), False)
    return F.nullif(F.trim(c), F.lit("")) if kind == "string" else F.trim(c).try_cast("bigint" if kind == "long" else kind)


def as_nodes(rows: DataFrame, label: str, key: str, dataset: str) -> DataFrame:
    """(label, id, props, dataset): rows with a key; null properties go."""
    rest = [c for c in rows.columns if c != key]
    props = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())
    return rows.where(F.col(key).isNotNull()).select(F.lit(label).alias("label"), F.col(key).cast("string").alias("id"), props.alias("props"), F.lit(dataset).alias("dataset"))


def purged(rows: DataFrame, dataset: str) -> DataFrame:
    """Rows of other datasets; rows without one stay."""
    return rows.where(~F.col("dataset").eqNullSafe(F.lit(dataset)))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet, partitioned by label and by relation, which prune scans."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")


def read_runs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Results of evaluation run files (JSON with run_id and an array `results`), a row a result with its keys and file.
    A file is one document, or, with lines, has one on each line, so that many runs need few files.

    (file, run_id, pos, result, kind, test_id, category, is_correct): a run without id is named by its file, and a result
    without test_id by a hash of itself, so that it has the same name whenever it is read.
    """
    files = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_name").alias("file"), "value")
    results = F.from_json(F.get_json_object("value", "$.results"), "array<map<string,string>>")
    run = F.coalesce(F.get_json_object("value", "$.run_id"), F.regexp_replace("file", r"\.[^.]*$", ""))
    rows = files.select("file", run.alias("run_id"), F.posexplode(results).alias("pos", "result"))
    own = F.concat(F.lit("test-"), F.substring(F.md5(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("result"))))), 1, 12))
    r = F.col("result")
    return rows.select("*", result_kind(F.map_keys("result")).alias("kind"), F.coalesce(r["test_id"], own).alias("test_id"), r["category"].alias("category"), r["is_correct"].try_cast("boolean").alias("is_correct"))


# The key that tells a kind of result row from the others, first match wins.
RESULT_KEYS = (("det_verdict", "comprehensive"), ("flipped", "position_bias"), ("prefers_verbose", "verbosity_bias"), ("fooled", "adversarial"), ("no_rubric_verdict", "rubric"), ("judge_verdict", "basic"))


def result_kind(keys: Column) -> Column:
    out = F.lit("unknown")
    for key, kind in reversed(RESULT_KEYS):
        out = F.when(F.array_contains(keys, key), kind).otherwise(out)
    return out


def json_object(df: DataFrame) -> Column:
    """A row as a JSON object: nulls are told, and doubles have the digits that other engines write."""
    def value(name: str, kind: str) -> Column:
        listed = F.to_json(F.array(name))  # [value]
        own = F.substring(listed, F.lit(2), F.length(listed) - 2)
        return F.when(~F.isnan(name) & (F.abs(name) != float("inf")), plain_number(F.col(name))).otherwise(own) if kind == "double" else own

    told = [F.concat(F.lit(f'"{name}":'), F.coalesce(F.when(F.col(name).isNotNull(), value(name, kind)), F.lit("null"))) for name, kind in df.dtypes]
    return F.concat(F.lit("{"), F.concat_ws(",", *told), F.lit("}"))


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON document of small result tables, each at most a few hundred rows by its definition."""
    out = None
    for name, df in tables.items():
        rows = F.array_sort(F.collect_list(F.struct(*df.columns, json_object(df).alias("_json"))))
        told = df.agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["_json"]), ","), F.lit("]")).alias("rows"))
        one = told.select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "rows"))))).alias("report"))
