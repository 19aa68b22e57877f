"""The library's model tables, bound to the driver's tables: DataFrames, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridag.sources.tables import dealt

METHODS = ["language", "length", "style"]
IN_PRICE, OUT_PRICE = 0.8, 4.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def verdicts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deterministic judges of labelled documents, a column each."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    noisy = F.col("text").contains("!!") | F.col("text").contains("&&&")
    base = docs.select("doc_id", "source", "lang", "n_chars", noisy.alias("noisy")).join(labels, "doc_id")
    return base.select(
        F.col("doc_id").alias("test_id"), F.col("source").alias("category"), (F.col("quality") == 1).alias("is_correct"), F.concat(F.lit("run"), (F.col("doc_id") % 3).cast("string")).alias("run_id"),
        F.when(F.col("lang") == "en", "PASS").when(F.col("lang") == "es", "UNCLEAR").otherwise("FAIL").alias("language_verdict"), (F.col("doc_id") * 37 % 500).alias("language_ms"),
        F.when(F.col("n_chars") >= 1500, "PASS").otherwise("FAIL").alias("length_verdict"), (F.col("doc_id") * 53 % 700).alias("length_ms"),
        F.when(F.col("noisy"), "FAIL").otherwise("PASS").alias("style_verdict"), (F.col("doc_id") * 71 % 900).alias("style_ms"),
        F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("long").alias("input_tokens"), (20 + F.col("doc_id") % 7).alias("output_tokens"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = verdicts_wide(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}_verdict").alias("result"), F.col(f"{m}_ms").alias("latency_ms")) for m in METHODS])
    keep = ["test_id", "category", "is_correct", "run_id", "input_tokens", "output_tokens"]
    correct = (F.col("result") != "UNCLEAR") & ((F.col("result") == "PASS") == F.col("is_correct"))
    return wide.select(*keep, F.inline(rows)).withColumn("correct", correct)


VERDICTS = """WITH wide AS (
  SELECT d.doc_id AS test_id, d.source AS category, l.quality = 1 AS is_correct, 'run' || (d.doc_id % 3) AS run_id,
         CASE d.lang WHEN 'en' THEN 'PASS' WHEN 'es' THEN 'UNCLEAR' ELSE 'FAIL' END AS language_verdict, d.doc_id * 37 % 500 AS language_ms,
         CASE WHEN d.n_chars >= 1500 THEN 'PASS' ELSE 'FAIL' END AS length_verdict, d.doc_id * 53 % 700 AS length_ms,
         CASE WHEN contains(d.text, '!!') OR contains(d.text, '&&&') THEN 'FAIL' ELSE 'PASS' END AS style_verdict, d.doc_id * 71 % 900 AS style_ms,
         greatest(1, d.n_chars // 4) AS input_tokens, 20 + d.doc_id % 7 AS output_tokens
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
long AS (
  SELECT test_id, category, is_correct, run_id, input_tokens, output_tokens, 'language' AS method, language_verdict AS result, language_ms AS latency_ms FROM wide
  UNION ALL SELECT test_id, category, is_correct, run_id, input_tokens, output_tokens, 'length', length_verdict, length_ms FROM wide
  UNION ALL SELECT test_id, category, is_correct, run_id, input_tokens, output_tokens, 'style', style_verdict, style_ms FROM wide),
verdicts AS (SELECT *, result <> 'UNCLEAR' AND (result = 'PASS') = is_correct AS correct FROM long)
"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, id, name, props) of the star schema's entities."""

    def of(name: str, label: str, key: str, shown: str | None, *props: str) -> DataFrame:
        pairs = [x for p in props for x in (F.lit(p), F.col(p).cast("string"))]
        return table(spark, sf_dir, name).select(F.lit(label).alias("label"), F.col(key).cast("string").alias("id"), (F.col(shown) if shown else F.lit(None).cast("string")).alias("name"), F.create_map(*pairs).alias("props"))

    out = of("customer", "Customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    for x in (
        of("supplier", "Supplier", "s_suppkey", "s_name", "s_nationkey"), of("part", "Part", "p_partkey", "p_name", "p_brand", "p_type", "p_size"),
        of("orders", "Order", "o_orderkey", None, "o_orderstatus", "o_orderpriority"), of("nation", "Nation", "n_nationkey", "n_name", "n_regionkey"), of("region", "Region", "r_regionkey", "r_name", "r_name"),
    ):
        out = out.unionByName(x)
    return out


NODES = """nodes AS (
  SELECT 'Customer' AS label, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 2 AS n_props FROM customer
  UNION ALL SELECT 'Supplier', CAST(s_suppkey AS VARCHAR), s_name, 1 FROM supplier UNION ALL SELECT 'Part', CAST(p_partkey AS VARCHAR), p_name, 3 FROM part
  UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR), NULL, 2 FROM orders UNION ALL SELECT 'Nation', CAST(n_nationkey AS VARCHAR), n_name, 1 FROM nation
  UNION ALL SELECT 'Region', CAST(r_regionkey AS VARCHAR), r_name, 1 FROM region)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_label, src_id, rel_type, dst_label, dst_id), distinct."""
    t = lambda name: table(spark, sf_dir, name)
    e = lambda df, a, src, rel, b, dst: df.select(F.lit(a).alias("src_label"), F.col(src).cast("string").alias("src_id"), F.lit(rel).alias("rel_type"), F.lit(b).alias("dst_label"), F.col(dst).cast("string").alias("dst_id"))
    lines = t("lineitem").count()  # of the files' footers
    pairs = lambda *keys: dealt(t("lineitem").select(*keys), lines, *keys).distinct()
    out = e(t("orders"), "Order", "o_orderkey", "PLACED_BY", "Customer", "o_custkey")
    for x in (
        e(pairs("l_orderkey", "l_partkey"), "Order", "l_orderkey", "CONTAINS", "Part", "l_partkey"),
        e(pairs("l_suppkey", "l_partkey"), "Supplier", "l_suppkey", "SUPPLIES", "Part", "l_partkey"),
        e(t("customer"), "Customer", "c_custkey", "IN_NATION", "Nation", "c_nationkey"), e(t("supplier"), "Supplier", "s_suppkey", "IN_NATION", "Nation", "s_nationkey"),
        e(t("nation"), "Nation", "n_nationkey", "IN_REGION", "Region", "n_regionkey"),
    ):
        out = out.unionByName(x)
    return out


EDGES = """edges AS (
  SELECT 'Order' AS src_label, CAST(o_orderkey AS VARCHAR) AS src_id, 'PLACED_BY' AS rel_type, 'Customer' AS dst_label, CAST(o_custkey AS VARCHAR) AS dst_id FROM orders
  UNION ALL SELECT DISTINCT 'Order', CAST(l_orderkey AS VARCHAR), 'CONTAINS', 'Part', CAST(l_partkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT DISTINCT 'Supplier', CAST(l_suppkey AS VARCHAR), 'SUPPLIES', 'Part', CAST(l_partkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'Customer', CAST(c_custkey AS VARCHAR), 'IN_NATION', 'Nation', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'Supplier', CAST(s_suppkey AS VARCHAR), 'IN_NATION', 'Nation', CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'Nation', CAST(n_nationkey AS VARCHAR), 'IN_REGION', 'Region', CAST(n_regionkey AS VARCHAR) FROM nation)"""
GRAPH = f"WITH {NODES}, {EDGES}"
