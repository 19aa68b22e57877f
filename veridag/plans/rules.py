"""Queries of rules, predicates and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridag.functions.text import camel_to_snake, snake_to_camel
from veridag.operators import graph, rules, shapes
from veridag.operators.rules import Rule
from veridag.plans.model import GRAPH, NODES, edges, nodes, table
from veridag.plans.registry import query

PACK = [
    Rule("ORD-1", "block", "Order", "urgent orders must not stay open", {"o_orderpriority": "1-urgent", "o_orderstatus": {"not_equals": "F"}}),
    Rule("ORD-2", "warn", "Order", "orders without a priority group", {"o_orderpriority": {"not_in": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}}, with_relation="CONTAINS", min_count=5),
    Rule("CUS-1", "info", "Customer", "segment under review", {"c_mktsegment": {"contains": "mach"}}),
    Rule("PRT-1", "warn", "Part", "large parts", {"p_size": {"gte": "45"}, "p_type": {"exists": True}}),
    Rule("PRT-2", "block", "Part", "small parts that nobody returned", without_relation="RETURNED_TO", where={"p_size": {"lt": 3}}),
    Rule("NAT-1", "block", "Nation", "never fires", {"n_regionkey": {"gt": 99}}),
]
HITS = GRAPH + """, rel AS (SELECT src_label, src_id, rel_type, count(*) AS n FROM edges GROUP BY ALL), hits AS (
  SELECT 'ORD-1' AS rule_id, CAST(o_orderkey AS VARCHAR) AS entity_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'
  UNION ALL SELECT 'ORD-2', CAST(o_orderkey AS VARCHAR) FROM orders JOIN rel ON src_label = 'Order' AND src_id = CAST(o_orderkey AS VARCHAR) AND rel_type = 'CONTAINS' AND n >= 5 WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
  UNION ALL SELECT 'CUS-1', CAST(c_custkey AS VARCHAR) FROM customer WHERE lower(c_mktsegment) LIKE '%mach%'
  UNION ALL SELECT 'PRT-1', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size >= 45 UNION ALL SELECT 'PRT-2', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size < 3 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)),
pack AS (SELECT * FROM (VALUES ('ORD-1', 'block', 0), ('ORD-2', 'warn', 1), ('CUS-1', 'info', 2), ('PRT-1', 'warn', 1), ('PRT-2', 'block', 0), ('NAT-1', 'block', 0)) t(rule_id, severity, rank))
"""


def scoped_counts(spark, sf_dir):
    """Facts of the labels and relations that the pack names; branches of other labels are pruned from the plan."""
    labels, relations = rules.named(PACK)
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select("l_partkey", "l_suppkey").distinct()
    returned = graph.foreign_edges(back, "Part", "l_partkey", "RETURNED_TO", "Supplier", "l_suppkey").drop("props")
    scoped = edges(spark, sf_dir).unionByName(returned).where(F.col("src_label").isin(labels) & F.col("rel_type").isin(relations))
    return graph.relation_counts(nodes(spark, sf_dir).where(F.col("label").isin(labels)), scoped, relations)


def rule_hits(spark, sf_dir):
    return rules.matches(scoped_counts(spark, sf_dir), PACK)


@query(HITS + """, e AS (SELECT rule_id, entity_id, row_number() OVER (PARTITION BY rule_id ORDER BY entity_id) AS k FROM hits)
SELECT e.rule_id, any_value(p.severity) AS severity, count(*) AS triggered, string_agg(entity_id, ',' ORDER BY entity_id) FILTER (k <= 3) AS examples FROM e JOIN pack p ON p.rule_id = e.rule_id GROUP BY e.rule_id""")
def rule_verdict(spark, sf_dir):
    fired = rules.verdict(rule_hits(spark, sf_dir), rules.rule_table(spark, PACK), [])
    return fired.orderBy("rank", "rule_id").select("rule_id", "severity", "triggered", "examples")


@query(HITS + "SELECT p.rule_id, count(h.rule_id) AS matches FROM pack p LEFT JOIN hits h ON h.rule_id = p.rule_id GROUP BY p.rule_id")
def rule_trace(spark, sf_dir):
    return rules.trace(rule_hits(spark, sf_dir), rules.rule_table(spark, PACK))


@query(HITS + """SELECT substr(entity_id, 1, 1) AS scope, bool_or(severity = 'block') AS blocked, count(DISTINCT p.rule_id) AS rules_fired FROM hits h JOIN pack p ON p.rule_id = h.rule_id GROUP BY ALL""")
def rule_blocked(spark, sf_dir):
    """Whether a scope, here the first digit of the key, is blocked."""
    hits = rule_hits(spark, sf_dir).withColumn("scope", F.substring("entity_id", 1, 1))
    return rules.blocked(rules.verdict(hits, rules.rule_table(spark, PACK), ["scope"]), ["scope"])


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND list_contains(string_split(lower(p_name), ' '), 'widget')")
def list_rules(spark, sf_dir):
    """contains on a property that holds a list is membership, not a substring; and NaN is above nothing."""
    parts = nodes(spark, sf_dir).where("label = 'Part'").withColumn("props", F.map_concat("props", F.create_map(F.lit("words"), F.col("name"), F.lit("weight"), F.lit("nan"))))
    size = {"p_size": {"gt": 10}}
    pack = [Rule("L-1", "info", "Part", "whole words", {"words": {"contains": "WIDGET"}} | size), Rule("L-2", "info", "Part", "parts of words", {"words": {"contains": "widge"}} | size), Rule("L-3", "info", "Part", "no number", {"weight": {"gt": 5}})]
    return rules.matches(graph.relation_counts(parts, edges(spark, sf_dir).where("false")), pack, {"words": " "}).select(F.col("entity_id").cast("long").alias("p_partkey"))


OPERATORS = {"exists": True, "equals": "click", "not_equals": "CLICK", "in": ["View", "error"], "not_in": ["View", "error"], "contains": "UR", "gt": 50, "gte": "50", "lt": 50, "lte": 50}


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN CAST(value AS VARCHAR) ELSE event_type END AS v FROM events), n AS (SELECT *, lower(v) AS f, TRY_CAST(v AS DOUBLE) AS d FROM e)
SELECT count(*) FILTER (v IS NOT NULL AND v <> '') AS "exists", count(*) FILTER (coalesce(f = 'click', false)) AS equals, count(*) FILTER (NOT coalesce(f = 'click', false)) AS not_equals, count(*) FILTER (coalesce(f IN ('view', 'error'), false)) AS "in",
  count(*) FILTER (NOT coalesce(f IN ('view', 'error'), false)) AS not_in, count(*) FILTER (coalesce(contains(f, 'ur'), false)) AS contains, count(*) FILTER (d > 50) AS gt, count(*) FILTER (d >= 50) AS gte, count(*) FILTER (d < 50) AS lt, count(*) FILTER (d <= 50) AS lte FROM n""")
def rule_operators(spark, sf_dir):
    """All operators over a column of strings, numbers and nulls."""
    v = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, F.col("value").cast("string")).otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select(v.alias("v"))
    return e.agg(*[F.count_if(rules.condition(F.col("v"), op, value)).alias(op) for op, value in OPERATORS.items()])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) >= 6)")
def with_relation(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_partkey").alias("n")).where("n >= 6")
    return table(spark, sf_dir, "orders").join(parts, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)")
def without_relation(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(returned, "s_suppkey", "left_anti").select("s_suppkey")


@query("SELECT count(*) AS n, min(c_custkey) AS first FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def property_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_nationkey = 3").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))


SHAPES = [
    ("customer", "segment", "in", ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD")), ("Customer", "c_nationkey", "min_count", 1), ("PART", "p_size", "datatype", "integer"),
    ("Part", "p_brand", "max_length", 7), ("Part", "p_type", "datatype", "float"), ("Order", "o_clerk", "min_count", 1), ("Order", "o_orderstatus", "in", ("F", "O")),
]
ALIASES = {"segment": "c_mktsegment"}
BROKEN = """WITH broken AS (SELECT 'Customer' AS label, CAST(c_custkey AS VARCHAR) AS id, 'segment' AS path, 'in' AS "constraint" FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')
  UNION ALL SELECT 'Part', CAST(p_partkey AS VARCHAR), 'p_brand', 'max_length' FROM part WHERE length(p_brand) > 7 UNION ALL SELECT 'Part', CAST(p_partkey AS VARCHAR), 'p_type', 'datatype' FROM part WHERE TRY_CAST(p_type AS DOUBLE) IS NULL
  UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR), 'o_clerk', 'min_count' FROM orders UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR), 'o_orderstatus', 'in' FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
"""


@query(BROKEN + 'SELECT label, path, "constraint", count(*) AS n, min(id) AS first FROM broken GROUP BY ALL')
def shape_violations(spark, sf_dir):
    broken = shapes.violations(nodes(spark, sf_dir), SHAPES, ALIASES)
    return broken.groupBy("label", "path", "constraint").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query(BROKEN + f", {NODES} SELECT n.label, count(DISTINCT n.id) AS nodes, count(DISTINCT b.id) AS violating FROM nodes n LEFT JOIN broken b ON b.label = n.label AND b.id = n.id GROUP BY n.label")
def shape_conformance(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return shapes.conformance(n, shapes.violations(n, SHAPES, ALIASES))


@query("SELECT 'Supplier' AS label, 's_nationkey' AS key, count(*) AS n FROM supplier UNION ALL SELECT 'Nation', 'n_regionkey', count(*) FROM nation UNION ALL SELECT 'Region', 'r_name', count(*) FROM region UNION ALL SELECT 'Order', 'o_orderpriority', count(*) FROM orders")
def unmapped_properties(spark, sf_dir):
    declared = {"Customer": {"c_mktsegment", "c_nationkey"}, "Part": {"p_size", "p_brand", "p_type"}, "Order": {"o_clerk", "o_orderstatus"}}
    return shapes.unmapped(nodes(spark, sf_dir), declared, {"dataset"})


@query(BROKEN + """, k AS (SELECT * FROM (VALUES ('o_clerk', 'source has no clerks'), ('p_type', 'types are words')) t(path, reason)) SELECT b.path, coalesce(k.reason, 'unexpected') AS reason, count(*) AS n FROM broken b LEFT JOIN k ON k.path = b.path GROUP BY ALL""")
def known_conflicts(spark, sf_dir):
    known = spark.createDataFrame([("o_clerk", "source has no clerks"), ("p_type", "types are words")], "path string, reason string")
    broken = shapes.violations(nodes(spark, sf_dir), SHAPES, ALIASES).join(F.broadcast(known), "path", "left")
    return broken.groupBy("path", F.coalesce("reason", F.lit("unexpected")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT 'tpch' AS module, 'part:' || p_partkey AS s, 'brand' AS p, p_brand AS o FROM part UNION ALL SELECT 'tpch', 'part:' || p_partkey, 'type', p_type FROM part UNION ALL SELECT 'extra', 'part:' || p_partkey, 'brand', p_brand FROM part WHERE p_partkey % 2 = 0),
d AS (SELECT s, p, o FROM t GROUP BY ALL HAVING count(*) > 1)
SELECT module, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, (SELECT count(*) FROM d) AS repeated FROM t GROUP BY module""")
def vocabulary_audit(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    s = F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("s")
    t = part.select(F.lit("tpch").alias("module"), s, F.lit("brand").alias("p"), F.col("p_brand").alias("o"))
    t = t.unionByName(part.select(F.lit("tpch").alias("module"), s, F.lit("type").alias("p"), F.col("p_type").alias("o"))).unionByName(part.where("p_partkey % 2 = 0").select(F.lit("extra").alias("module"), s, F.lit("brand").alias("p"), F.col("p_brand").alias("o")))
    repeated = t.groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("repeated"))
    return t.groupBy("module").agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates")).crossJoin(repeated)


@query("""SELECT event_type, lower(regexp_replace(event_type || 'Kind' || upper(substr(event_type, 1, 1)), '([A-Z])', '_\\1', 'g')) AS snake, event_type || 'Kind' AS camel, count(*) AS n FROM events GROUP BY ALL""")
def case_conversion(spark, sf_dir):
    t = F.col("event_type")
    kinds = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.select("event_type", camel_to_snake(F.concat(t, F.lit("Kind"), F.upper(F.substring(t, 1, 1)))).alias("snake"), snake_to_camel(F.concat(t, F.lit("_kind"))).alias("camel"), "n")
