"""Queries of the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridag.functions.text import short_id
from veridag.operators import graph
from veridag.plans.model import EDGES, GRAPH, NODES, edges, nodes, table
from veridag.plans.registry import query


@query(GRAPH + " SELECT label, count(*) AS n, count(DISTINCT id) AS ids, CAST(sum(n_props) AS BIGINT) AS properties FROM nodes GROUP BY label")
def node_load(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return n.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.sum(F.size("props")).cast("long").alias("properties"))


@query(f"WITH {EDGES} SELECT src_label, rel_type, dst_label, count(*) AS n FROM edges GROUP BY ALL")
def edge_patterns(spark, sf_dir):
    return graph.edge_patterns(edges(spark, sf_dir))


@query("""SELECT 'Customer' AS src_label, CAST(c_custkey AS VARCHAR) AS src_id, 'IN_NATION' AS rel_type, 'Nation' AS dst_label, CAST(n_nationkey AS VARCHAR) AS dst_id, c_mktsegment AS segment
FROM customer JOIN nation ON n_nationkey = CASE WHEN c_custkey % 10 = 0 THEN 99 ELSE c_nationkey END""")
def fk_edges(spark, sf_dir):
    """Edges from a foreign key, of the rows whose target is there, with a leftover column as a property."""
    key = F.when(F.col("c_custkey") % 10 == 0, 99).otherwise(F.col("c_nationkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", key.alias("c_nationkey"), F.col("c_mktsegment").alias("segment"))
    loaded = graph.loaded_edges(graph.foreign_edges(c, "Customer", "c_custkey", "IN_NATION", "Nation", "c_nationkey"), nodes(spark, sf_dir))
    return loaded.select(*graph.ENDS, F.col("props")["segment"].alias("segment"))


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS src_id, CAST(l_partkey AS VARCHAR) AS dst_id, arg_max(CAST(l_quantity AS VARCHAR), l_orderkey * 100000 + l_linenumber * 1000 + l_quantity) AS quantity FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY ALL""")
def edge_load(spark, sf_dir):
    """Edges with both ends known, upserted: the last line of a supplier and part gives the properties."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").alias("quantity"), (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("long")).alias("at"))
    tried = graph.foreign_edges(lines, "Supplier", "l_suppkey", "SUPPLIES", "Part", "l_partkey").withColumn("at", F.col("props")["at"].cast("long"))
    loaded = graph.loaded_edges(tried, nodes(spark, sf_dir), "at")
    return loaded.select("src_id", "dst_id", F.col("props")["quantity"].alias("quantity"))


@query(f"WITH {EDGES} SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM edges WHERE rel_type = 'SUPPLIES'")
def derived_again(spark, sf_dir):
    """A derivation that runs twice leaves its edges once: what it made before is purged first."""
    e = edges(spark, sf_dir).withColumn("derived", F.lit(False))
    derive = lambda df: df.unionByName(graph.inverse(df, "SUPPLIES", "SUPPLIED_BY").drop("confidence").withColumn("derived", F.lit(True)))
    return derive(graph.without_derived(derive(e))).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


def tagged_references(spark, sf_dir):
    """Polymorphic references: an event points at a customer, part or unknown kind, by its type."""
    kind = F.when(F.col("event_type") == "purchase", "part").when(F.col("event_type") == "error", "mystery").otherwise("client")
    return table(spark, sf_dir, "events").select("event_id", kind.alias("entity_type"), (F.col("user_id") * 17 % 2500).cast("string").alias("entity_id"))


POLY = """refs AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'part' WHEN 'error' THEN 'mystery' ELSE 'client' END AS entity_type, CAST(user_id * 17 % 2500 AS VARCHAR) AS entity_id FROM events),
alias AS (SELECT * FROM (VALUES ('part', 'Part'), ('client', 'Customer')) t(entity_type, label))"""


@query(GRAPH + f", {POLY} SELECT a.label AS dst_label, count(*) AS n, count(DISTINCT r.entity_id) AS targets FROM refs r JOIN alias a ON a.entity_type = r.entity_type JOIN nodes n ON n.label = a.label AND n.id = r.entity_id GROUP BY a.label")
def polymorphic_edges(spark, sf_dir):
    aliases = spark.createDataFrame([("part", "Part"), ("client", "Customer")], "entity_type string, label string")
    refs = tagged_references(spark, sf_dir).join(F.broadcast(aliases), "entity_type")
    keys = nodes(spark, sf_dir).where(F.col("label").isin("Part", "Customer")).select("label", F.col("id").alias("entity_id"))
    return refs.join(keys, ["label", "entity_id"]).groupBy(F.col("label").alias("dst_label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("targets"))


@query(GRAPH + f""", {POLY}, c AS (SELECT DISTINCT 'Event' AS src_label, r.entity_type AS rel_type, a.label AS dst_label, r.entity_id AS dst_id FROM refs r JOIN alias a ON a.entity_type = r.entity_type)
SELECT rel_type, src_label, count(*) AS attempted, count(n.id) AS matched FROM c LEFT JOIN nodes n ON n.label = c.dst_label AND n.id = c.dst_id GROUP BY rel_type, src_label""")
def unmatched_keys(spark, sf_dir):
    """Attempted and matched references per kind."""
    aliases = spark.createDataFrame([("part", "Part"), ("client", "Customer")], "entity_type string, dst_label string")
    refs = tagged_references(spark, sf_dir).join(F.broadcast(aliases), "entity_type")
    wanted = refs.select(F.lit("Event").alias("src_label"), F.lit("all").alias("src_id"), F.col("entity_type").alias("rel_type"), "dst_label", F.col("entity_id").alias("dst_id"))
    known = nodes(spark, sf_dir).select("label", "id").unionByName(spark.createDataFrame([("Event", "all")], "label string, id string"))
    return graph.mismatch_report(wanted, known)


@query("SELECT 'Lineitem' AS label, CAST(l_orderkey AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def key_uniqueness(spark, sf_dir):
    return graph.duplicate_keys(table(spark, sf_dir, "lineitem").select(F.lit("Lineitem").alias("label"), F.col("l_orderkey").cast("string").alias("id")))


@query("""WITH m AS (SELECT p_partkey, p_type, p_brand FROM part)
SELECT 'Part' AS entity_type, CAST(p_partkey AS VARCHAR) AS entity_id, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'ONE' ELSE upper(replace(p_brand, ' ', '')) END || ':' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS curie FROM m""")
def concept_crosswalk(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mappings = part.select(F.lit("Part").alias("entity_type"), F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_brand").alias("standard"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("external_id"))
    prefixes = part.where("p_brand like 'Brand#1%'").select(F.col("p_brand").alias("standard"), F.lit("ONE").alias("prefix")).distinct()
    return graph.crosswalk(mappings, prefixes)


@query("""SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS versions, arg_max(event_type, event_id) AS last_type, arg_max(CAST(value AS VARCHAR), event_id) FILTER (event_type = 'click') AS click,
  arg_max(CAST(value AS VARCHAR), event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""")
def upsert_by_key(spark, sf_dir):
    """Versions of a user merged property by property; the later one wins."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), "event_id", F.col("event_type").alias("last_type"), F.create_map(F.col("event_type"), F.col("value").cast("string"), F.lit("#"), F.lit("1")).alias("props"), F.lit(1).alias("one")
    )
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    versions = e.groupBy("id").agg(F.count(F.lit(1)).alias("versions"))
    merged = graph.upsert(old, new, ["id"], "event_id").join(versions, "id")
    return merged.select("id", "versions", "last_type", F.col("props")["click"].alias("click"), F.col("props")["view"].alias("view"))


@query("""SELECT o_orderkey AS order_id, n_name AS nation FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '1-URGENT'""")
def two_hop_path(spark, sf_dir):
    """Order to customer to nation."""
    e = edges(spark, sf_dir)
    start = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("origin"), F.col("o_orderkey").cast("string").alias("id"))
    found = graph.hop(graph.hop(start, e.where("src_label = 'Order'"), "PLACED_BY"), e.where("src_label = 'Customer'"), "IN_NATION")
    names = nodes(spark, sf_dir).where("label = 'Nation'").select("id", F.col("name").alias("nation"))
    return found.join(names, "id").select(F.col("origin").cast("long").alias("order_id"), "nation")


@query("SELECT DISTINCT p_name AS part, s_name AS supplier FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size = 15")
def one_hop(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size = 15").select(F.col("p_name").alias("origin"), F.col("p_partkey").cast("string").alias("id"))
    found = graph.hop(parts, edges(spark, sf_dir).where("src_label = 'Supplier'"), "SUPPLIES", backward=True)
    names = nodes(spark, sf_dir).where("label = 'Supplier'").select("id", F.col("name").alias("supplier"))
    return found.join(names, "id").select(F.col("origin").alias("part"), "supplier").distinct()


@query(f"""WITH {EDGES}, u AS (SELECT src_label || ':' || src_id AS a, dst_label || ':' || dst_id AS b FROM edges WHERE rel_type IN ('IN_NATION', 'IN_REGION')),
l AS (SELECT a, b FROM u UNION SELECT b, a FROM u), s AS (SELECT 'Region:' || r_regionkey AS origin FROM region),
h1 AS (SELECT origin, b AS node, 1 AS hops FROM s JOIN l ON a = origin), h2 AS (SELECT origin, b, 2 FROM h1 JOIN l ON a = node), h3 AS (SELECT origin, b, 3 FROM h2 t(origin, node, hops) JOIN l ON a = node),
al AS (SELECT origin, origin AS node, 0 AS hops FROM s UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)
SELECT origin, node, min(hops) AS hops FROM al GROUP BY origin, node""")
def three_hop_neighbourhood(spark, sf_dir):
    e = edges(spark, sf_dir).where(F.col("rel_type").isin("IN_NATION", "IN_REGION"))
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("Region:"), F.col("r_regionkey").cast("string")).alias("origin"))
    return graph.neighbourhood(seeds, e, 3)


@query(f"""WITH {EDGES}, ends AS (SELECT src_label AS label, src_id AS id FROM edges UNION ALL SELECT dst_label, dst_id FROM edges) SELECT label, id, count(*) AS degree FROM ends GROUP BY label, id""")
def degree(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query(f"""WITH {EDGES}, ends AS (SELECT src_label AS label, src_id AS id FROM edges UNION ALL SELECT dst_label, dst_id FROM edges), d AS (SELECT label, id, count(*) AS degree FROM ends GROUP BY label, id)
SELECT label, id, degree, CASE WHEN label = 'Nation' THEN 0 WHEN label = 'Customer' THEN 1 ELSE 2 END AS priority FROM d ORDER BY priority, degree DESC, label, id LIMIT 50""")
def capped_view(spark, sf_dir):
    """The 50 nodes that a view shows: by priority, degree and key."""
    priority = F.when(F.col("label") == "Nation", 0).when(F.col("label") == "Customer", 1).otherwise(2)
    return graph.degrees(edges(spark, sf_dir)).withColumn("priority", priority).orderBy("priority", F.desc("degree"), "label", "id").limit(50)


@query(GRAPH + """, t AS (SELECT src_label, src_id, rel_type, string_agg(dst_id, ',' ORDER BY dst_id) AS targets FROM (SELECT DISTINCT src_label, src_id, rel_type, dst_id FROM edges) GROUP BY ALL),
m AS (SELECT src_label, src_id, string_agg(rel_type || '=' || targets, ';' ORDER BY rel_type) AS relations FROM t GROUP BY ALL)
SELECT n.label AS entity_type, n.id AS entity_id, n.n_props AS n_properties, coalesce(m.relations, '') AS relations FROM nodes n LEFT JOIN m ON m.src_label = n.label AND m.src_id = n.id""")
def facts(spark, sf_dir):
    f = graph.facts(nodes(spark, sf_dir), edges(spark, sf_dir))
    shown = F.array_join(F.transform(F.map_entries("relations"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return f.select("entity_type", "entity_id", F.size("properties").alias("n_properties"), shown.alias("relations"))


@query("""SELECT label, n, keys FROM (VALUES ('Customer', (SELECT count(*) FROM customer), 'c_mktsegment,c_nationkey'), ('Supplier', (SELECT count(*) FROM supplier), 's_nationkey'), ('Part', (SELECT count(*) FROM part), 'p_brand,p_size,p_type'),
  ('Order', (SELECT count(*) FROM orders), 'o_orderpriority,o_orderstatus'), ('Nation', (SELECT count(*) FROM nation), 'n_regionkey'), ('Region', (SELECT count(*) FROM region), 'r_name')) t(label, n, keys)""")
def schema_profile(spark, sf_dir):
    return graph.schema_profile(nodes(spark, sf_dir))


@query(f"""WITH {NODES}, i AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events) SELECT i.id, n.label, coalesce(nullif(n.name, ''), i.id) AS display FROM i JOIN nodes n ON n.id = i.id""")
def resolve_names(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id")).distinct()
    return graph.resolved_names(ids, nodes(spark, sf_dir))


@query("""WITH s AS (SELECT DISTINCT 'P:' || p_size AS a, 'P:' || (p_size + 1) AS b FROM part), l AS (SELECT a, b FROM s UNION SELECT b, a FROM s), c AS (SELECT DISTINCT 'P:' || p_size AS curie FROM part),
h1 AS (SELECT curie, b FROM c JOIN l ON a = curie), h2 AS (SELECT h.curie, l.b FROM h1 h JOIN l ON l.a = h.b), h3 AS (SELECT h.curie, l.b FROM h2 h JOIN l ON l.a = h.b)
SELECT curie, min(b) AS canonical FROM (SELECT curie, curie AS b FROM c UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY curie""")
def canonical_ids(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    curie = lambda c: F.concat(F.lit("P:"), c.cast("string"))
    return graph.canonical(sizes.select(curie(F.col("p_size")).alias("curie")), sizes.select(curie(F.col("p_size")).alias("a"), curie(F.col("p_size") + 1).alias("b")))


TERMS = """terms AS (SELECT DISTINCT 'N:' || n_nationkey AS curie, n_name AS surface FROM nation UNION SELECT DISTINCT 'T:' || p_size, p_name FROM part UNION SELECT DISTINCT 'B:' || p_brand, p_name FROM part)"""


def terms(spark, sf_dir):
    curie = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("curie")
    n = table(spark, sf_dir, "nation").select(curie("N:", "n_nationkey"), F.col("n_name").alias("surface"))
    p = table(spark, sf_dir, "part").select(curie("T:", "p_size"), F.col("p_name").alias("surface"))
    r = table(spark, sf_dir, "part").select(curie("B:", "p_brand"), F.col("p_name").alias("surface"))
    return n.unionByName(p).unionByName(r).distinct()


@query(f"""WITH {TERMS}, k AS (SELECT DISTINCT curie, unnest(regexp_extract_all(lower(surface), '([a-z]{{5,}})', 1)) AS token FROM terms), f AS (SELECT * FROM k)
SELECT x.curie AS a, y.curie AS b, min(x.token) AS token FROM f x JOIN f y ON x.token = y.token AND x.curie < y.curie AND split_part(x.curie, ':', 1) <> split_part(y.curie, ':', 1) GROUP BY x.curie, y.curie""")
def crosswalk_pairs(spark, sf_dir):
    return graph.shared_token_pairs(terms(spark, sf_dir))[0]


@query(f"WITH {EDGES} SELECT dst_label AS src_label, dst_id AS src_id, 'SUPPLIED_BY' AS rel_type, src_label AS dst_label, src_id AS dst_id, CAST(1.0 AS DOUBLE) AS confidence FROM edges WHERE rel_type = 'SUPPLIES'")
def inverse_edges(spark, sf_dir):
    return graph.inverse(edges(spark, sf_dir), "SUPPLIES", "SUPPLIED_BY")


@query("""WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS needle FROM part) SELECT p_partkey AS part, needle FROM part JOIN w ON contains(lower(p_type || ' ' || p_name), needle)""")
def substring_edges(spark, sf_dir):
    """A containment join by runs of three characters, with the check after."""
    part = table(spark, sf_dir, "part")
    words = part.select(F.split("p_name", " ")[0].alias("needle"))
    parts = part.select(F.col("p_partkey").alias("part"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("text"))
    return graph.containing(parts, words).select("part", "needle")


@query("SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND n_name <> 'x'")
def abbreviation_edges(spark, sf_dir):
    """A curated list of exact pairs as an equi-join."""
    curated = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "c_mktsegment string")
    c = table(spark, sf_dir, "customer").join(F.broadcast(curated), "c_mktsegment")
    n = table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", F.col("n_name").alias("nation"))


@query( "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_concepts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("WITH s AS (SELECT DISTINCT event_type AS summary FROM events), r AS (SELECT DISTINCT user_id AS run FROM events) SELECT summary, count(*) AS runs, min(run) AS first_run FROM s CROSS JOIN r GROUP BY summary")
def summary_runs(spark, sf_dir):
    """One summary of a kind, linked to all runs: the side of the few kinds goes with each run's row."""
    e = table(spark, sf_dir, "events")
    kinds = F.array_sort(F.collect_set("event_type"))  # a summary a kind
    runs = e.select(F.col("user_id").alias("run"), F.lit(1).alias("all")).distinct()
    linked = runs.join(e.agg(kinds.alias("kinds"), F.lit(1).alias("all")), "all").select("run", F.explode("kinds").alias("summary"))
    return linked.groupBy("summary").agg(F.count(F.lit(1)).alias("runs"), F.min("run").alias("first_run"))


@query("""SELECT c_name AS name, 'segment ' || c_mktsegment || ' in ' || n_name || '; orders: ' || coalesce(o.ids, 'none') AS text FROM customer JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def corpus_text(spark, sf_dir):
    """One text an entity, with its neighbours."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(urgent, "c_custkey", "left")
    orders = F.coalesce(F.array_join(F.transform("ids", lambda i: i.cast("string")), ", "), F.lit("none"))
    return rows.select(F.col("c_name").alias("name"), F.format_string("segment %s in %s; orders: %s", "c_mktsegment", "n_name", orders).alias("text"))


@query("SELECT label, count(*) AS record_count, min(substr(md5('tpch:' || label || ':' || id), 1, 12)) AS first_id FROM (SELECT 'Customer' AS label, CAST(c_custkey AS VARCHAR) AS id FROM customer UNION ALL SELECT 'Part', CAST(p_partkey AS VARCHAR) FROM part) GROUP BY label")
def dataset_catalogue(spark, sf_dir):
    n = nodes(spark, sf_dir).where(F.col("label").isin("Customer", "Part"))
    return n.groupBy("label").agg(F.count(F.lit(1)).alias("record_count"), F.min(short_id(F.lit("tpch"), "label", "id")).alias("first_id"))


@query(GRAPH + " SELECT 'node' AS kind, label AS type, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY rel_type UNION ALL SELECT 'node', NULL, count(*) FROM nodes UNION ALL SELECT 'edge', NULL, count(*) FROM edges")
def graph_statistics(spark, sf_dir):
    count = F.count(F.lit(1)).alias("n")
    n = nodes(spark, sf_dir).rollup(F.col("label").alias("type")).agg(count).select(F.lit("node").alias("kind"), "type", "n")
    return n.unionByName(edges(spark, sf_dir).rollup(F.col("rel_type").alias("type")).agg(count).select(F.lit("edge").alias("kind"), "type", "n"))
