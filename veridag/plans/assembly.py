"""Queries of evidence assembly, scopes, merged searches, checks and actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridag.functions.numbers import rounded
from veridag.functions.text import entity_ids, id_label
from veridag.operators import assembly, evals, graph, vectors
from veridag.plans.graph import TERMS, terms
from veridag.plans.model import EDGES, GRAPH, IN_PRICE, OUT_PRICE, VERDICTS, edges, nodes, table, verdicts
from veridag.plans.registry import query
from veridag.plans.retrieval import KNN, points

ASSETS = ", ".join(f"'{w}'" for w in assembly.ASSET_TERMS)


@query(f"""WITH q AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Is the (Catalog) certified? ' || text WHEN 1 THEN 'Quality, ' || text ELSE text END AS t FROM conversations)
SELECT conv_id, turn, len(list_filter(list_transform(regexp_split_to_array(lower(t), '\\s+'), lambda w: trim(w, '.,?!:;()''"')), lambda w: w IN ({ASSETS}))) > 0 AS about_assets FROM q""")
def asset_questions(spark, sf_dir):
    i, t = F.col("turn") % 3, F.col("text")
    q = F.when(i == 0, F.concat(F.lit("Is the (Catalog) certified? "), t)).when(i == 1, F.concat(F.lit("Quality, "), t)).otherwise(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", assembly.about_assets(q).alias("about_assets"))


@query(f"""WITH {EDGES}, e AS (SELECT DISTINCT src_id, rel_type || ':' || dst_id AS edge FROM edges WHERE src_label = 'Supplier'), k AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY edge) AS k FROM e)
SELECT 'Supplier' AS label, src_id AS id, count(*) AS n, string_agg(edge, ' ' ORDER BY edge) FILTER (k <= 8) AS shown FROM k GROUP BY src_id""")
def entity_expansion(spark, sf_dir):
    return assembly.expanded(nodes(spark, sf_dir).where("label = 'Supplier'"), edges(spark, sf_dir))


@query(GRAPH + """, w AS (SELECT DISTINCT 'P:' || p_size AS curie, CAST(p_partkey AS VARCHAR) AS id FROM part ), r AS (SELECT dst_id, count(DISTINCT src_id) AS suppliers FROM edges WHERE rel_type = 'SUPPLIES' GROUP BY dst_id)
SELECT w.curie, count(*) AS entities, CAST(sum(coalesce(r.suppliers, 0)) AS BIGINT) AS suppliers FROM w LEFT JOIN r ON r.dst_id = w.id GROUP BY w.curie""")
def facts_by_concept(spark, sf_dir):
    """Concept to its entities to their facts."""
    maps_to = table(spark, sf_dir, "part").select(F.concat(F.lit("P:"), F.col("p_size").cast("string")).alias("curie"), F.lit("Part").alias("label"), F.col("p_partkey").cast("string").alias("id"))
    wanted = maps_to.distinct()
    back = graph.inverse(edges(spark, sf_dir), "SUPPLIES", "SUPPLIED_BY").drop("confidence")
    facts = graph.relation_counts(nodes(spark, sf_dir).join(wanted.select("label", "id"), ["label", "id"], "left_semi"), back, ["SUPPLIED_BY"])
    found = wanted.join(facts, wanted["id"] == facts["entity_id"])
    return found.groupBy("curie").agg(F.count(F.lit(1)).alias("entities"), F.sum(F.coalesce(F.col("relations")["SUPPLIED_BY"], F.lit(0))).cast("long").alias("suppliers"))


@query(KNN.replace("a.label % 2 = b.label % 2 AND ", "") .replace("PARTITION BY query_id ORDER BY", "PARTITION BY query_id, label % 2 ORDER BY") + """, t AS (SELECT * FROM r WHERE rank <= 3), m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS place FROM t)
SELECT query_id, point_id, label % 2 AS collection, score, place FROM m WHERE place <= 4""")
def merged_search(spark, sf_dir):
    """The best of each collection, merged and cut."""
    from pyspark.sql import Window

    p = points(spark, sf_dir)
    q = p.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "vec")
    each = q.crossJoin(p.select("collection").distinct())
    near = [vectors.nearest(each.where(F.col("collection") == c), p, 3, ["collection"]) for c in (0, 1)]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))
    return near[0].unionByName(near[1]).withColumn("place", place).where("place <= 4").select("query_id", "point_id", "collection", "score", "place")


@query(KNN.replace("WHERE a.vec_id % 20 = 0", "AND b.label % 3 = 0 WHERE a.vec_id % 20 = 0") + "SELECT query_id, point_id, score, rank FROM r WHERE rank <= 2")
def prior_decisions(spark, sf_dir):
    """The nearest open decisions: closed ones go before the cut, so that k are returned while there are k."""
    p = points(spark, sf_dir)
    q = p.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "collection", "vec")
    return vectors.nearest(q, p.where("label % 3 = 0"), 2, ["collection"]).select("query_id", "point_id", "score", "rank")


@query("SELECT name FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT p_name FROM part UNION SELECT p_type FROM part UNION SELECT c_mktsegment FROM customer) WHERE name IS NOT NULL")
def name_union(spark, sf_dir):
    t = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("name"))
    out = t("nation", "n_name")
    for x in (t("region", "r_name"), t("part", "p_name"), t("part", "p_type"), t("customer", "c_mktsegment")):
        out = out.unionByName(x)
    return out.where("name is not null").distinct()


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def first_wins(spark, sf_dir):
    return assembly.first_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query(f"WITH {TERMS}, k AS (SELECT DISTINCT curie, unnest(regexp_extract_all(lower(surface), '([a-z]{{5,}})', 1)) AS token FROM terms), c AS (SELECT token FROM k GROUP BY token HAVING count(*) > 40) SELECT token FROM c")
def crowded_tokens(spark, sf_dir):
    """Tokens that so many terms have that their pairs say little."""
    return graph.shared_token_pairs(terms(spark, sf_dir), crowded=40)[1].select("token")


@query("""WITH e AS (SELECT event_id AS q, user_id AS u, event_type AS t FROM events), c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name FROM customer),
s AS (SELECT q, 'Patient' AS label, 'PAT' || u AS id, 0 AS source FROM e UNION ALL SELECT q, 'Drug', 'D00' || (q % 10), 0 FROM e
  UNION ALL SELECT q, 'Customer', id, 1 FROM e JOIN c ON c.id = CAST(u AS VARCHAR)
  UNION ALL SELECT q, 'Part', CAST(p_partkey AS VARCHAR), 2 FROM e JOIN part ON p_partkey = u AND t = 'purchase'
  UNION ALL SELECT q, 'Patient', 'PAT' || u, 3 FROM e WHERE q % 3 = 0 UNION ALL SELECT q, 'ClinicalTrial', 'CT' || (q % 7), 3 FROM e WHERE q % 3 = 0
  UNION ALL SELECT q, 'Region', CAST(r_regionkey AS VARCHAR), 4 FROM e, region WHERE t = 'error')
SELECT q AS question_id, label, id, max(source) AS source FROM s GROUP BY ALL""")
def fact_scope(spark, sf_dir):
    """What a question's facts are drawn from: ids it names, names, concepts, ids in its graph elements, and data assets."""
    e = table(spark, sf_dir, "events").withColumn("question_id", F.col("event_id"))
    user = F.col("user_id").cast("string")
    ids = lambda df, t: df.select("question_id", F.explode(entity_ids(t)).alias("id")).select("question_id", id_label(F.col("id")).alias("label"), "id")
    named = ids(e, F.concat(F.lit("about PAT"), user, F.lit(" and D00"), (F.col("event_id") % 10).cast("string")))
    keyed = nodes(spark, sf_dir).select("label", "id")
    by_name = e.select("question_id", user.alias("id")).join(keyed.where("label = 'Customer'"), "id")
    by_concept = e.where("event_type = 'purchase'").select("question_id", user.alias("id")).join(keyed.where("label = 'Part'"), "id")
    in_elements = ids(e.where("event_id % 3 = 0"), F.concat(F.lit("Patient PAT"), user, F.lit(". Links: CT"), (F.col("event_id") % 7).cast("string")))
    question = F.when(F.col("event_type") == "error", "which table is certified?").otherwise("who is it?")
    assets = e.where(assembly.about_assets(question)).select("question_id", F.lit("Region").alias("label")).join(keyed, "label")
    return assembly.fact_scope(named, by_name, by_concept, in_elements, assets)


@query("""SELECT doc_id, contains(lower(text), 'the') AS has_word, length(text) % 2 = 0 AS even, CASE WHEN contains(text, '!!') THEN false ELSE string_split(text, ' ')[1] <> '' END AS starts FROM documents""")
def user_checks(spark, sf_dir):
    """Deterministic checks by users: a Column, a function of the text, and one that breaks on some texts."""

    def starts(t: str) -> bool:
        if "!!" in t:
            raise ValueError("loud")
        return t.split(" ")[0] != ""

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    checked = assembly.user_checks(docs, "text", {"has_word": F.contains(F.lower("text"), F.lit("the")), "even": lambda t: len(t) % 2 == 0, "starts": starts})
    return checked.select("doc_id", "has_word", "even", "starts")


@query("""WITH a AS (SELECT user_id % 200 AS object_id, event_type AS action, ts AS at, event_id AS seq FROM events), l AS (SELECT object_id, arg_max(action, seq) AS status, count(*) AS n FROM a GROUP BY object_id)
SELECT c_custkey AS object_id, coalesce(l.status, 'new') AS status, coalesce(l.n, 0) AS n_actions FROM customer LEFT JOIN l ON l.object_id = c_custkey""")
def object_actions(spark, sf_dir):
    actions = table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("object_id"), F.col("event_type").alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return assembly.acted(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id")), actions)


@query(VERDICTS + f"""SELECT test_id, method, result = 'PASS' AND NOT is_correct AS false_pass, result = 'FAIL' AND is_correct AS false_fail, round((input_tokens * {IN_PRICE} + output_tokens * {OUT_PRICE}) / 1e6, 8) AS cost FROM verdicts""")
def verdict_flags(spark, sf_dir):
    return verdicts(spark, sf_dir).select("test_id", "method", evals.wrong_pass().alias("false_pass"), evals.wrong_fail().alias("false_fail"), rounded(evals.cost(IN_PRICE, OUT_PRICE), 8).alias("cost"))


@query(f"WITH {EDGES}, c AS (SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type) SELECT rel_type, n FROM c ORDER BY n DESC, rel_type LIMIT 4")
def busiest_relations(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rel_type").limit(4)


@query("""WITH q AS (SELECT DISTINCT lower(p_brand) AS question_id, unnest([lower(p_type), lower(substr(p_name, 1, 5))]) AS term FROM part),
h AS (SELECT DISTINCT q.question_id, p_partkey AS record_id FROM q JOIN part ON term <> '' AND (contains(lower(p_name), term) OR contains(lower(p_type), term)))
SELECT question_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY record_id) AS k FROM h) WHERE k <= 20""")
def keyword_policies(spark, sf_dir):
    """For each question the first records whose folded title or scope has any of its terms."""
    p = table(spark, sf_dir, "part")
    terms_ = F.array(F.lower("p_type"), F.lower(F.substring("p_name", 1, 5)))
    questions = p.select(F.lower("p_brand").alias("question_id"), terms_.alias("terms"))
    return assembly.keyword_hits(questions, p.select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("title"), F.col("p_type").alias("scope")), 20)


@query("""SELECT event_id, 'Decision ' || event_id || ' by user ' || user_id || ': ' || event_type AS line FROM events""")
def decision_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.format_string("Decision %s by user %s: %s", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type").alias("line"))


@query(VERDICTS + """, j AS (SELECT test_id, count(*) FILTER (result = 'PASS') AS passes, any_value(is_correct) AS is_correct FROM verdicts GROUP BY test_id)
SELECT test_id, is_correct, passes FROM j WHERE (passes = 3 AND NOT is_correct) OR (passes = 0 AND is_correct)""")
def label_audit(spark, sf_dir):
    """Tests whose label all judges contradict: the label may be what is wrong."""
    by_test = verdicts(spark, sf_dir).groupBy("test_id").agg(F.count_if(F.col("result") == "PASS").alias("passes"), F.any_value("is_correct").alias("is_correct"))
    return by_test.where("(passes = 3 and not is_correct) or (passes = 0 and is_correct)").select("test_id", "is_correct", "passes")


@query("SELECT (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS building, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS finished, (SELECT c_name FROM customer WHERE c_custkey = 7) AS name")
def point_lookups(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    a = c.agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"))
    b = o.agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    return a.crossJoin(b).crossJoin(c.where("c_custkey = 7").select(F.col("c_name").alias("name")))


@query(f"""WITH {EDGES}, u AS (SELECT src_label || ':' || src_id AS me, rel_type, dst_label || ':' || dst_id AS other FROM edges UNION SELECT dst_label || ':' || dst_id, rel_type, src_label || ':' || src_id FROM edges)
SELECT me, rel_type, other FROM u WHERE me IN (SELECT 'Nation:' || n_nationkey FROM nation) OR me IN (SELECT 'Supplier:' || s_suppkey FROM supplier)""")
def linked_objects(spark, sf_dir):
    """Links with each nation and supplier, at either end."""
    wanted = nodes(spark, sf_dir).where(F.col("label").isin("Nation", "Supplier")).select("label", "id")
    return graph.links_of(edges(spark, sf_dir), wanted)
