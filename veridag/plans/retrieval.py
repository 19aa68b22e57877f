"""Queries of vectors, linking, evidence packages, grounding and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridag.functions.numbers import rounded
from veridag.functions.text import ANSWER_STOPWORDS
from veridag.operators import context, graph, linking, rules, vectors
from veridag.operators.rules import Rule
from veridag.plans.model import edges, nodes, table
from veridag.plans.registry import query

WEIGHTS = {"vector": 1.0, "graph": 0.9, "runtime": 0.8}
BUDGET = 1500
NORM = "sqrt(list_aggregate(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 'sum'))"
COSINE = f"list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / ({NORM.format('a.embedding')} * {NORM.format('b.embedding')})"


def points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "label", (F.col("label") % 2).alias("collection"), F.col("embedding").alias("vec"))


KNN = f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS point_id, b.label, round({COSINE}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label % 2 = b.label % 2 AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s)
"""


@query(KNN + "SELECT query_id, point_id, label, score, rank FROM r WHERE rank <= 5")
def knn_cosine(spark, sf_dir):
    """The stated query set, every row whose id 20 divides, against all rows of its collection."""
    p = points(spark, sf_dir)
    q = p.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "collection", "vec")
    return vectors.nearest(q, p, 5, ["collection"]).select("query_id", "point_id", "label", "score", "rank")


@query(KNN + """, k AS (SELECT * FROM r WHERE rank <= 4) SELECT 'Eval_Cluster:' || query_id AS cluster, count(*) AS size, count(*) FILTER (k.label % 3 = 0) AS failing, round(avg(score), 5) AS mean_score FROM k
JOIN embeddings e ON e.vec_id = k.query_id AND e.label IN (0, 3, 6) GROUP BY query_id""")
def failure_clusters(spark, sf_dir):
    """Failing anchors with their neighbours, and how many of those fail too."""
    p = points(spark, sf_dir)
    q = p.where("point_id % 20 = 0 and label in (0, 3, 6)").select(F.col("point_id").alias("query_id"), "collection", "vec")
    near = vectors.nearest(q, p, 4, ["collection"])
    return near.groupBy(F.concat(F.lit("Eval_Cluster:"), F.col("query_id").cast("string")).alias("cluster")).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("label") % 3 == 0).alias("failing"), rounded(F.avg("score"), 5).alias("mean_score"))


@query("SELECT label % 2 AS collection, count(*) AS points, count(*) FILTER (len(embedding) <> 64) AS wrong_dims FROM embeddings GROUP BY ALL")
def collection_audit(spark, sf_dir):
    return points(spark, sf_dir).groupBy("collection").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.size("vec") != 64).alias("wrong_dims"))


@query("SELECT vec_id AS point_id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 25")
def scroll(spark, sf_dir):
    return points(spark, sf_dir).where("label = 3").orderBy("point_id").limit(25).select("point_id", "label")


@query("""WITH c AS (SELECT conv_id * 100 + turn AS id, CASE WHEN conv_id % 4 = 0 THEN '12.5, 7' ELSE text END AS text, CASE WHEN turn % 5 = 0 THEN '' ELSE role END AS source FROM conversations),
g AS (SELECT *, trim(text) <> '' AND NOT regexp_full_match(substr(text, 1, 24), '[-0-9.,eE \\n]+') AND source <> '' AS good FROM c) SELECT good AS admitted, count(*) AS n, min(id) AS first FROM g GROUP BY good""")
def chunk_admission(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("conv_id") % 4 == 0, "12.5, 7").otherwise(F.col("text")).alias("text"), F.when(F.col("turn") % 5 == 0, "").otherwise(F.col("role")).alias("source"))
    good, bad = vectors.admitted(c)
    count = lambda df, flag: df.agg(F.lit(flag).alias("admitted"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return count(good, True).unionByName(count(bad, False)).where("n > 0")


NAMES = "names AS (SELECT DISTINCT 'Word' AS label, split_part(p_name, ' ', 1) AS key, split_part(p_name, ' ', 1) AS name FROM part UNION SELECT DISTINCT 'Phrase', p_name, p_name FROM part WHERE p_size < 25 UNION SELECT DISTINCT 'Word', p_name, p_name FROM part WHERE p_size % 2 = 0)"


@query(f"""WITH {NAMES}, t AS (SELECT p_partkey AS text_id, p_name || ' of ' || p_brand || ' ' || p_type AS text FROM part), w AS (SELECT text_id, list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}\\-]+'), lambda x: x <> '') AS ws FROM t),
g AS (SELECT text_id, i AS start, n AS size, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM w, range(1, 7) r(n), range(1, 14) s(i) WHERE i + n - 1 <= len(ws)),
h AS (SELECT g.*, label, key, name FROM g JOIN names ON lower(name) = lower(gram) AND (length(name) >= 4 OR name = gram)),
k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.text_id = h.text_id AND o.label = h.label AND o.size > h.size AND o.start <= h.start AND o.start + o.size >= h.start + h.size))
SELECT text_id, label, key, name, min(start) AS start FROM k GROUP BY text_id, label, key, name""")
def name_resolution(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first = F.split("p_name", " ")[0]
    names = part.select(F.lit("Word").alias("label"), first.alias("key"), first.alias("name")).unionByName(part.where("p_size < 25").select(F.lit("Phrase").alias("label"), F.col("p_name").alias("key"), F.col("p_name").alias("name")))
    names = names.unionByName(part.where("p_size % 2 = 0").select(F.lit("Word").alias("label"), F.col("p_name").alias("key"), F.col("p_name").alias("name")))
    texts = part.select(F.col("p_partkey").alias("text_id"), F.concat(F.col("p_name"), F.lit(" of "), F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("text"))
    return linking.resolve_names(texts, names).select("text_id", "label", "key", "name", F.col("start").cast("long").alias("start"))


@query("SELECT curie, min(surface) AS surface FROM (SELECT 'P:' || p_size AS curie, p_name AS surface FROM part UNION ALL SELECT 'P:' || p_size, upper(p_name) FROM part UNION ALL SELECT 'N:' || n_nationkey, n_name FROM nation) WHERE length(surface) >= 2 GROUP BY curie, lower(surface)")
def term_index(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("P:"), F.col("p_size").cast("string")).alias("curie"), F.col("p_name").alias("surface"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("curie"), F.col("n_name").alias("surface"))
    return linking.term_index(part, part.withColumn("surface", F.upper("surface")), nation)


MENTIONS = KNN + """, b AS (SELECT query_id AS mention_id, point_id, score FROM r WHERE rank = 1), m AS (SELECT *, CASE WHEN score < 0.33 THEN 'unlinked' WHEN point_id % 9 = 0 THEN 'rejected' ELSE 'linked' END AS status FROM b)
"""


def mentions(spark, sf_dir):
    p = points(spark, sf_dir)
    q = p.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "collection", "vec")
    near = vectors.nearest(q, p, 1, ["collection"]).select(F.col("query_id").alias("mention_id"), F.concat(F.lit("V:"), F.col("point_id").cast("string")).alias("curie"), "score")
    concepts = p.where("point_id % 9 <> 0").select(F.concat(F.lit("V:"), F.col("point_id").cast("string")).alias("curie"))
    return linking.linked_mentions(near, concepts, 0.33)


@query(MENTIONS + "SELECT mention_id, CASE WHEN status = 'linked' THEN 'V:' || point_id END AS curie, score, status FROM m")
def mention_links(spark, sf_dir):
    return mentions(spark, sf_dir)


@query(MENTIONS + "SELECT count(*) AS considered, count(*) FILTER (status = 'linked') AS linked, count(*) FILTER (status = 'unlinked') AS unlinked, count(*) FILTER (status = 'rejected') AS rejected, round(count(*) FILTER (status = 'linked') / count(*), 4) AS link_rate FROM m")
def link_statistics(spark, sf_dir):
    n = lambda s: F.count_if(F.col("status") == s)
    return mentions(spark, sf_dir).agg(F.count(F.lit(1)).alias("considered"), n("linked").alias("linked"), n("unlinked").alias("unlinked"), n("rejected").alias("rejected"), rounded(n("linked") / F.count(F.lit(1)), 4).alias("link_rate"))


def elements(spark, sf_dir):
    """Evidence of each conversation: six documents near three times its id, whole texts."""
    conv = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    wanted = conv.select(F.col("conv_id").alias("package_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).withColumn("doc_id", F.col("package_id") * 3 + F.col("k"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    kind = F.when(F.col("k") % 3 == 0, "vector").when(F.col("k") % 3 == 1, "graph").otherwise("runtime")
    return wanted.join(docs, "doc_id").select("package_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("element_id"), kind.alias("kind"), "content", (F.col("doc_id") * 7 % 100 / 100.0).alias("score"))


ELEMENTS = """WITH wanted AS (SELECT conv_id AS package_id, k, conv_id * 3 + k AS doc_id FROM (SELECT DISTINCT conv_id FROM conversations), range(0, 6) r(k)),
elements AS (SELECT package_id, 'doc:' || w.doc_id AS element_id, CASE k % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'graph' ELSE 'runtime' END AS kind, d.text AS content, (w.doc_id * 7 % 100) / 100.0 AS score FROM wanted w JOIN documents d ON d.doc_id = w.doc_id),
weighed AS (SELECT *, round(score * CASE kind WHEN 'vector' THEN 1.0 WHEN 'graph' THEN 0.9 ELSE 0.8 END, 6) AS w, substr(sha256(regexp_replace(lower(trim(content)), '\\s+', ' ', 'g')), 1, 16) AS print, greatest(1, length(content) // 4) AS tokens FROM elements),
ranked AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY w DESC, element_id) AS rank FROM weighed),
kept AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY rank) AS step FROM (SELECT *, min(rank) OVER (PARTITION BY package_id, print) AS first FROM ranked) WHERE rank = first)
"""
RECURSIVE = ELEMENTS.replace("WITH wanted", "WITH RECURSIVE wanted", 1)


def kept_elements(spark, sf_dir):
    return context.deduplicated(context.ranked(elements(spark, sf_dir), WEIGHTS))


@query(ELEMENTS + "SELECT package_id, element_id, rank FROM kept")
def rank_dedupe(spark, sf_dir):
    return kept_elements(spark, sf_dir).select("package_id", "element_id", "rank")


@query(RECURSIVE + f""", fold AS (SELECT package_id, 0 AS step, CAST(0 AS BIGINT) AS spent, '' AS ids FROM (SELECT DISTINCT package_id FROM kept)
  UNION ALL SELECT f.package_id, k.step, CASE WHEN f.spent + k.tokens <= {BUDGET} THEN f.spent + k.tokens ELSE f.spent END, CASE WHEN f.spent + k.tokens <= {BUDGET} THEN f.ids || ' ' || k.element_id ELSE f.ids END FROM fold f JOIN kept k ON k.package_id = f.package_id AND k.step = f.step + 1)
SELECT package_id, CAST(max(step) AS INTEGER) AS n, arg_max(spent, step) AS spent, trim(arg_max(ids, step)) AS kept FROM fold GROUP BY package_id""")
def token_budget(spark, sf_dir):
    packed = context.within_budget(context.with_tokens(kept_elements(spark, sf_dir)), BUDGET)
    return packed.select("package_id", "n", "spent", F.array_join("kept", " ").alias("kept"))


def answers(spark, sf_dir):
    """The last assistant turn of each conversation, with two citations of its package and one of nothing."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("package_id")).agg(F.max_by("text", "turn").alias("text"))
    mark = lambda i: F.concat(F.lit(" [doc:"), i.cast("string"), F.lit("]"))
    extra = F.when(F.col("package_id") % 3 == 0, " [doc:999999999]").otherwise("")
    return c.select("package_id", F.concat("text", mark(F.col("package_id") * 3), mark(F.col("package_id") * 3 + 1), mark(F.col("package_id") * 3), extra).alias("answer"))


ANSWERS = ELEMENTS + """, answers AS (SELECT conv_id AS package_id, arg_max(text, turn) || ' [doc:' || (conv_id * 3) || '] [doc:' || (conv_id * 3 + 1) || '] [doc:' || (conv_id * 3) || ']' || CASE WHEN conv_id % 3 = 0 THEN ' [doc:999999999]' ELSE '' END AS answer
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
marks AS (SELECT package_id, m AS element_id FROM (SELECT DISTINCT package_id, unnest(regexp_extract_all(answer, '\\[([A-Za-z0-9_.:\\-]+)\\]', 1)) AS m FROM answers)),
cited AS (SELECT m.package_id, m.element_id, e.element_id IS NOT NULL AS valid FROM marks m LEFT JOIN (SELECT DISTINCT package_id, element_id FROM elements) e ON e.package_id = m.package_id AND e.element_id = m.element_id)
"""


@query(ANSWERS + "SELECT package_id, element_id, valid FROM cited")
def citation_check(spark, sf_dir):
    return context.cited(answers(spark, sf_dir), elements(spark, sf_dir)).select("package_id", "element_id", "valid")


STOP = ", ".join(f"'{w}'" for w in ANSWER_STOPWORDS)
WORDS = f"list_filter(list_transform(regexp_split_to_array(lower({{0}}), '\\s+'), lambda w: trim(w, '.,;:!?()[]''\"')), lambda w: length(w) > 3 AND w NOT IN ({STOP}))"
GROUNDED = ANSWERS + f""", want AS (SELECT DISTINCT package_id, unnest({WORDS.format('answer')}) AS word FROM answers), have AS (SELECT DISTINCT package_id, unnest({WORDS.format('content')}) AS word FROM elements),
o AS (SELECT w.package_id, count(h.word) / count(*) AS overlap FROM want w LEFT JOIN have h ON h.package_id = w.package_id AND h.word = w.word GROUP BY w.package_id),
c AS (SELECT package_id, count(*) FILTER (valid) AS n_cited, count(*) FILTER (NOT valid) AS n_fabricated FROM cited GROUP BY package_id),
g AS (SELECT a.package_id, a.answer, coalesce(c.n_cited, 0) AS n_cited, coalesce(c.n_fabricated, 0) AS n_fabricated, coalesce(o.overlap, 0.0) AS overlap, CASE WHEN a.package_id % 4 = 0 THEN 0.35 WHEN a.package_id % 7 = 0 THEN 1.0 ELSE 0.0 END AS penalty FROM answers a LEFT JOIN c USING (package_id) LEFT JOIN o USING (package_id)),
s AS (SELECT *, round(least(greatest((0.45 * least(n_cited / 2.0, 1.0) + 0.55 * overlap) * (1.0 - penalty) * CASE WHEN n_fabricated > 0 THEN 0.4 ELSE 1.0 END, 0.0), 1.0), 3) AS score FROM g)
"""


def grounded(spark, sf_dir, evidence=None):
    a, e = answers(spark, sf_dir), elements(spark, sf_dir) if evidence is None else evidence
    n = context.cited(a, e).groupBy("package_id").agg(F.count_if("valid").alias("n_cited"), F.count_if(~F.col("valid")).alias("n_fabricated"))
    i = F.col("package_id")
    degraded = F.when(i % 4 == 0, F.array(F.lit("graph_retriever_unavailable: timeout"), F.lit("unheard_of"))).when(i % 7 == 0, F.array(F.lit("no_context_retrieved"))).otherwise(F.array().cast("array<string>"))
    rows = a.join(n, "package_id", "left").fillna(0, ["n_cited", "n_fabricated"]).join(context.overlaps(a, e), "package_id").withColumn("degradations", degraded)
    return rows.withColumn("score", context.grounding(F.col("n_cited"), F.col("overlap"), context.penalty(F.col("degradations")), F.col("n_fabricated")))


@query(GROUNDED + "SELECT package_id, n_cited, n_fabricated, round(overlap, 6) AS overlap, score FROM s")
def grounding_score(spark, sf_dir):
    return grounded(spark, sf_dir).select("package_id", "n_cited", "n_fabricated", rounded("overlap", 6).alias("overlap"), "score")


PACK = [
    Rule("G-1", "block", "Customer", "furniture is not to be told of", {"c_mktsegment": "furniture"}),
    Rule("G-2", "warn", "Customer", "many orders", with_relation="PLACED", min_count=9),
    Rule("G-3", "warn", "Customer", "an early nation", {"c_nationkey": {"lt": 8}}),
]
FIRED = """, placed AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), subject AS (SELECT a.package_id, c.*, coalesce(p.n, 0) AS n FROM answers a JOIN customer c ON c_custkey = a.package_id LEFT JOIN placed p ON p.k = c_custkey),
told AS (SELECT package_id, lower(c_mktsegment) = 'furniture' AS is_blocked, concat_ws(' ', CASE WHEN n >= 9 THEN 'many orders' END, CASE WHEN c_nationkey < 8 THEN 'an early nation' END) AS advisories FROM subject)
"""


def fired_rules(spark, sf_dir):
    """Rules that fire for a package: its subject is the customer with its number, its facts those of the graph."""
    placed = graph.inverse(edges(spark, sf_dir).where("rel_type = 'PLACED_BY'"), "PLACED_BY", "PLACED").drop("confidence")
    subjects = answers(spark, sf_dir).select("package_id", F.col("package_id").cast("string").alias("id")).join(nodes(spark, sf_dir).where("label = 'Customer'"), "id")
    hits = rules.matches(graph.relation_counts(subjects, placed), PACK)
    return rules.verdict(hits, rules.rule_table(spark, PACK), ["package_id"])


def asked(rows):
    i = F.col("package_id")
    return rows.withColumn("question", F.when(i % 5 == 0, "Should I take this now?").when(i % 5 == 1, "what dosage do they use").otherwise("Which trial studies it?"))


OUTCOME = "CASE WHEN package_id % 5 IN (0, 1) THEN 'refused_advice' WHEN coalesce(is_blocked, false) THEN 'blocked' WHEN trim(answer) = '' OR score < 0.6 THEN 'refused_grounding' ELSE 'released' END"


@query(GROUNDED + FIRED + f"""SELECT s.package_id, {OUTCOME.replace('package_id', 's.package_id')} AS outcome, CASE WHEN outcome = 'released' THEN coalesce(t.advisories, '') ELSE '' END AS advisories FROM s LEFT JOIN told t ON t.package_id = s.package_id""")
def gate(spark, sf_dir):
    """What becomes of each answer; a released one carries the warnings that its rules gave."""
    rows = context.with_verdict(asked(grounded(spark, sf_dir)), fired_rules(spark, sf_dir))
    outcome = context.gate(F.col("question"), F.col("answer"), F.col("is_blocked"), F.col("score"))
    told = F.when(outcome == "released", F.array_join("advisories", " ")).otherwise("")
    return rows.select("package_id", outcome.alias("outcome"), told.alias("advisories"))


KEPT = RECURSIVE + f""", fold AS (SELECT package_id, 0 AS step, CAST(0 AS BIGINT) AS spent, '' AS ids, '' AS lost FROM (SELECT DISTINCT package_id FROM kept)
  UNION ALL SELECT f.package_id, k.step, CASE WHEN f.spent + k.tokens <= {BUDGET} THEN f.spent + k.tokens ELSE f.spent END, CASE WHEN f.spent + k.tokens <= {BUDGET} THEN f.ids || ' ' || k.element_id ELSE f.ids END,
    CASE WHEN f.spent + k.tokens <= {BUDGET} THEN f.lost ELSE f.lost || ' ' || k.element_id END FROM fold f JOIN kept k ON k.package_id = f.package_id AND k.step = f.step + 1),
packed AS (SELECT package_id, trim(arg_max(ids, step)) AS ids, trim(arg_max(lost, step)) AS lost FROM fold GROUP BY package_id),
kinds AS (SELECT package_id, string_agg(DISTINCT kind, ' ' ORDER BY kind) AS kinds FROM elements GROUP BY package_id),
package AS (SELECT q.package_id, coalesce(kinds, '') AS kinds, coalesce(ids, '') AS ids, coalesce(lost, '') AS lost FROM (SELECT DISTINCT conv_id AS package_id FROM conversations) q LEFT JOIN packed p ON p.package_id = q.package_id LEFT JOIN kinds k ON k.package_id = q.package_id)
"""
SOURCES = {"vector": "vector_retriever_unavailable", "graph": "graph_retriever_unavailable", "runtime": "runtime_retriever_unavailable"}


def packages(spark, sf_dir):
    return context.assembled(elements(spark, sf_dir), table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("package_id")), SOURCES, WEIGHTS, BUDGET)


@query(KEPT + """SELECT package_id, ids AS kept, lost AS dropped, concat_ws(' ', CASE WHEN NOT contains(kinds, 'vector') THEN 'vector_retriever_unavailable' END, CASE WHEN NOT contains(kinds, 'graph') THEN 'graph_retriever_unavailable' END,
  CASE WHEN NOT contains(kinds, 'runtime') THEN 'runtime_retriever_unavailable' END, CASE WHEN ids = '' THEN 'no_context_retrieved' END) AS degradations FROM package""")
def context_package(spark, sf_dir):
    """Evidence of all sources for each question: kept, dropped, and what failed."""
    p = packages(spark, sf_dir)
    return p.select("package_id", *[F.array_join(c, " ").alias(c) for c in ("kept", "dropped", "degradations")])


@query(KEPT + """, n AS (SELECT *, CASE WHEN lost = '' THEN 0 ELSE len(string_split(lost, ' ')) END AS n_lost FROM package), t AS (SELECT package_id, concat_ws('; ', CASE WHEN kinds = '' THEN 'no context was retrieved for this question' END,
  CASE WHEN kinds <> '' AND NOT contains(kinds, 'graph') THEN 'no graph evidence was found' END, CASE WHEN kinds <> '' AND NOT contains(kinds, 'vector') THEN 'no document evidence was found' END,
  CASE WHEN NOT contains(kinds, 'vector') THEN 'vector_retriever_unavailable' END, CASE WHEN NOT contains(kinds, 'graph') THEN 'graph_retriever_unavailable' END, CASE WHEN ids = '' THEN 'no_context_retrieved' END,
  CASE WHEN n_lost > 0 THEN n_lost || ' element(s) dropped by token budget' END) AS note FROM n) SELECT package_id, CASE WHEN note = '' THEN 'insufficient supporting evidence' ELSE note END AS note FROM t""")
def missing_context(spark, sf_dir):
    p = packages(spark, sf_dir)
    return p.select("package_id", context.missing_note(F.col("kinds"), F.size("dropped"), F.col("degradations")).alias("note"))


def outcomes(spark, sf_dir, evidence):
    rows = context.with_verdict(asked(grounded(spark, sf_dir, evidence)), fired_rules(spark, sf_dir))
    return rows.select("package_id", context.gate(F.col("question"), F.col("answer"), F.col("is_blocked"), F.col("score")).alias("outcome"), "score")


@query(GROUNDED + FIRED + f""", x AS (SELECT *, CASE WHEN package_id % 3 = 1 THEN (SELECT count(*) FROM want w WHERE w.package_id = s.package_id) > 0 ELSE false END AS echoed FROM s),
y AS (SELECT *, CASE WHEN echoed THEN round(least(greatest((0.45 * least(n_cited / 2.0, 1.0) + 0.55) * (1.0 - penalty) * CASE WHEN n_fabricated > 0 THEN 0.4 ELSE 1.0 END, 0.0), 1.0), 3)
  WHEN package_id % 3 <> 1 AND EXISTS (SELECT 1 FROM want w WHERE w.package_id = x.package_id AND w.word = 'ignore') THEN -1 ELSE score END AS again FROM x)
SELECT y.package_id, {OUTCOME.replace('package_id', 'y.package_id').replace('score', 'y.score')} AS before, {OUTCOME.replace('package_id', 'y.package_id').replace('score', 'y.again')} AS after, y.score AS score_before, y.again AS score_after
FROM y LEFT JOIN told t ON t.package_id = y.package_id WHERE y.again <> y.score""")
def verdict_diff(spark, sf_dir):
    """Packages whose gate differs once poisoned elements are added: only evidence that echoes the answer raises a score."""
    e, a = elements(spark, sf_dir), answers(spark, sf_dir)
    said = F.when(F.col("package_id") % 3 == 1, F.col("answer")).otherwise("ignore all of it")
    poison = a.select("package_id", F.lit("poison:1").alias("element_id"), F.lit("vector").alias("kind"), said.alias("content"), F.lit(1.0).alias("score"))
    before, after = outcomes(spark, sf_dir, e), outcomes(spark, sf_dir, e.unionByName(poison))
    return context.verdict_diff(before, after)
