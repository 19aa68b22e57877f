"""Queries of loads, corpus texts, appends to the log, linking edges and record checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridag.functions.numbers import rounded
from veridag.functions import text
from veridag.operators import assembly, context, evals, graph, linking, log, shapes, vectors
from veridag.plans.graph import TERMS, terms
from veridag.plans.model import EDGES, GRAPH, METHODS, VERDICTS, edges, nodes, table, verdicts, verdicts_wide
from veridag.plans.registry import query
from veridag.plans.retrieval import KNN, MENTIONS, mentions, points
from veridag.sources.tables import new_folder, stored
from veridag.streaming import events as streams


@query("""SELECT DISTINCT 'Part' AS src_label, CAST(p_partkey AS VARCHAR) AS src_id, 'MAPS_TO' AS rel_type, 'Concept' AS dst_label, upper(replace(p_brand, ' ', '')) || ':' || p_size AS dst_id FROM part""")
def concept_mappings(spark, sf_dir):
    """A crosswalk's concepts as edges, once however often it is loaded."""
    part = table(spark, sf_dir, "part")
    mappings = part.select(F.lit("Part").alias("entity_type"), F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_brand").alias("standard"), F.col("p_size").cast("string").alias("external_id"))
    prefixes = spark.createDataFrame([("other", "X")], "standard string, prefix string")
    c = graph.crosswalk(mappings, prefixes)
    rows = c.unionByName(c).select(F.col("entity_type").alias("src_label"), F.col("entity_id").alias("src_id"), F.lit("MAPS_TO").alias("rel_type"), F.lit("Concept").alias("dst_label"), F.col("curie").alias("dst_id"))
    known = nodes(spark, sf_dir).select("label", "id").unionByName(rows.select(F.col("dst_label").alias("label"), F.col("dst_id").alias("id")).distinct())
    return graph.matched_edges(rows, known)


SHAPED = VERDICTS + """, r AS (SELECT *, test_id % 5 AS shape FROM wide), long2 AS (
  SELECT test_id, 'comprehensive' AS kind, unnest(['det', 'nr', 'wr']) AS method, unnest([language_verdict, length_verdict, style_verdict]) AS result, unnest([language_ms, length_ms, style_ms]) AS latency_ms FROM r WHERE shape = 0
  UNION ALL SELECT test_id, 'rubric', unnest(['no_rubric', 'with_rubric', 'det']), unnest([language_verdict, length_verdict, style_verdict]), unnest([language_ms, length_ms, NULL]) FROM r WHERE shape = 1
  UNION ALL SELECT test_id, 'basic', 'llm_basic', language_verdict, language_ms FROM r WHERE shape = 2
  UNION ALL SELECT test_id, 'position_bias', 'bias_test', CASE WHEN is_correct THEN 'biased' ELSE 'clean' END, NULL FROM r WHERE shape = 3)
"""


@query(SHAPED + "SELECT test_id, kind, method, result, CAST(latency_ms AS DOUBLE) AS latency_ms, CASE WHEN kind = 'position_bias' THEN result = 'clean' ELSE result = 'PASS' END AS correct FROM long2")
def result_shapes(spark, sf_dir):
    """Verdicts of result rows of four shapes, and of one that is no result."""
    w, shape = verdicts_wide(spark, sf_dir), F.col("test_id") % 5
    passed = lambda m: (F.col(f"{m}_verdict") == "PASS").cast("string")
    pairs = lambda key, m, verdict="verdict": [F.lit(f"{key}_{verdict}"), F.col(f"{m}_verdict"), F.lit(f"{key}_correct"), passed(m)] + ([F.lit(f"{key}_ms"), F.col(f"{m}_ms").cast("string")] if verdict == "verdict" else [])
    rows = [
        F.create_map(*[x for k, m in zip(("det", "nr", "wr"), METHODS) for x in pairs(k, m)]), F.create_map(*pairs("no_rubric", METHODS[0]), *pairs("with_rubric", METHODS[1]), *pairs("det", METHODS[2], "result")),
        F.create_map(*pairs("judge", METHODS[0])), F.create_map(F.lit("flipped"), F.col("is_correct").cast("string")), F.create_map(F.lit("note"), F.lit("no result")),
    ]
    kinds = F.array(*[F.lit(k) for k in ("comprehensive", "rubric", "basic", "position_bias", "unknown")])
    shaped = w.select("test_id", F.element_at(kinds, (shape + 1).cast("int")).alias("kind"), F.element_at(F.array(*rows), (shape + 1).cast("int")).alias("result"))
    return evals.hydrated(shaped).select("test_id", "kind", "method", "result", "latency_ms", "correct")


RUN = VERDICTS + """, v AS (SELECT *, CAST(test_id AS VARCHAR) AS t, substr(md5(run_id || ':' || test_id || ':' || method), 1, 12) AS vid, CASE WHEN NOT correct THEN CASE WHEN result = 'PASS' THEN 'FalsePass:' ELSE 'FalseNeg:' END || method END AS mode FROM verdicts),
ge AS (SELECT 'TestCase' AS src_label, t AS src_id, 'BELONGS_TO' AS rel_type, 'Category' AS dst_label, category AS dst_id FROM v UNION SELECT 'TestCase', t, 'HAS_OUTPUT', 'Output', t FROM v UNION SELECT 'Output', t, 'JUDGED_BY', 'Verdict', vid FROM v
  UNION SELECT 'EvalRun', run_id, 'CONTAINS', 'Verdict', vid FROM v UNION SELECT 'Verdict', vid, 'EXHIBITS', 'FailureMode', mode FROM v WHERE mode IS NOT NULL)
"""


@query(RUN + "SELECT src_label, src_id, rel_type, dst_label, dst_id FROM ge")
def eval_graph(spark, sf_dir):
    """Runs, tests, categories, outputs, verdicts and failure modes as edges."""
    return evals.eval_graph(verdicts(spark, sf_dir))[1]


@query(RUN + "SELECT label, count(*) AS n FROM (SELECT src_label AS label, src_id AS id FROM ge UNION SELECT dst_label, dst_id FROM ge) GROUP BY label")
def eval_nodes(spark, sf_dir):
    return evals.eval_graph(verdicts(spark, sf_dir))[0].groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(RUN + "SELECT v.run_id AS run, v.vid AS verdict, v.mode AS failure_mode FROM v")
def lineage(spark, sf_dir):
    """Run to verdict to failure mode, which right verdicts lack."""
    e = evals.eval_graph(verdicts(spark, sf_dir))[1]
    held = e.where("rel_type = 'CONTAINS'").select(F.col("src_id").alias("run"), F.col("dst_id").alias("verdict"))
    modes = e.where("rel_type = 'EXHIBITS'").select(F.col("src_id").alias("verdict"), F.col("dst_id").alias("failure_mode"))
    return held.join(modes, "verdict", "left").select("run", "verdict", "failure_mode")


@query(VERDICTS + "SELECT test_id, method, result FROM verdicts")
def latest_verdicts(spark, sf_dir):
    """The last verdict of each test and method, by run: an earlier run's is of another opinion."""
    v = verdicts(spark, sf_dir).select("test_id", "method", "result", F.lit(2).alias("at"))
    older = v.withColumn("result", F.lit("UNCLEAR")).withColumn("at", F.lit(1))
    return graph.latest_by(v.unionByName(older), ["test_id", "method"], F.desc("at")).select("test_id", "method", "result")


@query(GRAPH + """, nb AS (SELECT 'Supplier' AS label, s_suppkey AS k, n_name AS other, 'nation' AS cap FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT 'Part', l_partkey, s_name, 'suppliers' FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  UNION SELECT 'Nation', n_nationkey, r_name, 'region' FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT 'Region', n_regionkey, n_name, 'nations' FROM nation UNION SELECT 'Order', o_orderkey, c_name, 'customer' FROM orders JOIN customer ON c_custkey = o_custkey),
rk AS (SELECT *, row_number() OVER (PARTITION BY label, k, cap ORDER BY other) AS rn FROM nb), o AS (SELECT label, CAST(k AS VARCHAR) AS id, string_agg(other, ', ' ORDER BY other) AS others FROM rk WHERE rn <= 8 GROUP BY ALL),
b AS (SELECT 'Supplier' AS label, CAST(s_suppkey AS VARCHAR) AS id, 'Supplier ' || s_name AS t, 'nation' AS cap FROM supplier UNION ALL SELECT 'Part', CAST(p_partkey AS VARCHAR), 'Part ' || p_name || '; brand: ' || p_brand || '; type: ' || p_type, 'suppliers' FROM part
  UNION ALL SELECT 'Nation', CAST(n_nationkey AS VARCHAR), 'Nation ' || n_name, 'region' FROM nation UNION ALL SELECT 'Region', CAST(r_regionkey AS VARCHAR), 'Region ' || r_name, 'nations' FROM region
  UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR), 'Order ' || o_orderkey || '; status: ' || o_orderstatus, 'customer' FROM orders)
SELECT b.label, b.id, b.t || '; ' || b.cap || ': ' || coalesce(o.others, 'none') AS text FROM b LEFT JOIN o ON o.label = b.label AND o.id = b.id""")
def corpus_entities(spark, sf_dir):
    """One text an entity of five kinds, with the names of its neighbours."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    specs = [("Supplier", {}, ("nation", "IN_NATION", False)), ("Part", {"p_brand": "brand", "p_type": "type"}, ("suppliers", "SUPPLIES", True)), ("Nation", {}, ("region", "IN_REGION", False)), ("Region", {}, ("nations", "IN_REGION", True)), ("Order", {"o_orderstatus": "status"}, ("customer", "PLACED_BY", False))]
    out = None
    for label, captions, relation in specs:
        one = assembly.entity_texts(n, e, label, captions, [relation])
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'policy:' || n_nationkey AS source_id, n_name AS name, n_name || ' sets rules for ' || r_name || ' (nation ' || n_nationkey || ').' AS text FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'dataset:' || p_partkey, p_name, p_name || ' is of type ' || p_type || ', size ' || p_size || ', made by ' || p_brand || '.' FROM part
UNION ALL SELECT DISTINCT 'rule:' || c_mktsegment, c_mktsegment, 'Checks of the segment {' || c_mktsegment || '}.' FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, s_name, s_name || ' has credit ' || CASE WHEN s_acctbal > 0 THEN 'yes' ELSE 'unknown' END || ' in nation ' || s_nationkey || '.' FROM supplier""")
def corpus_governance(spark, sf_dir):
    """Texts of policies, datasets, rule types and suppliers, a template a kind."""
    t = lambda name: table(spark, sf_dir, name)
    text = assembly.templated_texts
    n = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    out = text(n, "policy", "n_nationkey", "n_name", "{n_name} sets rules for {r_name} (nation {n_nationkey}).")
    out = out.unionByName(text(t("part"), "dataset", "p_partkey", "p_name", "{p_name} is of type {p_type}, size {p_size}, made by {p_brand}."))
    out = out.unionByName(text(t("customer").select("c_mktsegment").distinct(), "rule", "c_mktsegment", "c_mktsegment", "Checks of the segment {{{c_mktsegment}}}."))
    s = t("supplier").withColumn("credit", F.when(F.col("s_acctbal") > 0, "yes"))
    return out.unionByName(text(s, "supplier", "s_suppkey", "s_name", "{s_name} has credit {credit} in nation {s_nationkey}."))


@query("SELECT vec_id AS point_id, CASE WHEN vec_id % 2 = 0 AND vec_id % 6 <> 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def vector_upsert(spark, sf_dir):
    """Points replaced by id; those of another dimension are refused."""
    p = points(spark, sf_dir)
    new = p.where("point_id % 2 = 0").withColumn("label", F.col("label") + 100).withColumn("vec", F.when(F.col("point_id") % 6 == 0, F.slice("vec", 1, 3)).otherwise(F.col("vec")))
    return vectors.upserted(p, new, 64)[0].select("point_id", "label")


@query("SELECT vec_id AS point_id FROM embeddings WHERE vec_id % 6 = 0")
def refused_points(spark, sf_dir):
    p = points(spark, sf_dir)
    return vectors.upserted(p, p.withColumn("vec", F.when(F.col("point_id") % 6 == 0, F.slice("vec", 1, 3)).otherwise(F.col("vec"))), 64)[1].select("point_id")


@query("SELECT 'events' AS dataset, event_type AS title, 'log:' || event_type AS source, max(ts) AS issued, count(*) AS record_count FROM events GROUP BY event_type")
def dataset_records(spark, sf_dir):
    """A catalogue's record of each dataset: title, source, when it was issued, and how many records it has."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("issued"), F.count(F.lit(1)).alias("record_count"))
    return e.select(F.lit("events").alias("dataset"), F.col("event_type").alias("title"), F.concat(F.lit("log:"), "event_type").alias("source"), "issued", "record_count")


@query("""WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS policy_id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS policy_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'Mandatory' WHEN 'MACHINERY' THEN 'Advisory' WHEN 'FURNITURE' THEN NULL ELSE 'maybe' END AS enforcement_level, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'EU' END AS jurisdiction FROM customer)
SELECT policy_id, 'policy_name is required' AS problem FROM p WHERE policy_name = '' UNION ALL SELECT policy_id, 'jurisdiction is required' FROM p WHERE jurisdiction IS NULL UNION ALL SELECT policy_id, 'unknown enforcement_level' FROM p WHERE enforcement_level IS NULL OR enforcement_level = 'maybe'""")
def policy_violations(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    level = F.when(F.col("c_mktsegment") == "BUILDING", "Mandatory").when(F.col("c_mktsegment") == "MACHINERY", "Advisory").when(F.col("c_mktsegment") != "FURNITURE", "maybe")
    return shapes.policy_violations(c.select(k.cast("string").alias("policy_id"), F.when(k % 7 == 0, "").otherwise(F.col("c_name")).alias("policy_name"), level.alias("enforcement_level"), F.when(k % 11 != 0, "EU").alias("jurisdiction")))


@query("""WITH r AS (SELECT event_id AS id, event_id % 3 = 0 AS refused, CASE WHEN event_id % 4 < 2 THEN event_type END AS answer, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'why' END AS reason, CASE WHEN event_id % 2 = 0 THEN 'c' END AS chunk_id, CASE WHEN event_id % 7 = 0 THEN 'X:1' END AS curie FROM events)
SELECT id AS response_id, 'a refusal carries an answer' AS problem FROM r WHERE refused AND answer IS NOT NULL UNION ALL SELECT id, 'a refusal without a reason' FROM r WHERE refused AND reason = '' UNION ALL SELECT id, 'no answer' FROM r WHERE NOT refused AND answer IS NULL
UNION ALL SELECT id, 'a citation without a target' FROM r WHERE chunk_id IS NULL AND curie IS NULL""")
def response_violations(spark, sf_dir):
    i = F.col("event_id")
    r = table(spark, sf_dir, "events").select(i.alias("response_id"), (i % 3 == 0).alias("refused"), F.when(i % 4 < 2, F.col("event_type")).alias("answer"), F.when(i % 5 == 0, "").otherwise("why").alias("reason"), F.when(i % 2 == 0, "c").alias("chunk_id"), F.when(i % 7 == 0, "X:1").alias("curie"))
    return context.response_violations(r)


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(ts, ' %Y-%m-%d ') WHEN 2 THEN 'next week' END AS raw, ts FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d 00:00:00') END AS at, event_id % 4 = 2 AS quarantined FROM t""")
def parsed_times(spark, sf_dir):
    """Times as text, parsed; what is no time goes to quarantine, and null stays null."""
    i = F.col("event_id") % 4
    raw = F.when(i == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i == 1, F.date_format("ts", " yyyy-MM-dd ")).when(i == 2, "next week")
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).withColumn("at", text.parsed_time(F.col("raw")))
    return rows.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), (F.col("raw").isNotNull() & F.col("at").isNull()).alias("quarantined"))


@query("""SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR) || '|' || coalesce(source, '')), 1, 16) AS answer_hash, substr(sha256(CAST(doc_id AS VARCHAR) || '|' || coalesce(source, '')), 1, 20) AS composite, '{"doc_id":"' || doc_id || '","n_chars":"' || n_chars || '"}' AS payload,
  CASE WHEN contains(upper(string_split(trim(text), chr(10))[1]), 'PASS') THEN 'PASS' WHEN contains(upper(string_split(trim(text), chr(10))[1]), 'FAIL') THEN 'FAIL' ELSE 'UNCLEAR' END AS verdict FROM documents""")
def deterministic_ids(spark, sf_dir):
    """Ids by hashes of both lengths, a payload with sorted keys, and the verdict of the first line alone."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    parts = [k, F.coalesce("source", F.lit(""))]
    payload = text.sorted_json(F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("doc_id"), k))
    return d.select("doc_id", text.long_id(*parts, digits=16).alias("answer_hash"), text.long_id(*parts).alias("composite"), payload.alias("payload"), text.verdict_line_only(F.col("text")).alias("verdict"))


@query("SELECT event_id, event_type, ts AS occurred_at, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE ts + INTERVAL 1 MINUTE END AS ingested_at, '{\"a\":\"' || event_type || '\",\"user\":\"' || user_id || '\"}' AS payload FROM events")
def event_append(spark, sf_dir):
    """Events appended to a log that has the even ones already: each once, with both of its times."""
    e = table(spark, sf_dir, "events")
    came = F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("interval 1 minute"))
    rows = e.select("event_id", "event_type", F.col("ts").alias("occurred_at"), came.alias("ingested_at"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type")).alias("payload"))
    kind = dict(rows.dtypes)["occurred_at"]
    now = F.to_timestamp(F.lit("2024-03-01 00:00:00")).cast(kind)
    empty = spark.createDataFrame([], f"event_id long, event_type string, occurred_at {kind}, ingested_at {kind}, payload string")
    return log.appended_events(log.appended_events(empty, rows.where("event_id % 2 = 0"), now), rows, now)


@query("SELECT DISTINCT CAST(event_id AS VARCHAR) AS src_id, 'ABOUT' AS rel_type, 'Customer' AS dst_label, CAST(c_custkey AS VARCHAR) AS dst_id FROM events JOIN customer ON c_custkey = user_id")
def event_about(spark, sf_dir):
    """What events are about: the entities that map to their concepts."""
    maps_to = nodes(spark, sf_dir).where("label = 'Customer'").select(F.concat(F.lit("C:"), "id").alias("curie"), "label", "id")
    curie = F.concat(F.lit("C:"), F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.array(curie, curie, F.lit("C:none")).alias("curies"))
    return log.concept_edges(rows, "event_id", "curies", maps_to, "ABOUT")


@query("""WITH d AS (SELECT event_id AS decision_id, ts AS decided_at, CASE WHEN event_id % 2 = 0 THEN ts ELSE ts - INTERVAL 1 DAY END AS valid_from, user_id FROM events) SELECT d.decision_id, d.valid_from, count(c_custkey) AS grounds FROM d LEFT JOIN customer ON c_custkey = d.user_id GROUP BY ALL""")
def decision_append(spark, sf_dir):
    """Decisions appended once, valid from their decision if not said, with the entities in which they are grounded."""
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("decision_id"), F.col("ts").alias("decided_at"), F.when(F.col("event_id") % 2 == 1, F.col("ts") - F.expr("interval 1 day")).alias("valid_from"), "user_id")
    kept = log.appended_decisions(log.appended_decisions(d.limit(0), d.where("decision_id % 5 = 0")), d)
    maps_to = nodes(spark, sf_dir).where("label = 'Customer'").select(F.concat(F.lit("C:"), "id").alias("curie"), "label", "id")
    grounded_in = log.concept_edges(d.select("decision_id", F.array(F.concat(F.lit("C:"), F.col("user_id").cast("string"))).alias("c")), "decision_id", "c", maps_to, "GROUNDED_IN")
    n = grounded_in.groupBy(F.col("src_id").alias("decision_id")).agg(F.count(F.lit(1)).alias("grounds"))
    return kept.join(n, "decision_id", "left").select("decision_id", "valid_from", F.coalesce("grounds", F.lit(0)).alias("grounds"))


@query("""WITH d AS (SELECT c_custkey AS decision_id FROM customer) SELECT d.decision_id, count(event_id) AS n_actions, string_agg(event_type, ',' ORDER BY ts, event_type) AS actions FROM d LEFT JOIN events ON user_id = decision_id GROUP BY d.decision_id""")
def decision_actions(spark, sf_dir):
    """Decisions with their actions in order of time."""
    actions = table(spark, sf_dir, "events").select(F.col("user_id").alias("decision_id"), F.col("event_type").alias("action"), F.col("ts").alias("at"))
    return log.with_actions(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("decision_id")), actions)


@query("SELECT event_type AS stage, round(quantile_cont(value, 0.5), 3) AS p50_ms, round(quantile_cont(value, 0.95), 3) AS p95_ms FROM events GROUP BY event_type")
def stage_percentiles(spark, sf_dir):
    return log.stage_percentiles(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")), exact=True)


@query("SELECT automation, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT 'errors' AS automation, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'large', count(*) FROM events WHERE value > 100 UNION ALL SELECT 'broken', 0) GROUP BY automation")
def automation_log(spark, sf_dir):
    """Automations on a stream of events; one whose handler fails is logged and stops no other."""
    events = table(spark, sf_dir, "events")
    folder, _, name = events.inputFiles()[0].rpartition("/")
    base = new_folder(spark, "automations")

    def broken(batch):
        raise ValueError("this handler fails")

    run = streams.automations([("errors", F.col("event_type") == "error", lambda b: b), ("large", F.col("value") > 100, lambda b: b), ("broken", F.lit(True), broken)])
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet" if folder.endswith(".parquet") else name).parquet(folder)
    stream = source.writeStream.foreachBatch(lambda b, k: run(b, k).write.mode("append").parquet(f"{base}/log")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{base}/log").groupBy("automation").agg(F.sum("rows").alias("rows"))


PAIRED = f"WITH {TERMS}, k AS (SELECT DISTINCT curie, unnest(regexp_extract_all(lower(surface), '([a-z]{{5,}})', 1)) AS token FROM terms), p AS (SELECT x.curie AS a, y.curie AS b, min(x.token) AS token FROM k x JOIN k y ON x.token = y.token AND x.curie < y.curie AND split_part(x.curie, ':', 1) <> split_part(y.curie, ':', 1) GROUP BY x.curie, y.curie)"


@query(PAIRED + " SELECT a AS src_id, 'SAME_AS' AS rel_type, b AS dst_id, 'shared_name_token' AS method, token AS evidence, CAST(0.9 AS DOUBLE) AS confidence FROM p")
def same_as_edges(spark, sf_dir):
    return graph.same_as(graph.shared_token_pairs(terms(spark, sf_dir))[0])


@query("""WITH s AS (SELECT DISTINCT p_size FROM part), x AS (SELECT 'P:' || p_size AS curie, 'P:' || (p_size // 5 * 5) AS canonical FROM s), q AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'P:' || p_size END AS a, 'P:' || (p_size + p_partkey % 3) AS b FROM part)
SELECT q.a, q.b, coalesce(coalesce(x.canonical, q.a) = coalesce(y.canonical, q.b), false) AS same FROM q LEFT JOIN x ON x.curie = q.a LEFT JOIN x y ON y.curie = q.b""")
def same_concepts(spark, sf_dir):
    """Whether two names mean one concept: their canonical ids are equal; what resolves to nothing is the same as nothing."""
    p = table(spark, sf_dir, "part")
    curie = lambda c: F.concat(F.lit("P:"), c.cast("string"))
    canonicals = p.select("p_size").distinct().select(curie(F.col("p_size")).alias("curie"), curie((F.floor(F.col("p_size") / 5) * 5).cast("long")).alias("canonical"))
    pairs = p.select(F.when(F.col("p_partkey") % 9 != 0, curie(F.col("p_size"))).alias("a"), curie(F.col("p_size") + F.col("p_partkey") % 3).alias("b"))
    return graph.same_concept(pairs, canonicals)


@query(MENTIONS + "SELECT 'Chunk' AS src_label, CAST(mention_id AS VARCHAR) AS src_id, 'MENTIONS' AS rel_type, 'Concept' AS dst_label, 'V:' || point_id AS dst_id, score AS confidence FROM m WHERE status = 'linked'")
def mention_edges(spark, sf_dir):
    return linking.mention_edges(mentions(spark, sf_dir))


@query("SELECT DISTINCT 'P:' || o_custkey AS curie FROM orders WHERE o_custkey IN (SELECT p_size FROM part) OR o_custkey IN (SELECT n_nationkey + 60 FROM nation)")
def known_curies(spark, sf_dir):
    """Concepts that one of two vocabularies has."""
    curie = lambda name, c: table(spark, sf_dir, name).select(F.concat(F.lit("P:"), c.cast("string")).alias("curie"))
    return linking.known_curies(curie("orders", F.col("o_custkey")).distinct(), curie("part", F.col("p_size")), curie("nation", F.col("n_nationkey") + 60))


@query(KNN.replace("WHERE a.vec_id % 20 = 0", "AND b.label % 3 = 0 WHERE a.vec_id % 40 = 0") + """, f AS (SELECT query_id, point_id, rank FROM r WHERE rank <= 2), l AS (SELECT vec_id AS point_id, row_number() OVER (ORDER BY vec_id DESC) AS rank FROM embeddings WHERE label % 3 = 0 QUALIFY rank <= 2)
SELECT query_id, point_id, rank FROM f UNION ALL SELECT q.vec_id, l.point_id, l.rank FROM embeddings q, l WHERE q.vec_id % 20 = 0 AND q.vec_id NOT IN (SELECT query_id FROM f)""")
def decisions_or_recent(spark, sf_dir):
    """The nearest open decisions; the most recent ones for questions without a vector."""
    p = points(spark, sf_dir)
    q = p.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "collection", F.when(F.col("point_id") % 40 == 0, F.col("vec")).alias("vec"))
    opened = p.where("label % 3 = 0")
    found = vectors.nearest(q, opened, 2, ["collection"])
    return vectors.with_fallback(found, q, opened.select("point_id", F.col("point_id").alias("at")), 2)


@query(f"""WITH {EDGES}, q AS (SELECT DISTINCT conv_id AS package_id, unnest(['S:' || (conv_id % 10), 'S:' || (conv_id % 7)]) AS curie FROM conversations), s AS (SELECT DISTINCT package_id, curie, CAST(substr(curie, 3) AS BIGINT) AS k FROM q),
e AS (SELECT src_id, rel_type || ':' || dst_id AS edge FROM edges WHERE src_label = 'Supplier'), r AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY edge) AS rn FROM e), l AS (SELECT src_id, string_agg(edge, ' ' ORDER BY edge) FILTER (rn <= 8) AS links FROM r GROUP BY src_id)
SELECT package_id, 'graph:Supplier:' || s_suppkey AS element_id, 'Supplier ' || s_name || '. s_nationkey=' || s_nationkey || CASE WHEN l.links IS NULL THEN '' ELSE '. Links: ' || replace(l.links, ' ', '; ') END AS content, CAST(0.75 AS DOUBLE) AS score
FROM s JOIN supplier ON s_suppkey = s.k LEFT JOIN l ON l.src_id = CAST(s_suppkey AS VARCHAR)""")
def graph_elements(spark, sf_dir):
    """Elements of the entities that a question's concepts reach, with their links."""
    conv = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("package_id")).distinct()
    curie = lambda n: F.concat(F.lit("S:"), (F.col("package_id") % n).cast("string"))
    wanted = context.seeds(conv.withColumn("curies", F.array(curie(10), curie(7), F.lit(None).cast("string"))))
    s = nodes(spark, sf_dir).where("label = 'Supplier'")
    shown = assembly.expanded(s, edges(spark, sf_dir)).select("label", "id", F.split("shown", " ").alias("links"))
    found = wanted.withColumn("id", F.substring("curie", 3, 30)).join(s, "id").join(shown, ["label", "id"], "left")
    found = found.withColumn("links", F.coalesce("links", F.array().cast("array<string>"))).withColumn("via", F.lit("curie"))
    return context.graph_elements(found).select("package_id", "element_id", "content", "score")


@query("""WITH e AS (SELECT user_id AS package_id, 'e:' || event_id AS element_id, event_type AS kind, round(value / 100, 3) AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
SELECT package_id, string_agg('[' || element_id || '] (' || kind || ', source=log, score=' || printf('%.3f', score) || ')' || chr(10) || 'of ' || kind, chr(10) || chr(10) ORDER BY rank) AS text FROM e WHERE rank <= 3 GROUP BY package_id""")
def package_text(spark, sf_dir):
    """Packages as a prompt shows them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("package_id"), F.concat(F.lit("e:"), F.col("event_id").cast("string")).alias("element_id"), F.col("event_type").alias("kind"), rounded(F.col("value") / 100, 3).alias("score"), "value", "event_id")
    first = graph.Window.partitionBy("package_id").orderBy(F.desc("value"), "event_id")
    rows = e.withColumn("rank", F.row_number().over(first)).where("rank <= 3").withColumn("source", F.lit("log")).withColumn("content", F.concat(F.lit("of "), "kind"))
    return context.rendered(rows)


@query("SELECT label AS category, count(*) AS total, count(*) FILTER (vec_id % 3 = 0) AS correct, count(*) FILTER (vec_id % 3 <> 0 AND vec_id % 2 = 0) AS false_passes, round(count(*) FILTER (vec_id % 3 <> 0 AND vec_id % 2 = 0) / count(*), 4) AS false_pass_rate FROM embeddings GROUP BY label")
def point_breakdown(spark, sf_dir):
    """Stored points by category: how many, how many right, and how many passed wrongly."""
    right, passed = F.col("point_id") % 3 == 0, F.col("point_id") % 2 == 0
    n, bad = F.count(F.lit(1)), F.count_if(~right & passed)
    return points(spark, sf_dir).groupBy(F.col("label").alias("category")).agg(n.alias("total"), F.count_if(right).alias("correct"), bad.alias("false_passes"), rounded(bad / n, 4).alias("false_pass_rate"))


@query(RUN + "SELECT c.dst_id AS category, count(DISTINCT c.src_id) AS tests, count(*) AS verdicts FROM ge c JOIN ge j ON c.rel_type = 'BELONGS_TO' AND j.rel_type = 'JUDGED_BY' AND j.src_id = c.src_id GROUP BY c.dst_id")
def category_membership(spark, sf_dir):
    """Categories joined with their tests and those with their verdicts."""
    e = evals.eval_graph(verdicts(spark, sf_dir))[1]
    of = e.where("rel_type = 'BELONGS_TO'").select(F.col("src_id").alias("test"), F.col("dst_id").alias("category"))
    judged = e.where("rel_type = 'JUDGED_BY'").select(F.col("src_id").alias("test"))
    return of.join(judged, "test").groupBy("category").agg(F.count_distinct("test").alias("tests"), F.count(F.lit(1)).alias("verdicts"))


@query("SELECT n_name AS title, 'Policy' AS kind FROM nation UNION SELECT c_mktsegment, 'DataGovernancePolicy' FROM customer")
def policy_union(spark, sf_dir):
    """Policies of two labels, each once."""
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.lit("Policy").alias("kind"))
    return a.unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("title"), F.lit("DataGovernancePolicy").alias("kind"))).distinct()


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, 'max_count' AS \"constraint\" FROM part WHERE len(string_split(p_type, ' ')) > 1 UNION ALL SELECT target || '>' || label, 'miscased' FROM (VALUES ('PART', 'Part'), ('customer', 'Customer')) t(target, label)")
def shape_counts(spark, sf_dir):
    """Properties with more values than a shape allows, and shape targets whose case is not that of the class."""
    n = nodes(spark, sf_dir).where("label = 'Part'").withColumn("props", F.create_map(F.lit("kinds"), F.replace(F.col("props")["p_type"], F.lit(" "), F.lit(";"))))
    declared = [("PART", "kinds", "max_count", 1), ("customer", "kinds", "max_count", 1), ("Part", "kinds", "max_count", 9)]
    broken = shapes.violations(n, declared).select("id", "constraint")
    odd = [(f"{a}>{b}", "miscased") for a, b in shapes.miscased(declared, ["Part", "Customer", "Order"])]
    return broken.unionByName(spark.createDataFrame(odd, broken.schema))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') || ' (some generic name) The Policy (ab) Some Generic Name' AS t FROM documents), m AS (SELECT doc_id, unnest(regexp_extract_all(t, '\b[A-Z][A-Za-z0-9\-]+(?:\s+[A-Z][A-Za-z0-9\-]+){0,3}\b|\([a-z][a-z0-9\- ]{3,}\)')) AS m FROM t),
s AS (SELECT doc_id, trim(CASE WHEN m[1] = '(' THEN m[2:-2] ELSE m END) AS surface FROM m) SELECT doc_id, count(DISTINCT lower(surface)) AS spans, true AS in_place FROM s WHERE length(surface) >= 3 AND len(list_filter(regexp_split_to_array(lower(surface), '\s+'), lambda w: w NOT IN (@))) > 0 GROUP BY doc_id""".replace("@", ", ".join(f"'{w}'" for w in text.SPAN_NOISE)))
def mention_spans(spark, sf_dir):
    """Surfaces worth linking, whole texts, with their offsets, which each give the surface back."""
    whole = F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", "_"), F.lit(" (some generic name) The Policy (ab) Some Generic Name"))
    d = stored(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", whole.alias("text")))
    m = stored(linking.mention_rows(d.withColumnRenamed("doc_id", "text_id")))
    there = m.join(d, F.col("text_id") == F.col("doc_id")).select("doc_id", F.expr("substring(text, start + 1, end - start) = surface").alias("there"))
    return there.groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"), F.min("there").alias("in_place"))
