"""Queries of the decision log, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridag.functions.numbers import rounded
from veridag.operators import evals, log
from veridag.plans import evals as evaluations
from veridag.plans.model import IN_PRICE, NODES, OUT_PRICE, VERDICTS, nodes, table, verdicts
from veridag.plans.registry import ORACLES, query
from veridag.sources import tabular
from veridag.sources.tables import new_folder
from veridag.streaming import events as streams

MOMENT = "2024-01-15 12:00:00"
DECISIONS = """WITH decisions AS (SELECT event_id AS decision_id, user_id, event_type AS question, value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)
"""


def decisions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("decision_id"), "user_id", F.col("event_type").alias("question"), "value", F.col("ts").alias("valid_from"))
    return log.chained(e, "user_id", "valid_from")


@query(DECISIONS + f"SELECT decision_id, user_id, question FROM decisions WHERE valid_from <= TIMESTAMP '{MOMENT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{MOMENT}')")
def as_of(spark, sf_dir):
    return log.as_of(decisions(spark, sf_dir), F.to_timestamp(F.lit(MOMENT))).select("decision_id", "user_id", "question")


@query(DECISIONS + """, p AS (SELECT o_orderkey AS probe, o_custkey % 160 AS user_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 13 % 43000 AS BIGINT)) AS at FROM orders)
SELECT p.user_id, p.probe, p.at, d.decision_id FROM p ASOF LEFT JOIN (SELECT * FROM decisions) d ON p.user_id = d.user_id AND p.at >= d.valid_from""")
def point_in_time_join(spark, sf_dir):
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    at = F.timestamp_seconds(F.unix_timestamp(start) + F.col("o_orderkey") * 13 % 43000 * 60)
    probes = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 160).alias("user_id"), F.col("o_orderkey").alias("probe"), at.cast("timestamp_ntz").alias("at"))
    d = decisions(spark, sf_dir).withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz")).withColumn("valid_to", F.col("valid_to").cast("timestamp_ntz"))
    return log.as_of_join(probes, d, ["user_id"])


@query(DECISIONS + "SELECT decision_id, user_id, question FROM decisions WHERE valid_to IS NULL ORDER BY valid_from DESC, decision_id DESC LIMIT 10")
def recent_open(spark, sf_dir):
    return log.recent_open(decisions(spark, sf_dir), 10).select("decision_id", "user_id", "question")


@query(DECISIONS + """, c AS (SELECT decision_id, min(valid_from) + INTERVAL 1 MINUTE AS closed_at FROM decisions WHERE decision_id % 3 = 0 GROUP BY decision_id)
SELECT d.decision_id, CASE WHEN c.closed_at IS NULL THEN d.valid_to WHEN d.valid_to IS NULL THEN c.closed_at ELSE least(d.valid_to, c.closed_at) END AS valid_to FROM decisions d LEFT JOIN c ON c.decision_id = d.decision_id""")
def supersede(spark, sf_dir):
    d = decisions(spark, sf_dir)
    closes = d.where("decision_id % 3 = 0").select("decision_id", (F.col("valid_from") + F.expr("interval 1 minute")).alias("closed_at"))
    again = closes.withColumn("closed_at", F.col("closed_at") + F.expr("interval 1 day"))
    return log.superseded(d, closes.unionByName(again)).select("decision_id", "valid_to")


@query("SELECT o_orderkey AS action_id, o_orderkey * 3 AS decision_id FROM orders WHERE o_orderkey * 3 IN (SELECT event_id FROM events)")
def action_semi(spark, sf_dir):
    actions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("action_id"), (F.col("o_orderkey") * 3).alias("decision_id"))
    return log.appendable(actions, decisions(spark, sf_dir)).select("action_id", "decision_id")


@query("SELECT user_id, count(*) AS n, min(CAST(json_extract(props, '$.k') AS BIGINT)) AS least_k, max(value) AS most FROM events GROUP BY user_id")
def decision_reads(spark, sf_dir):
    """Per user: decisions, and a payload field of their JSON."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.get_json_object("props", "$.k").cast("long")).alias("least_k"), F.max("value").alias("most"))


@query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 3) AS mean_ms, max(value) AS max_ms FROM events GROUP BY event_type")
def stage_times(spark, sf_dir):
    return log.stage_times(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


@query("""WITH r AS (SELECT user_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS source, CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE round(value / 100, 4) END AS confidence FROM events)
SELECT user_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(confidence) AS weakest, count(*) FILTER (NOT (source <> '' AND confidence > 0)) AS incomplete FROM r GROUP BY user_id""")
def provenance_chain(spark, sf_dir):
    i = F.col("event_id")
    r = table(spark, sf_dir, "events").select("user_id", F.when(i % 11 == 0, "").otherwise(F.col("event_type")).alias("source"), F.when(i % 13 == 0, 0.0).otherwise(rounded(F.col("value") / 100, 4)).alias("confidence"))
    return log.provenance_chain(r, "user_id")


@query("SELECT 'a' AS part, event_id AS id FROM events WHERE event_type = 'error' AND (value < 1 OR value IS NULL) UNION ALL SELECT 'b', event_id FROM events WHERE user_id IS NULL OR event_type = ''")
def record_invariants(spark, sf_dir):
    """Rows that break an invariant: an error needs a value of at least 1, an event a user and a type."""
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'error' and (value < 1 or value is null)").select(F.lit("a").alias("part"), F.col("event_id").alias("id"))
    return a.unionByName(e.where("user_id is null or event_type = ''").select(F.lit("b").alias("part"), F.col("event_id").alias("id")))


@query("SELECT event_id FROM events WHERE to_minutes(CAST(event_id * 7 % 200 AS BIGINT)) > INTERVAL 1 HOUR")
def late_arrivals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    came = e.withColumn("ingested_at", F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") * 7 % 200).cast("int")))
    return streams.late_arrivals(came, "ts", "ingested_at", "1 hour").select("event_id")


WINDOWS = "SELECT time_bucket(INTERVAL '{w} minutes', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL"


@query(WINDOWS.format(w=10))
def windowed_counts(spark, sf_dir):
    return streams.windowed_counts(table(spark, sf_dir, "events"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streamed_dedup(spark, sf_dir):
    """Events read twice as a stream, deduplicated by id within the watermark, and written to a table that is read again."""
    events = table(spark, sf_dir, "events")
    folder, _, name = events.inputFiles()[0].rpartition("/")  # the table is one file, or a folder of them
    glob = "*.parquet" if folder.endswith(".parquet") else name
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    once = streams.deduplicated(source.unionByName(source), "40 days")
    base = new_folder(spark, "dedup")
    run = once.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{base}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS BIGINT) AS size, CASE WHEN p_partkey % 2 = 0 THEN true WHEN p_partkey % 3 = 0 THEN false END AS flag FROM part")
def coerced_types(spark, sf_dir):
    k = F.col("p_partkey")
    raw = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("size"), F.when(k % 2 == 0, " Yes ").when(k % 3 == 0, "false").otherwise("maybe").alias("flag"))
    return raw.select("p_partkey", tabular.coerced(F.col("size"), "long").alias("size"), tabular.coerced(F.col("flag"), "boolean").alias("flag"))


@query("SELECT 'Supplier' AS label, count(*) AS n, CAST(sum(CASE WHEN s_acctbal > 0 THEN 3 ELSE 2 END) AS BIGINT) AS properties FROM supplier")
def keyed_nodes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("credit"))
    n = tabular.as_nodes(s, "Supplier", "s_suppkey", "tpch").unionByName(tabular.as_nodes(s, "Supplier", "s_suppkey", "old"))
    return tabular.purged(n, "old").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("props")).cast("long").alias("properties"))


KEYED = "CASE WHEN event_id % 4 = 0 THEN 'comprehensive' WHEN event_id % 4 = 1 THEN 'position_bias' WHEN event_id % 4 = 2 THEN 'basic' ELSE 'unknown' END"


@query(f"SELECT {KEYED} AS kind, count(*) AS n FROM events GROUP BY ALL")
def result_kinds(spark, sf_dir):
    """The kind of each result row, from its own keys."""
    i = F.col("event_id") % 4
    key = F.when(i == 0, "det_verdict").when(i == 1, "flipped").when(i == 2, "judge_verdict").otherwise("other")
    rows = table(spark, sf_dir, "events").select(tabular.result_kind(F.array(F.lit("test_id"), key)).alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NODES} SELECT label, id, 'IS_A' AS rel FROM nodes")
def typed_objects(spark, sf_dir):
    return nodes(spark, sf_dir).select("label", "id", F.lit("IS_A").alias("rel"))


@query(VERDICTS + """SELECT CASE WHEN method = 'language' THEN 'Eval_' WHEN method = 'length' THEN 'Ctx_' ELSE 'Other_' END || 'x' AS name, CASE WHEN method = 'language' THEN 'Evaluation' WHEN method = 'length' THEN 'Context' ELSE 'Biomedical' END AS layer, count(*) AS n FROM verdicts GROUP BY ALL""")
def layer_labels(spark, sf_dir):
    name = F.concat(F.when(F.col("method") == "language", "Eval_").when(F.col("method") == "length", "Ctx_").otherwise("Other_"), F.lit("x"))
    layer = F.when(F.col("name").startswith("Eval_"), "Evaluation").when(F.col("name").startswith("Ctx_"), "Context").otherwise("Biomedical")
    return verdicts(spark, sf_dir).select(name.alias("name")).groupBy("name", layer.alias("layer")).agg(F.count(F.lit(1)).alias("n"))


PARTS = {"categories": evaluations.category_breakdown, "leaderboard": evaluations.judge_leaderboard, "methods": evaluations.method_comparison}


@query(f"""WITH {", ".join(f"{name} AS ({ORACLES[f.__name__]})" for name, f in PARTS.items())}
SELECT CAST(to_json(MAP {{{", ".join(f"'{name}': (SELECT CAST(to_json(list(x ORDER BY {'category' if name == 'categories' else 'method'})) AS VARCHAR) FROM {name} x)" for name in PARTS)}}}) AS VARCHAR) AS report""")
def dashboard_report(spark, sf_dir):
    """All small reads of an evaluation as one JSON document."""
    v = verdicts(spark, sf_dir)
    return tabular.report({"methods": evals.method_comparison(v), "leaderboard": evals.leaderboard(v, IN_PRICE, OUT_PRICE), "categories": evals.category_breakdown(v)})
