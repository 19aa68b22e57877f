"""Queries of evaluation analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridag.functions.numbers import rounded
from veridag.operators import evals
from veridag.plans.model import IN_PRICE, METHODS, OUT_PRICE, VERDICTS, table, verdicts, verdicts_wide
from veridag.plans.registry import query

SHARE = "coalesce({} / nullif(CAST({} AS DOUBLE), 0), 0.0)"
COST = f"(input_tokens * {IN_PRICE} + output_tokens * {OUT_PRICE}) / 1e6"
CONFUSION = """, n AS (SELECT method, CAST(count(*) FILTER (NOT is_correct AND result = 'FAIL') AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT is_correct AND result <> 'FAIL') AS DOUBLE) AS fn,
  CAST(count(*) FILTER (is_correct AND result <> 'FAIL') AS DOUBLE) AS tn, CAST(count(*) FILTER (is_correct AND result = 'FAIL') AS DOUBLE) AS fp FROM verdicts GROUP BY method),
m AS (SELECT *, (tp + tn) / (tp + fn + tn + fp) AS po, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / ((tp + fn + tn + fp) * (tp + fn + tn + fp)) AS pe FROM n),
k AS (SELECT *, CASE WHEN pe >= 1 THEN 0.0 ELSE (po - pe) / (1 - pe) END AS kp FROM m)
"""


@query(VERDICTS + """SELECT method, count(*) AS total, count(*) FILTER (correct) AS n_correct, round(100.0 * avg(CAST(correct AS INT)), 1) AS accuracy,
  count(*) FILTER (result = 'PASS' AND NOT is_correct) AS false_passes, round(avg(latency_ms), 2) AS avg_latency FROM verdicts GROUP BY method""")
def method_comparison(spark, sf_dir):
    return evals.method_comparison(verdicts(spark, sf_dir))


@query(VERDICTS + CONFUSION + f"""SELECT method, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, round(po, 4) AS accuracy,
  round({SHARE.format('tp', '(tp + fn)')}, 4) AS tpr, round({SHARE.format('tn', '(tn + fp)')}, 4) AS tnr, round({SHARE.format('tp', '(tp + fp)')}, 4) AS precision,
  round({SHARE.format('2 * tp', '(2 * tp + fp + fn)')}, 4) AS f1, round(kp, 4) AS kappa, round(po - kp, 4) > 0.1 AS gap_flag FROM k""")
def confusion_metrics(spark, sf_dir):
    return evals.confusion(verdicts(spark, sf_dir), "method")


@query(VERDICTS + "SELECT category, method, count(*) AS false_passes FROM verdicts WHERE result = 'PASS' AND NOT is_correct GROUP BY category, method")
def false_pass_by_category(spark, sf_dir):
    return verdicts(spark, sf_dir).where(evals.wrong_pass()).groupBy("category", "method").agg(F.count(F.lit(1)).alias("false_passes"))


@query(VERDICTS + """, c AS (SELECT category, count(*) AS n FROM verdicts WHERE NOT correct GROUP BY category)
SELECT category, n, round(100.0 * n / sum(n) OVER (), 2) AS pct, round(100.0 * sum(n) OVER (ORDER BY n DESC, category ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 2) AS cumulative_pct FROM c""")
def error_pareto(spark, sf_dir):
    return evals.pareto(verdicts(spark, sf_dir).where("not correct"), "category")


@query(VERDICTS + f""", c AS (SELECT run_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(avg({COST}), 8) AS cost_per_eval, round(avg(latency_ms), 3) AS ms_per_judgment FROM verdicts GROUP BY run_id)
SELECT *, round(cost_per_eval * 1000, 4) AS daily, round(cost_per_eval * 30000, 3) AS monthly FROM c""")
def run_cost(spark, sf_dir):
    return evals.run_cost(verdicts(spark, sf_dir), IN_PRICE, OUT_PRICE, 1000)


@query(VERDICTS + f"SELECT method, round(sum({COST}), 6) AS cost, round(avg({COST}), 8) AS per_verdict FROM verdicts GROUP BY ROLLUP (method)")
def cost_by_judge(spark, sf_dir):
    return evals.cost_by_method(verdicts(spark, sf_dir), IN_PRICE, OUT_PRICE)


@query(VERDICTS + f""", p AS (SELECT method, CASE WHEN result = 'PASS' AND NOT is_correct THEN 'false_pass' WHEN result = 'FAIL' AND is_correct THEN 'false_fail' WHEN result = 'UNCLEAR' THEN 'unclear' END AS kind, count(*) AS n FROM verdicts GROUP BY ALL),
q AS (SELECT method, string_agg(kind || '=' || n, ',' ORDER BY kind || '=' || n) AS profile FROM p WHERE kind IS NOT NULL GROUP BY method)
SELECT v.method, round(avg(CAST(correct AS INT)), 4) AS accuracy, round({SHARE.format("count(*) FILTER (result = 'PASS' AND NOT is_correct)", "count(*) FILTER (NOT is_correct)")}, 4) AS false_pass_rate,
  round(sum({COST}), 6) AS cost, any_value(q.profile) AS profile FROM verdicts v LEFT JOIN q ON q.method = v.method GROUP BY v.method""")
def judge_leaderboard(spark, sf_dir):
    return evals.leaderboard(verdicts(spark, sf_dir), IN_PRICE, OUT_PRICE)


DIFFICULTY = VERDICTS + """, d AS (SELECT test_id, category, avg(CAST(NOT correct AS INT)) AS difficulty, CASE WHEN count(*) < 2 THEN 0.0 ELSE (count(DISTINCT result) - 1) / count(*) END AS disagreement,
  avg(CASE WHEN latency_ms <> 0 THEN latency_ms END) AS mean_latency FROM verdicts GROUP BY test_id, category)
"""


@query(DIFFICULTY + "SELECT test_id, category, round(difficulty, 4) AS difficulty, round(disagreement, 4) AS disagreement, round(mean_latency, 3) AS mean_latency FROM d")
def test_difficulty(spark, sf_dir):
    d = evals.difficulty(verdicts(spark, sf_dir))
    return d.select("test_id", "category", rounded("difficulty", 4).alias("difficulty"), rounded("disagreement", 4).alias("disagreement"), rounded("mean_latency", 3).alias("mean_latency"))


@query(DIFFICULTY + "SELECT test_id, round(difficulty, 2) AS difficulty FROM d WHERE round(difficulty, 2) > 0 ORDER BY round(difficulty, 2) DESC, test_id LIMIT 20")
def hardest_tests(spark, sf_dir):
    return evals.hardest(verdicts(spark, sf_dir), 20)


@query(DIFFICULTY + "SELECT category, count(*) AS tests, round(avg(1 - difficulty), 4) AS mean_accuracy FROM d GROUP BY category")
def category_breakdown(spark, sf_dir):
    return evals.category_breakdown(verdicts(spark, sf_dir))


@query(VERDICTS + "SELECT run_id, " + ", ".join(f"round(avg(CAST(correct AS INT)) FILTER (method = '{m}'), 4) AS {m}" for m in METHODS) + " FROM verdicts GROUP BY run_id")
def accuracy_heatmap(spark, sf_dir):
    return evals.accuracy_by(verdicts(spark, sf_dir), "run_id", "method", METHODS)


@query(VERDICTS + "SELECT test_id, string_agg(DISTINCT result, ',' ORDER BY result) AS results, count(DISTINCT result) > 1 AS inconsistent FROM verdicts GROUP BY test_id")
def judge_consistency(spark, sf_dir):
    return evals.consistency(verdicts(spark, sf_dir))


@query(VERDICTS + f"""SELECT method, round({SHARE.format("count(*) FILTER (result = 'PASS' AND NOT is_correct)", 'count(*) FILTER (NOT is_correct)')}, 4) AS pass_on_bad,
  round({SHARE.format('count(*) FILTER (NOT correct AND NOT is_correct)', 'count(*) FILTER (NOT is_correct)')}, 4) AS wrong_on_bad,
  round({SHARE.format("count(*) FILTER (result = 'FAIL' AND is_correct)", 'count(*) FILTER (is_correct)')}, 4) AS fail_on_good FROM verdicts GROUP BY method""")
def false_rates(spark, sf_dir):
    return evals.false_rates(verdicts(spark, sf_dir))


@query(VERDICTS + """, m AS (SELECT category, avg(CAST(NOT correct AS INT)) AS miss FROM verdicts WHERE starts_with(method, 'l') GROUP BY category),
n AS (SELECT category, miss, lead(category) OVER w AS easier, lead(miss) OVER w AS easier_miss FROM m WINDOW w AS (ORDER BY miss DESC, category))
SELECT category, easier, round(miss - easier_miss, 4) AS delta FROM n WHERE miss > easier_miss""")
def harder_than(spark, sf_dir):
    return evals.harder_than(verdicts(spark, sf_dir), "l")


@query(VERDICTS + "SELECT test_id, language_verdict AS language, length_verdict AS length, style_verdict AS style FROM wide")
def verdict_pivot(spark, sf_dir):
    return evals.verdict_pivot(verdicts(spark, sf_dir), METHODS)


@query(VERDICTS + "SELECT test_id, is_correct, method, result, latency_ms FROM verdicts")
def verdict_unpivot(spark, sf_dir):
    return evals.unpivot_verdicts(verdicts_wide(spark, sf_dir), METHODS)


@query(VERDICTS + """SELECT bias, count(*) AS n, round(count(*) / (SELECT count(*) FROM verdicts), 6) AS rate, min(test_id) AS first_test, max(test_id) AS last_test
FROM (SELECT test_id, CASE WHEN result = 'PASS' AND NOT is_correct THEN 'leniency' WHEN result = 'FAIL' AND is_correct THEN 'severity' WHEN result = 'UNCLEAR' THEN 'evasion' END AS bias FROM verdicts) WHERE bias IS NOT NULL GROUP BY bias""")
def bias_summary(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    bias = F.when(evals.wrong_pass(), "leniency").when(evals.wrong_fail(), "severity").when(F.col("result") == "UNCLEAR", "evasion")
    total = v.agg(F.count(F.lit(1)).alias("total"))
    found = v.select("test_id", bias.alias("bias")).where("bias is not null").groupBy("bias").agg(F.count(F.lit(1)).alias("n"), F.min("test_id").alias("first_test"), F.max("test_id").alias("last_test"))
    return found.crossJoin(F.broadcast(total)).select("bias", "n", rounded(F.col("n") / F.col("total"), 6).alias("rate"), "first_test", "last_test")


@query("""WITH p AS (SELECT doc_id, n_chars AS a, lead(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents)
SELECT count(*) AS pairs, round(avg(CASE WHEN (CASE WHEN a > 1000 THEN 'A' ELSE 'B' END) = (CASE WHEN b > 1000 THEN 'A' ELSE 'B' END) THEN 1.0 ELSE 0.0 END), 4) AS position_bias,
  round(avg(CASE WHEN b >= a THEN 1.0 ELSE 0.0 END), 4) AS verbosity_bias FROM p WHERE b IS NOT NULL""")
def pair_biases(spark, sf_dir):
    """Neighbours of one source as answer pairs: the same slot wins in both orders, or the longer one wins."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").alias("a"))
    pairs = docs.withColumn("b", F.lead("a").over(Window.partitionBy("source").orderBy("doc_id"))).where("b is not null")
    slot = lambda c: F.when(F.col(c) > 1000, "A").otherwise("B")
    rate = lambda c: rounded(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), rate(slot("a") == slot("b")).alias("position_bias"), rate(F.col("b") >= F.col("a")).alias("verbosity_bias"))


@query(VERDICTS + """SELECT lang AS attack, round(avg(CASE WHEN result = 'PASS' THEN 1.0 ELSE 0.0 END), 4) AS fooled_rate
FROM verdicts v JOIN documents d ON d.doc_id = v.test_id WHERE method = 'length' AND NOT is_correct GROUP BY lang""")
def fooled_rate(spark, sf_dir):
    v = verdicts(spark, sf_dir).where("method = 'length' and not is_correct")
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("test_id"), F.col("lang").alias("attack"))
    return v.join(langs, "test_id").groupBy("attack").agg(rounded(F.avg(F.when(F.col("result") == "PASS", 1.0).otherwise(0.0)), 4).alias("fooled_rate"))


@query("""WITH s AS (SELECT source, lang, CAST(nullif(regexp_extract('score ' || (n_chars % 10) || ' of 10', '([0-9]+)', 1), '') AS DOUBLE) AS score FROM documents),
p AS (SELECT source, avg(score) FILTER (lang = 'en') AS expert, avg(score) FILTER (lang = 'fr') AS novice FROM s GROUP BY source)
SELECT source, round(expert, 4) AS expert, round(novice, 4) AS novice, round(expert - novice, 4) AS delta FROM p""")
def authority_delta(spark, sf_dir):
    """First number of a reply, by claimed authority (here the language), and the difference."""
    reply = F.concat(F.lit("score "), (F.col("n_chars") % 10).cast("string"), F.lit(" of 10"))
    score = F.regexp_extract(F.substring(reply, 1, 50), "([0-9]+)", 1).try_cast("double")
    s = table(spark, sf_dir, "documents").select("source", "lang", score.alias("score"))
    p = s.groupBy("source").pivot("lang", ["en", "fr"]).agg(F.avg("score"))
    return p.select("source", rounded("en", 4).alias("expert"), rounded("fr", 4).alias("novice"), rounded(F.col("en") - F.col("fr"), 4).alias("delta"))


@query(VERDICTS + """SELECT method, CASE WHEN result = 'PASS' THEN 'false_pass' ELSE 'false_negative' END AS mode, count(*) AS occurrences
FROM verdicts WHERE NOT correct AND result <> 'UNCLEAR' GROUP BY ALL""")
def failure_modes(spark, sf_dir):
    mode = F.when(F.col("result") == "PASS", "false_pass").otherwise("false_negative")
    return verdicts(spark, sf_dir).where("not correct and result <> 'UNCLEAR'").groupBy("method", mode.alias("mode")).agg(F.count(F.lit(1)).alias("occurrences"))


@query(VERDICTS + "SELECT run_id, method, count(*) AS to_rerun FROM verdicts WHERE NOT correct GROUP BY run_id, method")
def rerun_failed(spark, sf_dir):
    return verdicts(spark, sf_dir).where("not correct").groupBy("run_id", "method").agg(F.count(F.lit(1)).alias("to_rerun"))


@query(VERDICTS + """SELECT category, method, count(*) AS n, count(*) FILTER (result = 'PASS' AND is_correct = false) AS fp, count(*) FILTER (result = 'FAIL' AND is_correct) AS ff FROM verdicts GROUP BY category, method""")
def mode_matrix(spark, sf_dir):
    return verdicts(spark, sf_dir).groupBy("category", "method").agg(F.count(F.lit(1)).alias("n"), F.count_if(evals.wrong_pass()).alias("fp"), F.count_if(evals.wrong_fail()).alias("ff"))


ARMS = VERDICTS + """, r AS (SELECT method AS arm, CASE result WHEN 'PASS' THEN 'answer' WHEN 'FAIL' THEN 'refuse' ELSE 'error' END AS outcome, CASE WHEN is_correct THEN 'answer' ELSE 'refuse' END AS expected,
  (test_id % 100) / 100.0 AS groundedness, test_id % 2 = 0 AS has_citation, CASE WHEN test_id % 3 <> 0 THEN test_id % 5 <> 0 END AS rules_hit FROM verdicts), s AS (SELECT *, outcome = expected AS ok FROM r)
"""


def arm_results(spark, sf_dir):
    v, i = verdicts(spark, sf_dir), F.col("test_id")
    fired = F.when(i % 5 != 0, F.array(F.lit("r1"), F.lit("r2"))).otherwise(F.array(F.lit("r2")))
    wanted = F.when(i % 3 != 0, F.array(F.lit("r1"))).otherwise(F.array().cast("array<string>"))
    return evals.outcome_scored(v.select(
        F.col("method").alias("arm"), F.when(F.col("result") == "PASS", "answer").when(F.col("result") == "FAIL", "refuse").otherwise("error").alias("outcome"),
        F.when(F.col("is_correct"), "answer").otherwise("refuse").alias("expected"), ((i % 100) / 100.0).alias("groundedness"), (i % 2 == 0).alias("has_citation"), fired.alias("fired"), wanted.alias("expected_rules"),
    ))


@query(ARMS + """SELECT arm, count(*) AS n, count(*) FILTER (outcome = 'error') AS errors, round(avg(CAST(ok AS INT)), 4) AS behaviour_correct, round(avg(groundedness) FILTER (outcome = 'answer'), 4) AS groundedness,
  round(count(*) FILTER (outcome = 'answer' AND has_citation) / nullif(count(*) FILTER (outcome = 'answer'), 0), 4) AS citation_coverage,
  round(count(*) FILTER (rules_hit) / nullif(count(*) FILTER (rules_hit IS NOT NULL), 0), 4) AS rule_compliance,
  round(count(*) FILTER (expected <> 'answer' AND outcome = 'answer') / nullif(count(*) FILTER (expected <> 'answer'), 0), 4) AS confabulation FROM s GROUP BY arm""")
def arm_summary(spark, sf_dir):
    return evals.arm_summary(arm_results(spark, sf_dir))


@query("""WITH c AS (SELECT o_orderpriority AS expected, 'exact' AS kind, o_orderpriority AS actual FROM orders UNION ALL SELECT 'HI', 'contains', o_orderpriority FROM orders UNION ALL SELECT '100000', 'at_least', CAST(o_totalprice AS VARCHAR) FROM orders)
SELECT kind, count(*) AS n, count(*) FILTER (CASE kind WHEN 'exact' THEN actual = expected WHEN 'contains' THEN contains(actual, expected) ELSE CAST(actual AS DOUBLE) >= CAST(expected AS DOUBLE) END) AS met FROM c GROUP BY kind""")
def expected_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderpriority").alias("expected"), F.lit("exact").alias("kind"), F.col("o_orderpriority").alias("actual"))
    rows = rows.unionByName(o.select(F.lit("HI").alias("expected"), F.lit("contains").alias("kind"), F.col("o_orderpriority").alias("actual")))
    rows = rows.unionByName(o.select(F.lit("100000").alias("expected"), F.lit("at_least").alias("kind"), F.col("o_totalprice").cast("string").alias("actual")))
    return evals.check_expected(rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("met").alias("met"))
