"""Analytics of evaluation verdicts: (test_id, category, is_correct, run_id, method, result, correct, latency_ms, tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridag.functions.numbers import rounded
from veridag.functions.text import short_id


def share(hits: Column, of: Column) -> Column:
    """hits / of, 0 where of is 0."""
    return F.coalesce(F.try_divide(hits.cast("double"), of.cast("double")), F.lit(0.0))


def wrong_pass() -> Column:
    return (F.col("result") == "PASS") & ~F.col("is_correct")


def wrong_fail() -> Column:
    return (F.col("result") == "FAIL") & F.col("is_correct")


def method_comparison(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("method").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("n_correct"), rounded(100.0 * F.avg(F.col("correct").cast("double")), 1).alias("accuracy"),
        F.count_if(wrong_pass()).alias("false_passes"), rounded(F.avg("latency_ms"), 2).alias("avg_latency"),
    )


def confusion(verdicts: DataFrame, *by: str) -> DataFrame:
    """Counts and rates with "bad output flagged FAIL" as the positive, Cohen's kappa, and the gap between agreement and kappa.

    UNCLEAR counts as not flagged.  Rates with an empty denominator are 0.
    """
    bad, flagged = ~F.col("is_correct"), F.col("result") == "FAIL"
    n = verdicts.groupBy(*by).agg(
        F.count_if(bad & flagged).alias("tp"), F.count_if(bad & ~flagged).alias("fn"), F.count_if(~bad & ~flagged).alias("tn"), F.count_if(~bad & flagged).alias("fp")
    )
    tp, fn, tn, fp = (F.col(c).cast("double") for c in ("tp", "fn", "tn", "fp"))
    total = tp + fn + tn + fp
    po = share(tp + tn, total)
    pe = share((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn), total * total)
    kappa = F.when(pe >= 1, 0.0).otherwise(share(po - pe, 1 - pe))
    return n.select(
        *by, "tp", "fn", "tn", "fp", rounded(po, 4).alias("accuracy"), rounded(share(tp, tp + fn), 4).alias("tpr"), rounded(share(tn, tn + fp), 4).alias("tnr"),
        rounded(share(tp, tp + fp), 4).alias("precision"), rounded(share(2 * tp, 2 * tp + fp + fn), 4).alias("f1"), rounded(kappa, 4).alias("kappa"), (rounded(po - kappa, 4) > 0.1).alias("gap_flag"),
    )


def pareto(rows: DataFrame, key: str) -> DataFrame:
    """Count, share and running share per key, most frequent first.  The window runs over one row a key."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()
    order = Window.orderBy(F.desc("n"), key).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(key, "n", rounded(100.0 * F.col("n") / F.sum("n").over(total), 2).alias("pct"), rounded(100.0 * F.sum("n").over(order) / F.sum("n").over(total), 2).alias("cumulative_pct"))


def cost(in_price: float, out_price: float) -> Column:
    """Dollars of a verdict at prices for a million tokens."""
    return (F.coalesce(F.col("input_tokens"), F.lit(0)) * in_price + F.coalesce(F.col("output_tokens"), F.lit(0)) * out_price) / 1e6


def run_cost(verdicts: DataFrame, in_price: float, out_price: float, per_day: int) -> DataFrame:
    c = cost(in_price, out_price)
    totals = verdicts.groupBy("run_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), rounded(F.avg(c), 8).alias("cost_per_eval"), rounded(F.avg("latency_ms"), 3).alias("ms_per_judgment")
    )
    return totals.withColumn("daily", rounded(F.col("cost_per_eval") * per_day, 4)).withColumn("monthly", rounded(F.col("cost_per_eval") * per_day * 30, 3))


def cost_by_method(verdicts: DataFrame, in_price: float, out_price: float) -> DataFrame:
    """Cost per method, and of all under the method null."""
    c = cost(in_price, out_price)
    return verdicts.rollup("method").agg(rounded(F.sum(c), 6).alias("cost"), rounded(F.avg(c), 8).alias("per_verdict"))


def leaderboard(verdicts: DataFrame, in_price: float, out_price: float) -> DataFrame:
    """Accuracy, false-pass rate over bad outputs, cost, and the number of wrong verdicts by kind, as a map."""
    kind = F.when(wrong_pass(), "false_pass").when(wrong_fail(), "false_fail").when(F.col("result") == "UNCLEAR", "unclear")
    main = verdicts.groupBy("method").agg(
        rounded(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"), rounded(share(F.count_if(wrong_pass()), F.count_if(~F.col("is_correct"))), 4).alias("false_pass_rate"),
        rounded(F.sum(cost(in_price, out_price)), 6).alias("cost"),
    )
    kinds = verdicts.where(kind.isNotNull()).groupBy("method", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    profile = kinds.groupBy("method").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))), ",").alias("profile"))
    return main.join(profile, "method", "left").orderBy(F.desc("accuracy"), "method")


def difficulty(verdicts: DataFrame) -> DataFrame:
    """Share of wrong verdicts of each test, and how far its judges disagree: (distinct results - 1) / n, 0 below two."""
    return verdicts.groupBy("test_id", "category").agg(
        F.avg((~F.col("correct")).cast("double")).alias("difficulty"), F.when(F.count(F.lit(1)) < 2, 0.0).otherwise((F.count_distinct("result") - 1) / F.count(F.lit(1))).alias("disagreement"),
        F.avg(F.when(F.col("latency_ms") != 0, F.col("latency_ms"))).alias("mean_latency"),
    )


def hardest(verdicts: DataFrame, n: int) -> DataFrame:
    tests = difficulty(verdicts).select("test_id", rounded("difficulty", 2).alias("difficulty")).where("difficulty > 0")
    return tests.orderBy(F.desc("difficulty"), "test_id").limit(n)


def category_breakdown(verdicts: DataFrame) -> DataFrame:
    """Tests of each category and the mean of their accuracies, a macro mean."""
    return difficulty(verdicts).groupBy("category").agg(F.count(F.lit(1)).alias("tests"), rounded(F.avg(1 - F.col("difficulty")), 4).alias("mean_accuracy"))


def accuracy_by(verdicts: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    return verdicts.groupBy(rows).pivot(columns, values).agg(rounded(F.avg(F.col("correct").cast("double")), 4))


def consistency(verdicts: DataFrame) -> DataFrame:
    """Distinct results of each test over its methods, and whether they differ."""
    found = verdicts.groupBy("test_id").agg(F.array_sort(F.collect_set("result")).alias("results"))
    return found.select("test_id", F.array_join("results", ",").alias("results"), (F.size("results") > 1).alias("inconsistent"))


def false_rates(verdicts: DataFrame) -> DataFrame:
    """Two false-pass rates over bad outputs, PASS alone and any wrong verdict, and the false-fail rate over good ones."""
    bad, good = ~F.col("is_correct"), F.col("is_correct")
    return verdicts.groupBy("method").agg(
        rounded(share(F.count_if(wrong_pass()), F.count_if(bad)), 4).alias("pass_on_bad"), rounded(share(F.count_if(bad & ~F.col("correct")), F.count_if(bad)), 4).alias("wrong_on_bad"),
        rounded(share(F.count_if(wrong_fail()), F.count_if(good)), 4).alias("fail_on_good"),
    )


def harder_than(verdicts: DataFrame, prefix: str) -> DataFrame:
    """Each category whose miss rate is above that of the next, in order of miss rate, under methods with a prefix.

    The window orders one row a category, after the aggregation.
    """
    miss = verdicts.where(F.col("method").startswith(prefix)).groupBy("category").agg(F.avg((~F.col("correct")).cast("double")).alias("miss"))
    order = Window.orderBy(F.desc("miss"), "category")
    next_ = miss.select("category", "miss", F.lead("category").over(order).alias("easier"), F.lead("miss").over(order).alias("easier_miss"))
    return next_.where("miss > easier_miss").select("category", "easier", rounded(F.col("miss") - F.col("easier_miss"), 4).alias("delta"))


def verdict_pivot(verdicts: DataFrame, methods: list[str]) -> DataFrame:
    """One row a test with the first verdict of each method, by run."""
    once = verdicts.withColumn("k", F.row_number().over(Window.partitionBy("test_id", "method").orderBy("run_id"))).where("k = 1")
    return once.groupBy("test_id").pivot("method", methods).agg(F.first("result"))


def unpivot_verdicts(wide: DataFrame, methods: list[str]) -> DataFrame:
    """Columns {method}_verdict and {method}_ms as rows (test_id, is_correct, method, result, latency_ms); null verdicts go."""
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}_verdict").alias("result"), F.col(f"{m}_ms").alias("latency_ms")) for m in methods])
    return wide.select("test_id", "is_correct", F.inline(pairs)).where("result is not null")


# For each kind of result row, its verdicts as (method, key of the verdict, of correctness, of latency).
RESULT_SHAPES = {
    "comprehensive": (("det", "det_verdict", "det_correct", "det_ms"), ("nr", "nr_verdict", "nr_correct", "nr_ms"), ("wr", "wr_verdict", "wr_correct", "wr_ms")),
    "rubric": (("no_rubric", "no_rubric_verdict", "no_rubric_correct", "no_rubric_ms"), ("with_rubric", "with_rubric_verdict", "with_rubric_correct", "with_rubric_ms"), ("domain_expert", "domain_expert_verdict", "domain_expert_correct", "domain_expert_ms"), ("det", "det_result", "det_correct", "det_ms")),
    "basic": (("llm_basic", "judge_verdict", "judge_correct", "judge_ms"), ("det", "det_result", "det_correct", "det_ms")),
}
BIASES = {"position_bias": "flipped", "verbosity_bias": "prefers_verbose", "adversarial": "fooled"}


def hydrated(results: DataFrame) -> DataFrame:
    """Verdict rows of result rows (test_id, kind, result: map of strings), whatever shape each row has.

    A bias probe's verdict is biased or clean by its own key.  Keys that a row lacks give no verdict.
    """
    r = F.col("result")
    one = lambda method, verdict, correct, ms: F.struct(F.lit(method).alias("method"), verdict.alias("result"), correct.alias("correct"), ms.alias("latency_ms"))
    rows = [F.when((F.col("kind") == kind) & (r[v].isNotNull() | r[c].isNotNull()), one(m, r[v], F.coalesce(r[c].try_cast("boolean"), F.lit(False)), r[ms].try_cast("double"))) for kind, shapes in RESULT_SHAPES.items() for m, v, c, ms in shapes]
    for kind, key in BIASES.items():
        biased = F.coalesce(r[key].try_cast("boolean"), F.lit(False))
        rows.append(F.when(F.col("kind") == kind, one("bias_test", F.when(biased, "biased").otherwise("clean"), ~biased, F.lit(None).cast("double"))))
    kept = [c for c in ("run_id", "test_id", "category", "is_correct", "kind") if c in results.columns]
    return results.select(*kept, F.inline(F.array_compact(F.array(*rows))))


def run_objects(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects (object_id, object_type, props) and links (source, rel_type, target) of run files' results, as read_runs gives them.

    A run, its tests and their categories, a verdict a judge and test, the judges, and a bias pattern for each verdict that
    passes what is bad.  What several files say of one object counts once, with the props of the largest run.
    """
    slug = lambda c: F.concat(F.lit("cat-"), F.regexp_replace(F.lower(c), " ", "-"))
    text = lambda **p: F.map_filter(F.create_map(*[x for k, v in p.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    obj = lambda id_, kind, props: F.struct(id_.alias("object_id"), F.lit(kind).alias("object_type"), props.alias("props"))
    link = lambda a, rel, b: F.struct(a.alias("source"), F.lit(rel).alias("rel_type"), b.alias("target"))
    run, test, category = F.col("run_id"), F.col("test_id"), F.coalesce("category", F.lit("unknown"))
    base = results.select("run_id", F.inline(F.array(
        obj(run, "EvalRun", text(source_file=F.col("file"))), obj(slug(category), "Category", text(name=category)),
        obj(test, "TestCase", text(category=category, is_correct=F.col("is_correct"), error_type=F.col("result")["error_type"])),
    )))
    v = hydrated(results).withColumn("verdict_id", F.concat_ws(":", "run_id", "test_id", "method"))
    bad = (F.col("result") == "PASS") & ~F.col("correct")
    judge, verdict, bias = F.concat(F.lit("judge-"), "method"), F.col("verdict_id"), F.when(bad, F.concat(F.lit("bias-fp-"), "verdict_id"))
    told = v.select("run_id", F.inline(F.array(
        obj(judge, "Judge", text(method=F.col("method"))), obj(verdict, "Verdict", text(result=F.col("result"), correct=F.col("correct"), latency_ms=F.col("latency_ms"))), obj(bias, "BiasPattern", text(bias_type=F.lit("false_positive"))),
    )))
    objects = base.unionByName(told).where("object_id is not null").groupBy("object_id", "object_type").agg(F.max_by("props", "run_id").alias("props"))
    links = results.select(F.inline(F.array(link(test, "BELONGS_TO", slug(category))))).unionByName(
        v.select(F.inline(F.array(link(verdict, "EVALUATED_IN", run), link(judge, "PRODUCES", verdict), link(verdict, "TESTS", test), link(verdict, "EXHIBITS", bias))))
    )
    return objects, links.where("target is not null").distinct()


def proof_lineage(evidence: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(summary, run_id, method, result, failure_mode): from each summary (summary, run_id), through the runs that it rests on,
    to their wrong verdicts and, where it has one, the mode of failure: a pass of what is bad, or a fail of what is good."""
    wrong = verdicts.where(~F.col("correct"))
    mode = F.when(F.col("result") == "PASS", F.concat(F.lit("FalsePass:"), "method")).when(F.col("result") == "FAIL", F.concat(F.lit("FalseNeg:"), "method"))
    return evidence.select("summary", "run_id").distinct().join(wrong, "run_id").select("summary", "run_id", "test_id", "method", "result", mode.alias("failure_mode"))


def eval_graph(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, id) and edges of evaluation runs: tests in categories, their outputs, verdicts in runs, failure modes."""
    v = verdicts.select("run_id", F.col("test_id").cast("string").alias("test_id"), "category", "method", "result", "correct", short_id("run_id", F.col("test_id").cast("string"), "method").alias("verdict_id"))
    mode = F.when(~F.col("correct"), F.concat(F.when(F.col("result") == "PASS", "FalsePass:").otherwise("FalseNeg:"), F.col("method")))
    e = lambda a, src, rel, b, dst: F.struct(F.lit(a).alias("src_label"), src.alias("src_id"), F.lit(rel).alias("rel_type"), F.lit(b).alias("dst_label"), dst.alias("dst_id"))
    test, verdict = F.col("test_id"), F.col("verdict_id")
    rows = F.array(e("TestCase", test, "BELONGS_TO", "Category", F.col("category")), e("TestCase", test, "HAS_OUTPUT", "Output", test), e("Output", test, "JUDGED_BY", "Verdict", verdict), e("EvalRun", F.col("run_id"), "CONTAINS", "Verdict", verdict), e("Verdict", verdict, "EXHIBITS", "FailureMode", mode))
    edges = v.select(F.inline(rows)).where("dst_id is not null").distinct()
    ends = edges.select(F.col("src_label").alias("label"), F.col("src_id").alias("id")).unionByName(edges.select(F.col("dst_label").alias("label"), F.col("dst_id").alias("id")))
    return ends.distinct(), edges


def arm_summary(results: DataFrame) -> DataFrame:
    """Per arm: n, errors, behaviour, groundedness, citations, rules and confabulation; null where nothing counts."""
    ratio = lambda hit, of: rounded(F.try_divide(F.count_if(hit).cast("double"), F.count_if(of).cast("double")), 4)
    answered, unanswerable = F.col("outcome") == "answer", F.col("expected") != "answer"
    return results.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "error").alias("errors"), ratio(F.col("behaviour_correct"), F.lit(True)).alias("behaviour_correct"),
        rounded(F.avg(F.when(answered, F.col("groundedness"))), 4).alias("groundedness"), ratio(answered & F.col("has_citation"), answered).alias("citation_coverage"),
        ratio(F.col("rules_hit"), F.col("rules_hit").isNotNull()).alias("rule_compliance"), ratio(unanswerable & answered, unanswerable).alias("confabulation"),
    )


def outcome_scored(results: DataFrame) -> DataFrame:
    """behaviour_correct and rules_hit (null where none are expected) of (outcome, expected, fired, expected_rules)."""
    hit = F.forall("expected_rules", lambda r: F.array_contains("fired", r))
    return results.withColumn("behaviour_correct", F.col("outcome") == F.col("expected")).withColumn("rules_hit", F.when(F.size("expected_rules") > 0, hit))


def check_expected(rows: DataFrame) -> DataFrame:
    """Whether actual meets expected by kind: exact, contains or at_least."""
    met = F.when(F.col("kind") == "exact", F.col("actual") == F.col("expected")).when(F.col("kind") == "contains", F.contains("actual", "expected"))
    return rows.withColumn("met", F.coalesce(met.otherwise(F.col("actual").try_cast("double") >= F.col("expected").try_cast("double")), F.lit(False)))
