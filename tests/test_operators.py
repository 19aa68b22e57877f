"""Golden values, truth tables and edge cases of the library's operators."""

import pytest
from pyspark.sql import functions as F

from veridag.functions import text
from veridag.operators import context, evals, graph, linking, log, rules, shapes, vectors
from veridag.sources import tabular
from veridag.streaming import events as streams


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("op, value, held, expected", [
    ("exists", True, "x", True), ("exists", True, "", False), ("exists", False, None, True), ("equals", "Active", "ACTIVE", True), ("equals", "a", None, False), ("not_equals", "a", None, True),
    ("not_equals", "a", "A", False), ("in", ["A", "b"], "a", True), ("in", ["a"], None, False), ("not_in", ["a"], None, True), ("not_in", ["a"], "A", False), ("contains", "UR", "hurt", True),
    ("contains", "x", None, False), ("gt", 5, "6", True), ("gt", 5, "six", False), ("gte", "5", "5.0", True), ("lt", 5, None, False), ("lte", 5, "5", True), ("lt", 5, "true", False),
    ("gt", 5, "nan", False), ("lte", 5, "NaN", False), ("gte", 5, "1_000", False),
])
def test_rule_operators(spark, op, value, held, expected):
    assert one(spark, rules.condition(F.col("v").cast("string"), op, value), v=held) is expected


def verdict_rows(spark, rows):
    full = [(i, "c", good, "r", "m", result, (result == "PASS") == good if result != "UNCLEAR" else False, 10, 100, 10) for i, (good, result) in enumerate(rows)]
    return spark.createDataFrame(full, "test_id long, category string, is_correct boolean, run_id string, method string, result string, correct boolean, latency_ms long, input_tokens long, output_tokens long")


@pytest.mark.parametrize("counts, kappa, accuracy", [((7, 0, 0, 5), 0.0, 0.5833), ((7, 0, 5, 0), 1.0, 1.0), ((6, 1, 5, 0), 0.8333, 0.9167)])
def test_published_confusion(spark, counts, kappa, accuracy):
    tp, fn, tn, fp = counts
    rows = [(False, "FAIL")] * tp + [(False, "PASS")] * fn + [(True, "PASS")] * tn + [(True, "FAIL")] * fp
    got = evals.confusion(verdict_rows(spark, rows), "method").first()
    assert (got["tp"], got["fn"], got["tn"], got["fp"]) == counts
    assert round(got["kappa"], 3) == pytest.approx(round(kappa, 3)) and got["accuracy"] == pytest.approx(accuracy)


def test_confusion_of_nothing(spark):
    assert evals.confusion(verdict_rows(spark, []), "method").count() == 0


def test_rule_documents():
    good = '{"rule_id": "b", "severity": "warn", "entity": "X", "rationale": "r", "where": {"p": {"gt": 1}}}'
    assert [r.rule_id for r in rules.load_rules([good, good.replace('"b"', '"a"')])] == ["a", "b"]
    for bad in (good.replace("warn", "fatal"), good.replace('"gt"', '"near"'), good.replace('"entity": "X", ', ""), good.replace('"where"', '"were"')):
        with pytest.raises(ValueError):
            rules.load_rules([bad])
    with pytest.raises(ValueError):
        rules.load_rules([good, good])


def test_greedy_budget_skips_and_goes_on(spark):
    rows = [("p", 1, "a", 60), ("p", 2, "b", 50), ("p", 3, "c", 40), ("q", 1, "d", 500)]
    df = spark.createDataFrame(rows, "package_id string, rank int, element_id string, tokens long")
    assert {r["package_id"]: (r["kept"], r["spent"]) for r in context.within_budget(df, 100).collect()} == {"p": (["a", "c"], 100), "q": ([], 0)}


def test_grounding_and_gate(spark):
    score = lambda c, o, p, f: one(spark, context.grounding(F.lit(c), F.lit(o), F.lit(p), F.lit(f)))
    assert score(2, 1.0, 0.0, 0) == 1.0 and score(1, 0.0, 0.0, 0) == 0.225 and score(2, 1.0, 0.5, 1) == 0.2 and score(9, 2.0, 0.0, 0) == 1.0
    assert one(spark, context.penalty(F.array(F.lit("vector_retriever_unavailable: x"), F.lit("odd")))) == pytest.approx(0.6)
    gate = lambda q, a, b, s: one(spark, context.gate(F.lit(q), F.lit(a), F.lit(b), F.lit(s)))
    assert gate("Should I take it?", "x", True, 1.0) == "refused_advice" and gate("why", "x", True, 1.0) == "blocked"
    assert gate("why", None, False, 1.0) == "refused_grounding" and gate(None, "x", False, 0.59) == "refused_grounding" and gate("why", "x", False, 0.6) == "released"


def test_text_functions(spark):
    assert one(spark, text.snake_to_camel(F.col("t")), t="drug_batch_id") == "drugBatchId" and one(spark, text.camel_to_snake(F.col("t")), t="drugBatchId") == "drug_batch_id"
    assert one(spark, text.snake_to_camel(F.col("t")), t="plain") == "plain"
    assert one(spark, text.iri_slug(F.col("t")), t="  a//b  c ") == "a-b-c" and one(spark, text.iri_slug(F.col("t").cast("string")), t=None) == "unknown"
    assert one(spark, text.entity_ids(F.col("t")), t="PAT015 and D001, DIS006 D1") == ["PAT015", "D001", "DIS006"]
    assert one(spark, text.id_label(F.col("t")), t="DIS006") == "Disease" and one(spark, text.id_label(F.col("t")), t="D006") == "Drug"
    assert one(spark, text.declines(F.col("t")), t="No Phase 4 trial is mentioned.") and not one(spark, text.declines(F.col("t")), t="It treats NSCLC.") and one(spark, text.declines(F.col("t")), t="  ")
    assert one(spark, text.citations(F.col("t")), t="a [x:1] b [y-2] [not this]") == ["x:1", "y-2"]
    assert one(spark, text.verdict_first_line(F.col("t")), t="well\nPASS") == "PASS" and one(spark, text.verdict_first_line(F.col("t").cast("string")), t=None) == "UNCLEAR"


def test_names_longest_within_a_label(spark):
    names = spark.createDataFrame([("Disease", "1", "Chronic Myeloid Leukemia"), ("Disease", "2", "Leukemia"), ("Gene", "3", "APP"), ("Gene", "4", "status"), ("Word", "5", "leukemia")], "label string, key string, name string")
    texts = spark.createDataFrame([(1, "chronic myeloid leukemia, an app; APP status"), (2, None), (3, "")], "text_id int, text string")
    got = {(r["label"], r["key"]) for r in linking.resolve_names(texts, names).collect()}
    assert got == {("Disease", "1"), ("Gene", "3"), ("Word", "5")}


def test_mentions_without_concept_are_rejected(spark):
    scored = spark.createDataFrame([(1, "A", 0.9), (1, "B", 0.8), (2, "C", 0.9), (3, "A", 0.1)], "mention_id int, curie string, score double")
    got = {r["mention_id"]: (r["curie"], r["status"]) for r in linking.linked_mentions(scored, spark.createDataFrame([("A",)], "curie string"), 0.72).collect()}
    assert got == {1: ("A", "linked"), 2: (None, "rejected"), 3: (None, "unlinked")}


def test_as_of_bounds(spark):
    d = spark.sql("select * from values (1, 7, timestamp'2024-01-01', timestamp'2024-01-02'), (2, 7, timestamp'2024-01-02', null) t(decision_id, user_id, valid_from, valid_to)")
    ids = lambda at: [r["decision_id"] for r in log.as_of(d, F.to_timestamp(F.lit(at))).collect()]
    assert ids("2024-01-01") == [1] and ids("2024-01-02") == [2] and ids("2023-12-31") == []
    probes = spark.sql("select * from values (7, timestamp'2024-01-01 12:00:00'), (7, timestamp'2023-01-01'), (8, timestamp'2024-01-05') t(user_id, at)")
    got = {(r["user_id"], str(r["at"])): r["decision_id"] for r in log.as_of_join(probes, d, ["user_id"]).collect()}
    assert got == {(7, "2024-01-01 12:00:00"): 1, (7, "2023-01-01 00:00:00"): None, (8, "2024-01-05 00:00:00"): None}


def test_neighbourhood_counts_least_hops(spark):
    e = spark.createDataFrame([("N", a, "R", "N", b) for a, b in (("1", "2"), ("2", "3"), ("3", "4"), ("4", "5"), ("1", "3"))], "src_label string, src_id string, rel_type string, dst_label string, dst_id string")
    got = {r["node"]: r["hops"] for r in graph.neighbourhood(spark.createDataFrame([("N:1",)], "origin string"), e, 3).collect()}
    assert got == {"N:1": 0, "N:2": 1, "N:3": 1, "N:4": 2, "N:5": 3}
    assert {r["curie"]: r["canonical"] for r in graph.canonical(spark.createDataFrame([("e",)], "curie string"), spark.createDataFrame([("e", "d"), ("d", "c"), ("c", "b"), ("b", "a")], "a string, b string")).collect()} == {"e": "b"}


def test_shapes(spark):
    n = spark.createDataFrame([("Drug", "1", {"name": "x", "year": "199O"}), ("Drug", "2", {"name": ""}), ("Other", "3", {})], "label string, id string, props map<string,string>")
    got = sorted(tuple(r) for r in shapes.violations(n, [("drug", "name", "min_count", 1), ("Drug", "year", "datatype", "integer")]).collect())
    assert got == [("Drug", "1", "year", "datatype"), ("Drug", "2", "name", "min_count")]


def test_chunks_and_metrics(spark):
    good, bad = vectors.admitted(spark.createDataFrame([("a text", "s"), (" ", "s"), ("12.5, 7", "s"), ("x", ""), (None, "s")], "text string, source string"))
    assert good.count() == 1 and bad.count() == 4
    v = lambda m: one(spark, vectors.similarity(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(5.0)), m))
    assert v("cosine") == pytest.approx(0.8) and v("dot") == pytest.approx(20.0) and v("euclid") == pytest.approx(-(10.0**0.5))


def test_csv_source(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿id,name,active,n\n 007 , Ann ,yes,1\n,,,\n8,Bob,no,x\n".encode())
    rows = tabular.read_csv(spark, str(tmp_path / "x.csv"), ["id", "name", "active", "n"])
    assert [r["id"] for r in rows.collect()] in (["007", "8"], ["007", None, "8"])
    nodes = tabular.as_nodes(rows.withColumn("active", tabular.coerced(F.col("active"), "boolean")), "Person", "id", "d")
    assert {r["id"]: r["props"] for r in nodes.collect()} == {"007": {"name": "Ann", "active": "true", "n": "1"}, "8": {"name": "Bob", "active": "false", "n": "x"}}
    e = spark.createDataFrame([("Person", "007", "KNOWS", "Person", "8")], "src_label string, src_id string, rel_type string, dst_label string, dst_id string")
    tabular.write_graph(nodes, e, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/nodes")).where("label = 'Person'").count() == 2


def test_run_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"run": 1, "results": [{"det_verdict": "PASS", "id": 1}, {"flipped": true}, {"zzz": 0}]}')
    assert [r["kind"] for r in tabular.read_runs(spark, str(tmp_path)).orderBy("pos").collect()] == ["comprehensive", "position_bias", "unknown"]


def test_failing_automation_is_logged(spark):
    run = streams.automations([("fine", F.col("id") > 3, lambda df: df), ("broken", F.lit(True), lambda df: df.select("nothing"))])
    got = {r["automation"]: (r["rows"], r["error"] is None) for r in run(spark.range(10), 0).collect()}
    assert got == {"fine": (6, True), "broken": (0, False)}


def test_judges_agree_with_the_text_of_a_document(spark):
    rows = spark.createDataFrame([("exact", "a", "a"), ("contains", "ell", "hello"), ("at_least", "3", "4"), ("at_least", "3", "x")], "kind string, expected string, actual string")
    assert [r["met"] for r in evals.check_expected(rows).collect()] == [True, True, True, False]


def test_names_of_many_words_and_letters(spark):
    names = spark.createDataFrame([("Disease", "D1", "Non-Small Cell Lung Cancer"), ("Disease", "D2", "lung cancer"), ("Disease", "D3", "Lung Cancer"), ("Gene", "G1", "Sjögren marker"), ("Gene", "G2", "EGF"), ("Gene", "G3", "status")], "label string, key string, name string")
    texts = spark.createDataFrame([(1, "a non-small cell lung cancer, EGF"), (2, "Lung cancer egf status"), (3, "the SJÖGREN marker"), (4, ""), (5, None)], "text_id long, text string")
    got = {(r["text_id"], r["key"], r["start"]) for r in linking.resolve_names(texts, names).collect()}
    assert got == {(1, "D1", 2), (1, "G2", 6), (2, "D2", 1), (2, "D3", 1), (3, "G1", 2)}
    assert linking.resolve_names(texts, names.limit(0)).count() == 0


def test_list_conditions(spark):
    facts = spark.createDataFrame([("P", "1", {"ill": "flu;Gout"}, {"R": 2}), ("P", "2", {"ill": "gouty"}, {}), ("P", "3", {}, {"R": 1})], "entity_type string, entity_id string, properties map<string,string>, relations map<string,bigint>")
    pack = [rules.Rule("a", "warn", "P", "", {"ill": {"contains": "gout"}}), rules.Rule("b", "warn", "P", "", with_relation="R", min_count=2), rules.Rule("c", "block", "P", "", without_relation="R")]
    hits = lambda lists: {(r["rule_id"], r["entity_id"]) for r in rules.matches(facts, pack, lists).collect()}
    assert hits({"ill": ";"}) == {("a", "1"), ("b", "1"), ("c", "2")}
    assert hits(None) == {("a", "1"), ("a", "2"), ("b", "1"), ("c", "2")}


def test_containing(spark):
    texts = spark.createDataFrame([(1, "abcabc x"), (2, "ab"), (3, ""), (4, None), (5, "xyz é")], "k long, text string")
    needles = spark.createDataFrame([("abc",), ("bca",), ("ab",), ("c x",), ("é",), ("abcd",), ("",), (None,), ("ab",)], "needle string")
    got = sorted((r["k"], r["needle"]) for r in graph.containing(texts, needles).collect())
    assert got == [(1, "ab"), (1, "abc"), (1, "bca"), (1, "c x"), (2, "ab"), (5, "é")]


def test_nearest_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    rows = [(i, 0, v.tolist()) for i, v in enumerate(x)] + [(60, 0, [0.0] * 5), (61, 0, None), (62, 0, [1.0, None, 1.0, 1.0, 1.0]), (63, 0, [1.0]), (64, 1, x[0].tolist())]
    points = spark.createDataFrame(rows, "point_id long, collection int, vec array<double>")
    queries = points.select(F.col("point_id").alias("query_id"), "collection", "vec").where("query_id % 3 = 0")
    for metric in ("cosine", "dot", "euclid"):
        y = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
        s = -np.linalg.norm(x[:, None] - x, axis=2) if metric == "euclid" else y @ y.T
        got = {(r["query_id"], r["rank"]): r["point_id"] for r in vectors.nearest(queries, points, 3, ["collection"], metric, block_rows=9).collect()}
        for q in range(0, 60, 3):
            near = sorted((j for j in range(60) if j != q), key=lambda j: (-s[q, j], j))[:3]
            if metric == "cosine":  # by the others, the zero vector is a point like any
                assert [got[q, k + 1] for k in range(3)] == near
        assert all(q not in (61, 62, 63) for q, _ in got)


def test_appends_come_once(spark):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00", None), (1, "2024-01-01 00:00:00", None), (2, "2024-01-02 00:00:00", "2023-01-01 00:00:00")], "decision_id long, decided_at string, valid_from string")
    d = d.select("decision_id", F.to_timestamp("decided_at").alias("decided_at"), F.to_timestamp("valid_from").alias("valid_from"))
    first = log.appended_decisions(d.limit(0), d)
    again = log.appended_decisions(first, d)
    assert sorted((r["decision_id"], r["valid_from"].year) for r in again.collect()) == [(1, 2024), (2, 2023)]


def test_package_note_and_degradations(spark):
    rows = [("p", "a", "vector", "one two", 0.9), ("p", "b", "vector", "x" * 400, 0.8)]
    elements = spark.createDataFrame(rows, "package_id string, element_id string, kind string, content string, score double")
    asked = spark.createDataFrame([("p",), ("q",)], "package_id string")
    out = context.assembled(elements, asked, {"vector": "vector_retriever_unavailable", "graph": "graph_retriever_unavailable"}, {}, 50)
    note = context.missing_note(F.col("kinds"), F.size("dropped"), F.col("degradations"))
    got = {r["package_id"]: (r["kept"], r["dropped"], r["note"]) for r in out.withColumn("note", note).collect()}
    assert got["p"] == (["a"], ["b"], "no graph evidence was found; graph_retriever_unavailable; 1 element(s) dropped by token budget")
    assert got["q"] == ([], [], "no context was retrieved for this question; vector_retriever_unavailable; graph_retriever_unavailable; no_context_retrieved")


def test_mentions_with_offsets(spark):
    t = "The Policy for Keytruda (pembrolizumab mono) and Keytruda. (ab) Lung Cancer"
    got = [tuple(s) for s in one(spark, text.candidate_mentions(F.col("t")), t=t)]
    assert got == [("Keytruda", 15, 23), ("pembrolizumab mono", 25, 43), ("Lung Cancer", 64, 75)]
