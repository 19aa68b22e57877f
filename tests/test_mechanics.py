"""Range joins, indexes, postings, buckets, rules as rows, partial states and streams, against brute force."""

import datetime as dt
import glob
import json
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridag.operators import assembly, context, evals, graph, linking, log, partials, rules, shapes, vectors
from veridag.plans import registry
from veridag.sources import tables, tabular
from veridag.streaming import events as streams

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


# --- interval join ---


def test_every_valid_decision(spark):
    rng = random.Random(1)
    d = [(i, rng.choice([7, 7, 7, 8, None]), a := rng.choice([None, *range(0, 5000, 7)]), rng.choice([None, a, (a or 0) + 1, (a or 0) + 3000, (a or 0) + rng.randint(1, 90)])) for i in range(300)]
    d += [(900, 9, 0, 10), (901, 9, 1, 2), (902, 9, -60 * 24 * 365 * 60, None)]
    p = [(i, rng.choice([7, 8, 10, None]), rng.choice([None, *range(0, 6000, 11)])) for i in range(200)] + [(500, 9, 4), (501, 9, 10), (502, 9, -10)] * 2
    decisions = spark.createDataFrame([(i, k, at(a), at(b)) for i, k, a, b in d], "decision_id long, user_id long, valid_from timestamp, valid_to timestamp")
    probes = spark.createDataFrame([(i, k, at(t)) for i, k, t in p], "probe long, user_id long, at timestamp")
    want = []
    for i, k, t in p:
        hits = [x for x, own, a, b in d if None not in (k, t, own, a) and own == k and a <= t and (b is None or b > t)]
        want += [(i, x) for x in hits or [None]]
    found = lambda **kw: [(r["probe"], r["decision_id"]) for r in log.as_of_join(probes, decisions, ["user_id"], **kw).collect()]
    whole = sorted(set(want), key=repr)
    for width in (60_000_000, 1, 10**13):
        assert sorted(set(found(width_us=width)), key=repr) == whole
    assert sorted(found(), key=repr) == sorted(want, key=repr)
    assert sorted(found(outer=False)) == sorted(x for x in want if x[1] is not None)
    assert log.as_of_join(probes.limit(0), decisions, ["user_id"]).count() == 0
    assert [r["decision_id"] for r in log.as_of_join(probes.limit(3), decisions.limit(0), ["user_id"]).collect()] == [None] * 3


def test_intervals_that_no_probe_can_meet_or_of_rare_lengths_cost_nothing(spark, monkeypatch):
    seen, keep = [], log.stored
    monkeypatch.setattr(log, "stored", lambda df: seen.append(keep(df)) or seen[-1])
    d = [(i, i % 2, at(i), at(i + 100)) for i in range(400)] + [(1000 + k, 0, at(50), at(50 + 4**k)) for k in range(6)] + [(2000, 0, at(0), None)]
    decisions = spark.createDataFrame(d, "decision_id long, user_id long, valid_from timestamp, valid_to timestamp")
    probes = spark.createDataFrame([(i, 0, at(i * 9)) for i in range(100)], "probe long, user_id long, at timestamp")
    want = sorted((i, x) for i, _, t in ((i, 0, at(i * 9)) for i in range(100)) for x, own, a, b in d if own == 0 and a <= t and (b is None or b > t))
    assert sorted((r["probe"], r["decision_id"]) for r in log.as_of_join(probes, decisions, ["user_id"], outer=False).collect()) == want
    assert all(t.where("user_id = 1").isEmpty() for t in seen)
    assert seen[-1].select(F.pmod("_bucket", F.lit(32))).distinct().count() == 2  # widths that a probe has a row for
    assert log.kept_levels({0: 1, 1: 2, 3: 90, 5: 1, 7: 1}) == [3, 7] and log.kept_levels({2: 5, 3: 5}) == [2, 3] and log.kept_levels({}) == [0]


# --- vectors ---


def test_index_against_exact_search(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(200, 32))
    x = centres[rng.integers(0, 200, 4000)] + 0.25 * rng.normal(size=(4000, 32))
    rows = [(i, 0, v.tolist()) for i, v in enumerate(x)] + [(4000, 0, [0.0] * 32), (4001, 0, None), (4002, 0, [1.0]), (4003, 0, [None] * 32)]
    points = spark.createDataFrame(rows, "point_id long, collection int, vec array<double>").repartition(4)
    queries = points.where("point_id % 20 = 0 or point_id > 3998").select(F.col("point_id").alias("query_id"), "collection", "vec")
    exact = vectors.nearest(queries, points, 5, ["collection"])
    index = vectors.build_index(points, 32, tables=12, bits=10)
    found = vectors.indexed(queries, index, 5, ["collection"], probes=4)
    got = vectors.recall(found, exact).first()
    assert got["n"] == 5 * 201 and got["recall"] >= 0.95
    compared = found.select("query_id", "compared").distinct().agg(F.sum("compared")).first()[0]
    assert compared < 0.1 * 201 * 4000
    both = found.join(exact, ["query_id", "point_id"]).where(found["score"] != exact["score"])
    assert both.count() == 0 and found.where("query_id >= 4000").count() == 0
    whole = vectors.indexed(queries, index, 5, ["collection"], probes=1, least=2.0)  # nothing is good enough, so all are searched in full
    row = lambda r: (r["query_id"], r["point_id"], r["score"], r["rank"])
    assert sorted(map(row, whole.collect())) == sorted(map(row, exact.collect()))


def test_upsert_of_repeated_points(spark):
    schema = "point_id long, label long, vec array<double>, seq int"
    old = spark.createDataFrame([(1, 0, [1.0, 0.0], 0), (2, 0, [0.0, 1.0], 0)], schema)
    new = spark.createDataFrame([(1, 5, [1.0, 1.0], 2), (1, 4, [2.0, 2.0], 1), (3, 1, None, 1), (2, 9, [1.0], 3), (2, 8, [1.0, None], 4), (4, 1, [0.0, 3.0], None)], schema)
    kept, refused = vectors.upserted(old, new, 2, "seq")
    assert sorted((r["point_id"], r["label"]) for r in kept.collect()) == [(1, 5), (2, 0), (4, 1)]
    assert sorted((r["point_id"], r["label"]) for r in refused.collect()) == [(2, 8), (2, 9), (3, 1)]


# --- postings and names ---


def test_containment_is_linear(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz é\U0001f600"
    texts = ["".join(rng.choices(letters, k=n)) for n in (16_000, 300, 40, 2, 1, 0)] + ["same text here"] * 5 + [None]
    needles = [t[i : i + n] for t in texts[:3] for i, n in ((5, 1), (7, 2), (3, 3), (11, 30))] + ["same", "text here", "nowhere at all", "", None, "\U0001f600"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    wanted = spark.createDataFrame([(n,) for n in needles], "needle string")
    found = lambda: sorted((r["k"], r["needle"]) for r in graph.containing(df, wanted).collect())
    assert found() == sorted({(k, n) for k, t in enumerate(texts) for n in needles if t and n and n in t})
    assert graph.containing(df, wanted.limit(0)).columns == ["k", "text", "needle"]
    took = []
    for n in (20_000, 320_000):
        one = spark.createDataFrame([(1, "".join(rng.choices(letters, k=n)))], "k long, text string")
        start = time.time()
        assert graph.containing(one, wanted).count() >= 0
        took.append(time.time() - start)
    assert took[1] < took[0] + 12  # sixteen times the text: a quadratic way took minutes


def test_names_by_their_rarest_word(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(12)] + ["ab", "Ab"]
    names = [("L", f"k{i}", " ".join(rng.choices(words, k=rng.randint(1, 4)))) for i in range(60)] + [("L", "long", " ".join(rng.choices(words, k=60))), ("M", "short", "Ab"), ("M", "none", "()"), ("M", "gone", "word1 elsewhere")]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(40)] + [(99, "x " + names[60][2] + " y"), (98, None)]
    want = set()
    for i, t in texts:
        cut = (t or "").split()
        for label, key, name in names:
            own = re.findall(r"[\w\-]+", name)
            loose = len(name) >= 4
            for s in range(len(cut) - len(own) + 1 if own else 0):
                if all(a.lower() == b.lower() and (loose or a == b) for a, b in zip(cut[s:], own)):
                    want.add((i, label, key, name, s + 1, len(own)))
    t = spark.createDataFrame(texts, "text_id long, text string")
    n = spark.createDataFrame(names, "label string, key string, name string")
    assert {tuple(r) for r in linking.named_spans(t, n.unionByName(n)).collect()} == want and any(x[5] == 60 for x in want)


def test_mentions_of_a_text_with_many(spark):
    t = "The Policy for Keytruda (pembrolizumab mono) and Keytruda. (ab) Lung Cancer"
    many = " ".join(f"Name{i}x and" for i in range(30_000))
    rows = [(1, t), (1, t), (2, many), (3, None), (4, "")]
    got = linking.mention_rows(spark.createDataFrame(rows, "text_id long, text string")).cache()
    assert sorted(tuple(r)[1:] for r in got.where("text_id = 1").collect()) == [("Keytruda", 15, 23), ("Lung Cancer", 64, 75), ("pembrolizumab mono", 25, 43)]
    found = got.where("text_id = 2").collect()
    assert len(found) == 30_000 and all(many[r["start"] : r["end"]] == r["surface"] for r in found)


def test_token_pairs_of_a_hot_token(spark):
    rng = random.Random(5)
    terms = [(f"{rng.choice('ABC')}:{i}", " ".join(rng.choices(["common", "others", "rarely", "tiny", "alpha beta"], k=2))) for i in range(150)] + [(f"A:x{i}", "lonely token") for i in range(400)]
    tokens = {c: set(re.findall("[a-z]{5,}", s)) for c, s in terms}
    want = {(a, b): min(tokens[a] & tokens[b]) for a in tokens for b in tokens if a < b and a[0] != b[0] and tokens[a] & tokens[b]}
    pairs, crowded = graph.shared_token_pairs(spark.createDataFrame(terms, "curie string, surface string"), crowded=300)
    assert {(r["a"], r["b"]): r["token"] for r in pairs.collect()} == want
    assert sorted(r["token"] for r in crowded.collect()) == ["lonely", "token"]


# --- equivalence classes ---


def test_classes_of_any_shape(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "stored", lambda df: rounds.append(1) or tables.stored(df))
    names = [f"c{i:04d}" for i in range(1000)]
    random.Random(6).shuffle(names)
    pairs = list(zip(names, names[1:])) + [("x", "x"), ("y1", "y0"), ("y0", "y1"), ("y1", "y0"), (None, "z"), ("z", None)] + [("hub", f"h{i}") for i in range(50)]
    got = {r["id"]: r["canonical"] for r in graph.equivalence_classes(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {**{n: "c0000" for n in names}, "x": "x", "y0": "y0", "y1": "y0", "hub": "h0", **{f"h{i}": "h0" for i in range(50)}}
    assert (len(rounds) - 2) / 3 <= 16
    assert graph.equivalence_classes(spark.createDataFrame([], "a string, b string")).count() == 0


# --- buckets ---


def files_of(path):
    return {int(re.search(r"bucket=(\d+)", p)[1]): sorted(os.path.basename(f) for f in glob.glob(f"{p}/part-*")) for p in glob.glob(f"{path}/bucket=*")}


def test_merge_into_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, dataset string, seq int, note string, props map<string,string>"
    df = lambda rows: spark.createDataFrame(rows, schema)
    first = [(i, "a" if i % 2 else "b", 1, "old", {"x": f"{i}", "y": "1"}) for i in range(200)] + [(None, "a", 1, "nameless", {})]
    tables.merge_rows(path, df(first), ["id"], "seq", buckets=16, props="props")
    before = files_of(path)
    batch = df([(5, "a", 2, "new", {"y": "2", "z": "3"}), (5, "a", 3, "newest", {"z": "4"}), (5, "a", 3, "newest", {"z": "4"}), (6, "b", 0, "too old", {"w": "9", "x": "lost"})])
    touched = tables.merge_rows(path, batch, ["id"], "seq", buckets=16, props="props")
    after = files_of(path)
    assert 1 <= len(touched) <= 2 and {b for b in before if before[b] != after[b]} == set(touched)
    rows = {r["id"]: r for r in tables.open_buckets(spark, path, batch.schema).collect()}
    assert len(rows) == 201 and rows[5]["note"] == "newest" and rows[5]["props"] == {"x": "5", "y": "2", "z": "4"}
    assert rows[6]["note"] == "old" and rows[6]["props"] == {"x": "6", "y": "1", "w": "9"} and rows[None]["note"] == "nameless"
    assert tables.merge_rows(path, batch, ["id"], "seq", buckets=16, props="props") == [] and files_of(path) == after
    purged = tables.purge_rows(spark, path, batch.schema, (F.col("dataset") == "b") & (F.col("id") < 40))
    left = tables.open_buckets(spark, path, batch.schema)
    assert left.count() == 181 and left.where("dataset = 'b' and id < 40").count() == 0 and set(purged) < set(after)
    assert tables.purge_rows(spark, path, batch.schema, F.col("id") < -1) == []
    tables.purge_rows(spark, path, batch.schema, F.lit(True))
    assert tables.open_buckets(spark, path, batch.schema).count() == 0


# --- rules ---


def generated_rules(rng, n):
    ops = [("equals", lambda: rng.choice(["a", "B", "3"])), ("not_equals", lambda: rng.choice(["a", "B"])), ("in", lambda: rng.sample(["a", "b", "C", "4"], 2)), ("not_in", lambda: rng.sample(["a", "b", "C"], 2)), ("exists", lambda: rng.random() < 0.5), ("contains", lambda: rng.choice(["a", "B", "x;"])), ("gt", lambda: rng.randint(0, 5)), ("gte", lambda: "3"), ("lt", lambda: 2.5), ("lte", lambda: rng.randint(0, 5))]
    out = []
    for i in range(n):
        where = {}
        for name in rng.sample(["p", "q", "r", "tags", "none"], rng.randint(0, 3)):
            where[name] = {op: value() for op, value in rng.sample(ops, rng.randint(1, 2))} if rng.random() < 0.8 else rng.choice(["a", 3, True])
        out.append(rules.Rule(f"r{i:04d}", rng.choice(rules.SEVERITIES), rng.choice("XYZ"), "", where, rng.choice([None, None, "R", "S"]), rng.choice([0, 1, 2]), rng.choice([None, None, None, "R", "T"])))
    return out


def test_a_thousand_rules_as_rows(spark):
    rng = random.Random(7)
    value = lambda: rng.choice(["a", "A", "b", "B", "c", "1", "2.5", "3", "4.0", "NaN", "true", "", "xa;b", None])
    facts = [(rng.choice("XY"), f"e{i}", {k: value() for k in rng.sample(["p", "q", "r", "tags"], rng.randint(0, 4))}, {k: rng.randint(0, 3) for k in rng.sample("RST", rng.randint(0, 2))}, rng.choice(["s1", None])) for i in range(60)]
    df = spark.createDataFrame(facts, "entity_type string, entity_id string, properties map<string,string>, relations map<string,bigint>, scope string")
    pack = generated_rules(rng, 1000)
    heads, conditions = rules.condition_rows(spark, pack, {"tags": ";"})
    key = lambda r: (r["rule_id"], r["entity_id"], r["scope"] or "")
    got = rules.row_matches(df, heads, conditions, {"tags": ";"})
    want = set()
    for k in range(0, 1000, 250):  # compiled, so many at once are more than one expression can hold
        want |= {key(r) for r in rules.matches(df, pack[k : k + 250], {"tags": ";"}).collect()}
    assert sorted(map(key, got.collect())) == sorted(want) and len(want) > 1000


def test_rules_as_rows_in_many_tasks(spark, monkeypatch):
    rng = random.Random(9)
    facts = [("X", f"e{i}", {"p": rng.choice("abc"), "q": str(rng.randint(0, 5))}, {"R": rng.randint(0, 3)}) for i in range(300)]
    df = spark.createDataFrame(facts, "entity_type string, entity_id string, properties map<string,string>, relations map<string,bigint>")
    pack = generated_rules(rng, 60)
    want = sorted((r["rule_id"], r["entity_id"]) for r in rules.matches(df, pack).collect())
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    got = rules.row_matches(df, *rules.condition_rows(spark, pack))
    assert sorted((r["rule_id"], r["entity_id"]) for r in got.collect()) == want and want


# --- rows of a task in graph queries ---


def test_edges_of_many_lines_are_dealt_to_tasks_of_bounded_rows(spark, sf_dir, monkeypatch):
    from veridag.plans import model

    want = sorted(map(tuple, model.edges(spark, sf_dir).collect()))
    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    e = model.edges(spark, sf_dir)
    assert sorted(map(tuple, e.collect())) == want
    held = e.where("rel_type = 'SUPPLIES'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert max(r["count"] for r in held) <= 400 and len(held) > 10


@pytest.mark.parametrize(("name", "without"), [("linked_objects", r"Aggregate \[l_orderkey"), ("facts_of_hubs", r"Aggregate \[label#\d+, id#\d+, rel_type#\d+, dst_id#\d+\]"), ("facts_by_concept", r"count\(distinct"), ("corpus_entities", r"Aggregate \[me#\d+, other#\d+\]")])
def test_graph_queries_hold_no_rows_that_they_can_do_without(spark, sf_dir, name, without):
    from veridag.plans import registry

    registry.load()
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(without, plan)


# --- partial states ---


def test_states_add_up(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"t{rng.randint(0, 900)}", rng.choice("ab"), f"2024-01-0{rng.randint(1, 5)}", rng.random() < 0.5, rng.choice(["PASS", "FAIL", "UNCLEAR"]), rng.choice([0, None, *range(1, 300)]), rng.randint(0, 9)) for _ in range(4000)]
    v = spark.createDataFrame([(*r, (r[4] == "PASS") == r[3], 1) for r in rows], "test_id string, method string, day string, is_correct boolean, result string, latency_ms long, input_tokens long, correct boolean, output_tokens long")
    path = str(tmp_path / "s")
    states = partials.daily_states(v, "day", ["method"])
    partials.save_states(states.where("day < '2024-01-04'"), path, "day")
    kept = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/day=2024-01-0[12]/*.parquet")}
    partials.save_states(states.where("day >= '2024-01-03'"), path, "day")
    assert kept == {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/day=2024-01-0[12]/*.parquet")}
    for r in partials.read_off(partials.merged(partials.load_states(spark, path, states), ["method"]), 0.5, 0.95).collect():
        own = [x for x in rows if x[1] == r["method"]]
        assert r["n"] == len(own) and r["false_passes"] == sum(x[4] == "PASS" and not x[3] for x in own) and r["input_tokens"] == sum(x[6] for x in own)
        times = sorted(x[5] for x in own if x[5])
        assert r["timed"] == len(times) and r["latency_ms"] == sum(times)
        assert abs(r["n_tests"] - len({x[0] for x in own})) <= 0.02 * len({x[0] for x in own})
        for q, got in ((0.5, r["p50_ms"]), (0.95, r["p95_ms"])):
            assert np.searchsorted(times, got, "left") / len(times) <= q + 0.0165 and np.searchsorted(times, got, "right") / len(times) >= q - 0.0165


# --- streams ---


def write_batches(tmp_path, spark, batches, schema):
    """A folder with a file a batch, read one a micro-batch in the order given."""
    folder = str(tmp_path / "in")
    for k, rows in enumerate(batches):
        out = str(tmp_path / f"b{k}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(out)
        os.makedirs(folder, exist_ok=True)
        target = f"{folder}/{k:04d}.parquet"
        os.rename(glob.glob(f"{out}/*.parquet")[0], target)
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_append_is_resumed(spark, tmp_path):
    schema = "event_id long, event_type string, ts timestamp, ingested_at timestamp, curies array<string>, payload map<string,string>"
    batches = [[(10 * k + i, "view", at(k), None, [f"C:{i}", "C:0"], {"b": "2", "a": "1"}) for i in range(4)] for k in range(4)]
    batches[2] += batches[0][:2]  # comes again within the watermark
    maps_to = spark.createDataFrame([("C:1", "Customer", "1"), ("C:0", "Customer", "0"), ("C:0", "Supplier", "0")], "curie string, label string, id string")
    source, out, state = write_batches(tmp_path, spark, batches, schema), str(tmp_path / "log"), str(tmp_path / "state")
    body, seen = streams.appended_epochs(out, {"events": lambda b: b.select("event_id")}), []
    body(spark.range(3).withColumnRenamed("id", "event_id"), 99)
    body(spark.range(3).withColumnRenamed("id", "event_id"), 99)  # the same batch once more
    assert spark.read.parquet(f"{out}/events/epoch=99").count() == 3

    whole = streams.append_events(source, maps_to, f"{out}2")

    def breaks(batch, epoch):
        streams_run(batch, epoch)
        seen.append(epoch)
        if epoch == 2 and seen.count(2) == 1:
            raise RuntimeError("lost after writing")

    tables_of = {"events": lambda b: b.select("event_id", "payload_json"), "about": lambda b: log.concept_edges(b, "event_id", "curies", maps_to, "ABOUT")}
    streams_run = streams.appended_epochs(f"{out}3", tables_of)
    told = streams.deduplicated(source.withColumn("payload_json", F.to_json("payload")))
    for _ in range(2):
        run = told.writeStream.foreachBatch(breaks).option("checkpointLocation", f"{state}3").trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        except Exception:  # noqa: BLE001, S110  the first run is meant to break off
            pass
    for _ in range(2):
        whole.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    want = sorted({r[0] for b in batches for r in b})
    for folder in (f"{out}2", f"{out}3"):
        assert sorted(r["event_id"] for r in spark.read.parquet(f"{folder}/events").collect()) == want
        edges = sorted((r["src_id"], r["dst_label"], r["dst_id"]) for r in spark.read.parquet(f"{folder}/about").collect())
        assert edges == sorted({(e, *x) for b in batches for e, *_, c, _ in b for x in (("Customer", "0"), ("Supplier", "0"), *([("Customer", "1")] if "C:1" in c else []))})
    assert {r["payload"] for r in spark.read.parquet(f"{out}2/events").collect()} == {'{"a":"1","b":"2"}'} and 2 in seen


def test_windows_close_and_late_rows_are_counted(spark, tmp_path):
    schema = "event_id long, event_type string, ts timestamp, value double"
    minutes = [[0, 3, 12], [31, 95, 29], [20, 90, 40, 95], [30, 200], [100, 139, 260], [400, 50, 34, 199], [60, 420]]
    n, batches = 0, []
    for b in minutes:
        batches.append([(n + i, "view", at(m), float(m)) for i, m in enumerate(b)])
        n += len(b)
    source, out = write_batches(tmp_path, spark, batches, schema), str(tmp_path / "out")
    listener = streams.LateRows()
    spark.streams.addListener(listener)
    try:
        run = streams.closed_windows(source, "10 minutes", "1 hour").writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        before = mark = high = -1000
        counts, late = {}, 0
        for b in minutes:  # rows are late by the watermark of the batch before; the last batch's own closes windows
            for m in b:
                late += m <= before
                if m > before:
                    counts[m // 10 * 10] = counts.get(m // 10 * 10, 0) + 1
            high = max(high, *b)
            before, mark = mark, high - 60
        want = {w: c for w, c in counts.items() if w + 10 <= high - 60}
        got = {int((r["start"] - T0).total_seconds() // 60): r["n"] for r in spark.read.parquet(out).collect()}
        assert got == want and late == 4, (got, want)
        deadline = time.time() + 20
        while sum(listener.rows.values()) < late and time.time() < deadline:
            time.sleep(0.2)
        assert sum(listener.rows.values()) == late
    finally:
        spark.streams.removeListener(listener)


def test_validity_from_keyed_state(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, 3]), i, at(i * 7)) for i in range(60)] + [(1, 100, at(21)), (2, 101, at(21))]
    dealt = sorted(rows, key=lambda r: (r[2] - T0).total_seconds() / 60 + rng.uniform(-25, 25))  # out of order by less than an hour
    batches = [dealt[k : k + 6] for k in range(0, len(dealt), 6)] + [[(9, 999, at(10_000))]]
    source, out = write_batches(tmp_path, spark, batches, "key long, decision_id long, valid_from timestamp"), str(tmp_path / "out")
    closes = streams.closed_decisions(source, "1 hour")
    with streams.with_rocksdb(spark):
        closes.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    d = spark.createDataFrame([*rows, (9, 999, at(10_000))], "key long, decision_id long, valid_from timestamp")
    found = log.superseded(d.withColumn("valid_to", F.lit(None).cast("timestamp")), spark.read.schema(closes.schema).parquet(out))
    want = log.chained(d, "key", "valid_from")
    read = lambda df: sorted(((r["decision_id"], r["valid_to"]) for r in df.collect()), key=repr)
    assert read(found) == read(want)


# --- smaller parts ---


def test_run_files_become_objects(spark, tmp_path):
    results = [{"test_id": "E01", "category": "Drug Facts", "is_correct": False, "det_verdict": "PASS", "det_correct": False, "det_ms": 1, "nr_verdict": "FAIL", "nr_correct": True}, {"flipped": True, "test_id": "A1"}, {"zzz": 0}]
    (tmp_path / "one.json").write_text(json.dumps({"run_id": "R1", "results": results}))
    (tmp_path / "two.json").write_text(json.dumps({"results": results[:1]}))
    rows = tabular.read_runs(spark, str(tmp_path))
    v = evals.hydrated(rows).collect()
    assert sorted((r["run_id"], r["test_id"], r["method"], r["result"]) for r in v) == [("R1", "A1", "bias_test", "biased"), ("R1", "E01", "det", "PASS"), ("R1", "E01", "nr", "FAIL"), ("two", "E01", "det", "PASS"), ("two", "E01", "nr", "FAIL")]
    objects, links = evals.run_objects(rows)
    kinds = {}
    for r in objects.collect():
        kinds.setdefault(r["object_type"], []).append(r["object_id"])
    assert sorted(kinds["EvalRun"]) == ["R1", "two"] and sorted(kinds["Category"]) == ["cat-drug-facts", "cat-unknown"] and len(kinds["TestCase"]) == 3 and len(kinds["Verdict"]) == 5
    assert sorted(kinds["BiasPattern"]) == ["bias-fp-R1:E01:det", "bias-fp-two:E01:det"] and len(kinds["Judge"]) == 3
    found = {tuple(r) for r in links.collect()}
    assert ("R1:E01:det", "EXHIBITS", "bias-fp-R1:E01:det") in found and ("judge-nr", "PRODUCES", "two:E01:nr") in found and ("E01", "BELONGS_TO", "cat-drug-facts") in found and len(found) == 3 + 5 * 3 + 2


def test_templates_and_rendering(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, "y")], "k long, name string, other string")
    got = {r["source_id"]: r["text"] for r in assembly.templated_texts(rows, "x", "k", "name", "{name} has {{{other}}} of {k}.").collect()}
    assert got == {"x:1": "a has {unknown} of 1.", "x:2": "unknown has {y} of 2."}
    e = spark.createDataFrame([("p", "e1", "graph", "s", 0.5, "text", 1, ["A:1", "B:2"]), ("p", "e2", "graph", "s", 0.25, "more", 2, [])], "package_id string, element_id string, kind string, source string, score double, content string, rank int, curies array<string>")
    asked = spark.createDataFrame([("p",), ("q",)], "package_id string")
    assert {r["package_id"]: r["text"] for r in context.rendered(e, asked).collect()} == {"p": "[e1] (graph, source=s, score=0.500, curies=A:1 B:2)\ntext\n\n[e2] (graph, source=s, score=0.250)\nmore", "q": "nothing was retrieved"}


def test_retrievers_and_scopes(spark):
    own = context.Retrievers()
    own.register("a", lambda q: q.select("nothing"))
    assert own.gathered(spark.range(1)) == (None, {"a": "a_retriever_unavailable: AnalysisException"})
    with pytest.raises(ValueError, match="already"):
        own.register("a", lambda q: q)
    nodes = spark.createDataFrame([("A", f"{i}", None, {}) for i in range(5)] + [("B", "1", None, {})], "label string, id string, name string, props map<string,string>")
    edges = spark.createDataFrame([("A", "1", "R", "B", "1"), ("A", "3", "R", "B", "1"), ("B", "1", "S", "A", "2")], "src_label string, src_id string, rel_type string, dst_label string, dst_id string")
    ids = spark.createDataFrame([("A", "3"), (None, "1"), ("A", "3"), ("B", "4")], "label string, id string")
    got = lambda **kw: sorted((r["entity_type"], r["entity_id"], sorted(r["relations"])) for r in graph.scoped_facts(nodes, edges, **kw).collect())
    assert got(ids=ids) == [("A", "1", ["R"]), ("A", "3", ["R"]), ("B", "1", ["S"])]
    assert got(ids=ids, types=["A"], most=1) == [("A", "1", ["R"])] and len(got(types=["A"])) == 5 and got(ids=ids.limit(0)) == []


def test_bridge_prefers_aliases(spark):
    nodes = spark.createDataFrame([("Drug", "1", {"drug_type": "x", "name": "y", "year": "", "odd": "z", "source": "s"})], "label string, id string, props map<string,string>")
    declared = spark.createDataFrame([("DRUG", "drugType"), ("DRUG", "kind"), ("DRUG", "name"), ("DRUG", "drug_type"), ("Other", "odd")], "label string, path string")
    aliases = spark.createDataFrame([("drug", "drug_type", "kind"), ("Drug", "name", "undeclared")], "label string, key string, path string")
    assert sorted(tuple(r) for r in shapes.bridged(nodes, declared, aliases, ("source",)).collect()) == [("Drug", "drug_type", "kind", 1), ("Drug", "name", "name", 1), ("Drug", "odd", None, 1)]


# --- joins that must not pass through the driver ---


def broadcasts(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_intervals_are_not_broadcast(spark):
    decisions = spark.createDataFrame([(1, 7, at(0), at(5))], "decision_id long, user_id long, valid_from timestamp, valid_to timestamp")
    probes = spark.createDataFrame([(1, 7, at(4)), (2, 7, at(6))], "probe long, user_id long, at timestamp")
    found = log.as_of_join(probes, decisions, ["user_id"])
    assert not broadcasts(found)
    assert sorted(((r["probe"], r["decision_id"]) for r in found.collect()), key=repr) == [(1, 1), (2, None)]


def test_names_are_not_broadcast(spark):
    texts = spark.createDataFrame([(1, "a large ring"), (2, "Ring")], "text_id long, text string")
    names = spark.createDataFrame([("W", "r", "ring"), ("P", "l", "large ring")], "label string, key string, name string")
    assert not broadcasts(linking.named_spans(texts, names))
    found = linking.resolve_names(texts, names)
    assert not broadcasts(found)
    assert sorted((r["text_id"], r["key"], r["start"]) for r in found.collect()) == [(1, "l", 2), (1, "r", 3), (2, "r", 1)]


# --- results that equal SQL's ---


def test_rounding_and_json_as_in_sql(spark):
    import duckdb

    from veridag.functions.numbers import rounded

    x = [203.15 / 100, 330.65 / 100, 268.15 / 100, -2.0315, 0.00049, 2e-6, 12345678.25, None, 7.0]
    con = duckdb.connect()
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double")
    assert [r[0] for r in got.orderBy("i").select(rounded("v", 3)).collect()] == [con.execute("SELECT round(CAST(? AS DOUBLE), 3)", [v]).fetchone()[0] for v in x]
    want = con.execute("SELECT CAST(to_json(list(t ORDER BY i)) AS VARCHAR) FROM (SELECT CAST(unnest(range(?)) AS INT) AS i, unnest(CAST(? AS DOUBLE[])) AS v) t", [len(x), x]).fetchone()[0]
    assert json.loads(tabular.report({"t": got}).first()["report"]) == {"t": want}


def test_copies_do_not_hide_a_point_from_itself(spark):
    x = np.random.default_rng(3).normal(size=(600, 32))
    points = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(np.concatenate([x, x, x]))], "point_id long, collection int, vec array<double>")
    queries = points.where("point_id % 20 = 0").select((-1 - F.col("point_id")).alias("query_id"), "collection", F.transform("vec", lambda v: v * 1.5).alias("vec"), F.col("point_id").alias("own"))
    for found in (vectors.indexed(queries, vectors.build_index(points, 32, tables=4, bits=6), 1, ["collection"], probes=2, least=0.9, own="own"), vectors.nearest(queries, points, 1, ["collection"], block_rows=100, own="own")):
        assert sorted((-1 - r["query_id"], r["point_id"]) for r in found.collect()) == [(i, i) for i in range(0, 1800, 20)]


def test_near_copies_do_not_hide_a_point_from_itself(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    moved = x + 0.04 * (np.arange(64) % 4 == np.arange(200)[:, None] % 4)
    rows = [(i, i % 10, v.tolist()) for i, v in enumerate(np.concatenate([x, moved]))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    registry.load()
    found = registry.QUERIES["indexed_search"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(i, i, 1) for i in range(0, 400, 20)]


def test_a_query_that_misses_the_point_it_names_is_searched_in_full(spark):
    rows = [(0, 0, [1.0, 0.0, 0.0]), (1, 0, [-1.0, 0.01, 0.0]), (2, 0, [-1.0, 0.0, 0.5])]
    points = spark.createDataFrame(rows, "point_id long, collection int, vec array<double>")
    queries = spark.createDataFrame([(-1, 0, [-1.0, 0.0, 0.1], [1.0, 0.0, 0.0], 0)], "query_id long, collection int, vec array<double>, exact array<double>, own long")
    found = vectors.indexed(queries, vectors.build_index(points, 3, tables=2, bits=4), 1, ["collection"], probes=1, least=-1.0, own="own", exact="exact")
    assert [(r["point_id"], r["score"], r["compared"]) for r in found.collect()] == [(0, 1.0, 3)]


def test_index_makes_no_row_of_a_pair(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    points = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "point_id long, collection int, vec array<float>").repartition(3)
    queries = points.where("point_id % 4 = 0").select((-1 - F.col("point_id")).alias("query_id"), "collection", "vec")
    index = vectors.build_index(points, 16, tables=4, bits=3)
    found = vectors.indexed(queries, index, 3, ["collection"], probes=2, block_rows=100)
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "MapInArrow" not in plan
    codes, looked = vectors.codes_of(x.astype(np.float32).astype(float), index.planes)[0], vectors.probed_codes(x.astype(np.float32).astype(float), index.planes, 2)
    want = {}
    for i in range(0, 3000, 4):
        met = np.flatnonzero((codes[:, :, None] == looked[i][None]).any(axis=(1, 2)) & (np.arange(3000) % 2 == i % 2))
        y = x.astype(np.float32).astype(float)
        cosine = y[met] @ y[i] / np.linalg.norm(y[met], axis=1) / np.linalg.norm(y[i])
        want[-1 - i] = (len(met), [int(met[j]) for j in np.argsort(-np.round(cosine, 6), kind="stable")[:3]])
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], (r["compared"], []))[1].append(r["point_id"])
    assert got == want


def test_containing_long_needles(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gämma", "dé", "x", "🙂🙂", "theta"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, ""), (902, "z" * 300)]
    needles = [t[a : a + n] for _, t in texts[:80] if t and len(t) > 70 for a, n in ((3, 19), (5, 20), (7, 21), (0, 45), (9, 3), (11, 1))] + ["z" * 20, "z" * 301, "not in any of the texts", "beta gämma beta gämma beta"]
    rows = graph.containing(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert not broadcasts(rows)
    assert sorted((r["doc_id"], r["needle"]) for r in rows.collect()) == sorted((i, n) for i, t in texts if t for n in set(needles) if n in t)


def test_marks_are_fewer_than_characters():
    rng = random.Random(12)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(5000))
    found = set(graph.marked(text).tolist())
    assert len(found) < 0.3 * len(text)
    assert all(set(graph.marked(text[a : a + n]).tolist()) <= found for a in range(0, 4000, 37) for n in (20, 33))
    assert all(len(graph.marked(text[a : a + 20])) == 1 for a in range(0, 4000, 37))


def test_a_key_has_a_timer_a_batch(spark):
    import pandas as pd

    class Listed(list):
        appendValue, get, put, exists = list.append, lambda self: iter(self), lambda self, x: self.__setitem__(slice(None), x), lambda self: bool(self)  # noqa: N815
        appendList = list.extend  # noqa: N815

    class Handle:
        def __init__(self):
            self.timers = []

        def registerTimer(self, ms):  # noqa: N802
            self.timers.append(ms)

    p = streams.ClosesDecisions()
    p.handle, p.waiting = Handle(), Listed()
    rows = pd.DataFrame({"key": 1, "decision_id": range(500), "valid_from": pd.date_range("2024-01-01", periods=500, freq="s")})
    list(p.handleInputRows((1,), iter([rows, rows]), None))
    assert len(p.waiting) == 1000 and p.handle.timers == [int(rows["valid_from"][0].value // 10**6)]


# --- few rows before rows meet ---


def test_overlap_makes_rows_of_shared_words_only(spark):
    answers = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "none of it"), (3, None)], "package_id long, answer string")
    elements = spark.createDataFrame([(1, "Alpha; zeta"), (1, "alpha beta"), (3, "alpha")], "package_id long, content string")
    found = context.overlaps(answers, elements)
    assert "array_intersect" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["package_id"]: r["overlap"] for r in found.collect()} == {1: 0.5, 2: 0.0, 3: 0.0}


def test_terms_are_cut_before_questions_meet_them(spark):
    questions = spark.createDataFrame([(q, ["ring", "bolt"]) for q in range(3)] + [(9, ["nut"])], "question_id long, terms array<string>")
    records = spark.createDataFrame([(i % 150, ("ring", "Bolt", "nut")[i % 3], None) for i in range(400)], "record_id long, title string, scope string")
    found = assembly.keyword_hits(questions, records, 4)
    assert "dense_rank" in found._jdf.queryExecution().optimizedPlan().toString()
    want = {q: sorted({i % 150 for i in range(400) if ("ring", "bolt", "nut")[i % 3] in t})[:4] for q, t in [(0, ["ring", "bolt"]), (1, ["ring", "bolt"]), (2, ["ring", "bolt"]), (9, ["nut"])]}
    assert sorted((r["question_id"], r["record_id"]) for r in found.collect()) == sorted((q, i) for q, ids in want.items() for i in ids)
