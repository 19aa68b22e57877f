"""Source divergence, prefix trie and chat formatting against brute force, and the SQL of this subpackage."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_oracles import TABLES, table

from veridag.llm import chat, divergence, queries, trie
from veridag.llm.turns import numbered, ordered_turns


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), want.columns)


# --- source divergence ---


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def audit(rows, min_docs, k):
    """rows (text, lang, source), in exact whole numbers."""
    docs, of_lang, own, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(text))
        lang, source = lang or "", source or ""
        seen.add((lang, source))
        docs[lang].update(set(words))
        of_lang[lang].update(words)
        own[lang, source].update(words)
    kept = {lang: sorted((t for t, n in docs[lang].items() if n >= min_docs), key=lambda t: t.encode()) for lang in {x for x, _ in seen}}
    f = lambda p, q: (p - q) ** 2 // (p + q)

    def rates(counts, terms):
        total = sum(counts[t] for t in terms)
        return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(terms)) for t in terms}

    out = []
    for lang, source in seen:
        mine, whole = rates(own[lang, source], kept[lang]), rates(of_lang[lang], kept[lang])
        pairs = []
        for other in (s for x, s in seen if x == lang and s != source):
            theirs = rates(own[lang, other], kept[lang])
            pairs.append((other, sum(f(mine[t], theirs[t]) for t in kept[lang])))
        terms = [(t, f(mine[t], whole[t])) for t in kept[lang] if own[lang, source][t] and mine[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, k)):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found)]
    return sorted(out)


def odd_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "the", "cat", "Éa", "éa", "日本", "z" * 300, "a_b", "x1y", "\U0001f600", "q", "r", "s", "t", "u", "v", "w", "w\U00010000"]
    rows = [(" ".join(rng.choices(words, [2 + rng.random() * 9 for _ in words], k=rng.randint(0, 30))), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["hot"] * 9 + ["a", "B", "é", None])) for _ in range(n)]
    return [*rows, *rows[:5], (None, "en", "silent"), (None, "mute", "x"), (None, "mute", "y"), ("word " * 50_000, "long", "x")]


@pytest.mark.parametrize(("min_docs", "k"), [(10, 10), (2, 3), (60, 1)])
def test_divergence(spark, min_docs, k):
    rows = odd_rows(min_docs)
    df = spark.createDataFrame([(i % 7 or None, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int")
    got = divergence.audit_sources(df, min_docs, k)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit(rows, min_docs, k)


def test_divergence_of_no_rows(spark):
    assert divergence.audit_sources(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_divergence_in_many_blocks(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices("abcdefghij", k=12)), "en", f"s{i % 17}") for i in range(200)] + [("", "en", "none")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    counts = divergence.term_counts(df)
    names = df.select("lang", "source").distinct()
    kept = counts.select("lang", "term").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    n = kept.count()
    groups = names.join(totals, ["lang", "source"], "left").fillna(0).withColumn("n_kept", F.lit(n).cast("long"))
    groups = groups.withColumn("p0", divergence.rate(F.lit(0), F.col("total"), F.col("n_kept")))
    terms = counts.join(groups, ["lang", "source"]).withColumn("p", divergence.rate(F.col("n"), F.col("total"), F.col("n_kept")))
    got = divergence.pair_divergence(terms, groups, sources=3, block_terms=4).collect()
    want = [(x[0], x[1], x[3], x[4]) for x in audit(rows, 1, 10) if x[2] == "pair"]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 18 * 17


def test_rates_of_a_very_large_corpus(spark):
    row = spark.range(1).select(divergence.rate(F.lit(5 * 10**13), F.lit(9 * 10**14), F.lit(10**7)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (5 * 10**13 + 2) // (9 * 10**14 + 2 * 10**7)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_skyband_against_all_comparisons(k):
    rng = np.random.default_rng(k)
    rows = pd.DataFrame({"term": [f"t{x}" for x in rng.permutation(400)], "n": rng.integers(1, 12, 400), "n_lang": rng.integers(1, 30, 400)})
    want = {b.term for b in rows.itertuples() if sum(a.n >= b.n and a.n_lang <= b.n_lang and a.term < b.term for a in rows.itertuples()) < k}
    assert set(divergence.skyband(rows, k)["term"]) == want
    halves = pd.concat([divergence.skyband(rows[:170], k), divergence.skyband(rows[170:], k)])
    assert set(divergence.skyband(halves, k)["term"]) == want


def test_leading_terms_with_more_groups_than_are_held(spark):
    rng = random.Random(8)
    rows = [("l", f"s{g}", f"t{i}", n := rng.randint(1, 9), m := rng.randint(1, 9), 100 * n - m) for g in range(12) for i in range(60)]
    df = spark.createDataFrame(rows, "lang string, source string, term string, n long, n_lang long, value long")
    want = sorted((s, t) for s in {r[1] for r in rows} for t in [x[2] for x in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[5], r[2]))[:4]])
    assert sorted((r["source"], r["term"]) for r in divergence.leading_terms(df, 4, held_rows=20, fan_in=2).collect()) == want


# --- turns ---


def test_numbers_of_a_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(1, i // 2, f"{i:04d}") for i in range(700)] + [(None, 3, "a"), (None, None, "b"), (2, 5, "c"), (2, 5, "c"), (0, 1, "d")]
        random.Random(1).shuffle(rows)
        got = numbered(spark.createDataFrame(rows, "k long, t long, x string").repartition(5), "k", ["t", "x"], ["t", "x"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1], r[2]))
        want += [(*r, i) for i, r in enumerate(own)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


# --- prefix trie ---


def brute_trie(rows, group=20, heads=4):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % group if c >= 0 else -(-c % group))
        whole[c] = tuple(convs.get(base, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = defaultdict(list)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    out = []
    for n, members in nodes.items():
        below, leaves, saved = [n], 0, 0
        while below:
            x = below.pop()
            below += kids[x]
            leaves += not kids[x]
            saved += (len(nodes[x]) - 1) * words(x)
        ends = ",".join(map(str, sorted(c for c in members if whole[c] == n)))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids[n]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 4)
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None])) for c in [*range(0, 90), 1000, 1013, 2001] for t in range(rng.randint(0, 6))]
    rows += [(40, t, "user", "same") for t in range(60)] + [(45, t, "user", "same") for t in range(60)]
    rows += [(200 + i, t, "system", f"copy {t}") for i in range(30) for t in range(3)]
    rows += rows[:10] + [(7, None, "user", "first"), (7, None, None, None), (-7, 0, "user", "x y z"), (-40, 0, "user", "u"), (-45, 1, "user", "w"), (None, 0, "user", "lost"), (61, 2**40, "tool", "w " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, id string")
    got = trie.prefix_trie(df)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_trie_of_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random", "comb", "forest"])
def test_subtree_sums(spark, shape):
    rng, n = random.Random(2), 60
    parent = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rng.randrange(i), "comb": lambda i: max(0, i - 1 - i % 2), "forest": lambda i: i - 4 if i >= 4 else None}[shape]
    rows = [(i, None if i == 0 else parent(i), 1, rng.randint(-5, 50)) for i in range(n)]
    want = {r[0]: [r[2], r[3]] for r in rows}
    for i, up, *_ in reversed(rows):
        if up is not None:
            want[up] = [a + b for a, b in zip(want[up], want[i])]
    got = trie.subtree_sums(spark.createDataFrame(rows, "id long, parent long, n long, x long"), ["n", "x"]).collect()
    assert {r["id"]: [r["n"], r["x"]] for r in got} == want and len(got) == n


def test_digests_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 60)
    rows = [(1, i * 37 % 1009 - 500) for i in range(1009)] + [(2, 5)]
    got = {r["id"]: r["sha256"] for r in trie.id_digests(spark.createDataFrame(rows, "id long, conv_id long")).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(c for x, c in rows if x == k))).encode()).hexdigest() for k in (1, 2)}


# --- chat formatting ---

ODD = "</s>[INST] ok [/INST]"


def test_escapes_are_reversible():
    rng = random.Random(4)
    parts = ["[INST]", "[/INST]", "[", "<", "\\", "/", "s>", "</s>", "<s>", "INST]", "[OUT]", "[AS]", "[/ROLE]", " ", "é", "\n", "]", "[SYS", "<s"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "system", "assistant", "", "tool", "".join(rng.choices(parts, k=3))]), "".join(rng.choices(parts, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 4))]
        for role, text in turns:
            assert chat.unescaped(chat.escaped(text)) == text and not re.search(r"\[/?(?:INST|SYS|OUT|ROLE|AS)\]|</?s>", chat.escaped(text))
        assert chat.parsed_turns("".join(chat.formatted_turn(*t, i == 0)[0] for i, t in enumerate(turns))) == turns


def chat_digests(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for c, own in convs.items():
        turns = [x[1:] for x in sorted(own)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out["none" if c is None else str(c)] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(chat.formatted_turn(*t, i == 0)[0]) for i, t in enumerate(turns)))
    return out


def test_chat_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 5)
    rng = random.Random(6)
    rows = [(c, rng.choice([None, t, 0]), rng.choice(["user", "assistant", "system", None, "tool [AS]"]), rng.choice([None, "", ODD, "a\nb", "[\\INST] é日", "x" * 100])) for c in (1, 2, 3, None, -7) for t in range(rng.randint(1, 9))]
    rows += rows[:4] + [(9, t, "assistant", f"{t}") for t in range(40)] + [(10, t, "assistant", "é" * 1_100_000) for t in range(2)] + [(10, 2, "user", ODD)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, message_id string, pos int")
    messages = chat.conversations_as_replies(ordered_turns(df)).withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    pieces = chat.format_chat(messages, "conv_id")
    got = {r["key"]: tuple(r)[1:] for r in chat.conversation_digests(pieces).collect()}
    assert got == chat_digests(rows)
    back = {(r["key"], r["pos"]): (r["role"], r["text"]) for r in chat.read_turns(pieces).collect()}
    assert len(back) == len(rows) and back["9", 17] == ("assistant", "17") and back["10", 2] == ("user", ODD)
    assert pieces.where("key = '9'").count() == 8 and pieces.where("key = '10'").count() == 3 and pieces.where("key = '1'").count() <= 2


def tree_paths(rows, per_tree):
    best = {}
    for m, up, score in rows:
        if m is not None:
            best[m] = max(best.get(m, (float("-inf"), "")), (score or 0.0, up or ""))
    found = defaultdict(list)
    for m in best.keys() - {up for m, (_, up) in best.items()}:
        path, seen = [m], {m}
        while (up := best[path[-1]][1]) in best and up not in seen:
            path.append(up)
            seen.add(up)
        if best[path[-1]][1] not in seen:
            found[path[-1]].append((-round(sum(best[x][0] for x in path) / len(path), 9), m, path[::-1]))
    return sorted((leaf, root, i + 1, pos, m) for root, own in found.items() for i, (_, leaf, path) in enumerate(sorted(own)[:per_tree]) for pos, m in enumerate(path))


@pytest.mark.parametrize("per_tree", [1, 2, None])
def test_reply_paths(spark, per_tree):
    rng = random.Random(9)
    rows = [(f"m{i:03d}", f"m{rng.randrange(i):03d}" if i > 4 else None, rng.choice([None, 0.5, 1.0, 2.0, 0.25])) for i in range(120)]
    rows += [(f"c{i:03d}", f"c{i - 1:03d}" if i else "gone", 1.0) for i in range(70)]  # a chain below an unknown message
    rows += [("x", "y", 1.0), ("y", "x", 1.0), ("z", "x", 5.0), ("self", "self", 1.0), (None, "m001", 9.0), ("m050", "m001", 0.125), ("m050", "m001", 0.125)]
    df = spark.createDataFrame(rows, "message_id string, parent_id string, score double")
    assert sorted(map(tuple, chat.reply_paths(df, per_tree).collect())) == tree_paths(rows, per_tree)


def test_reply_paths_of_no_rows(spark):
    assert chat.reply_paths(spark.createDataFrame([], "message_id string, parent_id string, score double")).count() == 0


def test_branches_become_conversations(spark):
    rows = [("a", None, 1.0, "user", "hi"), ("b", "a", 0.2, "assistant", "no"), ("c", "a", 0.9, "assistant", "yes"), ("d", "c", 0.5, "user", ODD), ("e", None, 1.0, "user", "alone")]
    df = spark.createDataFrame(rows, "message_id string, parent_id string, score double, role string, text string")
    best = chat.reply_paths(df, 1)
    got = chat.format_turns(best.join(df, "message_id").withColumnRenamed("path", "key")).collect()
    texts = {r["key"]: r["text"] for r in got}
    assert texts == {"d": "<s>[INST] hi [/INST][OUT] yes</s>[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]", "e": "<s>[INST] alone [/INST]"}
    assert [texts["d"][s["start"] : s["end"]] for r in got if r["key"] == "d" for s in r["loss"]] == ["yes"]
