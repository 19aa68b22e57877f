"""Property-graph operators over nodes (label, id, name, props) and edges (src_label, src_id, rel_type, dst_label, dst_id)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridag.sources.tables import stored

ENDS = ["src_label", "src_id", "rel_type", "dst_label", "dst_id"]


def foreign_edges(rows: DataFrame, label: str, key: str, rel_type: str, dst_label: str, fk: str) -> DataFrame:
    """Candidate edges from a foreign key, with the other columns in props; rows without a key or a target give none."""
    rest = [c for c in rows.columns if c not in (key, fk)]
    props = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    ends = [F.lit(label).alias("src_label"), F.col(key).cast("string").alias("src_id"), F.lit(rel_type).alias("rel_type"), F.lit(dst_label).alias("dst_label"), F.col(fk).cast("string").alias("dst_id")]
    return rows.where(F.col(key).isNotNull() & F.col(fk).isNotNull()).select(*ends, props.alias("props"))


def loaded_edges(candidates: DataFrame, nodes: DataFrame, order: str | None = None) -> DataFrame:
    """An edge a (source, relation, target) both of whose ends are nodes; of its rows the last by `order` gives the props."""
    keys = nodes.select("label", "id").distinct()
    for end in ("src", "dst"):
        candidates = candidates.join(keys.select(F.col("label").alias(f"{end}_label"), F.col("id").alias(f"{end}_id")), [f"{end}_label", f"{end}_id"], "left_semi")
    return candidates.groupBy(*ENDS).agg((F.max_by("props", order) if order else F.any_value("props")).alias("props"))


def without_derived(edges: DataFrame) -> DataFrame:
    """Edges that were loaded; those that a derivation made (derived is true) go, so that it can be run again."""
    return edges.where(~F.coalesce(F.col("derived"), F.lit(False)))


def matched_edges(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct candidate edges both of whose ends are nodes."""
    keys = nodes.select("label", "id").distinct()
    src = keys.select(F.col("label").alias("src_label"), F.col("id").alias("src_id"))
    dst = keys.select(F.col("label").alias("dst_label"), F.col("id").alias("dst_id"))
    return candidates.join(src, ["src_label", "src_id"], "left_semi").join(dst, ["dst_label", "dst_id"], "left_semi").select(*ENDS).distinct()


def mismatch_report(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attempted and matched edges per relation; the rest points at keys that no node has."""
    matched = matched_edges(candidates, nodes).groupBy("rel_type", "src_label").agg(F.count(F.lit(1)).alias("matched"))
    tried = candidates.select(*ENDS).distinct().groupBy("rel_type", "src_label").agg(F.count(F.lit(1)).alias("attempted"))
    return tried.join(matched, ["rel_type", "src_label"], "left").select("rel_type", "src_label", "attempted", F.coalesce("matched", F.lit(0)).alias("matched"))


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both with props merged per key, the later row winning per property; the other columns are of the last row.

    Properties are aggregated one by one, so a key with many versions never meets in one row.
    """
    rows = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*keys, "props")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last"))
    each = rows.select(*keys, order, F.explode("props").alias("key", "value")).groupBy(*keys, "key").agg(F.max_by("value", order).alias("value"))
    props = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("props"))
    return last.join(props, keys, "left").select(*keys, "props", *[F.col("last")[c].alias(c) for c in rest])


def crosswalk(mappings: DataFrame, prefixes: DataFrame) -> DataFrame:
    """CURIEs of (entity_id, entity_type, standard, external_id): prefix:id, where an unknown standard is folded to its letters."""
    known = mappings.join(prefixes, "standard", "left")
    prefix = F.coalesce("prefix", F.upper(F.regexp_replace("standard", " ", "")))
    return known.select("entity_type", "entity_id", F.concat_ws(":", prefix, "external_id").alias("curie"))


def hop(start: DataFrame, edges: DataFrame, rel_type: str, backward: bool = False) -> DataFrame:
    """start (origin, id) moved along edges of one type, distinct."""
    a, b = ("dst_id", "src_id") if backward else ("src_id", "dst_id")
    step = edges.where(F.col("rel_type") == rel_type).select(F.col(a).alias("id"), F.col(b).alias("to"))
    return start.join(step, "id").select("origin", F.col("to").alias("id")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    a = edges.select(F.concat_ws(":", "src_label", "src_id").alias("a"), F.concat_ws(":", "dst_label", "dst_id").alias("b"), "rel_type")
    return a.unionByName(a.select(F.col("b").alias("a"), F.col("a").alias("b"), "rel_type"))


def neighbourhood(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(origin, node, hops): the nodes within `depth` undirected steps of each seed node (origin), with the least steps.

    A join a step; a node is kept with its first step only, so a step starts from what the last one found anew.
    """
    links = both_ways(edges).select("a", "b").distinct()
    seen = seeds.select("origin", F.col("origin").alias("node"), F.lit(0).alias("hops"))
    front = seen
    for k in range(1, depth + 1):
        reached = front.join(links, front["node"] == links["a"]).select("origin", F.col("b").alias("node")).distinct()
        front = reached.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src_label").alias("label"), F.col("src_id").alias("id")).unionByName(edges.select(F.col("dst_label").alias("label"), F.col("dst_id").alias("id")))
    return ends.groupBy("label", "id").agg(F.count(F.lit(1)).alias("degree"))


def scoped_facts(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None, types: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Facts of the entities that ids (label, id; a null label is any) and types name, the first `most` by type and id.

    The scope cuts nodes and edges before relations are gathered, and the limit, which has an order, before edges are read.
    """
    wanted = nodes if types is None else nodes.where(F.col("label").isin(types))
    if ids is not None:
        exact = wanted.join(ids.where("label is not null").select("label", "id").distinct(), ["label", "id"], "left_semi")
        loose = wanted.join(ids.where("label is null").select("id").distinct(), "id", "left_semi").select(*wanted.columns)
        wanted = exact.select(*wanted.columns).unionByName(loose).dropDuplicates(["label", "id"])
    if most is not None:
        wanted = stored(wanted.orderBy("label", "id").limit(most))
    own = wanted.select(F.col("label").alias("src_label"), F.col("id").alias("src_id"))
    return facts(wanted, edges.join(own, ["src_label", "src_id"], "left_semi"))


def facts(nodes: DataFrame, edges: DataFrame, most: int | None = None, distinct_edges: bool = False) -> DataFrame:
    """(entity_type, entity_id, properties, relations): each relation with its sorted distinct targets; no relation, empty map.

    With `most`, a relation lists its first targets only, cut before rows meet, so that a hub is no large row, and a map
    `counts` tells how many it has.  distinct_edges: no two edges have the same ends and relation, so that none are sought.
    """
    keys = [F.col("src_label").alias("label"), F.col("src_id").alias("id"), "rel_type"]
    none = lambda kind: F.create_map().cast(f"map<string,{kind}>")
    if most is None:
        targets = edges.groupBy(*keys).agg(F.array_sort(F.collect_set("dst_id")).alias("targets"))
    else:
        distinct = edges.select(*keys, "dst_id")
        distinct = distinct if distinct_edges else distinct.distinct()
        order = Window.partitionBy("label", "id", "rel_type").orderBy("dst_id")
        first = distinct.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).groupBy("label", "id", "rel_type").agg(F.array_sort(F.collect_list("dst_id")).alias("targets"))
        targets = first.join(distinct.groupBy("label", "id", "rel_type").agg(F.count(F.lit(1)).alias("n")), ["label", "id", "rel_type"])
    of = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel_type", c))))  # noqa: E731  a row a relation
    maps = targets.groupBy("label", "id").agg(of("targets").alias("relations"), *([of("n").alias("counts")] if most is not None else []))
    out = nodes.join(maps, ["label", "id"], "left").select(F.col("label").alias("entity_type"), F.col("id").alias("entity_id"), F.col("props").alias("properties"), F.coalesce("relations", none("array<string>")).alias("relations"), *([F.coalesce("counts", none("bigint")).alias("counts")] if most is not None else []))
    return out


def relation_counts(nodes: DataFrame, edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """(entity_type, entity_id, properties, relations): for each relation how many distinct targets; rules need no more of them.

    With relations named, edges must be distinct, and one aggregate counts those named and no other.
    """
    ends = [F.col("src_label").alias("label"), F.col("src_id").alias("id")]
    if relations is not None:
        pairs = edges.where(F.col("rel_type").isin(relations)).groupBy(*ends).agg(*[F.count_if(F.col("rel_type") == r).alias(f"n{i}") for i, r in enumerate(relations)])
        found = [x for i, r in enumerate(relations) for x in (F.lit(r), F.nullif(F.col(f"n{i}"), F.lit(0)))]
        maps = pairs.select("label", "id", F.map_filter(F.create_map(*found), lambda _, n: n.isNotNull()).alias("relations")) if relations else pairs.withColumn("relations", F.create_map().cast("map<string,bigint>"))
    else:
        counts = edges.groupBy(*ends, "rel_type").agg(F.count_distinct("dst_label", "dst_id").alias("n"))
        maps = counts.groupBy("label", "id").agg(F.map_from_entries(F.collect_list(F.struct("rel_type", "n"))).alias("relations"))  # a row a relation
    rest = [c for c in nodes.columns if c not in ("label", "id", "name", "props")]
    none = F.create_map().cast("map<string,bigint>")
    return nodes.join(maps, ["label", "id"], "left").select(F.col("label").alias("entity_type"), F.col("id").alias("entity_id"), F.col("props").alias("properties"), F.coalesce("relations", none).alias("relations"), *rest)


def links_of(edges: DataFrame, ids: DataFrame, rel_type: str | None = None) -> DataFrame:
    """(me, rel_type, other) of the edges at either end of each id (label, id): two equi-joins, never one on an OR.

    Only edges with an end of one of the ids' labels are read.
    """
    labels = [r[0] for r in ids.select("label").distinct().collect()]  # a row a label
    e = edges.where(F.col("rel_type") == rel_type) if rel_type else edges
    me = ids.select(F.concat_ws(":", "label", "id").alias("me")).distinct()
    a, b = F.concat_ws(":", "src_label", "src_id"), F.concat_ws(":", "dst_label", "dst_id")
    end = lambda name, own, far: e.where(F.col(name).isin(labels)).select(own.alias("me"), "rel_type", far.alias("other")).join(me, "me")
    return end("src_label", a, b).unionByName(end("dst_label", b, a)).distinct()


# A run of RUN characters is marked in a stretch of SPAN where its hash is the least of the stretch's runs; SKETCH is the
# number of bits of a sketch of runs, and CHUNK how many of them a row of it has.
RUN, SPAN, SKETCH, CHUNK = 12, 20, 1 << 27, 1 << 20


def marked(text: str) -> np.ndarray:
    """Hashes of the marked runs of a text.  A text that holds a needle of SPAN characters or more has all of its marks."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < SPAN:
        return np.empty(0, np.int64)
    n, h = len(c) - RUN + 1, np.zeros(len(c) - RUN + 1, np.uint64)
    for j in range(RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : j + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, SPAN - RUN + 1).min(axis=1)).view(np.int64)


def mark_rows(rows: DataFrame, id: str, text: str, among: np.ndarray | None = None) -> DataFrame:
    """(id, run): the marks of texts; with `among`, a sketch, only those that it may hold."""
    kind = rows.schema[id].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(among) if among is not None else None

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                found = [marked(t) for t in part[text]]
                run = np.concatenate([np.empty(0, np.int64), *found])
                own = np.repeat(part[id].to_numpy(), [len(x) for x in found])
                if held is not None:
                    bit = run.view(np.uint64) % np.uint64(SKETCH)
                    keep = (held.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    run, own = run[keep], own[keep]
                yield pd.DataFrame({id: own, "run": run})

    return rows.where(F.col(text).isNotNull()).select(id, text).mapInPandas(mark, f"{id} {kind}, run long")


def sketch_of(runs: DataFrame) -> np.ndarray:
    """A bit set for each run, of SKETCH bits whatever their number; its chunks are made in tasks."""

    def chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(CHUNK, np.uint8)
        bits[rows["bit"].to_numpy() % CHUNK] = 1
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    # Signed remainder made that of the unsigned hash: SKETCH is a power of two.
    bit = F.col("run").bitwiseAND(F.lit(SKETCH - 1))
    rows = runs.select(bit.alias("bit")).distinct().withColumn("chunk", F.floor(F.col("bit") / CHUNK))
    out = np.zeros(SKETCH // 8, np.uint8)
    for k, bits in rows.groupBy("chunk").applyInPandas(chunk, "chunk long, bits binary").collect():  # SKETCH / CHUNK rows at most
        out[k * CHUNK // 8 : (k + 1) * CHUNK // 8] = np.frombuffer(bits, np.uint8)
    return out


def rarest_runs(parts: DataFrame, postings: DataFrame) -> DataFrame:
    """(nid, run) of needles all of whose runs (nid, run) are in texts: the run that the fewest texts hold."""
    held = stored(postings.groupBy("run").agg(F.count(F.lit(1)).alias("n")))
    rarest = parts.join(held.hint("merge"), "run", "left").groupBy("nid").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.min_by("run", "n").alias("run"))
    return stored(rarest.where("missing = 0").select("nid", "run"))


def containing(texts: DataFrame, needles: DataFrame, gram: int = 3) -> DataFrame:
    """(text columns…, needle) of each text (column text) that holds a needle, by an inverted index of character runs.

    A needle is sought by the one of its runs that the fewest texts hold, and not at all if one of them is in no text.
    Needles of SPAN characters or more have long runs, marked about one in five, and a sketch of all needles' runs keeps
    from the shuffle what texts have besides.  Shorter needles have all their runs of `gram` characters; one shorter still
    is a run itself.  Texts are named by a hash until the check, for which they join again: what is made of a text is in
    proportion to its length.  Null and empty texts and needles match nothing.  All joins shuffle, as the planner takes
    runs for no more than the texts' file.
    """
    wanted = needles.where("length(needle) > 0").select("needle").distinct().withColumn("size", F.when(F.length("needle") >= SPAN, F.lit(SPAN)).otherwise(F.least(F.length("needle"), F.lit(gram))))
    wanted = stored(wanted.withColumn("nid", F.monotonically_increasing_id()))
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())  # `gram` of them at most, and SPAN
    if not sizes:
        return texts.withColumn("needle", F.lit(None).cast("string")).limit(0)
    keyed = texts.withColumn("_text_hash", F.xxhash64("text"))
    found = []
    if short := [n for n in sizes if n < SPAN]:
        runs = lambda c, n: F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)))
        postings = keyed.select("_text_hash", F.explode(F.concat(*[runs("text", n) for n in short])).alias("run"))
        parts = None
        for n in short:
            own = wanted.where(F.col("size") == n).select("nid", F.explode(runs("needle", n)).alias("run"))
            parts = own if parts is None else parts.unionByName(own)
        found.append(postings.join(rarest_runs(parts, postings).hint("merge"), "run").select("_text_hash", "nid").distinct())
    if SPAN in sizes:
        parts = stored(mark_rows(wanted.where(F.col("size") == SPAN), "nid", "needle"))
        keys = rarest_runs(parts, mark_rows(keyed, "_text_hash", "text", sketch_of(parts)))
        postings = mark_rows(keyed, "_text_hash", "text", sketch_of(keys))
        found.append(postings.join(keys.hint("merge"), "run").select("_text_hash", "nid").distinct())
    met = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    met = stored(met.join(wanted.select("nid", "needle").hint("merge"), "nid").select("_text_hash", "needle"))
    return keyed.join(met.hint("merge"), "_text_hash").where(F.contains("text", F.col("needle"))).drop("_text_hash")


def same_as(pairs: DataFrame) -> DataFrame:
    """SAME_AS edges between concepts, with method, evidence and confidence."""
    return pairs.select(F.col("a").alias("src_id"), F.lit("SAME_AS").alias("rel_type"), F.col("b").alias("dst_id"), F.lit("shared_name_token").alias("method"), F.col("token").alias("evidence"), F.lit(0.9).alias("confidence"))


def same_concept(pairs: DataFrame, canonicals: DataFrame) -> DataFrame:
    """pairs (a, b of curies, null if unresolved) with same: whether both have the same canonical curie; unknown ones are their own."""
    known = lambda c: canonicals.select(F.col("curie").alias(c), F.col("canonical").alias(f"{c}_canonical"))
    own = lambda c: F.coalesce(f"{c}_canonical", c)
    return pairs.join(known("a"), "a", "left").join(known("b"), "b", "left").select("a", "b", F.coalesce(own("a") == own("b"), F.lit(False)).alias("same"))


def schema_profile(nodes: DataFrame) -> DataFrame:
    keys = nodes.select("label", F.explode(F.map_keys("props")).alias("key")).groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(keys, "label", "left")


def edge_patterns(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_label", "rel_type", "dst_label").agg(F.count(F.lit(1)).alias("n"))


def resolved_names(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Label and display name of each id, whatever its label: its name, or itself."""
    return ids.join(nodes.select("id", "label", "name"), "id").select("id", "label", F.coalesce(F.nullif("name", F.lit("")), "id").alias("display"))


def canonical(curies: DataFrame, same_as: DataFrame, depth: int = 3) -> DataFrame:
    """(curie, canonical): the smallest curie within `depth` SAME_AS steps."""
    edges = same_as.select(F.lit("C").alias("src_label"), F.col("a").alias("src_id"), F.lit("SAME_AS").alias("rel_type"), F.lit("C").alias("dst_label"), F.col("b").alias("dst_id"))
    near = neighbourhood(curies.select(F.concat(F.lit("C:"), "curie").alias("origin")), edges, depth)
    return near.groupBy(F.substring("origin", 3, 1 << 30).alias("curie")).agg(F.min(F.substring("node", 3, 1 << 30)).alias("canonical"))


def equivalence_classes(pairs: DataFrame) -> DataFrame:
    """(id, canonical) for each id of the undirected pairs (a, b): the smallest id that pairs lead to, however far.

    In a round each id and the canonical id it has take the smallest one of its neighbours, and then that one's: chains
    shorten by a factor a round, and about log n rounds are left.  Each round is stored.  Pairs with a null go; an id paired
    with itself alone is its own class; repeated pairs count once.
    """
    known = pairs.where("a is not null and b is not null").select("a", "b")
    both = stored(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    of = stored(both.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("canonical")))
    while True:
        seen = both.join(of.select(F.col("id").alias("b"), "canonical"), "b").groupBy(F.col("a").alias("id")).agg(F.min("canonical").alias("near"))
        near = stored(of.join(seen, "id"))
        hooked = near.select("id", F.least("canonical", "near").alias("canonical")).unionByName(near.select(F.col("canonical").alias("id"), F.col("near").alias("canonical")))
        hooked = stored(hooked.groupBy("id").agg(F.min("canonical").alias("canonical")))
        up = hooked.select(F.col("id").alias("canonical"), F.col("canonical").alias("above"))
        jumped = hooked.join(up, "canonical").select("id", F.least("canonical", "above").alias("canonical"))
        changed = stored(jumped.join(of.select("id", F.col("canonical").alias("before")), "id"))
        of = changed.select("id", "canonical")
        if changed.where("canonical <> before").isEmpty():
            return of


def shared_token_pairs(terms: DataFrame, least: int = 5, crowded: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Pairs of terms (curie, surface) of different vocabularies that share an alphabetic token, and the crowded tokens.

    Terms meet by token and by the two vocabularies, so that no pair within a vocabulary is made.  A token that more than
    `crowded` terms have hardly names a concept and pairs much with much; it is reported, and joined all the same: the
    tokens are stored, so that a hot one can be split.
    """
    tokens = terms.select("curie", F.explode(F.regexp_extract_all(F.lower("surface"), F.lit(rf"([a-z]{{{least},}})"), F.lit(1))).alias("token")).distinct()
    tokens = stored(tokens.withColumn("own", F.split("curie", ":")[0]))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    met = stored(tokens.select("token", "own").distinct().groupBy("token").agg(F.array_sort(F.collect_list("own")).alias("all")).where(F.size("all") > 1))  # a row a vocabulary
    # Of two vocabularies the first in order is on the left; a vocabulary is dealt to each one after it.
    sides = stored(tokens.join(met, "token").select("token", "curie", "own", F.explode("all").alias("with")).where("own <> with"))
    left = sides.where("own < with").select("token", "own", "with", F.col("curie").alias("x"))
    right = sides.where("own > with").select("token", F.col("with").alias("own"), F.col("own").alias("with"), F.col("curie").alias("y"))
    pairs = left.join(right, ["token", "own", "with"])
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("token").alias("token")), counts.where(F.col("n") > crowded)


def inverse(edges: DataFrame, rel_type: str, name: str) -> DataFrame:
    return edges.where(F.col("rel_type") == rel_type).select(
        F.col("dst_label").alias("src_label"), F.col("dst_id").alias("src_id"), F.lit(name).alias("rel_type"), F.col("src_label").alias("dst_label"), F.col("src_id").alias("dst_id"), F.lit(1.0).alias("confidence")
    )


def latest_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
