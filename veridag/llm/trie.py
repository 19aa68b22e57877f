"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns.  Turns are hashed with their place, and the sum of the hashes names the
sequence: sums of parts add up, so that no conversation needs one task.  Totals of subtrees come from rounds of joins that
rake all leaves and splice out every other node of unary chains, until only roots are left, and then put the nodes back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridag.llm.common import forget, small_batches, stored
from veridag.llm.turns import ordered_turns

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a conversation whose running sums one task makes.
SEGMENT = 1024
#: Characters of ids that are joined to one string on the way to a digest.
CHUNK = 1 << 16


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(id, values…) of a forest (id, parent, values…): each value summed over the node and all below it.

    Ids are unique, and a parent is a node's id or null.  In a round all leaves go and give their sums to their parents;
    then nodes with one child go, where a coin says so and not for the child too, and their child takes their place and
    carries their sum up.  About log n rounds leave the roots, whatever the shape.  A node that was spliced out is what it
    had itself, and all of its child: put back round by round, the last first.
    """
    carried = [f"carried_{v}" for v in values]
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    live = stored(nodes.select("id", "parent", *[F.col(v).cast("long").alias(v) for v in values], *[F.lit(0).cast("long").alias(c) for c in carried]).join(kids, "id", "left").fillna(0, ["kids"]))
    rounds = []
    while not live.where("parent is not null").isEmpty():
        leaf = (F.col("kids") == 0) & F.col("parent").isNotNull()
        raked = live.where(leaf).select("id", *values)
        gifts = live.where(leaf).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("gone"), *[F.sum(F.col(v) + F.col(c)).alias(f"gift_{v}") for v, c in zip(values, carried)])
        rest = live.where(~leaf).join(gifts, "id", "left")
        rest = stored(rest.select("id", "parent", *[(F.col(v) + F.coalesce(f"gift_{v}", F.lit(0))).alias(v) for v in values], *carried, (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids")))

        coin = (F.pmod(F.xxhash64("id", F.lit(len(rounds))), F.lit(2)) == 1) & (F.col("kids") == 1) & F.col("parent").isNotNull()
        over = rest.where(coin).select(F.col("id").alias("over"), F.col("parent").alias("top"), *[F.col(v).alias(f"over_{v}") for v in values], *[F.col(c).alias(f"over_{c}") for c in carried])
        pairs = rest.where(~coin).join(over, F.col("parent") == F.col("over"))
        spliced = stored(pairs.select("over", "top", F.col("id").alias("heir"), *[(F.col(f"over_{v}") + F.col(c)).alias(v) for v, c in zip(values, carried)], *[(F.col(c) + F.col(f"over_{v}") + F.col(f"over_{c}")).alias(f"new_{c}") for v, c in zip(values, carried)]))
        moved = spliced.select(F.col("heir").alias("id"), "top", *[f"new_{c}" for c in carried])
        after = rest.join(spliced.select(F.col("over").alias("id")), "id", "left_anti").join(moved, "id", "left")
        rounds.append((raked, spliced, live))
        live = stored(after.select("id", F.coalesce("top", "parent").alias("parent"), *values, *[F.coalesce(f"new_{c}", c).alias(c) for c in carried], "kids"))
        forget(rest)
    known, used = live.select("id", *values), [live]
    for raked, spliced, before in reversed(rounds):
        below = known.select(F.col("id").alias("heir"), *[F.col(v).alias(f"below_{v}") for v in values])
        back = stored(spliced.join(below, "heir").select(F.col("over").alias("id"), *[(F.col(v) + F.col(f"below_{v}")).alias(v) for v in values]))
        known = known.unionByName(back).unionByName(raked)
        used += [spliced, before, back]
    out = stored(known)
    forget(*used)
    return out


def id_digests(members: DataFrame) -> DataFrame:
    """(id, sha256) of members (id, conv_id): the digest of an id's decimal conv_ids, ascending, joined by commas.

    A digest is sequential by its nature: sorted ids are joined to strings by range, wherever they are, and one task a
    digest reads those strings one after another.
    """
    small_batches(members.sparkSession, 64)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, own in b.groupby("id", sort=False)["conv_id"]:
                ids = own.tolist()
                rows += [(k, ids[i], ",".join(map(str, ids[i : i + CHUNK // 20]))) for i in range(0, len(ids), CHUNK // 20)]
            yield pd.DataFrame(rows, columns=["id", "first", "ids"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sha = None, None
        for b in batches:
            rows = []
            for k, ids in zip(b["id"].tolist(), b["ids"]):
                if k == last:
                    sha.update(b"," + ids.encode())
                else:
                    rows += [(last, sha.hexdigest())] if sha else []
                    last, sha = k, hashlib.sha256(ids.encode())
            yield pd.DataFrame(rows, columns=["id", "sha256"])
        if sha:
            yield pd.DataFrame([(last, sha.hexdigest())], columns=["id", "sha256"])

    parts = members.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInPandas(join, "id long, first long, ids string")
    return parts.repartition("id").sortWithinPartitions("id", "first").mapInPandas(digest, "id long, sha256 string")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n_turns), and their turns (conv_id, pos, …), rebuilt on their group's first conversation.

    A conversation gets the first h turns of the first of its group, all if that has fewer and none if there is none, and
    then its own after its first h; h is the CRC-32 of its decimal id modulo heads.
    """
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = stored(convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")))
    of = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stored(convs.join(of, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n"))
    rest = [c for c in turns.columns if c not in ("conv_id", "pos")]
    head = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("pos < h").select("conv_id", "pos", *rest)
    own = turns.join(convs.select("conv_id", "h", "m"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), *rest)
    return convs.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), head.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, pos, a, b, …) with depth, and s, the sums of place-bound hashes up to the turn, and up, before it."""
    hashed = turns.select("*", (F.col("pos") / SEGMENT).cast("long").alias("segment"), *[F.xxhash64(F.lit(k), "pos", "a", "b").cast("decimal(20,0)").alias(f"x{k}") for k in (1, 2)])
    hashed = stored(hashed)
    order = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("conv_id", "segment").agg(F.sum("x1").alias("y1"), F.sum("x2").alias("y2"))
    wide = lambda c: c.cast("decimal(38,0)")
    before = sums.select("conv_id", "segment", wide(F.sum("y1").over(order)).alias("b1"), wide(F.sum("y2").over(order)).alias("b2")).where("segment > 0")
    run = Window.partitionBy("conv_id", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = hashed.select("*", wide(F.sum("x1").over(run)).alias("r1"), wide(F.sum("x2").over(run)).alias("r2")).join(before, ["conv_id", "segment"], "left")
    s = [wide(F.col(f"r{k}") + F.coalesce(f"b{k}", F.lit(0))) for k in (1, 2)]
    return out.select("conv_id", (F.col("pos") + 1).alias("depth"), "words", *[s[k - 1].alias(f"s{k}") for k in (1, 2)], *[wide(s[k - 1] - F.col(f"x{k}")).alias(f"up{k}") for k in (1, 2)])


def prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256).

    A node is named by its smallest member and its depth.  Turns are in order of turn, null first, then of role and text;
    null role or text is empty, and repeated rows are turns of their own.  Rows without conv_id belong to none and make no
    node.  A conversation left without turns is a member of the root alone.  Other columns are ignored, whatever their
    names; an empty table has no root.  Sequences are told apart by 128 bits of hashes.
    """
    hashes = [F.xxhash64(F.lit(k), "role", "text").alias(name) for k, name in ((3, "a"), (4, "b"))]
    words = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("words")
    known = conversations.where(F.col("conv_id").isNotNull())
    turns = stored(ordered_turns(known).select("conv_id", "pos", *hashes, words))
    convs, whole = rebuilt(turns, group, heads)
    spots = stored(prefixes(whole))

    zero = F.lit(0).cast("decimal(38,0)")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), zero.alias("s1"), zero.alias("s2"), F.lit(None).cast("decimal(38,0)").alias("up1"), F.lit(None).cast("decimal(38,0)").alias("up2"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = spots.groupBy("depth", "s1", "s2", "up1", "up2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    nodes = stored(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()))
    at = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("up1"), F.col("s2").alias("up2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    linked = stored(nodes.join(at, ["depth", "up1", "up2"], "left").select("id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", saved))
    kids = linked.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    linked = stored(linked.join(kids, "id", "left").fillna(0, ["n_children"]))
    sums = subtree_sums(linked.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")), ["n_leaves", "saved_tokens"])

    last = spots.groupBy("conv_id").agg(F.max(F.struct("depth", "s1", "s2")).alias("end"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("end.depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("end.s1", zero).alias("s1"), F.coalesce("end.s2", zero).alias("s2"))
    digests = id_digests(stored(ends).join(nodes.select("depth", "s1", "s2", "id"), ["depth", "s1", "s2"]).select("id", "conv_id"))
    out = linked.drop("saved_tokens").join(sums, "id").join(digests, "id", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    forget(turns, spots)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(nothing)).alias("ends_sha256"))
