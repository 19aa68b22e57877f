"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas (DataFrame functions only).

Documents are linked when their texts are equal.  Members of one group with the same first label move together, so the
state of the iteration is a count per (group, first label): a group of any size is at most n_shards rows of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridag.llm.common import stored


def admitted_shares(flows: dict[tuple[int, int], int], sizes: list[int], capacity: float) -> list[float]:
    """For each shard, the largest share of the rows that want in which keeps it within capacity, given who leaves.

    flows is at most n_shards squared numbers.  The shares only fall from 1, so the loop ends at the greatest fixed point.
    """
    n = len(sizes)
    share = [1.0] * n
    wanted = [sum(v for (_, b), v in flows.items() if b == s) for s in range(n)]
    for _ in range(4 * n):
        leaving = [sum(v * share[b] for (a, b), v in flows.items() if a == s) for s in range(n)]
        new = [min(share[s], max(0.0, min(1.0, (capacity - sizes[s] + leaving[s]) / wanted[s]))) if wanted[s] else share[s] for s in range(n)]
        if max(a - b for a, b in zip(share, new)) < 1e-6:
            return new
        share = new
    return share


def counts_of(df: DataFrame, by: list[str]) -> dict:
    """Sum of n for each value of the shard columns `by`: bounded by the number of shards, or of pairs of them."""
    return {tuple(r[c] for c in by) if len(by) > 1 else r[by[0]]: r["n"] for r in df.groupBy(*by).agg(F.sum("n").alias("n")).collect()}


def propagate(cells: DataFrame, sizes: list[int], rounds: int, slack: float) -> DataFrame:
    """cells (grp, first, n, label) after at most `rounds` rounds in which cells move to the label most of their group has."""
    n_shards, capacity = len(sizes), (1 + slack) * sum(sizes) / len(sizes)
    for k in range(rounds):
        votes = cells.groupBy("grp", "label").agg(F.sum("n").alias("n"))
        tie = F.xxhash64("grp", "label").alias("tie")  # so that ties favour no shard
        best = votes.groupBy("grp").agg(F.max(F.struct("n", tie, "label")).alias("top")).select("grp", F.col("top.label").alias("target"))
        moves = cells.join(best, "grp")
        flows = counts_of(moves.where("label <> target"), ["label", "target"])
        share = admitted_shares(flows, sizes, capacity)
        if not any(share[b] for _, b in flows):
            break
        table = F.array(*[F.lit(x) for x in share])
        draw = F.pmod(F.xxhash64("grp", "first", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
        goes = (draw < F.element_at(table, F.col("target") + 1)) & (F.col("n") <= capacity / 2)
        cells = stored(moves.select("grp", "first", "n", "label", F.when(goes, F.col("target")).otherwise(F.col("label")).alias("to")))
        moved = counts_of(cells.where("label <> to"), ["label", "to"])
        for (a, b), v in moved.items():
            sizes[a], sizes[b] = sizes[a] - v, sizes[b] + v
        cells = cells.select("grp", "first", "n", F.col("to").alias("label"))
        if not moved:
            break
    return cells


def pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1).cast("long")


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16, rounds: int = 4, slack: float = 0.1, bucket_rows: int = 200_000) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, shard and slot; counts of shards are at most one apart.

    size is the text's UTF-8 bytes plus 1, text_crc32 its unsigned CRC-32; null text is empty.  First labels come from a
    hash of id and text.  In each round, cells of equal texts ask for the label that most of their group has; a shard
    admits as many rows as keep it within (1 + slack) times the mean, given who leaves; ties fall by a hash.  Last, shards over their exact
    size give rows to shards under it, unlinked ones first.  slot numbers a shard's rows from 0 without gaps.  A group
    larger than a shard is spread over several.  Ids may be null or repeated: each row is placed by itself, and equal
    rows are interchangeable.  Other columns are not carried; join on the id.  An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("grp"))
    mixed = F.xxhash64("id", "grp", F.lit(3))
    base = base.withColumn("first", F.pmod(mixed, F.lit(n_shards)).cast("int")).withColumn("mixed", F.xxhash64("id", "grp", F.lit(5)))
    base = stored(base)

    cells = base.groupBy("grp", "first").agg(F.count(F.lit(1)).alias("n"))
    first = counts_of(cells, ["first"])
    sizes = [first.get(s, 0) for s in range(n_shards)]
    rows = sum(sizes)
    linked = cells.groupBy("grp").agg(F.sum("n").alias("all")).where("all > 1").select("grp")
    cells = stored(cells.join(linked, "grp").select("grp", "first", "n", F.col("first").alias("label")))
    cells = propagate(cells, list(sizes), rounds, slack)

    buckets = max(64, -(-rows // (n_shards * bucket_rows)))
    placed = base.join(cells.select("grp", "first", "label"), ["grp", "first"], "left")
    placed = placed.select("id", "bytes", "crc", "mixed", F.coalesce("label", "first").alias("label"), F.col("label").isNull().cast("int").alias("single"), F.pmod("mixed", F.lit(buckets)).cast("int").alias("bucket"))
    placed = stored(placed)

    # Number the rows of each shard: count per bucket, prefix sums over the small table of counts, then rows in a bucket.
    counts = placed.groupBy("label", "single", "bucket").agg(F.count(F.lit(1)).alias("n"))
    have = counts_of(counts, ["label"])
    have = [have.get(s, 0) for s in range(n_shards)]
    before = Window.partitionBy("label").orderBy("single", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("label", "single", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("label", "single", "bucket").orderBy("mixed", "id")
    ranked = placed.join(offsets, ["label", "single", "bucket"]).withColumn("rank", F.col("offset") + F.row_number().over(within) - 1)

    by_size = sorted(range(n_shards), key=lambda s: (-have[s], s))
    want = {s: rows // n_shards + (k < rows % n_shards) for k, s in enumerate(by_size)}
    surplus = [max(0, have[s] - want[s]) for s in range(n_shards)]
    lack = [max(0, want[s] - have[s]) for s in range(n_shards)]
    over = F.col("rank") >= pick([want[s] for s in range(n_shards)], F.col("label"))
    place = F.col("rank") - pick([want[s] for s in range(n_shards)], F.col("label")) + pick([sum(surplus[:s]) for s in range(n_shards)], F.col("label"))
    starts = [(s, sum(lack[:s])) for s in range(n_shards) if lack[s]]
    shard, slot = F.col("label"), F.col("rank")
    for s, start in starts:  # the last of these that fits wins
        fits = over & (F.col("place") >= start)
        shard, slot = F.when(fits, F.lit(s)).otherwise(shard), F.when(fits, have[s] + F.col("place") - start).otherwise(slot)
    return ranked.withColumn("place", place).select(
        F.col("id").alias(id_col), (F.col("bytes") + 1).alias("size"), F.col("crc").alias("text_crc32"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot")
    )
