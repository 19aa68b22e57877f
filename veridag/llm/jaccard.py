"""N-gram Jaccard join by parity sketches.

Each shingle XORs its hash into one word of a document's sketch.  Two sketches of w words differ in at most as many words
as there are shingles in just one of the documents, so if that is at most d, d + 1 words leave one that is equal: sketches
are joined by equal words within a size band.  A second sketch of single bits bounds what is left to verify on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridag.llm.common import forget, small_batches, stored
from veridag.llm.components import components
from veridag.llm.words import BASE, grouped, hashes, mixed, per_text, runs

#: 64-bit words of the bit sketch.
BIT_WORDS = 8
#: More words than d + 1, so that a sketch with at most so many empty words need not be joined by them.
SPARE = 2
#: Still more, as a share of d + 1: similar sketches then have so many more words in common, and each may leave as many
#: of its most frequent ones unjoined.
SURPLUS = 0.15


#: Bytes as they are compared: A-Z in lower case; and whether they are no blank.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.ones(256, bool)
INSIDE[[9, 10, 11, 12, 13, 32]] = False


def shingles(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its n-word shingles; of the whole sequence where it has fewer words."""
    out: list[np.ndarray] = []
    for part in grouped(texts):
        coded = [f"{t or ''}\n".encode("utf-8", "surrogatepass") for t in texts[part]]
        codes = LOWER[np.frombuffer(b"".join(coded), np.uint8)]
        start, end = runs(INSIDE[codes])
        h, count = hashes(codes, start, end), per_text(start, np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))))
        rolled = {n: rolled_hashes(h, n)}
        first = np.cumsum(count) - count
        for a, m in zip(first.tolist(), count.tolist()):
            k = min(n, m)
            if k not in rolled:
                rolled[k] = rolled_hashes(h, k) if k else np.empty(0, np.uint64)
            out.append(np.unique(rolled[k][a : a + m - k + 1]) if k else rolled[0])
    return out


def rolled_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each one on."""
    out = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(BASE) + h[i : i + len(out)])
    return out


def bands(least: int) -> list[tuple[int, int]]:
    """Size bands (smallest, largest) from the least size that can have an unequal partner, each half as wide again."""
    out = []
    while least < 1 << 40:
        out.append((least, max(least, int(1.5 * least))))
        least = out[-1][1] + 1
    return out


class Sketcher:
    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        #: At a similarity of num / den, at most size * (den - num) / num shingles are in just one of the two.
        self.bands = bands(-(-num // (den - num)))

    def keys(self, hashes: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(join keys, how many of the most frequent may go) for each size band in which the document can have a partner.

        A partner differs in at most d shingles, d by the smaller size, so of `width` words at least width - d are equal,
        and at least width - d - spare of them are not empty.  If both leave out one less than so many of their keys, the
        most frequent first, the rarest key in common stays for both.
        """
        size = len(hashes)
        out = []
        for i, (low, high) in enumerate(self.bands):
            if low > size:
                break
            if size * self.num > high * self.den:
                continue  # in no pair whose smaller document is in this band
            most, own = (x * (self.den - self.num) // self.num for x in (high, min(high, size)))
            spare, surplus = SPARE + most // 500, int(SURPLUS * (most + 1))
            width = most + 1 + spare + surplus
            part = ((hashes >> np.uint64(20)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(width)
            order = np.argsort(part, kind="stable")
            at = np.flatnonzero(np.diff(part[order], prepend=np.uint64(width)))
            full, value = part[order][at], np.bitwise_xor.reduceat(hashes[order], at)
            if width - len(full) > spare:  # too many empty words to leave them out
                empty = np.setdiff1d(np.arange(width, dtype=np.uint64), full)
                full, value = np.concatenate([full, empty]), np.concatenate([value, np.zeros(len(empty), np.uint64)])
            found = mixed(mixed(value) + full * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1))
            out.append((found.view(np.int64), surplus + most - own))
        return out


def fingerprints(docs: DataFrame, ngram: int) -> DataFrame:
    """(id, n, fp_a, fp_b): size and a 128-bit fingerprint of each set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = shingles(b["text"].tolist(), ngram)
            yield pd.DataFrame({
                "id": b["id"], "n": [len(s) for s in sets],
                "fp_a": [int(np.bitwise_xor.reduce(mixed(s + np.uint64(1))).view(np.int64)) if len(s) else 0 for s in sets],
                "fp_b": [int(mixed(s + np.uint64(2)).sum().view(np.int64)) if len(s) else 0 for s in sets],
            }).astype({"id": "Int64"})

    return docs.mapInPandas(run, "id long, n long, fp_a long, fp_b long")


def sketched(docs: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    """(id, n, keys0, drops0, keys1, drops1): set size, and the keys of up to two bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher, none = Sketcher(num, den), (np.empty(0, np.int64), 0)
        for b in batches:
            sets = shingles(b["text"].tolist(), ngram)
            keys = [[*sketcher.keys(s), none, none][:2] for s in sets]
            yield pd.DataFrame({
                "id": b["id"], "n": [len(s) for s in sets],
                "keys0": [k[0][0] for k in keys], "drops0": [k[0][1] for k in keys], "keys1": [k[1][0] for k in keys], "drops1": [k[1][1] for k in keys],
            })

    return docs.mapInPandas(run, "id long, n long, keys0 array<long>, drops0 int, keys1 array<long>, drops1 int")


def verified(pairs: DataFrame, texts: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts' shingle sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = pd.unique(pd.concat([rows["text_a"], rows["text_b"]])).tolist()
            sets, good = dict(zip(texts, shingles(texts, ngram))), []
            for ta, tb in zip(rows["text_a"], rows["text_b"]):
                one, two = sets[ta], sets[tb]
                both = len(one) + len(two) - len(np.union1d(one, two))
                good.append(den * both >= num * (len(one) + len(two) - both))
            yield rows.loc[good, ["a", "b"]]

    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return right.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def bit_sketches(texts: DataFrame, ngram: int) -> DataFrame:
    """(id, s0, s1, …): for each bit, the parity of the shingles that hash to it."""
    columns = [f"s{i}" for i in range(BIT_WORDS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = [np.bincount((s >> np.uint64(7)).astype(np.int64) % (64 * BIT_WORDS), minlength=64 * BIT_WORDS) & 1 for s in shingles(b["text"].tolist(), ngram)]
            packed = np.packbits(np.array(bits, np.uint8).reshape(len(b), -1), axis=1).view(np.int64)
            yield pd.DataFrame(packed.reshape(len(b), -1), columns=columns).assign(id=b["id"].to_numpy())

    return texts.mapInPandas(run, ", ".join(f"{c} long" for c in columns) + ", id long")


def linked(near: DataFrame, ties: DataFrame, texts: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    """Components (id, comp) of ties (a, b) and of the links among near (key, id, n, held), where equal keys propose a pair.

    First, each key proposes one leader to its other members: that which shares most keys with others, so that all of a
    group of copies meet their common source.  Then the pairs of a key that are still in different components are
    proposed, if their sizes and the bits in which their sketches differ leave them a chance.  All that is proposed is
    counted in full, so no link between components is missed, and a key of like members never makes all its pairs.
    """
    degree = stored(near.groupBy("id").agg(F.sum("held").alias("degree")))
    lead = near.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), "n")).alias("lead"))
    lead = stored(lead.select("key", (-F.col("lead.minus")).alias("a"), F.col("lead.n").alias("a_n")))
    similar_sizes = F.least("a_n", "n") * den >= F.greatest("a_n", "n") * num
    pairs = near.withColumnRenamed("id", "b").join(lead, "key").where("a <> b").where(similar_sizes)
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    stars = stored(verified(pairs, texts, ngram, num, den))
    labels = components(ties.unionByName(stars))
    forget(degree, lead, pairs)

    rows = near.join(labels, "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
    still = stored(rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key"))
    bits = [f"s{i}" for i in range(BIT_WORDS)]
    sketches = stored(bit_sketches(texts, ngram))
    two = stored(rows.join(still, "key").join(sketches, "id"))
    one = two.select("key", F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("comp").alias("a_comp"), *[F.col(c).alias(f"a_{c}") for c in bits])
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"a_{c}"))) for c in bits[1:]), F.bit_count(F.col(bits[0]).bitwiseXOR(F.col(f"a_{bits[0]}"))))
    chance = similar_sizes & (differ * (den + num) <= (F.col("n") + F.col("a_n")) * (den - num))
    rest = one.join(two.withColumnRenamed("id", "b"), "key").where("comp < a_comp").where(chance)
    rest = stored(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    out = components(ties.unionByName(stars).unionByName(verified(rest, texts, ngram, num, den)))
    forget(still, sketches, two, rest, stars)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row per row of docs: id, n_shingles and component_id, the smallest id that links reach, itself included.

    Words are what blanks (space, U+0009 to U+000D) part, with A-Z lower-cased; a set holds the distinct ngram-word
    shingles, or the whole sequence as one where there are fewer words; without words it is empty and links with nothing.
    Sets link when den * |A and B| >= num * |A or B|; each proposed pair is counted in full.  num / den is at least 2 / 3,
    so that a document has partners in two size bands at most.  Equal sets are one class from the start.  A row without id
    links with nothing and has no component; rows that repeat an id are one document with links of either text.  Other columns are not carried.  An empty table gives an empty table.
    """
    if not 2 * den <= 3 * num < 3 * den:
        raise ValueError("num / den must be at least 2 / 3 and below 1")
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = stored(fingerprints(read, ngram))
    # Stored, so that the join sees two plain shuffles and can split the partition of a very common set.
    reps = stored(sets.where("n > 0 and id is not null").groupBy("n", "fp_a", "fp_b").agg(F.min("id").alias("rep")))
    members = sets.join(reps, ["n", "fp_a", "fp_b"], "left")
    members = stored(members.select("id", "n", F.coalesce("rep", "id").alias("rep")))
    several = members.where("n > 0").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).where("a < high")
    ties = stored(members.join(several, "id").where("a < rep").select("a", F.col("rep").alias("b")).distinct())
    forget(sets, reps)

    # Texts are read again, as storing the keys of copies, which need none, would take more room.  Keys are made where a text
    # is read, and go to the join in its place, as they are less than half as large.
    ids = stored(members.where("id = rep and n > 0").select("id").distinct())
    firsts = stored(sketched(read, ngram, num, den).join(ids, "id", "left_semi"))
    of_band = [firsts.select("id", F.lit(k).cast("byte").alias("band"), F.explode(f"keys{k}").alias("key")) for k in (0, 1)]
    keyed = of_band[0].unionByName(of_band[1])
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    # The keys that no other document has are the rarest, so it does no harm that they are gone before ranks are given.
    # Of an id with several texts, the keys are ranked together, so that none of them leaves out more than it may.
    ranks = Window.partitionBy("id", "band").orderBy(F.desc("held"), "key")
    near = keyed.join(shared, "key").withColumn("rank", F.row_number().over(ranks))
    near = near.join(firsts.select("id", "n", "drops0", "drops1"), "id").where(F.col("rank") > F.when(F.col("band") == 0, F.col("drops0")).otherwise(F.col("drops1")))
    near = stored(near.select("key", "id", "n", "held"))
    forget(firsts, shared)
    texts = stored(read.join(near.select("id").distinct(), "id", "left_semi"))
    labels = linked(near, ties, texts, ngram, num, den)
    labels = labels.select(F.col("id").alias("rep"), "comp")
    out = members.join(labels, "rep", "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"))
