"""Source divergence audit: how far the sources of a language are from each other, and by which terms from the language.

Rates are whole numbers of parts in 10^9, so that every figure is exact and the same on any partitioning.  A pair's
divergence sums over all kept terms, in blocks of sources and of terms.  A group's leading terms come from dominance
skybands: a term with at least as many occurrences in the group, at most as many in the language and an earlier UTF-8
form is ahead whatever the totals are, so that a term with k such others is not among the k first.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridag.llm.common import forget, small_batches, stored

#: A term is a run of letters A-Z, a-z and of anything beyond ASCII; this lower-cases A-Z and blanks what is no term.
TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"
#: Terms that a task counts before it hands them on.
AT_ONCE = 200_000
SKYBAND = "lang string, source string, term string, n long, n_lang long, value long, part int"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and how many of its rows have it.

    Tasks count whole batches of UTF-8 bytes, in which no ASCII byte is part of another character.
    """
    small_batches(docs.sparkSession)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def rows_of(found: dict) -> pa.RecordBatch:
        parts = []
        for (lang, source), (terms, docs) in found.items():
            words = list(terms)
            texts = pa.array(words, pa.binary()).cast(pa.string())
            counts = [np.fromiter(c, np.int64, len(words)) for c in (terms.values(), map(docs.__getitem__, words))]
            parts.append([pa.repeat(lang, len(words)), pa.repeat(source, len(words)), texts, *map(pa.array, counts)])
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.concat_arrays(c) for c in zip(*parts)] or [pa.array([], k) for k in kinds]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                terms, docs = found.setdefault((lang, source), (Counter(), Counter()))
                words = text.translate(TO_TERMS).split()
                terms.update(words)
                docs.update(set(words))
            if sum(len(terms) for terms, _ in found.values()) >= AT_ONCE:
                yield rows_of(found)
                found = {}
        yield rows_of(found)

    rows = docs.select(name("lang"), name("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def rate(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), in decimals, as counts of a large corpus overflow a long here."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(count) + F.lit(2).cast("decimal(1,0)")), wide(total + 2 * kept))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def skyband(rows: pd.DataFrame, k: int, probes: int = 128) -> pd.DataFrame:
    """The rows (term, n, n_lang) that fewer than k others dominate: n at least, n_lang at most, an earlier term.

    Rows that k of some promising ones dominate go at once; those left are compared in an order in which whoever dominates
    a row comes before it, with the ones kept: if k dominate a row, k of these are in the skyband themselves.
    """
    place = np.empty(len(rows), np.int64)
    place[np.argsort(rows["term"].to_numpy(object), kind="stable")] = np.arange(len(rows))
    n, lang = rows["n"].to_numpy(np.int64), rows["n_lang"].to_numpy(np.int64)
    order = np.lexsort((place, lang, -n))
    n, lang = n[order], lang[order]
    # Of equal counts only the terms decide, and the first k may stay.
    fresh = np.concatenate([[True], (n[1:] != n[:-1]) | (lang[1:] != lang[:-1])])[: len(n)]
    run = np.arange(len(n)) - np.maximum.accumulate(np.where(fresh, np.arange(len(n)), 0))
    first = run < k
    rows, n, lang, place = rows.iloc[order[first]], n[first], lang[first], place[order[first]]
    hits = np.zeros(len(rows), np.int64)
    for i in np.argsort(-(n.astype(float) ** 2 / np.maximum(lang, 1)), kind="stable")[:probes]:
        hits += (n <= n[i]) & (lang >= lang[i]) & (place > place[i])
    left = np.flatnonzero(hits < k)
    rows, lang, place, kept, m = rows.iloc[left], lang[left], place[left], np.zeros(len(left), bool), 0
    langs, places = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
    for i in range(len(left)):
        if np.count_nonzero((langs[:m] <= lang[i]) & (places[:m] < place[i])) < k:
            kept[i], langs[m], places[m], m = True, lang[i], place[i], m + 1
    return rows[kept]


def skybands(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    found = [skyband(own, k) for _, own in rows.groupby(["lang", "source"], sort=False)]
    return pd.concat(found) if found else rows


def leading_terms(terms: DataFrame, k: int, held_rows: int = 100_000, fan_in: int = 32) -> DataFrame:
    """The first k terms of each group (lang, source, term, n, n_lang, value), by value and then by term, with rank.

    Every partition keeps a skyband a group, of at most held_rows rows in all at a time; those meet fan_in to a group,
    and then in one.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, part = [], 0, TaskContext.get().partitionId() % fan_in
        for b in batches:
            held, n = [*held, b], n + len(b)
            if n >= held_rows:
                band = skybands(pd.concat(held), k)
                held, n = [band], len(band)
                if n >= held_rows // 2:  # too many groups to hold: what is let go is still whole
                    yield band.assign(part=part)
                    held, n = [], 0
        if held:
            yield skybands(pd.concat(held), k).assign(part=part)

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        return skyband(rows, k)

    bands = terms.select("lang", "source", "term", "n", "n_lang", "value").mapInPandas(local, SKYBAND)
    for keys in (["lang", "source", "part"], ["lang", "source"]):
        bands = bands.groupBy(*keys).applyInPandas(merged, SKYBAND)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return bands.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pair_sums(cells: pd.DataFrame, heads: pd.DataFrame, sides: tuple[int, int]) -> pd.DataFrame:
    """Sums over the cells' terms of the divergence of every source of one block from every one of the other.

    cells: (source, side, term, p) where the source has the term.  heads: (source, side, p0) of all sources, with the rate
    of a term that the source lacks.  Within one block each pair comes once.
    """
    code, names = pd.factorize(cells["term"])
    left, right = (heads[heads["side"] == s].sort_values("source", kind="stable") for s in sides)
    rates = []
    for side, own in zip(sides, (left, right)):
        column = pd.Series(np.arange(len(own)), index=own["source"].to_numpy(object))
        mine = (cells["side"] == side).to_numpy()
        whole = np.broadcast_to(own["p0"].to_numpy(np.int64), (len(names), len(own))).copy()
        whole[code[mine], column.reindex(cells.loc[mine, "source"]).to_numpy(int)] = cells.loc[mine, "p"].to_numpy(np.int64)
        rates.append(whole)
    out = []
    for i, (name, p0) in enumerate(zip(left["source"], left["p0"])):
        first = i + 1 if sides[0] == sides[1] else 0
        p, q = rates[0][:, i, None], rates[1][:, first:]
        other = right.iloc[first:]
        out.append(pd.DataFrame({"a": name, "b": other["source"].to_numpy(object), "p0_a": p0, "p0_b": other["p0"].to_numpy(), "terms": len(names), "value": ((p - q) ** 2 // (p + q)).sum(axis=0)}))
    return pd.concat(out) if out else pd.DataFrame(columns=["a", "b", "p0_a", "p0_b", "terms", "value"])


def pair_divergence(terms: DataFrame, groups: DataFrame, sources: int = 64, block_terms: int = 2048) -> DataFrame:
    """(lang, source, item, value) of each group and each other source of its language.

    terms: (lang, source, term, p) of kept terms that the source has; groups: (lang, source, n_kept, p0) of all sources.
    Sources meet in blocks of about `sources`, a task for two blocks and about block_terms terms; terms that neither source
    of a pair has are added by their number.
    """
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"), F.max("n_kept").alias("v")).agg(F.max("s"), F.max("v")).first()
    n, m = (max(1, math.ceil((x or 0) / y)) for x, y in ((sizes[0], sources), (sizes[1], block_terms)))
    side, every = F.pmod(F.xxhash64("source"), F.lit(n)).cast("int").alias("side"), lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    low, high = F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high")
    keys = ["lang", "low", "high", "bucket"]
    cells = terms.select("lang", "source", side, F.pmod(F.xxhash64("term"), F.lit(m)).cast("int").alias("bucket"), "term", "p", every(n).alias("other")).withColumns({"low": low, "high": high})
    heads = groups.select("lang", "source", side, "p0", "n_kept", every(n).alias("other")).withColumns({"low": low, "high": high}).withColumn("bucket", every(m))

    def sums(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        kept = int(right["n_kept"].iloc[0]) if len(right) else 0
        return pair_sums(left, right, (key[1], key[2])).assign(lang=key[0], n_kept=kept)[["lang", "a", "b", "p0_a", "p0_b", "n_kept", "terms", "value"]]

    schema = "lang string, a string, b string, p0_a long, p0_b long, n_kept long, terms long, value long"
    parts = cells.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInPandas(sums, schema)
    whole = parts.groupBy("lang", "a", "b", "p0_a", "p0_b", "n_kept").agg(F.sum("terms").alias("terms"), F.sum("value").alias("value"))
    lacking = F.when(F.col("n_kept") > 0, (F.col("n_kept") - F.col("terms")) * divergence(F.col("p0_a"), F.col("p0_b"))).otherwise(0)
    both = whole.select("lang", "a", "b", (F.col("value") + lacking).alias("value"))
    return both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")


def audit_sources(docs: DataFrame, min_docs: int = 10, k: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part "pair", how far each group is from each other source of its language;
    part "term", the first k kept terms that the group uses more than its language does.

    A language keeps the terms of at least min_docs of its rows.  Null text, lang and source are ''; every row is a
    document, whatever its doc_id, and repeated rows count as often as they come.  Equal values are ranked by UTF-8.  A
    group without terms has pairs all the same, of value 0 where its language keeps no term; a language of one source has
    none.  Other columns are ignored, whatever their names; an empty table gives an empty table.
    """
    counts = stored(term_counts(docs))
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= min_docs).select("lang", "term", "n_lang"))
    own = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    names = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("n_lang").alias("total_lang"))
    used = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = names.join(used, ["lang", "source"], "left").join(totals, "lang", "left").fillna(0, ["total", "n_kept", "total_lang"])
    lacked = F.when(F.col("n_kept") > 0, rate(F.lit(0), F.col("total"), F.col("n_kept"))).otherwise(0)
    groups = stored(groups.withColumn("p0", lacked))
    forget(counts, kept)

    rated = own.join(groups, ["lang", "source"])
    rated = rated.select("lang", "source", "term", "n", "n_lang", rate(F.col("n"), F.col("total"), F.col("n_kept")).alias("p"), rate(F.col("n_lang"), F.col("total_lang"), F.col("n_kept")).alias("q"))
    ahead = rated.where(F.col("p") > F.col("q")).withColumn("value", divergence(F.col("p"), F.col("q")))
    terms = leading_terms(ahead, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    pairs = pair_divergence(rated, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).unionByName(terms)
