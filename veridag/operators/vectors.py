"""Vector search over (point_id, collection, vec, payload columns)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridag.functions.numbers import rounded
from veridag.sources.tables import stored


# Queries that a task scores at once: what it holds is this many times the points of a block.
SLICE = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine, dot or (negative) euclid; null where undefined."""
    if metric == "dot":
        return dot(a, b)
    if metric == "euclid":
        return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(queries: DataFrame, points: DataFrame, k: int, on: list[str], metric: str = "cosine", digits: int = 6, block_rows: int = 4096, own: str | None = None) -> DataFrame:
    """The k points nearest to each query (query_id, vec) among those equal to it in the columns `on`, itself excluded.

    Exact search of a stated query set: both sides are dealt into blocks of about block_rows, each pair of blocks meets in
    one task, which keeps the k best of each query before rows meet and scores SLICE queries at once.  Vectors that are
    null, hold nulls or have another length than the query match nothing, and so do zero vectors by cosine.  Equal scores,
    rounded to `digits`, are in order of point_id, but for the point that the queries' column `own` names, which is first.
    """
    fine = "vec is not null and size(vec) > 0 and forall(vec, x -> x is not null)"
    vec = F.transform("vec", lambda x: x.cast("double")).alias("vec")
    q = queries.where(fine).select("query_id", *on, *([F.col(own).alias("_own")] if own else []), vec, F.size("vec").alias("_dims"))
    p = points.where(fine).select(*[c for c in points.columns if c != "vec"], vec, F.size("vec").alias("_dims"))
    q_parts, p_parts = (max(1, math.ceil(df.count() / block_rows)) for df in (q, p))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = q.withColumn("_q", part("query_id", q_parts)).withColumn("_p", every(p_parts))
    p = p.withColumn("_p", part("point_id", p_parts)).withColumn("_q", every(q_parts))
    rest = [c for c in points.columns if c != "vec"]
    schema = T.StructType([queries.schema["query_id"], *[points.schema[c] for c in rest], *([T.StructField("_own", queries.schema[own].dataType)] if own else []), T.StructField("score", T.DoubleType())])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=schema.names)
        right = right.sort_values("point_id", kind="stable")
        b, ids = np.stack(right["vec"].to_list()), right["point_id"].to_numpy()
        return pd.concat([best_rows(left.iloc[i : i + SLICE], right, b, ids) for i in range(0, len(left), SLICE)])

    def best_rows(left: pd.DataFrame, right: pd.DataFrame, b: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        names = left["query_id"].to_numpy(), ids, left["_own"].to_numpy() if own else None
        row, top, score, _ = best_of(scores(np.stack(left["vec"].to_list()), b, metric), *names, k, digits)
        out = right[rest].iloc[top].assign(query_id=names[0][row], score=score)
        return (out.assign(_own=names[2][row]) if own else out)[schema.names]

    keys = [*on, "_dims", "_p", "_q"]
    near = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(best, schema).withColumn("score", rounded("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *own_first(own), "point_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_own")


def best_of(score: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, own: np.ndarray | None, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best points of each query, from scores of queries x points in order of their ids, where what is not finite is
    no score: places of query and point, score, and, on the first row of each query, how many scores it had."""
    score[(query_ids[:, None] == ids) | ~np.isfinite(score)] = -np.inf
    order = np.round(score, digits)
    if own is not None:
        order[own[:, None] == ids] += 0.5 * 10.0**-digits  # before those that are equal, after those above
    top = order.argmax(axis=1)[:, None] if k == 1 else np.argsort(-order, axis=1, kind="stable")[:, :k]
    row, met = np.repeat(np.arange(len(score)), top.shape[1]), np.zeros(top.shape, int)
    met[:, 0] = np.isfinite(score).sum(axis=1)
    best = score[row, top.ravel()]
    some = np.isfinite(best)
    return row[some], top.ravel()[some], best[some], met.ravel()[some]


def own_first(own: str | None) -> list[Column]:
    return [F.desc(F.col("_own").eqNullSafe(F.col("point_id")))] if own else []


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclid":
        return -np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1), 0.0))
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    return a @ b.T


@dataclass(frozen=True)
class VectorIndex:
    """Hash tables over vectors: the points, each with `codes`, its code in each table, and the hyperplanes of each table."""

    points: DataFrame
    planes: np.ndarray  # tables x bits x dims


FINE = "{0} is not null and size({0}) = {1} and forall({0}, x -> x is not null) and exists({0}, x -> x <> 0)"


def build_index(points: DataFrame, dims: int, tables: int = 16, bits: int = 10, seed: int = 7) -> VectorIndex:
    """Random-projection hash tables over points (point_id, vec, …), stored: a bit of a code is the side of a hyperplane.

    Vectors that are null, hold nulls, are zero or have other than dims dimensions are in no table, as they have no cosine
    with anything.  A code of `bits` bits suits some 30 * 2**bits points; point_id must be unique.
    """
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
    code = F.pandas_udf(lambda v: pd.Series(list(codes_of(stacked(v), planes)[0]) if len(v) else [], dtype=object), "array<long>")
    return VectorIndex(stored(points.where(FINE.format("vec", dims)).withColumn("codes", code("vec"))), planes)


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(float)


def codes_of(x: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each row in each table, and how far the row is from each hyperplane."""
    far = np.einsum("nd,tbd->ntb", x, planes)
    return (far > 0) @ (1 << np.arange(planes.shape[1])), far


def probed_codes(x: np.ndarray, planes: np.ndarray, probes: int) -> np.ndarray:
    """The codes to look up for each row in each table: its own, and those with the nearest hyperplanes crossed, the
    cheapest sets of one or two crossings first."""
    own, far = codes_of(x, planes)
    bits = planes.shape[1]
    sets = [(i,) for i in range(bits)] + [(i, j) for i in range(bits) for j in range(i)]
    flips = np.array([sum(1 << i for i in s) for s in sets])
    cost = np.stack([(far[..., list(s)] ** 2).sum(axis=-1) for s in sets], axis=-1)
    order = np.argsort(cost, axis=-1, kind="stable")[..., : max(0, probes - 1)]
    return np.concatenate([own[..., None], own[..., None] ^ flips[order]], axis=-1)


def indexed(queries: DataFrame, index: VectorIndex, k: int, on: list[str], probes: int = 8, digits: int = 6, least: float | None = None, own: str | None = None, exact: str | None = None, block_rows: int = 4096) -> DataFrame:
    """What nearest() gives by cosine, from the points in the probed buckets alone, with `compared`, the points that each
    query was compared with.

    Scores are exact; what may be missing are points whose codes differ too much in every table.  With `least`, queries
    that find fewer than k points of that score or more are searched again in full, by nearest(), and so are those that
    don't find the point that the column `own` names; of equal scores, that point is first.  With `exact`, the queries'
    `vec` only looks buckets up, and scores are those of the vector in the column `exact`.

    A bucket's queries and points meet in blocks of about block_rows, each pair of blocks in one task, so that no row is
    made of a pair; small blocks share a task.  What is shuffled is each point once a table, each query once a bucket, and
    k rows a query and block.
    """
    planes, payload = index.planes, [c for c in index.points.columns if c not in ("vec", "codes")]
    tables, dims = planes.shape[0], planes.shape[2]
    probed = F.pandas_udf(lambda v: pd.Series([x.ravel() for x in probed_codes(stacked(v), planes, probes)] if len(v) else [], dtype=object), "array<long>")
    q = queries.where(FINE.format("vec", dims)).where(FINE.format(exact or "vec", dims)).withColumn("_probed", probed("vec"))
    q = q.select("query_id", *on, *([F.col(own).alias("_own")] if own else []), F.col(exact or "vec").alias("vec"), "_probed")
    keys, each_probe = [*on, "_table", "_code"], F.size("_probed") / tables
    q = stored(q).select("*", F.posexplode("_probed").alias("_table", "_code")).withColumn("_table", F.floor(F.col("_table") / each_probe).cast("int"))
    p = index.points.select("*", F.posexplode("codes").alias("_table", "_code"))
    sizes = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    buckets = sizes(q, "_qs").join(sizes(p, "_ps"), keys).withColumn("_bucket", F.monotonically_increasing_id())  # a row a bucket
    buckets = stored(buckets.select(*keys, "_bucket", *[F.ceil(F.col(c) / block_rows).alias(c) for c in ("_qs", "_ps")], F.col("_qs").alias("_n_q"), F.col("_ps").alias("_n_p")))
    met = buckets.agg(F.sum(F.greatest(F.col("_n_p") * F.col("_qs"), F.col("_n_q") * F.col("_ps")))).first()[0]
    bins, block = -(-(met or 1) // block_rows), ["_bucket", "_p", "_q"]
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    bin = F.pmod(F.xxhash64(*block), F.lit(bins)).alias("_bin")
    q = q.join(buckets, keys).withColumn("_q", part("query_id", "_qs")).withColumn("_p", every("_ps"))
    q = q.select("query_id", *(["_own"] if own else []), "vec", "_probed", "_table", F.col("_bucket").alias("_bucket"), "_p", "_q", bin)  # named anew, as both sides have it from one table
    p = p.join(buckets, keys).withColumn("_p", part("point_id", "_ps")).withColumn("_q", every("_qs")).select(*payload, "vec", "codes", *block, bin)
    schema = T.StructType([queries.schema["query_id"], *[index.points.schema[c] for c in payload], *([T.StructField("_own", queries.schema[own].dataType)] if own else []), T.StructField("score", T.DoubleType()), T.StructField("compared", T.LongType())])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=schema.names)
        right = right.sort_values("point_id", kind="stable")
        a, b, codes = stacked(left["vec"]), stacked(right["vec"]), np.stack(right["codes"].to_list())
        looked = np.stack(left["_probed"].to_list()).reshape(len(left), tables, -1)
        query_ids, ids, table, named = left["query_id"].to_numpy(), right["point_id"].to_numpy(), left["_table"].to_numpy(), left["_own"].to_numpy() if own else None
        points_of, out = right.groupby(block).indices, [(np.zeros(0, int),) * 4]
        for key, w in left.groupby(block).indices.items():
            for x in (w[i : i + SLICE] for i in range(0, len(w), SLICE) if key in points_of):
                y = points_of[key]
                score = scores(a[x], b[y], "cosine")
                for t in range(table[x[0]]):  # a pair is scored in the first table where it meets
                    for code in looked[x, t].T:
                        score[code[:, None] == codes[y, t]] = -np.inf
                row, top, *rest = best_of(score, query_ids[x], ids[y], named[x] if own else None, k, digits)
                out.append((x[row], y[top], *rest))
        row, top, score, compared = map(np.concatenate, zip(*out))
        found = right[payload].iloc[top].assign(query_id=query_ids[row], score=score, compared=compared)
        return (found.assign(_own=named[row]) if own else found)[schema.names]

    found = q.groupBy("_bin").cogroup(p.groupBy("_bin")).applyInPandas(best, schema).withColumn("score", rounded("score", digits))
    each = Window.partitionBy("query_id")
    near = found.withColumn("rank", F.row_number().over(each.orderBy(F.desc("score"), *own_first(own), "point_id"))).withColumn("compared", F.sum("compared").over(each)).where(F.col("rank") <= k)
    if least is None:
        return near.drop("_own")
    near = stored(near)
    named = F.bool_or(F.col("_own").isNull() | (F.col("_own") == F.col("point_id"))) if own else F.lit(True)
    whole = near.groupBy("query_id").agg(F.count_if(F.col("score") >= least).alias("n"), named.alias("named")).where((F.col("n") >= k) & F.col("named"))
    near, again = near.drop("_own"), stored(queries.withColumn("vec", F.col(exact or "vec")).join(whole, "query_id", "left_anti"))
    if again.isEmpty():
        return near
    full = nearest(again, index.points.drop("codes"), k, on, digits=digits, own=own).withColumn("compared", F.lit(index.points.count()))
    return near.join(whole.select("query_id"), "query_id", "left_semi").select(*near.columns).unionByName(full.select(*near.columns))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: of how many exact neighbours (query_id, point_id), how many were found, and their share."""
    hit = exact.select("query_id", "point_id").join(found.select("query_id", "point_id", F.lit(1).alias("hit")), ["query_id", "point_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("found")).withColumn("recall", F.try_divide("found", "n"))


def with_fallback(found: DataFrame, queries: DataFrame, recent: DataFrame, k: int) -> DataFrame:
    """found (query_id, point_id, rank), and for queries that found nothing the k most recent of recent (point_id, at)."""
    last = recent.orderBy(F.desc("at"), F.desc("point_id")).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("at"), F.desc("point_id"))))
    bare = queries.select("query_id").join(found, "query_id", "left_anti").withColumn("one", F.lit(1))
    return found.select("query_id", "point_id", "rank").unionByName(bare.join(last.withColumn("one", F.lit(1)), "one").select("query_id", "point_id", "rank"))


def upserted(old: DataFrame, new: DataFrame, dims: int, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Points by id, where a new one replaces the old; and the new ones that are refused, which replace nothing.

    Refused are vectors that are null, hold nulls or have another number of dimensions.  Of a batch's points with one id the
    last by `order` stays, ties by their vector; a null order comes first.
    """
    fine = F.coalesce((F.size("vec") == dims) & F.forall("vec", lambda x: x.isNotNull()), F.lit(False))
    rest = [c for c in old.columns if c != "point_id"]
    last = new.where(fine).groupBy("point_id").agg(F.max_by(F.struct(*rest), F.struct(*([order] if order else []), "vec")).alias("x"))
    kept = old.join(new.where(fine).select("point_id"), "point_id", "left_anti")
    return kept.unionByName(last.select("point_id", *[F.col("x")[c].alias(c) for c in rest]).select(*old.columns)), new.where(~fine)


def admitted(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with text that is neither blank nor numeric in its first 24 characters and with a source; and the rest."""
    good = (F.trim("text") != "") & ~F.substring("text", 1, 24).rlike(r"^[-0-9.,eE \n]+$") & (F.coalesce("source", F.lit("")) != "")
    flagged = chunks.withColumn("good", F.coalesce(good, F.lit(False)))
    return flagged.where("good").drop("good"), flagged.where("not good").drop("good")
