"""Embedding near-dedup by an inverted multi-index.

Two codebooks, one for each half of the vectors, form a grid of cells.  A query visits cells in order of the sum of its
two half distances (multi-sequence traversal) until the recall target, then the vectors there are verified by cosine.
How many cells that takes is measured on links planted at the threshold as well as on those that a sample has, so that a
table with few or no links is searched by the same way as one with many.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridag.llm.common import stored
from veridag.llm.components import components


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = half_distances(x, centres).argmin(axis=1)
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def half_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)


def traverse(da: np.ndarray, db: np.ndarray, visits: int) -> list[int]:
    """The first `visits` cells i * len(db) + j by da[i] + db[j], by the multi-sequence algorithm."""
    a, b = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    heap, pushed, out = [(da[a[0]] + db[b[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * len(db) + int(b[j]))
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(da) and v < len(db) and (u, v) not in pushed:
                pushed.add((u, v))
                heapq.heappush(heap, (da[a[u]] + db[b[v]], u, v))
    return out


class Grid:
    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.first, self.second = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)

    def cells(self, x: np.ndarray, visits: int) -> np.ndarray:
        da, db = half_distances(x[:, : self.half], self.first), half_distances(x[:, self.half :], self.second)
        return np.array([traverse(p, q, visits) for p, q in zip(da, db)], np.int64)


def rank_of(da: np.ndarray, db: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Cells that a query with these half distances visits before it has visited each of `cells`, itself included; ties count."""
    b = np.sort(db)
    sums = da[cells // len(db)] + db[cells % len(db)]
    sums = sums + 1e-12 * (1 + np.abs(sums))
    return np.array([np.searchsorted(b, x - da, "right").sum() for x in sums], np.int64)


def planted(x: np.ndarray, threshold: float, seed: int = 11) -> np.ndarray:
    """For each unit row a vector whose cosine with it is the threshold, in a random direction: the links hardest to find."""
    u = np.random.default_rng(seed).normal(size=x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(u, axis=1, keepdims=True)
    return threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * u / np.where(size > 0, size, 1)  # of one dimension there is no other direction


def measured_visits(reps: DataFrame, grid: Grid, sample: pd.DataFrame, threshold: float, target: float, query_rows: int, planted_rows: int = 1024) -> tuple[int, float, float]:
    """Cells to visit for a mean recall of at least target, and the recall of planted and of real links then.

    Links at the very threshold are planted beside planted_rows of the sample; and query_rows of it are compared by brute
    force with all rows.  Both kinds of links, if there are real ones, must be found.  A link is found from either end, so
    that few are lost of those that one end misses.
    """
    q = unit(sample["vec"].iloc[:planted_rows])
    da, db = half_distances(q[:, : grid.half], grid.first), half_distances(q[:, grid.half :], grid.second)
    there = grid.cells(unit(planted(q, threshold)), 1)
    curves = [(np.concatenate([rank_of(da[k], db[k], there[k]) for k in range(len(q))]), np.full(len(q), 1 / len(q)))]
    some = sample.iloc[:query_rows]
    found = linked_cells(reps, grid, q[: len(some)] if len(some) <= len(q) else unit(some["vec"]), some["label"].to_numpy(), some["id"].to_numpy(), threshold)
    if len(found):
        q = unit(some["vec"])
        da, db = half_distances(q[:, : grid.half], grid.first), half_distances(q[:, grid.half :], grid.second)
        own = [(rank_of(da[k], db[k], g["cell"].to_numpy()), g["n"].to_numpy() / g["n"].sum()) for k, g in found.groupby("query")]
        curves.append((np.concatenate([r for r, _ in own]), np.concatenate([m for _, m in own]) / len(own)))
    visits = 4
    for rank, share in curves:
        order = np.argsort(rank, kind="stable")
        at = min(int(np.searchsorted(np.cumsum(share[order]), target - 1e-9)), len(rank) - 1)
        visits = max(visits, int(rank[order][at]))
    visits = min(visits, len(grid.first) * len(grid.second))
    recall = [float(share[rank <= visits].sum()) for rank, share in curves]
    return visits, recall[0], recall[-1] if len(recall) > 1 else math.nan


def linked_cells(reps: DataFrame, grid: Grid, q: np.ndarray, labels: np.ndarray, ids: np.ndarray, threshold: float) -> pd.DataFrame:
    """(query, cell, n): in which cells the links of each query are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, own_labels, own_ids = unit(b["vec"]), b["label"].to_numpy(), b["id"].to_numpy()
            for s in range(0, len(q), 256):
                row, col = np.nonzero((q[s : s + 256] @ x.T >= threshold) & (labels[s : s + 256, None] == own_labels) & (ids[s : s + 256, None] != own_ids))
                if len(row):
                    some, at = np.unique(col, return_inverse=True)
                    yield pd.DataFrame({"query": row + s, "cell": grid.cells(x[some], 1)[:, 0][at]}).value_counts().rename("n").reset_index()

    return reps.mapInPandas(run, "query long, cell long, n long").groupBy("query", "cell").agg(F.sum("n").alias("n")).toPandas()


def block_links(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Counts and a spanning forest of the links between the probes and the members of one block of one cell.

    A link that both sides probe is counted for the prober alone, as the other finds it in its own probe.
    """
    p, m = group[group["probe"]], group[~group["probe"]]
    out = []
    if len(p) and len(m):
        pid, mid, pw, mw = p["id"].to_numpy(), m["id"].to_numpy(), p["mult"].to_numpy(), m["mult"].to_numpy()
        x, y, own, visits = unit(p["vec"]), unit(m["vec"]), p["own"].to_numpy(), np.array(m["visits"].tolist())
        near = (x @ y.T >= threshold) & (pid[:, None] != mid)
        row, col = np.nonzero(near)
        back = np.zeros(len(row), bool)
        for s in range(0, len(row), 1 << 18):
            back[s : s + (1 << 18)] = (visits[col[s : s + (1 << 18)]] == own[row[s : s + (1 << 18)]][:, None]).any(axis=1)
        n_p = np.bincount(row, mw[col], len(p)).astype(np.int64)
        n_m = np.bincount(col[~back], pw[row[~back]], len(m)).astype(np.int64)
        lp, lm = pid.copy(), mid.copy()
        while True:  # smallest id of each component of the block
            was = lp.sum() + lm.sum()
            np.minimum.at(lp, row, lm[col])
            np.minimum.at(lm, col, lp[row])
            if lp.sum() + lm.sum() == was:
                break
        both = pd.DataFrame({"id": np.concatenate([pid, mid]), "n": np.concatenate([n_p, n_m]), "root": np.concatenate([lp, lm])})
        out = both[(both["n"] > 0) | (both["root"] != both["id"])]
    return pd.DataFrame(out, columns=["id", "n", "root"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, target: float = 0.995,
                 sample_rows: int = 16_384, query_rows: int = 256, cell_rows: int = 32, block_rows: int = 1024) -> DataFrame:
    """A row per row of vectors: id, n_links, component_id, kept, visits, the cells that each query visited, and compared, the
    vectors that it was compared with there.

    Vectors link when their labels are equal and not null and their cosine in double precision is at least threshold.
    Null, empty or zero vectors, and those with null or non-finite components, link with nothing; so do rows without id,
    whose component_id and kept are null.  Only vectors of like length are compared.  Equal vectors are one class, whose
    members link with each other.  Codebooks are fitted on at most sample_rows vectors, for cells of about cell_rows vectors
    of one label, and the number of cells to visit is measured (see measured_visits) on links planted in the sample and on
    query_rows of it against all vectors; every vector is indexed.  Cells larger than block_rows are compared block by
    block.  All vectors of lengths but the commonest that have at most block_rows vectors are one cell a length and label.
    Rows that repeat an id share the links of each other's vectors.  Columns of other names are ignored, label and vector
    columns are named by the caller.  An empty table gives an empty table.
    """
    vec = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fine = (F.size("vec") > 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vec.alias("vec"))
    rows = rows.withColumn("fine", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)), F.lit(False)))
    rows = rows.withColumn("h1", F.xxhash64("vec", "label")).withColumn("h2", F.xxhash64(F.lit(9), "label", "vec"))
    reps = rows.where("fine").groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("mult"), F.any_value("vec").alias("vec"))
    reps = stored(reps.withColumn("dims", F.size("vec")))
    members = rows.select("id", "fine", "label", "h1", "h2").join(reps.select("label", "h1", "h2", F.col("id").alias("rep"), "mult"), ["label", "h1", "h2"], "left")
    members = stored(members.select("id", F.when(F.col("fine"), F.col("rep")).alias("rep"), F.when(F.col("fine"), F.col("mult")).alias("mult")))

    found = []
    visited = 0
    lengths = [(r["dims"], r["count"]) for r in reps.groupBy("dims").count().orderBy(F.desc("count"), "dims").collect()]  # one in practice
    few = [k for k, (_, n) in enumerate(lengths) if k and n <= block_rows]
    for dims, n in lengths[: few[0] if few else None]:
        one = reps.where(F.col("dims") == dims).select("id", F.col("label").cast("string").alias("label"), "mult", "vec")
        drawn = one.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample_rows).toPandas()
        beside = one.groupBy("label").count().agg(F.sum(F.col("count").cast("double") ** 2) / n).first()[0]  # of one label, for a vector on average
        grid = Grid(unit(drawn["vec"]), max(1, min(len(drawn) // 8, round(math.sqrt(beside / cell_rows)))))
        visits, _, _ = measured_visits(one, grid, drawn, threshold, target, query_rows)
        visited = max(visited, visits)
        found.append(linked_pairs(one, grid, visits, block_rows, threshold))
    if few:
        rest = reps.where(~F.col("dims").isin([dims for dims, _ in lengths[: few[0]]]))
        rest = rest.select("id", F.concat_ws(":", "dims", F.col("label").cast("string")).alias("label"), "mult", "vec")
        found.append(linked_pairs(rest, None, 1, block_rows, threshold))
        visited = max(visited, 1)
    counts = edges = compared = None
    for one, met in found:
        c = one.groupBy("id").agg(F.sum("n").alias("n"))
        e = one.where("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
        counts, edges, compared = (c, e, met) if counts is None else (counts.unionByName(c), edges.unionByName(e), compared.unionByName(met))

    if counts is None:
        return members.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"), F.lit(0).alias("visits"), F.lit(0).cast("long").alias("compared"))
    labels = components(edges)
    links = counts.groupBy("id").agg(F.sum("n").alias("n")).select(F.col("id").alias("rep"), "n")
    known = links.join(labels.select(F.col("id").alias("rep"), "comp"), "rep", "full")
    known = stored(known.join(compared.withColumnRenamed("id", "rep"), "rep", "full"))
    out = members.join(known, "rep", "left")
    comp = F.coalesce("comp", "rep", "id")
    return out.select(F.col("id").alias(id_col), (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("mult") - 1, F.lit(0))).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("id") == comp).alias("kept"), F.lit(visited).alias("visits"), F.coalesce("compared", F.lit(0)).cast("long").alias("compared"))


def linked_pairs(reps: DataFrame, grid: Grid | None, visits: int, block_rows: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links (id, n, root) block by block, and how many vectors each was compared with (id, compared)."""
    blocks, compared = block_pairs(reps, grid, visits, block_rows)
    links = blocks.groupBy("label", "cell", "part", "against").applyInPandas(lambda g: block_links(g, threshold), "id long, n long, root long")
    return stored(links), compared


def block_pairs(reps: DataFrame, grid: Grid | None, visits: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Members and probes of each cell, dealt into blocks of about block_rows so that each pair of blocks meets once.

    Without a grid all vectors of a label are one cell.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = grid.cells(unit(b["vec"]), visits) if grid else np.zeros((len(b), 1), np.int64)
            yield b.assign(own=cells[:, 0], visits=list(cells))

    placed = stored(reps.mapInPandas(run, "id long, label string, mult long, vec array<double>, own long, visits array<long>"))
    probes = placed.withColumn("cell", F.explode("visits")).withColumn("probe", F.lit(True))
    rows = placed.withColumn("cell", F.col("own")).withColumn("probe", F.lit(False)).unionByName(probes)
    sizes = placed.groupBy("label", F.col("own").alias("cell")).agg(F.count(F.lit(1)).alias("in_cell"))
    probed = placed.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(F.count(F.lit(1)).alias("at_cell"))
    sizes = stored(sizes.join(probed, ["label", "cell"]).select("label", "cell", "in_cell", F.ceil(F.col("in_cell") / block_rows).alias("parts"), F.ceil(F.col("at_cell") / block_rows).alias("sides")))
    met = placed.select("id", "label", F.explode("visits").alias("cell")).join(sizes, ["label", "cell"]).groupBy("id").agg((F.sum("in_cell") - 1).alias("compared"))
    dealt = rows.join(sizes.drop("in_cell"), ["label", "cell"])  # a cell without members ends here
    own = F.pmod(F.xxhash64("id"), F.when(F.col("probe"), F.col("sides")).otherwise(F.col("parts")))
    all_of = F.when(F.col("probe"), F.col("parts")).otherwise(F.col("sides"))
    dealt = dealt.withColumn("mine", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), all_of - 1)))
    return dealt.select("label", "cell", "probe", "id", "mult", "vec", "own", "visits", F.when(F.col("probe"), F.col("other")).otherwise(F.col("mine")).alias("part"), F.when(F.col("probe"), F.col("mine")).otherwise(F.col("other")).alias("against")), met
