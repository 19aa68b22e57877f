"""Benchmark decontamination by latent semantic retrieval.

TF-IDF passages of all documents are factorised by a distributed randomised SVD; benchmark items are queries in the latent
space.  Passages near an item by cosine are verified by their longest common subsequence of words, and those that only
paraphrase it by whether they also hold its answer, the item's last words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridag.llm.common import forget, small_batches, stored
from veridag.llm.words import code_points, grouped, hashes, per_text, runs

#: Words in a chunk; passages are 2, 4, 8 or, for long items, further doublings of chunks long and begin at every chunk.
CHUNK = 16


def scale_of(size: int) -> int:
    """Chunks of the passages in which an item of `size` words is sought: they hold it from whichever chunk it starts in."""
    scale = 2
    while scale * CHUNK < size + CHUNK // 2:
        scale *= 2
    return scale


@cache
def word_characters() -> np.ndarray:
    """Whether each code point is a letter, a digit or an underscore."""
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and how many each text has."""
    low = [f"{t or ''}\n".lower() for t in texts]
    codes = code_points("".join(low))
    start, end = runs(word_characters()[codes])
    return hashes(codes, start, end), per_text(start, np.cumsum(np.fromiter(map(len, low), np.int64, len(low))))


@dataclass
class Chunks:
    """The words of a batch that the benchmark has too, as (chunk, term, count), and where each document's chunks are.

    Terms beyond n_terms share the weights of others, so that what is held of them is bounded.
    """

    first: np.ndarray  # first chunk of each document, and the end
    row: np.ndarray
    term: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray], n_terms: int) -> Chunks:
        """docs: a term for each word, -1 for a word that the benchmark doesn't have."""
        lengths = np.array([len(d) for d in docs], np.int64)
        first = np.concatenate([[0], np.cumsum(-(-lengths // CHUNK))])
        term = np.concatenate([*docs, np.empty(0, np.int32)]).astype(np.int64)
        at = np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        keep = term >= 0
        key, count = np.unique((np.repeat(first[:-1], lengths) + at // CHUNK)[keep] * n_terms + term[keep] % n_terms, return_counts=True)
        return cls(first, key // n_terms, key % n_terms, count)

    def weighted(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, term, weight) with the weights above 0."""
        keep = idf[self.term] > 0
        row, term = self.row[keep], self.term[keep]
        return row, term, ((1 + np.log(self.count[keep])) * idf[term]).astype(np.float32)


def coded(found: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """The place of each word in the sorted vocabulary, -1 if it isn't there."""
    at = np.minimum(np.searchsorted(vocab, found), len(vocab) - 1)
    return np.where(vocab[at] == found, at, -1).astype(np.int32)


def sums_by_row(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values whose row is equal; row is sorted."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(row):
        at = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[at]] = np.add.reduceat(values, at, axis=0)
    return out


def encoded(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """(id, terms): the only pass over the texts; the others read what it stores."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).to_pylist()
            for part in grouped(texts):
                found, count = words_of(texts[part])
                terms = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(coded(found, vocab)))
                yield pa.RecordBatch.from_arrays([b.column(0)[part], terms], names=["id", "terms"])

    return stored(docs.mapInArrow(run, T.StructType([docs.schema["id"], T.StructField("terms", T.ArrayType(T.IntegerType()))])))


def document_frequency(docs: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """Chunks with each term, and all chunks, over all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(n_terms, np.int64), 0
        for b in batches:
            c = Chunks.of(b["terms"].tolist(), n_terms)
            df += np.bincount(c.term, minlength=n_terms)
            n += int(c.first[-1])
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(at, -1), "n": np.append(df[at], n)})

    found = docs.select("terms").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_terms + 1, np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()  # -1, all chunks, is the last
    return out[:-1], int(out[-1])


def partial_range(c: Chunks, idf: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A'A start over the TF-IDF passages A of these chunks, each of length 1."""
    row, term, w = c.weighted(idf)
    if not len(row):
        return np.zeros(start.shape)
    w /= np.sqrt(np.maximum(np.bincount(row, w.astype(float) ** 2), 1e-12)).astype(np.float32)[row]
    y = sums_by_row(row, start[term] * w[:, None], int(row[-1]) + 1)
    order = np.argsort(term, kind="stable")
    return sums_by_row(term[order], y[row[order]] * w[order][:, None], len(idf))


def range_of(docs: DataFrame, idf: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A'A start over the passages of all documents: a partial sum a task, added up by Spark a term a row."""
    rank = start.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(start.shape)
        for b in batches:
            total += partial_range(Chunks.of(b["terms"].tolist(), len(idf)), idf, start)
        at = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame(total[at], columns=[f"z{i}" for i in range(rank)]).assign(term=at)

    columns = [f"z{i}" for i in range(rank)]
    parts = docs.select("terms").mapInPandas(run, ", ".join(f"{c} double" for c in columns) + ", term long")
    found = parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    out = np.zeros(start.shape)
    out[found["term"].to_numpy()] = found[columns].to_numpy()
    return out


def common_length(masks: dict[int, int], size: int, terms: list[int]) -> int:
    """Length of the longest common subsequence of an item of `size` words, given by the positions of each term, and terms."""
    full = (1 << size) - 1
    v = full
    for t in terms:
        if m := masks.get(t):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def positions(terms: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, t in enumerate(terms):
        out[t] = out.get(t, 0) | 1 << i
    return out


@dataclass
class Retriever:
    ids: list[int]
    items: list[list[int]]
    idf: np.ndarray
    basis: np.ndarray  # (terms, rank), float32
    min_cosine: float
    min_lcs: float
    min_paraphrase: float
    min_answer: float

    def __post_init__(self) -> None:
        c = Chunks.of([np.array(x) for x in self.items], len(self.idf))
        whole = np.add.reduceat(self.latent(c), c.first[:-1], axis=0)
        self.queries = whole / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)
        self.masks = [positions(x) for x in self.items]
        self.answers = [x[-max(3, len(x) // 8) :] for x in self.items]
        self.answer_masks = [positions(x) for x in self.answers]
        self.scale = np.array([scale_of(len(x)) for x in self.items])

    def latent(self, c: Chunks) -> np.ndarray:
        row, term, w = c.weighted(self.idf)
        return sums_by_row(row, self.basis[term] * w[:, None], int(c.first[-1]))

    def search(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, bool]]:
        """(document, item, cosine, LCS share, whether the answer is there) of the leaks."""
        c = Chunks.of(docs, len(self.idf))
        z = self.latent(c)
        n, sums = len(z), np.concatenate([np.zeros((1, z.shape[1]), np.float32), np.cumsum(z, axis=0, dtype=np.float64)])
        doc = np.repeat(np.arange(len(docs)), np.diff(c.first))
        for s in np.unique(self.scale).tolist() if n else ():
            own = np.flatnonzero(self.scale == s)
            begin = np.arange(n)
            end = np.minimum(begin + s, c.first[doc + 1])
            x = (sums[end] - sums[begin]).astype(np.float32)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            best: dict[tuple[int, int], tuple[float, float, bool]] = {}
            for row, col in zip(*np.nonzero(x @ self.queries[own].T >= self.min_cosine)):
                d, k = int(doc[row]), int(own[col])
                at = (int(row) - int(c.first[d])) * CHUNK
                near = docs[d][max(0, at - CHUNK) : at + (s + 1) * CHUNK].tolist()
                share = common_length(self.masks[k], len(self.items[k]), near) / len(self.items[k])
                if share < self.min_paraphrase:
                    continue
                answer = common_length(self.answer_masks[k], len(self.answers[k]), near) >= self.min_answer * len(self.answers[k])
                if share >= self.min_lcs or answer:
                    hit = (share, float(x[row] @ self.queries[k]), answer)
                    best[d, k] = max(best.get((d, k), hit), hit)
            for (d, k), (share, cosine, answer) in best.items():
                yield d, k, cosine, share, answer


def told_by(df: np.ndarray, items: list[np.ndarray]) -> np.ndarray:
    """The terms among the rarer half of any item's: kept whatever their counts are, as copies of an item make its own frequent."""
    keep = np.zeros(len(df), bool)
    for terms in items:
        own = np.unique(terms % len(df))
        keep[own[df[own] <= np.median(df[own])]] = True
    return keep


def weights(df: np.ndarray, n: int, told: np.ndarray, common_share: float) -> np.ndarray:
    """Smoothed idf of the terms that tell an item, at the weight of common_share of all chunks at least, and of the others
    in at most common_share of them.  A term without weight is one that every item can spare."""
    return np.where(told | (df <= common_share * n), np.maximum(np.log((1 + n) / (1 + df)), -math.log(common_share)), 0.0)


def items_in_blocks(benchmark: DataFrame, at_once: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and word hashes of the items with words, in blocks of about at_once."""
    usable = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    blocks = max(1, math.ceil(usable.count() / at_once))
    for k in range(blocks):
        rows = sorted(usable.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect())  # about at_once rows
        found, count = words_of([r["text"] for r in rows])
        parts = np.split(found, np.cumsum(count)[:-1]) if rows else []
        kept = [(r["item_id"], p) for r, p in zip(rows, parts) if len(p)]
        yield [i for i, _ in kept], [p for _, p in kept]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: int = 64, common_share: float = 0.02, min_cosine: float = 0.6, min_lcs: float = 0.7,
               min_paraphrase: float = 0.55, min_answer: float = 1.0, items_at_once: int = 4096, most_terms: int = 1 << 18) -> DataFrame:
    """(id, item_id, cosine, lcs, answer) of each document and benchmark item (item_id, text) that it holds or paraphrases.

    A leak has cosine at least min_cosine in the latent space and shares at least min_lcs of the item's words in order, or
    at least min_paraphrase of them and min_answer of its answer, its last words.  Words are lower-cased runs of letters,
    digits and underscores, compared by 64-bit hashes.  Weights and basis are fitted once for all items; items are then
    queries in blocks of items_at_once, each a pass over the coded documents, so what is sent to tasks is bounded: by a
    block, by the benchmark's vocabulary (12 bytes a word) and by most_terms weights.  Null or empty texts and items leak
    nothing.  Rows count by themselves: equal rows give equal rows.  Further columns are ignored; an empty table on either
    side gives an empty table.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), *T.StructType.fromDDL("item_id long, cosine double, lcs double, answer boolean").fields])
    vocab = np.empty(0, np.uint64)
    for _, items in items_in_blocks(benchmark, items_at_once):
        vocab = np.unique(np.concatenate([vocab, *items]))
    if not len(vocab):
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    terms, n_terms = encoded(read, vocab), min(len(vocab), most_terms)
    df, n = document_frequency(terms, n_terms)
    told = np.zeros(n_terms, bool)
    for _, items in items_in_blocks(benchmark, items_at_once):
        told |= told_by(df, [coded(x, vocab) for x in items])
    idf = weights(df, n, told, common_share)
    start = np.random.default_rng(11).standard_normal((n_terms, min(rank, n_terms))).astype(np.float32)
    ours = np.zeros(start.shape)  # A'A start over the items' own chunks
    for _, items in items_in_blocks(benchmark, items_at_once):
        ours += partial_range(Chunks.of([coded(x, vocab) for x in items], n_terms), idf, start)
    weigh = lambda m: m / max(1e-12, float(np.linalg.norm(m)))  # noqa: E731  documents and items count alike
    basis, _ = np.linalg.qr(weigh(range_of(terms, idf, start)) + weigh(ours))
    out = None
    for ids, items in items_in_blocks(benchmark, items_at_once):
        if ids:
            retriever = Retriever(ids, [coded(x, vocab).tolist() for x in items], idf, basis.astype(np.float32), min_cosine, min_lcs, min_paraphrase, min_answer)
            found = search_all(terms, retriever, schema)
            out = found if out is None else out.unionByName(found)
    out = stored(out)  # few rows, so that the coded documents can go
    forget(terms)
    return out.withColumnRenamed("id", id_col)


def search_all(terms: DataFrame, retriever: Retriever, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].tolist()
            rows = [(ids[d], retriever.ids[k], cosine, share, answer) for d, k, cosine, share, answer in retriever.search(b["terms"].tolist())]
            yield pd.DataFrame(rows, columns=["id", "item_id", "cosine", "lcs", "answer"])

    return terms.mapInPandas(run, schema)
