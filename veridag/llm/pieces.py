"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice of pieces.  Forward Viterbi gives the best score from the start to every position, which is the exact
heuristic of an A* search backward from the end: paths leave its queue in order of their score, the first without any
detour, so that it is read off directly.  No piece spans certain boundaries (which is checked against the vocabulary), so
a text's lattice is a chain of small ones: the forward scores of all chains of a batch are computed at once, and the n
best paths of a text combine those of the chains where a second path loses least.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridag.llm.common import held, small_batches
from veridag.llm.words import code_points, grouped

SPACE = "▁"
#: Stands for a SPACE character of the text itself, which must not become a space; no text holds it.
LITERAL = "\ud800"
LETTER = "A-Za-zÀ-ɏͰ-῿"
#: Ways to cut a text into chains, finest first; the first that cuts no piece is taken.
CUTS = (f"{SPACE}*(?:[{LETTER}]+|[^{SPACE}{LETTER}]+)|{SPACE}+", f"{SPACE}*[^{SPACE}]+|{SPACE}+", "(?s:.+)")
LOW = float("-inf")


class Table:
    """A map from integers below 2**63 to integers, as arrays: lookups of many keys at once; -1 for an unknown key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot = self.slots(keys)
        left = np.arange(len(keys))
        while len(left):  # of the keys that want an empty slot, the first gets it, the others try the next
            free = self.keys[slot[left]] < 0
            _, at = np.unique(slot[left][free], return_index=True)
            won = left[free][at]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = left[~np.isin(left, won)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], -1)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[left]]
            out[left] = np.where(seen == keys[left], self.values[slot[left]], -1)
            left = left[(seen != keys[left]) & (seen >= 0)]
        return out


class Numbers(dict):
    """Numbers of things in order of their first lookup."""

    def __missing__(self, x: str) -> int:
        k = self[x] = len(self)
        return k


class Arcs:
    """The arcs of some chains, sorted by how far from its chain's start an arc ends, then by that end, then by start.

    Places are numbered over all chains, one more a chain than it has characters.
    """

    def __init__(self, lattice: Lattice, chains: list[str]):
        self.size = np.fromiter(map(len, chains), np.int64, len(chains))
        self.first = np.cumsum(self.size + 1) - self.size - 1  # place where each chain starts
        codes, ends = code_points("".join(chains)).astype(np.int64), np.repeat(np.cumsum(self.size), self.size)
        alive, node, found, n = np.arange(len(codes)), np.zeros(len(codes), np.int64), [], 0
        while len(alive):
            near = alive + n < ends[alive]
            alive, node = alive[near], node[near]
            child = lattice.trie.get(node << 21 | codes[alive + n])
            piece = np.where(child >= 0, lattice.piece_at[child], -1)
            n += 1
            if n == 1:  # a character without a piece has an arc below 0
                piece = np.where(piece >= 0, piece, -1 - codes)
                found.append((alive, np.full(len(alive), n), piece))
            else:
                own = piece >= 0
                found.append((alive[own], np.full(own.sum(), n), piece[own]))
            alive, node = alive[child >= 0], child[child >= 0]
        at, length, piece = (np.concatenate(x) if found else np.empty(0, np.int64) for x in zip(*found[::-1])) if found else (np.empty(0, np.int64),) * 3
        chain = np.repeat(np.arange(len(chains)), self.size)[at]
        start = at + chain
        far = start + length - self.first[chain]
        order = np.argsort((far * (len(codes) + len(chains)) + start + length << 16) - length)
        self.start, self.end, self.far, self.chain = start[order], (start + length)[order], far[order], chain[order]
        self.piece = piece[order]
        self.score = np.where(self.piece >= 0, lattice.score[np.maximum(self.piece, 0)], lattice.worst)

    def forward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best and second best score of every place, and the arc by which the best comes; of equal ones, the longest."""
        places = int((self.size + 1).sum())
        best, second, back = np.full(places, LOW), np.full(places, LOW), np.full(places, -1)
        best[self.first] = 0.0
        bounds = np.searchsorted(self.far, np.arange(1, int(self.far[-1]) + 2 if len(self.far) else 1))
        for low, high in zip(bounds, bounds[1:]):
            a = slice(low, high)
            start, end = self.start[a], self.end[a]
            v, w = best[start] + self.score[a], second[start] + self.score[a]
            head = np.flatnonzero(np.diff(end, prepend=-1))
            top = np.maximum.reduceat(v, head)
            which = np.minimum.reduceat(np.where(v == np.repeat(top, np.diff(head, append=len(v))), np.arange(len(v)), len(v)), head)
            v[which] = w[which]
            best[end[head]], second[end[head]], back[end[head]] = top, np.maximum.reduceat(v, head), which + low
        return best, second, back

    def n_best(self, chains: list[int], forward: np.ndarray, n: int) -> Iterator[tuple[int, list[tuple[float, list[int]]]]]:
        """The n best paths of each of the chains, best first, as (score, pieces): backward A* under the forward scores."""
        into: dict[int, list] = {}
        near = np.flatnonzero(np.isin(self.chain, chains))
        for i, j, score, piece in zip(self.start[near].tolist(), self.end[near].tolist(), self.score[near].tolist(), self.piece[near].tolist()):
            into.setdefault(j, []).append((i, score, piece))
        for chain in chains:
            first = int(self.first[chain])
            end = first + int(self.size[chain])
            out, queue, k = [], [(-forward[end], 0, end, 0.0, None)], 0
            while queue and len(out) < n:
                _, _, j, tail, path = heapq.heappop(queue)
                if j == first:
                    pieces = []
                    while path:
                        pieces.append(path[0])
                        path = path[1]
                    out.append((tail, pieces))
                    continue
                for i, score, piece in into[j]:
                    k += 1
                    heapq.heappush(queue, (-(forward[i] + score + tail), k, i, score + tail, (piece, path)))
            yield chain, out


class Lattice:
    """A model's vocabulary as arrays, and the search for the n best segmentations of texts."""

    def __init__(self, model: bytes, n: int):
        self.n, sp = n, sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        plain = {sp.id_to_piece(i): i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.score = np.array([sp.get_score(i) for i in ids])
        self.worst = float(self.score[list(plain.values())].min()) - 10.0
        if max(map(len, plain)) >= 1 << 16:
            raise ValueError("a piece is too long")
        nodes = {p[:k]: 0 for p in plain for k in range(1, len(p) + 1)}
        for k, head in enumerate(sorted(nodes, key=len), 1):
            nodes[head] = k
        self.piece_at = np.full(len(nodes) + 1, -1, np.int64)
        self.piece_at[[nodes[p] for p in plain]] = list(plain.values())
        keys = np.array([nodes.get(x[:-1], 0) << 21 | ord(x[-1]) for x in nodes], np.int64)
        self.trie = Table(keys, np.array(list(nodes.values()), np.int64))
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.cut = next(c for c in map(re.compile, CUTS) if all(len(c.findall(p)) == 1 for p in plain))

    def of_char(self, code: int) -> list[int]:
        char = SPACE if chr(code) == LITERAL else chr(code)
        return [self.bytes.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")]

    def spelled(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, where a character without one becomes its bytes, and how many ids each piece has."""
        size, odd = np.ones(len(piece), np.int64), np.flatnonzero(piece < 0)
        if len(odd):
            spelt = [self.of_char(-1 - c) for c in piece[odd].tolist()]
            size[odd] = list(map(len, spelt))
            out = np.repeat(piece, size)
            out[np.repeat(piece < 0, size)] = [i for x in spelt for i in x]
            return out, size
        return piece, size

    def read_off(self, arcs: Arcs, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chain's best path, all in one array, and how many each has."""
        at, own, steps = arcs.first + arcs.size, np.arange(len(arcs.size)), []
        own = own[at != arcs.first]
        while len(own):
            arc = back[at[own]]
            steps.append((own, arcs.piece[arc]))
            at[own] = arcs.start[arc]
            own = own[at[own] != arcs.first[own]]
        chain, piece = (np.concatenate(x) for x in zip(*steps[::-1]))
        order = np.argsort(chain, kind="stable")  # the last step is the first piece
        ids, size = self.spelled(piece[order])
        return ids, np.bincount(chain[order], size, len(arcs.size)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[list[tuple[int, list[int]]]]]]:
        """Ids of all texts' best paths, and how many each has; scores of the n best; and what each of these changes."""
        known = Numbers()
        parts = [self.cut.findall(SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE)) if t else [] for t in texts]
        numbered = [np.fromiter(map(known.__getitem__, p), np.int64, len(p)) for p in parts]
        scores: list = [[] for _ in texts]
        changes: list = [[] for _ in texts]
        if not known:
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64), scores, changes
        arcs = Arcs(self, list(known))
        best, second, back = arcs.forward()
        end = arcs.first + arcs.size
        (ids, size), score, loss = self.read_off(arcs, back), best[end], best[end] - second[end]

        start, flat = np.cumsum(size) - size, np.concatenate(numbered)
        n = size[flat]
        out = ids[np.repeat(start[flat] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        count = np.array([size[own].sum() for own in numbered], np.int64)
        rivals = [[k for k in sorted(self.least(loss[own]).tolist()) if loss[own[k]] < float("inf")] if len(own) else [] for own in numbered]
        wanted = sorted({int(own[k]) for own, ks in zip(numbered, rivals) for k in ks})
        after = {c: [(paths[0][0] - x, self.spelled(np.array(pieces))[0].tolist()) for x, pieces in paths[1:]] for c, paths in arcs.n_best(wanted, best, self.n)}
        for i, (own, ks) in enumerate(zip(numbered, rivals)):
            if len(own):
                found, total = self.combine([(k, after[int(own[k])]) for k in ks]), float(score[own].sum())
                scores[i], changes[i] = [total - x for x, _ in found], [c for _, c in found]
        return out, count, scores, changes

    def least(self, loss: np.ndarray) -> np.ndarray:
        """Positions of the n - 1 least losses; of equal ones, the first."""
        if self.n < 2:
            return np.empty(0, int)
        k = min(self.n - 1, len(loss)) - 1
        near = np.flatnonzero(loss <= np.partition(loss, k)[k])
        return near[np.argsort(loss[near], kind="stable")[: self.n - 1]]

    def combine(self, rivals: list) -> list[tuple[float, list[tuple[int, list[int]]]]]:
        """The n ways of least loss to change chains, given the n - 1 chains whose first change loses least.

        Any other chain's change loses more than n - 1 single changes and none at all, so it's in none of the n best.
        """
        paths: list = [(0.0, [])]
        for k, others in rivals:
            more = paths + [(loss + own, [*c, (k, ids)]) for loss, c in paths for own, ids in others]
            paths = heapq.nsmallest(self.n, more, key=lambda p: p[0])
        return paths


def lattice(model: bytes, n: int) -> Lattice:
    return held("pieces", (hash(model), n), lambda: Lattice(model, n))


def read_model(path: str | None = None) -> bytes:
    """The model file's bytes, which tasks get by closure; by default that of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


CODED = "ids array<int>, scores array<double>, alternatives array<array<struct<chain:int,ids:array<int>>>>"


def encode_pieces(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", n_best: int = 3) -> DataFrame:
    """A row per row of docs: id, ids of the best path, n_pieces, scores of the n_best paths, best first, and
    alternatives, what each of them changes in the best: arrays of (chain, ids).

    Scores add those of the pieces; a character without a piece is its bytes, at 10 below the worst piece.  Null or empty
    text has no ids and no scores.  A text with fewer paths has fewer scores.  Ties of score fall by the search's order,
    alike at every run.  Whole texts are encoded; rows that repeat an id are encoded each by itself; other columns are not
    carried; an empty table gives an empty table.  A task holds no more than the chains of about a million characters, or
    of one longer text.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = T.StructType.fromDDL(CODED)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = lattice(model, n_best)
        paths = pa.list_(pa.list_(pa.struct([("chain", pa.int32()), ("ids", pa.list_(pa.int32()))])))
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in grouped(texts):
                ids, count, scores, changes = own.encode(texts[part])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32()))
                rows = [[[{"chain": k, "ids": x} for k, x in c] for c in one] for one in changes]
                columns = [b.column(0)[part], lists, pa.array(scores, pa.list_(pa.float64())), pa.array(rows, paths)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "scores", "alternatives"])

    coded = read.mapInArrow(run, T.StructType([read.schema["id"], *kinds.fields]))
    return coded.select(F.col("id").alias(id_col), "ids", F.size("ids").alias("n_pieces"), "scores", "alternatives")


def spellings(model: bytes) -> str:
    """The bytes of every piece in hexadecimal, by id and parted by blanks."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return " ".join(sp.id_to_piece(i)[3:5] if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode().hex() for i in range(sp.get_piece_size()))


def decode_pieces(rows: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col, the text of ids_col; null where that is null.  An input column of that name gives way.

    Pieces are looked up in a constant array.  Bytes that are no UTF-8 become U+FFFD; an id outside the vocabulary is an
    error.  No ids give an empty text.
    """
    table = F.split(F.lit(spellings(model)), " ")
    piece = lambda i: F.coalesce(F.get(table, i), F.raise_error(F.lit("an id is not in the vocabulary")))
    whole = F.make_valid_utf8(F.unhex(F.array_join(F.transform(F.col(ids_col), piece), "")).cast("string"))
    return rows.withColumn(out_col, F.substring(whole, 2, (1 << 31) - 1))
