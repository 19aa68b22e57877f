"""Language ID of code-switched text by a linear-chain conditional random field.

Words carry affix, character n-gram and lexicon features; transitions between the languages of neighbouring words are
learned with them.  Forward-backward gives each word's language probabilities, and a document has the language with the
largest share of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridag.llm.common import small_batches
from veridag.llm.words import code_points, grouped, hashes, mixed

DIMS = 1 << 15


def bare(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def hashed(kind: int, *codes: np.ndarray) -> np.ndarray:
    """Feature of a kind of n-gram or affix; 0 is that of nothing."""
    x = np.full(len(codes[0]), kind, np.uint64)
    for c in codes:
        x = x * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
    return (mixed(x) % np.uint64(DIMS - 1) + np.uint64(1)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, hashed feature) of words without their non-letters: each itself, its affixes of 1 to 3, its n-grams of 2 and 3."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    full = np.flatnonzero(size)
    codes, end = code_points("".join(words)), np.cumsum(size)[full]
    start, owner = end - size[full], np.repeat(np.arange(len(words)), size)
    out = [(full, (hashes(codes, start, end) % np.uint64(DIMS - 1) + np.uint64(1)).astype(np.int64))]
    padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
    for k in (1, 2, 3):
        long = start + k <= end  # a shorter word has itself as its affix, which is the one before
        for kind, at in ((k, start[long]), (3 + k, end[long] - k)):
            out.append((full[long], hashed(kind, *(padded[at + i] for i in range(k)))))
    for n in (2, 3):
        at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.empty(0, np.int64)
        out.append((owner[at], hashed(5 + n, *(padded[at + i] for i in range(n)))))
    return tuple(np.concatenate(x) for x in zip(*out))


def features_by_word(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """How many features each word has, and all of them, word by word."""
    sizes, parts = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for i in range(0, len(words), at_once):
        some = words[i : i + at_once]
        at, feats = features(some)
        sizes.append(np.bincount(at, minlength=len(some)))
        parts.append(feats[np.argsort(at, kind="stable")].astype(np.int32))
    return np.concatenate(sizes), np.concatenate(parts)


def chains(text: str) -> Iterator[list[str]]:
    """The words of each line, in full: a chain has any length."""
    return map(str.split, text.split("\n"))


def forward_backward(emit: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (chains, words, languages), from emission scores and log transitions; and the scaled forward and backward scores."""
    n, t, k = emit.shape
    e, a = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(trans)
    fore, back = np.empty_like(e), np.empty_like(e)
    fore[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        x = (fore[:, i - 1] @ a) * e[:, i]
        fore[:, i] = x / x.sum(axis=1, keepdims=True)
    back[:, t - 1] = 1.0
    for i in range(t - 2, -1, -1):
        back[:, i] = e[:, i + 1] = x = e[:, i + 1] * back[:, i + 1]
        x = x @ a.T
        back[:, i] = np.where((i + 1 < length)[:, None], x / x.sum(axis=1, keepdims=True), 1.0)
    marginal = fore * back
    marginal /= marginal.sum(axis=2, keepdims=True)
    return marginal, fore, e


def transitions(fore: np.ndarray, ahead: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected transitions, from forward scores and what lies ahead of each word (its emission and backward score)."""
    pair = fore[:, :-1, :, None] * np.exp(trans) * ahead[:, 1:, None, :]
    pair *= (np.arange(1, fore.shape[1]) < length[:, None])[:, :, None, None] / pair.sum(axis=(2, 3), keepdims=True)
    return pair.sum(axis=(0, 1))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (DIMS, languages); row 0 is zero
    trans: np.ndarray


def fit(lines: list[tuple[str, str]], steps: int = 160, batch: int = 192, words: int = 24, seed: int = 7) -> Model:
    """Gradient ascent (Adagrad) on the likelihood of chains that join pieces of one to three labelled lines."""
    langs = sorted({lang for lang, _ in lines})
    rng, k = np.random.default_rng(seed), len(langs)
    model = Model(langs, np.zeros((DIMS, k), np.float32), np.zeros((k, k), np.float32))
    known: dict[str, int] = {}
    pieces = [(langs.index(lang), np.array([known.setdefault(b, len(known)) for w in line.split() if (b := bare(w))], np.int64)) for lang, line in lines]
    size, feats = features_by_word(list(known))
    first = np.cumsum(size) - size
    by_lang = [[ws for j, ws in pieces if j == i and len(ws)] for i in range(k)]
    by_lang = [(i, own) for i, own in enumerate(by_lang) if own]
    if k < 2 or len(by_lang) < 2:
        return model
    g_w, g_t = np.full((DIMS, k), 1e-2, np.float32), np.full((k, k), 1e-2, np.float32)
    for _ in range(steps):
        chosen, gold, length = [], np.zeros((batch, words), int), np.zeros(batch, int)
        for i in range(batch):
            n = 0
            for _ in range(1 if rng.random() < 0.6 else rng.integers(2, 4)):
                lang, own = by_lang[rng.integers(len(by_lang))]
                ws = own[rng.integers(len(own))]
                at = rng.integers(max(1, len(ws) - 7))
                ws = ws[at : at + rng.integers(4, words)][: words - n]
                gold[i, n : n + len(ws)] = lang
                chosen.append(ws)
                n += len(ws)
            length[i] = n
        drawn = np.concatenate(chosen)
        sizes = size[drawn]
        at = np.cumsum(sizes) - sizes
        flat = feats[np.repeat(first[drawn] - at, sizes) + np.arange(sizes.sum())]
        mask = np.arange(words) < length[:, None]
        emit = np.zeros((batch, words, k), np.float32)
        emit[mask] = np.add.reduceat(model.weights[flat], at, axis=0)
        marginal, fore, ahead = forward_backward(emit, length, model.trans)
        pairs = transitions(fore, ahead, length, model.trans)
        grad = (np.eye(k, dtype=np.float32)[gold] - marginal)[mask]
        spread = np.repeat(grad, sizes, axis=0)
        step = np.stack([np.bincount(flat, spread[:, j], DIMS) for j in range(k)], axis=1) / batch
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1.0)
        turn = (seen - pairs) / batch
        g_w += step**2
        g_t += turn**2
        model.weights += 0.3 * step / np.sqrt(g_w)
        model.trans += 0.1 * turn / np.sqrt(g_t)
    model.weights[0] = 0.0
    return model


def shares(model: Model, texts: list[str]) -> np.ndarray:
    """For each text, the sum of its words' probabilities of each language; all 0 without a letter."""
    known: dict[str, int] = {}
    flat, length, owner = [], [], []
    for i, text in enumerate(texts):
        for chain in chains(text):
            flat += [known.setdefault(w, len(known)) for w in chain]
            length.append(len(chain))
            owner.append(i)
    out = np.zeros((len(texts), len(model.langs)))
    if not known:
        return out
    words = list(map(bare, known))
    at, feats = features(words)
    table = np.stack([np.bincount(at, model.weights[feats, k], len(words)) for k in range(len(model.langs))], axis=1)
    lettered = np.fromiter(map(bool, words), bool, len(words))
    flat, length, owner = np.array(flat), np.array(length), np.array(owner)
    start = np.cumsum(length) - length
    for bits in range(1, int(length.max()).bit_length() + 1):  # chains of like length together
        part = np.flatnonzero((length >> (bits - 1)) == 1)
        if len(part):
            n, t = length[part], np.arange(int(length[part].max()))
            mask = t < n[:, None]
            ids = flat[np.minimum(start[part][:, None] + t, len(flat) - 1)]
            marginal, *_ = forward_backward(table[ids], n, model.trans)
            counts = mask & lettered[ids]
            for k in range(len(model.langs)):
                out[:, k] += np.bincount(owner[part], (marginal[:, :, k] * counts).sum(axis=1), len(texts))
    return out


def held_out(id_col: str) -> F.Column:
    """Whether a row is kept from training: crc32 of the id as text is divisible by 5, or there is no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1200, lines_per_doc: int = 6, line_chars: int = 1000) -> Model:
    """Fits on a bounded sample: about docs_per_lang labelled documents a language, lines_per_doc lines of each, drawn by
    hash, and the first line_chars characters of a line.

    Rows without text, label or id, and those held out, are not drawn.  A document that repeats is drawn as often.  With
    fewer than two languages, or in an empty table, nothing is learned, and one language or none is ever predicted.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.join(F.broadcast(counts), "lang").where(draw * F.col("n") < docs_per_lang)  # a row a language
    lines = F.transform(F.split("text", "\n"), lambda s: F.struct(F.xxhash64(s).alias("h"), F.substring(s, 1, line_chars).alias("line")))
    rows = drawn.select("lang", F.explode(F.slice(F.array_sort(lines), 1, lines_per_doc)).alias("s")).select("lang", "s.line").collect()
    return fit(sorted((r["lang"], r["line"]) for r in rows))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the share of its words' probability that language has.

    lang_pred is "und" with score 0 if the text is null or has no letter, or if the model knows no language; ties go to the
    language first in order.  Input columns of these names give way; others pass through.  Every word of a text counts, and
    all of its letters; rows that repeat an id are predicted each from its own text.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop("lang_pred", "score")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = rows.columns.index(next(c for c in rows.columns if c.lower() == text_col.lower()))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            share = np.concatenate([shares(model, texts[part]) for part in grouped(texts)]) if model.langs and texts else np.zeros((len(texts), 1))
            total = share.sum(axis=1)
            best = share.argmax(axis=1)
            names = [model.langs[k] if s > 0 else "und" for k, s in zip(best, total)]
            score = np.minimum(1.0, share[np.arange(len(best)), best] / np.where(total > 0, total, 1.0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
