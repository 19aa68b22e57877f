"""Main text of web pages, with host suffix arrays for boilerplate.

Every page takes one way: the array of its host says which token runs of all its blocks distinct pages share, and those
are boilerplate; an exact check of markup follows, which gives back what is in the article for sure and takes what is
beside it for sure.  The suffix array of a host's token streams is kept in Spark form: every suffix is keyed by the host
and its first `run` tokens, so that equal keys are the array's intervals of suffixes with that much in common, and counting
the distinct pages of an interval needs no host in one task: keys are dealt by their ranges.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridag.llm.common import small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|([^<]+|<)", re.S)
#: Elements whose content is no text of the page; those of RAW go on to the end of the page if they are never closed.
RAW = frozenset("script style textarea title iframe".split())
OPAQUE = RAW | frozenset("noscript template svg select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button dialog menu object audio video canvas head".split())
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Words of class, id or role that mark what isn't the article, and words that say nothing beside them.
SIDE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent notice notices newsletter subscribe share sharing social related recommended comment comments reply replies disqus popup modal overlay toolbar pagination pager login signup complementary contentinfo search skip".split())
NEUTRAL = frozenset("area bar block bottom box button buttons container content footer form inner item items left link links list main outer panel right section site slot thread top unit widget wrap wrapper".split())
MAIN = frozenset("article main post entry story content articlebody".split())
#: Words that mark what is never the article, whatever other words a name has.
NEVER = frozenset("comment comments reply replies disqus cookie cookies consent".split())
#: Parts of a text, whose id is made of what they say, and words of a class that say little of them.
PARTS, VAGUE = frozenset("h1 h2 h3 h4 h5 h6 p ul ol dl li dt dd blockquote pre figure table".split()), frozenset(["side"])

#: Kinds of blocks: the array's own, those of the article for sure, and those beside it for sure.
OPEN, GUARDED, BESIDE = range(3)
#: The stream of the article's blocks.
ARTICLE = 1
#: Bytes of html whose pages a task holds at once.
GROUP_BYTES = 1 << 24


@dataclass
class Block:
    level: int  # 3 in an article, 2 in main, 1 in an element named so, 0 elsewhere
    suspect: bool  # in an element whose name has a word of SIDE among others
    text: str
    beside: bool = False  # in a menu, form or the like


def marks(tag: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element is beside the article for sure, perhaps is, could hold it, and has the role main."""
    sure = perhaps = holds = main = never = plain = False
    for name, value in ATTRIBUTE.findall(attrs) if attrs.strip() else ():
        name, value = name.lower(), value.strip("\"'").lower()
        sure |= name == "hidden"
        if name in ("class", "id", "role") and not (name == "id" and tag in PARTS):
            main |= name == "role" and value == "main"
            for token in value.split():
                words = {w for w in re.split(r"[^a-z]+", token) if w}
                side = words & SIDE - VAGUE if tag in PARTS else words & SIDE
                if side:
                    sure, perhaps = sure or words <= SIDE | NEUTRAL, True
                never |= bool(words & NEVER)
                plain |= bool(words) and words <= MAIN  # as in class="post comments-open"
                holds |= bool(words & MAIN)
    return sure or (never and not plain), perhaps, holds, main


def blocks(page: str, beside: bool = False) -> list[Block]:
    """The page's text blocks, without those in scripts and the like, and in menus, forms and the like unless `beside`."""
    out: list[Block] = []
    text: list[str] = []
    other: list[str] = []  # text of what goes
    depth = {3: 0, 2: 0, 1: 0}
    opened: list[tuple[str, int, bool, bool]] = []  # elements that matter: tag, level or 0, whether it goes, whether it is suspect
    dropped = suspect = 0

    def flush() -> None:
        if text:
            level = next((k for k in (3, 2, 1) if depth[k]), 0)
            if words := " ".join(html.unescape("".join(text)).split()):
                out.append(Block(level, suspect > 0, words))
            text.clear()

    def flush_beside() -> None:
        if other:
            if beside and (words := " ".join(html.unescape("".join(other)).split())):
                out.append(Block(0, False, words, True))
            other.clear()

    def close(k: int) -> None:
        nonlocal dropped, suspect
        while len(opened) > k:
            _, level, goes, odd = opened.pop()
            dropped, suspect = dropped - goes, suspect - odd
            if goes:
                flush_beside()
            if level:
                depth[level] -= 1

    at, unclosed = 0, set()
    while m := TOKEN.search(page, at):
        at = m.end()
        raw = m[4]
        if raw is not None:
            (other if dropped else text).append(raw)
            continue
        tag = (m[2] or "").lower()
        if not tag:  # a comment or declaration
            continue
        if tag in OPAQUE and not m[1]:
            if tag == "svg" and m[3].rstrip().endswith("/"):  # the one of them that may close itself
                continue
            end = None if tag in unclosed else re.compile(rf"</{tag}(?![\w:-])[^>]*>?", re.I).search(page, at)
            if end or tag in RAW:
                at = end.end() if end else len(page)
                continue
            unclosed.add(tag)  # what is never closed takes nothing with it
            continue
        if tag == "br":
            text.append(" ")
            other.append(" ")
            continue
        if tag in BLOCK or tag in DROPPED:
            flush()
            flush_beside()
        if m[1]:
            k = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == tag), None)
            if k is not None:
                close(k)
            continue
        if opened and opened[-1][0] == "p" and tag in BLOCK:  # a block ends a paragraph
            close(len(opened) - 1)
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        sure, perhaps, holds, main = marks(tag, m[3])
        frame = tag in ("html", "body", "article", "main")
        goes = tag in DROPPED or (sure and not frame) or (tag == "article" and perhaps and depth[3] > 0) or (tag == "header" and not depth[3])
        odd = perhaps and not goes and not frame
        level = 3 if tag == "article" else 2 if tag == "main" or (main and not perhaps) else 1 if holds and not perhaps and tag in ("div", "section", "td") else 0
        # Every open element of a tag that matters is kept, so that its end is not taken for that of an outer one.
        if goes or level or odd or any(tag == x[0] for x in opened):
            if odd and tag not in BLOCK:
                flush()
            opened.append((tag, level, goes, odd))
            dropped, suspect = dropped + goes, suspect + odd
            if level:
                depth[level] += 1
    flush()
    flush_beside()
    return out


def best_level(found: list[Block]) -> int:
    """The level that holds the page's text: that of articles, or that of main where most of its text is beside them, as
    around a teaser."""
    best = max((b.level for b in found), default=0)
    if best == 3:
        size = lambda level: sum(len(b.text) for b in found if b.level == level and not b.suspect)
        best = 2 if size(2) > 2 * size(3) else 3
    return best


def main_text(found: list[Block]) -> str | None:
    """The text of the best level that markup gives; None if markup doesn't decide."""
    if not found:
        return ""
    best = best_level(found)
    own = [b for b in found if b.level == best]
    return None if best == 0 or any(b.suspect for b in own) else "\n".join(b.text for b in own)


def stream(found: list[Block], run: int) -> tuple[list[tuple[int, list[str]]], list[tuple[int, int, int]]]:
    """The token streams of a page, each with the place of its first token: all that markup neither guards nor has beside
    the article, the article's blocks, and each stretch beside it; and a block's place, tokens and kind, in page order.

    Every token of every block is in one stream.  Places of different streams are at least `run` apart, so that no run
    leads from one to the next.
    """
    best = best_level([b for b in found if not b.beside])
    streams: list[list[str]] = [[], []]
    places, last = [], False
    for b in found:
        guarded = not b.beside and best > 0 and b.level == best and not b.suspect
        if b.beside and not last:
            streams.append([])
        k, words = len(streams) - 1 if b.beside else ARTICLE if guarded else 0, b.text.split()
        places.append((k, len(streams[k]), len(words), GUARDED if guarded else OPEN if not b.beside and b.level == best else BESIDE))
        streams[k] += words
        last = b.beside
    starts = [0]
    for words in streams:
        starts.append(starts[-1] + len(words) + run)
    return list(zip(starts, streams)), [(starts[k] + at, n, kind) for k, at, n, kind in places]


class Hashes(dict):
    """Hashes of tokens, each made once."""

    def __missing__(self, token: str) -> int:
        self[token] = made = xxhash.xxh3_64_intdigest(token)
        return made


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def keyed_suffixes(pages: Iterable[list[tuple[int, list[str]]]], hosts: list[int], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes of the streams of pages, in order: the page's number, the place in it, the key, of the host and the
    first `run` tokens, and whether it lies outside the article; a stretch beside it that is shorter than `run` is one."""
    known, hashes, streams = Hashes(), [np.zeros(0, np.uint64)], []
    for page, (host, own) in enumerate(zip(hosts, pages)):
        words = [w for _, part in own for w in part]
        hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        streams += [(page, start, len(part), k, host) for k, (start, part) in enumerate(own)]
    of, start, tokens, k, host = np.array(streams, np.int64).reshape(-1, 5).T
    n = np.where(k <= ARTICLE, run, np.minimum(run, tokens))  # tokens of a key
    count = np.where(tokens > 0, np.maximum(tokens - n + 1, 0), 0)
    each = np.repeat(np.arange(len(of)), count)
    offset = np.arange(len(each)) - np.repeat(count.cumsum() - count, count)
    at, n = (tokens.cumsum() - tokens)[each] + offset, n[each]
    h = np.concatenate([*hashes, np.zeros(run, np.uint64)])
    keys = n.astype(np.uint64)
    for i in range(run):
        keys += np.where(i < n, h[at + i] * np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)), np.uint64(0))
    return of[each], start[each] + offset, mixed(mixed(keys) + host.view(np.uint64)[each]), (k != ARTICLE)[each]


def unique_runs(found: list[Block], places: list[tuple[int, int, int]], taken: np.ndarray, outside: np.ndarray, run: int) -> tuple[str, int, int]:
    """The text that is left of a page's blocks, how many tokens repeated runs took, given where those begin and those of
    them that pages share outside their articles, and how many more the check of markup took."""
    at, n, kind = np.array(places, np.int64).reshape(-1, 3).T
    end = int((at + n).max(initial=0)) + run + 1
    gone, gone_outside = ((np.bincount(x, minlength=end) - np.bincount(x + run, minlength=end)[:end]).cumsum() > 0 for x in (taken, outside))
    before = np.concatenate([[0], gone.cumsum()])
    by_array = before[at + n] - before[at]
    kept = []
    for b, (start, count, of) in zip(found, places):
        if of == GUARDED:  # the check gives it back whole
            kept.append(b.text)
        elif of == OPEN and (left := [w for w, x in zip(b.text.split(), gone_outside[start : start + count].tolist()) if not x]):
            kept.append(" ".join(left))
    return "\n".join(kept), int(by_array.sum()), int((n - by_array)[kind == BESIDE].sum())


def packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers by their gaps, byte by byte of equal weight, in few bytes."""
    gaps = np.diff(numbers.astype("<u8"), prepend=np.zeros(1, "<u8"))
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel().cumsum(dtype=np.uint64)


def joined(parts: Iterable[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *map(unpacked, parts)]))


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in known, which is ascending."""
    at = np.searchsorted(known, x)
    return known[np.minimum(at, len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def as_row(found: list[Block]) -> tuple[bytes, bytes]:
    return zlib.compress("\n".join(b.text for b in found).encode(), 1), bytes(b.level | b.suspect << 2 | b.beside << 3 for b in found)


def as_blocks(texts: bytes, marks: bytes) -> list[Block]:
    return [Block(m & 3, m & 4 > 0, text, m & 8 > 0) for text, m in zip(zlib.decompress(texts).decode().split("\n"), marks)]


def distinct_pages(group: pd.DataFrame) -> tuple[np.ndarray, list[int], list[list[Block]]]:
    own = group.drop_duplicates("page")
    return own["page"].to_numpy(), own["host"].to_list(), [as_blocks(*x) for x in zip(own["texts"], own["marks"])]


def held_runs(group: pd.DataFrame, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the runs of each distinct page of a group, each once a page and in ascending order, with the page, and
    whether it holds the run outside its article."""
    pages, hosts, found = distinct_pages(group)
    of, _, keys, outside = keyed_suffixes((stream(f, run)[0] for f in found), hosts, run)
    order = np.argsort(keys, kind="stable")
    of, keys, outside = of[order], keys[order], outside[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])[: len(keys)])
    return keys[first], pages[of[first]], np.logical_or.reduceat(outside, first) if len(first) else outside


def ranges(keys: np.ndarray, count: int) -> Iterator[tuple[int, slice]]:
    """Stretches of ascending keys that lie in each of `count` equal ranges, where there are any."""
    ends = np.searchsorted(keys, np.array([(k << 64) // count for k in range(1, count)], np.uint64))
    for k, (a, b) in enumerate(zip([0, *ends], [*ends, len(keys)])):
        if a < b:
            yield k, slice(a, b)


def extract_main_text(pages: DataFrame, run: int = 8, min_pages: int = 3) -> DataFrame:
    """A row per row of pages (page_id, url, html): page_id, url, text, by_markup, n_repeated and n_beside.

    Blocks are joined by a line feed, with white space inside one turned into a space and character references decoded.
    The array takes all token runs of at least `run` tokens that at least min_pages distinct pages of the host hold,
    whether in articles, menus, adverts or footers; a shorter stretch of what is beside the article counts as a whole.
    Equal pages count once.  Then markup checks: the article's blocks are given back whole, or those of main, or of an
    element named so, and what is beside goes; blocks of an element whose class or id has a word like "related" among
    others, and all blocks of a page whose markup names no article, stay as the array left them, but get back the runs that
    fewer than min_pages pages hold outside their articles, and by_markup is false.  n_repeated tokens were taken by the
    array, with those that the check gave back, and n_beside more by the check.  Null or empty html gives empty text; a
    null url is the host of the empty name.  Rows may repeat ids; further columns are ignored; an empty table gives an
    empty table.
    """
    small_batches(pages.sparkSession)
    body, host = F.coalesce("html", F.lit("")), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/?#]*)", 1))
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    groups, bits = size // GROUP_BYTES + 1, size.bit_length() + 2
    rows = pages.select("page_id", "url", body.alias("html"), F.xxhash64(host).alias("host"), F.xxhash64(host, body).alias("page"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("page", "page_id"), F.lit(groups)))
    kinds = dict(pages.dtypes)
    key = f"page_id {kinds['page_id']}, url {kinds['url']}"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [as_row(blocks(x, beside=True)) for x in b["html"]]
            b["texts"], b["marks"] = [f[0] for f in found], [f[1] for f in found]
            yield b[["page_id", "url", "host", "page", "grp", "texts", "marks"]]

    def ask_cells(group: pd.DataFrame) -> pd.DataFrame:
        keys = held_runs(group, run)[0]
        asked = [(group["grp"].iloc[0], k, packed(keys[at] >> np.uint64(64 - bits))) for k, at in ranges(keys, groups)]
        return pd.DataFrame(asked, columns=["grp", "part", "cells"])

    def full_cells(asked: pd.DataFrame) -> pd.DataFrame:
        cells = [unpacked(x) for x in asked["cells"]]
        each, n = np.unique(np.concatenate(cells), return_counts=True)
        full = each[n >= min_pages]
        return pd.DataFrame({"grp": asked["grp"], "cells": [packed(np.unique(x[among(x, full)])) for x in cells]})

    def ask_runs(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        asked = []
        if len(group):
            keys, held_by, outside = held_runs(group, run)
            some = among(keys >> np.uint64(64 - bits), joined(told["cells"]))
            keys, held_by, outside = keys[some], held_by[some], outside[some]
            for k, at in ranges(keys, groups):
                who, place = np.unique(held_by[at], return_inverse=True)
                asked.append((group["grp"].iloc[0], k, packed(keys[at]), zlib.compress(place.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1), who.tobytes(), np.packbits(outside[at]).tobytes()))
        return pd.DataFrame(asked, columns=["grp", "part", "keys", "places", "pages", "outside"])

    def take(asked: pd.DataFrame) -> pd.DataFrame:
        keys = [unpacked(x) for x in asked["keys"]]
        places = [np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for x in asked["places"]]
        pairs = pd.DataFrame({
            "key": np.concatenate(keys), "page": np.concatenate([np.frombuffer(w, np.int64)[p] for w, p in zip(asked["pages"], places)]),
            "outside": np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=len(k)) for o, k in zip(asked["outside"], keys)]),
        }).drop_duplicates(["key", "page"])  # equal pages lie in several groups
        n = pairs.groupby("key")["outside"].agg(["size", "sum"])
        taken = [n.index[n[c] >= min_pages].to_numpy() for c in ("size", "sum")]
        told = [[packed(np.unique(k[among(k, t)])) for k in keys] for t in taken]
        return pd.DataFrame({"grp": asked["grp"], "taken": told[0], "outside": told[1]})

    def cut(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        pages, hosts, found = distinct_pages(group)
        placed = []

        def streams() -> Iterator[list[tuple[int, list[str]]]]:  # so that the words of one page are held at a time
            for f in found:
                own, places = stream(f, run)
                placed.append(places)
                yield own

        of, ats, keys, _ = keyed_suffixes(streams(), hosts, run)
        ends = np.searchsorted(of, np.arange(len(pages) + 1))
        taken, outside = (among(keys, joined(told[c])) for c in ("taken", "outside"))
        left = {}
        for i, (page, f, places) in enumerate(zip(pages, found, placed)):
            own = slice(ends[i], ends[i + 1])
            left[page] = *unique_runs(f, places, ats[own][taken[own]], ats[own][outside[own]], run), all(kind != OPEN for *_, kind in places)
        of = [left[page] for page in group["page"]]
        return group[["page_id", "url"]].assign(text=[x[0] for x in of], by_markup=[x[3] for x in of], n_repeated=[x[1] for x in of], n_beside=[x[2] for x in of])

    # Pages are shuffled once, in groups of about GROUP_BYTES, and that shuffle is read three times.  What goes from groups to
    # ranges of keys and back is first a cell a run, a few bits of its key, and then the key where enough pages share the cell.
    parsed = rows.mapInPandas(parse, f"{key}, host long, page long, grp long, texts binary, marks binary").repartition(4 * groups, "grp")
    full = parsed.groupBy("grp").applyInPandas(ask_cells, "grp long, part long, cells binary").groupBy("part").applyInPandas(full_cells, "grp long, cells binary")
    asked = parsed.groupBy("grp").cogroup(full.groupBy("grp")).applyInPandas(ask_runs, "grp long, part long, keys binary, places binary, pages binary, outside binary")
    taken = asked.groupBy("part").applyInPandas(take, "grp long, taken binary, outside binary")
    return parsed.groupBy("grp").cogroup(taken.groupBy("grp")).applyInPandas(cut, f"{key}, text string, by_markup boolean, n_repeated long, n_beside long")
