"""Chat formatting of reply trees: the best root-to-leaf paths, each written as one conversation and read back.

Ancestors are found by self-joins that double their reach, so that a tree as deep as a long chat takes a few rounds.  The
template marks turns by control strings; one that occurs in a text gets a backslash more after its first character, which
reading takes off again, so that any text and any role survives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridag.llm.common import forget, small_batches, stored

START, OTHER = "<s>", ("[ROLE] ", "[AS] ", " [/ROLE]")
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[OUT] ", "</s>")}
#: What must not stand in a text as it is, with the backslashes that it may have already.
CONTROL = re.compile(r"([\[<])(\\*)(/?(?:INST|SYS|OUT|ROLE|AS)\]|/?s>)")
ESCAPED = re.compile(r"([\[<])\\(\\*)(/?(?:INST|SYS|OUT|ROLE|AS)\]|/?s>)")
TURN = re.compile(r"(?:<s>)?(?:\[INST\] (?P<user>.*?) \[/INST\]|\[SYS\] (?P<system>.*?) \[/SYS\]|\[OUT\] (?P<assistant>.*?)</s>|\[ROLE\] (?P<role>.*?)\[AS\] (?P<other>.*?) \[/ROLE\])", re.S)
#: Turns and characters of a conversation that are formatted as one piece; almost every conversation is one.
SEGMENT, PIECE = 4096, 1 << 20
PIECES = "key string, first long, text string, loss array<struct<start:long,end:long>>"


def escaped(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def formatted_turn(role: str, text: str, first: bool) -> tuple[str, int, int]:
    """A turn in the template, and where its text is."""
    head, tail = MARKS.get(role) or (f"{OTHER[0]}{escaped(role)}{OTHER[1]}", OTHER[2])
    head, text = START * first + head, escaped(text)
    return head + text + tail, len(head), len(head) + len(text)


def parsed_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    turns, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = m.lastgroup
        turns.append((unescaped(m["role"]) if role == "other" else role, unescaped(m[role])))
        at = m.end()
    return turns


def reply_paths(messages: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """(path, tree, rank, pos, message_id): the messages, from the root on, of each tree's first per_tree root-to-leaf paths.

    messages: (message_id, parent_id, score).  A path is named by its leaf, and ranked by the mean score of its messages to
    nine digits, ties by leaf; per_tree None takes all.  A null score counts 0; a message whose parent is null or unknown
    is a root; rows that repeat an id count once, with the highest score; rows without id name nothing and go, as do
    messages on or below a cycle, which have no root.  An empty table gives an empty table.
    """
    once = messages.where(F.col("message_id").isNotNull()).groupBy(F.col("message_id").alias("node")).agg(F.max(F.struct(F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.col("parent_id").alias("parent"))).alias("x"))
    once = stored(once.select("node", "x.parent", "x.score"))
    known = once.select(F.col("node").alias("parent"), F.col("node").alias("up"))
    step = once.join(known, "parent", "left").select("node", "up", F.lit(1).cast("long").alias("n"), "score", F.when(F.col("up").isNull(), F.col("node")).alias("root"))
    # jumps[k] leads 2**k messages up; n and score are those of the messages passed.
    jumps, most = [stored(step)], once.count()
    while (1 << (len(jumps) - 1)) <= most and not jumps[-1].where("up is not null").isEmpty():
        now = jumps[-1]
        far = now.select(F.col("node").alias("far"), F.col("up").alias("far_up"), F.col("n").alias("far_n"), F.col("score").alias("far_score"), F.col("root").alias("far_root"))
        on = now.where("up is not null").join(far, F.col("up") == F.col("far")).select("node", F.col("far_up").alias("up"), (F.col("n") + F.col("far_n")).alias("n"), (F.col("score") + F.col("far_score")).alias("score"), F.col("far_root").alias("root"))
        jumps.append(stored(now.where("up is null").unionByName(on)))
    inner = jumps[0].where("up is not null").select(F.col("up").alias("node")).distinct()
    leaves = jumps[-1].where("root is not null").join(inner, "node", "left_anti")
    order = Window.partitionBy("root").orderBy(F.desc(F.round(F.col("score") / F.col("n"), 9)), "node")
    ranked = leaves.select(F.col("node").alias("path"), F.col("root").alias("tree"), F.row_number().over(order).alias("rank"), "n", "node", F.lit(0).cast("long").alias("above"))
    on_path = stored(ranked if per_tree is None else ranked.where(F.col("rank") <= per_tree))
    for k, jump in enumerate(jumps[:-1]):
        up = jump.where("up is not null").select("node", "up")
        higher = on_path.join(up, "node").select("path", "tree", "rank", "n", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        on_path = stored(on_path.unionByName(higher))
    forget(once, *jumps)
    return on_path.select("path", "tree", "rank", (F.col("n") - 1 - F.col("above")).alias("pos"), F.col("node").alias("message_id"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Conversations in the template, stored: (key, first, text, loss) of turns (key, pos, role, text).

    A row is a whole conversation, or, if that has over SEGMENT turns or PIECE characters, a run of whole turns of it that
    begins with turn `first`; its texts by `first` are the conversation.  loss has the spans of assistant texts, in code
    points.  Null role or text is empty.
    """
    small_batches(turns.sparkSession, 64)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece: list[str] = []
        at, first, spans, last = 0, 0, [], None

        def row() -> tuple:
            return (None if last[0] is pd.NA else last[0], first, "".join(piece), spans)

        for b in batches:
            rows = []
            for key, segment, pos, role, text in zip(b["key"], b["segment"], b["pos"], b["role"], b["text"]):
                if last is not None and ((key, segment) != last or at >= PIECE):
                    rows.append(row())
                    piece, at, spans, last = [], 0, [], None
                if last is None:
                    first, last = pos, (key, segment)
                whole, start, end = formatted_turn(role, text, pos == 0)
                if role == "assistant":
                    spans.append({"start": at + start, "end": at + end})
                piece.append(whole)
                at += len(whole)
            yield pd.DataFrame(rows, columns=["key", "first", "text", "loss"])
        if last is not None:
            yield pd.DataFrame([row()], columns=["key", "first", "text", "loss"])

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select(F.col("key").cast("string").alias("key"), (F.col("pos") / SEGMENT).cast("long").alias("segment"), F.col("pos").cast("long").alias("pos"), empty("role"), empty("text"))
    return stored(rows.repartition("key", "segment").sortWithinPartitions("key", "segment", "pos").mapInPandas(write, PIECES))


def read_turns(pieces: DataFrame) -> DataFrame:
    """(key, pos, role, text) of what format_turns wrote."""
    small_batches(pieces.sparkSession, 64)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, first + i, *turn) for key, first, text in zip(b["key"], b["first"], b["text"]) for i, turn in enumerate(parsed_turns(text))]
            yield pd.DataFrame(rows, columns=["key", "pos", "role", "text"])

    return pieces.mapInPandas(read, "key string, pos long, role string, text string")


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from what format_turns wrote.

    A digest is sequential: the pieces of one conversation are read one after another, and never held together.
    """
    small_batches(pieces.sparkSession, 64)
    columns = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sums = object(), None
        for b in batches:
            rows = []
            for key, text, loss in zip(b["key"], b["text"], b["loss"]):
                if sums is None or key != last:
                    rows += [(last, sums[0], sums[1].hexdigest(), sums[2], sums[3].hexdigest(), sums[4])] if sums else []
                    last, sums = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parsed_turns(text):
                    sums[0] += 1
                    sums[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescaped(text[span["start"] : span["end"]])
                    sums[2] += len(said)
                    sums[3].update(said.encode())
                sums[4] += len(text)
            yield pd.DataFrame(rows, columns=columns)
        if sums:
            yield pd.DataFrame([(last, sums[0], sums[1].hexdigest(), sums[2], sums[3].hexdigest(), sums[4])], columns=columns)

    schema = "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInPandas(read, schema)


def conversations_as_replies(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, pos, role, text) as messages, each a reply to the one before it."""
    name = lambda pos: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), pos)
    return turns.select(name(F.col("pos")).alias("message_id"), F.when(F.col("pos") > 0, name(F.col("pos") - 1)).alias("parent_id"), F.lit(0.0).alias("score"), "conv_id", "role", "text")


def format_chat(messages: DataFrame, key: str, per_tree: int | None = 1) -> DataFrame:
    """Pieces, as of format_turns, of the chosen paths of messages (message_id, parent_id, score, role, text, key).

    key is the column that names a path's conversation; rows that repeat a message count once, with the first role and text.
    """
    paths = reply_paths(messages, per_tree)
    said = messages.where(F.col("message_id").isNotNull()).groupBy("message_id").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col(key).alias("key"))).alias("x"))
    return format_turns(paths.join(said, "message_id").select("x.key", "pos", "x.role", "x.text"))
