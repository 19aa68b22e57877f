"""Line dedup: drop lines that many documents share (DataFrame functions only).

Lines are exploded and hashed, distinct documents are counted per hash with partial aggregation, and the positions to
drop go back to their documents; whole texts are shuffled once, as they rejoin their positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridag.llm.common import BLANKS, ascii_lower, stored, with_outputs


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Every row of docs with text_col shortened, and n_lines and n_dropped.

    A line's key is the line without blanks at both ends and with A-Z lower-cased.  A key of at least min_chars code
    points that at least min_docs distinct ids hold loses all its lines, except in the rows of the largest id with it.
    Null or empty text is one empty line.  Rows with the same id are one document when documents are counted; each keeps
    its own text.  A null id counts for no document and is never the largest.  Columns named n_lines or n_dropped are
    replaced; others pass through.  An empty table gives an empty table.  Keys are compared by two 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row_hash"), F.split(text, "\n", -1).alias("lines"))
    lines = lines.select("id", "row_hash", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("id", "row_hash", "n", "pos", F.btrim(ascii_lower(F.col("line")), F.lit(BLANKS)).alias("key")).where(F.length("key") >= min_chars)
    keyed = keyed.select("id", "row_hash", "n", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"))

    shared = keyed.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    shared = stored(shared)  # so that the join sees two plain shuffles and can split the partition of a very common line
    hits = keyed.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    at = hits.groupBy("id", "row_hash", "n").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # One byte a line, 1 where it goes: runs of 0 between the dropped positions.
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), "at"), F.concat("at", F.array("n")), lambda a, b: F.repeat(F.lit("0"), b - a - 1))
    masks = at.select(F.col("id").alias("mask_id"), F.col("row_hash").alias("mask_hash"), F.array_join(runs, "1").cast("binary").alias("mask"))

    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("row_hash"))
    joined = whole.join(masks, F.col("id").eqNullSafe(F.col("mask_id")) & (F.col("row_hash") == F.col("mask_hash")), "left")
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    split = F.split(text, "\n", -1)
    kept = F.filter(split, lambda _, i: F.substring(F.col("mask"), i + 1, 1) == F.lit(b"0"))
    n_kept = F.length(F.replace(F.col("mask").cast("string"), F.lit("1"), F.lit("")))
    outputs = {
        text_col: F.when(F.col("mask").isNull(), text).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size(split).cast("long"),
        "n_dropped": F.when(F.col("mask").isNull(), F.lit(0)).otherwise(F.length("mask") - n_kept).cast("long"),
    }
    return with_outputs("row", joined, outputs)
