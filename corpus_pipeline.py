"""A corpus from raw documents to pieces, in stages that each work on all that the one before kept.

Language ID lets go of documents without a language, line dedup of lines that documents share, the n-gram join of all
but one document of each near-duplicate group, decontamination of documents that hold benchmark items; the last stage
encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridag.llm import langid, pieces
from veridag.llm.common import stored, table
from veridag.llm.decontam import find_leaks
from veridag.llm.jaccard import near_duplicates
from veridag.llm.linededup import drop_shared_lines

#: Below this share of a document's words in its language, it has none: with four languages, chance gives about 0.25.
MIN_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language of their own, which replaces a missing label.

    Null, empty and letterless texts have none and go.  Rows with a null or repeated doc_id, and repeated rows, are each
    judged by their own text; a tie of languages is for the first in order.  All columns pass, whatever their names; an
    empty table gives an empty table.
    """
    known = langid.identify(docs.select(F.struct("*").alias("row"), F.col("text")), langid.train(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return known.select(*[F.coalesce(F.col("row")[c], "lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops shared lines, and documents of which nothing but blanks is left; n_chars follows.

    Null and blank texts go.  Rows that repeat a doc_id count as one document and keep each its own text; a null doc_id
    counts for no document.  The largest doc_id with a line keeps it.  All columns pass, whatever their names; an empty
    table gives an empty table.
    """
    kept = drop_shared_lines(docs.select(F.struct("*").alias("row"), "doc_id", "text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents whose 5-word shingle sets have similarity 0.8 or more.

    Texts without words are in no group and stay, as do rows without doc_id, which nothing could name.  Rows that repeat a
    doc_id are one document and stay or go together.  All columns pass; an empty table gives an empty table.
    """
    gone = near_duplicates(docs.select("doc_id", "text"), ngram=5, num=80, den=100).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(stored(gone), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold or paraphrase a benchmark item.

    A null or empty text holds nothing and stays.  A leak of one row takes all rows of its doc_id; rows without doc_id
    are compared by their text instead.  All columns pass; with an empty table or benchmark nothing is dropped.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256)))
    leaks = stored(find_leaks(docs.select(key.alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key").select("key").distinct())
    return docs.join(leaks, key.eqNullSafe(leaks["key"]), "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text's best segmentation, the scores of the three best, and the hash of what the ids decode to.

    A row per row: a null or empty text has no ids, and the hash of the empty text.  Repeated rows and ids are encoded each
    by itself; other columns are not carried; an empty table gives an empty table.
    """
    model = pieces.read_model()
    coded = pieces.decode_pieces(pieces.encode_pieces(docs, model), model)
    return coded.select("doc_id", "n_pieces", "ids", "scores", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]

#: The learned stages can't be said in SQL; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES on documents, each stage's rows written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if k < len(STAGES) - 1 else docs
    return docs
