"""Linking of text mentions to terms: dictionary names by their rarest words, and mentions to concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridag.functions.text import MENTION, SPAN_NOISE
from veridag.sources.tables import stored

# Names that are too general to resolve.
NAME_STOPLIST = ("type", "status", "protein", "mutation", "expression")


def cut_words(c: str) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}\-]+"), lambda w: w != "")


def named_spans(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, label, key, name, start, size): where texts have all words of a name (label, key, name), in order.

    A name is sought by the one of its words that texts use least, and not at all if one of them is in no text; only where
    that word is are the others looked for, each at its place.  So the work follows the places found, not the length of
    the longest name.  Words are compared folded, and exactly for names of fewer than four letters.  text_id names one text.
    All joins shuffle: the planner takes exploded words for no more than the texts' file, and would send them by the driver.
    """
    known = stored(names.select("label", "key", "name").distinct().withColumn("words", cut_words("name")).where("size(words) > 0").withColumn("nid", F.monotonically_increasing_id()))
    parts = known.select("nid", F.size("words").alias("size"), (F.length("name") >= 4).alias("loose"), F.posexplode("words").alias("j", "own")).withColumn("token", F.lower("own"))
    tokens = texts.select("text_id", F.posexplode(cut_words("text")).alias("pos", "word")).select("text_id", (F.col("pos") + 1).alias("pos"), "word", F.lower("word").alias("token"))
    held = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(parts.select("token").distinct().hint("merge"), "token", "left_semi"))
    rarest = parts.join(held.hint("merge"), "token", "left").groupBy("nid", "size", "loose").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.min(F.struct("n", "j", "token", "own")).alias("x"))
    keys = stored(rarest.where("missing = 0").select("nid", "size", "loose", F.col("x.j").alias("key_j"), "x.token", "x.own"))
    same = F.col("loose") | (F.col("word") == F.col("own"))
    met = tokens.join(keys.hint("merge"), "token").where(same).select("text_id", (F.col("pos") - F.col("key_j")).alias("start"), "nid", "size", "key_j").where("start >= 1")
    rest = met.where("size > 1").join(parts.select("nid", "j", "loose", "token", "own").hint("merge"), "nid").where("j <> key_j").withColumn("pos", F.col("start") + F.col("j"))
    whole = rest.join(tokens.hint("merge"), ["text_id", "pos", "token"]).where(same).groupBy("text_id", "start", "nid", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size - 1")
    spans = met.where("size = 1").select("text_id", "start", "nid", "size").unionByName(whole.drop("n"))
    return spans.join(known.drop("words").hint("merge"), "nid").select("text_id", "label", "key", "name", "start", "size")


def resolve_names(texts: DataFrame, names: DataFrame, most: int = 12) -> DataFrame:
    """(text_id, label, key, name, start): names in texts, longest first.

    A name matches whole words: exactly if it has fewer than four letters, else folded.  Names of the stoplist go; within
    a label, a match inside a longer one goes, and names with the same span all stay; of the rest, the first `most` by
    length, place, label and key stay.
    """
    hits = stored(named_spans(texts, names.where(~F.lower("name").isin(*NAME_STOPLIST))))  # read twice
    by_label = Window.partitionBy("text_id", "label").orderBy("start", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("text_id", "label", "start", "size", (F.col("start") + F.col("size")).alias("end")).distinct().withColumn("covered", F.max("end").over(by_label))
    kept = hits.join(spans.where("covered is null or end > covered").hint("merge"), ["text_id", "label", "start", "size"], "left_semi")
    once = kept.groupBy("text_id", "label", "key", "name").agg(F.min("start").alias("start"))
    order = Window.partitionBy("text_id").orderBy(F.desc(F.length("name")), "start", "label", "key")
    return once.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def mention_rows(texts: DataFrame, least: int = 3) -> DataFrame:
    """(text_id, surface, start, end) of the mentions of texts (text_id, text), as candidate_mentions gives them.

    Places are running sums over a text's matches, a row a match, so that a text with many takes time in proportion.
    Rows that repeat an id and text count once.
    """
    found, gaps = F.regexp_extract_all("text", F.lit(MENTION), F.lit(0)), F.split("text", MENTION, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap")))
    rows = texts.where(F.col("text").isNotNull()).select("text_id", F.xxhash64("text").alias("h"), F.posexplode(pairs).alias("k", "x"))
    rows = rows.groupBy("text_id", "h", "k").agg(F.any_value("x").alias("x")).select("text_id", "h", "k", "x.m", "x.gap")
    before = F.sum(F.col("gap") + F.length("m")).over(Window.partitionBy("text_id", "h").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    inner = F.col("m").startswith("(")
    placed = rows.withColumn("start", (F.coalesce(before, F.lit(0)) + F.col("gap") + inner.cast("int")).cast("int"))
    placed = placed.withColumn("surface", F.trim(F.when(inner, F.substring("m", F.lit(2), F.length("m") - 2)).otherwise(F.col("m")))).withColumn("folded", F.lower("surface"))
    told = placed.where((F.length("surface") >= least) & ~F.forall(F.split("folded", r"\s+"), lambda w: w.isin(*SPAN_NOISE)))
    first = told.groupBy("text_id", "h", "folded").agg(F.min(F.struct("start", "surface")).alias("x"))
    return first.select("text_id", "x.surface", "x.start", (F.col("x.start") + F.length("x.surface")).alias("end"))


def term_index(*sources: DataFrame) -> DataFrame:
    """Distinct (curie, surface) of vocabularies, by curie and folded surface; surfaces under two letters go."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    fine = rows.where(F.length("surface") >= 2).groupBy("curie", F.lower("surface").alias("folded")).agg(F.min("surface").alias("surface"))
    return fine.select("curie", "surface")


def mention_edges(mentions: DataFrame) -> DataFrame:
    """MENTIONS edges (chunk, concept) of the linked among mentions (mention_id, curie, score)."""
    return mentions.where(F.col("curie").isNotNull()).select(F.lit("Chunk").alias("src_label"), F.col("mention_id").cast("string").alias("src_id"), F.lit("MENTIONS").alias("rel_type"), F.lit("Concept").alias("dst_label"), F.col("curie").alias("dst_id"), F.col("score").alias("confidence"))


def known_curies(curies: DataFrame, *vocabularies: DataFrame) -> DataFrame:
    """Those of the curies that any of the vocabularies has."""
    known = vocabularies[0].select("curie")
    for v in vocabularies[1:]:
        known = known.unionByName(v.select("curie"))
    return curies.join(known, "curie", "left_semi")


def linked_mentions(scored: DataFrame, concepts: DataFrame, threshold: float) -> DataFrame:
    """Mentions (mention_id, curie, score) with their best curie, or null below the threshold or for an unknown concept."""
    best = scored.groupBy("mention_id").agg(F.max(F.struct("score", "curie")).alias("top")).select("mention_id", "top.curie", "top.score")
    known = best.join(concepts.select("curie").distinct().withColumn("known", F.lit(True)), "curie", "left")
    status = F.when(F.col("score") < threshold, "unlinked").when(F.col("known").isNull(), "rejected").otherwise("linked")
    return known.select("mention_id", F.when(status == "linked", F.col("curie")).alias("curie"), "score", status.alias("status"))
