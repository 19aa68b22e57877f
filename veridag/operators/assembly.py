"""Assembly of evidence and scope: expansions, merged searches, scopes of facts, user checks and actions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridag.operators.graph import containing

# Words of a question about data assets.
ASSET_TERMS = (
    "table tables hub layer ard dataset datasets mart load loads incremental job jobs pipeline pipelines schema column columns lineage certified certify quality dq "
    "governance compliant compliance policy policies warehouse ingestion ingest batch catalog"
).split()


def about_assets(question: Column) -> Column:
    words = F.transform(F.split(F.lower(F.coalesce(question, F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit(".,?!:;()'\"")))
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in ASSET_TERMS]))


def expanded(entities: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(label, id, n, shown): how many distinct "relation:target" an entity has, and the first `most` of them."""
    out = edges.select(F.col("src_label").alias("label"), F.col("src_id").alias("id"), F.concat_ws(":", "rel_type", "dst_id").alias("edge"))
    wanted = out.join(entities.select("label", "id").distinct(), ["label", "id"], "left_semi").distinct()
    order = Window.partitionBy("label", "id").orderBy("edge")
    some = wanted.withColumn("k", F.row_number().over(order)).groupBy("label", "id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.col("edge")))).alias("shown"))
    return some.select("label", "id", "n", F.array_join("shown", " ").alias("shown"))


def fact_scope(*scopes: DataFrame) -> DataFrame:
    """(question_id, label, id, source) of several sources, each entity once a question, as the last source that names it has it."""
    out = None
    for k, s in enumerate(scopes):
        one = s.select("question_id", "label", "id", F.lit(k).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("question_id", "label", "id").agg(F.max("source").alias("source"))


def entity_texts(nodes: DataFrame, edges: DataFrame, label: str, captions: dict[str, str], relations: list[tuple[str, str, bool]], most: int = 8) -> DataFrame:
    """(label, id, text): one text an entity of a label, with its properties and the first `most` names of its neighbours.

    captions: caption by property; relations: caption, relation, and whether it is followed backward.
    """
    own = nodes.where(F.col("label") == label)
    shown = [F.concat(F.lit(f"{caption}: "), F.coalesce(F.col("props")[name], F.lit("unknown"))) for name, caption in captions.items()]
    out = own.select("label", "id", F.concat_ws("; ", F.concat(F.lit(f"{label} "), F.coalesce("name", "id")), *shown).alias("text"))
    for caption, rel, backward in relations:
        me, other = ("dst", "src") if backward else ("src", "dst")
        step = edges.where((F.col("rel_type") == rel) & (F.col(f"{me}_label") == label)).select(F.col(f"{me}_id").alias("me"), F.col(f"{other}_label").alias("label"), F.col(f"{other}_id").alias("id"))
        names = step.join(nodes.select("label", "id", F.coalesce("name", "id").alias("other")), ["label", "id"]).select("me", "other")
        # Equal names share a place, and are made one after the cut.
        some = names.withColumn("k", F.dense_rank().over(Window.partitionBy("me").orderBy("other"))).where(F.col("k") <= most)
        told = some.groupBy(F.col("me").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("other")), ", ").alias("others"))
        out = out.join(told, "id", "left").select("label", "id", F.concat("text", F.lit(f"; {caption}: "), F.coalesce("others", F.lit("none"))).alias("text"))
    return out


def templated_texts(rows: DataFrame, kind: str, key: str, name: str, template: str) -> DataFrame:
    """(source_id, name, text) of rows by a template in which {column} stands for a column's value, "unknown" if it is null.

    The template is cut at plan time, so that a text is one expression; {{ and }} stand for braces.
    """
    parts = []
    for literal, column, *_ in Formatter().parse(template):
        parts += [F.lit(literal)] if literal else []
        parts += [F.coalesce(F.col(column).cast("string"), F.lit("unknown"))] if column else []
    return rows.select(F.concat_ws(":", F.lit(kind), F.col(key).cast("string")).alias("source_id"), F.col(name).alias("name"), F.concat(*parts, F.lit("")).alias("text"))


def keyword_hits(questions: DataFrame, records: DataFrame, most: int | None = None) -> DataFrame:
    """(question_id, record_id) where any of a question's terms is in a record's folded title or scope; the first `most` by id.

    The first `most` of a question are among the first of its terms, so that terms are cut before questions meet them: in
    parts by a hash of the record, and then as wholes.
    """
    terms = questions.select("question_id", F.explode("terms").alias("needle")).where("needle <> ''").distinct()
    texts = records.select("record_id", F.lower(F.concat_ws("\n", "title", "scope")).alias("text"))
    hits = containing(texts, terms).select("record_id", "needle")
    if most is not None:
        for part in ([F.pmod(F.xxhash64("record_id"), F.lit(64))], []):
            hits = hits.withColumn("k", F.dense_rank().over(Window.partitionBy("needle", *part).orderBy("record_id"))).where(F.col("k") <= most).drop("k")
    found = hits.distinct().join(terms, "needle").select("question_id", "record_id").distinct()
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("record_id"))
    return found if most is None else found.withColumn("k", order).where(F.col("k") <= most).drop("k")


def first_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(position))).where("_k = 1").drop("_k")


def user_checks(rows: DataFrame, text: str, checks: dict[str, Column | Callable[[str], bool]]) -> DataFrame:
    """A boolean column per check: a Column as it is, a function of the text by Arrow batches; an exception is a fail."""
    for name, check in checks.items():
        rows = rows.withColumn(name, F.coalesce(check if isinstance(check, Column) else python_check(check)(F.col(text)), F.lit(False)))
    return rows


def python_check(check: Callable[[str], bool]):
    def safe(t: str | None) -> bool:
        try:
            return bool(check(t))
        except Exception:  # noqa: BLE001  a check that breaks has not passed
            return False

    @F.pandas_udf("boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(safe).astype("bool")

    return run


def acted(objects: DataFrame, actions: DataFrame) -> DataFrame:
    """Objects (object_id, …) with the status of their last action (object_id, action, at, seq), "new" without one."""
    last = actions.groupBy("object_id").agg(F.max_by("action", F.struct("at", "seq")).alias("status"), F.count(F.lit(1)).alias("n_actions"))
    return objects.join(last, "object_id", "left").withColumn("status", F.coalesce("status", F.lit("new"))).withColumn("n_actions", F.coalesce("n_actions", F.lit(0)))
