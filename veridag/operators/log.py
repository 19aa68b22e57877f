"""The time-aware decision log: append-only tables read as of any moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridag.functions.numbers import rounded
from veridag.functions.text import sorted_json
from veridag.sources.tables import stored


def as_of(decisions: DataFrame, at: Column) -> DataFrame:
    """Decisions valid at a moment: from valid_from, until before valid_to or open."""
    return decisions.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def width_level(length: Column, width_us: int) -> Column:
    """Which of the widths, each four times the one before, is the first as wide as a length."""
    return F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(float(width_us))) / 2)).cast("int")


def kept_levels(counts: dict[int, int], share: int = 16) -> list[int]:
    """Of the levels and their numbers of intervals, those that keep their own width: the widest, and those that a share of
    all intervals has, with what narrower ones pass on.  The others' intervals go to the next width kept."""
    kept, waiting, total = [], 0, sum(counts.values())
    for k in sorted(counts):
        waiting += counts[k]
        if waiting * share >= total or k == max(counts):
            kept, waiting = [*kept, k], 0
    return kept or [0]


def as_of_join(probes: DataFrame, decisions: DataFrame, on: list[str], outer: bool = True, width_us: int = 60_000_000) -> DataFrame:
    """For each probe (at, …), every decision of its key that is valid then; outer: a row with null where there is none.

    decisions: (…, decision_id, valid_from, valid_to), valid from valid_from until before valid_to, or open if that is null.
    Each interval lies in the two or so buckets of time that are at least as wide as itself, and a probe in one bucket of
    each width in use, so that rows meet by key and bucket, whatever the intervals' lengths, and bounds are checked
    after.  Each width costs a row a probe, so they grow by four, and intervals of a length that few have lie in wider
    buckets.  Decisions of keys that nobody asks about don't enter.  A hot key's rows are in as many buckets as its time
    has.  Null keys and moments match nothing.  The exploded intervals are stored, so that the planner knows their size.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    horizon = probes.agg(F.max(us("at"))).first()[0]
    end = F.least(F.coalesce(us("valid_to"), F.lit((horizon or 0) + 1)), F.lit((horizon or 0) + 1))
    asked_for = stored(probes.select(*on).distinct())
    cut = decisions.join(asked_for, on, "left_semi").select(*on, "decision_id", us("valid_from").alias("_from"), end.alias("_to")).where("_from < _to")
    cut = stored(cut.withColumn("_level", width_level(F.col("_to") - F.col("_from"), width_us)))  # read twice
    levels = kept_levels({r[0]: r[1] for r in cut.groupBy("_level").count().collect()})  # one a power of four

    def bucket(t: Column, level: Column) -> Column:
        size = (F.lit(width_us) * F.pow(F.lit(4), level)).cast("long")
        return F.call_function("div", t - F.pmod(t, size), size)

    cut = cut.withColumn("_level", F.array_min(F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= F.col("_level"))))
    spread = F.explode(F.sequence(bucket(F.col("_from"), F.col("_level")), bucket(F.col("_to") - 1, F.col("_level"))))
    cut = stored(cut.withColumn("_b", spread).withColumn("_bucket", F.col("_b") * 32 + F.col("_level")).drop("_b", "_level"))
    asked = probes.withColumn("_bucket", F.explode(F.array(*[bucket(us("at"), F.lit(k)) * 32 + k for k in levels])))
    cut = cut.select(*[F.col(c).alias(f"_{c}") for c in (*on, "decision_id")], "_from", "_to", F.col("_bucket").alias("_at_bucket"))
    valid = [*[F.col(c) == F.col(f"_{c}") for c in on], F.col("_bucket") == F.col("_at_bucket"), F.col("_from") <= us("at"), us("at") < F.col("_to")]
    found = asked.join(cut, valid).select(*probes.columns, F.col("_decision_id").alias("decision_id"))
    if not outer:
        return found
    # Which probes have any is asked without their pairs.
    had = asked.join(cut, valid, "left_semi").select(*[F.col(c).alias(f"_{c}") for c in probes.columns]).distinct()
    bare = probes.join(had.hint("merge"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in probes.columns], "left_anti")
    return found.unionByName(bare.withColumn("decision_id", F.lit(None).cast(decisions.schema["decision_id"].dataType)))


def superseded(decisions: DataFrame, closes: DataFrame) -> DataFrame:
    """Decisions with valid_to from the close records (decision_id, closed_at): the first close wins, and none reopens."""
    closed = closes.groupBy("decision_id").agg(F.min("closed_at").alias("closed_at"))
    return decisions.join(closed, "decision_id", "left").withColumn("valid_to", F.least("valid_to", "closed_at")).drop("closed_at")


def chained(events: DataFrame, key: str, at: str) -> DataFrame:
    """valid_to of each row of a key: when its next begins."""
    return events.withColumn("valid_to", F.lead(at).over(Window.partitionBy(key).orderBy(at, "decision_id")))


def appended_events(log: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """The log with events (event_id, event_type, occurred_at, ingested_at, payload map) that it hasn't yet.

    Each has two times: what was ingested at no stated time is so now.  Payloads are JSON with sorted keys.
    """
    new = events.select("event_id", "event_type", "occurred_at", F.coalesce("ingested_at", now).alias("ingested_at"), sorted_json(F.col("payload")).alias("payload"))
    return log.unionByName(new.dropDuplicates(["event_id"]).join(log.select("event_id"), "event_id", "left_anti"))


def appended_decisions(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """The log with decisions (decision_id, decided_at, valid_from, …) that it hasn't yet, valid from their decision if not said."""
    new = decisions.withColumn("valid_from", F.coalesce("valid_from", "decided_at")).select(*log.columns)
    return log.unionByName(new.dropDuplicates(["decision_id"]).join(log.select("decision_id"), "decision_id", "left_anti"))


def concept_edges(rows: DataFrame, key: str, curies: str, maps_to: DataFrame, rel_type: str) -> DataFrame:
    """Edges (src_id, rel_type, dst_label, dst_id) from rows to the entities (label, id) that map to any of their curies."""
    wanted = rows.select(F.col(key).alias("src_id"), F.explode(curies).alias("curie")).distinct()
    return wanted.join(maps_to, "curie").select("src_id", F.lit(rel_type).alias("rel_type"), F.col("label").alias("dst_label"), F.col("id").alias("dst_id")).distinct()


def with_actions(decisions: DataFrame, actions: DataFrame, most: int | None = None) -> DataFrame:
    """decisions with n_actions and their actions (decision_id, action, at) in order of time, as "action" joined by commas.

    With `most`, only the last so many are told, and no more than those meet in a row; action_rows gives all as rows.
    """
    rows = actions
    if most is not None:
        order = Window.partitionBy("decision_id").orderBy(F.desc("at"), F.desc("action"))
        rows = actions.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    told = rows.groupBy("decision_id").agg(F.array_sort(F.collect_list(F.struct("at", "action"))).alias("a"))
    told = told.select("decision_id", F.array_join(F.transform("a", lambda x: x["action"]), ",").alias("actions"))
    n = actions.groupBy("decision_id").agg(F.count(F.lit(1)).alias("n_actions"))
    return decisions.join(n, "decision_id", "left").join(told, "decision_id", "left").select(*decisions.columns, F.coalesce("n_actions", F.lit(0)).alias("n_actions"), "actions")


def action_rows(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """A row an action (decision_id, action, at) of known decisions, numbered in order of time: for decisions with many."""
    order = Window.partitionBy("decision_id").orderBy("at", "action")
    return actions.join(decisions.select("decision_id").distinct(), "decision_id", "left_semi").withColumn("seq", F.row_number().over(order))


def appendable(children: DataFrame, decisions: DataFrame) -> DataFrame:
    """Those actions or outcomes whose decision exists."""
    return children.join(decisions.select("decision_id"), "decision_id", "left_semi")


def recent_open(decisions: DataFrame, k: int) -> DataFrame:
    return decisions.where("valid_to is null").orderBy(F.desc("valid_from"), F.desc("decision_id")).limit(k)


def provenance_chain(rows: DataFrame, key: str) -> DataFrame:
    """Per key: distinct sources, weakest confidence, and how many rows lack a source or confidence."""
    whole = (F.coalesce(F.col("source"), F.lit("")) != "") & (F.col("confidence") > 0)
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("confidence").alias("weakest"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("incomplete"))


def stage_times(actions: DataFrame) -> DataFrame:
    return actions.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("ms"), 3).alias("mean_ms"), F.max("ms").alias("max_ms"))


def stage_percentiles(actions: DataFrame, exact: bool = False) -> DataFrame:
    """Median and 95th percentile of each stage's times: by a sketch of bounded size, or exact."""
    p = (lambda q: F.percentile("ms", q)) if exact else (lambda q: F.percentile_approx("ms", q))
    return actions.groupBy("stage").agg(rounded(p(0.5), 3).alias("p50_ms"), rounded(p(0.95), 3).alias("p95_ms"))
