"""Declarative policy rules over facts: conditions become Column predicates, and all rules of a scope run in one pass.

A condition is {property: value} for equality or {property: {operator: value}}; a rule is a Rule below.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridag.sources.tables import dealt, stored

SEVERITIES = ("block", "warn", "info")  # most severe first


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    entity: str
    rationale: str
    where: dict = field(default_factory=dict)
    with_relation: str | None = None
    min_count: int = 1
    without_relation: str | None = None


def folded(v: object) -> str:
    return str(v).lower()


def present(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def compared(c: Column, value: object, op: str) -> Column:
    """Numeric comparison; null, booleans, NaN and what is no number compare as false."""
    number, v = c.cast("string").try_cast("double"), F.lit(float(value))  # type: ignore[arg-type]
    test = {"gt": number > v, "gte": number >= v, "lt": number < v, "lte": number <= v}[op]
    return F.coalesce(test & ~F.isnan(number), F.lit(False))


def condition(c: Column, op: str, value: object, is_list: bool = False) -> Column:
    """The predicate of one operator.  A missing value is unequal to, and not in, anything."""
    low = F.lower(c.cast("string"))
    if op == "exists":
        return present(c) == F.lit(bool(value))
    if op == "equals":
        return low.eqNullSafe(F.lit(folded(value)))
    if op == "not_equals":
        return ~low.eqNullSafe(F.lit(folded(value)))
    if op in ("in", "not_in"):
        hit = F.coalesce(low.isin([folded(v) for v in value]), F.lit(False))  # type: ignore[union-attr]
        return hit if op == "in" else ~hit
    if op == "contains":
        hit = F.exists(c, lambda x: F.lower(x) == folded(value)) if is_list else F.contains(low, F.lit(folded(value)))
        return F.coalesce(hit, F.lit(False))
    if op in ("gt", "gte", "lt", "lte"):
        return compared(c, value, op)
    raise ValueError(f"unknown operator {op}")


def where_predicate(where: dict, properties: str = "properties", lists: dict[str, str] | None = None) -> Column:
    """All tests of a rule's conditions.  lists: properties that hold delimited lists, and the delimiter of each."""
    tests = []
    for name, spec in where.items():
        for op, value in (spec if isinstance(spec, dict) else {"equals": spec}).items():
            c, listed = F.col(properties)[name], op == "contains" and name in (lists or {})
            tests.append(condition(F.split(c, re.escape(lists[name])) if listed else c, op, value, listed))  # type: ignore[index]
    return reduce(and_, tests, F.lit(True))


def rule_predicate(rule: Rule, lists: dict[str, str] | None = None) -> Column:
    """Whether a fact (entity_type, properties, relations with their counts) meets a rule."""
    count = lambda rel: F.coalesce(F.col("relations")[rel], F.lit(0))
    test = (F.col("entity_type") == rule.entity) & where_predicate(rule.where, lists=lists)
    if rule.with_relation:
        test = test & (count(rule.with_relation) >= rule.min_count)
    if rule.without_relation:
        test = test & (count(rule.without_relation) == 0)
    return test


def named(pack: list[Rule]) -> tuple[list[str], list[str]]:
    """Labels and relations that a pack of rules reads."""
    relations = {x for r in pack for x in (r.with_relation, r.without_relation) if x}
    return sorted({r.entity for r in pack}), sorted(relations)


def matches(facts: DataFrame, rules: list[Rule], lists: dict[str, str] | None = None) -> DataFrame:
    """(rule_id, entity_type, entity_id, scope columns…) of every rule that a fact meets, in one pass over the facts."""
    hits = F.filter(F.array(*[F.when(rule_predicate(r, lists), F.lit(r.rule_id)) for r in rules]), lambda x: x.isNotNull())
    rest = [c for c in facts.columns if c not in ("properties", "relations")]
    return facts.select(*rest, F.explode(hits).alias("rule_id"))


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.severity, SEVERITIES.index(r.severity), r.rationale) for r in rules], "rule_id string, severity string, rank int, rationale string")


# Conditions that hold where a property is missing; they are told by the facts that break them.
ABSENT_HOLDS = ("not_equals", "not_in", "no_relation", "absent")
CONDITION_ROWS = "rule_id string, entity string, name string, op string, value string, number double"


def condition_rows(spark, rules: list[Rule], lists: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A pack as data: rules (rule_id, entity, needed) and conditions, a row a value.

    needed is how many of a rule's conditions facts must meet; the others must not be broken.  Conditions on equality have
    a row a value, which facts join by it, and the others one row of the property.
    """
    rows, heads = [], []
    for r in rules:
        needed = 0
        for name, spec in r.where.items():
            for op, value in (spec if isinstance(spec, dict) else {"equals": spec}).items():
                condition(F.lit(None), op, value)  # an unknown operator fails here
                op = {(True): "present", False: "absent"}[bool(value)] if op == "exists" else "holds" if op == "contains" and name in (lists or {}) else op
                values = sorted({folded(v) for v in (value if op in ("in", "not_in") else [value])})
                needed += op not in ABSENT_HOLDS
                rows += [(r.rule_id, r.entity, name, op, v, float(value) if op in ("gt", "gte", "lt", "lte") else None) for v in values]
        if r.with_relation and r.min_count > 0:
            needed += 1
            rows.append((r.rule_id, r.entity, r.with_relation, "relation", None, float(r.min_count)))
        if r.without_relation:
            rows.append((r.rule_id, r.entity, r.without_relation, "no_relation", None, None))
        heads.append((r.rule_id, r.entity, needed))
    return spark.createDataFrame(heads, "rule_id string, entity string, needed long"), spark.createDataFrame(rows, CONDITION_ROWS)


def row_matches(facts: DataFrame, heads: DataFrame, conditions: DataFrame, lists: dict[str, str] | None = None) -> DataFrame:
    """What matches() gives, with the rules as tables: facts meet conditions in joins on label and property, so that a pack
    may have any number of rules.

    Facts are exploded into their properties.  Equality, membership and their opposites join by the folded value too; only
    comparisons, substrings and presence meet every value of their property.  A rule fires where a fact meets as many of its
    conditions as it needs and breaks none; rules that need none are tried on all entities of their label.
    """
    scope = [c for c in facts.columns if c not in ("properties", "relations")]
    facts = stored(facts)  # read once by each kind of condition
    held = F.map_filter(F.col("properties"), lambda _, v: v.isNotNull())
    each = facts.select(*scope, F.explode(held).alias("name", "value")).withColumn("low", F.lower("value"))
    on = [F.col("entity_type") == F.col("entity"), F.col("name") == F.col("c_name")]
    c = conditions.select("rule_id", "entity", F.col("name").alias("c_name"), "op", F.col("value").alias("c_value"), "number")
    verdict_of = lambda hit: F.struct("rule_id", F.concat_ws("\u0001", "op", "c_name", F.when(F.col("op").isin("in", "not_in"), F.lit("")).otherwise(F.coalesce("c_value", F.lit("")))).alias("condition"), F.col("op").isin(*ABSENT_HOLDS).alias("breaks"), hit.alias("hit"))
    told = lambda rows, hit: rows.select(*scope, verdict_of(hit).alias("x")).where("x.hit")

    equal = c.where(F.col("op").isin("equals", "in", "not_equals", "not_in"))
    out = told(each.join(equal, [*on, F.col("low") == F.col("c_value")]), F.lit(True))
    number = F.col("value").try_cast("double")
    test = F.when(F.col("op") == "gt", number > F.col("number")).when(F.col("op") == "gte", number >= F.col("number")).when(F.col("op") == "lt", number < F.col("number")).when(F.col("op") == "lte", number <= F.col("number"))
    test = F.when(F.col("op").isin("present", "absent"), F.col("value") != "").when(F.col("op") == "contains", F.contains("low", F.col("c_value"))).otherwise(test & ~F.isnan(number))
    loose = c.where(F.col("op").isin("present", "absent", "contains", "gt", "gte", "lt", "lte"))
    out = out.unionByName(told(each.join(loose, on), F.coalesce(test, F.lit(False))))
    for name, mark in (lists or {}).items():
        parts = each.where(F.col("name") == name).withColumn("low", F.explode(F.array_distinct(F.split("low", re.escape(mark.lower())))))
        out = out.unionByName(told(parts.join(c.where("op = 'holds'"), [*on, F.col("low") == F.col("c_value")]), F.lit(True)))
    counted = facts.select(*scope, F.explode("relations").alias("name", "n"))
    related = c.where(F.col("op").isin("relation", "no_relation"))
    out = out.unionByName(told(counted.join(related, on), F.coalesce(F.when(F.col("op") == "relation", F.col("n") >= F.col("number")).otherwise(F.col("n") > 0), F.lit(False))))

    keys = [*scope, "rule_id"]
    # Dealt by key first: as good as all of these rows differ, and a task that counted them before would hold them all.
    met = dealt(out.select(*scope, "x.rule_id", "x.condition", "x.breaks"), facts.count(), *keys).groupBy(*keys, "condition", "breaks").agg(F.count(F.lit(1)).alias("n"))
    met = stored(met.groupBy(*keys).agg(F.count_if(~F.col("breaks")).alias("met"), F.count_if("breaks").alias("broken")))
    some = met.where("broken = 0").join(heads.where("needed > 0").select("rule_id", "needed"), "rule_id").where("met = needed")
    free = facts.select(*scope).join(heads.where("needed = 0").select("rule_id", "entity"), F.col("entity_type") == F.col("entity")).select(*keys)
    bad = met.where("broken > 0").select(*[F.col(k).alias(f"bad_{k}") for k in keys])
    free = free.join(bad, [F.col(k).eqNullSafe(F.col(f"bad_{k}")) for k in keys], "left_anti")
    return some.select(*keys).unionByName(free)


def verdict(hits: DataFrame, rules: DataFrame, scope: list[str], shown: int = 3) -> DataFrame:
    """Per scope and rule: how many entities triggered it, and the first `shown` of them by id."""
    hits = stored(hits.select(*scope, "rule_id", "entity_id"))  # read twice
    keys = [*scope, "rule_id"]
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("entity_id"))
    some = hits.select(*keys, "entity_id").distinct().withColumn("k", order).where(F.col("k") <= shown)  # cut before the shuffle
    some = some.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("examples"))
    fired = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("triggered")).join(some, keys)
    return fired.join(F.broadcast(rules), "rule_id").select(*scope, "rule_id", "severity", "rank", "rationale", "triggered", "examples")


def blocked(fired: DataFrame, scope: list[str]) -> DataFrame:
    return fired.groupBy(*scope).agg(F.max(F.col("severity") == "block").alias("blocked"), F.count(F.lit(1)).alias("rules_fired"))


def trace(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Match count of every rule, zero included."""
    return rules.join(hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")), "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("matches"))


def load_rules(documents: list[str]) -> list[Rule]:
    """Rules of JSON documents, sorted by id; unknown or missing keys, operators, severities and repeated ids are errors."""
    out: dict[str, Rule] = {}
    for text in documents:
        raw = json.loads(text)
        unknown, missing = raw.keys() - Rule.__dataclass_fields__.keys(), {"rule_id", "severity", "entity", "rationale"} - raw.keys()
        if unknown or missing:
            raise ValueError(f"unknown keys {sorted(unknown)}, missing keys {sorted(missing)}")
        rule = Rule(**raw)
        if rule.severity not in SEVERITIES or rule.rule_id in out:
            raise ValueError(f"severity or repeated id of rule {rule.rule_id}")
        where_predicate(rule.where)  # an unknown operator fails here, before any data is read
        out[rule.rule_id] = rule
    return [out[k] for k in sorted(out)]
