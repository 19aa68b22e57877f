"""Shape validation: a table of constraints against nodes, one pass for all constraints of a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridag.functions.text import snake_to_camel

NUMERIC = ("integer", "decimal", "float", "double")


def violation(value: Column, kind: str, limit: object) -> Column:
    """Whether a value (string, or null; values of a list are parted by semicolons) breaks a constraint of a kind:
    min_count, max_count, datatype, in, max_length."""
    held = value.isNotNull() & (value != "")
    if kind == "min_count":
        return ~held if int(limit) > 0 else F.lit(False)  # type: ignore[call-overload]
    if kind == "max_count":
        return held & (F.size(F.split(value, ";")) > int(limit))  # type: ignore[call-overload]
    if kind == "datatype":
        return held & value.try_cast("double").isNull() if limit in NUMERIC else F.lit(False)
    if kind == "in":
        return held & ~value.isin(list(limit))  # type: ignore[call-overload]
    if kind == "max_length":
        return held & (F.length(value) > int(limit))  # type: ignore[call-overload]
    raise ValueError(kind)


def violations(nodes: DataFrame, constraints: list[tuple[str, str, str, object]], aliases: dict[str, str] | None = None) -> DataFrame:
    """(label, id, path, constraint) of each broken (class, path, kind, limit); class names match whatever their case.

    aliases maps a declared path to the property that holds it.  A class without constraints conforms.
    """
    props = lambda path: F.col("props")[(aliases or {}).get(path, path)]
    checks = F.array(*[
        F.when((F.lower("label") == cls.lower()) & violation(props(path), kind, limit), F.struct(F.lit(path).alias("path"), F.lit(kind).alias("constraint"))) for cls, path, kind, limit in constraints
    ])
    return nodes.select("label", "id", F.inline(F.filter(checks, lambda x: x.isNotNull())))


def conformance(nodes: DataFrame, broken: DataFrame) -> DataFrame:
    bad = broken.select("label", "id").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("violating"))
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("nodes")).join(bad, "label", "left").select("label", "nodes", F.coalesce("violating", F.lit(0)).alias("violating"))


def miscased(constraints: list[tuple[str, str, str, object]], labels: list[str]) -> list[tuple[str, str]]:
    """(target, label) of constraint classes that are a label but for their case."""
    folded = {x.lower(): x for x in labels}
    return sorted({(cls, folded[cls.lower()]) for cls, *_ in constraints if folded.get(cls.lower(), cls) != cls})


# Levels of a policy's enforcement.
ENFORCEMENT_LEVELS = ("Mandatory", "Advisory", "Informational")


def policy_violations(policies: DataFrame) -> DataFrame:
    """(policy_id, problem) of policies without id, name or jurisdiction, or with an unknown enforcement level."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    level = ~F.coalesce(F.col("enforcement_level").isin(*ENFORCEMENT_LEVELS), F.lit(False))
    problems = [F.when(empty(c), F.lit(f"{c} is required")) for c in ("policy_id", "policy_name", "jurisdiction")] + [F.when(level, F.lit("unknown enforcement_level"))]
    return policies.select("policy_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def unmapped(nodes: DataFrame, declared: dict[str, set[str]], skipped: set[str]) -> DataFrame:
    """(label, key, n) of properties that no constraint declares."""
    known = F.create_map(*[x for label, keys in declared.items() for x in (F.lit(label), F.array(*[F.lit(k) for k in sorted(keys | skipped)]))])
    keys = nodes.select("label", F.explode(F.map_keys("props")).alias("key"))
    return keys.where(~F.coalesce(F.array_contains(known[F.col("label")], F.col("key")), F.lit(False))).groupBy("label", "key").agg(F.count(F.lit(1)).alias("n"))


def bridged(nodes: DataFrame, declared: DataFrame, aliases: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """(label, key, path, n): for the properties of nodes, the declared path of their class that holds them, null if none.

    declared: (label, path); aliases: (label, key, path).  Candidates are the alias, the name in camel case and the name as
    it is, the first of them that is declared; classes match whatever their case.  Empty values and skipped keys don't count.
    """
    filled = F.map_filter("props", lambda k, v: (F.coalesce(v, F.lit("")) != "") & ~k.isin(*skipped))
    keys = nodes.select("label", F.explode(F.map_keys(filled)).alias("key")).groupBy("label", "key").agg(F.count(F.lit(1)).alias("n"))
    low = lambda df: df.withColumn("low", F.lower("label")).drop("label")
    of = low(aliases).withColumnRenamed("path", "alias")
    named = keys.withColumn("low", F.lower("label")).join(of, ["low", "key"], "left")
    tried = named.select("label", "low", "key", "n", F.posexplode(F.array("alias", snake_to_camel(F.col("key")), "key")).alias("k", "path"))
    known = tried.join(low(declared).distinct(), ["low", "path"], "left_semi").groupBy("label", "key").agg(F.min_by("path", "k").alias("path"))
    return keys.join(known, ["label", "key"], "left").select("label", "key", "path", "n")
