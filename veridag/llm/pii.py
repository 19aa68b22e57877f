"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base patterns give seed identifiers.  The words around seeds are lexical patterns; patterns and instances score each
other over their graph in a few rounds of joins, and instances that only trusted patterns surround become new spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridag.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: What seeds are of: the kinds of personal data, and secrets, which have columns of their own.
SEEDED = (*KINDS, "secret")
# The contract's patterns.  A match can only begin at the head of a run of its first class or where the last match ended,
# which the look-behind states, and nothing after a possessive part could give way: same matches, in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Secrets that tell themselves: a cloud key's form, or a value with a digit that is assigned to a credential's name.
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=(?i:password|passwd|pwd|secret|token|api_?key|access_?key)[\x20]{0,2}[=:][\x20]{0,2}[\"']?)(?=[A-Za-z+/_.-]*[0-9])[A-Za-z0-9+/_.-]{8,}+)"
#: What those patterns may miss: numbers with separators, addresses without a dotted host or with a spelt-out at, and codes.
LOOSE = {
    "number": r"(?<![A-Za-z0-9._%+@-])\+?[0-9][0-9().\x20-]*[0-9](?![A-Za-z0-9@_%+-])",
    "handle": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]{2,64}+(?:\.[A-Za-z0-9-]++)*+",
    "code": r"(?<![A-Za-z0-9+/_=.@-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{12,}+(?![@.][A-Za-z0-9])",
}
GATES = {
    "email": r"@", "handle": r"@|at[\])]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "number": r"[0-9]", "secret": r"AKIA|[=:]", "code": r"[A-Za-z+/_-][0-9]|[0-9][A-Za-z+/_-]",
}
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    return {"email": F.lit(True), "secret": F.lit(True), "ip": value.rlike(OCTETS), "card": n.between(13, 19) & F.coalesce(F.call_function("luhn_check", F.when(n.between(13, 19), digits(value))), F.lit(False)), "phone": n.between(9, 15)}[kind]


def valid_of(kind: str):
    return lambda span: valid(kind, span["value"])


def with_matches(df: DataFrame, patterns: dict[str, str], text: Column) -> DataFrame:
    """Adds {name}_m, the matches, {name}_g, the text between them, and {name}_e, where each match ends; all empty where what
    every match has is missing."""
    none = F.array().cast("array<string>")
    for name, pattern in patterns.items():
        gate = text.rlike(GATES[name])
        df = df.withColumn(f"{name}_m", F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
        df = df.withColumn(f"{name}_g", F.when(gate, F.split(text, pattern, -1)).otherwise(none))
    kept = df.columns
    for name in patterns:
        m, g = F.col(f"{name}_m"), F.col(f"{name}_g")
        df = df.withColumn(f"{name}_n", F.zip_with(F.slice(g, 1, F.size(m)), m, lambda x, y: F.length(x) + F.length(y)))
    return df.select(*kept, *[running_sums(F.col(f"{name}_n")).alias(f"{name}_e") for name in patterns])


def running_sums(n: Column, chunk: int = 256) -> Column:
    """Sums of an array up to each element.  A fold copies what it has with every step; so sums are made in chunks, and what
    is before each chunk by a fold over the chunks alone."""
    each = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(n) / chunk).cast("int") - 1, F.lit(0)))
    part = lambda k: F.slice(n, k * chunk + 1, chunk)
    add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    sums = F.transform(each, lambda k: F.struct(k.alias("k"), F.aggregate(part(k), F.lit(0), lambda s, x: s + x).alias("sum")))
    ends = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<k:int,before:int>>").alias("out")), lambda acc, x: F.struct((acc["at"] + x["sum"]).alias("at"), F.concat(acc["out"], F.array(F.struct(x["k"].alias("k"), acc["at"].alias("before")))).alias("out")), lambda acc: acc["out"])
    return F.flatten(F.transform(ends, lambda c: F.aggregate(part(c["k"]), start(c["before"]), add, lambda acc: acc["out"])))


def spans(name: str) -> Column:
    """Start and end in code points, value, and the two words on either side, of each match."""
    m, g, e = F.col(f"{name}_m"), F.col(f"{name}_g"), F.col(f"{name}_e")
    left = F.transform(F.slice(g, 1, F.size(m)), lambda x: F.lower(F.regexp_extract(F.substring(x, -80, 80), r"(\S+\s+\S+)\s*$", 1)))
    right = F.transform(F.slice(g, 2, F.size(m)), lambda x: F.lower(F.regexp_extract(F.substring(x, 1, 80), r"^\s*(\S+\s+\S+)", 1)))
    return F.transform(F.arrays_zip(m.alias("m"), e.alias("e"), left.alias("l"), right.alias("r")), lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), x["m"].alias("value"), x["l"].alias("left"), x["r"].alias("right")))


def mask(name: str) -> Column:
    """A byte a code point up to the last match: 1 in valid matches, else 0; null without matches."""
    m, g = F.col(f"{name}_m"), F.col(f"{name}_g")
    parts = F.zip_with(F.slice(g, 1, F.size(m)), m, lambda x, y: F.concat(F.repeat(F.lit("0"), F.length(x)), F.repeat(F.when(valid(name, y), "1").otherwise("0"), F.length(y))))
    return F.when(F.size(m) > 0, F.array_join(parts, "").cast("binary"))


def touches(masks: list[str], s: Column) -> Column:
    """Whether a span has a code point that any of the masks marks."""
    return reduce(lambda x, y: x | y, [F.coalesce(F.contains(F.substring(F.col(c), s["start"] + 1, s["end"] - s["start"]), F.lit(b"1")), F.lit(False)) for c in masks])


def tagged(kind: str, found: Column) -> Column:
    return F.transform(found, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def patterns_of(s: Column) -> Column:
    """Lexical patterns of an occurrence: two words before, two words after, the word on either side, and a name with signs
    that touch the occurrence, as in an assignment."""
    left, right = F.regexp_replace(s["left"], "[0-9]", "0"), F.regexp_replace(s["right"], "[0-9]", "0")
    near = F.concat_ws(" _ ", F.regexp_extract(left, r"(\S+)$", 1), F.regexp_extract(right, r"^(\S+)", 1))
    touching = F.regexp_extract(left, r"([a-z_]+\s?[=:]\s?[\"']?)$", 1)
    return F.filter(F.array(F.concat(F.lit("L "), left), F.concat(F.lit("R "), right), F.concat(F.lit("C "), near), F.concat(F.lit("T "), touching)), lambda p: F.length(p) > 6)


def fits(shape: Column, value: Column, kind: Column) -> Column:
    """Whether an unseen value has a shape that an identifier of this kind could have."""
    n = F.length(digits(value))
    number = ((kind == "phone") & n.between(7, 15)) | ((kind == "card") & n.between(12, 19)) | ((kind == "ip") & value.rlike(r"^[0-9]+(\.[0-9]+){3}$"))
    return F.when(shape == "handle", kind == "email").when(shape == "code", kind == "secret").otherwise(number)


def discovered(seen: DataFrame, rounds: int, min_support: int, min_pattern: float, min_instance: float, min_share: float) -> DataFrame:
    """(value, kind) of unseen identifiers.  seen: an occurrence a row with value, seed (its kind or null), shape, patterns.

    Against a pattern count the seeds of other kinds and what can't be of its kind; a value that fits is unknown, and says
    nothing until it is found.  What is found with confidence supports further patterns in the next round, as seeds do.
    """
    edges = stored(seen.select("value", "seed", "shape", F.explode("patterns").alias("pattern")).groupBy("value", "seed", "shape", "pattern").agg(F.count(F.lit(1)).alias("n")))
    fit = lambda k: F.col("seed").isNull() & F.coalesce(fits(F.col("shape"), F.col("value"), F.lit(k)), F.lit(False))
    # A row a pattern: how many values it has, and of each kind how many seeds and how many that might be one.
    around = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("degree"), *[F.count_if((F.col("seed") == k) | fit(k)).alias(f"may_{k}") for k in SEEDED])
    around = stored(around.select("pattern", "degree", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"may_{k}").alias("may")) for k in SEEDED])).alias("x")).select("pattern", "degree", "x.kind", "x.may").where("may > 0"))
    unseen = edges.where("seed is null").select("value", "shape", "pattern")
    reach = stored(unseen.groupBy("value", "shape").agg(F.count(F.lit(1)).alias("reach")))
    seeds = edges.where("seed is not null").select("value", "pattern", F.col("seed").alias("kind"), F.lit(1.0).alias("r"), F.lit(1).alias("support"))
    votes, instances = seeds, None
    for _ in range(rounds):
        scored = stored(votes.groupBy("pattern", "kind").agg(F.sum("r").alias("mass"), F.sum("support").alias("support"))).join(around, ["pattern", "kind"])
        pure = F.col("mass") / (F.col("mass") + F.col("degree") - F.col("may"))
        scored = scored.withColumn("pure", pure).withColumn("score", pure * F.col("support") / (F.col("support") + 1.0))
        # Stored, as all aggregates here that are joined: so the join sees plain shuffles and can split a hot pattern or value.
        trusted = stored(scored.where((F.col("support") >= min_support) & (F.col("pure") >= min_pattern) & (F.col("support") >= min_share * F.col("may"))).select("pattern", "kind", "score"))
        near = unseen.join(trusted, "pattern").where(fits(F.col("shape"), F.col("value"), F.col("kind")))
        instances = near.groupBy("value", "shape", "kind").agg(F.sum("score").alias("score")).join(reach, ["value", "shape"])
        instances = stored(instances.select("value", "shape", "kind", (F.col("score") / F.col("reach")).alias("r")))
        again = instances.join(unseen, ["value", "shape"]).select("value", "pattern", "kind", "r", (F.col("r") >= min_instance).cast("int").alias("support"))
        votes = seeds.unionByName(again)
    best = instances.where(F.col("r") >= min_instance).groupBy("value", "shape").agg(F.max(F.struct("r", "kind")).alias("top"))
    return stored(best.select("value", "shape", F.col("top.kind").alias("kind")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_support: int = 3, min_pattern: float = 0.8, min_instance: float = 0.3, min_share: float = 0.1) -> DataFrame:
    """A row per row of docs: id, base and all spans as arrays of "kind:start:end", the number of base spans by kind, and
    the spans of secrets with their number.

    Base spans are the valid leftmost matches of BASE; SECRET gives the seeds of secrets.  A pattern is trusted for a kind
    when at least min_support distinct values of the kind have it, seeds or found with confidence in the round before, they
    are at least min_share of the values with it that could be of the kind, and their mass is at least min_pattern of
    itself and the values that can't; an unseen value of a fitting shape becomes a span of a kind when the mean score of its
    patterns is at least min_instance.  Added spans overlap no seed's span.  Null or empty text has no spans.  Rows may
    repeat ids: each gets the spans of its own text.  Of kinds with equal scores, the last by name has the value.  Other
    columns are not carried.  An empty table gives an empty table.
    """
    text = F.col("text")
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = with_matches(read, BASE | {"secret": SECRET} | LOOSE, text)
    # Of all text only arrays and masks go on; loose matches on a seed's place are dropped by the masks.
    masks = [f"mask_{k}" for k in SEEDED]
    found = found.select("id", F.xxhash64("text").alias("row_hash"), *[spans(name).alias(name) for name in [*SEEDED, *LOOSE]], *[mask(k).alias(f"mask_{k}") for k in SEEDED])
    clear = [F.filter(k, lambda s: ~touches(masks, s)).alias(k) for k in LOOSE]
    found = stored(found.select("id", "row_hash", *[F.filter(k, valid_of(k)).alias(k) for k in SEEDED], *clear))

    def seen(name: str, seed: Column) -> DataFrame:
        return found.select("id", "row_hash", F.lit(name).alias("shape"), seed.alias("seed"), F.explode(name).alias("s")).select("id", "row_hash", "shape", "seed", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), patterns_of(F.col("s")).alias("patterns"))

    loose = reduce(DataFrame.unionByName, [seen(k, F.lit(None).cast("string")) for k in LOOSE])
    seeds = reduce(DataFrame.unionByName, [seen(k, F.lit(k)) for k in SEEDED])
    new = loose.join(discovered(seeds.unionByName(loose), rounds, min_support, min_pattern, min_instance, min_share), ["value", "shape"])
    added = new.groupBy("id", "row_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added")).select(F.col("id").alias("added_id"), F.col("row_hash").alias("added_hash"), "added")
    rows = found.join(added, F.col("id").eqNullSafe(F.col("added_id")) & (F.col("row_hash") == F.col("added_hash")), "left")

    def with_added(kind: str) -> Column:
        own = F.filter(F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda a: a["kind"] == kind)
        plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return tagged(kind, F.array_sort(F.concat(plain(F.col(kind)), plain(own))))

    secrets = with_added("secret")
    return rows.select(
        F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.concat(*[tagged(k, F.col(k)) for k in KINDS]).alias("base_spans"), F.concat(*[with_added(k) for k in KINDS]).alias("spans"),
        F.size(secrets).cast("long").alias("n_secret"), secrets.alias("secret_spans"),
    )
