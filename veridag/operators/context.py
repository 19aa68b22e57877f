"""Evidence packages, grounding and the release gate: elements (package_id, element_id, kind, content, score), one package a question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridag.functions.numbers import rounded
from veridag.functions.text import citations, content_words, fingerprint, token_estimate
from veridag.operators.assembly import keyword_hits

# Penalties of degradations that undermine confidence; any other costs 0.1.
PENALTIES = {"no_context_retrieved": 1.0, "vector_retriever_unavailable": 0.5, "graph_retriever_unavailable": 0.25, "vector_collection_unavailable": 0.15, "runtime_retriever_unavailable": 0.0}
# Requests for individual treatment advice.
ADVICE = (
    r"\bshould (?:i|he|she|they|we|the patient|my)\b.*\b(take|use|start|stop|switch|dose|prescrib)",
    r"\bwhat (?:dose|dosage)\b.*\b(should|do|for me|for him|for her|for my)\b",
    r"\bis it safe for (?:me|him|her|my|the patient)\b",
    r"\bprescrib(?:e|ing) (?:for|to) (?:me|him|her|my|the patient)\b",
    r"\bhow much .* should (?:i|he|she|they|the patient) (?:take|receive)\b",
    r"\b(?:diagnose|treat) (?:me|my|him|her)\b",
    r"\bwhat treatment (?:should|do) (?:i|we|they) (?:choose|use|give)\b.*\bpatient\b",
)


def ranked(elements: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rank of each element in its package by score times its kind's weight, then id."""
    weight = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(w))])[F.col("kind")] if weights else F.lit(1.0)
    order = Window.partitionBy("package_id").orderBy(F.desc(rounded(F.col("score") * F.coalesce(weight, F.lit(1.0)), 6)), "element_id")
    return elements.withColumn("rank", F.row_number().over(order))


def deduplicated(elements: DataFrame) -> DataFrame:
    """Of elements of a package with equal fingerprints, the best ranked."""
    first = F.min("rank").over(Window.partitionBy("package_id", fingerprint(F.col("content"))))
    return elements.withColumn("first", first).where("rank = first").drop("first")


def within_budget(elements: DataFrame, budget: int) -> DataFrame:
    """Elements that fit in rank order: one that doesn't is skipped, later ones may still fit.  A package is a few rows."""
    rows = elements.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("rank", "element_id", F.col("tokens")))).alias("rows"))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).cast("long").alias("spent"), none.alias("kept"), none.alias("dropped"))

    def take(acc: Column, row: Column) -> Column:
        fits = acc["spent"] + row["tokens"] <= budget
        more = lambda name, when: F.when(when, F.concat(acc[name], F.array(row["element_id"]))).otherwise(acc[name]).alias(name)
        return F.struct(F.when(fits, acc["spent"] + row["tokens"]).otherwise(acc["spent"]).alias("spent"), more("kept", fits), more("dropped", ~fits))

    out = rows.select("package_id", F.size("rows").alias("n"), F.aggregate("rows", start, take).alias("acc"))
    return out.select("package_id", "n", F.col("acc.spent").alias("spent"), F.col("acc.kept").alias("kept"), F.col("acc.dropped").alias("dropped"))


def with_tokens(elements: DataFrame) -> DataFrame:
    return elements.withColumn("tokens", token_estimate(F.col("content")))


def cited(answers: DataFrame, elements: DataFrame) -> DataFrame:
    """(package_id, element_id, position, valid): first occurrence of each id that an answer cites, and whether it's in the package."""
    marks = answers.select("package_id", F.posexplode(F.array_distinct(citations(F.col("answer")))).alias("position", "element_id"))
    known = elements.select("package_id", "element_id").distinct().withColumn("known", F.lit(True))
    return marks.join(known, ["package_id", "element_id"], "left").select("package_id", "element_id", "position", F.coalesce("known", F.lit(False)).alias("valid"))


def overlaps(answers: DataFrame, elements: DataFrame) -> DataFrame:
    """(package_id, overlap): share of the answer's content words that the package has; 0 without either.

    Each element meets the answer's words as one row, and only words that both have become rows.
    """
    words = F.array_distinct(F.flatten(F.collect_list(content_words(F.col("answer")))))  # a package has an answer
    want = answers.groupBy("package_id").agg(words.alias("words"))
    both = F.array_intersect("words", content_words(F.col("content")))
    hit = elements.select("package_id", "content").join(want, "package_id").select("package_id", F.explode(both).alias("word")).distinct().groupBy("package_id").agg(F.count(F.lit(1)).alias("n"))
    return want.join(hit, "package_id", "left").select("package_id", F.coalesce(F.try_divide("n", F.size("words")), F.lit(0.0)).alias("overlap"))


def penalty(degradations: Column) -> Column:
    table = F.create_map(*[x for k, v in PENALTIES.items() for x in (F.lit(k), F.lit(v))])
    cost = F.aggregate(degradations, F.lit(0.0), lambda s, d: s + F.coalesce(table[F.split(d, ":")[0]], F.lit(0.1)))
    return F.least(F.coalesce(cost, F.lit(0.0)), F.lit(1.0))


def grounding(n_cited: Column, overlap: Column, fine: Column, n_fabricated: Column) -> Column:
    """Score in [0, 1] from valid citations, overlap, penalty and fabricated citations."""
    base = (0.45 * F.least(n_cited / 2.0, F.lit(1.0)) + 0.55 * overlap) * (1.0 - fine)
    return rounded(F.least(F.greatest(F.when(n_fabricated > 0, base * 0.4).otherwise(base), F.lit(0.0)), F.lit(1.0)), 3)


def advice(question: Column) -> Column:
    """Number of the first pattern of advice that a question meets, or null."""
    out = F.lit(None).cast("int")
    for k, pattern in reversed(list(enumerate(ADVICE))):
        out = F.when(F.coalesce(question, F.lit("")).rlike("(?i)" + pattern), F.lit(k)).otherwise(out)
    return out


def gate(question: Column, answer: Column, is_blocked: Column, score: Column, least: float = 0.6) -> Column:
    """What becomes of an answer: refused_advice, blocked, refused_grounding or released."""
    empty = F.trim(F.coalesce(answer, F.lit(""))) == ""
    return F.when(advice(question).isNotNull(), "refused_advice").when(is_blocked, "blocked").when(empty | (score < least), "refused_grounding").otherwise("released")


def missing_note(kinds: Column, n_dropped: Column, degradations: Column) -> Column:
    """What a package lacks: kinds of elements, sources that failed (but prior decisions), and elements over budget."""
    # The wording of the notes.
    none = F.size(kinds) == 0
    lacks = lambda kind, note: F.when(~none & ~F.array_contains(kinds, kind), note)
    told = F.filter(degradations, lambda d: F.split(d, ":")[0].isin(*PENALTIES) & ~d.startswith("runtime_retriever"))
    first = F.array(F.when(none, "no context was retrieved for this question"), lacks("graph", "no graph evidence was found"), lacks("vector", "no document evidence was found"))
    last = F.array(F.when(n_dropped > 0, F.concat(n_dropped.cast("string"), F.lit(" element(s) dropped by token budget"))))
    note = F.array_join(F.concat(F.array_compact(first), told, F.array_compact(last)), "; ")
    return F.coalesce(F.nullif(note, F.lit("")), F.lit("insufficient supporting evidence"))


def assembled(elements: DataFrame, asked: DataFrame, sources: dict[str, str], weights: dict[str, float], budget: int) -> DataFrame:
    """A package a row of asked (package_id): elements ranked over all sources, deduplicated and cut to a budget.

    sources: for each kind of element, what it is called when it gave nothing.  kept and dropped hold ids in rank order;
    degradations name the sources without elements, and that nothing was kept.
    """
    packed = within_budget(with_tokens(deduplicated(ranked(elements, weights))), budget)
    kinds = elements.groupBy("package_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))  # as many as there are sources
    none = F.array().cast("array<string>")
    rows = asked.select("package_id").distinct().join(kinds, "package_id", "left").join(packed, "package_id", "left")
    kept, kinds_ = F.coalesce("kept", none), F.coalesce("kinds", none)
    failed = [F.when(~F.array_contains(kinds_, kind), F.lit(name)) for kind, name in sources.items()]
    lost = F.array_compact(F.array(*failed, F.when(F.size(kept) == 0, F.lit("no_context_retrieved"))))
    return rows.select("package_id", kinds_.alias("kinds"), kept.alias("kept"), F.coalesce("dropped", none).alias("dropped"), F.coalesce("spent", F.lit(0)).cast("long").alias("spent"), lost.alias("degradations"))


def seeds(elements: DataFrame) -> DataFrame:
    """(package_id, curie): concepts of the elements (curies), once a package, from which the graph is searched."""
    return elements.select("package_id", F.explode("curies").alias("curie")).where("curie is not null").distinct()


def graph_elements(found: DataFrame) -> DataFrame:
    """Elements of entities (package_id, label, id, name, props, links, via): what is known of each, and its links.

    via is curie, for entities reached from a concept, or keyword.  Ids are made of keys, so that they can be cited.
    """
    filled = F.map_filter("props", lambda _, v: F.coalesce(v, F.lit("")) != "")
    detail = F.array_join(F.slice(F.transform(F.array_sort(F.map_entries(filled)), lambda e: F.concat_ws("=", e["key"], e["value"])), 1, 8), "; ")
    links = F.when(F.size("links") > 0, F.concat(F.lit(". Links: "), F.array_join("links", "; "))).otherwise("")
    text = F.concat(F.col("label"), F.lit(" "), F.coalesce("name", "id"), F.lit(". "), detail, links)
    return found.select("package_id", F.concat_ws(":", F.lit("graph"), "label", "id").alias("element_id"), F.lit("graph").alias("kind"), text.alias("content"), F.when(F.col("via") == "curie", 0.75).otherwise(0.55).alias("score"))


def keyword_elements(questions: DataFrame, nodes: DataFrame, labels: list[str], title: str, scope: str, most: int = 8) -> DataFrame:
    """Elements of the entities of some labels whose title or scope (names of properties, or "name") has any of a question's
    terms (package_id, terms): the first `most` by label and id, below those that a concept leads to."""
    of = lambda c: F.coalesce("name", F.lit("")) if c == "name" else F.coalesce(F.col("props")[c], F.lit(""))
    rows = nodes.where(F.col("label").isin(labels)).withColumn("record_id", F.concat_ws(":", "label", "id"))
    hits = keyword_hits(questions.select(F.col("package_id").alias("question_id"), "terms"), rows.select("record_id", of(title).alias("title"), of(scope).alias("scope")), most)
    found = hits.join(rows, "record_id").select(F.col("question_id").alias("package_id"), "label", "id", "name", "props", F.array().cast("array<string>").alias("links"), F.lit("keyword").alias("via"))
    return graph_elements(found)


#: What a source of elements gives; further columns are left out, and curies may be missing.
ELEMENT = ("package_id", "element_id", "kind", "content", "score", "curies")


class Retrievers:
    """Sources of elements by name, which a user adds to: each a function of the questions that gives their elements."""

    def __init__(self) -> None:
        self.sources: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, source: Callable[[DataFrame], DataFrame]) -> None:
        if name in self.sources:
            raise ValueError(f"there is a retriever {name} already")
        self.sources[name] = source

    def gathered(self, asked: DataFrame) -> tuple[DataFrame | None, dict[str, str]]:
        """Elements of all sources, and of those whose plan can't be made, why: they are degradations, and stop no other."""
        out, failed = None, {}
        for name, source in self.sources.items():
            try:
                rows = source(asked)
                rows = rows if "curies" in rows.columns else rows.withColumn("curies", F.array().cast("array<string>"))
                rows = rows.select(*ELEMENT)
            except Exception as e:  # noqa: BLE001  whatever a user's source raises belongs in the report
                failed[name] = f"{name}_retriever_unavailable: {type(e).__name__}"
                continue
            out = rows if out is None else out.unionByName(rows)
        return out, failed


def rendered(elements: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(package_id, text): the elements (rank, source) of a package as a prompt shows them, in rank order.

    Elements with curies show them; packages of asked without elements say so.
    """
    has = "curies" in elements.columns
    curies = F.when(F.size("curies") > 0, F.concat(F.lit(", curies="), F.array_join("curies", " "))).otherwise("") if has else F.lit("")
    line = F.concat(F.format_string("[%s] (%s, source=%s, score=%.3f", "element_id", "kind", "source", "score"), curies, F.lit(")\n"), "content")
    rows = elements.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("rows"))  # a package is a few rows
    out = rows.select("package_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n").alias("text"))
    if asked is None:
        return out
    return asked.select("package_id").distinct().join(out, "package_id", "left").withColumn("text", F.coalesce("text", F.lit("nothing was retrieved")))


def with_verdict(rows: DataFrame, fired: DataFrame) -> DataFrame:
    """rows with is_blocked and advisories, the warnings' rationales in order of rule, of rules fired (package_id, severity, rule_id, rationale)."""
    warned = F.array_sort(F.collect_list(F.when(F.col("severity") == "warn", F.struct("rule_id", "rationale"))))
    told = fired.groupBy("package_id").agg(F.max(F.col("severity") == "block").alias("is_blocked"), F.transform(warned, lambda r: r["rationale"]).alias("advisories"))  # a row a rule
    joined = rows.join(told, "package_id", "left")
    return joined.withColumn("is_blocked", F.coalesce("is_blocked", F.lit(False))).withColumn("advisories", F.coalesce("advisories", F.array().cast("array<string>")))


def verdict_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(package_id, before, after, score_before, score_after) of packages whose outcome or score (package_id, outcome, score) differs."""
    a = before.select("package_id", F.col("outcome").alias("before"), F.col("score").alias("score_before"))
    b = after.select("package_id", F.col("outcome").alias("after"), F.col("score").alias("score_after"))
    return a.join(b, "package_id").where("before <> after or score_before <> score_after")


def response_violations(responses: DataFrame) -> DataFrame:
    """(response_id, problem) of responses (refused, answer, reason) and of their citations (chunk_id, curie) that contradict themselves."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    problems = F.array_compact(F.array(
        F.when(F.col("refused") & F.col("answer").isNotNull(), "a refusal carries an answer"), F.when(F.col("refused") & empty("reason"), "a refusal without a reason"),
        F.when(~F.col("refused") & F.col("answer").isNull(), "no answer"), F.when(empty("chunk_id") & empty("curie"), "a citation without a target"),
    ))
    return responses.select("response_id", F.explode(problems).alias("problem"))
