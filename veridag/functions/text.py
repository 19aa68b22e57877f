"""Scalar functions on text, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in an answer.
ANSWER_STOPWORDS = (
    "the a an is are was were be been being and or but if then than that this these those of in on at to for with from by as it its "
    "which who whom what when where why how can could should would may might must not no there their they we our you your has have had do "
    "does did any all some more most other such"
).split()
# Words that carry no content in a question.
QUESTION_STOPWORDS = (
    "what which who how why when the a an is are for of in on to and or can we i do does with from about should would any there this that "
    "use used data please tell me"
).split()
# Phrases by which an answer declines, and negated evidence.
DENIALS = (
    "no information", "not available", "no data", "cannot provide", "cannot determine", "cannot answer", "does not contain", "does not mention",
    "no mention", "not mentioned", "is not specified", "not specified", "insufficient", "unable to", "there is no", "no such",
    "not present in the context", "context does not",
)
NEGATED_EVIDENCE = (
    r"\b(?:no|not any|none)\b[^.]{0,60}?\b(?:mentioned|available|found|exists|present|recorded|specified|listed|included|provided|referenced|documented)\b"
)
# The pattern of entity ids in a question, and the label of each prefix.
ENTITY_ID = r"\b(PAT\d+|D\d{3}|DIS\d+|CT\d+|AE\d+|B\d{3}|G\d{3}|P\d{3}|POL[_A-Z0-9]*)\b"
ID_LABELS = (("PAT", "Patient"), ("DIS", "Disease"), ("CT", "ClinicalTrial"), ("AE", "AdverseEvent"), ("POL", "DataGovernancePolicy"), ("D", "Drug"), ("B", "Biomarker"), ("G", "Gene"), ("P", "Protein"))
# What a citation and a numeric head look like.
CITATION = r"\[([A-Za-z0-9_.:\-]+)\]"
NUMERIC_HEAD = r"^[-0-9.,eE \n]+$"


def verdict_first_line(text: Column, chars: int = 150) -> Column:
    """PASS or FAIL in the first line, else in the first chars characters, else UNCLEAR; null is UNCLEAR."""
    found = F.lit("UNCLEAR")
    for head in (F.upper(F.substring(text, 1, chars)), F.upper(F.split(F.trim(text), "\n")[0])):
        found = F.when(head.contains("PASS"), "PASS").when(head.contains("FAIL"), "FAIL").otherwise(found)
    return found


def verdict_strict(text: Column) -> Column:
    """PASS if the text starts so, else FAIL."""
    return F.when(F.upper(F.trim(text)).startswith("PASS"), "PASS").otherwise("FAIL")


def verdict_line_only(text: Column) -> Column:
    """PASS or FAIL in the first line alone, else UNCLEAR."""
    return verdict_first_line(text, 0)


def snake_to_camel(name: Column) -> Column:
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30))))
    return F.concat(parts[0], F.array_join(rest, ""))


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_"))


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text, trimmed, folded and with white space collapsed."""
    return F.substring(F.sha2(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), 256), 1, 16)


def short_id(*parts: Column | str, digits: int = 12) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits)


def long_id(*parts: Column | str, digits: int = 20) -> Column:
    """First hex digits of the SHA-256 of the parts, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits)


def sorted_json(payload: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(payload))))


def parsed_time(text: Column) -> Column:
    """An ISO date or date with time, null if it is none: such rows belong in quarantine, not at the present moment."""
    return F.trim(text).try_cast("timestamp")


def iri_slug(text: Column, most: int = 96) -> Column:
    """Letters, digits, dots, underscores and single dashes, at most `most` of them; null or empty is "unknown"."""
    dashed = F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "-")
    slug = F.substring(F.regexp_replace(F.regexp_replace(dashed, "-{2,}", "-"), "^-|-$", ""), 1, most)
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


def mint_iri(base: str, kind: Column, key: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), iri_slug(kind), F.lit("/"), iri_slug(key))


def bare_words(text: Column, marks: str) -> Column:
    """Folded words without the given marks at their ends."""
    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit(marks)))


def content_words(text: Column) -> Column:
    """Distinct words of more than three letters that are no stop words."""
    words = bare_words(text, ".,;:!?()[]'\"")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(ANSWER_STOPWORDS)))


def question_terms(text: Column, most: int = 8) -> Column:
    words = bare_words(text, ".,?!:;()'\"")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(QUESTION_STOPWORDS)), 1, most)


def citations(text: Column) -> Column:
    """Ids in brackets, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1))


def entity_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY_ID), F.lit(1)))


def id_label(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, label in reversed(ID_LABELS):
        out = F.when(token.startswith(prefix) if len(prefix) > 1 else token.rlike(rf"^{prefix}\d{{3}}$"), label).otherwise(out)
    return out


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def declines(text: Column) -> Column:
    """Whether an answer declines in substance: blank, or a denial or negated evidence in its first 400 characters."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 400))
    return (F.trim(head) == "") | head.rlike("|".join(DENIALS)) | head.rlike(NEGATED_EVIDENCE)


def mentions_all(text: Column, needles: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.forall(needles, lambda n: F.contains(low, F.lower(n)))


def forbidden_mentions(text: Column, needles: Column) -> Column:
    """The needles that the text asserts: none if it declines."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(declines(text), F.array().cast("array<string>")).otherwise(F.filter(needles, lambda n: F.contains(low, F.lower(n))))


# Words that begin sentences or name kinds, and no concept.
SPAN_NOISE = (
    "the this that these those policy drug disease gene protein patient trial adverse event biomarker research paper published approval status "
    "treats targets mechanism clinical based context answer note scope owner category phase sponsor enrollment severity frequency reported "
    "trials none recorded unknown unspecified medication indicated quality governance biomedical data table layer hub"
).split()
# What a mention looks like.
MENTION = r"\b[A-Z][A-Za-z0-9\-]+(?:\s+[A-Z][A-Za-z0-9\-]+){0,3}\b|\([a-z][a-z0-9\- ]{3,}\)"


def candidate_mentions(text: Column, least: int = 3) -> Column:
    """(surface, start, end) of capitalised phrases and of lower-case ones in parentheses, without those of noise words
    alone; each surface once, whatever its case, where it is first."""
    whole = F.coalesce(text, F.lit(""))
    found, gaps = F.regexp_extract_all(whole, F.lit(MENTION), F.lit(0)), F.split(whole, MENTION, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("n")))
    kind = "struct<at:int,out:array<struct<surface:string,start:int,end:int>>>"

    def step(acc: Column, x: Column) -> Column:
        start, inner = acc["at"] + x["n"], x["m"].startswith("(")
        surface = F.trim(F.when(inner, F.substring(x["m"], F.lit(2), F.length(x["m"]) - 2)).otherwise(x["m"]))
        begin = start + inner.cast("int")
        words = F.split(F.lower(surface), r"\s+")
        noise = F.forall(words, lambda w: w.isin(*SPAN_NOISE)) | (F.length(surface) < least) | F.exists(acc["out"], lambda o: F.lower(o["surface"]) == F.lower(surface))
        more = F.concat(acc["out"], F.array(F.struct(surface.alias("surface"), begin.alias("start"), (begin + F.length(surface)).alias("end"))))
        return F.struct((start + F.length(x["m"])).alias("at"), F.when(noise, acc["out"]).otherwise(more).alias("out")).cast(kind)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<surface:string,start:int,end:int>>").alias("out")).cast(kind)
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def candidate_spans(text: Column, least: int = 3) -> Column:
    """Distinct capitalised phrases of up to four words, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z][A-Za-z0-9\-]+(?:\s+[A-Z][A-Za-z0-9\-]+){0,3})\b"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda s: F.length(s) >= least))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
