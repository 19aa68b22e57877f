"""Queries of scalar text functions, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridag.functions import text
from veridag.plans.model import table
from veridag.plans.registry import query

QSTOP = ", ".join(f"'{w}'" for w in text.QUESTION_STOPWORDS)
ASTOP = ", ".join(f"'{w}'" for w in text.ANSWER_STOPWORDS)
WORDS = "list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: trim(w, '{0}'))"


@query("SELECT doc_id, substr(sha256(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')), 1, 16) AS print, greatest(1, length(text) // 4) AS tokens, substr(md5(source || ':' || doc_id), 1, 12) AS id FROM documents")
def fingerprints(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.fingerprint(F.col("text")).alias("print"), text.token_estimate(F.col("text")).alias("tokens"), text.short_id("source", F.col("doc_id").cast("string")).alias("id"))


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pass, ' || text WHEN 1 THEN text || chr(10) || 'FAIL' WHEN 2 THEN 'Verdict: fail' || chr(10) || text ELSE text END AS reply FROM documents),
u AS (SELECT doc_id, upper(string_split(trim(reply), chr(10))[1]) AS a, upper(substr(reply, 1, 150)) AS b, upper(trim(reply)) AS c FROM d)
SELECT doc_id, CASE WHEN contains(a, 'PASS') THEN 'PASS' WHEN contains(a, 'FAIL') THEN 'FAIL' WHEN contains(b, 'PASS') THEN 'PASS' WHEN contains(b, 'FAIL') THEN 'FAIL' ELSE 'UNCLEAR' END AS first_line, CASE WHEN starts_with(c, 'PASS') THEN 'PASS' ELSE 'FAIL' END AS strict FROM u""")
def verdict_parse(spark, sf_dir):
    i, t = F.col("doc_id") % 4, F.col("text")
    reply = F.when(i == 0, F.concat(F.lit("pass, "), t)).when(i == 1, F.concat(t, F.lit("\nFAIL"))).when(i == 2, F.concat(F.lit("Verdict: fail\n"), t)).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", text.verdict_first_line(reply).alias("first_line"), text.verdict_strict(reply).alias("strict"))


@query("""WITH s AS (SELECT page_id, url, regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '-', 'g') AS d FROM pages), t AS (SELECT page_id, substr(regexp_replace(regexp_replace(d, '-{2,}', '-', 'g'), '^-|-$', '', 'g'), 1, 96) AS slug FROM s)
SELECT page_id, 'urn:x/page/' || coalesce(nullif(slug, ''), 'unknown') AS iri FROM t""")
def iri_mint(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.mint_iri("urn:x/", F.lit("page"), F.col("url")).alias("iri"))


@query(f"""SELECT doc_id, len(list_distinct(list_filter({WORDS.format(".,;:!?()[]''\"")}, lambda w: length(w) > 3 AND w NOT IN ({ASTOP})))) AS content_words,
  array_to_string(list_filter({WORDS.format(".,?!:;()''\"")}, lambda w: length(w) > 3 AND w NOT IN ({QSTOP}))[1:8], ' ') AS terms FROM documents""")
def words_of_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(text.content_words(F.col("text"))).cast("long").alias("content_words"), F.array_join(text.question_terms(F.col("text")), " ").alias("terms"))


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'There is no data on this. ' || text WHEN 1 THEN 'None of the trials was found in ' || text ELSE text END AS reply FROM conversations), h AS (SELECT *, lower(substr(reply, 1, 400)) AS head FROM c)
SELECT conv_id, turn, trim(head) = '' OR regexp_matches(head, '{0}') OR regexp_matches(head, '{1}') AS declines FROM h""".format("|".join(text.DENIALS), text.NEGATED_EVIDENCE))
def refusal_test(spark, sf_dir):
    i, t = F.col("turn") % 3, F.col("text")
    reply = F.when(i == 0, F.concat(F.lit("There is no data on this. "), t)).when(i == 1, F.concat(F.lit("None of the trials was found in "), t)).otherwise(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.declines(reply).alias("declines"))


@query("""SELECT conv_id, turn, contains(lower(text), 'the') AND contains(lower(text), 'on') AS mentions, list_aggregate(list_filter(['THE', 'zebra', 'De'], lambda n: contains(lower(text), lower(n))), 'string_agg', ',') AS forbidden FROM conversations""")
def mention_test(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    found = F.array_join(text.forbidden_mentions(F.col("text"), F.array(F.lit("THE"), F.lit("zebra"), F.lit("De"))), ",")
    return c.select("conv_id", "turn", text.mentions_all(F.col("text"), F.array(F.lit("the"), F.lit("ON"))).alias("mentions"), F.nullif(found, F.lit("")).alias("forbidden"))


@query("""WITH e AS (SELECT event_id, 'see PAT' || user_id || ', D' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || ' and CT' || (event_id % 7) || ' or B12 or POL_X1' AS t FROM events), m AS (SELECT event_id, unnest(list_distinct(regexp_extract_all(t, '\\b(PAT\\d+|D\\d{3}|DIS\\d+|CT\\d+|AE\\d+|B\\d{3}|G\\d{3}|P\\d{3}|POL[_A-Z0-9]*)\\b', 1))) AS id FROM e)
SELECT event_id, id, CASE WHEN starts_with(id, 'PAT') THEN 'Patient' WHEN starts_with(id, 'CT') THEN 'ClinicalTrial' WHEN starts_with(id, 'POL') THEN 'DataGovernancePolicy' ELSE 'Drug' END AS label FROM m""")
def entity_ids(spark, sf_dir):
    i = F.col("event_id")
    t = F.concat(F.lit("see PAT"), F.col("user_id").cast("string"), F.lit(", D"), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit(" and CT"), (i % 7).cast("string"), F.lit(" or B12 or POL_X1"))
    ids = table(spark, sf_dir, "events").select("event_id", F.explode(text.entity_ids(t)).alias("id"))
    return ids.select("event_id", "id", text.id_label(F.col("id")).alias("label"))


@query("""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '\\b([A-Z][A-Za-z0-9\\-]+(?:\\s+[A-Z][A-Za-z0-9\\-]+){0,3})\\b', 1)), lambda s: length(s) >= 3)) AS spans FROM documents""")
def candidate_spans(spark, sf_dir):
    """The oracle's word boundary is that of ASCII, so it sees letters beyond it as underscores."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.candidate_spans(F.col("text"))).cast("long").alias("spans"))


@query("SELECT o_orderkey, list_contains(string_split(o_orderpriority || ';' || o_orderstatus, ';'), 'O') AS open, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, ''), o_orderpriority) AS display FROM orders")
def list_membership(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus"))
    joined = F.concat_ws(";", "o_orderpriority", "o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_contains(F.split(joined, ";"), "O").alias("open"), text.first_filled(status, F.col("o_orderpriority")).alias("display"))
