"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridag.llm import chat, langid, pieces, warc
from veridag.llm.boilerplate import extract_main_text
from veridag.llm.common import LOWER, UPPER, stored, table
from veridag.llm.decontam import find_leaks
from veridag.llm.divergence import audit_sources
from veridag.llm.jaccard import near_duplicates
from veridag.llm.linededup import drop_shared_lines
from veridag.llm.multiindex import near_vectors
from veridag.llm.pii import find_pii
from veridag.llm.sharding import shard_rows
from veridag.llm.trie import prefix_trie
from veridag.llm.turns import ordered_turns

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in ("email", "ip", "card", "phone")]
    whole = [F.sha2(F.array_join("base_spans", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans")]
    more = ["n_secret", F.array_join("secret_spans", ",").alias("secret_spans"), (F.size("spans") + F.size("secret_spans")).cast("long").alias("n_found")]
    return found.select("doc_id", *counts, *whole, *more)


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_main_text(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_markup", "n_repeated", "n_beside")


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_rows(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), ngram=3, num=90, den=100)


@query
def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    index = warc.write_bundles(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.read_bundles(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op5_warc_bundles"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, list_aggregate(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)),
        'string_agg', '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("lcs", 4).alias("lcs"), "answer")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op9_line_dedup"] = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM split),
keyed AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT y.doc_id, y.pos, y.line, s.k IS NOT NULL AND y.doc_id <> s.keeper AS goes FROM keyed y LEFT JOIN shared s ON y.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = table(spark, sf_dir, "documents"), pieces.read_model()
    coded = pieces.decode_pieces(pieces.encode_pieces(docs, model), model)
    # The hash of the decoded text shows the round trip: it equals that of the text.
    return coded.select("doc_id", "n_pieces", "ids", "scores", "alternatives", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT g.lang, g.source, coalesce(sum(own.n), 0) AS n FROM g LEFT JOIN own USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n, CAST(1 + 1000000000 * CAST(coalesce(own.n, 0) + 2 AS HUGEINT) // (total.n + 2 * v.v) AS BIGINT) AS p,
        CAST(1 + 1000000000 * CAST(kept.n + 2 AS HUGEINT) // (v.n + 2 * v.v) AS BIGINT) AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN total USING (lang, source) LEFT JOIN own USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 10
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a decimal number c, bit by bit: a list element of a digit flips its bits in, and each of eight -1 shifts one out.
CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: list_concat([CAST(ascii(x) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

ORACLES["op12_prefix_trie"] = f"""
WITH r AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, n, {CRC32} % 4 AS h FROM (SELECT c, count(*) AS n FROM r GROUP BY c)),
m AS (SELECT a.c, a.h, a.c - a.c % 20 AS base, least(a.h, coalesce(b.n, 0)) AS m FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 20),
t AS (SELECT m.c, r.pos, role, text FROM m JOIN r ON r.c = m.base AND r.pos < m.h UNION ALL SELECT m.c, r.pos - m.h + m.m, role, text FROM m JOIN r ON r.c = m.c AND r.pos >= m.h),
seq AS (SELECT convs.c, list({{'role': role, 'text': text}} ORDER BY pos) FILTER (pos IS NOT NULL) AS s FROM convs LEFT JOIN t ON t.c = convs.c GROUP BY convs.c),
pre AS (SELECT c, len(coalesce(s, [])) AS n, d, coalesce(s, [])[1:d] AS k FROM (SELECT c, s, unnest(range(0, len(coalesce(s, [])) + 1)) AS d FROM seq)),
nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN len(regexp_extract_all(k[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words FROM pre GROUP BY d, k),
mem AS (SELECT pre.c, pre.d, pre.n, nodes.conv_id FROM pre JOIN nodes USING (d, k)),
up AS (SELECT n.conv_id, n.d, n.n_convs, n.words, mem.conv_id AS parent FROM nodes n LEFT JOIN mem ON mem.c = n.conv_id AND mem.d = n.d - 1),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL),
whole AS (SELECT up.*, coalesce(kids.n, 0) AS n_children FROM up LEFT JOIN kids USING (conv_id, d)),
sub AS (SELECT mem.conv_id, mem.d, count(*) FILTER (w.n_children = 0) AS n_leaves, CAST(sum((w.n_convs - 1) * w.words) AS BIGINT) AS saved_tokens FROM whole w JOIN mem ON mem.c = w.conv_id AND mem.d <= w.d GROUP BY ALL),
ends AS (SELECT conv_id, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM mem WHERE d = n GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, w.parent AS parent_conv_id, w.n_convs, w.n_children, sub.n_leaves, sub.saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM whole w JOIN sub USING (conv_id, d) LEFT JOIN ends USING (conv_id, d)
"""


@query
def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"  # a conversation of control strings
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"))
    pieces_of = chat.format_chat(chat.conversations_as_replies(stored(ordered_turns(rows))), "conv_id")
    return chat.conversation_digests(pieces_of).withColumn("conv_id", F.col("key").cast("long")).drop("key")


ORACLES["op13_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?(?:INST|SYS|OUT|ROLE|AS)\]|/?s>)', '\1\\\2\3', 'g')) AS n,
        length(regexp_replace(role, '([\[<])(\\*)(/?(?:INST|SYS|OUT|ROLE|AS)\]|/?s>)', '\1\\\2\3', 'g')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 10 ELSE r + 20 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
