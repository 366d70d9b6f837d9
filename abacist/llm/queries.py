"""One registered query for each operator, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.catalog.base import query, table
from abacist.llm import alignment, conversations, decontaminate, exact_dedup, html, jaccard, langid, mixing, passages, pieces, substrings, vectors, warc

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR) || ':mix') AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, source_size * 3.0::DOUBLE AS most FROM s),
f AS (SELECT *, row_number() OVER o AS pos,
        (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS fair
      FROM w WINDOW o AS (ORDER BY most / w, source NULLS LAST)),
l AS (SELECT arg_min(fair, pos) AS level FROM f WHERE most / w >= fair),
t AS (SELECT source, source_size, least(most, level * w) AS target FROM f, l),
p AS (SELECT *, round(target)::BIGINT AS total FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN total // source_size ELSE 0 END AS rounds FROM p),
j AS (SELECT d.*, q.source_size, q.target, q.rounds, q.total - q.rounds * q.source_size AS rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       (rounds * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM j
"""


@query("op5_mix_sources", MIX_SQL)
def op5(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


EXACT_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


@query("op7_exact_dedup", EXACT_SQL)
def op7(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op4_language_id")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(langid.held_out(), F.lit(False))
    model = langid.train(docs.filter(~out))
    return model.predict(docs.select("doc_id", "text", out.alias("held_out"))).select("doc_id", "held_out", "lang_pred", "score")


PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op10_sentencepiece")
def op10(spark, sf_dir):
    vocabulary = pieces.load(PIECES)
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    text, blank = F.coalesce("text", F.lit("")), F.lit(chr(pieces.BLANK))
    restored = F.coalesce("decoded", F.lit("")) == F.replace(text, blank, F.lit(" "))
    counted = F.coalesce(F.size("token_ids"), F.lit(0)).cast("long")
    return pieces.decode(encoded, vocabulary).select("doc_id", counted.alias("n_tokens"), "ids_sha256", restored.alias("restored"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY 1, 2
"""


@query("op8_jaccard_join", JACCARD_SQL)
def op8(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op2_remove_substrings")
def op2(spark, sf_dir):
    return substrings.remove_substrings(table(spark, sf_dir, "documents"))


@query("op9_remove_passages")
def op9(spark, sf_dir):
    return passages.remove_passages(table(spark, sf_dir, "documents"))


VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""


@query("op1_similar_vectors", VECTORS_SQL)
def op1(spark, sf_dir):
    return vectors.similar_vectors(table(spark, sf_dir, "embeddings"))


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""


@query("op3_warc", WARC_SQL)
def op3(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op6_main_text")
def op6(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
              lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 20 AS k FROM conversations, crc),
e AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM d, range(2) r(i) WHERE k <> 0 AND (i = 0 OR k = 3)),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM e),
g AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
             WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS prior FROM f),
puts(q, z, i, put) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', chr(10) || 'user:'), (1, 2, 'I', chr(10) || 'user:'),
  (3, 2, 'I', chr(10) || 'user:'), (2, 3, 'I', chr(10) || 'assistant:'), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (3, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 'II', chr(10) || 'assistant:' || chr(10) || 'user:')),
edits(q, z, x, initial, name) AS (VALUES (0, 0, 'D', '', ''), (1, 1, 'D', '', ''), (2, 2, 'D', '', ''), (3, 3, 'D', '', ''),
  (0, 1, 'K', 's', ''), (0, 2, 'K', 'u', ''), (1, 2, 'K', 'u', ''), (3, 2, 'K', 'u', ''), (2, 3, 'K', 'a', ''),
  (0, 2, 'R', '', 'user'), (1, 2, 'R', '', 'user'), (3, 2, 'R', '', 'user'), (2, 3, 'R', '', 'assistant')),
s(conv_id, n, q, v) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'c': 0::BIGINT, 'a': '', 't': ''} FROM conversations
  UNION ALL
  SELECT s.conv_id, g.n, edits.z, min({
      'c': s.v.c + 5 * len(puts.i) + CASE edits.x WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN edits.x <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END,
      'a': s.v.a || puts.i || edits.x,
      't': s.v.t || puts.put || CASE edits.x WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || edits.name || ':' || text END})
  FROM s JOIN puts ON puts.q = s.q JOIN edits ON edits.q = puts.z JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.n = s.n + 1
  WHERE (edits.x = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (edits.x <> 'K' OR left(role, 1) = edits.initial)
  GROUP BY s.conv_id, g.n, edits.z),
m AS (SELECT conv_id, max(n) AS n FROM s GROUP BY conv_id),
w AS (SELECT s.conv_id, min({'c': v.c + 5 * len(i), 'a': v.a || i, 't': v.t || put}) AS v FROM s JOIN m ON s.conv_id IS NOT DISTINCT FROM m.conv_id AND s.n = m.n JOIN puts ON puts.q = s.q
      WHERE puts.z IN (0, 3) GROUP BY s.conv_id),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND left(prior, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       v.c AS cost, v.a AS audit, sha256(substr(v.t, 2)) AS repaired_sha256
FROM w LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id
"""


@query("op11_repair_conversations", REPAIR_SQL)
def op11(spark, sf_dir):
    return conversations.repair_conversations(conversations.damaged(table(spark, sf_dir, "conversations")))


BYTE_TOKENS = "/opt/tokenizers/byte_bpe_50k.json"


@query("op12_align_tokenizers")
def op12(spark, sf_dir):
    return alignment.align_documents(table(spark, sf_dir, "documents"), BYTE_TOKENS, PIECES)


LEAKS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t FROM b, range(1, 1000000) s(i) WHERE len(w) > 0 AND i <= greatest(len(w) - 9, 1)),
l AS (SELECT DISTINCT n FROM p),
x AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l)),
h AS (SELECT r, i, x.n, item FROM x JOIN p USING (n, t)),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
f AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS told FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(told, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN f USING (r)
"""


@query("op13_decontaminate", LEAKS_SQL)
def op13(spark, sf_dir):
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
