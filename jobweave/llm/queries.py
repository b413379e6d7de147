"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exactdedup, filteraudit, langid, linededup, piecewise, secrets, simhash, tokenfile, toxicity, turnrepair, urlfilter
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.compared(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


def op7_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as definition:
        return tokenfile.round_trip(table(spark, sf_dir, "documents"), definition.read())


#: The rules of op8_urlfilter: action, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.folded(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.folded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(exactdedup.normalized(F.col("text")).cast("binary"), 256)
    return exactdedup.grouped(table(spark, sf_dir, "documents"), {"text_sha256": digest})


def op13_turnrepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnrepair.summaries(turnrepair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_linededup, op3_bpe, op4_piecewise, op5_secrets, op6_simhash, op7_tokenfile, op8_urlfilter, op9_langid, op10_toxicity, op11_filteraudit, op12_exactdedup, op13_turnrepair)}
#: The aliases' part follows canonical and refresh edges that name an absolute URL.
ORACLE_SQL: dict[str, str] = {
    "op8_urlfilter": r"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
named AS (SELECT page_id, html, coalesce(url, '') AS url FROM pages),
split AS (SELECT page_id, url, html,
  translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
  CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '^([^:/?#]*)://', 1)) || '://' || translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(url, '://[^/?#]*([^#]*)', 1) END AS node FROM named),
links AS (
  SELECT url, node, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS b FROM (SELECT url, node, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|''(?:[^''>]*\s)?canonical(?:\s[^''>]*)?''|canonical(?:\s|/?>))[^>]*>?')) AS tag FROM split)
  UNION SELECT url, node, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM (SELECT url, node, unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')) AS tag FROM split)),
targets AS (SELECT node AS a, lower(regexp_extract(b, '^([^:/?#]*)://', 1)) || '://' || translate(regexp_extract(b, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(b, '://[^/?#]*([^#]*)', 1) AS b FROM links WHERE regexp_matches(b, '^[A-Za-z][A-Za-z0-9+.-]*://')),
both_ways AS (SELECT a, b FROM targets WHERE a <> b UNION SELECT b, a FROM targets WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
target AS (SELECT a, b, translate(regexp_extract(b, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(b, '://[^/?#]*([^?#]*)', 1) AS path FROM reach),
ruled AS (SELECT t.a, arg_max(r.verdict, length(r.host) + length(r.path)) AS verdict FROM target t JOIN rules r ON (t.host = r.host OR ends_with(t.host, '.' || r.host)) AND starts_with(t.path, r.path) GROUP BY t.a, t.b),
alias AS (SELECT a, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM ruled GROUP BY a),
own AS (SELECT s.host, s.path, arg_max(r.host || r.path, length(r.host) + length(r.path)) AS rule, arg_max(r.verdict, length(r.host) + length(r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM split) s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY s.host, s.path)
SELECT s.page_id, s.host, s.path, o.rule, coalesce(o.verdict, a.verdict, 'allow') AS verdict
FROM split s LEFT JOIN own o ON s.host = o.host AND s.path = o.path LEFT JOIN alias a ON s.node = a.a
""",
    "op11_filteraudit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS smallest FROM d),
m AS (SELECT doc_id, part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN smallest < doc_id THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & bit = 0 AND mask & earlier::INTEGER = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & earlier::INTEGER = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & earlier::INTEGER <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & earlier::INTEGER = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & earlier::INTEGER = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
""",
    "op12_exactdedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
""",
    # States: 0 nothing, 1 a system turn alone, 2 a user turn last, 3 an assistant turn last.
    "op13_turnrepair": r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT FOR x IN string_split(key, '')]),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT FOR i IN range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM keyed),
hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered),
marked AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
runs(q, k, mid) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
moves AS (SELECT q, mid AS q2, 2 * k + 3 AS price, repeat('I', k) || 'D' AS code, 'D' AS edit, NULL AS need FROM runs
  UNION ALL SELECT q, CASE mid WHEN 2 THEN 3 ELSE 2 END, 2 * k + 2, repeat('I', k) || 'R', 'R', NULL FROM runs
  UNION ALL SELECT q, CASE mid WHEN 2 THEN 3 ELSE 2 END, 2 * k, repeat('I', k) || 'K', 'K', CASE mid WHEN 2 THEN 'a' ELSE 'u' END FROM runs
  UNION ALL SELECT q, 1, 2 * k, repeat('I', k) || 'K', 'K', 's' FROM runs WHERE mid = 0),
reach(conv_id, i, q, s) AS (SELECT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': ''} FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT r.conv_id, m.i, v.q2, min({'cost': r.s.cost + v.price + CASE WHEN m.fault = 'truncated' AND v.edit <> 'D' THEN 1 ELSE 0 END, 'audit': r.s.audit || v.code})
  FROM reach r JOIN marked m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.i = r.i + 1 JOIN moves v ON v.q = r.q AND (v.edit = 'D' OR m.fault NOT IN ('blank', 'duplicate')) AND (v.need IS NULL OR v.need = m.initial) GROUP BY r.conv_id, m.i, v.q2),
ends AS (SELECT conv_id, i, {'cost': s.cost + 2 * tail, 'audit': s.audit || repeat('I', tail)} AS s FROM reach JOIN (VALUES (0, 0), (1, 2), (2, 1), (3, 0)) t(state, tail) ON q = state),
best AS (SELECT conv_id, min(s) AS s FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS last FROM ends) WHERE i = last GROUP BY conv_id),
letters AS (SELECT conv_id, s.audit AS audit, unnest(range(1, length(s.audit) + 1)) AS n FROM best),
spelled AS (SELECT conv_id, substr(audit, n, 1) AS edit, length(replace(substr(audit, 1, n), 'I', '')) AS i, length(replace(substr(audit, 1, n), 'D', '')) AS place, length(replace(audit, 'D', '')) AS size FROM letters),
lines AS (SELECT p.conv_id, p.place, CASE WHEN p.edit = 'K' THEN m.role WHEN (p.place + p.size) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN p.edit = 'I' THEN '' ELSE m.text END AS line
  FROM spelled p LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i WHERE p.edit <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS text FROM lines GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND substr(before, 1, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT b.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal,
  b.s.cost::BIGINT AS cost, b.s.audit AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
""",
}
