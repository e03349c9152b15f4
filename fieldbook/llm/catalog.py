"""The operators as queries over the test tables, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldbook.llm import alignment, decontaminate, fingerprints, language, licenses, mixing, ngram_join, pii, prefix_trie, quality, toxicity, urls, warc
from fieldbook.llm.storage import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.toxic_scores(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(table(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited(table(spark, folder, "documents"))


def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages"), urls.train(urls.labelled_urls(spark)))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.predicted(docs, language.learn(docs))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return licenses.scan(licenses.as_files(docs), docs)


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.quality_scores(docs, quality.train(docs, table(spark, folder, "labels")))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.digest(table(spark, folder, "documents"), alignment.public_tokenizers(spark))


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))


def near_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Documents grouped by the likeness of their fingerprints: the join of the fifth operator."""
    return fingerprints.near_duplicates(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_pii, op3_decontamination, op4_ngram_join, op5_fingerprints, op6_url_filters, op7_language, op8_mixing, op9_licenses, op10_quality,
        op11_alignment, op12_warc, op13_prefix_trie, near_fingerprints,
    )
}


def _spans_sql(kind: str, pattern: str, valid: str) -> str:
    """Spans of one kind: the pieces between the matches give the places."""
    return f"""
{kind}_found AS (
  SELECT id, unnest(m) AS v, unnest(p[1:len(m)]) AS piece, generate_subscripts(m, 1) AS i
  FROM (SELECT id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM given)),
{kind}_placed AS (
  SELECT id, v, piece, i, CAST(sum(length(piece) + length(v)) OVER (PARTITION BY id ORDER BY i) AS BIGINT) AS e FROM {kind}_found),
{kind} AS (
  SELECT id, count(*) AS n, string_agg('{kind}:' || (e - length(v)) || ':' || e, ',' ORDER BY i) AS s
  FROM {kind}_placed WHERE {valid} GROUP BY id)"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"(list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), k, 1) AS INT) ELSE (2 * CAST(substr(reverse({_DIGITS}), k, 1) AS INT)) // 10 + (2 * CAST(substr(reverse({_DIGITS}), k, 1) AS INT)) % 10 END)) % 10 = 0)"
_MOVED = "(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4))"
_MOD97 = f"(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({_MOVED}, ''), lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))), lambda a, x: (a * (CASE WHEN x > 9 THEN 100 ELSE 10 END) + x) % 97) = 1)"
_PIECES = ",".join([
    _spans_sql("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true"),
    _spans_sql("ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "list_max(list_transform(string_split(v, '.'), lambda d: CASE WHEN length(ltrim(d, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(d, '0') AS INT) END)) <= 255"),
    _spans_sql("card", "[0-9]([\\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    _spans_sql("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    _spans_sql("iban", "\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\\b", _MOD97),
    _spans_sql("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", f"regexp_matches(lower(right(piece, {pii.REACH})), '(?:^|[^a-z])(?:{pii.CONTEXT['ssn']})') AND NOT regexp_matches(v, '^(?:000|666|9)')"),
])

PII_SQL = f"""
WITH given AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),{_PIECES}
SELECT g.id AS doc_id, CAST(coalesce(email.n, 0) AS BIGINT) AS n_email, CAST(coalesce(ip.n, 0) AS BIGINT) AS n_ip,
       CAST(coalesce(card.n, 0) AS BIGINT) AS n_card, CAST(coalesce(phone.n, 0) AS BIGINT) AS n_phone,
       sha256(concat_ws(',', email.s, ip.s, card.s, phone.s)) AS base_sha256,
       concat_ws(',', email.s, ip.s, card.s, phone.s, iban.s, ssn.s) AS spans
FROM given g LEFT JOIN email USING (id) LEFT JOIN ip USING (id) LEFT JOIN card USING (id) LEFT JOIN phone USING (id)
LEFT JOIN iban USING (id) LEFT JOIN ssn USING (id)
"""

NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(list_sort(s), chr(10))) AS same, s FROM sets),
tokens AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k
  FROM tokens a JOIN tokens b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared WHERE 100 * k >= 75 * (n + m - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x),
part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT z.doc_id, z.n AS n_shingles, p.component_id, CAST(CASE WHEN z.n = 0 THEN 1 ELSE count(*) OVER (PARTITION BY z.same, z.n) END AS BIGINT) AS n_same
FROM sized z JOIN part p ON p.a = z.doc_id
"""

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS place FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS n, (ARRAY[5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, sum(n) OVER () AS total, coalesce(sum(n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM sources),
shares AS (SELECT *, (total - 3 * below) / rest AS share FROM ranked),
fixed AS (SELECT min(share) FILTER (share * w <= 3 * n) AS low, max(share) FILTER (share * w <= 3 * n) AS high FROM shares),
goal AS (SELECT s.source, n, CASE WHEN f.share IS NULL OR f.share * w > 3 * n THEN 3 * n ELSE f.share * w END AS target
  FROM shares s, (SELECT arg_min(share, n / w) AS share FROM shares WHERE share * w <= 3 * n) f),
plan AS (SELECT source, n, target, CASE WHEN n = 0 THEN 0 ELSE least(3, floor(target / n)) END AS passes FROM goal),
places AS (
  SELECT source, place, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS upto FROM sized WHERE size > 0 GROUP BY source, place)
SELECT s.doc_id, s.source, s.size, CAST(p.n AS BIGINT) AS source_size, p.target,
       CAST(least(3 * s.size, s.size * p.passes + CASE WHEN s.size = 0 OR q.upto - q.words > p.target - p.passes * p.n THEN 0
         WHEN q.upto <= p.target - p.passes * p.n THEN s.size
         ELSE round(s.size * ((p.target - p.passes * p.n - (q.upto - q.words)) / q.words)) END) AS BIGINT) AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN places q ON s.source IS NOT DISTINCT FROM q.source AND s.place = q.place
"""

WARC_SQL = f"""
WITH each AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM each WHERE payload_bytes >= {warc.LEAST_REVISITED} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f.first IS NULL OR page_id IS NOT DISTINCT FROM f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM each LEFT JOIN firsts f USING (payload_digest)
"""

_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT))"""

TRIE_SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, o.i, o.role, o.txt FROM convs c JOIN own o ON o.conv_id = c.conv_id - (c.conv_id % 100 + 100) % 100 AND o.i <= c.h
  UNION ALL SELECT c.conv_id, 1, o.i, o.role, o.txt FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h),
placed AS (
  SELECT conv_id, row_number() OVER w AS d, length(txt) AS n,
         md5(string_agg(md5(length(role) || ':' || role || txt), '') OVER (PARTITION BY conv_id ORDER BY part, i)) AS key
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
members AS (SELECT conv_id, d, n, key FROM placed UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
members_up AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM members),
nodes AS (
  SELECT key, d, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members_up GROUP BY key, d),
children AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT m.key, sum(n.saved) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.d <= n.d LEFT JOIN children c ON c.up = n.key GROUP BY m.key)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.key = n.up LEFT JOIN children c ON c.up = n.key JOIN below b ON b.key = n.key
"""

ORACLES = {"op2_pii": PII_SQL, "op4_ngram_join": NEAR_SQL, "op8_mixing": MIX_SQL, "op12_warc": WARC_SQL, "op13_prefix_trie": TRIE_SQL}
