r"""DuckDB SQL for the queries that SQL can express.

Written from the definitions, on the texts themselves: no hashes, no partitions.
"""

from __future__ import annotations

_DOCS = """
docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents)"""

# CRC-32 byte by byte, with its table from the reversed polynomial.
_CRC_TABLE = r"""
bits AS (
  SELECT i, list_reduce(list_prepend(i, [0::BIGINT FOR k IN range(8)]),
                        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) t(i)),
crc_table AS (SELECT list(c ORDER BY i) AS entries FROM bits)"""
_CHECKSUM = rf"""
{_CRC_TABLE.strip()},
sized AS (
  SELECT doc_id, octet_length(encode(text)) + 8 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
               [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(text)), '..')]),
             lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM docs, crc_table)"""

_SHARDING = f"""
WITH {_DOCS.strip()}, {_CHECKSUM.strip()},
placed AS (
  SELECT *, sum(size) OVER w AS until, sum(size) OVER () AS total, row_number() OVER w AS place
  FROM sized
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
dealt AS (
  SELECT *, CAST((2 * until - size) * 24 // (2 * total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard,
       place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt"""

_WORD = r"[^\x20\x09-\x0D]"
_QUALITY = rf"""
WITH {_DOCS.strip()},
split AS (
  SELECT *, regexp_extract_all(text, '{_WORD}+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM docs),
windows AS (
  SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
repeated AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY rid),
counted AS (
  SELECT rid, doc_id, source, text, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (rid)),
common AS (
  SELECT rid, source, text, unnest(list_filter(list_transform(
           string_split(regexp_replace(lower(text), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)),
           lambda x: trim(x, ' ')), lambda x: x <> '')) AS line
  FROM docs),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM docs GROUP BY source),
removed AS (
  SELECT c.source, c.line FROM common c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  GROUP BY c.source, c.line, h.texts
  HAVING 100 * count(DISTINCT c.text) > greatest(1000, 2 * h.texts)),
lost AS (
  SELECT c.rid, sum(len(string_split(c.line, ' '))) AS n
  FROM common c JOIN removed r ON c.source IS NOT DISTINCT FROM r.source AND c.line = r.line
  GROUP BY c.rid),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         coalesce(100 * n > 50 * n_words, false) AS depleted
  FROM counted LEFT JOIN lost USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, depleted,
       NOT base_failed AND NOT depleted AS kept
FROM judged"""

_REPEATS = rf"""
WITH {_DOCS.strip()},
contents AS (
  SELECT rid, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(encode(text)) AS h, octet_length(encode(text)) AS n
  FROM docs),
strings AS (
  SELECT rid, id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT rid, id, h, unnest(range(n - 49)) AS i FROM contents WHERE n >= 50)),
least AS (SELECT s, min(id) AS low FROM strings GROUP BY s),
gone AS (SELECT rid, i FROM strings JOIN least USING (s) WHERE low < id),
numbered AS (
  SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS span
  FROM (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM gone)),
spans AS (SELECT rid, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY rid, span),
sums AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY rid),
between_spans AS (SELECT rid, a, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS start FROM spans),
kept AS (
  SELECT rid, string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) AS k
  FROM between_spans JOIN contents USING (rid) GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM contents LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid)"""

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_RESAMPLING = rf"""
WITH {_DOCS.strip()},
{_CRC_TABLE.strip()},
own AS (
  SELECT rid, doc_id, unnest(words) AS word
  FROM (SELECT rid, doc_id, regexp_extract_all({_LOWERED},
                '{_ALNUM}+') AS words FROM docs)),
target AS (
  SELECT unnest(regexp_extract_all({_LOWERED},
                '{_ALNUM}+')) AS word FROM benchmark),
hashed AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
               [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(word)), '..')]),
             lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM own UNION SELECT word FROM target), crc_table),
s AS (SELECT bucket, count(*) AS n FROM own JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS all_s, (SELECT coalesce(sum(n), 0) FROM t) AS all_t),
gains AS (
  SELECT b.i AS bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (all_s + 10000) AS DOUBLE)
           / CAST((coalesce(s.n, 0) + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) b(i) CROSS JOIN totals LEFT JOIN s ON s.bucket = b.i LEFT JOIN t ON t.bucket = b.i),
weights AS (
  SELECT rid, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM own JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY rid),
scored AS (
  SELECT docs.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(docs.doc_id AS VARCHAR), '')), 1, 8)
           AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (rid)),
placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place
  FROM scored),
drawn AS (SELECT 10 * count(*) // 100 AS wanted FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank
FROM placed, drawn"""


def _vector_codes(rounds: int = 4) -> str:
    """A full search in every round, unrolled."""
    steps = [
        """
WITH vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM vectors, range(4) t(p)),
book0 AS (
  SELECT p, place - 1 AS entry, x
  FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS place FROM parts)
  WHERE place <= 256)"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""found{r} AS MATERIALIZED (
  SELECT vec_id, label, a.p, a.x, min(CAST(list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x)
           - 2 * list_dot_product(a.x, b.x) AS BIGINT) * 256 + entry) AS nearest
  FROM parts a JOIN book{r} b USING (p) GROUP BY ALL)"""
        )
        if r < rounds:
            steps.append(
                f"""mean{r} AS (
  SELECT p, entry, list(m ORDER BY j) AS x
  FROM (SELECT p, nearest % 256 AS entry, j, floor(sum(x[j]) / count(*)) AS m
        FROM found{r}, range(1, 1025) t(j) WHERE j <= len(x) GROUP BY ALL)
  GROUP BY p, entry),
book{r + 1} AS MATERIALIZED (
  SELECT p, entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m USING (p, entry))"""
            )
    steps.append(
        f"""digest AS (
  SELECT sha256(string_agg(CAST(CAST(x[j] AS BIGINT) AS VARCHAR), ',' ORDER BY p, entry, j)) AS codebooks_sha256
  FROM book{rounds}, range(1, 1025) t(j) WHERE j <= len(x)),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', nearest % 256), '' ORDER BY p) AS code,
         CAST(sum(nearest // 256) AS BIGINT) AS error
  FROM found{rounds} GROUP BY vec_id, label),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN sums ON coded.label IS NOT DISTINCT FROM sums.label, digest"""
    )
    return ",\n".join(steps)


ORACLE_SQL: dict[str, str] = {
    "op8_sharding": _SHARDING,
    "op10_quality_rules": _QUALITY,
    "op11_vector_codes": _vector_codes(),
    "op12_suffix_dedup": _REPEATS,
    "op13_importance_resampling": _RESAMPLING,
}
