"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_RATIO = {
    "words": "n_words",
    "mean_word_chars": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END",
    "symbols_per_word": "CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END",
    "duplicate_lines": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END",
    "stop_words": "CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0.0 END",
}
_VERDICT = " AND ".join(f"({_RATIO[r.ratio]}) {op} {limit}" for r in RULES for op, limit in ((">=", r.low), ("<=", r.high)) if limit is not None)

OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
words AS (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
windows AS (
  SELECT k, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS x,
         lead(x, 4) OVER o IS NOT NULL AS whole
  FROM words WINDOW o AS (PARTITION BY k ORDER BY i)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS c FROM windows WHERE whole) WHERE c > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS n FROM again, range(5) r(j) GROUP BY k),
m AS (
  SELECT d.k, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (k)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {_VERDICT} AS kept
FROM f
"""

OP8 = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, source, text, strlen(coalesce(text, '')) AS b,
         CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS s
  FROM documents),
u AS (
  SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
         lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]))) AS crc
  FROM d, crc),
c AS (SELECT *, md5('17:' || coalesce(doc_id::VARCHAR, CASE WHEN text IS NULL THEN 'null' ELSE 'null ' || b || ' ' || crc END)) AS h FROM u),
r AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h, doc_id, b, crc) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY s) AS f FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY f, h, s, doc_id, b, crc) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, (b + 1)::BIGINT AS size, crc::BIGINT AS text_crc32, source, 'rows' AS law, (pos * 8 // n)::INTEGER AS shard,
       (pos - ((pos * 8 // n) * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM p
"""

OP3 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT k, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT k, i, n, item_id FROM places JOIN wins USING (n, x)),
hit AS (SELECT k, count(DISTINCT p) AS c FROM (SELECT k, unnest(range(i, i + n)) AS p FROM found) GROUP BY k),
items AS (SELECT k, count(DISTINCT item_id) AS c, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS l FROM found GROUP BY k),
each AS (SELECT k, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
asked AS (SELECT x, unnest(string_split(x, ' ')) AS t, generate_subscripts(string_split(x, ' '), 1) AS j FROM (SELECT DISTINCT x FROM wins)),
often AS (SELECT t, count(*) AS c FROM each GROUP BY t),
ranked AS (SELECT x, t, j, coalesce(c, 0) AS c, count(*) OVER (PARTITION BY x) AS n, min(coalesce(c, 0)) OVER (PARTITION BY x) AS least FROM asked LEFT JOIN often USING (t)),
anchors AS (SELECT x, t, j, n FROM ranked WHERE least > 0 QUALIFY row_number() OVER (PARTITION BY x ORDER BY c, j) = 1),
begun AS (SELECT x, k, p - j AS s, n FROM anchors JOIN each USING (t)),
near AS (
  SELECT DISTINCT x, k FROM (
    SELECT b.x, b.k, b.s FROM begun b JOIN asked a ON a.x = b.x JOIN each e ON e.k = b.k AND e.t = a.t AND abs(e.p - a.j - b.s) <= 2
    GROUP BY b.x, b.k, b.s, b.n HAVING count(DISTINCT a.j) = b.n)),
near_items AS (SELECT k, count(DISTINCT item_id) AS c, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS l FROM near JOIN wins USING (x) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.c, 0)::BIGINT AS n_hit, coalesce(items.c, 0)::BIGINT AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, coalesce(hit.c, 0) > 0 AS contaminated,
       coalesce(near_items.c, 0)::BIGINT AS n_near_items, sha256(coalesce(near_items.l, '')) AS near_items_sha256
FROM d LEFT JOIN hit USING (k) LEFT JOIN items USING (k) LEFT JOIN near_items USING (k)
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INTEGER), 0) AS q, coalesce(max((toxic = 1)::INTEGER), 0) AS x FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x, MAP {
      'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
      'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)} AS f
  FROM d LEFT JOIN l USING (doc_id)),
z(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS o FROM z a, z b, z c, z d, z e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
r AS (SELECT part, q, x, f, o, list_position(list_transform(string_split(o, ''), lambda c: f[c]), true) AS gone, len(list_filter(map_values(f), lambda v: v)) AS n FROM m, o),
s AS (
  SELECT part, o, s, o[s] AS c,
         count_if(gone IS NULL OR gone > s) AS kept, count_if(gone = s) AS removed, count_if(f[o[s]] AND gone < s) AS redundant,
         count_if(f[o[s]] AND n = 1) AS unique_fails, count_if(gone = s AND q = 1) AS good_lost, count_if(gone = s AND x = 1) AS toxic_lost
  FROM r, range(1, 6) t(s) GROUP BY ALL)
SELECT part, o AS filter_order, s::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley
FROM s
"""


def _op12(rounds: int = 6) -> str:
    """Lloyd's rounds one after another, each comparing every part with every entry."""
    near = """a{r} AS MATERIALIZED (
  SELECT k, v.p, any_value(v.x) AS x, min(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 16 + i) AS best
  FROM v JOIN c{r} c USING (p) GROUP BY k, v.p)"""
    moved = """s{r} AS (
  SELECT p, i, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x
  FROM (SELECT p, best % 16 AS i, j, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT p, best, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{r}) GROUP BY ALL) GROUP BY p, i),
c{n} AS MATERIALIZED (SELECT p, i, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN s{r} s USING (p, i))"""
    steps = ",\n".join(near.format(r=r) + ",\n" + moved.format(r=r, n=r + 1) for r in range(rounds))
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT k, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS x FROM e, range(8) t(p)),
c0 AS (SELECT p, k - 1 AS i, x FROM v WHERE k <= 16),
{steps},
{near.format(r=rounds)},
b AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, i, j)) AS h FROM (SELECT p, i, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM c{rounds})),
f AS (SELECT k, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, sum(best // 16)::BIGINT AS error FROM a{rounds} GROUP BY k)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM e JOIN f USING (k), b
"""


OP12 = _op12()
