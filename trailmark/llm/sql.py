"""SQL that DuckDB runs on the driver's tables to the same rows as the queries."""

from __future__ import annotations

#: Shares by weight 5, 2, 1; the sources that stop at three times their size are the first by
#: size / weight, so the share is the one of the shortest such list that leaves none above.
MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_size * 3.0 / weight, source NULLS LAST) AS k
  FROM by_source),
shares AS (
  SELECT k, source_size * 3 AS most, weight,
         (sum(source_size) OVER ()
          - coalesce(sum(source_size * 3) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         )::DOUBLE / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS share
  FROM ordered),
final AS (SELECT share FROM shares WHERE share * weight <= most ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN share * weight > source_size * 3
         THEN (source_size * 3)::DOUBLE ELSE share * weight END AS target
  FROM by_source, final),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-42|' || coalesce(s.doc_id::VARCHAR, s.text, '')), 1, 12))::BIGINT
         / 281474976710656.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""

TOP_K_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: Every string of 200 bytes by its digest; removed runs are the unions of those that occur twice.
SUFFIX_SQL = """
WITH bytes AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
starts AS (SELECT r, x, unnest(range(1, octet_length(x) - 198)) AS i FROM bytes WHERE octet_length(x) >= 200),
windows AS (SELECT r, i, md5_number(array_slice(x, i, i + 199)) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hits AS (SELECT r, i FROM windows SEMI JOIN twice USING (h)),
marked AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true) AS new FROM hits),
numbered AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
spans AS (SELECT r, run, min(i) AS a, max(i) + 199 AS b FROM numbered GROUP BY r, run),
edges AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS since FROM spans),
cut AS (SELECT r, sum(b - a + 1)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
  string_agg(hex(array_slice(x, since, a - 1)), '' ORDER BY a) AS kept FROM edges JOIN bytes USING (r) GROUP BY r)
SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN x ELSE unhex(kept || hex(array_slice(x, last + 1, octet_length(x)))) END) AS kept_sha256
FROM bytes LEFT JOIN cut USING (r)
"""

#: Every pair of a label by brute force, components by closure; right where the graph misses no link.
VECTORS_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u),
counted AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings e LEFT JOIN counted c ON c.u = vec_id LEFT JOIN least l ON l.u = vec_id
"""

_BLANK = r"[ \t\n\x0B\f\r]"
_MARK = r"[ \t]*>[> \t]*"
_NORMAL = rf"trim(regexp_replace(lower(regexp_replace({{}}, '(?m)^{_MARK}', '', 'g')), '{_BLANK}+', ' ', 'g'))"
QUOTES_SQL = rf"""
WITH RECURSIVE messages AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text, string_split_regex(text, '\r?\n') AS ls FROM conversations),
own AS (SELECT id, conv_id, turn, role, CASE WHEN text IS NOT NULL THEN regexp_replace(array_to_string(
    list_filter(ls, lambda x: NOT regexp_matches(x, '^{_MARK}')), chr(10)), '^{_BLANK}+|{_BLANK}+$', '', 'g') END AS own_text FROM messages),
lines AS (SELECT id, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM messages
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND regexp_matches(text, '(?m)^{_MARK}')),
levels AS (SELECT *, length(regexp_replace(regexp_extract(line, '^{_MARK}'), '[^>]', '', 'g')) AS level FROM lines),
marked AS (SELECT *, (lag(level) OVER (PARTITION BY id ORDER BY pos) IS DISTINCT FROM level)::INT AS new FROM levels),
runs AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY pos) AS run FROM marked),
passages AS (SELECT id, conv_id, turn, run, level, {_NORMAL.format("string_agg(line, chr(10) ORDER BY pos)")} AS said FROM runs WHERE level > 0 GROUP BY id, conv_id, turn, run, level),
pieces AS (SELECT conv_id, turn, unnest(list_concat([own_text], string_split_regex(own_text, '\n{_BLANK}*\n'), string_split(own_text, chr(10)))) AS piece
  FROM own WHERE own_text <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
originals AS (SELECT DISTINCT conv_id, turn, {_NORMAL.format("piece")} AS said FROM pieces),
quoted_lines AS (SELECT id, conv_id, run, list({_NORMAL.format("line")} ORDER BY pos) AS every_line FROM runs WHERE level > 0 GROUP BY ALL),
quoted AS (SELECT id, run, list_filter(every_line, lambda x: x <> '') AS kept FROM quoted_lines),
lengths AS (SELECT DISTINCT conv_id, len(list_filter(every_line, lambda x: x <> '')) AS n FROM quoted_lines),
own_lines AS (SELECT id, conv_id, turn, list_filter(list_transform(string_split(own_text, chr(10)), lambda x: {_NORMAL.format("x")}), lambda x: x <> '') AS kept
  FROM own WHERE own_text <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
runs_said AS (SELECT DISTINCT conv_id, turn, kept[i + 1 : i + n] AS kept FROM (SELECT o.*, n, unnest(range(0, len(o.kept) - n + 1)) AS i
  FROM own_lines o JOIN lengths USING (conv_id) WHERE n > 1)),
linked AS (SELECT p.conv_id, p.turn, p.level, greatest(
    (SELECT max(o.turn) FROM originals o WHERE o.conv_id = p.conv_id AND o.said = p.said AND o.turn < p.turn),
    (SELECT max(o.turn) FROM runs_said o JOIN quoted q ON o.kept = q.kept WHERE q.id = p.id AND q.run = p.run AND o.conv_id = p.conv_id AND o.turn < p.turn)) AS source_turn
  FROM passages p WHERE p.said <> ''),
by_message AS (SELECT conv_id, turn, count(*) AS n_quotes, count(source_turn) AS n_linked, max(source_turn) FILTER (level = 1) AS reply_to FROM linked GROUP BY ALL),
up AS (SELECT conv_id, turn, reply_to AS root_turn, 1 AS depth FROM by_message WHERE reply_to IS NOT NULL
  UNION ALL SELECT up.conv_id, up.turn, b.reply_to, depth + 1 FROM up JOIN by_message b ON b.conv_id = up.conv_id AND b.turn = up.root_turn WHERE b.reply_to IS NOT NULL),
roots AS (SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM up GROUP BY ALL)
SELECT o.conv_id, coalesce(root_turn, o.turn) AS root_turn, coalesce(depth, 0)::INT AS reply_depth, o.turn, role, own_text,
  coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, reply_to
FROM own o LEFT JOIN by_message b ON b.conv_id = o.conv_id AND b.turn = o.turn LEFT JOIN roots r ON r.conv_id = o.conv_id AND r.turn = o.turn
"""

#: Every combination of a URL's tokens is counted, which the small tables allow.
_SHAPE = "^.*?://([^/?#]*)([^?#]*)\\??([^#]*)"
URLS_SQL = rf"""
WITH seen AS (SELECT row_number() OVER () AS r, page_id, url, coalesce(translate(regexp_extract(url, '(?s){_SHAPE}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s){_SHAPE}', 2), '') AS path, coalesce(regexp_extract(url, '(?s){_SHAPE}', 3), '') AS query FROM pages),
rules(own, start, says) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (SELECT r, arg_max(own || start, length(own || start)) AS rule, arg_max(says, length(own || start)) AS says
  FROM seen JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY r),
judged AS (SELECT seen.*, rule, says FROM seen LEFT JOIN fits USING (r)),
tokens AS (SELECT r, says, list_sort(list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h=' || x),
    list_transform(list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> ''), lambda x: 'p=' || x),
    list_transform(list_filter(string_split(regexp_replace(query, '=[^&]*', '', 'g'), '&'), lambda x: x <> ''), lambda x: 'q=' || x)))) AS w FROM judged WHERE host <> ''),
picks AS (SELECT r, says, w, unnest(range(1, 1 << len(w))) AS mask FROM tokens),
subsets AS (SELECT r, says, list_transform(list_filter(range(len(w)), lambda i: (mask >> i) & 1 = 1), lambda i: w[i + 1]) AS items FROM picks),
counted AS (SELECT items, count(*) AS n, count(*) FILTER (says = 'block') AS blocked FROM subsets GROUP BY items),
kept AS (SELECT items FROM counted WHERE blocked >= ceil(0.01 * (SELECT count(*) FROM tokens)) AND blocked > 0 AND blocked::DOUBLE / n >= 0.6),
minimal AS (SELECT items, array_to_string(items, ' ') AS name FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept s WHERE len(s.items) < len(k.items) AND list_has_all(k.items, s.items))),
mined AS (SELECT r, min(name) AS mined_rule FROM tokens JOIN minimal ON list_has_all(w, items) WHERE says IS NULL GROUP BY r)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN mined_rule IS NULL THEN 'allow' ELSE 'block' END) AS verdict, mined_rule
FROM judged LEFT JOIN mined USING (r)
"""

WARC_SQL = """
WITH seen AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
sized AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM seen),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest),
said AS (SELECT sized.*, first IS NOT NULL AND first IS DISTINCT FROM page_id AS again, first FROM sized LEFT JOIN firsts USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to FROM said
"""

#: CRC-32 of a word byte by byte, its table from the polynomial.
RESAMPLING_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
said AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
listed AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM said),
held AS (SELECT side, r, unnest(words) AS word FROM listed),
known AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM held)),
hashed AS (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM known, crc),
placed AS (SELECT side, r, bucket FROM held JOIN hashed USING (word)),
sums AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM listed LEFT JOIN weights USING (r) WHERE side = 'd'),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (r)
"""
