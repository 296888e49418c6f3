"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from cueline.llm.mixing import BLOCK_TOKENS, ENTROPY_FRACTION, MAX_REPEATS, STEPS
from cueline.llm.secrets import ACCESS, ASSIGN, ASSIGN_LEAST, BARE, COPIED_OWNERS, HEX, KINDS, LIVE_CHARACTERS
from cueline.llm.sharding import SHARDS, TABLE_SIZE

_SLOT = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT) % {1}"

OP1 = f"""
WITH RECURSIVE names AS (
  SELECT i AS turn, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS name FROM range({SHARDS}) r(i)),
prefs AS (
  SELECT turn, list_transform(range({TABLE_SIZE}), lambda j: (o + j * s) % {TABLE_SIZE}) AS slots
  FROM (SELECT turn, {_SLOT.format("'offset:' || name", TABLE_SIZE)} AS o, {_SLOT.format("'skip:' || name", TABLE_SIZE - 1)} + 1 AS s FROM names)),
fill AS (
  SELECT 0 AS step, list_transform(range({TABLE_SIZE}), lambda j: -1) AS owner, -1 AS took
  UNION ALL
  SELECT step + 1, list_transform(owner, lambda x, i: CASE WHEN i = slot + 1 THEN step % {SHARDS} ELSE x END), slot
  FROM (SELECT f.step, f.owner, list_filter(p.slots, lambda s: f.owner[s + 1] = -1)[1] AS slot FROM fill f JOIN prefs p ON p.turn = f.step % {SHARDS} WHERE f.step < {TABLE_SIZE}) t),
held AS (SELECT took AS slot, 'shard-' || lpad(CAST((step - 1) % {SHARDS} AS VARCHAR), 3, '0') AS shard FROM fill WHERE step > 0)
SELECT doc_id, source, slot, shard
FROM (SELECT doc_id, source, {_SLOT.format("coalesce(CAST(doc_id AS VARCHAR), '')", TABLE_SIZE)} AS slot FROM documents) d JOIN held USING (slot)
"""

OP10 = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(source, '<none>') AS mix_source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents),
sums AS (SELECT mix_source, sum(n_tokens)::DOUBLE AS t FROM rows GROUP BY 1 HAVING sum(n_tokens) > 0),
shares AS (SELECT *, t / sum(t) OVER () AS p, sum(t) OVER () AS total, count(*) OVER () AS n FROM sums),
search AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
          (SELECT ln(sum(pow(p, (s.lo + s.hi) / 2))) - (s.lo + s.hi) / 2 * sum(pow(p, (s.lo + s.hi) / 2) * ln(p)) / sum(pow(p, (s.lo + s.hi) / 2)) >= {ENTROPY_FRACTION} * ln(max(n)::DOUBLE) FROM shares) AS ok
        FROM search s WHERE step < {STEPS}) x),
first AS (SELECT CASE WHEN (SELECT count(*) FROM shares) <= 1 THEN 1.0 ELSE lo END AS a0 FROM search WHERE step = {STEPS}),
again AS (
  SELECT 0 AS step, a0 AS lo, 1.0::DOUBLE AS hi FROM first
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid, (SELECT pow(min(p), (s.lo + s.hi) / 2 - 1) / sum(pow(p, (s.lo + s.hi) / 2)) > {MAX_REPEATS} FROM shares) AS ok
        FROM again s WHERE step < {STEPS}) x),
chosen AS (
  SELECT round(CASE WHEN (SELECT pow(min(p), a0 - 1) / sum(pow(p, a0)) FROM shares) <= {MAX_REPEATS} THEN a0 ELSE (SELECT lo FROM again WHERE step = {STEPS}) END, 9) AS a FROM first),
weights AS (
  SELECT mix_source, t::BIGINT AS t, total, pow(p, a) / sum(pow(p, a)) OVER () AS w FROM shares, chosen),
spend AS (
  SELECT mix_source, w, t, floor(round(w * floor(round(total, 3)), 3))::BIGINT AS allowed, greatest(1, t // {BLOCK_TOKENS}) AS n_blocks FROM weights),
placed AS (
  SELECT r.*, w, allowed // t AS whole, allowed % t AS rest, CAST('0x' || substr(h, 1, 12) AS BIGINT) % coalesce(n_blocks, 1) AS mix_block
  FROM rows r LEFT JOIN spend USING (mix_source)),
blocks AS (
  SELECT *, sum(b) OVER (PARTITION BY mix_source ORDER BY md5(mix_source || ':' || mix_block), mix_block ROWS UNBOUNDED PRECEDING) AS upto
  FROM (SELECT mix_source, mix_block, sum(n_tokens) AS b FROM placed WHERE w IS NOT NULL GROUP BY ALL) x),
ordered AS (
  SELECT p.*, b.upto, b.b, sum(n_tokens) OVER (PARTITION BY p.mix_source, p.mix_block ORDER BY substr(h, 13, 20), h ROWS UNBOUNDED PRECEDING) AS d_upto
  FROM placed p LEFT JOIN blocks b USING (mix_source, mix_block))
SELECT doc_id, mix_source, n_tokens::BIGINT AS n_tokens, round(coalesce(w, 0), 9) AS mix_weight, mix_block,
  (coalesce(whole, 1) + CASE WHEN n_tokens = 0 THEN 0 WHEN upto <= rest THEN 1 WHEN upto - b + d_upto <= rest THEN 1 ELSE 0 END)::BIGINT AS mix_repeats
FROM ordered
"""

OP3 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '[<\[](?:\||/?s>|/?INST\]|<SYS>>|</SYS>>)')) AS chars,
    CASE WHEN regexp_full_match(role, '[A-Za-z0-9_-]+') THEN length(role) ELSE 1 + 2 * strlen(role) END AS role_chars FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + role_chars + 1 + chars + 11)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP7 = r"""
WITH low AS (SELECT doc_id, coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, p, x.n, item_id FROM (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n) y) x JOIN win USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) z GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h FROM (SELECT DISTINCT doc_id, item_id FROM occ) z GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP9 = """
WITH x AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, p, hash(array_slice(b, p + 1, p + 50)) AS s FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 49)) AS p FROM x WHERE octet_length(b) >= 50) y),
least_of AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, p FROM win JOIN least_of USING (s) WHERE doc_id > m),
runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (
    SELECT doc_id, p, sum(CASE WHEN p - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS g
    FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) AS before FROM gone) u) v GROUP BY doc_id, g),
parts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS tail, string_agg(hex(array_slice(b, since + 1, a)), '' ORDER BY a) AS keep FROM parts JOIN x USING (doc_id) GROUP BY 1)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN keep IS NULL THEN b ELSE unhex(keep || hex(array_slice(b, tail + 1, octet_length(b)))) END) AS kept_sha256
FROM x LEFT JOIN cut USING (doc_id)
"""

OP11 = r"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
low AS (
  SELECT true AS corpus, doc_id, text FROM documents UNION ALL SELECT false, CAST(NULL AS BIGINT), text FROM benchmark),
d AS (
  SELECT row_number() OVER () AS r, corpus, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
f AS (
  SELECT r, corpus, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM (SELECT r, corpus, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT unnest([1, 2, 3]) AS n) ns WHERE len(w) >= n) x),
keys AS (SELECT DISTINCT k FROM f),
hexed AS (SELECT k, hex(encode(k)) AS h, octet_length(encode(k)) AS n FROM keys),
bytes AS (SELECT k, list_transform(range(n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM hexed),
crc AS (SELECT k, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, bits),
n AS (SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM f JOIN crc USING (k) GROUP BY 1),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM n)::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM n)::DOUBLE + 10000))))::BIGINT AS gain FROM n),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM f JOIN crc USING (k) JOIN gains USING (bucket) WHERE corpus GROUP BY 1),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r) WHERE corpus),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS fit FROM scored)
SELECT doc_id, (n_words + greatest(n_words - 1, 0) + greatest(n_words - 2, 0))::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * fit // 100 THEN place END AS rank
FROM ranked
"""


def _op12() -> str:
    """Places are sums of the lengths of matches and of what lies between them."""
    kinds = [(0, ASSIGN, 2, f"length(v) >= {ASSIGN_LEAST}"), (1, ACCESS, 0, "true"), (2, HEX, 0, "true")]
    quoted = [(k, p.replace("'", "''"), g, w) for k, p, g, w in kinds]

    def spans(table: str, kind: int, pattern: str, group: int, held: str) -> str:
        return f"""
SELECT doc_id, source, {kind} AS kind, stop - length(m) AS begin, stop, v
FROM (SELECT doc_id, source, m[i] AS m, v[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + list_sum(list_transform(m[1:i], lambda x: length(x)))::BIGINT AS stop
      FROM (SELECT doc_id, source, m, v, g, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT doc_id, source, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM {table}) a) b) c
WHERE {held}"""

    base = " UNION ALL ".join(spans("x", *k) for k in quoted)
    left = "t"
    for _, pattern, _, _ in quoted:
        blank = lambda t: f"array_to_string(list_transform(string_split_regex({t}, '{pattern}'), lambda g, i: g || repeat(' ', coalesce(length(regexp_extract_all({t}, '{pattern}')[i]), 0))), '')"  # noqa: B023, E731
        left = f"(SELECT {blank('q.t')} AS t, q.doc_id, q.source FROM {left} q)" if left != "t" else f"(SELECT {blank('q.t')} AS t, q.doc_id, q.source FROM x q)"
    bare = spans(left, 3, BARE, 0, "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')").replace(f"FROM {left}) a", f"FROM {left} y) a")
    return f"""
WITH x AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({base} UNION ALL {bare}),
held AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners FROM found GROUP BY 1),
judged AS (
  SELECT doc_id, kind, begin, stop, owners >= {COPIED_OWNERS} AS copied,
    owners = 1 AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= {LIVE_CHARACTERS} AS live
  FROM found JOIN held USING (v)),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || begin || ':' || stop, ',' ORDER BY begin, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || begin || ':' || stop, ',' ORDER BY begin, kind) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied
  FROM (SELECT *, {list(KINDS)}[kind + 1] AS name FROM judged WHERE kind < 3 OR live) j GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM x LEFT JOIN told USING (doc_id)
"""


OP12 = _op12()

OP13 = r"""
WITH x AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM x),
f AS (
  SELECT part, [len(words) < 200, 100 * list_unique(words) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS toxic
  FROM w),
same AS (
  SELECT part, [i FOR i IN range(1, 6) IF fails[i]] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
orders AS (
  SELECT [a, b, c, d, e] AS o FROM (SELECT unnest(range(1, 6)) AS a), (SELECT unnest(range(1, 6)) AS b), (SELECT unnest(range(1, 6)) AS c), (SELECT unnest(range(1, 6)) AS d), (SELECT unnest(range(1, 6)) AS e)
  WHERE list_unique([a, b, c, d, e]) = 5),
steps AS (SELECT o, step, o[step] AS i, o[1 : step - 1] AS before FROM (SELECT o, unnest(range(1, 6)) AS step FROM orders) z),
told AS (
  SELECT part, o, step, i,
    coalesce(sum(n) FILTER (NOT list_has_any(fails, before) AND NOT list_contains(fails, i)), 0) AS kept, coalesce(sum(n) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, i)), 0) AS removed,
    coalesce(sum(n) FILTER (list_has_any(fails, before) AND list_contains(fails, i)), 0) AS redundant, coalesce(sum(n) FILTER (fails = [i]), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, i)), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, i)), 0) AS toxic_lost
  FROM same, steps GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, i)::BIGINT AS shapley
FROM told
"""

ORACLES = {"op1_sharding": OP1, "op3_chat_format": OP3, "op7_decontamination": OP7, "op9_suffix_dedup": OP9, "op10_mixing": OP10, "op11_resampling": OP11, "op12_secret_scan": OP12, "op13_filter_audit": OP13}
