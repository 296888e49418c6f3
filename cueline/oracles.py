"""DuckDB SQL for the queries of the registry, written on its own: folds are recursive."""

from __future__ import annotations

from cueline.operators.packages import CAPTIONS, ENGLISH_CAPTIONS, LAYOUTS, TITLES

EV = "ev AS (SELECT user_id AS media_id, event_id, event_type, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS t FROM events)"
NUM = "row_number() OVER (PARTITION BY media_id ORDER BY t, event_id) - 1"
EVN = f"evn AS (SELECT *, {NUM} AS n FROM ev)"
SEG = f"seg AS (SELECT media_id, {NUM} AS seg_idx, event_id, t AS s, t + value / 100 AS e FROM ev)"
SC = f"sc AS (SELECT * FROM (SELECT media_id, {NUM} AS scene_idx, t AS s, lead(t) OVER (PARTITION BY media_id ORDER BY t, event_id) AS e FROM ev) x WHERE e IS NOT NULL)"
TEXTS = """placed AS (
  SELECT media_id, seg_idx, scene_idx FROM (
    SELECT g.media_id, g.seg_idx, c.scene_idx, row_number() OVER (PARTITION BY g.media_id, g.seg_idx ORDER BY least(g.e, c.e) - greatest(g.s, c.s) DESC, c.scene_idx) AS k
    FROM seg g JOIN sc c ON g.media_id = c.media_id AND c.s < g.e AND g.s < c.e) x WHERE k = 1),
texts AS (
  SELECT c.media_id, c.scene_idx, coalesce(string_agg(x.text, ' ' ORDER BY x.seg_idx), '') AS transcript_text
  FROM sc c LEFT JOIN (SELECT p.media_id, p.scene_idx, p.seg_idx, d.text FROM placed p JOIN seg g USING (media_id, seg_idx) JOIN documents d ON d.doc_id = g.event_id % (SELECT max(doc_id) + 1 FROM documents) WHERE length(d.text) > 0) x
    ON x.media_id = c.media_id AND x.scene_idx = c.scene_idx GROUP BY ALL),
stats AS (
  SELECT media_id, scene_idx, transcript_text, length(trim(transcript_text, E' \\n\\t\\r')) AS chars,
         len(list_filter(regexp_split_to_array(transcript_text, '\\s+'), lambda w: w <> '')) AS words FROM texts)"""
LOUD = """audio AS (
  SELECT c.media_id, c.scene_idx, v.n, v.value / 300 AS x, (v.n - CAST(floor(c.s * 0.1) AS BIGINT)) // 4 AS w
  FROM sc c JOIN evn v ON v.media_id = c.media_id AND v.n >= CAST(floor(c.s * 0.1) AS BIGINT) AND v.n < CAST(floor(c.e * 0.1) AS BIGINT)),
loud AS (
  SELECT c.media_id, c.scene_idx, coalesce(a.r, 0) AS avg_rms, coalesce(w.r, 0) AS max_rms FROM sc c
  LEFT JOIN (SELECT media_id, scene_idx, sqrt(sum(x * x) / count(*)) AS r FROM audio GROUP BY ALL) a USING (media_id, scene_idx)
  LEFT JOIN (SELECT media_id, scene_idx, max(r) AS r FROM (SELECT media_id, scene_idx, w, sqrt(sum(x * x) / count(*)) AS r FROM audio GROUP BY ALL) y GROUP BY ALL) w USING (media_id, scene_idx))"""
CHANGE = """change AS (
  SELECT * FROM (
    SELECT c.media_id, c.scene_idx, v.n AS frame_number,
      (abs(v.value / 300 - lag(v.value / 300) OVER q) + abs((v.event_id % 7) / 7.0::DOUBLE - lag((v.event_id % 7) / 7.0::DOUBLE) OVER q)) / 2 AS change
    FROM sc c JOIN evn v ON v.media_id = c.media_id AND v.n >= CAST(floor(c.s * 0.1) AS BIGINT) AND v.n < CAST(floor(c.e * 0.1) AS BIGINT)
    WINDOW q AS (PARTITION BY c.media_id, c.scene_idx ORDER BY v.n)) x WHERE change IS NOT NULL)"""
SCORES = f"""{TEXTS}, {LOUD}, {CHANGE},
feats AS (
  SELECT c.media_id, c.scene_idx, c.s, c.e, coalesce(m.a, 0) AS motion, st.words, l.avg_rms FROM sc c
  JOIN stats st USING (media_id, scene_idx) JOIN loud l USING (media_id, scene_idx)
  LEFT JOIN (SELECT media_id, scene_idx, avg(change) AS a FROM change GROUP BY ALL) m USING (media_id, scene_idx)),
rel AS (
  SELECT *, CASE WHEN max(motion) OVER p > 0 THEN motion / max(motion) OVER p ELSE 0 END AS motion_score,
    CASE WHEN max(words) OVER p > 0 THEN words / max(words) OVER p ELSE 0 END AS speech_score,
    CASE WHEN max(avg_rms) OVER p > 0 THEN avg_rms / max(avg_rms) OVER p ELSE 0 END AS audio_score
  FROM feats WINDOW p AS (PARTITION BY media_id)),
scores AS (SELECT *, motion_score * 0.45 + speech_score * 0.30 + audio_score * 0.25 AS final_score FROM rel)"""
BASE = f"{EV}, {EVN}, {SEG}, {SC}"


def _window(least: float, most: float) -> str:
    """Clip window of a scene (s, e) in a recording of 720 s, as start and end expressions in a lateral chain."""
    return f"""span AS (SELECT *, least(greatest(s, 0), 720.0) AS a, least(greatest(e, 0), 720.0) AS b FROM ranked),
aimed AS (SELECT *, least(greatest({least}::DOUBLE, b - a), least({most}::DOUBLE, 720.0)) AS goal FROM span),
laid AS (SELECT *, (a + b) / 2 - goal / 2 AS x FROM aimed),
clips AS (
  SELECT media_id, scene_idx, rank, final_score, (s + e) / 2 AS middle,
    CASE WHEN x < 0 THEN 0.0 WHEN x + goal > 720 THEN greatest(0.0, 720.0 - goal) ELSE x END AS cs,
    CASE WHEN x < 0 THEN goal WHEN x + goal > 720 THEN 720.0 ELSE x + goal END AS ce FROM laid)"""


CLIPS = f"""{EV}, {SC},
scored AS (SELECT c.*, v.value / max(v.value) OVER (PARTITION BY c.media_id) AS final_score FROM sc c JOIN ev v ON v.media_id = c.media_id AND v.t = c.s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY final_score DESC, scene_idx) AS rank FROM scored WHERE final_score >= 0.4),
{_window(10, 30)}"""
NEAR = "(least({a}.ce, {b}.ce) - greatest({a}.cs, {b}.cs)) / (greatest({a}.ce, {b}.ce) - least({a}.cs, {b}.cs)) >= 0.6 AND abs({a}.cs - {b}.cs) <= 5 AND abs({a}.ce - {b}.ce) <= 5 AND abs({a}.middle - {b}.middle) <= 3"

RAW = f"""{EV}, {EVN},
raw AS (
  SELECT media_id, n + 1 AS rank, event_id, event_type, t, printf('%.4f', value / 300) AS c,
    CASE WHEN event_id % 11 = 0 THEN E'two\\nlines' ELSE 'one line' END AS reason, event_id % 7 = 0 AS cut, event_id % 3 = 0 AS yes, event_id % 11 = 0 AS broken FROM evn)"""

METRICS = """m AS (
  SELECT l_orderkey AS request_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS sequence,
    l_quantity * 5 AS brightness, l_discount * 800 AS contrast, l_extendedprice / 100 AS sharpness, l_quantity * 3 AS saturation, l_tax AS edge FROM lineitem),
q AS (
  SELECT *, least(100, greatest(0, (1 - abs(brightness - 130) / 125) * 100)) AS b, least(100, greatest(0, (contrast - 20) / (75.0::DOUBLE - 20) * 100)) AS k,
    least(100, greatest(0, (sharpness - 30) / (900.0::DOUBLE - 30) * 100)) AS h, least(100, greatest(0, (saturation - 25) / (150.0::DOUBLE - 25) * 100)) AS c,
    least(100, greatest(0, (edge - 0.02::DOUBLE) / (0.22::DOUBLE - 0.02::DOUBLE) * 100)) AS d FROM m),
tot AS (SELECT *, round(b * 0.20::DOUBLE + k * 0.20::DOUBLE + h * 0.30::DOUBLE + c * 0.15::DOUBLE + d * 0.15::DOUBLE, 2) AS total FROM q),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY total DESC, sequence) AS rank, count(*) FILTER (total >= 60) OVER (PARTITION BY request_id) AS strong FROM tot),
short AS (SELECT * FROM rk WHERE (total >= 60 AND rank <= 3) OR (strong = 0 AND rank = 1))"""

RESULTS = """pg AS (
  SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS request_id, page_id * 2 AS pos, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, url, page_id FROM pages),
res AS (
  SELECT request_id, pos, title, url FROM pg UNION ALL SELECT request_id, pos + 1, 'Again ' || title, url || '/' FROM pg WHERE page_id % 3 = 0),
norm AS (
  SELECT request_id, pos, array_to_string(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> ''), ' ') AS title, array_to_string(list_filter(regexp_split_to_array(url, '\\s+'), lambda w: w <> ''), ' ') AS url FROM res)"""

MANIFEST = """man AS (
  SELECT o_orderkey AS session_id, CASE o_orderkey % 3 WHEN 0 THEN 'portrait' WHEN 1 THEN 'face_top' ELSE 'wide' END AS layout,
    CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 'rec' || o_custkey || '.mp4' END AS r,
    CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN 'rec' || o_custkey || '.mp4' ELSE 'game' || o_custkey || '.MP4' END AS g,
    CASE WHEN o_custkey % 13 = 0 THEN 'face' || o_custkey || '.mkv' ELSE 'face' || o_custkey || '.mp4' END AS f FROM orders),
err AS (
  SELECT session_id, layout, CASE WHEN r IS NULL THEN 'no recording' WHEN layout = 'portrait' THEN NULL WHEN layout = 'wide' THEN 'unknown layout' WHEN g IS NULL OR f IS NULL THEN 'face_top needs three videos'
    WHEN f LIKE '%.mkv' THEN 'not an mp4 file' WHEN r = g THEN 'a video is given twice' END AS error FROM man)"""

ATTEMPTS = """att AS (
  SELECT conv_id, turn + 1 AS attempt, coalesce(text, '') AS text, turn % 2 = 0 AS marked FROM conversations),
meta AS (
  SELECT conv_id, attempt, text AS hook, text AS title,
    list_transform(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: w <> ''), lambda w: CASE WHEN marked THEN '#' || w ELSE w END) AS tags FROM att),
rules AS (
  SELECT *, list_filter([CASE WHEN trim(hook, E' \\n\\t\\r') = '' THEN 'hook' END, CASE WHEN trim(title, E' \\n\\t\\r') = '' THEN 'title' END, CASE WHEN len(tags) = 0 THEN 'hashtags' END,
    CASE WHEN length(title) > 70 THEN 'title_length' END, CASE WHEN len(list_filter(tags, lambda h: h[1] <> '#')) > 0 THEN 'hashtag_mark' END, CASE WHEN regexp_matches(hook, '[஀-ൿ]') THEN 'script' END], lambda x: x IS NOT NULL) AS failures FROM meta)"""

MOMENTS = """
WITH RECURSIVE {EV},
media AS (SELECT DISTINCT media_id, CASE WHEN media_id % 2 = 0 THEN greatest(8.0, least(720.0 / {four}, 45.0)) ELSE greatest(2.0, least(720.0 / {four}, 12.0)) END AS g FROM ev),
inside AS (SELECT media_id, t, g, row_number() OVER (PARTITION BY media_id ORDER BY t) AS i FROM ev JOIN media USING (media_id) WHERE t >= 20 AND t <= 700 {cut}),
thin AS (
  SELECT media_id, i, t AS kept, true AS keep, t, g FROM inside WHERE i = 1
  UNION ALL
  SELECT n.media_id, n.i, CASE WHEN n.t - f.kept >= n.g THEN n.t ELSE f.kept END, n.t - f.kept >= n.g, n.t, n.g FROM thin f JOIN inside n ON n.media_id = f.media_id AND n.i = f.i + 1),
det AS (SELECT media_id, t, row_number() OVER (PARTITION BY media_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM thin WHERE keep),
pick AS (SELECT media_id, list(t ORDER BY t) AS l FROM det WHERE n <= {n} OR i IN (SELECT CAST(round_even(j * (n - 1) / {last}.0::DOUBLE, 0) AS BIGINT) FROM range({n}) r(j)) GROUP BY 1),
fill AS (
  SELECT m.media_id, g, 0 AS step, coalesce(l, []::DOUBLE[]) AS l FROM media m LEFT JOIN pick p USING (media_id)
  UNION ALL
  SELECT media_id, g, step + 1, CASE WHEN len(l) < {n} AND (CASE WHEN step < {n} THEN len(list_filter(l, lambda k: abs(x - k) < g)) = 0 ELSE NOT list_contains(l, x) END) THEN list_append(l, x) ELSE l END
  FROM (SELECT *, 20.0::DOUBLE + 680.0::DOUBLE / ({n} + 1) * (step % {n} + 1) AS x FROM fill WHERE step < 2 * {n}) y),
flat AS (SELECT media_id, unnest(l[1:{n}]) AS t FROM fill WHERE step = 2 * {n})
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY t) AS sequence, round(t, 6) AS t,
  CASE WHEN EXISTS (SELECT 1 FROM det d WHERE d.media_id = f.media_id AND abs(d.t - f.t) < 0.001) THEN 'scene_detection' ELSE 'uniform_fallback' END AS source
FROM flat f"""

ENVELOPE = f"""{EV}, {EVN},
rms AS (SELECT media_id, n // 4 AS w, ln(1 + sqrt(avg(value * value))) AS x FROM evn GROUP BY ALL HAVING count(*) = 4),
mid AS (SELECT media_id, median(x) AS mid FROM rms GROUP BY 1),
mad AS (SELECT media_id, median(abs(x - mid)) AS mad FROM rms JOIN mid USING (media_id) GROUP BY 1),
lev AS (SELECT media_id, w, least(8.0, greatest(-8.0, (x - mid) / greatest(1.4826::DOUBLE * mad, 1e-6::DOUBLE))) AS level FROM rms JOIN mid USING (media_id) JOIN mad USING (media_id))"""

WORDS = """docs AS (SELECT coalesce(source, '') AS request_id, doc_id, regexp_replace(lower(text), '[\\x{80}-\\x{10FFFF}]', '_', 'g') AS t FROM documents),
toks AS (SELECT request_id, doc_id, list_filter(regexp_extract_all(t, '\\b[a-z][a-z0-9''-]{2,}\\b'), lambda w: w NOT IN ('the', 'ring')) AS w FROM docs)"""

PACK = """req AS (
  SELECT p_partkey AS request_id, p_partkey % turn + 1 AS profile_key, '/videos/' || p_partkey || '.mp4' AS source_video, CASE WHEN p_partkey % 4 = 0 THEN 'The ' || p_name ELSE p_name END AS name, p_brand AS topic,
    ['Funny cuts', 'Challenge run', 'Full Walkthrough', 'BOSS fight', 'Stream'][p_partkey % 5 + 1] AS vt, ['funny', 'challenge', 'walkthrough', 'boss', 'other'][p_partkey % 5 + 1] AS kind,
    coalesce(s_name, '') AS ch, CASE WHEN s_suppkey % 3 = 0 THEN 'Hinglish' ELSE 'English' END AS lang, CASE WHEN s_suppkey % 2 = 0 THEN 'night owls' ELSE 'gaming viewers' END AS aud
  FROM part, (SELECT max(s_suppkey) + 1 AS turn FROM supplier) z LEFT JOIN supplier ON s_suppkey = p_partkey % turn + 1),
tag AS (
  SELECT *, [name, name || ' gameplay', name || ' ' || vt, name || ' ' || topic, vt, topic, 'gaming', 'gameplay', 'gaming video', 'gameplay highlights', lang || ' gaming', ch] AS traw,
    ['#' || regexp_replace(name, '[^a-zA-Z0-9]+', '', 'g'), '#Gaming', '#Gameplay', '#' || regexp_replace(vt, '[^a-zA-Z0-9]+', '', 'g'), '#GamingVideo'] AS hraw FROM req),
uniq AS (
  SELECT *, list_filter(traw, lambda x, i: list_position(list_transform(traw, lambda y: lower(y)), lower(x)) = i) AS tags, list_filter(hraw, lambda x, i: list_position(list_transform(hraw, lambda y: lower(y)), lower(x)) = i) AS hashtags FROM tag)"""


def _titles() -> str:
    rows = ", ".join(f"('{k}', {i}, '{t.replace(chr(39), chr(39) * 2)}')" for k, ts in TITLES.items() for i, t in enumerate(ts))
    return f"tpl(kind, pos, template) AS (VALUES {rows})"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _fallback(rows) -> str:
    return "fb(category, hook, title, tags) AS (VALUES " + ", ".join(f"('{a}', '{b.replace(chr(39), chr(39) * 2)}', '{c}', '{' '.join(d)}')" for a, b, c, d in rows) + ")"


def _time(x: str, mark: str) -> str:
    ms = f"CAST(round_even(greatest({x}, 0) * 1000, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def _caption_cte() -> str:
    return """src AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w, doc_id % 50 + 10.5::DOUBLE AS d FROM documents),
cap AS (
  SELECT doc_id, i AS caption_idx, i * (d / n) AS s, CASE WHEN i = n - 1 THEN d ELSE (i + 1) * (d / n) END AS e, array_to_string(w[i * 4 + 1 : i * 4 + 4], ' ') AS text
  FROM (SELECT doc_id, w, d, n, unnest(range(n)) AS i FROM (SELECT *, CAST(ceil(len(w) / 4) AS BIGINT) AS n FROM src WHERE len(w) > 0) y) x)"""


def build(words: tuple[str, ...], pairs: tuple[str, ...], fallback: tuple) -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["speech_chunks"] = f"""
WITH RECURSIVE {EV}, {SEG},
fold AS (
  SELECT media_id, seg_idx, s AS cs, e AS ce, 0::BIGINT AS chunk FROM seg WHERE seg_idx = 0
  UNION ALL
  SELECT n.media_id, n.seg_idx, CASE WHEN n.s - f.ce <= 2 AND n.e - f.cs <= 20 THEN f.cs ELSE n.s END, n.e, CASE WHEN n.s - f.ce <= 2 AND n.e - f.cs <= 20 THEN f.chunk ELSE f.chunk + 1 END
  FROM fold f JOIN seg n ON n.media_id = f.media_id AND n.seg_idx = f.seg_idx + 1)
SELECT media_id, chunk AS chunk_idx, round(arg_max(cs, seg_idx), 6) AS start_seconds, round(arg_max(ce, seg_idx), 6) AS end_seconds FROM fold GROUP BY media_id, chunk"""
    sql["merged_scenes"] = f"""
WITH RECURSIVE {EV}, {SC},
fold AS (
  SELECT media_id, scene_idx, s AS cs, e AS ce, 0::BIGINT AS k FROM sc WHERE scene_idx = 0
  UNION ALL
  SELECT n.media_id, n.scene_idx, CASE WHEN f.ce - f.cs < 2 THEN f.cs ELSE n.s END, n.e, CASE WHEN f.ce - f.cs < 2 THEN f.k ELSE f.k + 1 END FROM fold f JOIN sc n ON n.media_id = f.media_id AND n.scene_idx = f.scene_idx + 1)
SELECT media_id, k AS scene_idx, round(arg_max(cs, scene_idx), 6) AS start_seconds, round(arg_max(ce, scene_idx), 6) AS end_seconds FROM fold GROUP BY media_id, k"""
    sql["thinned_moments"] = f"""
WITH RECURSIVE {EV}, {EVN},
fold AS (
  SELECT media_id, n, t AS kept, true AS keep FROM evn WHERE n = 0
  UNION ALL
  SELECT v.media_id, v.n, CASE WHEN v.t - f.kept >= 5 THEN v.t ELSE f.kept END, v.t - f.kept >= 5 FROM fold f JOIN evn v ON v.media_id = f.media_id AND v.n = f.n + 1)
SELECT media_id, round(kept, 6) AS t FROM fold WHERE keep"""
    sql["deduped_candidates"] = f"""
WITH RECURSIVE {CLIPS},
fold AS (
  SELECT media_id, 0::BIGINT AS rank, []::STRUCT(cs DOUBLE, ce DOUBLE, middle DOUBLE)[] AS kept, false AS keep, 0.0::DOUBLE AS cs, 0.0::DOUBLE AS ce FROM clips WHERE rank = 1
  UNION ALL
  SELECT media_id, rank, CASE WHEN near THEN kept ELSE list_append(kept, {{'cs': cs, 'ce': ce, 'middle': middle}}) END, NOT near, cs, ce
  FROM (SELECT c.media_id, c.rank, f.kept, c.cs, c.ce, c.middle, len(list_filter(f.kept, lambda k: {NEAR.format(a="k", b="c")})) > 0 AS near FROM fold f JOIN clips c ON c.media_id = f.media_id AND c.rank = f.rank + 1) x)
SELECT media_id, rank, round(cs, 6) AS start_seconds, round(ce, 6) AS end_seconds FROM fold WHERE keep"""
    sql["near_duplicate_pairs"] = f"WITH {CLIPS} SELECT a.media_id, a.rank, b.rank AS other_rank FROM clips a JOIN clips b ON a.media_id = b.media_id AND a.rank < b.rank WHERE {NEAR.format(a='a', b='b')}"
    sql["scene_transcripts"] = f"WITH {EV}, {SEG}, {SC}, {TEXTS} SELECT media_id, scene_idx, md5(transcript_text) AS text_md5, chars AS speech_character_count, words AS speech_word_count, chars > 0 AS has_speech FROM stats"
    sql["prompts"] = f"WITH {EV}, {SEG}, {SC}, {TEXTS} SELECT media_id, scene_idx AS rank, md5('Scene ' || scene_idx || ' says: ' || CASE WHEN chars = 0 THEN '[NO SPEECH]' ELSE transcript_text END) AS prompt_md5 FROM stats"
    sql["scene_loudness"] = f"WITH {EV}, {EVN}, {SC}, {LOUD} SELECT media_id, scene_idx, round(avg_rms, 6) AS average_audio_rms, round(max_rms, 6) AS maximum_audio_rms FROM loud"
    sql["frame_changes"] = f"WITH {EV}, {EVN}, {SC}, {CHANGE} SELECT media_id, scene_idx, frame_number, round(change, 6) AS change FROM change"
    sql["scene_motion"] = """
WITH f AS (SELECT label::BIGINT AS media_id, vec_id, vec_id // 100 AS scene_idx, embedding FROM embeddings),
d AS (
  SELECT media_id, scene_idx, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: abs(embedding[i]::DOUBLE - prev[i]::DOUBLE))) / len(embedding) AS c
  FROM (SELECT *, lag(embedding) OVER (PARTITION BY media_id, scene_idx ORDER BY vec_id) AS prev FROM f WHERE (vec_id - scene_idx * 100) % 5 = 0) x WHERE prev IS NOT NULL)
SELECT s.media_id, s.scene_idx, round(coalesce(avg(c), 0), 6) AS average_motion_score, round(coalesce(max(c), 0), 6) AS maximum_motion_score
FROM (SELECT DISTINCT media_id, scene_idx FROM f) s LEFT JOIN d USING (media_id, scene_idx) GROUP BY ALL"""
    sql["representative_frames"] = """
WITH c AS (SELECT label::BIGINT AS media_id, count(*) AS n FROM embeddings GROUP BY 1),
p AS (SELECT media_id, CASE WHEN n = 1 THEN [0] ELSE list_transform(range(least(3, n)), lambda i: CAST(round_even(i * (n - 1) / (least(3, n) - 1)::DOUBLE, 0) AS BIGINT)) END AS l FROM c)
SELECT media_id, 1 AS rank, i AS pos, l[i + 1] AS frame_number FROM p, range(3) r(i) WHERE i < len(l)"""
    sql["envelopes"] = f"WITH {ENVELOPE} SELECT media_id AS session_id, w, round(level, 6) AS level FROM lev"
    sql["lag_alignment"] = f"""
WITH {ENVELOPE}, src AS (SELECT media_id - 1 AS session_id, w AS j, level AS s FROM lev),
sizes AS (SELECT a.media_id AS session_id, a.n AS nm, b.n AS ns FROM (SELECT media_id, count(*) AS n FROM lev GROUP BY 1) a JOIN (SELECT session_id, count(*) AS n FROM src GROUP BY 1) b ON a.media_id = b.session_id),
sums AS (
  SELECT s.session_id, l AS lag, sum(m.level * s.s) AS dot, corr(m.level, s.s) AS r FROM src s, range(-5, 6) q(l) JOIN lev m ON true
  WHERE m.media_id = s.session_id AND m.w = s.j - l GROUP BY ALL),
sc AS (SELECT session_id, lag, dot / greatest(1, least(nm, ns) - abs(lag)) AS score, r FROM sums JOIN sizes USING (session_id)),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, lag) = 1),
sec AS (SELECT b.session_id, max(o.score) AS second FROM best b JOIN sc o ON o.session_id = b.session_id AND abs(o.lag - b.lag) > 2 GROUP BY 1),
fin AS (SELECT b.session_id, b.lag, least(1, greatest(0, coalesce(CASE WHEN isnan(r) THEN NULL ELSE r END, 0))) AS p, CASE WHEN coalesce(second, 0) <= 0 THEN 2.0 ELSE score / second END AS ratio FROM best b LEFT JOIN sec USING (session_id))
SELECT session_id, lag, round(p, 6) AS pearson, round(ratio, 6) AS ratio, round(0.8 * p + 0.2 * least(1, greatest(0, (ratio - 1) / 0.25)), 6) AS confidence, p >= 0.2 AND ratio >= 1.05 AS accepted FROM fin"""
    sql["fft_alignment"] = sql["lag_alignment"]
    sql["session_offsets"] = f"SELECT session_id, lag * 40.0 AS gameplay_offset_seconds, lag * 40.0 AS facecam_offset_seconds, confidence AS gameplay_confidence, confidence AS facecam_confidence FROM ({sql['lag_alignment']}) x WHERE accepted"
    sql["metadata_rows"] = f"""
WITH {RAW}
SELECT media_id, rank, CASE WHEN cut THEN '' ELSE replace(reason, E'\\n', ' ') END AS hook, CASE WHEN cut THEN '' ELSE event_type END AS title, CASE WHEN cut THEN '' ELSE '#' || event_type || '|None|#clip' END AS hashtags,
  '' AS description, '' AS thumbnail_prompt FROM raw"""
    sql["run_counts"] = """
SELECT user_id AS run_id, count(*) FILTER (event_type = 'purchase') AS highlights, count(*) FILTER (event_type = 'click') AS exports, count(*) FILTER (event_type = 'view') AS packages FROM events GROUP BY 1"""
    sql["highlight_scores"] = f"WITH {BASE}, {SCORES} SELECT media_id, scene_idx, round(motion_score, 6) AS motion_score, round(speech_score, 6) AS speech_score, round(audio_score, 6) AS audio_score, round(final_score, 6) AS final_score FROM scores"
    sql["highlight_candidates"] = f"""
WITH {BASE}, {SCORES},
rounded AS (SELECT media_id, scene_idx, s, e, round(final_score, 6) AS final_score FROM scores),
ranked AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY final_score DESC, scene_idx) AS rank FROM rounded WHERE final_score >= 0.4),
{_window(45, 145)}
SELECT media_id, scene_idx, rank, final_score, round(cs, 6) AS start_seconds, round(ce, 6) AS end_seconds FROM clips"""
    sql["missing_features"] = f"""
WITH {EV}, {SC}, cnt AS (SELECT media_id, count(*) AS k FROM ev GROUP BY 1),
span AS (SELECT c.media_id, scene_idx, least(CAST(floor(e * 0.1) AS BIGINT), k) - CAST(floor(s * 0.1) AS BIGINT) AS n FROM sc c JOIN cnt USING (media_id))
SELECT media_id, scene_idx, 'motion' AS missing FROM span WHERE n < 2 UNION ALL SELECT media_id, scene_idx, 'loudness' FROM span WHERE n < 1"""
    sql["response_rows"] = f"""
WITH {RAW}
SELECT media_id, rank, NOT cut AND yes AS is_interesting, CASE WHEN cut THEN 'unknown' ELSE event_type END AS category,
  CASE WHEN cut THEN 'no JSON object in the response' ELSE replace(reason, E'\\n', ' ') END AS reason, CASE WHEN cut THEN 0 ELSE least(1, greatest(0, CAST(c AS DOUBLE))) END AS confidence FROM raw"""
    sql["visual_rows"] = f"""
WITH {RAW}
SELECT media_id, rank, '' AS visual_event, CASE WHEN cut OR broken THEN 'low' ELSE 'high' END AS action_level, 'low' AS danger_level, false AS looks_interesting,
  CASE WHEN cut OR broken THEN '' ELSE reason END AS reason, CASE WHEN cut OR broken THEN 0 ELSE least(1, greatest(0, CAST(c AS DOUBLE))) END AS confidence FROM raw"""
    sql["metadata_rules"] = f"WITH {ATTEMPTS} SELECT conv_id, attempt, array_to_string(failures, ',') AS failures FROM rules"
    sql["first_valid_metadata"] = f"""
WITH {ATTEMPTS}, {_fallback(fallback)},
good AS (SELECT * FROM rules WHERE attempt <= 3 AND len(failures) = 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY attempt) = 1),
items AS (SELECT DISTINCT conv_id, ['click', 'view', 'other'][conv_id % 3 + 1] AS category FROM att)
SELECT i.conv_id, g.attempt, coalesce(g.hook, f.hook) AS hook, coalesce(g.title, f.title) AS title, coalesce(array_to_string(g.tags, ' '), f.tags) AS hashtags FROM items i LEFT JOIN good g USING (conv_id) LEFT JOIN fb f ON f.category = i.category"""
    sql["final_ranking"] = f"""
WITH {RAW}, {SC},
fine AS (SELECT *, least(1, greatest(0, CAST(c AS DOUBLE))) AS final_confidence FROM raw WHERE NOT (cut OR broken))
SELECT f.media_id, rank, row_number() OVER (PARTITION BY f.media_id ORDER BY final_confidence DESC, rank) AS number, event_type AS commentary_category, 'high' AS action_level, true AS keep_highlight, final_confidence, round(s, 6) AS start_seconds
FROM fine f JOIN sc c ON c.media_id = f.media_id AND c.scene_idx + 1 = f.rank"""
    sql["highlight_files"] = f"""
WITH {RAW}, c AS (SELECT media_id, rank, CASE WHEN cut OR broken THEN 0 ELSE least(1, greatest(0, CAST(c AS DOUBLE))) END AS conf FROM raw),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY conf DESC, rank) AS number FROM c)
SELECT media_id, number, printf('highlight_%03d.mp4', number) AS file_name, rank, printf('highlight_%03d.mp4', number) AS named FROM n"""
    sql["timeline_remap"] = f"""
WITH {EV}, bought AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY media_id) > 0 AS has FROM ev)
SELECT media_id, event_id, CASE WHEN has THEN round(t + media_id % 7 - 100, 6) END AS source_seconds,
  CASE WHEN NOT has THEN 'no session' WHEN t + (media_id % 7 - 100) < 0 THEN 'before the source begins' END AS reject_reason FROM bought"""
    sql["run_summary"] = """
WITH s AS (SELECT user_id AS run_id, event_type AS stage, sum(value) AS s FROM events GROUP BY ALL),
b AS (SELECT run_id, count(*) AS stages, sum(s) AS total FROM s GROUP BY 1)
SELECT run_id, stages, round(total, 6) AS total_seconds, stage AS slowest_stage, round(CASE WHEN total > 0 THEN s / total ELSE 0 END, 6) AS slowest_share
FROM s JOIN b USING (run_id) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY s DESC, stage DESC) = 1"""
    sql["session_rejects"] = f"WITH {MANIFEST} SELECT session_id, error FROM err WHERE error IS NOT NULL"
    sql["layout_routes"] = f"WITH {MANIFEST} SELECT session_id, CASE WHEN error IS NULL AND layout = 'face_top' THEN 'facecam' ELSE 'portrait' END AS renderer FROM err"
    sql["caption_rows"] = f"WITH {_caption_cte()} SELECT doc_id, caption_idx, round(s, 6) AS start_seconds, round(e, 6) AS end_seconds, text FROM cap"
    sql["srt_documents"] = f"""
WITH {_caption_cte()},
doc AS (SELECT doc_id, string_agg((caption_idx + 1) || E'\\n' || {_time("s", ",")} || ' --> ' || {_time("e", ",")} || E'\\n' || text, E'\\n\\n' ORDER BY caption_idx) || E'\\n' AS d FROM cap GROUP BY 1)
SELECT s.doc_id, length(coalesce(doc.d, '')) AS chars, md5(coalesce(doc.d, '')) AS document_md5 FROM src s LEFT JOIN doc USING (doc_id)"""
    sql["caption_lines"] = f"""
WITH {ATTEMPTS}, w AS (SELECT conv_id, attempt, list_filter(regexp_split_to_array(hook, '\\s+'), lambda x: x <> '') AS w FROM meta),
c AS (SELECT *, len(w) AS n, CASE WHEN len(w) <= 5 THEN 2 ELSE CAST(ceil(len(w) * 0.4) AS BIGINT) END AS a, CASE WHEN len(w) = 5 THEN 4 ELSE CAST(ceil(len(w) * 0.75) AS BIGINT) END AS b FROM w)
SELECT conv_id, attempt, CASE WHEN n = 0 THEN 'NOW' WHEN n <= 2 THEN array_to_string(w, ' ') WHEN n <= 4 THEN array_to_string(w[1:2], ' ') || '/' || array_to_string(w[3:], ' ')
  ELSE array_to_string(w[1:a], ' ') || '/' || array_to_string(w[a + 1 : b], ' ') || '/' || array_to_string(w[b + 1 :], ' ') END AS lines FROM c"""
    clock = "CAST(round_even(greatest(t, 0), 0) AS BIGINT)"
    sql["time_codes"] = f"WITH {EV} SELECT event_id, {_time('t - 1', ',')} AS srt, {_time('t', '.')} AS dotted, printf('%02d:%02d:%02d', {clock} // 3600, {clock} // 60 % 60, {clock} % 60) AS clock FROM ev"
    sql["moment_selection"] = MOMENTS.format(EV=EV, n=5, four="20.0", last=4, cut="")
    sql["sparse_moments"] = MOMENTS.format(EV=EV, n=8, four="32.0", last=7, cut="AND event_type = 'purchase'")
    sql["frame_files"] = f"""
SELECT media_id, sequence, 'Run_' || media_id || '_' || CASE WHEN media_id % 2 = 0 THEN 'full' ELSE 'existing_highlight' END || '_mp4' AS folder,
  printf('candidate_%02d_', sequence) || source || '_' || translate({_time("t", ".")}, ':.', '--') || '.jpg' AS file_name FROM ({sql["moment_selection"]}) x"""
    sql["scene_cut_times"] = f"WITH {EV}, {EVN} SELECT media_id, n AS pos, CAST(printf('%.3f', t) AS DOUBLE) AS t FROM evn"
    sql["frame_shortlist"] = f"WITH {METRICS} SELECT request_id, sequence, rank, total AS total_score, round(b, 2) AS brightness_score, round(k, 2) AS contrast_score, round(h, 2) AS sharpness_score, round(c, 2) AS color_score, round(d, 2) AS detail_score FROM short"
    sql["round_robin"] = f"""
WITH {METRICS},
fr AS (SELECT request_id, sequence, row_number() OVER (PARTITION BY request_id ORDER BY rank) - 1 AS i, count(*) OVER (PARTITION BY request_id) AS n FROM short),
cu AS (
  SELECT l_orderkey AS request_id, pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY area DESC, pos) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
          l_quantity * (l_partkey % 60) * CASE WHEN (l_partkey % 60) / greatest(l_quantity, 1) > 1.1 THEN 1.25 ELSE 1.0 END AS area FROM lineitem) x)
SELECT f.request_id, v AS variant, f.sequence, c.pos FROM fr f JOIN cu c USING (request_id), range(1, 6) r(v) WHERE (v - 1) % f.n = f.i AND (v - 1) % c.n = c.i"""
    sql["term_counts"] = f"WITH {WORDS}, u AS (SELECT request_id, unnest(w) AS term FROM toks) SELECT request_id, term, count(*) AS n FROM u WHERE term IN ({_quoted(words)}) GROUP BY ALL"
    sql["phrase_counts"] = f"""
WITH {WORDS}, u AS (SELECT request_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM toks)
SELECT request_id, phrase, count(*) AS n FROM u WHERE phrase IN ({_quoted(pairs)}) GROUP BY ALL"""
    sql["deduped_results"] = f"""
WITH RECURSIVE {RESULTS},
ord AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS i, lower(regexp_replace(url, '/+$', '')) AS u, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS k FROM norm WHERE title <> '' AND url <> ''),
fold AS (
  SELECT request_id, i, [u] AS us, [k] AS ks, true AS keep FROM ord WHERE i = 1
  UNION ALL
  SELECT o.request_id, o.i, CASE WHEN seen THEN us ELSE list_append(us, u) END, CASE WHEN seen THEN ks ELSE list_append(ks, k) END, NOT seen
  FROM (SELECT n.*, f.us, f.ks, list_contains(f.us, n.u) OR list_contains(f.ks, n.k) AS seen FROM fold f JOIN ord n ON n.request_id = f.request_id AND n.i = f.i + 1) o)
SELECT o.request_id, o.pos, o.url, regexp_replace(lower(regexp_extract(o.url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS domain, o.title FROM fold f JOIN ord o USING (request_id, i) WHERE keep"""
    sql["search_queries"] = "SELECT p_partkey AS request_id, i AS query_no, p_name || ' ' || ['game', 'gameplay', 'best moments', 'tips'][i + 1] AS query FROM part, range(4) r(i)"
    sql["upload_packages"] = f"""
WITH {PACK}, {_titles()},
t AS (SELECT request_id, CASE WHEN lang = 'English' THEN replace(x, 'gone wrong', 'went wrong') ELSE x END AS title, pos FROM (SELECT request_id, lang, pos, replace(replace(template, '%n', name), '%t', topic) AS x FROM req JOIN tpl USING (kind)) y)
SELECT u.request_id, profile_key, ch AS channel_name, vt AS video_type, topic AS episode_topic, source_video, name AS game_name, lang AS preferred_language, (SELECT title FROM t WHERE t.request_id = u.request_id AND pos = 0) AS primary_title, (SELECT string_agg(title, '|' ORDER BY pos) FROM t WHERE t.request_id = u.request_id AND pos > 0) AS alternate_titles,
  ch || ' plays ' || name || ': ' || topic || E'.\\n\\nA ' || vt || ' video for ' || aud || E'.\\n\\nGame: ' || name || E'\\nType: ' || vt || E'\\nTopic: ' || topic || E'\\nChannel: ' || ch || E'\\n\\n' || array_to_string(hashtags, ' ') AS description,
  array_to_string(hashtags, '|') AS hashtags, array_to_string(tags, '|') AS tags FROM uniq u"""
    sql["package_files"] = f"""
WITH t AS (
  SELECT *, 'YOUTUBE UPLOAD PACKAGE' || E'\\n' || repeat('=', 22) || E'\\n\\nChannel: ' || channel_name || E'\\nProfile: ' || profile_key || E'\\nGame: ' || game_name || E'\\nVideo type: ' || video_type
    || E'\\nEpisode/topic: ' || episode_topic || E'\\nLanguage: ' || preferred_language || E'\\nSource video: ' || source_video || E'\\n\\nPRIMARY TITLE\\n' || repeat('-', 13) || E'\\n' || primary_title
    || E'\\n\\nALTERNATE TITLES\\n' || repeat('-', 16) || E'\\n' || array_to_string(list_transform(string_split(alternate_titles, '|'), lambda t, i: i || '. ' || t), E'\\n')
    || E'\\n\\nDESCRIPTION\\n' || repeat('-', 11) || E'\\n' || description || E'\\n\\nHASHTAGS\\n' || repeat('-', 8) || E'\\n' || replace(hashtags, '|', ' ')
    || E'\\n\\nTAGS / KEYWORDS\\n' || repeat('-', 15) || E'\\n' || replace(tags, '|', ', ') || E'\\n' AS text FROM ({sql["upload_packages"]}) x)
SELECT request_id, length(text) AS chars, md5(text) AS text_md5, primary_title, channel_name, profile_key, source_video FROM t"""
    sql["request_queries"] = f"WITH {PACK} SELECT p_partkey AS request_id, concat_ws('|', p_name || ' official game', p_name || ' gameplay terminology', p_name || ' ' || vt || ' ' || topic, p_name || ' latest gameplay trends') AS queries FROM req JOIN part ON p_partkey = request_id"
    sql["local_terms"] = f"""
WITH {PACK}, own AS (SELECT request_id, list_filter([p_name, vt, CASE request_id % 3 WHEN 0 THEN upper(vt) WHEN 1 THEN '' ELSE topic END, 'Gameplay', 'Gaming', 'Highlights', 'Reaction'], lambda x: x <> '') AS t FROM req JOIN part ON p_partkey = request_id)
SELECT request_id, array_to_string(list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i), '|') AS terminology FROM own"""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    captions = ", ".join(f"('{k}', {i}, {quoted(t)})" for k, v in CAPTIONS.items() for i, t in enumerate(v))
    english = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in ENGLISH_CAPTIONS.items())
    layouts = ", ".join(f"({i}, '{a}', '{b}', {c}::DOUBLE, {d}::DOUBLE, {e})" for i, (a, b, c, d, e) in enumerate(LAYOUTS))
    sql["caption_variants"] = f"""
WITH {PACK}, cap(kind, i, template) AS (VALUES {captions}), eng(caption, english) AS (VALUES {english}), lay(i, descriptive_name, creator_side, gameplay_zoom, creator_scale, darken_strength) AS (VALUES {layouts}),
made AS (SELECT p_partkey AS request_id, i, CASE WHEN lang = 'English' THEN 1 ELSE 0 END AS e, replace(replace(template, '%n', upper(p_name)), '%t', upper(p_brand)) AS caption FROM req JOIN part ON p_partkey = request_id JOIN cap USING (kind))
SELECT request_id, i + 1 AS variant, CASE WHEN e = 1 THEN coalesce(english, m.caption) ELSE m.caption END AS caption, descriptive_name, creator_side, gameplay_zoom, creator_scale, darken_strength
FROM made m JOIN lay USING (i) LEFT JOIN eng ON eng.caption = m.caption"""
    sql["name_slugs"] = f"""
WITH {ATTEMPTS}, s AS (SELECT *, trim(regexp_replace(lower(hook), '[^a-z0-9]+', '_', 'g'), '_') AS sl, regexp_replace(hook, '[^a-zA-Z0-9]+', '', 'g') AS h, array_to_string(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> ''), ' ') AS ti FROM meta),
c AS (SELECT *, rtrim(substr(ti, 1, 37)) AS cu FROM s)
SELECT conv_id, attempt, CASE WHEN sl = '' THEN 'untitled' ELSE sl END AS slug, CASE WHEN h = '' THEN '#Gaming' ELSE '#' || h END AS hashtag,
  CASE WHEN length(ti) <= 40 THEN ti ELSE (CASE WHEN contains(cu, ' ') THEN regexp_replace(cu, ' [^ ]*$', '') ELSE cu END) || '...' END AS title FROM c"""
    sql["probe_media"] = """
WITH p AS (SELECT p_partkey AS media_id, p_size AS n, p_size % 17 = 0 AS torn, p_size % 9 <> 0 AS video, p_size % 9 = 0 OR p_size % 6 <> 0 AS audio, CASE WHEN p_size % 10 = 0 THEN 0.5 ELSE p_size + 0.5 END AS d FROM part)
SELECT media_id, CASE WHEN torn THEN 0 ELSE d::DOUBLE END AS duration_seconds, CASE WHEN torn OR NOT video THEN 0 ELSE n * 16 END AS width, CASE WHEN torn OR NOT video THEN 0 ELSE n * 9 END AS height,
  CASE WHEN torn OR NOT video THEN 0 WHEN n % 4 = 0 THEN 0 WHEN n % 4 = 1 THEN round(n * 1000 / 1001::DOUBLE, 6) ELSE n END::DOUBLE AS fps,
  CASE WHEN torn OR NOT video THEN 'unknown' ELSE 'h264' END AS video_codec, CASE WHEN torn OR NOT audio THEN '' ELSE 'aac' END AS audio_codec, CASE WHEN torn OR NOT audio THEN 0 ELSE 128000 END AS audio_bitrate,
  CASE WHEN torn THEN 0 ELSE media_id * 1000 END AS file_size, NOT torn AND audio AS has_audio,
  CASE WHEN torn THEN 'unreadable' WHEN NOT video THEN 'no video stream' WHEN d <= 0 THEN 'no duration' WHEN n <= 0 THEN 'no frame size' END AS reject_reason FROM p"""
    sql["probe_media_lenient"] = """
WITH p AS (SELECT p_partkey AS media_id, p_size AS n, p_size % 17 = 0 AS torn, p_size % 9 <> 0 AS video, p_size % 9 = 0 OR p_size % 6 <> 0 AS audio, CASE WHEN p_size % 10 = 0 THEN 0.5 ELSE p_size + 0.5 END AS d FROM part)
SELECT media_id, CASE WHEN torn THEN 0 ELSE d::DOUBLE END AS duration_seconds, CASE WHEN torn OR NOT video THEN 0 ELSE n * 16 END AS width, CASE WHEN torn OR NOT video THEN 0 ELSE n * 9 END AS height,
  CASE WHEN torn OR NOT video THEN 0 ELSE 30 END::DOUBLE AS fps, CASE WHEN torn OR NOT video THEN '' ELSE 'h264' END AS video_codec, CASE WHEN torn OR NOT audio THEN '' ELSE 'aac' END AS audio_codec,
  CASE WHEN torn THEN 'unreadable' END AS reject_reason FROM p"""
    sql["profile_rules"] = """
SELECT s_suppkey AS profile_key, CASE WHEN s_suppkey % 11 = 0 THEN 'not a mapping' WHEN s_suppkey % 5 = 0 THEN 'missing: ai_face_generation' WHEN s_suppkey % 7 = 0 THEN 'channel_name is not a text'
  WHEN s_suppkey % 3 = 0 THEN 'brand_colors is not a list' END AS error FROM supplier"""
    sql["ranking_validity"] = """
WITH c AS (SELECT l_orderkey AS list_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS pos, l_partkey % 50 = 0 AS mov, l_linenumber AS rank, l_suppkey % 40 = 0 AS two, l_suppkey % 41 = 0 AS none FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY list_id, rank ORDER BY pos) AS k FROM c),
v AS (SELECT *, CASE WHEN mov THEN 'not an mp4 file' WHEN rank <= 0 THEN 'rank is not positive' WHEN k > 1 THEN 'rank is used twice' WHEN two THEN 'description is not one word' WHEN none THEN 'no description' END AS bad FROM r)
SELECT list_id, count(*) AS clip_count, CASE WHEN count(*) < 2 THEN 'fewer than two clips' ELSE arg_min(bad, pos) FILTER (bad IS NOT NULL) END AS first_violation FROM v GROUP BY list_id"""
    sql["countdown_order"] = """
WITH c AS (SELECT l_orderkey AS list_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS pos, l_linenumber AS rank FROM lineitem)
SELECT list_id, pos, rank, row_number() OVER (PARTITION BY list_id ORDER BY rank DESC, pos) AS show_order FROM c"""
    sql["profile_gaps"] = "SELECT s_suppkey AS profile_key, 'target_audience,preferred_language,brand_colors,logo,creator_photos_folder,' || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'style,' END || 'ai_face_generation' AS missing FROM supplier"
    sql["package_assembly"] = f"""
WITH {_caption_cte()}, {ATTEMPTS},
doc AS (SELECT doc_id, count(*) AS n, length(string_agg((caption_idx + 1) || E'\\n' || {_time("s", ",")} || ' --> ' || {_time("e", ",")} || E'\\n' || text, E'\\n\\n')) + 1 AS chars FROM cap GROUP BY 1)
SELECT s.doc_id AS media_id, s.doc_id % 3 + 1 AS rank, coalesce(n, 0) AS caption_count, coalesce(chars, 0) AS chars, coalesce(hook, 'now') AS hook, coalesce(title, 'clip ' || s.doc_id) AS title, coalesce(array_to_string(tags, ' '), '#clip') AS hashtags
FROM src s LEFT JOIN doc USING (doc_id) LEFT JOIN (SELECT * FROM meta QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY attempt DESC) = 1) m ON m.conv_id = s.doc_id"""
    sql["usable_envelopes"] = f"WITH {ENVELOPE} SELECT media_id AS session_id FROM lev GROUP BY 1 HAVING count(*) >= 16 AND stddev_pop(level) >= 0.01"
    sql["stage_shares"] = "SELECT event_id, round(CASE WHEN sum(value) OVER p > 0 THEN value / sum(value) OVER p ELSE 0 END, 6) AS share FROM events WINDOW p AS (PARTITION BY user_id)"
    sql["media_plan"] = """
WITH p AS (SELECT p_partkey AS media_id, p_size AS n, CASE WHEN p_size % 10 = 0 THEN 0.5 ELSE p_size + 0.5 END::DOUBLE AS d FROM part WHERE p_size % 17 <> 0 AND p_size % 9 <> 0)
SELECT media_id, CASE WHEN media_id % 2 = 0 THEN 0.35 ELSE 0.28 END AS scene_threshold, round(CASE WHEN media_id % 2 = 0 THEN greatest(8, least(d / 20, 45)) ELSE greatest(2, least(d / 20, 12)) END, 6) AS spacing,
  round(greatest(1, least(d * 0.03, 20)), 6) AS margin, CASE WHEN n * 16 <= 320 THEN n * 9 ELSE greatest(1, CAST(round_even(n * 9 * 320.0::DOUBLE / (n * 16), 0) AS BIGINT)) END AS frame_height FROM p"""
    # a frame is mirrored at its edges, without the edge itself: place 0 is row 2, place 9 is row 7
    sql["frame_pixels"] = """
WITH f AS (SELECT label::BIGINT AS media_id, vec_id AS frame_number, embedding AS g FROM embeddings),
px AS (
  SELECT media_id, frame_number, g[y * 8 + x + 1]::DOUBLE AS v,
    g[abs(y - 1) * 8 + x + 1]::DOUBLE + g[(7 - abs(6 - y)) * 8 + x + 1]::DOUBLE + g[y * 8 + abs(x - 1) + 1]::DOUBLE + g[y * 8 + (7 - abs(6 - x)) + 1]::DOUBLE - 4 * g[y * 8 + x + 1]::DOUBLE AS lap
  FROM f, range(8) r(y), range(8) c(x))
SELECT media_id, frame_number, round(avg(v), 6) AS brightness, round(stddev_pop(v), 6) AS contrast, round(var_pop(lap), 6) AS sharpness FROM px GROUP BY ALL"""
    sql["blurred_frames"] = """
WITH f AS (SELECT label::BIGINT AS media_id, vec_id AS frame_number, embedding AS g FROM embeddings), w(i, k) AS (VALUES (0, 1::DOUBLE), (1, 4::DOUBLE), (2, 6::DOUBLE), (3, 4::DOUBLE), (4, 1::DOUBLE))
SELECT media_id, frame_number, y * 8 + x AS pixel, round(sum(a.k * b.k / 256 * g[(7 - abs(7 - abs(y + a.i - 2))) * 8 + (7 - abs(7 - abs(x + b.i - 2))) + 1]::DOUBLE), 6) AS value
FROM f, range(8) r(y), range(8) c(x), w a, w b GROUP BY ALL"""
    sql["caption_translations"] = "SELECT event_id, CASE event_type WHEN 'click' THEN 'klick' WHEN 'view' THEN 'blick' ELSE event_type END AS caption FROM events"
    sql["profile_logos"] = "SELECT s_suppkey AS profile_key, s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AS logo_enabled, CASE WHEN s_suppkey % 3 = 0 THEN 'logo.png' ELSE '' END AS logo_path FROM supplier"
    return sql
