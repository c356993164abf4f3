"""DuckDB SQL of the queries in ``operators/rules.py``, written apart from them."""

from __future__ import annotations

LEVELS = "lv AS (SELECT vec_id, label, i - 1 AS i, CAST(floor(list_extract(embedding, i) * 1000) AS BIGINT) AS v FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) t)"
RGBA = "px AS (SELECT vec_id, i // 4 AS pixel, i % 4 AS channel, CASE WHEN i % 4 = 3 AND abs(v) % 256 % 3 = 0 THEN 0 ELSE abs(v) % 256 END AS p FROM lv)"
#: A table of what happens to each known chunk (fixed values).
POLICY = "policy AS (SELECT unnest(['IHDR','PLTE','tRNS','IDAT','iCCP']) AS name, 'rebuild' AS action UNION ALL SELECT unnest(['gAMA','cHRM','sRGB','cICP','mDCV','mDCv','cLLI','cLLi','sBIT','bKGD','hIST','pHYs','sPLT']), 'keep')"

ORACLE_SQL = {
    "size_label": """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE l_linenumber % 7 WHEN 0 THEN -1 WHEN 1 THEN floor(l_extendedprice) WHEN 2 THEN floor(l_extendedprice) * 977 WHEN 3 THEN floor(l_extendedprice) * 700001
  WHEN 4 THEN floor(l_extendedprice) * 30000001 WHEN 5 THEN 1000000 - l_partkey % 3 ELSE l_suppkey % 3 END AS BIGINT) AS size FROM lineitem),
u AS (SELECT *, CASE WHEN size < 1000 THEN 0 ELSE least(4, (length(CAST(size AS VARCHAR)) - 1) // 3) END AS power FROM s),
d AS (SELECT *, CASE WHEN power = 0 THEN 0 ELSE 2 - (length(CAST(size AS VARCHAR)) - 1 - 3 * power) END AS want FROM u),
r AS (SELECT *, greatest(want, 0) AS digits, CAST(round(CAST(size AS DOUBLE) * pow(10, greatest(want, 0)) / pow(1000, power)) AS BIGINT) AS n FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, size, CASE WHEN size < 0 THEN '—' ELSE format('{:,}', n // CAST(pow(10, digits) AS BIGINT))
  || CASE WHEN digits > 0 THEN '.' || lpad(CAST(n % CAST(pow(10, digits) AS BIGINT) AS VARCHAR), CAST(digits AS INT), '0') ELSE '' END
  || ' ' || CASE WHEN power = 0 AND size = 1 THEN 'byte' ELSE list_extract(['bytes', 'kB', 'MB', 'GB', 'TB'], power + 1) END END AS label FROM r""",
    "reduction_label": """
WITH f AS (SELECT doc_id AS id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS original_size, doc_id % 111 AS share FROM documents),
g AS (SELECT id, original_size, original_size * share // 100 AS output_size FROM f),
p AS (SELECT *, CASE WHEN original_size > 0 AND output_size < original_size THEN (1 - CAST(output_size AS DOUBLE) / original_size) * 100 ELSE 0 END AS percent FROM g)
SELECT id, original_size, output_size, CASE WHEN percent >= 10 THEN CAST(CAST(floor(percent) AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.1f', floor(percent * 10) / 10), '[.]0$', '') END AS label FROM p""",
    "options_key": """
SELECT p_partkey AS id,
  CASE WHEN p_size <= 10 THEN 'lossless' ELSE CAST(p_size + 30 AS VARCHAR) || '/' || CASE WHEN p_size % 3 = 0 THEN 'keep' ELSE CAST(p_size * 10 AS VARCHAR) END END
    || CASE WHEN p_size > 10 AND p_size % 2 = 0 THEN '+photos' ELSE '' END || CASE WHEN p_retailprice > 1000 THEN '+metadata' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '+editing' ELSE '' END AS pdf_key,
  CASE WHEN p_size <= 10 THEN 'lossless' ELSE 'q' || CAST(p_size + 30 AS VARCHAR) END || '+' || CASE WHEN p_size % 3 = 0 THEN 'webp-lossless' ELSE 'webp' || CAST(p_size * 10 AS VARCHAR) END || '+png' || CAST(p_partkey % 7 AS VARCHAR)
    || CASE WHEN p_size % 2 = 0 THEN '+zopfli' ELSE '' END || CASE WHEN p_retailprice > 1000 THEN '+metadata' ELSE '' END AS image_key
FROM part""",
    "pdf_details": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'Already optimal: original kept, nothing removed' ELSE 'Already optimal' END AS kept,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE (o_orderkey % 4 + 1) || CASE o_orderkey % 4 WHEN 0 THEN ' page' ELSE ' pages' END || ' · ' || (o_custkey % 3) || CASE o_custkey % 3 WHEN 1 THEN ' image' ELSE ' images' END || ' re-encoded, ' || (o_orderkey % 3) || ' downsampled · '
    || (o_custkey % 2) || CASE o_custkey % 2 WHEN 1 THEN ' duplicate stream merged' ELSE ' duplicate streams merged' END
    || CASE WHEN o_custkey % 5 = 0 THEN ' · metadata removed' ELSE '' END || CASE WHEN o_custkey % 7 = 0 THEN ' · document metadata kept for PDF/A, PDF/UA or PDF/X' ELSE '' END
    || CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' · 1 thumbnail removed' ELSE ' · ' || (o_orderkey % 6) || ' thumbnails removed' END || CASE WHEN o_custkey % 4 = 0 THEN '' ELSE ' · editing data removed' END END AS details
FROM orders""",
    "image_details": """
WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG' ELSE 'WebP' END AS f, (p_size * 10) || '×' || (p_partkey % 900 + 1) AS s, p_size % 2 AS odd, p_partkey % 5 = 0 AS bare FROM part)
SELECT id, f || ' ' || s || CASE odd WHEN 0 THEN ' · re-encoded' ELSE ' · pixels unchanged' END || CASE WHEN bare THEN ' · metadata removed' ELSE '' END AS compressed,
  f || ' ' || s || CASE f WHEN 'JPEG' THEN ' · lossy' ELSE ' · lossless' END || CASE WHEN bare THEN ' · transparency flattened' ELSE '' END || ' · metadata removed' AS converted FROM r""",
    "report_fields": """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 4 ELSE 3 END AS fields, turn % 3 = 0 AS refused, CASE WHEN turn % 3 = 0 THEN NULL ELSE role END AS status, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn || '=x' END AS turn_field FROM conversations""",
    "metadata_policy": f"""
WITH {POLICY},
c AS (SELECT l_orderkey, l_linenumber, l_partkey, list_extract(['IHDR','PLTE','tRNS','IDAT','iCCP','gAMA','cHRM','sRGB','cICP','mDCV','mDCv','cLLI','cLLi','sBIT','bKGD','hIST','pHYs','sPLT','tEXt','zTXt','iTXt','tIME','eXIf','prVt','prVT','vpAg','acTL'], l_partkey % 27 + 1) AS name,
  l_linenumber % 2 = 0 AS strip, l_suppkey % 2 = 0 AS oriented FROM lineitem),
a AS (SELECT c.*, coalesce(policy.action, CASE WHEN strip THEN CASE WHEN c.name = 'eXIf' AND oriented THEN 'replace' ELSE 'drop' END
  WHEN c.name IN ('tEXt', 'zTXt', 'iTXt', 'tIME', 'eXIf') OR regexp_matches(c.name, '[a-z]$') THEN 'keep' ELSE 'drop' END) AS action FROM c LEFT JOIN policy USING (name))
SELECT *, strip AND action = 'drop' AS removes FROM a""",
    "gain_thresholds": """
WITH r AS (SELECT p_partkey AS id, CAST(floor(p_retailprice) AS BIGINT) AS old, CAST(floor(p_retailprice * (p_size + 60) / 100) AS BIGINT) AS new, p_partkey % 1300 + 1 AS deflated FROM part)
SELECT id, old, new, new < CAST(trunc(old * CAST(0.98 AS DOUBLE)) AS BIGINT) AS in_pdf, new <= (CASE WHEN deflated < old THEN deflated ELSE old END) * CAST(0.98 AS DOUBLE) AS as_file, new <= (CASE WHEN deflated < old THEN deflated ELSE old END) * CAST(0.8 AS DOUBLE) AS as_photo FROM r""",
    "image_candidates": """
WITH r AS (SELECT p_partkey AS id, list_extract(['gray', 'gray', 'rgb', 'rgb', NULL, 'gray', 'rgb', 'icc', NULL, NULL], p_partkey % 10 + 1) AS space, list_extract([1, 3, 4], p_partkey % 3 + 1) AS n, CAST(p_size * 50 - 50 AS BIGINT) AS w, p_partkey % 2000 AS h, p_partkey % 4 = 0 AS jpx,
    CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 4 = 0 ELSE p_partkey % 5 > 0 END AS bits_ok FROM part),
k AS (SELECT id, w, h, CASE WHEN id % 13 = 0 OR id % 11 = 0 OR NOT bits_ok OR (jpx AND (id % 17 = 0 OR id % 3 > 0)) OR w <= 0 OR h <= 0 OR w * h > 3000000 OR space IS NULL THEN NULL WHEN space <> 'icc' THEN space WHEN n = 1 THEN 'gray' WHEN n = 3 THEN 'rgb' END AS pixels FROM r),
t AS (SELECT *, CASE WHEN pixels IS NOT NULL AND id % 6 > 0 THEN greatest(h / 4.0 / 72 * 150 / w, w / 7.0 / 72 * 150 / h) END AS scale FROM k)
SELECT id, pixels, CASE WHEN scale * 1.15 < 1 THEN greatest(1, CAST(round(CAST(w * scale AS DOUBLE)) AS BIGINT)) END AS target_width, CASE WHEN scale * 1.15 < 1 THEN greatest(1, CAST(round(CAST(h * scale AS DOUBLE)) AS BIGINT)) END AS target_height FROM t""",
    "target_size": """
WITH r AS (SELECT p_partkey AS id, CAST(p_size * 40 + 1 AS DOUBLE) AS w, CAST(p_partkey % 900 + 60 AS DOUBLE) AS h, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice / 8 END AS wp, CAST(p_size AS DOUBLE) * 6.5 - 13 AS hp, CAST(CASE p_partkey % 3 WHEN 0 THEN 72 WHEN 1 THEN 150 ELSE 200 END AS DOUBLE) AS dpi FROM part),
s AS (SELECT id, w, h, CASE WHEN wp > 0 AND hp > 0 THEN greatest(wp / CAST(72 AS DOUBLE) * dpi / w, hp / CAST(72 AS DOUBLE) * dpi / h) END AS scale FROM r)
SELECT id, CASE WHEN scale * CAST(1.15 AS DOUBLE) < 1 THEN greatest(CAST(round(w * scale) AS BIGINT), 1) END AS target_width, CASE WHEN scale * CAST(1.15 AS DOUBLE) < 1 THEN greatest(CAST(round(h * scale) AS BIGINT), 1) END AS target_height FROM s""",
    "intake_outcome": """
SELECT coalesce(source, '') AS scope, 'f' || doc_id AS name, CASE WHEN doc_id % 23 = 0 THEN 'skipped' WHEN doc_id % 4 > 0 AND doc_id % 3 = 2 THEN 'ignored' WHEN doc_id % 19 = 0 THEN 'skipped' ELSE 'added' END AS outcome FROM documents""",
    "batch_totals": """
WITH j AS (SELECT o_orderpriority AS tool, CAST(floor(o_totalprice) AS BIGINT) AS old, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 13 + 90) // 100 AS made, o_custkey % 7 = 0 AS outdated FROM orders WHERE o_orderstatus = 'F')
SELECT tool, count(*) AS jobs, CAST(sum(CASE WHEN made < old THEN 1 ELSE 0 END) AS BIGINT) AS savable, CAST(sum(old) AS BIGINT) AS total_before, CAST(sum(CASE WHEN made < old THEN made ELSE old END) AS BIGINT) AS total_after, max(CASE WHEN outdated THEN 1 ELSE 0 END) = 1 AS any_outdated FROM j GROUP BY tool""",
    "unique_names": """
WITH n AS (SELECT doc_id, coalesce(source, '') || '-' || coalesce(lang, 'none') AS stem FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY doc_id) AS k FROM n),
m AS (SELECT doc_id, stem, CASE WHEN length(stem) % 2 = 1 THEN k WHEN k = 1 THEN 2 ELSE k + 2 END AS k FROM r)
SELECT doc_id, CASE WHEN k = 1 THEN stem || '.txt' ELSE stem || ' (' || k || ').txt' END AS name FROM m""",
    "registered": "SELECT row_number() OVER (ORDER BY min(doc_id)) AS id, min(doc_id) AS first_id, source AS scope, sha256(coalesce(text, '')) AS path FROM documents GROUP BY source, coalesce(text, '')",
    "renumbered": "SELECT a.c_custkey AS old_id, (SELECT count(*) FROM customer b WHERE b.c_custkey % 3 > 0 AND b.c_custkey <= a.c_custkey) AS new_id FROM customer a WHERE a.c_custkey % 3 > 0",
    "folder_cap": """
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lower(lang) NULLS FIRST, lang NULLS FIRST, doc_id) AS rn FROM documents)
SELECT source, count(*) FILTER (WHERE rn <= 20) AS added, count(*) FILTER (WHERE rn > 20) AS cut, max(rn) > 20 AS truncated, max(doc_id) FILTER (WHERE rn <= 20) AS largest_added FROM r GROUP BY source""",
    "rewritten_references": "WITH k AS (SELECT text, min(doc_id) AS keeper FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT l.doc_id AS owner, l.quality, coalesce(k.keeper, l.doc_id) AS reference FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN k ON k.text = d.text",
    "added_files": "SELECT id, bool_and(fresh) AS added FROM (SELECT doc_id AS id, false AS fresh FROM labels UNION ALL SELECT doc_id, true FROM documents) t GROUP BY id",
    "dropped_jobs": "SELECT o_orderkey AS job, o_custkey AS file FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "job_states": """
WITH e AS (SELECT user_id AS job, event_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'cancelled' END AS ending FROM events),
f AS (SELECT job, min(event_id) AS at, min_by(ending, event_id) AS ending FROM e WHERE ending IS NOT NULL GROUP BY job),
b AS (SELECT job, min(event_id) AS first FROM e GROUP BY job)
SELECT e.job, e.event_id, CASE WHEN e.event_id > f.at THEN f.ending WHEN e.event_id = b.first THEN 'waiting' ELSE 'working' END AS state, CASE WHEN e.event_id >= f.at THEN f.ending ELSE 'working' END AS next_state FROM e JOIN b ON e.job = b.job LEFT JOIN f ON e.job = f.job""",
    "download_progress": """
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS size FROM lineitem GROUP BY ALL)
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, CAST(sum(b.size) FILTER (WHERE (b.l_linenumber, b.l_partkey, b.l_suppkey) <= (a.l_linenumber, a.l_partkey, a.l_suppkey)) AS BIGINT) AS done, CAST(sum(b.size) AS BIGINT) AS total
FROM f a JOIN f b ON a.l_orderkey = b.l_orderkey GROUP BY a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey""",
    "evidence_predicates": """
WITH e AS (SELECT event_id, event_type, value * 5 AS ms, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, coalesce(ms >= 0 AND ms <= 250, false) AS quick, coalesce(event_type = 'purchase' AND k % 5 <> 0, false) AS completed, coalesce(event_type = 'error' AND ms >= 0 AND ms <= 250 AND k % 2 = 0, false) AS cancelled FROM e""",
    "option_documents": """
WITH o AS (SELECT p_partkey AS id, p_partkey % 10 > 0 AND p_size * 2 >= 30 AND p_size * 2 <= 95 AND (p_partkey % 3 = 0 OR (p_size * 15 >= 72 AND p_size * 15 <= 600)) AS good, p_size * 2 AS q, p_size * 15 AS dpi FROM part)
SELECT id, CASE WHEN good THEN NULL ELSE 'invalidOptions' END AS error_code, CASE WHEN good THEN '{"jpegQuality":' || q || CASE WHEN id % 3 = 0 THEN '' ELSE ',"maxDpi":' || dpi END || '}' END AS options FROM o""",
    "page_streams": "SELECT conv_id, string_agg(turn || ' ' || role, chr(10) ORDER BY turn, role) AS content FROM conversations GROUP BY conv_id",
    "glyph_dict": """
WITH r AS (SELECT s_suppkey % 25 AS font, s_suppkey * 7 % 500 AS first, min(s_suppkey) AS fd FROM supplier GROUP BY ALL),
n AS (SELECT *, lead(first) OVER (PARTITION BY font ORDER BY first) AS next FROM r)
SELECT p_partkey % 25 AS font, p_partkey AS glyph, n.fd FROM part LEFT JOIN n ON n.font = p_partkey % 25 AND p_partkey // 25 >= n.first AND (n.next IS NULL OR p_partkey // 25 < n.next)""",
    "restart_markers": """
WITH m AS (SELECT s_suppkey AS image, s_suppkey % 5 AS step, CAST(unnest(range(46)) AS INTEGER) AS mcu FROM supplier),
k AS (SELECT image, mcu, CASE WHEN step > 0 AND mcu > 0 THEN CASE WHEN mcu % step = 0 THEN row_number() OVER (PARTITION BY image, step > 0 AND mcu > 0 AND mcu % (CASE WHEN step = 0 THEN 1 ELSE step END) = 0 ORDER BY mcu) END END AS nth FROM m)
SELECT image, mcu, (nth - 1) % 8 AS marker FROM k""",
    "run_symbols": f"""
WITH {LEVELS}, c AS (SELECT vec_id, i AS k, CASE WHEN abs(v) % 5 < 3 THEN 0 ELSE v % 700 END AS v FROM lv WHERE i > 0),
z AS (SELECT a.vec_id, a.k, a.v, a.k - 1 - coalesce((SELECT max(b.k) FROM c b WHERE b.vec_id = a.vec_id AND b.k < a.k AND b.v <> 0), 0) AS zeros, length(bin(abs(a.v))) AS size FROM c a WHERE a.v <> 0)
SELECT vec_id, k, zeros // 16 AS zrl, CAST(zeros % 16 * 16 + size AS BIGINT) AS symbol, CASE WHEN v < 0 THEN (CAST(1 AS BIGINT) << CAST(size AS INT)) - 1 - abs(v) ELSE v END AS bits FROM z
UNION ALL SELECT vec_id, 64, 0, 0, 0 FROM c GROUP BY vec_id HAVING bool_and(k < 63 OR v = 0)""",
    "mcu_blocks": """
WITH i AS (SELECT s_suppkey AS image, s_suppkey % 90 + 1 AS w, s_suppkey % 70 + 1 AS h, s_suppkey % 2 + 1 AS hm, s_suppkey // 2 % 2 + 1 AS vm FROM supplier WHERE s_suppkey <= 200),
p AS (SELECT i.*, c.component, CASE c.component WHEN 0 THEN hm ELSE 1 END AS ch, CASE c.component WHEN 0 THEN vm ELSE 1 END AS cv, (w + 8 * hm - 1) // (8 * hm) AS mw, (h + 8 * vm - 1) // (8 * vm) AS mh FROM i, (VALUES (0), (1)) c(component)),
y AS (SELECT *, unnest(range(mh * cv)) AS block_y FROM p), b AS (SELECT *, unnest(range(mw * ch)) AS block_x FROM y)
SELECT image, block_y // cv * mw + block_x // ch AS mcu, component, block_y % cv * ch + block_x % ch AS place, block_y, block_x, ((w * ch + hm - 1) // hm + 7) // 8 AS own_blocks_w FROM b""",
    "pixel_metrics": f"""
WITH {LEVELS}, {RGBA}, q AS (SELECT a.vec_id, a.pixel, a.channel, a.p, abs(a.p - b.p) AS e FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND b.pixel = a.pixel AND b.channel = a.channel),
s AS (SELECT vec_id, pixel FROM px WHERE channel = 3 AND p > 0)
SELECT q.vec_id, coalesce(avg(e) FILTER (WHERE channel < 3 AND s.pixel IS NOT NULL), 0) AS rgb_mean_error, coalesce(max(e) FILTER (WHERE channel < 3 AND s.pixel IS NOT NULL), 0) AS rgb_max_error, max(e) FILTER (WHERE channel = 3) AS alpha_max_error
FROM q LEFT JOIN s ON s.vec_id = q.vec_id AND s.pixel = q.pixel GROUP BY q.vec_id""",
    "tile_pairs": f"""
WITH {LEVELS}, t AS (SELECT vec_id // 4 AS tile, (vec_id % 4 * 64 + i) // 16 AS y, (vec_id % 4 * 64 + i) % 16 AS x, abs(v) % 256 AS p FROM lv),
w AS (SELECT tile FROM t GROUP BY tile HAVING count(*) = 256),
d AS (SELECT a.tile, abs(a.p - b.p) AS d FROM t a JOIN t b ON a.tile = b.tile AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))),
c AS (SELECT tile, max(n) AS top_tone FROM (SELECT tile, p, count(*) AS n FROM t GROUP BY tile, p) u GROUP BY tile),
s AS (SELECT tile, count(*) FILTER (WHERE d <= 2) AS flat, count(*) FILTER (WHERE d >= 48) AS sharp, count(*) AS pairs FROM d GROUP BY tile)
SELECT s.*, top_tone, NOT (top_tone >= 64) AND flat < 0.35 * pairs AND sharp < 0.15 * pairs AS photographic FROM s JOIN w USING (tile) JOIN c USING (tile)""",
    "box_mean": f"""
WITH {LEVELS}, g AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM lv)
SELECT a.vec_id, a.y, a.x, avg(b.v) AS mean FROM g a JOIN g b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY a.vec_id, a.y, a.x""",
    "best_mask": f"""
WITH {LEVELS}, m AS (SELECT label, vec_id, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS area, max(abs(v)) // 100 AS score FROM lv GROUP BY label, vec_id)
SELECT label, max(vec_id) FILTER (WHERE area = top_area) AS automatic, max(vec_id) FILTER (WHERE score = top_score) AS clicked FROM (SELECT *, max(area) OVER (PARTITION BY label) AS top_area, max(score) OVER (PARTITION BY label) AS top_score FROM m) t GROUP BY label""",
    "alpha_gates": f"""
WITH {LEVELS}, s AS (SELECT vec_id, i, 1 / (1 + exp(-(CASE WHEN v > 1500 THEN 30 WHEN v < -1500 THEN -30 ELSE v / CAST(50 AS DOUBLE) END))) AS a FROM lv)
SELECT vec_id, i, CAST(round(CASE WHEN a > 0.02 AND a < 0.98 THEN a WHEN a >= 0.98 THEN 1 ELSE 0 END * 1000000) AS BIGINT) AS alpha_millionths FROM s""",
    "valid_masks": """
SELECT vec_id, len(embedding) BETWEEN 1 AND 1048576 AND len(embedding) = CASE WHEN vec_id % 7 = 0 THEN 72 ELSE 64 END AND (vec_id % 11 > 0 OR (CAST(list_max(embedding) AS DOUBLE) <= 0.15 AND CAST(list_min(embedding) AS DOUBLE) >= -0.15)) AS valid FROM embeddings""",
    "tensor_values": f"""
WITH {LEVELS}, {RGBA} SELECT vec_id, pixel, channel, round((p / CAST(255 AS DOUBLE) - CASE channel WHEN 0 THEN CAST(0.485 AS DOUBLE) WHEN 1 THEN CAST(0.456 AS DOUBLE) ELSE CAST(0.406 AS DOUBLE) END) / CASE channel WHEN 0 THEN CAST(0.229 AS DOUBLE) WHEN 1 THEN CAST(0.224 AS DOUBLE) ELSE CAST(0.225 AS DOUBLE) END, 6) AS value FROM px WHERE channel < 3""",
    "pixel_digest": f"""
WITH {LEVELS}, {RGBA}, h AS (SELECT vec_id, pixel FROM px WHERE channel = 3 AND p = 0),
s AS (SELECT px.vec_id, px.pixel, channel, CASE WHEN h.pixel IS NOT NULL THEN 0 ELSE p END AS p FROM px LEFT JOIN h ON h.vec_id = px.vec_id AND h.pixel = px.pixel)
SELECT vec_id, sha256(string_agg(printf('%02X', CAST(p AS INT)), '' ORDER BY pixel, channel)) AS digest FROM s GROUP BY vec_id""",
    "oriented": f"""
WITH {LEVELS}, m AS (SELECT * FROM (VALUES (1, 1, 0, 0, 0, 1, 0), (2, -1, 0, 7, 0, 1, 0), (3, -1, 0, 7, 0, -1, 3), (4, 1, 0, 0, 0, -1, 3), (5, 0, 1, 0, 1, 0, 0), (6, 0, -1, 3, 1, 0, 0), (7, 0, -1, 3, -1, 0, 7), (8, 0, 1, 0, -1, 0, 7)) t(o, a, b, c, d, e, f))
SELECT vec_id, o AS orientation, a * (i % 8) + b * (i // 8) + c AS x, d * (i % 8) + e * (i // 8) + f AS y, v FROM lv JOIN m ON m.o = vec_id % 8 + 1 WHERE i < 32""",
}

#: Apart from the queries of ``operators/tabular.py`` as well: tables of outcomes, joins and comparisons in
#: place of their CASE chains and windows.
ORACLE_SQL |= {
    "file_kind": """
SELECT doc_id AS id, list_extract(['pdf', 'PNG', 'jpeg', 'mp4', 'mp3', 'txt', 'webp', 'Pdf', 'JPG', 'mov'], doc_id % 10 + 1) AS ext,
  CASE WHEN contains(left(text, 1024), 'PDF-') THEN 'pdf' ELSE list_extract(['other', 'image', 'image', 'video', 'audio', 'other', 'image', 'other', 'image', 'video'], doc_id % 10 + 1) END AS kind FROM documents""",
    "kind_counts": """
WITH k AS (SELECT CASE WHEN contains(left(text, 1024), 'PDF-') THEN 'pdf' WHEN doc_id % 10 IN (1, 2, 6, 8) THEN 'image' WHEN doc_id % 10 IN (3, 9) THEN 'video' WHEN doc_id % 10 = 4 THEN 'audio' ELSE 'other' END AS kind, CAST(strlen(text) AS BIGINT) AS size FROM documents)
SELECT kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size, max(size) AS largest FROM k GROUP BY kind""",
    "raster_format": """
SELECT doc_id AS id, list_extract(['jpeg', 'png', 'webp', NULL, NULL, NULL, NULL], doc_id % 7 + 1) AS format, list_extract(['unknown', 'unknown', 'unknown', 'HEIF or AVIF', 'GIF', 'TIFF', 'BMP'], doc_id % 7 + 1) AS description FROM documents""",
    "kept_reason": """
WITH f AS (SELECT *, list_extract(['jpeg', 'png', 'webp'], l_partkey % 3 + 1) AS format FROM lineitem)
SELECT l_orderkey, l_linenumber, format, coalesce(if(l_quantity > 40, 'extraData', NULL), if(format IN ('png', 'webp') AND l_tax > 0.06, 'animated', NULL), if(l_discount > 0.07, 'signed', NULL), if(format IN ('jpeg', 'webp') AND l_suppkey % 5 = 0, 'unsupportedEncoding', NULL)) AS kept FROM f""",
    "accepted_files": """
WITH k AS (SELECT doc_id AS id, doc_id % 10 AS d, contains(left(text, 1024), 'PDF-') AS pdf FROM documents)
SELECT id, CASE WHEN pdf THEN 'pdf' WHEN d IN (1, 2, 6, 8) THEN 'image' WHEN d IN (3, 9) THEN 'video' WHEN d = 4 THEN 'audio' ELSE 'other' END AS kind, CASE WHEN pdf THEN d IN (0, 1, 2, 7, 8) ELSE d IN (1, 2, 8) END AS accepted FROM k""",
    "lookup_errors": """
SELECT o_orderkey AS job, o_custkey AS id, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN NULL WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 'wrongTool' ELSE 'unknownFile' END AS error_code FROM orders""",
    "latest_result": """
WITH t AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id), e AS (SELECT user_id, max(event_id) AS event_id FROM events JOIN t USING (user_id, ts) GROUP BY user_id)
SELECT user_id AS id, event_id AS result, event_type AS extension FROM e JOIN events USING (user_id, event_id)""",
    "unsaved_results": """
WITH s AS (SELECT count(DISTINCT user_id) AS saved FROM events WHERE event_type = 'purchase'), a AS (SELECT count(DISTINCT user_id) AS results FROM events) SELECT results - saved AS unsaved, saved, results FROM s, a""",
    "pruned_objects": "SELECT (SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON o_custkey = c_custkey) AS kept, count(*) - (SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON o_custkey = c_custkey) AS removed FROM customer",
    "resource_priority": """
WITH p AS (SELECT o_custkey, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY o_custkey) SELECT o_custkey AS owner, min(o_orderkey) AS resource FROM orders JOIN p USING (o_custkey, o_orderpriority) GROUP BY o_custkey""",
    "preset_matrix": """
SELECT s_suppkey AS id, p.preset, p.quality, p.dpi FROM supplier, (SELECT 'lossless' AS preset, NULL AS quality, NULL AS dpi UNION ALL SELECT 'balanced', 85, 200 UNION ALL SELECT 'maximum', 70, 150 UNION ALL SELECT 'screen', 65, 100) p""",
    "dc_differences": """
WITH c AS (SELECT *, (l_linenumber - 1) // 3 AS segment, row_number() OVER (PARTITION BY l_orderkey, (l_linenumber - 1) // 3 ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS k FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, CASE a.segment WHEN 0 THEN NULL ELSE (a.segment + 7) % 8 END AS restart, CAST(a.l_quantity AS BIGINT) - CASE WHEN a.k = 1 THEN 0 ELSE CAST(b.l_quantity AS BIGINT) END AS diff
FROM c a LEFT JOIN c b ON b.l_orderkey = a.l_orderkey AND b.segment = a.segment AND b.k = a.k - 1""",
    "dc_values": """
WITH c AS (SELECT *, (l_linenumber - 1) // 3 AS segment, row_number() OVER (PARTITION BY l_orderkey, (l_linenumber - 1) // 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, CAST(sum(CAST(b.l_quantity AS BIGINT)) AS BIGINT) AS value FROM c a JOIN c b ON b.l_orderkey = a.l_orderkey AND b.segment = a.segment AND b.k <= a.k GROUP BY a.l_orderkey, a.l_linenumber, a.segment, a.k""",
    "integral_image": f"""
WITH {LEVELS}, g AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM lv)
SELECT a.vec_id, a.y, a.x, CAST(sum(b.v) AS BIGINT) AS total FROM g a JOIN g b ON b.vec_id = a.vec_id AND b.y <= a.y AND b.x <= a.x GROUP BY a.vec_id, a.y, a.x""",
    "visible_box": f"""
WITH {LEVELS}, s AS (SELECT vec_id, min(i % 8) AS left_x, max(i % 8) AS right_x, min(i // 8) AS top_y, max(i // 8) AS bottom_y, count(*) AS n FROM lv WHERE v > 0 GROUP BY vec_id)
SELECT e.vec_id, left_x, right_x, top_y, bottom_y, coalesce(n, 0) < 64 AS any_clear FROM embeddings e LEFT JOIN s USING (vec_id)""",
    "composited": f"""
WITH {LEVELS}, c AS (SELECT vec_id, i, abs(v) % 256 AS p, abs(v) * 7 % 256 AS a FROM lv)
SELECT vec_id, i, CAST(floor((p * a + 255 * (255 - a) + 127) / 255.0) AS BIGINT) AS over_white, (77 * p + 150 * a + 29 * p) >> 8 AS luma FROM c""",
    "subr_bias": "SELECT o_custkey AS font, count(*) AS subrs, CASE WHEN count(*) < 12.4 THEN 107 WHEN count(*) < 339 THEN 1131 ELSE 32768 END AS bias FROM orders GROUP BY o_custkey",
    "timely_progress": "SELECT user_id AS job, event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.event_id <= e.event_id)",
    "cancelled_tickets": "SELECT user_id AS job, event_id AS ticket, coalesce(event_id < last, false) AS cancelled FROM events LEFT JOIN (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY user_id) l USING (user_id)",
    "first_tool": "SELECT r_name, n_name AS tool FROM region JOIN (SELECT n_regionkey, min(n_nationkey) AS n_nationkey FROM nation GROUP BY n_regionkey) f ON r_regionkey = f.n_regionkey JOIN nation USING (n_nationkey)",
    "first_names": """
WITH n AS (SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY n_regionkey)
SELECT n_regionkey, array_to_string(names[1:3], ', ') || if(len(names) > 3, ' +' || (len(names) - 3), '') AS shown FROM n""",
    "median_latency": "SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS middle, max(o_totalprice) AS worst FROM orders GROUP BY o_orderpriority",
    "symbol_histogram": "SELECT l_returnflag AS class, l_linestatus AS tbl, CAST(l_quantity AS INT) AS symbol, count(*) AS n FROM lineitem GROUP BY ALL",
}
