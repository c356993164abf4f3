"""The file-processing operators as declarative queries, each on the driver's tables.

``documents`` plays the file registry: name, size in bytes and kind of each file are derived from
a row; other tables play presets, object graphs, ordered coefficients and masks.  Each entry names
the operators of the inventory (SURVEY section 2) that it expresses.
"""

from __future__ import annotations

#: Extensions by kind (fixed values), and ten example extensions dealt out by id.
FILES = """files AS (
  SELECT doc_id AS id, source AS scope, lang, text, CAST(OCTETS(text) AS BIGINT) AS size,
    CASE doc_id % 10 WHEN 0 THEN 'pdf' WHEN 1 THEN 'PNG' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'mp4' WHEN 4 THEN 'mp3' WHEN 5 THEN 'txt' WHEN 6 THEN 'webp' WHEN 7 THEN 'Pdf' WHEN 8 THEN 'JPG' ELSE 'mov' END AS ext
  FROM documents)"""
KIND = """CASE WHEN text LIKE '%PDF-%' AND substr(text, 1, 1024) LIKE '%PDF-%' THEN 'pdf' WHEN lower(ext) IN ('jpg', 'jpeg', 'png', 'webp') THEN 'image'
  WHEN lower(ext) IN ('mp4', 'mov', 'mkv', 'webm', 'avi') THEN 'video' WHEN lower(ext) IN ('mp3', 'wav', 'flac', 'm4a', 'ogg') THEN 'audio' ELSE 'other' END"""
LEVELS = "grid AS (SELECT vec_id, label, i, CAST(IDIV(i, 8) AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(floor(AT(embedding, CAST(i + 1 AS INT)) * CAST(1000 AS FLOAT)) AS BIGINT) AS v FROM (SELECT vec_id, label, embedding, EXPLODE_RANGE(0, 63) AS i FROM embeddings) e)"

QUERIES = {
    # The content decides a PDF, else the extension, in any letter case
    "file_kind": f"WITH {FILES} SELECT id, ext, {KIND} AS kind FROM files",
    "kind_counts": f"WITH {FILES}, k AS (SELECT {KIND} AS kind, size FROM files) SELECT kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size, max(size) AS largest FROM k GROUP BY kind",
    # Magic bytes, here as hex text
    "raster_format": """WITH h AS (SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN '524946460000000057454250' WHEN 3 THEN '0000001C6674797061766966' WHEN 4 THEN '474946383961' WHEN 5 THEN '49492A00' ELSE '424D' END AS head FROM documents)
      SELECT id, CASE WHEN head LIKE 'FFD8FF%' THEN 'jpeg' WHEN head LIKE '89504E470D0A1A0A%' THEN 'png' WHEN substr(head, 1, 8) = '52494646' AND substr(head, 17, 8) = '57454250' THEN 'webp' END AS format,
        CASE WHEN substr(head, 9, 8) = '66747970' THEN 'HEIF or AVIF' WHEN head LIKE '474946%' THEN 'GIF' WHEN head LIKE '49492A00%' OR head LIKE '4D4D002A%' THEN 'TIFF' WHEN head LIKE '424D%' THEN 'BMP' ELSE 'unknown' END AS description FROM h""",
    # Strictly over the limit is refused
    "size_guard": f"WITH {FILES} SELECT id, size, CASE WHEN size > 2000 THEN 'tooLarge' END AS error_code FROM files",
    # The first reason that holds, in the order of each format
    "kept_reason": """WITH f AS (SELECT l_orderkey, l_linenumber, CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' ELSE 'webp' END AS format, l_quantity > 40 AS extra, l_discount > 0.07 AS signed, l_tax > 0.06 AS animated, l_suppkey % 5 = 0 AS odd FROM lineitem)
      SELECT l_orderkey, l_linenumber, format, CASE WHEN extra THEN 'extraData' WHEN animated AND format <> 'jpeg' THEN 'animated' WHEN signed THEN 'signed' WHEN odd AND format <> 'png' THEN 'unsupportedEncoding' END AS kept FROM f""",
    # Lossy only if at least 2 percent better, never larger than the input
    "candidate_choice": f"""WITH {FILES}, c AS (SELECT id, size, CAST(floor(size * (0.90 + RATIO((id % 13), 100.0))) AS BIGINT) AS lossless, CAST(floor(size * (0.88 + RATIO((id % 17), 100.0))) AS BIGINT) AS lossy FROM files),
      b AS (SELECT *, least(lossless, size) AS reference FROM c)
      SELECT id, size, CASE WHEN lossy <= reference * 0.98 THEN lossy WHEN lossless < size THEN lossless ELSE size END AS output_size, CASE WHEN lossy <= reference * 0.98 THEN 'lossy' WHEN lossless < size THEN 'lossless' ELSE 'original' END AS choice FROM b""",
    # Accepted and rejected files of a tool
    "accepted_files": f"WITH {FILES}, k AS (SELECT id, ext, {KIND} AS kind FROM files) SELECT id, kind, kind IN ('pdf', 'image') AND lower(ext) IN ('pdf', 'jpg', 'jpeg', 'png') AS accepted FROM k",
    # Another tool's file, and a missing id, are errors as data
    "lookup_errors": "SELECT o_orderkey AS job, o_custkey AS id, CASE WHEN c.c_custkey IS NULL THEN 'unknownFile' WHEN c.c_mktsegment <> 'BUILDING' THEN 'wrongTool' END AS error_code FROM orders LEFT JOIN customer c ON o_custkey = c.c_custkey",
    # The digit within 16 bytes of the key
    "declared_part": "SELECT doc_id AS id, EXTRACT1('pdfaid:part=' || CAST(doc_id % 5 AS VARCHAR(9)) || substr(text, 1, 8), 'pdfaid:part[^0-9]{0,4}([0-9])') AS part FROM documents",
    # Evidence predicates and their summary
    "evidence_summary": "SELECT event_type, count(*) AS runs, COUNTIF(value IS NULL) AS refused, COUNTIF(value > 50) AS slow, max(value) AS worst FROM events GROUP BY event_type",
    # Hidden names and package folders
    "pruned_entries": """WITH p AS (SELECT page_id AS id, LASTPART(url) AS name, url FROM pages) SELECT id, name, name LIKE '.%' AS hidden, MATCHES(lower(url), '[.](app|bundle|framework|pages|numbers|key)/') AS in_package FROM p WHERE name <> ''""",
    # File x preset; presets are four rows
    "preset_matrix": """WITH presets AS (SELECT * FROM (VALUES ('lossless', 0, 0), ('balanced', 85, 200), ('maximum', 70, 150), ('screen', 65, 100)) AS t(preset, quality, dpi))
      SELECT s_suppkey AS id, preset, CASE WHEN quality = 0 THEN NULL ELSE quality END AS quality, CASE WHEN dpi = 0 THEN NULL ELSE dpi END AS dpi FROM supplier CROSS JOIN presets""",
    # K1: the last result of a file wins
    "latest_result": "WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id AS id, event_id AS result, event_type AS extension FROM r WHERE rn = 1",
    # Saved and unsaved results
    "unsaved_results": "WITH r AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS saved, max(event_id) AS made FROM events GROUP BY user_id) SELECT COUNTIF(saved IS NULL) AS unsaved, COUNTIF(saved IS NOT NULL) AS saved, count(*) AS results FROM r",
    # Targets that are inputs of this session
    "refused_targets": "SELECT s_suppkey AS id FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey AND c_nationkey = s_nationkey)",
    # Width and height maxima are taken apart
    "largest_placement": "WITH m AS (SELECT l_partkey, max(l_quantity) AS width_pt, max(l_extendedprice) AS height_pt FROM lineitem GROUP BY l_partkey) SELECT p_partkey, width_pt, height_pt FROM part LEFT JOIN m ON p_partkey = l_partkey",
    # The first resource by priority
    "resource_priority": "WITH c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders) SELECT o_custkey AS owner, o_orderkey AS resource FROM c WHERE rn = 1",
    # Kept, dropped and newly added
    "pruned_objects": "WITH o AS (SELECT DISTINCT o_custkey FROM orders), c AS (SELECT c_custkey, count(*) AS n FROM customer GROUP BY c_custkey) SELECT count(o_custkey) AS kept, CAST(coalesce(sum(n), 0) - count(o_custkey) AS BIGINT) AS removed FROM c LEFT JOIN o ON c_custkey = o_custkey",
    # Content digest as a cache key
    "content_digest": "SELECT SHA256(text) AS digest, count(*) AS uses, min(doc_id) AS computed_for FROM documents GROUP BY SHA256(text)",
    # Baseline and patched by case
    "paired_runs": "SELECT a.item_id, a.text = b.text AS same, length(a.text) - length(b.text) AS difference FROM benchmark a JOIN benchmark b ON a.item_id = b.item_id - 1",
    # Any transparent, bounding box of what is visible
    "visible_box": f"WITH {LEVELS} SELECT vec_id, min(CASE WHEN v > 0 THEN x END) AS left_x, max(CASE WHEN v > 0 THEN x END) AS right_x, min(CASE WHEN v > 0 THEN y END) AS top_y, max(CASE WHEN v > 0 THEN y END) AS bottom_y, COUNTIF(v <= 0) > 0 AS any_clear FROM grid GROUP BY vec_id",
    # Symbol histogram
    "symbol_histogram": "SELECT l_returnflag AS class, l_linestatus AS tbl, CAST(l_quantity AS INT) AS symbol, least(count(*), 2147483647) AS n FROM lineitem GROUP BY 1, 2, 3",
    # Errors and IoU of neighbouring masks
    "median_latency": "SELECT o_orderpriority, median(o_totalprice) AS middle, max(o_totalprice) AS worst FROM orders GROUP BY o_orderpriority",
    # Differential coding and its inverse, reset at restarts
    "dc_differences": "WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, IDIV(l_linenumber - 1, 3) AS segment, CAST(l_quantity AS BIGINT) AS value FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN segment > 0 THEN (segment - 1) % 8 END AS restart, value - coalesce(lag(value) OVER (PARTITION BY l_orderkey, segment ORDER BY l_linenumber, l_partkey, l_suppkey, value), 0) AS diff FROM c",
    "dc_values": "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey, IDIV(l_linenumber - 1, 3) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM lineitem",
    # A stage's counter, clipped; position in the list
    "stage_counter": "SELECT user_id AS job, event_id, least(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), 5) AS done, count(*) OVER (PARTITION BY user_id) AS total FROM events",
    # T5: three names, then how many more
    "first_names": "WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation) SELECT n_regionkey, JOINED(SORTED_LIST(n_name), ', ') || CASE WHEN max(n) > 3 THEN ' +' || CAST(max(n) - 3 AS VARCHAR(9)) ELSE '' END AS shown FROM n WHERE rn <= 3 GROUP BY n_regionkey",
    # names
    "output_names": f"WITH {FILES} SELECT id, coalesce(nullif(scope, ''), 'document') || '-compressed.' || CASE WHEN lower(ext) = 'jpeg' THEN 'jpeg' WHEN lower(ext) IN ('jpg', 'png', 'webp', 'pdf') THEN lower(ext) ELSE 'jpg' END AS name FROM files",
    "display_names": "SELECT page_id AS id, LASTPART(url) AS name FROM pages",
    # error sentences from a dimension table, with a default
    "error_sentences": "WITH s AS (SELECT * FROM (VALUES ('tooLarge', 'The file is too large.'), ('malformed', 'The file is damaged.')) AS t(code, sentence)), e AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'tooLarge' WHEN 1 THEN 'malformed' ELSE 'other' END AS code FROM documents) SELECT id, e.code, coalesce(sentence, 'Something went wrong.') AS sentence FROM e LEFT JOIN s ON e.code = s.code",
    # session names
    "session_names": "WITH n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'session-' ELSE 'sess-' END || CAST(c_custkey AS VARCHAR(20)) || '-1-' || CAST(c_nationkey AS VARCHAR(20)) AS name FROM customer) SELECT id, MATCHES(name, '^session-[0-9]+-[0-9]+-[0-9]+$') AND length(name) <= 80 AS is_session FROM n",
    # clamp, half up
    "clamped_quality": "SELECT p_partkey AS id, CAST(least(greatest(floor(p_retailprice / 20 + 0.5), 30), 95) AS BIGINT) AS quality FROM part",
    # Luma and compositing in integers
    "composited": f"WITH {LEVELS}, c AS (SELECT vec_id, i, abs(v) % 256 AS p, (abs(v) * 7) % 256 AS a FROM grid) SELECT vec_id, i, IDIV(p * a + 255 * (255 - a) + 127, 255) AS over_white, IDIV(77 * p + 150 * a + 29 * p, 256) AS luma FROM c",
    # padding of 2 percent of the long side, clipped
    "padded_crop": "SELECT p_partkey AS id, greatest(0, p_size - IDIV(greatest(p_size * 10, 200) * 2 + 99, 100)) AS left_x, least(600, p_size + 100 + IDIV(greatest(p_size * 10, 200) * 2 + 99, 100)) AS right_x FROM part",
    # bias by count
    "subr_bias": "SELECT o_custkey AS font, count(*) AS subrs, CASE WHEN count(*) * 100 < 1240 THEN 107 WHEN count(*) * 100 < 33900 THEN 1131 ELSE 32768 END AS bias FROM orders GROUP BY o_custkey",
    # Tile origins; the last tile overlaps
    "tile_origins": "WITH s AS (SELECT s_suppkey AS id, CAST(64 + s_suppkey % 50 AS INT) AS width FROM supplier), t AS (SELECT id, width, EXPLODE_RANGE(0, IDIV(width - 1, 16)) AS k FROM s) SELECT id, least(k * 16, width - 16) AS x FROM t",
    # References of an object; the first ready tool
    "first_tool": "WITH t AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS rn FROM region JOIN nation ON r_regionkey = n_regionkey) SELECT r_name, n_name AS tool FROM t WHERE rn = 1",
    # Progress counts only before a job's end; R4: a ticket is cancelled by a later generation
    "timely_progress": "WITH e AS (SELECT user_id, min(event_id) AS ended FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT v.user_id AS job, v.event_id FROM events v LEFT JOIN e ON v.user_id = e.user_id WHERE e.ended IS NULL OR v.event_id < e.ended",
    "cancelled_tickets": "WITH g AS (SELECT user_id, event_id, COUNTIF(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM events) SELECT user_id AS job, event_id AS ticket, later > 0 AS cancelled FROM g",
}
