"""Scalar rules on text, timecodes, ranges and numbers, as expressions Spark compiles."""

STATEMENTS = {
    "timecode_format": """WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice * 10 + 0.5) AS BIGINT) AS tenths FROM orders)
      SELECT o_orderkey, concat(CAST(IDIV(tenths, 600) AS STRING), ':', lpad(CAST(IDIV(tenths % 600, 10) AS STRING), 2, '0'), '.', CAST(tenths % 10 AS STRING)) AS code FROM x""",
    "timecode_parse": """WITH x AS (SELECT event_id, concat(CAST(event_id % 50 AS STRING), ':', lpad(CAST(event_id % 90 AS STRING), 2, '0')) AS code FROM events)
      SELECT event_id, CASE WHEN HAS(code, '^[0-9]+:[0-9]') THEN CAST(split_part(code, ':', 1) AS BIGINT) * 60 + CAST(split_part(code, ':', 2) AS BIGINT) END AS seconds FROM x""",
    "chunk_plan": """WITH x AS (SELECT doc_id, n_chars, CASE WHEN n_chars <= 1000 THEN 1 ELSE IDIV(n_chars, 1000) END AS chunks FROM documents)
      SELECT doc_id, chunks, (chunks - 1) * 1000 AS last_from, n_chars AS last_to FROM x""",
    "loop_phase": "SELECT event_id, event_id % 37 + 100 AS phase, CASE WHEN event_id * 100 > 102 * 37 THEN CAST(floor(event_id * 10 / 37) AS BIGINT) ELSE 10 END AS repeats_tenths FROM events",
    "even_dimensions": "SELECT p_partkey, CAST(2 * floor(p_size * 9 / 32 + 0.5) AS BIGINT) AS height, least(greatest(p_size * 30000, 200000), 1200000) AS bitrate FROM part",
    "row_flags": """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 0 ELSE CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END + CASE WHEN l_quantity < 10 THEN 1 ELSE 0 END END AS n_flags FROM lineitem""",
    "payload_validator": """SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 1 AND 40 AND l_quantity = floor(l_quantity) AND HAS(l_returnflag, '^[AN]$') AS valid FROM lineitem""",
    "cost_guard": "SELECT o_orderkey, CAST(floor((o_orderkey * (2 * 7 + 1) + o_orderkey * 1025 * 4) * 11 / 10) AS BIGINT) AS bytes FROM orders",
    "stored_duration": "SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS seconds FROM orders",
    "suffix_insert": "SELECT page_id, CASE WHEN HAS(url, '[.][a-z]+$') THEN regexp_replace(url, '([.][a-z]+)$', '_9x16') ELSE concat(url, '_9x16') END AS url FROM pages",
    "safe_name": "SELECT p_partkey, trim(translate(lower(p_name), ' /:', '___')) AS slug, CAST(length(p_name) AS BIGINT) AS n FROM part",
    "reference_text": """WITH x AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY l_orderkey)
      SELECT l_orderkey, CASE WHEN a = b THEN concat(CAST(l_orderkey AS STRING), ':', CAST(a AS STRING)) ELSE concat(CAST(l_orderkey AS STRING), ':', CAST(a AS STRING), '-', CAST(b AS STRING)) END AS reference FROM x""",
    "digit_fold": "SELECT c_custkey, translate(CAST(c_custkey AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS digits FROM customer",
    "edit_distance": "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "media_kind": "SELECT page_id, CASE WHEN HAS(url, '[.](mp4|webm)$') THEN 'video' WHEN HAS(url, '[.](png|jpg)$') THEN 'image' ELSE 'page' END AS kind FROM pages",
    "schedule_check": "SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN 'invalid' WHEN o_orderdate < TIMESTAMP '1996-01-01 00:00:00' THEN 'past' ELSE 'time' END AS state FROM orders",
    "text_precedence": "SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality IS NOT NULL THEN 'label' WHEN lang IS NOT NULL THEN 'lang' ELSE 'none' END AS source_of FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
}
