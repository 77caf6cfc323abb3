"""Edits of spans and jobs, decoded paths, folds of text and comparisons of neighbouring rows."""

E = "e AS (SELECT event_id, user_id, event_type, US(ts) AS t, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v FROM events)"
NEXT = f"{E}, s AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM e)"
LINES = "l AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, lag(l_returnflag) OVER w AS before, CAST(l_quantity AS BIGINT) AS q, CAST(lag(l_quantity) OVER w AS BIGINT) AS bq, row_number() OVER w AS i FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"

STATEMENTS = {
    "split_at_time": f"""WITH {NEXT}, c AS (SELECT event_id, t, nxt FROM s WHERE nxt > t)
      SELECT event_id, 0 AS part, t AS a, CASE WHEN t < 1705000000000000 AND nxt > 1705000000000000 THEN 1705000000000000 ELSE nxt END AS b FROM c
      UNION ALL SELECT event_id, 1 AS part, 1705000000000000 AS a, nxt AS b FROM c WHERE t < 1705000000000000 AND nxt > 1705000000000000""",
    "retimed_spans": f"""WITH {NEXT}, m AS (SELECT event_id, IDIV((t - 1704067200000000) * 4, 5) AS a, IDIV((nxt - 1704067200000000) * 4, 5) AS b FROM s WHERE nxt IS NOT NULL) SELECT event_id, a, b FROM m WHERE b - a >= 50000""",
    "deduplicated_names": """WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, CASE WHEN n = 1 THEN p_brand ELSE concat(p_brand, '-', CAST(n AS STRING)) END AS name FROM r""",
    "http_ranges": """WITH h AS (SELECT doc_id, n_chars, concat('bytes=', CAST(doc_id % 3000 AS STRING), '-', CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 3000 + 99 AS STRING) ELSE '' END) AS header FROM documents),
      p AS (SELECT doc_id, n_chars, CAST(split_part(substr(header, 7), '-', 1) AS BIGINT) AS a, split_part(substr(header, 7), '-', 2) AS b FROM h)
      SELECT doc_id, a < n_chars AS satisfiable, a, least(n_chars - 1, CASE WHEN b = '' THEN n_chars - 1 ELSE CAST(b AS BIGINT) END) AS z FROM p""",
    "feasibility_bound": f"WITH {LINES} SELECT l_orderkey, count(*) + count(CASE WHEN f = before THEN 1 END) AS frames FROM l GROUP BY l_orderkey",
    "collapsed_path": f"WITH {LINES} SELECT l_orderkey, CAST(i AS BIGINT) AS i, f FROM l WHERE f <> 'N' AND (before IS NULL OR before <> f)",
    "path_spans": f"""WITH {LINES}, g AS (SELECT *, i - row_number() OVER (PARTITION BY l_orderkey, f ORDER BY i) AS grp FROM l) SELECT l_orderkey, f, CAST(min(i) AS BIGINT) AS a, CAST(max(i) + 1 AS BIGINT) AS b FROM g WHERE f <> 'N' GROUP BY l_orderkey, f, grp""",
    "change_sums": f"WITH {LINES} SELECT l_orderkey, CAST(coalesce(sum(abs(q - bq)), 0) AS BIGINT) AS change, count(bq) AS n FROM l GROUP BY l_orderkey",
    "still_spans": f"""WITH {LINES}, c AS (SELECT *, CASE WHEN abs(q - bq) <= 5 THEN 0 ELSE 1 END AS moved FROM l), r AS (SELECT *, sum(moved) OVER (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c)
      SELECT l_orderkey, CAST(min(i) AS BIGINT) AS a, CAST(max(i) AS BIGINT) AS b FROM r GROUP BY l_orderkey, run HAVING count(*) >= 3""",
    "length_checks": """WITH y AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last_line FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, abs(n - last_line) <= 1 AS fits FROM y""",
    "mask_sync": """WITH a AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey), b AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey)
      SELECT a.l_orderkey, CASE WHEN a.n = b.n THEN 'carry' ELSE 'reset' END AS action FROM a LEFT JOIN b ON b.l_orderkey = a.l_orderkey""",
    "numeric_segments": "SELECT p_partkey, CAST(split_part(p_brand, '#', 2) AS BIGINT) AS code FROM part WHERE HAS(p_brand, '#[0-9]+$')",
    "jobs_first_wins": """SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'F') x WHERE rn = 1""",
    "jobs_cancelled": "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'C' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "jobs_removed": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 2 = 1",
    "play_order": f"WITH {NEXT} SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t, nxt, event_id) AS BIGINT) AS place FROM s",
    "row_differences": """SELECT s_suppkey, concat_ws(',', CASE WHEN s_nationkey <> n_nationkey THEN 'nation' END, CASE WHEN s_suppkey % 5 <> n_regionkey THEN 'region' END) AS differs FROM supplier JOIN nation ON n_nationkey = s_suppkey % 25""",
    "loose_fold": "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS folded FROM documents",
    "skeleton_fold": "SELECT doc_id, translate(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), 'aeiou', '') AS skeleton FROM documents",
    "script_majority": "SELECT doc_id, 2 * length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) > length(text) AS mostly_ascii FROM documents",
    "open_endings": "SELECT doc_id, substr(trim(text), length(trim(text)), 1) IN ('a', 'e', 'i', 'o', 'u') AS open_end FROM documents",
    "stop_list_ends": "SELECT item_id, lower(split_part(text, ' ', -1)) IN ('the', 'of', 'and', 'a') AS cannot_end FROM benchmark",
    "ordered_distinct": "SELECT l_orderkey, l_returnflag, min(l_linenumber) AS place FROM lineitem GROUP BY l_orderkey, l_returnflag",
    "edited_length": f"""WITH {NEXT} SELECT user_id, CAST(sum(CASE WHEN event_type <> 'error' THEN nxt - t ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN event_type = 'error' THEN nxt - t ELSE 0 END) AS BIGINT) AS cut FROM s WHERE nxt IS NOT NULL GROUP BY user_id""",
    "seam_gaps": """WITH b AS (SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nxt FROM lineitem) SELECT l_orderkey, l_linenumber + 1 AS a, nxt AS b FROM b WHERE nxt - l_linenumber > 1""",
}
