"""Filters, lookups and reconciliations between stored and fetched rows."""

E = "e AS (SELECT event_id, user_id, event_type, US(ts) AS t, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v FROM events)"
NEXT = f"{E}, s AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM e)"

STATEMENTS = {
    "never_or_before": """SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR o_orderdate < TIMESTAMP '1996-01-01 00:00:00'""",
    "range_slice": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 100 AND 400 AND l_linenumber BETWEEN 2 AND 4",
    "keyed_texts_in_range": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id BETWEEN 10 AND 500 AND lang IN ('en', 'fr')",
    "next_flagged_circular": """WITH f AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_discount > 0.05), b AS (SELECT l_orderkey, l_linenumber, n, (l_linenumber - 3 + 7) % 7 AS ahead FROM f)
      SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ahead, l_linenumber) AS rn FROM b) x WHERE rn = 1""",
    "unsure_edges": """WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS prev FROM lineitem)
      SELECT l_orderkey, min(l_linenumber) AS first_unsure FROM p WHERE abs(l_quantity - prev) > 30 GROUP BY l_orderkey""",
    "distinct_in_window": "SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_place FROM lineitem WHERE l_linenumber <= 5 GROUP BY l_orderkey, l_suppkey",
    "length_fits": """WITH p AS (SELECT CAST(p_size AS BIGINT) AS most, min(p_partkey) AS first_seen, count(*) AS n FROM part GROUP BY p_size)
      SELECT most, n, most >= 25 AS fits, CAST(row_number() OVER (ORDER BY first_seen) AS BIGINT) AS place FROM p""",
    "window_or_whole": f"""WITH {NEXT}, b AS (SELECT user_id, min(t) AS lo, max(nxt) AS hi FROM s GROUP BY user_id)
      SELECT s.event_id, CASE WHEN s.t - b.lo <= 50000 AND b.hi - s.nxt <= 50000 THEN NULL ELSE greatest(s.t - 5000000, b.lo) END AS view_from, least(s.nxt + 5000000, b.hi) AS view_to FROM s JOIN b ON b.user_id = s.user_id WHERE nxt IS NOT NULL""",
    "edge_labels": """WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), o AS (SELECT l_orderkey, min(CASE WHEN rn = 1 THEN l_returnflag END) AS first_flag, min(CASE WHEN rn = n THEN l_returnflag END) AS last_flag, min(l_linenumber) AS a, max(l_linenumber) AS b FROM r GROUP BY l_orderkey)
      SELECT l_orderkey, CASE WHEN first_flag = last_flag THEN concat(first_flag, ' ', CAST(a AS STRING), '-', CAST(b AS STRING)) ELSE concat(first_flag, CAST(a AS STRING), ' ', last_flag, CAST(b AS STRING)) END AS label FROM o""",
    "matching_preset": """SELECT s.s_suppkey, min(n.n_nationkey) AS preset FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey AND n.n_regionkey = s.s_suppkey % 5 GROUP BY s.s_suppkey""",
    "keyed_inner_lookup": """SELECT l.doc_id, l.quality, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "bounds_or_zero": """WITH b AS (SELECT o_custkey, min(o_totalprice) AS lo, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey, coalesce(n, 0) AS n, coalesce(CAST(floor(lo) AS BIGINT), 0) AS lo FROM customer LEFT JOIN b ON o_custkey = c_custkey""",
    # spans of two hours touch two cells of two hours, so the range join is an equi join of user and cell
    "midpoint_containment": f"""WITH {NEXT}, w AS (SELECT event_id, user_id, IDIV(t + nxt, 2) AS mid, IDIV(t + nxt, 14400000000) AS cell FROM s WHERE nxt IS NOT NULL),
      p AS (SELECT user_id, event_id AS span_id, t - 3600000000 AS a, t + 3600000000 AS b, IDIV(t - 3600000000, 7200000000) AS first_cell FROM e WHERE event_type = 'purchase'),
      q AS (SELECT user_id, span_id, a, b, first_cell AS cell FROM p UNION ALL SELECT user_id, span_id, a, b, first_cell + 1 AS cell FROM p)
      SELECT w.event_id, q.span_id FROM w JOIN q ON q.user_id = w.user_id AND q.cell = w.cell AND w.mid >= q.a AND w.mid <= q.b""",
    "phrase_twins": """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem)
      SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS twin FROM l a JOIN l b ON b.l_orderkey = a.l_orderkey AND b.l_returnflag = a.l_returnflag AND b.l_linestatus = a.l_linestatus AND b.l_linenumber = a.l_linenumber + 2""",
    "last_row_wins": """SELECT n_regionkey, n_name FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS rn FROM nation) x WHERE rn = 1""",
    "assembled_words": """WITH w AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem) SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_returnflag END) AS w1, max(CASE WHEN l_linenumber = 2 THEN l_returnflag END) AS w2, count(*) AS n FROM w GROUP BY l_orderkey""",
    "global_positions": """SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey % 64 ORDER BY l_orderkey, l_linenumber) AS BIGINT) AS place FROM lineitem""",
    "forward_fill": f"""WITH {E}, f AS (SELECT *, count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM e)
      SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN v END) OVER (PARTITION BY user_id, grp) AS filled FROM f""",
    "share_within_tolerance": f"""WITH {NEXT}, g AS (SELECT user_id, count(*) AS n, count(CASE WHEN nxt - t <= 21600000000 THEN 1 END) AS near FROM s WHERE nxt IS NOT NULL GROUP BY user_id)
      SELECT user_id, near * 10 >= n * 8 AS agrees FROM g""",
    "first_per_key": f"""WITH {E} SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS rn FROM e) x WHERE rn = 1""",
    "first_override": """WITH x AS (SELECT o_custkey, min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS edited, min(o_orderkey) AS fetched FROM orders GROUP BY o_custkey) SELECT o_custkey, coalesce(edited, fetched) AS chosen FROM x""",
    "equal_neighbours": """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS grp FROM lineitem)
      SELECT l_orderkey, l_returnflag, min(l_linenumber) AS a, max(l_linenumber) AS b FROM l GROUP BY l_orderkey, l_returnflag, grp""",
    "key_group_update": """SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'B' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
    "nearest_candidate": f"""WITH {NEXT}, c AS (SELECT event_id, user_id, abs(nxt - t - 86400000000) AS off FROM s WHERE nxt IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off, event_id) AS rn FROM c)
      SELECT user_id, event_id, off FROM r WHERE rn = 1 AND off <= 43200000000""",
    "widened_agreement": """WITH x AS (SELECT o_orderkey, US(o_orderdate) AS d FROM orders), y AS (SELECT l_orderkey, min(d) AS a, max(d) AS b FROM (SELECT l_orderkey, US(l_shipdate) AS d FROM lineitem) z GROUP BY l_orderkey)
      SELECT o_orderkey, d >= a - 2592000000000 AND d <= b + 2592000000000 AS agrees, abs(b - a) AS width FROM x JOIN y ON l_orderkey = o_orderkey""",
    "latest_snapshot": """WITH r AS (SELECT o_custkey, max(o_orderdate) AS latest, count(*) AS segments FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey) SELECT o_custkey, US(latest) AS latest_t, segments FROM r""",
    "language_groups": """SELECT coalesce(lang, 'Other') AS lang, count(*) AS n, CAST(row_number() OVER (ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, coalesce(lang, 'Other')) AS BIGINT) AS place FROM documents GROUP BY coalesce(lang, 'Other'), CASE WHEN lang = 'en' THEN 0 ELSE 1 END, lang""",
    "key_bounds_stray": """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, lead(l_quantity) OVER w AS n1, lead(l_quantity, 2) OVER w AS n2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))
      SELECT l_orderkey, min(CASE WHEN n1 IS NULL OR n2 IS NULL OR NOT (n1 < l_quantity AND n2 < l_quantity) THEN l_linenumber END) AS start_at, max(l_linenumber) AS end_at FROM l GROUP BY l_orderkey""",
    "dominant_cluster": """WITH x AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) <= 2 THEN 0 ELSE 1 END AS starts, l_linenumber FROM lineitem),
      y AS (SELECT *, sum(starts) OVER (PARTITION BY l_orderkey ORDER BY q, l_linenumber ROWS UNBOUNDED PRECEDING) AS c FROM x), z AS (SELECT l_orderkey, c, count(*) AS weight, min(q) AS a, max(q) AS b FROM y GROUP BY l_orderkey, c)
      SELECT l_orderkey, weight, a, b FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY weight DESC, c) AS rn FROM z) u WHERE rn = 1""",
    "verdict_tally": """SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus""",
    "median_of_nearest": """WITH r AS (SELECT l_partkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY abs(l_quantity - 25), l_orderkey, l_linenumber) AS rn FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY q, rn) - 1 AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM r WHERE rn <= 5)
      SELECT l_partkey, q FROM k WHERE i = IDIV(n, 2)""",
    "mean_duration_eta": """WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
      SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM r WHERE rn <= 10 GROUP BY o_custkey""",
    "largest_group": """WITH g AS (SELECT n_regionkey, s_nationkey, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_regionkey, s_nationkey) SELECT n_regionkey, s_nationkey, n FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, s_nationkey) AS rn FROM g) x WHERE rn = 1""",
    "majority_test": """SELECT l_orderkey, 2 * count(CASE WHEN l_returnflag = 'N' THEN 1 END) > count(*) AS mostly FROM lineitem GROUP BY l_orderkey""",
    "share_at_least": """SELECT o_orderkey, coalesce(count(CASE WHEN l_quantity > 20 THEN 1 END) * 10 >= 6 * count(l_orderkey), true) AS passes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "level_energy": f"""WITH {E}, i AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS place FROM e), h AS (SELECT user_id, IDIV(place, 4) AS hop, v FROM i) SELECT user_id, hop, CAST(sum(v * v) AS BIGINT) AS energy FROM h GROUP BY user_id, hop HAVING count(*) = 4""",
    # three leads of one window: no row meets more than three others
    "lag_products": f"""WITH {E}, r AS (SELECT user_id, v, lead(v, 1) OVER w AS v1, lead(v, 2) OVER w AS v2, lead(v, 3) OVER w AS v3 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
      p AS (SELECT user_id, 1 AS lag_by, sum(v * v1) AS dot FROM r GROUP BY user_id UNION ALL SELECT user_id, 2 AS lag_by, sum(v * v2) AS dot FROM r GROUP BY user_id UNION ALL SELECT user_id, 3 AS lag_by, sum(v * v3) AS dot FROM r GROUP BY user_id)
      SELECT user_id, CAST(lag_by AS BIGINT) AS lag_by, CAST(dot AS BIGINT) AS dot FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dot DESC, lag_by) AS rn FROM p WHERE dot IS NOT NULL) x WHERE rn = 1""",
    "gap_verdicts": """WITH p AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey), x AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_extendedprice > 30000 GROUP BY l_orderkey)
      SELECT coalesce(p.l_orderkey, x.l_orderkey) AS k, CASE WHEN p.n IS NULL THEN 'missing' WHEN x.n IS NULL THEN 'wrong' WHEN p.n < x.n THEN 'merge' WHEN p.n > x.n THEN 'split' ELSE 'match' END AS verdict FROM p FULL JOIN x ON x.l_orderkey = p.l_orderkey""",
    "consecutive_cuts": """WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS prev FROM lineitem) SELECT l_orderkey, l_linenumber FROM l WHERE l_suppkey = prev + 1""",
    "disjoint_merge_window": f"""WITH {NEXT}, o AS (SELECT user_id, event_id, t AS a, nxt AS b FROM s WHERE nxt IS NOT NULL AND NOT (t >= 1704672000000000 AND nxt <= 1705276800000000))
      SELECT user_id, event_id, CASE WHEN a >= 1704672000000000 AND a < 1705276800000000 THEN 1705276800000000 ELSE a END AS a, CASE WHEN b > 1704672000000000 AND b <= 1705276800000000 THEN 1704672000000000 ELSE b END AS b FROM o""",
    "html_strip": """SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ ]+', ' ', 'g')) AS text FROM pages""",
    "letter_count": "SELECT doc_id, CAST(length(translate(lower(text), ' .,!?\n', '')) AS BIGINT) AS n FROM documents",
    "name_slug": "SELECT c_custkey, translate(lower(c_name), '# ', '--') AS slug FROM customer",
}
