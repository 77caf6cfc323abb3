"""Dashboards, library grouping, search, ranking, caches and set operations."""

E = "e AS (SELECT event_id, user_id, event_type, US(ts) AS t, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v FROM events)"

STATEMENTS = {
    "latest_per_key": f"WITH {E} SELECT user_id, event_type, max(t) AS latest_t FROM e WHERE t IS NOT NULL GROUP BY user_id, event_type",
    "dashboard_totals": f"""WITH {E}, m AS (SELECT max(t) AS now FROM e) SELECT count(*) AS total, count(CASE WHEN now - t < 604800000000 THEN 1 END) AS last_7d,
      count(CASE WHEN now - t < 2592000000000 THEN 1 END) AS last_30d, CAST(sum(v) AS BIGINT) AS cents FROM e CROSS JOIN m""",
    "ranked_counts": f"""WITH {E}, c AS (SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM e GROUP BY event_type)
      SELECT event_type, n, CAST(row_number() OVER (ORDER BY n DESC, first_seen) AS BIGINT) AS place FROM c""",
    "counts_by_user_and_shape": f"WITH {E} SELECT user_id, event_type, count(*) AS n, min(v) AS least_v, max(v) AS most_v FROM e GROUP BY user_id, event_type",
    "group_representative": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
      SELECT o_custkey, o_orderkey, o_orderstatus, n FROM o WHERE rn = 1""",
    "present_or_absent": """WITH x AS (SELECT o_orderkey, count(*) AS n, max(CASE WHEN l_returnflag = 'R' THEN US(l_shipdate) END) AS returned FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
      SELECT o_orderkey, n, CASE WHEN returned IS NULL THEN 'never' ELSE 'returned' END AS state FROM x""",
    "coverage_matrix": """WITH b AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
      SELECT l.l_orderkey, l.l_linenumber, l.l_linenumber BETWEEN coalesce(lo, 0) AND coalesce(hi, -1) AS covered FROM lineitem l LEFT JOIN b ON b.l_orderkey = l.l_orderkey""",
    "skipped_interior_keys": """WITH b AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey)
      SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN b ON b.l_orderkey = l.l_orderkey WHERE l_linenumber > lo AND l_linenumber < hi AND l_returnflag = 'N'""",
    "fill_empty_only": """SELECT d.doc_id, CASE WHEN d.n_chars = 0 OR d.lang IS NULL THEN 'unknown' ELSE d.lang END AS lang, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "multi_field_search": """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND (contains(lower(p_brand), '1') OR contains(lower(p_type), 'e'))""",
    "catalogue_groups": """SELECT r_name, count(*) AS n, min(n_name) AS first_name, max(n_name) AS last_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "recent_top": "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS place FROM (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) x",
    "gallery_order": """SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END, c_acctbal DESC, c_custkey) AS BIGINT) AS place FROM customer""",
    "best_fit_choice": """SELECT s_nationkey, s_suppkey, CAST(place AS BIGINT) AS place FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal >= 5000 THEN 0 ELSE 1 END, abs(s_acctbal - 5000), s_suppkey) AS place FROM supplier) x WHERE place <= 4""",
    "longest_first_cap": """SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) x WHERE place <= 8""",
    "recently_used": f"""WITH {E}, l AS (SELECT user_id, event_type, max(t) AS t FROM e GROUP BY user_id, event_type)
      SELECT user_id, event_type, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_type) AS place FROM l) x WHERE place <= 3""",
    "lru_by_size": f"""WITH {E}, k AS (SELECT event_id, user_id, sum(v) OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS held, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS rn FROM e)
      SELECT user_id, event_id FROM k WHERE held <= 50000 OR rn = 1""",
    "prefix_budget": """SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) x WHERE used <= 20000""",
    "removed_keys": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "symmetric_difference": """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
      SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS only_second FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""",
    "multiset_hits": """WITH p AS (SELECT l_orderkey AS k, l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey, l_returnflag),
      x AS (SELECT l_orderkey AS k, l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey, l_returnflag)
      SELECT p.k, CAST(sum(least(p.n, x.n)) AS BIGINT) AS hits FROM p JOIN x ON x.k = p.k AND x.f = p.f GROUP BY p.k""",
    "multiset_difference": """SELECT user_id, event_type FROM events WHERE event_id % 2 = 0 EXCEPT ALL SELECT user_id, event_type FROM events WHERE event_id % 3 = 0""",
    "id_set_from_log": f"""WITH {E}, l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM e WHERE event_type IN ('signup', 'error'))
      SELECT user_id FROM l WHERE rn = 1 AND event_type = 'signup'""",
    "mutation_reduction": f"""WITH {E}, l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM e)
      SELECT user_id, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'snapshot' END AS state FROM l WHERE rn = 1""",
    "snapshot_diff": """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 3 <> 0)
      SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN b.k IS NULL THEN 'removed' ELSE 'stale' END AS state FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s""",
    "upsert": """WITH n AS (SELECT o_orderkey, 'U' AS o_orderstatus FROM orders WHERE o_orderkey % 4 = 0)
      SELECT o.o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM orders o LEFT JOIN n ON n.o_orderkey = o.o_orderkey""",
    "delete_by_key": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT o_orderkey % 4 = 0",
    "staleness": f"""WITH {E}, m AS (SELECT max(t) AS now FROM e), l AS (SELECT user_id, max(t) AS synced FROM e GROUP BY user_id)
      SELECT user_id, synced IS NULL OR now - synced >= 518400000000 AS due FROM l CROSS JOIN m""",
    "coverage_ratio": """WITH a AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), g AS (SELECT l_orderkey, count(*) AS own, count(CASE WHEN l_suppkey % 2 = 0 THEN 1 END) AS hit FROM a GROUP BY l_orderkey)
      SELECT l_orderkey, CAST(floor(hit * 10000 / own) AS BIGINT) AS share_bp FROM g""",
    "mode_per_key": f"""WITH {E}, c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_seen FROM e GROUP BY user_id, event_type)
      SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_seen) AS rn FROM c) x WHERE rn = 1""",
    "floor_rank_percentile": f"""WITH {E}, r AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
      SELECT user_id, v AS level_v FROM r WHERE i = IDIV(n * 7, 10)""",
    "range_verdicts": """WITH p AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey), x AS (SELECT l_orderkey, min(l_linenumber) AS xlo, max(l_linenumber) AS xhi FROM lineitem GROUP BY l_orderkey)
      SELECT x.l_orderkey, CASE WHEN lo IS NULL THEN 'none' WHEN lo = xlo AND hi = xhi THEN 'exact' WHEN lo >= xlo AND hi <= xhi THEN 'partial' ELSE 'wrong' END AS verdict FROM x LEFT JOIN p ON p.l_orderkey = x.l_orderkey""",
    "scoring_report": """WITH j AS (SELECT d.doc_id, CASE WHEN n_chars > 200 THEN 1 ELSE 0 END AS predicted, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
      SELECT predicted, quality, count(*) AS n FROM j GROUP BY predicted, quality""",
    "missing_on_some_row": """WITH t AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events), h AS (SELECT DISTINCT user_id, event_type FROM events)
      SELECT t.event_type, count(*) AS users_without FROM u CROSS JOIN t LEFT JOIN h ON h.user_id = u.user_id AND h.event_type = t.event_type WHERE h.user_id IS NULL GROUP BY t.event_type""",
    "batch_queue_heads": """SELECT o_custkey, min(o_orderkey) AS next_job, count(*) AS waiting FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey""",
    "job_recovery": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders",
}
