"""Runs, restarts, sessions, layouts and windows over ordered rows, as window functions.

Every statement orders by a total order (time, then id), so ties have one answer.
"""

E = "e AS (SELECT event_id, user_id, event_type, US(ts) AS t, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v FROM events)"
NEXT = f"{E}, s AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM e)"

STATEMENTS = {
    # sessions: rows whose gap to the row before is long start a new group
    "session_gaps": f"""WITH {E}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 21600000000 THEN 0 ELSE 1 END AS starts FROM e),
      n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
      SELECT user_id, CAST(session AS BIGINT) AS session, min(t) AS first_t, max(t) AS last_t, count(*) AS n_events, CAST(sum(v) AS BIGINT) AS value_cents FROM n GROUP BY user_id, session""",
    "adjacent_key_runs": f"""WITH {E}, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) THEN 0 ELSE 1 END AS starts FROM e),
      n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
      SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, min(t) AS from_t, max(t) AS to_t, count(*) AS n FROM n GROUP BY user_id, run""",
    "running_reach": f"""WITH {E}, r AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)
      SELECT event_id, reach, coalesce(v <= reach, false) AS is_repeat FROM r""",
    "seen_before": f"""WITH {E} SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) > 1 AS is_repeat FROM e""",
    "restart_count": f"""WITH {E}, p AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY t, event_id) AS prev FROM e)
      SELECT user_id, count(CASE WHEN v <= prev THEN 1 END) AS restarts FROM p GROUP BY user_id""",
    "decreasing_runs": f"""WITH {E}, p AS (SELECT *, CASE WHEN v > lag(v) OVER (PARTITION BY user_id ORDER BY t, event_id) THEN 0 ELSE 1 END AS starts FROM e),
      n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p)
      SELECT user_id, CAST(run AS BIGINT) AS run, min(v) AS low, max(v) AS high, count(*) AS n FROM n GROUP BY user_id, run""",
    "known_stops": f"""WITH {E}, p AS (SELECT *, lag(v) OVER w AS pv, lag(event_type) OVER w AS pt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
      SELECT event_id FROM p WHERE pv IS NOT NULL AND (event_type <> pt OR v < pv)""",
    "median_gap_lower": f"""WITH {NEXT}, g AS (SELECT user_id, nxt - t AS gap, row_number() OVER (PARTITION BY user_id ORDER BY nxt - t, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM s WHERE nxt IS NOT NULL)
      SELECT user_id, gap FROM g WHERE rn = IDIV(n + 1, 2)""",
    "gap_closing": f"""WITH {NEXT} SELECT event_id, t AS start_t, CASE WHEN nxt IS NULL THEN t + 2000000 WHEN nxt - t < 2000000 THEN nxt ELSE IDIV(t + nxt, 2) END AS end_t FROM s""",
    "cumulative_layout": f"""WITH {E} SELECT event_id, coalesce(CAST(sum(v) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start_at,
      CAST(sum(v) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_at FROM e""",
    "remove_and_shift": f"""WITH {E} SELECT event_id, v, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - v AS start_at FROM e WHERE event_type <> 'error'""",
    "duplicate_and_shift": f"""WITH {E}, d AS (SELECT event_id, user_id, t, v, 0 AS copy FROM e UNION ALL SELECT event_id, user_id, t, v, 1 AS copy FROM e WHERE event_type = 'purchase')
      SELECT event_id, copy, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY t, event_id, copy ROWS UNBOUNDED PRECEDING) AS BIGINT) - v AS start_at FROM d""",
    "monotone_filter": f"""WITH {E}, m AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
      SELECT event_id, user_id, v FROM m WHERE top IS NULL OR v >= top""",
    "moving_sums": f"""WITH {E} SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS total, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "late_restarts": f"""WITH {E}, p AS (SELECT *, lag(v) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS prev FROM e)
      SELECT event_id, t FROM p WHERE v < prev OR event_type = 'signup'""",
    "held_to_end": f"""WITH {NEXT}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id) AS last_rank, max(t) OVER (PARTITION BY user_id) AS final_t FROM s)
      SELECT event_id, CASE WHEN last_rank = 1 THEN final_t + 5000000 ELSE coalesce(nxt, t) END AS end_t FROM r""",
    "order_preserving_clamp": f"""WITH {E}, m AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS start_v FROM e)
      SELECT event_id, start_v, least(start_v + 500, lead(start_v) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS end_v FROM m""",
    "transition_windows": f"""WITH {E} SELECT event_id, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) - 350000 AS from_t, t + 350000 AS to_t FROM e""",
    "swap_neighbours": """WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
      SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), role) ELSE coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), role) END AS swapped FROM t""",
    "bucketed_peaks": f"""WITH {E}, b AS (SELECT user_id, IDIV(t, 86400000000) AS day, abs(v) AS v FROM e) SELECT user_id, day, max(v) AS peak, count(*) AS n FROM b GROUP BY user_id, day""",
    "incremental_peaks": f"""WITH {E}, b AS (SELECT user_id, IDIV(t, 86400000000) AS day, abs(v) AS v FROM e) SELECT user_id, IDIV(day, 7) AS week, max(v) AS peak FROM b GROUP BY user_id, IDIV(day, 7)""",
    "voice_extent": f"""WITH {E}, c AS (SELECT *, CASE WHEN v >= 2000 THEN 1 ELSE 0 END AS loud, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, v >= 2000 ORDER BY t, event_id) AS grp FROM e),
      r AS (SELECT user_id, grp, min(t) AS from_t, max(t) AS to_t, count(*) AS n FROM c WHERE loud = 1 GROUP BY user_id, grp)
      SELECT user_id, min(from_t) AS first_t, max(to_t) AS last_t FROM r WHERE n >= 3 GROUP BY user_id""",
    "dead_stretches": f"""WITH {E}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, v < 3000 ORDER BY t, event_id) AS grp FROM e)
      SELECT user_id, min(t) AS from_t, max(t) AS to_t, count(*) AS n FROM c WHERE v < 3000 GROUP BY user_id, grp HAVING count(*) >= 2""",
}
