"""Registered queries of threadlake.operators.records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.operators import records as X
from threadlake.operators import rollups as R
from threadlake.plans import queries as Q

_LATE = "sum(CAST(hour_of_day IN (22, 23, 0, 1, 2, 3, 4) AS INT))"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
_SPAN = f"{_ISO.format('arg_min(ts, seq)')} AS first_ts, {_ISO.format('arg_max(ts, seq)')} AS last_ts"
FLOORS = {"balanced": 200, "night": 400}

Q._COUNTS |= {"shard_count", "participants", "total_messages", "top_day_count", "top_month_count", "longest_session", "cycles"}

Q.rows("messages_manifest", X.messages_manifest, "archive_id month_key shard_id n first_ts last_ts shard_count total_messages", f"SELECT archive_id, month_key, 'messages_' || month_key AS shard_id, count(*) AS n, {_SPAN}, count(*) OVER (PARTITION BY archive_id) AS shard_count, sum(count(*)) OVER (PARTITION BY archive_id) AS total_messages FROM m GROUP BY archive_id, month_key")
Q.rows("source_manifest", X.source_manifest, "archive_id n participants first_ts last_ts", f"SELECT archive_id, count(*) AS n, count(DISTINCT sender_id) AS participants, {_SPAN} FROM m GROUP BY archive_id")
Q.rows("chunk_manifest", X.chunk_manifest, "archive_id chunk_no first_seq last_seq n first_ts last_ts session_ids", """, c AS (SELECT archive_id, count(*) AS n FROM m GROUP BY 1),
k AS (SELECT archive_id, unnest(range(0, CASE WHEN n <= 120 THEN 1 ELSE CAST(ceil((n - 120) / 105.0) AS BIGINT) + 1 END)) AS k FROM c),
x AS (SELECT m.archive_id, seq, ts, session_no, k + 1 AS chunk_no FROM m JOIN k ON m.archive_id = k.archive_id AND m.seq >= 105 * k AND m.seq < 105 * k + 120),
y AS (SELECT archive_id, chunk_no, string_agg(printf('tech_%04d', CAST(session_no AS BIGINT)), ',' ORDER BY session_no) AS session_ids FROM (SELECT DISTINCT archive_id, chunk_no, session_no FROM x) GROUP BY ALL),
z AS (SELECT archive_id, chunk_no, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, """ + _SPAN + """ FROM x GROUP BY archive_id, chunk_no);;SELECT * FROM y JOIN z USING (archive_id, chunk_no)""")
Q.rows("late_night_by_sender", R.late_night_by_sender, "archive_id month_key sender_id late_night_messages", f"""SELECT mo.archive_id, month_key, pe.sender_id, coalesce(l, 0) AS late_night_messages FROM (SELECT DISTINCT archive_id, month_key FROM act) mo
JOIN (SELECT DISTINCT archive_id, sender_id FROM act WHERE sender_id IS NOT NULL) pe USING (archive_id) LEFT JOIN (SELECT archive_id, month_key, sender_id, {_LATE} AS l FROM act GROUP BY ALL) c USING (archive_id, month_key, sender_id)""")
_MIX = "SELECT archive_id, {0} AS sender_id, emotion_label, count(*) AS n FROM a WHERE message_type <> 'system' {1} GROUP BY archive_id, emotion_label"
Q.rows("scope_filter", lambda a: R.scope(mix := R.emotion_mix(a), "participant_02").unionByName(R.scope(mix, None)), "archive_id sender_id emotion_label n", _MIX.format("'participant_02'", "AND sender_id = 'participant_02'") + " UNION ALL " + _MIX.format("'*'", ""), 1)
_PEAK = "SELECT archive_id, sender_id, '{0}' AS kind, row_number() OVER (PARTITION BY archive_id, sender_id ORDER BY count(*) DESC, {1}) AS rank, {2} AS weekday, {3} AS hour_of_day, count(*) AS n FROM act WHERE sender_id IS NOT NULL GROUP BY archive_id, sender_id, {4}"
_PEAKS = " UNION ALL ".join(
    f"SELECT * FROM ({_PEAK.format(*x)}) WHERE rank <= {k}"
    for x, k in ((("window", "weekday || ':' || hour_of_day", "weekday", "hour_of_day", "weekday, hour_of_day"), 4), (("weekday", "weekday", "weekday", "NULL", "weekday"), 3), (("hour", "hour_of_day", "NULL", "hour_of_day", "hour_of_day"), 3))
)
Q.rows("participant_peak_windows", X.participant_peak_windows, "archive_id sender_id kind rank weekday hour_of_day n", _PEAKS)
Q.rows("most_balanced_month", lambda m: X.most_balanced_month(m, FLOORS["balanced"]), "archive_id month_key total_messages imbalance", Q._SPLIT + f""",
b AS (SELECT archive_id, month_key, max(n) AS hi, min(n) AS lo, any_value(total_messages) AS total_messages FROM sp GROUP BY ALL),
f AS (SELECT *, greatest({FLOORS["balanced"]}, floor(avg(total_messages) OVER (PARTITION BY archive_id) * 0.35e0 + 0.5e0)) AS least FROM b),
g AS (SELECT archive_id, month_key, total_messages, (hi - lo) / CAST(greatest(hi, 1) AS DOUBLE) AS imbalance FROM f WHERE total_messages >= least);;
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY imbalance, total_messages DESC, month_key) AS r FROM g) WHERE r = 1""")
Q.rows("monthly_takeover", X.monthly_takeover, "archive_id month_key winner margin total_messages", Q._SPLIT + """, r AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS second FROM sp WINDOW w AS (PARTITION BY archive_id, month_key ORDER BY n DESC, sender_id)),
w AS (SELECT archive_id, month_key, sender_id AS winner, n - coalesce(second, 0) AS margin, total_messages FROM r WHERE r = 1 AND n IS DISTINCT FROM second);;
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY margin DESC, total_messages DESC, month_key) AS q FROM w) WHERE q = 1""")
Q.rows("night_owl_month", lambda m: X.night_owl_month(m, FLOORS["night"]), "archive_id month_key total_messages late_night_share", f""", n AS (SELECT archive_id, month_key, count(*) AS total_messages, round({_LATE} / CAST(count(*) AS DOUBLE) * 100, 2) AS late_night_share FROM act GROUP BY archive_id, month_key);;
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY late_night_share DESC, total_messages DESC, month_key) AS r FROM n WHERE total_messages >= {FLOORS["night"]}) WHERE r = 1""")
_HINTED = f""", t AS (SELECT archive_id, seq, {Q._TOKENS} AS t FROM a WHERE message_type = 'text' AND word_count BETWEEN 2 AND 8),
c AS (SELECT archive_id, array_to_string(t, ' ') AS phrase, count(*) AS n, min(seq) AS f FROM t WHERE len(t) BETWEEN 2 AND 8 GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY n DESC, f) AS rank FROM c WHERE n >= 3) WHERE rank <= 40),
h AS (SELECT k.*, archetype_tags[1] AS archetype_hint FROM k LEFT JOIN a ON a.archive_id = k.archive_id AND a.seq = k.f)"""
Q.rows("motif_hints", X.hinted_motifs, "archive_id rank phrase archetype_hint n", _HINTED + ";;SELECT * FROM h", 1)
Q.rows("inside_jokes", X.inside_jokes, "archive_id rank phrase n", _HINTED + ";;SELECT * FROM (SELECT archive_id, phrase, n, row_number() OVER (PARTITION BY archive_id ORDER BY rank) AS rank FROM h WHERE n >= 4 AND archetype_hint = 'humor_banter') WHERE rank <= 18", 1)
_WEEKS = f""", w AS (SELECT archive_id, week_key, round(avg(emotion_intensity), 4) AS mean_intensity FROM {Q._AACT} GROUP BY ALL),
l AS (SELECT archive_id, week_key, emotion_label, row_number() OVER (PARTITION BY archive_id, week_key ORDER BY count(*) DESC, min(seq)) AS r FROM {Q._AACT} GROUP BY archive_id, week_key, emotion_label),
t AS (SELECT archive_id, week_key, mean_intensity, emotion_label AS e, row_number() OVER (PARTITION BY archive_id ORDER BY week_key) - 1 AS i, count(*) OVER (PARTITION BY archive_id) AS c FROM w JOIN l USING (archive_id, week_key) WHERE r = 1)"""
Q.rows("arc_summary", X.arc_summary, "archive_id opening_tone middle_tone closing_tone peak_week peak_intensity", _WEEKS + ";;SELECT archive_id, max(e) FILTER (i = 0) AS opening_tone, max(e) FILTER (i = c // 2) AS middle_tone, max(e) FILTER (i = c - 1) AS closing_tone, (list(week_key ORDER BY mean_intensity DESC, week_key))[1] AS peak_week, max(mean_intensity) AS peak_intensity FROM t GROUP BY archive_id", 1)
_PERIOD = "SELECT archive_id, '{0}' AS kind, {1} AS period, {2} AS value, row_number() OVER (PARTITION BY archive_id ORDER BY {2} DESC, min(seq)) AS r FROM {3} GROUP BY archive_id, {1}"
_PERIODS = " UNION ALL ".join(_PERIOD.format(k, p, v, Q._AACT) for k, p, v in (("most_active_month", "month_key", "CAST(count(*) AS DOUBLE)"), ("support_month", "month_key", "CAST(sum(CAST(support_signal AS INT)) AS DOUBLE)"), ("repair_month", "month_key", "CAST(sum(CAST(repair_signal AS INT)) AS DOUBLE)"), ("most_intense_week", "week_key", "CAST(count(*) AS DOUBLE)")))
Q.rows("peak_periods", X.peak_periods, "archive_id kind period value", f";;SELECT * FROM ({_PERIODS}) WHERE r = 1", 1)
_CYCLES = "SELECT archive_id, count(*) FILTER (list_contains(p_arch, 'conflict') AND list_contains(archetypes, 'repair_reconnection')) AS n FROM p GROUP BY archive_id"
Q.rows("conflict_repair_cycles", lambda x: X.conflict_repair_cycles(x[1]), "archive_id n", _CYCLES, 2)
Q.rows("signature_headline", lambda x: X.signature_headline(*x), "archive_id total_messages mean_per_day late_night_share longest_streak top_day top_day_count top_month top_month_count longest_session support_count cycles", f""",
tt AS (SELECT archive_id, count(*) AS total_messages, round(count(*) / CAST(count(DISTINCT day_key) AS DOUBLE), 2) AS mean_per_day, round({_LATE} / CAST(count(*) AS DOUBLE) * 100, 2) AS late_night_share FROM act GROUP BY 1),
dd AS (SELECT DISTINCT archive_id, CAST(day_key AS DATE) AS d FROM act), rr AS (SELECT archive_id, d - CAST(row_number() OVER (PARTITION BY archive_id ORDER BY d) AS INT) AS g FROM dd),
st AS (SELECT archive_id, max(k) AS longest_streak FROM (SELECT archive_id, g, count(*) AS k FROM rr GROUP BY ALL) GROUP BY archive_id),
td AS (SELECT archive_id, day_key AS top_day, count(*) AS top_day_count, row_number() OVER (PARTITION BY archive_id ORDER BY count(*) DESC, day_key) AS r1 FROM act GROUP BY archive_id, day_key),
tm AS (SELECT archive_id, month_key AS top_month, count(*) AS top_month_count, row_number() OVER (PARTITION BY archive_id ORDER BY count(*) DESC, month_key) AS r2 FROM act GROUP BY archive_id, month_key),
ls AS (SELECT archive_id, max(message_count) AS longest_session FROM s GROUP BY 1), su AS (SELECT archive_id, sum(CAST(support_signal AS INT)) AS support_count FROM a GROUP BY 1), cy AS (SELECT archive_id, n AS cycles FROM ({_CYCLES}));;
SELECT * FROM tt LEFT JOIN st USING (archive_id) LEFT JOIN td USING (archive_id) LEFT JOIN tm USING (archive_id) LEFT JOIN ls USING (archive_id) LEFT JOIN su USING (archive_id) LEFT JOIN cy USING (archive_id) WHERE r1 = 1 AND r2 = 1""", 2)
