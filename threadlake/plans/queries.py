"""Registered queries over the message test bed, each with the same question in DuckDB SQL."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import labels as L
from threadlake.functions import text as T
from threadlake.operators import narrative as N
from threadlake.operators import rollups as R
from threadlake.operators import sessions as S
from threadlake.operators.annotate import ANNOTATIONS
from threadlake.sources.messages import PHRASES, messages_view
from threadlake.sources.store import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _hits(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(normalized_text, {quoted(w)}) AS INT)" for w in words) + ")"


def _tags(table: dict[str, list[str]], default: str) -> str:
    each = ", ".join(f"CASE WHEN {_hits(w)} > 0 THEN {quoted(t)} END" for t, w in table.items())
    return f"CASE WHEN len(list_filter([{each}], lambda x: x IS NOT NULL)) = 0 THEN [{quoted(default)}] ELSE list_sort(list_filter([{each}], lambda x: x IS NOT NULL)) END"


def _repaired(c: str) -> str:
    for a, b in T.REPAIRS:
        c = f"replace({c}, {quoted(a)}, {quoted(b)})"
    return f"trim(regexp_replace({c}, '[{L.SPACES}]+', ' ', 'g'))"


BASE = f"""
conv AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY conv_id, turn),
m0 AS (
  SELECT user_id // 50 AS archive_id, CAST(row_number() OVER (PARTITION BY user_id // 50 ORDER BY event_id) - 1 AS BIGINT) AS seq,
    date_trunc('minute', ts) + to_days(CAST(25 * ((day(ts) - 1) // 5) AS INTEGER)) AS ts, e.event_id, user_id,
    CASE WHEN event_type = 'signup' AND event_id % 10 = 0 THEN 'system' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'deleted' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'media_omitted' ELSE 'text' END AS message_type, said
  FROM (SELECT *, CASE WHEN event_id % 5 = 1 THEN event_id // 5 END AS k, (SELECT max(conv_id) + 1 FROM conversations) AS nc FROM events) e LEFT JOIN conv ON conv_id = k % nc AND turn = (k // nc) % 8),
m1 AS (
  SELECT archive_id, seq, ts, message_type, CASE WHEN message_type <> 'system' THEN 'participant_0' || (user_id % 5 + 1) END AS sender_id,
    CASE message_type WHEN 'deleted' THEN 'This message was deleted' WHEN 'media_omitted' THEN '<Media omitted>'
      ELSE coalesce(trim(regexp_replace(said, '\\s+', ' ', 'g')), ([{", ".join(map(quoted, PHRASES))}])[(event_id * 7 + user_id) % 40 + 1]) END AS text, coalesce(message_type = 'text' AND contains(said, chr(10)), false) AS is_multiline
  FROM m0),
m2 AS (
  SELECT *, {_repaired("lower(text)")} AS normalized_text, regexp_matches(text, '(?i)(https?://|www\\.)') AS has_url,
    CAST(length(text) + len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS INT) AS char_count,
    CAST(len(list_filter(string_split({_repaired("text")}, ' '), lambda x: x <> '')) AS INT) AS word_count, CAST(len(regexp_extract_all(text, '{L.EMOJI}')) AS INT) AS emoji_count,
    CAST(hour(ts) AS INT) AS hour_of_day, CAST(dayofweek(ts) AS INT) AS weekday, strftime(ts, '%Y-%m-%d') AS day_key, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_key, strftime(ts, '%Y-%m') AS month_key,
    lag(ts) OVER (PARTITION BY archive_id ORDER BY seq) AS before, lag(ts) OVER (PARTITION BY archive_id, sender_id ORDER BY seq) AS own_before
  FROM m1),
m AS (
  SELECT *, sum(CASE WHEN gap_minutes IS NULL OR gap_minutes >= {L.SESSION_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY archive_id ORDER BY seq) AS session_no
  FROM (SELECT *, CAST(greatest(0, floor((epoch(ts) - epoch(before)) / 60.0 + 0.5)) AS INT) AS g, CASE WHEN before IS NOT NULL THEN CAST(greatest(0, floor((epoch(ts) - epoch(before)) / 60.0 + 0.5)) AS INT) END AS gap_minutes,
      CASE WHEN own_before IS NOT NULL AND sender_id IS NOT NULL THEN CAST(greatest(0, floor((epoch(ts) - epoch(own_before)) / 60.0 + 0.5)) AS INT) END AS reply_gap_minutes FROM m2)),
act AS (SELECT * FROM m WHERE message_type <> 'system')"""

_EMO = list(L.EMOTIONS)
ANNOTATED = f""",
a0 AS (SELECT *, {", ".join(f"{_hits(w)} AS h_{e}" for e, w in L.EMOTIONS.items())} FROM m),
a1 AS (SELECT *, greatest({", ".join(f"h_{e}" for e in _EMO)}) AS best FROM a0),
a2 AS (SELECT *, CASE WHEN best = 0 THEN 'romantic' {" ".join(f"WHEN h_{e} = best THEN '{e}'" for e in _EMO)} END AS emotion_label, {_tags(L.ARCHETYPES, "everyday_life")} AS archetype_tags, {_tags(L.TOPICS, "daily_life")} AS topic_tags FROM a1),
a3 AS (SELECT *, least(1e0, greatest(0e0, 0.15e0 + emoji_count * 0.04e0 + len(regexp_extract_all(text, '!')) * 0.04e0 + len(regexp_extract_all(text, '\\?')) * 0.03e0
    + CASE WHEN char_count > 4 AND text = upper(text) THEN 0.12e0 ELSE 0e0 END + CASE WHEN emotion_label <> 'neutral' THEN 0.18e0 ELSE 0e0 END + least(word_count, 40) / 140e0)) AS ri,
    {_hits(L.SUPPORT)} > 0 AS support_signal, emotion_label = 'conflict' OR list_contains(archetype_tags, 'conflict') OR contains(normalized_text, 'hurt') AS conflict_signal,
    list_contains(archetype_tags, 'repair_reconnection') OR {_hits(L.REPAIR)} > 0 AS repair_signal FROM a2),
a4 AS (SELECT *, least(1e0, greatest(0e0, 0.15e0 + ri * 0.45e0 + least(word_count, 40) / 120e0 + CASE WHEN support_signal THEN 0.16e0 ELSE 0e0 END + CASE WHEN conflict_signal THEN 0.18e0 ELSE 0e0 END + CASE WHEN repair_signal THEN 0.18e0 ELSE 0e0 END
    + CASE WHEN {_hits(L.INTIMACY)} > 0 THEN 0.2e0 ELSE 0e0 END + CASE WHEN {_hits(L.BANTER)} > 0 THEN 0.15e0 ELSE 0e0 END - CASE WHEN {_hits(L.INSTITUTIONAL)} > 0 THEN 0.5e0 ELSE 0e0 END - CASE WHEN word_count > 60 THEN 0.3e0 ELSE 0e0 END)) AS rs FROM a3),
a AS (SELECT *, message_type = 'text' AND rs >= 0.67e0 AND word_count BETWEEN 4 AND 50 AS highlight_candidate, rs >= 0.78e0 OR support_signal OR conflict_signal OR repair_signal OR list_contains(archetype_tags, 'affection') AS milestone_candidate,
    floor(ri * 10000e0 + 0.5e0) / 10000e0 AS emotion_intensity, floor(rs * 10000e0 + 0.5e0) / 10000e0 AS importance_score, floor((0.3e0 + rs * 0.7e0) * 10000e0 + 0.5e0) / 10000e0 AS evidence_score FROM a4)"""

SESSIONS = """,
s0 AS (SELECT archive_id, session_no, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(ts, seq) AS start_ts, arg_max(ts, seq) AS end_ts, count(*) AS message_count, avg(importance_score) AS mean_importance FROM a GROUP BY ALL),
s1 AS (SELECT *, message_count / greatest(1e0, (epoch(end_ts) - epoch(start_ts)) / 3600e0) AS density FROM s0),
mood AS (SELECT archive_id, session_no, emotion_label AS dominant_emotion FROM (SELECT archive_id, session_no, emotion_label, row_number() OVER (PARTITION BY archive_id, session_no ORDER BY count(*) DESC, min(seq)) AS r FROM a GROUP BY archive_id, session_no, emotion_label) WHERE r = 1),
tops AS (SELECT archive_id, session_no, list(t ORDER BY r) AS topics FROM (SELECT archive_id, session_no, t, row_number() OVER (PARTITION BY archive_id, session_no ORDER BY count(*) DESC, min(seq * 100 + p)) AS r
   FROM (SELECT archive_id, session_no, seq, unnest(topic_tags) AS t, generate_subscripts(topic_tags, 1) AS p FROM a) GROUP BY archive_id, session_no, t) WHERE r <= 3 GROUP BY ALL),
arch AS (SELECT archive_id, session_no, list(t ORDER BY r) AS archetypes FROM (SELECT archive_id, session_no, t, row_number() OVER (PARTITION BY archive_id, session_no ORDER BY count(*) DESC, min(seq * 100 + p)) AS r
   FROM (SELECT archive_id, session_no, seq, unnest(archetype_tags) AS t, generate_subscripts(archetype_tags, 1) AS p FROM a) GROUP BY archive_id, session_no, t) WHERE r <= 3 GROUP BY ALL),
s AS (SELECT * FROM s1 JOIN mood USING (archive_id, session_no) JOIN tops USING (archive_id, session_no) JOIN arch USING (archive_id, session_no)),
p AS (SELECT *, lag(end_ts) OVER w AS p_end, lag(dominant_emotion) OVER w AS p_emotion, lag(topics) OVER w AS p_topics, lag(archetypes) OVER w AS p_arch, lag(density) OVER w AS p_density FROM s WINDOW w AS (PARTITION BY archive_id ORDER BY session_no)),
scored AS (SELECT *, CASE WHEN p_end IS NULL THEN 2 ELSE CASE WHEN date_diff('day', p_end, start_ts) >= 2 THEN 2 ELSE 0 END + CAST(p_emotion <> dominant_emotion AS INT) + CAST(NOT list_has_any(p_topics, topics) AS INT)
   + CAST(abs(p_density - density) >= 4 AS INT) + CASE WHEN list_contains(p_arch, 'conflict') AND list_contains(archetypes, 'repair_reconnection') THEN 2 ELSE 0 END END AS change_score FROM p),
runs AS (SELECT *, sum(CASE WHEN change_score >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY archive_id ORDER BY session_no) AS run FROM scored),
cut AS (SELECT *, (row_number() OVER (PARTITION BY archive_id, run ORDER BY session_no) - 1) // 4 AS part FROM runs),
seg AS (SELECT *, dense_rank() OVER (PARTITION BY archive_id ORDER BY run, part) AS segment_no FROM cut)"""


#: What queries that are made within shared() read: annotated messages, written once.
_SHARED: ContextVar[DataFrame | None] = ContextVar("shared", default=None)


@contextmanager
def shared(spark: SparkSession, sf_dir: str):
    """Queries made within read one table of annotated messages, which is written now."""
    token = _SHARED.set(written(messages_view(spark, sf_dir, annotated=True)))
    try:
        yield
    finally:
        _SHARED.reset(token)


def messages(spark: SparkSession, sf_dir: str, annotated: bool) -> DataFrame:
    m = _SHARED.get()
    if m is None:
        return messages_view(spark, sf_dir, annotated)
    return m if annotated else m.drop(*ANNOTATIONS)


def add(name: str, build, sql: str, level: int = 0) -> None:
    """level: 0 needs messages, 1 annotations, 2 sessions and segments, 3 these and annotated messages, which are written once for both."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = messages(spark, sf_dir, level > 0)
        a = written(a) if level > 2 and not _SHARED.get() else a
        return build(a if level < 2 else (a, N.session_summaries(a)))

    QUERIES[name] = query
    ORACLES[name] = "WITH " + BASE.strip() + ANNOTATED * (level > 0) + SESSIONS * (level > 1) + "\n" + sql


def column(name: str, make, sql: str, level: int = 0) -> None:
    add(name, lambda m: m.select("archive_id", "seq", make.alias("value") if not callable(make) else make().alias("value")), f"SELECT archive_id, seq, {sql} AS value FROM {'a' if level else 'm'}", level)


def long(*names: str):
    return lambda df: df.select(*(F.col(n).cast("long").alias(n) if n in _COUNTS else F.col(n) for n in names))


_COUNTS = {"multiline_count", "n", "seq", "rank", "session_no", "message_count", "total_messages", "margin", "winner_count", "late_night_count", "late_night_messages", "active_days", "longest_streak", "chunk_no", "change_score", "segment_no", "support_count", "conflict_count", "repair_count", "sessions", "first_session", "first_seq", "last_seq", "total_words", "emoji_count", "link_count", "session_opener_count", "longest_message", "hour_of_day", "weekday", "gap_minutes", "reply_gap_minutes", "from_seq", "archive_id"}


def rows(name: str, build, names: str, sql: str, level: int = 0) -> None:
    """Columns by name; counts are BIGINT on both sides."""
    cols = names.split()
    out = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in _COUNTS else c for c in cols)
    head, _, tail = sql.rpartition(";;")
    add(name, lambda x: long(*cols)(build(x)), f"{head}\nSELECT {out} FROM ({tail})", level)


column("normalize_whitespace", lambda: T.normalize_whitespace(F.concat(F.lit(" â€œ "), F.col("text"), F.lit("â€¦ x\t"))), _repaired("' â€œ ' || text || 'â€¦ x\t'"))
column("normalize_text", lambda: F.col("normalized_text"), "normalized_text")
column("count_emoji", lambda: F.col("emoji_count"), "emoji_count")
column("has_url", lambda: F.col("has_url"), "has_url")
column("word_count", lambda: F.col("word_count"), "word_count")
column("char_count", lambda: F.col("char_count"), "char_count")
_STOP = ", ".join(map(quoted, L.STOP_WORDS))
_TOKENS = f"list_filter(string_split_regex(regexp_replace(normalized_text, '[^\\p{{L}}\\p{{N}}{L.SPACES}]', ' ', 'g'), '[{L.SPACES}]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP}))"
column("tokenize", lambda: F.array_join(T.tokenize(F.col("text")), " "), f"array_to_string({_TOKENS}, ' ')")
column("slugify", lambda: T.slugify(F.col("text")), "substr(regexp_replace(regexp_replace(normalized_text, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)")
column("sentence_case", lambda: T.sentence_case(F.col("text")), "CASE WHEN substr(text, 1, 1) = 'ß' THEN 'SS' ELSE upper(substr(text, 1, 1)) END || substr(text, 2)")
column("title_case", lambda: T.title_case(F.col("text")), f"array_to_string(list_transform(list_filter(string_split_regex(text, '[_\\-{L.SPACES}]+'), lambda x: x <> ''), lambda x: CASE WHEN substr(x, 1, 1) = 'ß' THEN 'SS' ELSE upper(substr(x, 1, 1)) END || substr(x, 2)), ' ')")
rows("calendar_keys", lambda m: m, "archive_id seq hour_of_day weekday day_key week_key month_key", "SELECT * FROM m")
rows("gap_minutes", lambda m: m, "archive_id seq gap_minutes", "SELECT * FROM m")
rows("sessionize", lambda m: m, "archive_id seq session_no", "SELECT * FROM m")
rows("reply_gap", lambda m: m, "archive_id seq reply_gap_minutes", "SELECT * FROM m")
column("late_night_flag", lambda: T.late_night(F.col("hour_of_day")), "hour_of_day IN (22, 23, 0, 1, 2, 3, 4)")
column("weekend_flag", lambda: T.weekend(F.col("weekday")), "weekday IN (0, 6)")
rows("silence_gaps", S.silence_gaps, "archive_id rank from_seq seq gap_minutes", """, g AS (SELECT archive_id, seq, lag(seq) OVER w AS from_seq, floor((epoch(ts) - epoch(lag(ts) OVER w)) / 60.0 + 0.5) AS gap_minutes FROM act WINDOW w AS (PARTITION BY archive_id ORDER BY seq)),
r AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY gap_minutes DESC, seq) AS rank FROM g WHERE gap_minutes > 0);;SELECT * FROM r WHERE rank <= 6""")
rows("chunk_windows", S.chunk_windows, "archive_id seq chunk_no", """, c AS (SELECT archive_id, count(*) AS n FROM m GROUP BY 1), k AS (SELECT archive_id, n, unnest(range(0, CASE WHEN n <= 120 THEN 1 ELSE CAST(ceil((n - 120) / 105.0) AS BIGINT) + 1 END)) AS k FROM c);;SELECT m.archive_id, m.seq, k + 1 AS chunk_no FROM m JOIN k ON m.archive_id = k.archive_id AND m.seq >= 105 * k AND m.seq < 105 * k + 120""")
rows("longest_streak", S.longest_streak, "archive_id longest_streak", """, d AS (SELECT DISTINCT archive_id, CAST(day_key AS DATE) AS d FROM act), r AS (SELECT archive_id, d - CAST(row_number() OVER (PARTITION BY archive_id ORDER BY d) AS INT) AS run FROM d), n AS (SELECT archive_id, run, count(*) AS n FROM r GROUP BY ALL);;SELECT archive_id, max(n) AS longest_streak FROM n GROUP BY 1""")
add("participants", R.participants, """, f AS (SELECT archive_id, sender_id AS label, min(seq) AS s, count(*) AS message_count FROM m WHERE sender_id IS NOT NULL GROUP BY ALL)
SELECT archive_id, printf('participant_%02d', row_number() OVER (PARTITION BY archive_id ORDER BY s)) AS participant_id, label, message_count, printf('msg_%07d', s + 1) AS first_message_id FROM f""")
rows("daily_counts", R.daily_counts, "archive_id day_key n", "SELECT archive_id, day_key, count(*) AS n FROM act GROUP BY ALL")
rows("heatmap_bins", R.heatmap_bins, "archive_id weekday hour_of_day n", "SELECT archive_id, weekday, hour_of_day, count(*) AS n FROM m GROUP BY ALL")
rows("monthly_volume", R.monthly_volume, "archive_id month_key n", "SELECT archive_id, month_key, count(*) AS n FROM act GROUP BY ALL")
rows("frequency_summary", R.frequency_summary, "archive_id total_messages active_days mean_per_day", "SELECT archive_id, count(*) AS total_messages, count(DISTINCT day_key) FILTER (message_type <> 'system') AS active_days, round(count(*) FILTER (message_type <> 'system') / greatest(1e0, count(DISTINCT day_key) FILTER (message_type <> 'system')), 2) AS mean_per_day FROM m GROUP BY 1")
_OPEN = ", o AS (SELECT archive_id, session_no, arg_min(sender_id, seq) AS sender_id FROM act GROUP BY ALL)"
rows("session_openers", R.session_openers, "archive_id sender_id n", _OPEN + ";;SELECT archive_id, sender_id, count(*) AS n FROM o GROUP BY ALL")
rows("participant_overview", R.participant_overview, "archive_id sender_id total_messages message_share total_words words_per_message chars_per_message emoji_count emoji_share link_count link_share weekend_percentage late_night_percentage session_opener_count longest_message multiline_count average_reply_gap", _OPEN + """,
oc AS (SELECT archive_id, sender_id, count(*) AS opened FROM o GROUP BY ALL),
p AS (SELECT archive_id, sender_id, count(*) AS n, sum(word_count) AS words, sum(char_count) AS chars, sum(emoji_count) AS emoji, sum(CAST(has_url AS INT)) AS links, sum(CAST(weekday IN (0, 6) AS INT)) AS weekends, sum(CAST(hour_of_day IN (22, 23, 0, 1, 2, 3, 4) AS INT)) AS late, max(char_count) AS longest, sum(CAST(is_multiline AS INT)) AS multiline_count, avg(reply_gap_minutes) AS gap FROM act WHERE sender_id IS NOT NULL GROUP BY ALL);;
SELECT archive_id, sender_id, n AS total_messages, round(n / greatest(1e0, sum(n) OVER w) * 100, 2) AS message_share, words AS total_words, round(words / CAST(n AS DOUBLE), 2) AS words_per_message, round(chars / CAST(n AS DOUBLE), 2) AS chars_per_message, emoji AS emoji_count,
round(emoji / greatest(1e0, sum(emoji) OVER w) * 100, 2) AS emoji_share, links AS link_count, round(links / greatest(1e0, sum(links) OVER w) * 100, 2) AS link_share, round(weekends / CAST(n AS DOUBLE) * 100, 2) AS weekend_percentage, round(late / CAST(n AS DOUBLE) * 100, 2) AS late_night_percentage,
coalesce(opened, 0) AS session_opener_count, longest AS longest_message, multiline_count, round(coalesce(gap, 0e0), 2) AS average_reply_gap FROM p LEFT JOIN oc USING (archive_id, sender_id) WINDOW w AS (PARTITION BY archive_id)""")
rows("reply_gaps", R.reply_gaps, "archive_id sender_id average_reply_gap", "SELECT archive_id, sender_id, round(coalesce(avg(reply_gap_minutes), 0e0), 2) AS average_reply_gap FROM act WHERE sender_id IS NOT NULL GROUP BY ALL")
_SPLIT = """, mo AS (SELECT archive_id, month_key, count(*) AS total_messages, sum(CAST(hour_of_day IN (22, 23, 0, 1, 2, 3, 4) AS INT)) AS late_night_count FROM act GROUP BY ALL), pe AS (SELECT DISTINCT archive_id, sender_id FROM act WHERE sender_id IS NOT NULL),
c AS (SELECT archive_id, month_key, sender_id, count(*) AS k FROM act GROUP BY ALL), sp AS (SELECT mo.archive_id, mo.month_key, pe.sender_id, total_messages, late_night_count, coalesce(k, 0) AS n FROM mo JOIN pe USING (archive_id) LEFT JOIN c ON c.archive_id = mo.archive_id AND c.month_key = mo.month_key AND c.sender_id = pe.sender_id)"""
rows("monthly_split", R.monthly_split, "archive_id month_key sender_id total_messages late_night_count n", _SPLIT + ";;SELECT * FROM sp")
rows("month_winners", R.month_winners, "archive_id month_key winner winner_count margin total_messages", _SPLIT + ", r AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS second FROM sp WINDOW w AS (PARTITION BY archive_id, month_key ORDER BY n DESC, sender_id));;SELECT archive_id, month_key, CASE WHEN n = second THEN NULL ELSE sender_id END AS winner, n AS winner_count, CASE WHEN n = second THEN 0 ELSE n - coalesce(second, 0) END AS margin, total_messages FROM r WHERE r = 1")
rows("late_night_trend", R.late_night_trend, "archive_id month_key total_messages late_night_messages late_night_share", "SELECT archive_id, month_key, total_messages, l AS late_night_messages, round(l / CAST(total_messages AS DOUBLE) * 100, 2) AS late_night_share FROM (SELECT archive_id, month_key, count(*) AS total_messages, sum(CAST(hour_of_day IN (22, 23, 0, 1, 2, 3, 4) AS INT)) AS l FROM act GROUP BY ALL)")
for _name, _col, _size in (("weekday_distribution", "weekday", 7), ("hour_distribution", "hour_of_day", 24)):
    rows(_name + "_by_sender", lambda m, c=_col, n=_size: R.distribution_by_sender(m, c, n), f"archive_id sender_id {_col} n", f", g AS (SELECT archive_id, sender_id, unnest(range(0, {_size})) AS {_col} FROM (SELECT DISTINCT archive_id, sender_id FROM act WHERE sender_id IS NOT NULL)), c AS (SELECT archive_id, sender_id, {_col}, count(*) AS k FROM act GROUP BY ALL);;SELECT archive_id, sender_id, {_col}, coalesce(k, 0) AS n FROM g LEFT JOIN c USING (archive_id, sender_id, {_col})")
    rows(_name, lambda m, c=_col, n=_size: R.dense(m, c, n), f"archive_id {_col} n", f", g AS (SELECT archive_id, unnest(range(0, {_size})) AS {_col} FROM (SELECT DISTINCT archive_id FROM m)), c AS (SELECT archive_id, {_col}, count(*) AS k FROM act GROUP BY ALL);;SELECT archive_id, {_col}, coalesce(k, 0) AS n FROM g LEFT JOIN c USING (archive_id, {_col})")
for _name, _quiet in (("busiest_windows", False), ("quietest_windows", True)):
    rows(_name, lambda m, q=_quiet: R.window_extremes(m, quiet=q), "archive_id rank weekday hour_of_day n", f", c AS (SELECT archive_id, weekday, hour_of_day, count(*) AS n FROM act GROUP BY ALL);;SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY n {'' if _quiet else 'DESC'}, weekday, hour_of_day) AS rank FROM c) WHERE rank <= 6")
rows("highest_volume_days", R.highest_volume_days, "archive_id rank day_key n", ", c AS (SELECT archive_id, day_key, count(*) AS n FROM act GROUP BY ALL);;SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY n DESC, day_key) AS rank FROM c) WHERE rank <= 6")
rows("fastest_exchange_windows", N.fastest_exchange_windows, "archive_id rank session_no n average_reply_gap", ", c AS (SELECT archive_id, session_no, count(*) AS n, round(coalesce(avg(reply_gap_minutes), 0e0), 2) AS average_reply_gap FROM act GROUP BY ALL);;SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY average_reply_gap, session_no) AS rank FROM c WHERE n >= 20) WHERE rank <= 6")
rows("phrase_motifs", N.phrase_motifs, "archive_id rank phrase label n", f", t AS (SELECT archive_id, seq, {_TOKENS} AS t FROM m WHERE message_type = 'text' AND word_count BETWEEN 2 AND 8), c AS (SELECT archive_id, array_to_string(t, ' ') AS phrase, count(*) AS n, min(seq) AS f FROM t WHERE len(t) BETWEEN 2 AND 8 GROUP BY ALL);;SELECT archive_id, rank, phrase, upper(substr(phrase, 1, 1)) || substr(phrase, 2) AS label, n FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY n DESC, f) AS rank FROM c WHERE n >= 3) WHERE rank <= 40")
column("emotion_label", lambda: F.col("emotion_label"), "emotion_label", 1)
column("archetype_tags", lambda: F.array_join("archetype_tags", ","), "array_to_string(archetype_tags, ',')", 1)
column("topic_tags", lambda: F.array_join("topic_tags", ","), "array_to_string(topic_tags, ',')", 1)
column("emotion_intensity", lambda: F.col("emotion_intensity"), "emotion_intensity", 1)
column("importance_score", lambda: F.col("importance_score"), "importance_score", 1)
rows("signals_and_candidates", lambda a: a, "archive_id seq support_signal conflict_signal repair_signal highlight_candidate milestone_candidate evidence_score", "SELECT * FROM a", 1)
_AACT = "(SELECT * FROM a WHERE message_type <> 'system')"
rows("emotion_timeline", R.emotion_timeline, "archive_id week_key mean_intensity dominant_emotion n", f", w AS (SELECT archive_id, week_key, round(avg(emotion_intensity), 4) AS mean_intensity, count(*) AS n FROM {_AACT} GROUP BY ALL), l AS (SELECT archive_id, week_key, emotion_label AS dominant_emotion, row_number() OVER (PARTITION BY archive_id, week_key ORDER BY count(*) DESC, min(seq)) AS r FROM {_AACT} GROUP BY archive_id, week_key, emotion_label);;SELECT * FROM w JOIN l USING (archive_id, week_key) WHERE r = 1", 1)
rows("emotion_mix", R.emotion_mix, "archive_id sender_id emotion_label n", f"SELECT archive_id, coalesce(sender_id, '*') AS sender_id, emotion_label, count(*) AS n FROM {_AACT} GROUP BY GROUPING SETS ((archive_id, emotion_label), (archive_id, sender_id, emotion_label))", 1)
rows("archetype_mix", R.archetype_mix, "archive_id sender_id archetype n", f"SELECT archive_id, coalesce(sender_id, '*') AS sender_id, archetype, count(*) AS n FROM (SELECT archive_id, sender_id, unnest(archetype_tags) AS archetype FROM {_AACT}) GROUP BY GROUPING SETS ((archive_id, archetype), (archive_id, sender_id, archetype))", 1)
for _name, _by in (("signal_totals", "sender_id"), ("signal_trend", "month_key")):
    rows(_name, lambda a, by=_by: R.signals(a, by), f"archive_id {_by} support_count conflict_count repair_count", f"SELECT archive_id, {_by}, {', '.join(f'sum(CAST({s}_signal AS INT)) AS {s}_count' for s in ('support', 'conflict', 'repair'))} FROM {_AACT} GROUP BY ALL", 1)
rows("topic_clusters", N.topic_clusters, "archive_id rank topic n", ", e AS (SELECT archive_id, seq, unnest(topic_tags) AS topic, generate_subscripts(topic_tags, 1) AS p FROM a);;SELECT archive_id, topic, count(*) AS n, row_number() OVER (PARTITION BY archive_id ORDER BY count(*) DESC, min(seq * 100 + p)) AS rank FROM e GROUP BY archive_id, topic", 1)
rows("highlights", N.highlights, "archive_id rank seq importance_score", ", b AS (SELECT *, row_number() OVER (PARTITION BY archive_id, normalized_text ORDER BY importance_score DESC, seq) AS r FROM a WHERE message_type = 'text' AND highlight_candidate);;SELECT * FROM (SELECT archive_id, seq, importance_score, row_number() OVER (PARTITION BY archive_id ORDER BY importance_score DESC, seq) AS rank FROM b WHERE r = 1) WHERE rank <= 60", 1)
rows("session_summaries", lambda x: x[1].withColumns({"topics": F.array_join("topics", ","), "archetypes": F.array_join("archetypes", ","), "density": F.round("density", 6), "mean_importance": F.round("mean_importance", 6)}), "archive_id session_no first_seq last_seq message_count mean_importance density dominant_emotion topics archetypes", "SELECT * REPLACE (array_to_string(topics, ',') AS topics, array_to_string(archetypes, ',') AS archetypes, round(density, 6) AS density, round(mean_importance, 6) AS mean_importance) FROM s", 2)
rows("change_score", lambda x: N.change_scores(x[1]), "archive_id session_no change_score", "SELECT * FROM scored", 2)
rows("narrative_segments", lambda x: N.with_segments(x[1]), "archive_id session_no segment_no", "SELECT * FROM seg", 2)
rows("longest_sessions", lambda x: N.session_extremes(x[1], "message_count"), "archive_id rank session_no message_count density", ", r AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY message_count DESC, session_no) AS rank FROM s);;SELECT * REPLACE (round(density, 2) AS density) FROM r WHERE rank <= 6", 2)
rows("densest_sessions", lambda x: N.session_extremes(x[1], "density"), "archive_id rank session_no message_count density", ", r AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY density DESC, session_no) AS rank FROM s);;SELECT * REPLACE (round(density, 2) AS density) FROM r WHERE rank <= 6", 2)
rows("segment_summary", lambda x: N.segment_summary(N.with_segments(x[1])), "archive_id segment_no first_session sessions message_count dominant_emotion dominant_archetype conflict_repair_cycle", """, b AS (SELECT archive_id, segment_no, min(session_no) AS first_session, count(*) AS sessions, sum(message_count) AS message_count, bool_or(list_contains(archetypes, 'conflict')) AND bool_or(list_contains(archetypes, 'repair_reconnection')) AS conflict_repair_cycle FROM seg GROUP BY ALL),
e AS (SELECT archive_id, segment_no, dominant_emotion, row_number() OVER (PARTITION BY archive_id, segment_no ORDER BY count(*) DESC, min(session_no)) AS r FROM seg GROUP BY archive_id, segment_no, dominant_emotion),
x AS (SELECT archive_id, segment_no, session_no, unnest(archetypes) AS t, generate_subscripts(archetypes, 1) AS p FROM seg), y AS (SELECT archive_id, segment_no, t AS dominant_archetype, row_number() OVER (PARTITION BY archive_id, segment_no ORDER BY count(*) DESC, min(session_no * 100 + p)) AS q FROM x GROUP BY archive_id, segment_no, t);;
SELECT * FROM b JOIN e USING (archive_id, segment_no) JOIN y USING (archive_id, segment_no) WHERE r = 1 AND q = 1""", 2)


def _placed(x) -> DataFrame:
    a, s = x
    return a.join(N.with_segments(s).select("archive_id", "session_no", "segment_no"), ["archive_id", "session_no"], "left")


rows("message_to_segment", _placed, "archive_id seq session_no segment_no", "SELECT a.archive_id, a.seq, a.session_no, segment_no FROM a LEFT JOIN seg ON a.archive_id = seg.archive_id AND a.session_no = seg.session_no", 2)
rows("milestones", lambda x: N.milestones(_placed(x)), "archive_id rank segment_no seq milestone_type importance_score", """, pl AS (SELECT a.*, segment_no FROM a LEFT JOIN seg ON a.archive_id = seg.archive_id AND a.session_no = seg.session_no), b AS (SELECT *, row_number() OVER (PARTITION BY archive_id, segment_no ORDER BY importance_score DESC, seq) AS r FROM pl WHERE message_type = 'text' AND milestone_candidate);;
SELECT * FROM (SELECT archive_id, segment_no, seq, importance_score, CASE WHEN repair_signal THEN 'repair' WHEN conflict_signal THEN 'conflict' WHEN support_signal THEN 'support' WHEN list_contains(archetype_tags, 'affection') THEN 'affection' WHEN list_contains(archetype_tags, 'future_imagining') THEN 'future' ELSE 'turning_point' END AS milestone_type,
row_number() OVER (PARTITION BY archive_id ORDER BY importance_score DESC, seq) AS rank FROM b WHERE r = 1) WHERE rank <= 24""", 3)
