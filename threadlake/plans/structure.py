"""Registered queries of the transcript parser and of chapters, with their SQL."""

from __future__ import annotations

from threadlake.operators import narrative as N
from threadlake.plans import queries as Q
from threadlake.sources import transcripts as P

Q._COUNTS |= {"line_no", "record_no", "source_line_start", "source_line_end", "chapter_no", "first_segment", "segments"}

_HEAD = "^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}), ([0-9]{1,2}:[0-9]{2}) (am|pm) - (.*)$"
_LINES = f""",
body AS (SELECT archive_id, seq, string_split(day(ts) || '/' || month(ts) || '/' || year(ts) || ', ' || ((hour(ts) + 11) % 12 + 1) || ':' || strftime(ts, '%M') || CASE WHEN hour(ts) < 12 THEN ' am' ELSE ' pm' END || ' - '
  || coalesce(sender_id || ': ', '') || regexp_replace(text, '([.!?]) ', '\\1\n', 'g'), chr(10)) AS pieces FROM m),
each AS (SELECT archive_id, seq, unnest(pieces) AS line, generate_subscripts(pieces, 1) AS p FROM body),
lines AS (SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY seq, p) AS line_no, line FROM each),
parsed AS (SELECT archive_id, line_no, regexp_matches(line, '{_HEAD}') AS is_header, regexp_extract(line, '{_HEAD}', ['d', 't', 'h', 'rest']) AS g, line FROM lines),
pl AS (SELECT archive_id, line_no, is_header, CASE WHEN is_header THEN g.d || ', ' || g.t || ' ' || g.h END AS timestamp_raw, CASE WHEN is_header THEN g.rest ELSE line END AS rest FROM parsed)"""
_RECORDS = _LINES + """,
numbered AS (SELECT *, sum(CAST(is_header AS INT)) OVER (PARTITION BY archive_id ORDER BY line_no) AS record_no FROM pl),
rec AS (SELECT archive_id, record_no, min(line_no) AS source_line_start, max(line_no) AS source_line_end, max(timestamp_raw) AS timestamp_raw, string_agg(rest, chr(10) ORDER BY line_no) AS body FROM numbered WHERE record_no > 0 GROUP BY ALL)"""
_CANONICAL = _RECORDS + f""",
sent AS (SELECT *, record_no - 1 AS seq, strpos(split_part(body, chr(10), 1), ': ') AS mark FROM rec),
said AS (SELECT *, CASE WHEN mark > 1 THEN substr(body, 1, mark - 1) END AS sender_label, {Q._repaired("CASE WHEN mark > 1 THEN substr(body, mark + 2) ELSE body END")} AS text FROM sent),
firsts AS (SELECT archive_id, sender_label, row_number() OVER (PARTITION BY archive_id ORDER BY min(seq)) AS k FROM said WHERE sender_label IS NOT NULL GROUP BY archive_id, sender_label),
can AS (SELECT s.*, printf('msg_%07d', CAST(record_no AS BIGINT)) AS message_id, source_line_end > source_line_start AS is_multiline, strptime(timestamp_raw, '%d/%m/%Y, %I:%M %p') AS ts, printf('participant_%02d', k) AS sender_id,
  CASE WHEN s.sender_label IS NULL THEN 'system' WHEN text = '<Media omitted>' THEN 'media_omitted' WHEN contains(lower(text), 'message was deleted') THEN 'deleted' ELSE 'text' END AS message_type
  FROM said s LEFT JOIN firsts f ON s.archive_id = f.archive_id AND s.sender_label = f.sender_label)"""


def _canonical(m):
    return P.canonical(P.render_lines(m))


Q.rows("parse_lines", lambda m: P.parse_lines(P.render_lines(m)), "archive_id line_no is_header timestamp_raw rest", _LINES + ";;SELECT * FROM pl")
Q.rows("assemble_records", lambda m: P.assemble_records(P.parse_lines(P.render_lines(m))), "archive_id record_no source_line_start source_line_end timestamp_raw body", _RECORDS + ";;SELECT * FROM rec")
for _name, _cols in (
    ("split_sender", "sender_label text"), ("parse_timestamp", "timestamp_raw ts"), ("detect_type", "text message_type"), ("assign_ids", "message_id sender_label sender_id"),
    ("canonical_messages", "message_id source_line_start source_line_end timestamp_raw ts sender_id sender_label message_type text is_multiline"),
):
    Q.rows(_name, _canonical, "archive_id seq " + _cols, _CANONICAL + ";;SELECT * FROM can")

_CHAPTERS = """,
mood2 AS (SELECT archive_id, segment_no, dominant_emotion, row_number() OVER (PARTITION BY archive_id, segment_no ORDER BY count(*) DESC, min(session_no)) AS r FROM seg GROUP BY archive_id, segment_no, dominant_emotion),
sizes AS (SELECT archive_id, segment_no, sum(message_count) AS message_count FROM seg GROUP BY ALL),
sg AS (SELECT z.*, d.dominant_emotion, sum(message_count) OVER (PARTITION BY archive_id) AS total, count(*) OVER (PARTITION BY archive_id) AS size FROM sizes z JOIN mood2 d USING (archive_id, segment_no) WHERE r = 1),
st AS (SELECT *, least(6, size) AS target, greatest(1, ceil(total / CAST(least(6, size) AS DOUBLE))) AS share FROM sg),
fold AS (
  SELECT archive_id, CAST(0 AS BIGINT) AS segment_no, CAST(0 AS BIGINT) AS running, CAST(0 AS BIGINT) AS done, CAST(0 AS BIGINT) AS chapter_no FROM (SELECT DISTINCT archive_id FROM st)
  UNION ALL
  SELECT archive_id, segment_no, CASE WHEN enough THEN 0 ELSE running END, done + CAST(enough AS BIGINT), done + 1 FROM (
    SELECT s.archive_id, CAST(s.segment_no AS BIGINT) AS segment_no, CAST(f.running + s.message_count AS BIGINT) AS running, f.done,
      f.running + s.message_count >= share AND (size - s.segment_no >= target - f.done - 1 OR target - f.done - 1 <= 0) AS enough
    FROM fold f JOIN st s ON s.archive_id = f.archive_id AND s.segment_no = f.segment_no + 1)),
ch AS (SELECT st.*, chapter_no FROM st JOIN fold ON st.archive_id = fold.archive_id AND st.segment_no = fold.segment_no)"""


def _chapters(x):
    return N.with_chapters(N.segment_summary(N.with_segments(x[1])))


Q.rows("chapters", _chapters, "archive_id segment_no message_count chapter_no", _CHAPTERS + ";;SELECT * FROM ch", 2)
Q.rows("chapter_summary", lambda x: N.chapter_summary(_chapters(x)), "archive_id chapter_no first_segment segments message_count dominant_emotion", _CHAPTERS + """,
v AS (SELECT archive_id, chapter_no, dominant_emotion, row_number() OVER (PARTITION BY archive_id, chapter_no ORDER BY count(*) DESC, min(segment_no)) AS r FROM ch GROUP BY archive_id, chapter_no, dominant_emotion),
b AS (SELECT archive_id, chapter_no, min(segment_no) AS first_segment, count(*) AS segments, sum(message_count) AS message_count FROM ch GROUP BY ALL);;
SELECT * FROM b JOIN v USING (archive_id, chapter_no) WHERE r = 1""", 2)  # fmt: skip
for _name in ("chapters", "chapter_summary"):
    Q.ORACLES[_name] = Q.ORACLES[_name].replace("WITH", "WITH RECURSIVE", 1)
