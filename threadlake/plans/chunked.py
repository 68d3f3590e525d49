"""Registered queries of chunks, keyword counts, records, spotlights, month shards and validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.functions import labels as L
from threadlake.functions.text import format_compact
from threadlake.operators import annotate as A
from threadlake.operators import chunks as K
from threadlake.operators import narrative as N
from threadlake.operators import records as X
from threadlake.plans import queries as Q
from threadlake.plans.records import _PERIODS
from threadlake.plans.story import PLACED, shown
from threadlake.sources import shards as H
from threadlake.sources import store as I
from threadlake.sources import tables as S

Q._COUNTS |= {"checked", "violations", "bytes", "total_bytes", "file_count", "file_no", "shard_count"}
q = Q.quoted

_KINDS = " UNION ALL ".join(f"SELECT archive_id, seq, '{kind}' AS kind, {q(label)} AS label, {Q._hits(words)} AS n FROM m" for kind, t in (("emotion", L.EMOTIONS), ("archetype", L.ARCHETYPES), ("topic", L.TOPICS)) for label, words in t.items())
Q.rows("keyword_match_counts", A.match_counts, "archive_id seq kind label n", f";;SELECT * FROM ({_KINDS}) WHERE n > 0")


def compact(c: str) -> str:
    out = f"CAST(CAST({c} AS BIGINT) AS VARCHAR)"
    for power, unit, least in ((3, "K", 1000), (6, "M", 999_950), (9, "B", 999_950_000), (12, "T", 999_950_000_000)):
        out = f"CASE WHEN abs({c}) >= {least} THEN regexp_replace(printf('%.1f', round({c} / {10**power}e0, 1)), '\\.0$', '') || '{unit}' ELSE {out} END"
    return out


_BIG = "CAST((seq + 1) * (seq + 1) * (1 + seq % 7) * 13 AS BIGINT)"
Q.column("format_compact", lambda: format_compact((F.col("seq") + 1) * (F.col("seq") + 1) * (1 + F.col("seq") % 7) * 13), compact(_BIG))

_MEMBERS = """, c0 AS (SELECT archive_id, count(*) AS n FROM m GROUP BY 1), ck AS (SELECT archive_id, unnest(range(0, CASE WHEN n <= 120 THEN 1 ELSE CAST(ceil((n - 120) / 105.0) AS BIGINT) + 1 END)) AS k FROM c0)"""
_IN = _MEMBERS + ", cx AS (SELECT a.*, k + 1 AS chunk_no, printf('msg_%07d', seq + 1) AS message_id FROM a JOIN ck ON a.archive_id = ck.archive_id AND a.seq >= 105 * k AND a.seq < 105 * k + 120)"
Q.rows("chunk_hashes", K.chunk_hashes, "archive_id chunk_no n chunk_hash message_ids", _MEMBERS + """, cx AS (SELECT m.*, k + 1 AS chunk_no, printf('msg_%07d', seq + 1) AS message_id FROM m JOIN ck ON m.archive_id = ck.archive_id AND m.seq >= 105 * k AND m.seq < 105 * k + 120);;
SELECT archive_id, chunk_no, count(*) AS n, sha256('[' || string_agg('{"message_id":"' || message_id || '","text":' || to_json(normalized_text) || '}', ',' ORDER BY seq) || ']') AS chunk_hash, string_agg(message_id, ',' ORDER BY seq) AS message_ids FROM cx GROUP BY archive_id, chunk_no""")  # fmt: skip


def _dense(name: str, labels: list[str], counted: str) -> str:
    rows = ", ".join(f"({i}, {q(x)})" for i, x in enumerate(labels))
    return f""",
{name} AS (SELECT archive_id, chunk_no, string_agg(label, ',' ORDER BY r) AS tops FROM (SELECT b.archive_id, b.chunk_no, v.label, row_number() OVER (PARTITION BY b.archive_id, b.chunk_no ORDER BY coalesce(n, 0) DESC, v.i) AS r
  FROM (SELECT DISTINCT archive_id, chunk_no FROM cx) b CROSS JOIN (VALUES {rows}) v(i, label) LEFT JOIN (SELECT archive_id, chunk_no, label, count(*) AS n FROM ({counted}) GROUP BY ALL) c ON c.archive_id = b.archive_id AND c.chunk_no = b.chunk_no AND c.label = v.label) WHERE r <= 3 GROUP BY ALL)"""


_PICKS = lambda name, source, where, order, k: f", {name} AS (SELECT archive_id, chunk_no, string_agg(message_id, ',' ORDER BY r) AS ids FROM (SELECT archive_id, chunk_no, message_id, row_number() OVER (PARTITION BY archive_id, chunk_no ORDER BY {order}) AS r FROM {source} WHERE {where}) WHERE r <= {k} GROUP BY ALL)"
Q.rows("chunk_annotations", K.chunk_annotations, "archive_id chunk_no emotions topics archetypes highlights milestones turns summary", _IN + _dense("de", K.CHUNK_EMOTIONS, "SELECT archive_id, chunk_no, emotion_label AS label FROM cx") + _dense("dt", list(L.TOPICS), "SELECT archive_id, chunk_no, unnest(topic_tags) AS label FROM cx") + _dense("da", list(L.ARCHETYPES), "SELECT archive_id, chunk_no, unnest(archetype_tags) AS label FROM cx") + """,
cl AS (SELECT *, lag(emotion_label) OVER w AS pe, lag(importance_score) OVER w AS pi FROM cx WINDOW w AS (PARTITION BY archive_id, chunk_no ORDER BY seq))""" + _PICKS("ph", "cx", "highlight_candidate", "importance_score DESC, seq", 5) + _PICKS("pm", "cx", "milestone_candidate", "importance_score DESC, seq", 4) + _PICKS("pt", "cl", "pe <> emotion_label AND (importance_score >= 0.7 OR pi >= 0.7)", "seq", 5) + """;;
SELECT de.archive_id, de.chunk_no, de.tops AS emotions, dt.tops AS topics, da.tops AS archetypes, coalesce(ph.ids, '') AS highlights, coalesce(pm.ids, '') AS milestones, coalesce(pt.ids, '') AS turns,
printf('Chunk chunk_%05d leaned ', de.chunk_no) || split_part(de.tops, ',', 1) || ' with ' || split_part(da.tops, ',', 1) || ' exchanges and ' || split_part(dt.tops, ',', 1) || ' themes.' AS summary
FROM de JOIN dt USING (archive_id, chunk_no) JOIN da USING (archive_id, chunk_no) LEFT JOIN ph USING (archive_id, chunk_no) LEFT JOIN pm USING (archive_id, chunk_no) LEFT JOIN pt USING (archive_id, chunk_no)""", 1)  # fmt: skip


def _observed(a):
    """Observations as an annotator would give them that trusts chunks of even number less, and calls them neutral."""
    o = K.in_chunks(a.select("archive_id", "seq", "emotion_label", *K.MEANS, *K.FLAGS, *K.TAGS))
    even = F.col("chunk_no") % 2 == 0
    return o.withColumn("importance_score", F.when(even, F.col("importance_score") * 0.875).otherwise(F.col("importance_score"))).withColumn("emotion_label", F.when(even, "neutral").otherwise(F.col("emotion_label")))


Q.rows("merge_annotations", lambda a: K.merge_annotations(_observed(a)).withColumns({"chunks": F.array_join("chunks", ","), "topics": F.array_join("topic_tags", ","), "archetypes": F.array_join("archetype_tags", ",")}), "archive_id seq emotion_label emotion_intensity importance_score evidence_score topics archetypes chunks highlight_candidate", _IN + """,
ob AS (SELECT * REPLACE (CASE WHEN chunk_no % 2 = 0 THEN importance_score * 0.875e0 ELSE importance_score END AS importance_score, CASE WHEN chunk_no % 2 = 0 THEN 'neutral' ELSE emotion_label END AS emotion_label), row_number() OVER (PARTITION BY archive_id, seq ORDER BY chunk_no) AS o FROM cx),
ot AS (SELECT x.*, y.chunk_no AS c2, y.emotion_label AS e2, y.importance_score AS i2, floor((x.importance_score * 1e0 + y.importance_score) / 2e0 * 10000e0 + 0.5e0) / 10000e0 AS im, floor((x.emotion_intensity * 1e0 + y.emotion_intensity) / 2e0 * 10000e0 + 0.5e0) / 10000e0 AS em, floor((x.evidence_score * 1e0 + y.evidence_score) / 2e0 * 10000e0 + 0.5e0) / 10000e0 AS ev
  FROM ob x LEFT JOIN ob y ON y.archive_id = x.archive_id AND y.seq = x.seq AND y.o = 2 WHERE x.o = 1);;
SELECT archive_id, seq, CASE WHEN i2 >= im THEN e2 ELSE emotion_label END AS emotion_label, coalesce(em, emotion_intensity) AS emotion_intensity, coalesce(im, importance_score) AS importance_score, coalesce(ev, evidence_score) AS evidence_score,
array_to_string(topic_tags, ',') AS topics, array_to_string(archetype_tags, ',') AS archetypes, CAST(chunk_no AS VARCHAR) || coalesce(',' || c2, '') AS chunks, highlight_candidate FROM ot""", 1)  # fmt: skip

_LEAD = Q.ORACLES["participant_overview"]
_HEAD, _TAIL = _LEAD[_LEAD.index(", o AS (") :].split("\nSELECT CAST(archive_id", 1)
_PO = _HEAD + ", po AS (" + _TAIL.split(" FROM (", 1)[1].rsplit(")", 1)[0].strip() + ")"
_MEASURES = " UNION ALL ".join(f"SELECT archive_id, sender_id, '{k}' AS measure, CAST({c} AS DOUBLE) AS value, CAST({c} AS DOUBLE) * {1 if least else -1} AS o FROM po" for k, c, least in X.LEADERS)
_LEADERS = _PO + f""", sn AS (SELECT archive_id, sender_id, min(seq) AS seen FROM act WHERE sender_id IS NOT NULL GROUP BY ALL),
ld AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.archive_id, measure ORDER BY e.o, seen) AS r FROM ({_MEASURES}) e JOIN sn USING (archive_id, sender_id)) WHERE r = 1)"""
Q.rows("participant_leaders", X.participant_leaders, "archive_id measure sender_id value", _LEADERS + ";;SELECT * FROM ld")
_LATE = "hour_of_day IN (22, 23, 0, 1, 2, 3, 4)"
_SUPPORT = ", su AS (SELECT archive_id, kind, who, string_agg(printf('msg_%07d', seq + 1), ',' ORDER BY seq) AS ids FROM (SELECT archive_id, kind, who, seq, row_number() OVER (PARTITION BY archive_id, kind, who ORDER BY seq) AS r FROM (" + " UNION ALL ".join(
    f"SELECT archive_id, seq, '{k}' AS kind, {who} AS who FROM act WHERE {w}" for k, who, w in (
        ("all", "sender_id", "sender_id IS NOT NULL"), ("emoji", "sender_id", "sender_id IS NOT NULL AND emoji_count > 0"), ("late", "sender_id", f"sender_id IS NOT NULL AND {_LATE}"), ("link", "sender_id", "sender_id IS NOT NULL AND has_url"),
        ("multiline", "sender_id", "sender_id IS NOT NULL AND is_multiline"), ("weekend", "sender_id", "sender_id IS NOT NULL AND weekday IN (0, 6)"), ("month", "month_key", "true"), ("week", "week_key", "true"), ("any", "'*'", "true"), ("night", "'*'", _LATE))
) + ")) WHERE r <= 3 GROUP BY ALL)"


def tenths(c: str) -> str:
    t = f"CAST(floor({c} * 10e0 + 0.5e0) AS BIGINT)"
    return f"({t} // 10 || '.' || {t} % 10)"


_TEXT = {"average_reply_gap": f"{tenths('value')} || ' min'", "chars_per_message": f"{tenths('value')} || ' chars/msg'", "late_night_percentage": f"{tenths('value')} || '%'", "weekend_percentage": f"{tenths('value')} || '%'"}
_VALUE = "CASE measure " + " ".join(f"WHEN '{k}' THEN {_TEXT[c]}" for k, c, _ in X.LEADERS if c in _TEXT) + f" ELSE {compact('value')} END"
_NAMED = {"most_active_month": "most_active_month", "most_intense_week": "most_intense_week", "support_month": "highest_support_stretch", "repair_month": "strongest_repair_stretch"}
_GRID = ", ".join(f"({i}, {q(k)}, {q(label)}, {q(d) if d else 'NULL'}, {q(route)}, {q(kind)})" for i, (k, label, d, route, kind) in enumerate(X.RECORDS))


from threadlake.plans import records as R  # noqa: E402

_BAL = Q._SPLIT + f""",
b1 AS (SELECT archive_id, month_key, max(n) AS hi, min(n) AS lo, any_value(total_messages) AS total_messages FROM sp GROUP BY ALL),
b2 AS (SELECT *, greatest({R.FLOORS["balanced"]}, floor(avg(total_messages) OVER (PARTITION BY archive_id) * 0.35e0 + 0.5e0)) AS least FROM b1),
b3 AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY (hi - lo) / CAST(greatest(hi, 1) AS DOUBLE), total_messages DESC, month_key) AS r FROM b2 WHERE total_messages >= least),
w1 AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS second FROM sp WINDOW w AS (PARTITION BY archive_id, month_key ORDER BY n DESC, sender_id)),
w2 AS (SELECT archive_id, month_key, sender_id AS winner, n - coalesce(second, 0) AS margin, total_messages FROM w1 WHERE r = 1 AND n IS DISTINCT FROM second),
w3 AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY margin DESC, total_messages DESC, month_key) AS r FROM w2),
n1 AS (SELECT archive_id, month_key, count(*) AS total_messages, round(sum(CAST({_LATE} AS INT)) / CAST(count(*) AS DOUBLE) * 100, 2) AS share FROM act GROUP BY archive_id, month_key),
n2 AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY share DESC, total_messages DESC, month_key) AS r FROM n1 WHERE total_messages >= {R.FLOORS["night"]})"""
_FOUND = f""", fo AS (
SELECT ld.archive_id, measure AS record_id, ld.sender_id || ' - ' || {_VALUE} AS value, CASE WHEN measure = 'who_sent_more' THEN {tenths("message_share")} || '% of the archive' END AS own, ld.sender_id AS winner, ld.sender_id AS who FROM ld JOIN po ON po.archive_id = ld.archive_id AND po.sender_id = ld.sender_id
UNION ALL SELECT archive_id, CASE kind {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _NAMED.items())} END, period || ' - ' || {compact("value")}, NULL, NULL, period FROM ({_PERIODS}) WHERE r = 1
UNION ALL SELECT archive_id, 'most_balanced_month', month_key || ' - ' || {compact("total_messages")}, NULL, NULL, month_key FROM b3 WHERE r = 1
UNION ALL SELECT archive_id, 'biggest_monthly_takeover', month_key || ' - ' || winner, {compact("margin")} || ' message lead', winner, month_key FROM w3 WHERE r = 1
UNION ALL SELECT archive_id, 'most_night_owl_month', month_key || ' - ' || {tenths("share")} || '%', NULL, NULL, month_key FROM n2 WHERE r = 1)"""
Q.rows("detective_records", X.detective_records, "archive_id place record_id label value detail winner route ids", _LEADERS.replace(", pe AS (", ", pe AS (") + _BAL + _SUPPORT + _FOUND + f""";;
SELECT gr.archive_id, v.place, v.record_id, v.label, coalesce(value, 'N/A') AS value, CASE WHEN value IS NULL AND v.record_id = 'who_sent_more' THEN 'No data' WHEN value IS NULL AND v.record_id = 'most_balanced_month' THEN 'No balanced month found' WHEN value IS NULL AND v.record_id = 'biggest_monthly_takeover' THEN 'No clear monthly winner' ELSE coalesce(own, told) END AS detail,
winner, route, coalesce(ids, '') AS ids FROM (SELECT DISTINCT archive_id FROM act) gr CROSS JOIN (VALUES {_GRID}) v(place, record_id, label, told, route, kind) LEFT JOIN fo ON fo.archive_id = gr.archive_id AND fo.record_id = v.record_id LEFT JOIN su ON su.archive_id = gr.archive_id AND su.kind = v.kind AND su.who = fo.who""", 1)  # fmt: skip
Q.rows("story_spotlights", X.story_spotlights, "archive_id place label value ids", _SUPPORT + f""",
d0 AS (SELECT DISTINCT archive_id, CAST(day_key AS DATE) AS d FROM act), d1 AS (SELECT archive_id, d - CAST(row_number() OVER (PARTITION BY archive_id ORDER BY d) AS INT) AS run FROM d0), d2 AS (SELECT archive_id, max(k) AS streak FROM (SELECT archive_id, run, count(*) AS k FROM d1 GROUP BY ALL) GROUP BY 1),
t0 AS (SELECT archive_id, count(*) AS n, sum(CAST({_LATE} AS INT)) AS late FROM act GROUP BY 1), m9 AS (SELECT archive_id, month_key, count(*) AS top, row_number() OVER (PARTITION BY archive_id ORDER BY count(*) DESC, month_key) AS r FROM act GROUP BY archive_id, month_key),
al AS (SELECT * FROM t0 JOIN d2 USING (archive_id) JOIN m9 USING (archive_id) WHERE r = 1),
rw AS (SELECT archive_id, 1 AS place, 'Messages shared' AS label, {compact("n")} AS value, 'any' AS kind, '*' AS who FROM al UNION ALL SELECT archive_id, 2, 'Longest streak', streak || ' days', 'any', '*' FROM al
UNION ALL SELECT archive_id, 3, 'Most active month', month_key || ' (' || {compact("top")} || ')', 'month', month_key FROM al UNION ALL SELECT archive_id, 4, 'Late-night share', regexp_replace({tenths("(late * 100e0 / n)")}, '\\.0$', '') || '%', 'night', '*' FROM al);;
SELECT rw.archive_id, place, label, value, coalesce(ids, '') AS ids FROM rw LEFT JOIN su USING (archive_id, kind, who)""")  # fmt: skip
shown("month_shard_rows", lambda p, s, g: S.month_rows(p), "archive_id month_key message_id timestamp_local sender_id message_type text technical_session_id narrative_segment_id chapter_id", ";;SELECT *, printf('msg_%07d', seq + 1) AS message_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp_local, printf('tech_%04d', CAST(session_no AS BIGINT)) AS technical_session_id, printf('segment_%04d', segment_no) AS narrative_segment_id, printf('chapter_%03d', chapter_no) AS chapter_id FROM pl")
_FIELD = lambda name, c: f""" CASE WHEN {c} IS NULL THEN '' ELSE ',"{name}":' || to_json({c}) END"""
_FILES = """, f0 AS (SELECT archive_id, month_key, seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, '{' || substr(""" + " || ".join(_FIELD(n, c) for n, c in (
    ("message_id", "printf('msg_%07d', seq + 1)"), ("timestamp_local", "strftime(ts, '%Y-%m-%dT%H:%M:%S')"), ("sender_id", "sender_id"), ("sender_label", "sender_id"), ("message_type", "message_type"), ("text", "text"),
    ("technical_session_id", "printf('tech_%04d', CAST(session_no AS BIGINT))"), ("narrative_segment_id", "printf('segment_%04d', segment_no)"), ("chapter_id", "printf('chapter_%03d', chapter_no)"))) + """, 2) || '}' AS line FROM pl),
f1 AS (SELECT *, strlen(line) + 1 AS size FROM f0),
f2 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY archive_id, month_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 16384 AS file_no FROM f1),
f3 AS (SELECT archive_id, month_key, CAST(file_no AS BIGINT) AS file_no, sum(size) AS bytes, count(*) AS n, arg_min(stamp, seq) AS first_ts, arg_max(stamp, seq) AS last_ts FROM f2 GROUP BY ALL)"""  # fmt: skip
shown("shard_files", lambda p, s, g: H.files_of(H.in_files(p, 1 << 14)), "archive_id month_key shard_id file_no path bytes n first_ts last_ts shard_count file_count total_messages total_bytes", _FILES + """;;
SELECT *, 'messages_' || month_key AS shard_id, 'archive=' || archive_id || '/messages_' || month_key || '/' || printf('%06d', file_no) AS path, count(*) OVER w AS file_count, sum(n) OVER w AS total_messages, sum(bytes) OVER w AS total_bytes,
sum(CASE WHEN file_no = 0 THEN 1 ELSE 0 END) OVER w AS shard_count FROM f3 WINDOW w AS (PARTITION BY archive_id)""")
_SH = ", sh9 AS (SELECT archive_id, session_no, seq, row_number() OVER (PARTITION BY archive_id, session_no ORDER BY importance_score DESC, seq) AS rank FROM a WHERE highlight_candidate)"
Q.rows("session_highlights", N.session_highlights, "archive_id session_no rank seq", _SH + ";;SELECT * FROM sh9 WHERE rank <= 5", 1)
Q.add("session_senders", lambda x: x[1].select("archive_id", F.col("session_no").cast("long").alias("session_no"), F.explode("sender_counts").alias("sender_id", "n")), "SELECT archive_id, CAST(session_no AS BIGINT) AS session_no, sender_id, count(*) AS n FROM a WHERE sender_id IS NOT NULL GROUP BY ALL", 2)
Q.rows("motif_messages", lambda m: N.motif_messages(m, N.phrase_motifs(m)), "archive_id phrase rank seq", f", t AS (SELECT archive_id, seq, {Q._TOKENS} AS t FROM m WHERE message_type = 'text' AND word_count BETWEEN 2 AND 8), u AS (SELECT archive_id, seq, array_to_string(t, ' ') AS phrase FROM t WHERE len(t) BETWEEN 2 AND 8), c AS (SELECT archive_id, phrase, count(*) AS n, min(seq) AS f FROM u GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY n DESC, f) AS p FROM c WHERE n >= 3);;SELECT archive_id, phrase, seq, rank FROM (SELECT u.archive_id, u.phrase, seq, row_number() OVER (PARTITION BY u.archive_id, u.phrase ORDER BY seq) AS rank FROM u SEMI JOIN (SELECT * FROM k WHERE p <= 40) USING (archive_id, phrase)) WHERE rank <= 8")
_BAD = {
    "messages": ("a", {r: w for r, w in (*((f"{c} not null", f"{c} IS NULL") for c in ("message_id", "text", "normalized_text", "has_url", "is_multiline", "technical_session_id", "day_key", "week_key", "month_key")), ("message_type among types", f"coalesce(message_type NOT IN ({', '.join(map(q, S.TYPES))}), true)"), *((f"{c} not negative", f"coalesce({c} < 0, true)") for c in ("char_count", "word_count", "emoji_count")), ("hour_of_day within 0 to 23", "coalesce(hour_of_day NOT BETWEEN 0 AND 23, true)"), ("weekday within 0 to 6", "coalesce(weekday NOT BETWEEN 0 AND 6, true)"))}),
    "annotations": ("a", {"emotion_label among labels": f"coalesce(emotion_label NOT IN ({', '.join(map(q, K.CHUNK_EMOTIONS))}), true)", **{f"{c} within 0 to 1": f"coalesce({c} NOT BETWEEN 0 AND 1, true)" for c in ("emotion_intensity", "importance_score", "evidence_score")},
                          "topic_tags some, among labels": f"len(topic_tags) < 1 OR len(list_filter(topic_tags, lambda x: x NOT IN ({', '.join(map(q, L.TOPICS))}))) > 0", "archetype_tags some, among labels": f"len(archetype_tags) < 1 OR len(list_filter(archetype_tags, lambda x: x NOT IN ({', '.join(map(q, L.ARCHETYPES))}))) > 0", **{f"{c} not null": f"{c} IS NULL" for c in ("highlight_candidate", "milestone_candidate", "support_signal", "conflict_signal", "repair_signal")}}),
    "sessions": ("s", {"message_count positive": "coalesce(message_count < 1, true)", "mean_importance within 0 to 1": "coalesce(mean_importance NOT BETWEEN 0 AND 1, true)", "density not negative": "coalesce(density < 0, true)"}),
}
_CHECKS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {q(r)} AS rule, count(*) AS checked, coalesce(sum(CAST({w} AS INT)), 0) AS violations FROM (SELECT *, 'x' AS message_id, 'x' AS technical_session_id FROM {src})" for t, (src, rules) in _BAD.items() for r, w in rules.items())
Q.rows("validate_tables", lambda x: S.validate_table(x[0], "messages").unionByName(S.validate_table(x[0], "annotations")).unionByName(S.validate_table(x[1], "sessions")), "table_name rule checked violations", f";;{_CHECKS}", 2)
_STORED = "provider string, version string, chunk_hash string, archive_id bigint, seq bigint, chunk_no bigint, emotion_label string, importance_score double"


def _incremental(m):
    """Annotations from a store that was filled with an earlier state of the archives first, and then with what was new."""
    path = I.shared_folder(m.sparkSession)
    I.annotate_into(m.where("seq < 500"), path, _STORED)
    I.annotate_into(m, path, _STORED)
    return I.stored_annotations(m, path, _STORED)


Q.rows("incremental_annotate", _incremental, "archive_id seq chunk_no emotion_label importance_score", _IN + ";;SELECT * FROM cx")
Q.ORACLES["incremental_annotate"] = "WITH " + Q.BASE.strip() + Q.ANNOTATED + _IN + "\nSELECT archive_id, seq, chunk_no, emotion_label, importance_score FROM cx"
