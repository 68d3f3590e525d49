"""Registered queries of what is shown: cleaned texts, scores, greedy selections, titles, lenses and previews, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import display as D
from threadlake.functions import labels as L
from threadlake.operators import curation as C
from threadlake.operators import narrative as N
from threadlake.operators import records as X
from threadlake.plans import queries as Q
from threadlake.plans.structure import _CHAPTERS
from threadlake.sources.store import written

Q._COUNTS |= {"place", "occurrence", "weight", "first_rank", "broadcast", "relational", "career_hits", "mojibake"}
q = Q.quoted


def clean(c: str) -> str:
    for a, b in D.SHOWN:
        c = f"replace({c}, {q(a)}, {q(b)})"
    return f"""trim(regexp_replace(regexp_replace({c}, '[{L.SPACES}]+', ' ', 'g'), '^"+|"+$', '', 'g'))"""


def cut(c: str, n: int) -> str:
    head = f"substr({c}, 1, {n})"
    at = f"greatest(CASE WHEN strpos(reverse({head}), ' ') > 0 THEN {n} - strpos(reverse({head}), ' ') ELSE -1 END, {n - 18})"
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE trim(substr({head}, 1, {at})) || '...' END"


def hits(c: str, patterns: list[str]) -> str:
    if patterns is D.MOJIBAKE:
        return "(" + " + ".join(f"CAST(contains({c}, {q(p)}) AS INT)" for p in patterns) + ")"
    return "(" + " + ".join(f"CAST(regexp_matches({c}, {q('(?i)' + p)}) AS INT)" for p in patterns) + ")"


def judged(source: str, name: str, text: str = "text") -> str:
    """CTEs: source with clean, career, close, words and low."""
    return f""",
{name}0 AS (SELECT *, {clean(text)} AS clean FROM {source}),
{name}1 AS (SELECT *, {hits("clean", D.BROADCAST)} AS broadcast, {hits("clean", D.RELATIONAL)} AS close, {hits("clean", D.CAREER)} > 0 AS career, {hits("clean", D.MOJIBAKE)} AS broken, len(list_filter(string_split(clean, ' '), lambda x: x <> '')) AS words,
  len(regexp_extract_all(clean, '[:;]')) AS marks, len(regexp_extract_all(clean, '\\b-[{L.SPACES}]')) AS dashes, regexp_matches(clean, 'https?://') AS link, len(regexp_extract_all(clean, '[!?]')) AS cries FROM {name}0),
{name} AS (SELECT *, broadcast >= 2 OR (broadcast >= 1 AND close = 0 AND NOT career) OR (words > 60 AND close < 2 AND NOT career) OR (words > 100 AND close < 3) OR ((marks >= 4 OR dashes >= 3) AND close < 2)
  OR (broken >= 4 AND words > 35) OR (link AND close = 0) OR (cries > 10 AND words > 50 AND close < 2) AS low FROM {name}1)"""


def gain(cond: str, v: float) -> str:
    return f" + CASE WHEN {cond} THEN {float(v)}e0 ELSE 0e0 END"


PLACED = _CHAPTERS + """,
pl AS (SELECT a.*, w.segment_no, ch.chapter_no FROM a LEFT JOIN seg w ON a.archive_id = w.archive_id AND a.session_no = w.session_no LEFT JOIN ch ON ch.archive_id = w.archive_id AND ch.segment_no = w.segment_no)"""
HIGH = """,
hl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY importance_score DESC, seq) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY archive_id, normalized_text ORDER BY importance_score DESC, seq) AS r FROM pl WHERE message_type = 'text' AND highlight_candidate) WHERE r = 1) WHERE rank <= 60)"""
RATED_HIGH = judged("hl", "hj") + f""",
hq AS (SELECT *, importance_score * 100e0{gain("low", -80)}{"".join(gain(f"list_contains(archetype_tags, {q(t)})", v) for t, v in D.TAG_POINTS.items())}{"".join(gain(f"emotion_label = {q(t)}", v) for t, v in D.MOOD_POINTS.items())}
  {gain("length(clean) BETWEEN 25 AND 160", 20)}{gain("words > 35", -25)}{gain("length(clean) > 200", -30)}{gain("words < 4", -20)} AS quality FROM hj)"""
_TITLED = "upper(substr({0}, 1, 1)) || substr({0}, 2)"


def title_case(c: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split_regex({c}, '[_\\-{L.SPACES}]+'), lambda x: x <> ''), lambda x: {_TITLED.format('x')}), ' ')"


_KIND = "CASE WHEN repair_signal THEN 'repair' WHEN conflict_signal THEN 'conflict' WHEN support_signal THEN 'support' WHEN list_contains(archetype_tags, 'affection') THEN 'affection' WHEN list_contains(archetype_tags, 'future_imagining') THEN 'future' ELSE 'turning_point' END"
STONES = f""",
ml0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY importance_score DESC, seq) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY archive_id, segment_no ORDER BY importance_score DESC, seq) AS r, {_KIND} AS milestone_type FROM pl WHERE message_type = 'text' AND milestone_candidate) WHERE r = 1) WHERE rank <= 24),
ml1 AS (SELECT *, printf('milestone_%04d', rank) AS milestone_id, CASE milestone_type {" ".join(f"WHEN {q(k)} THEN {q(t)}" for k, t in N.MILESTONE_TITLES.items())} END AS title FROM ml0),
ml AS (SELECT *, title || ' around ' || strftime(ts, '%b %-d, %Y') || ' with ' || emotion_label || ' tone and ' || {title_case("archetype_tags[1]")} || ' energy.' AS summary FROM ml1)"""
_M = lambda p: f"regexp_matches(told, {q('(?i)' + p)})"
RATED_STONES = judged("ml", "mj") + f""",
mt AS (SELECT *, lower({clean("title || ' ' || summary || ' ' || text")}) AS told FROM mj),
mu AS (SELECT *, CASE WHEN {_M(D.BIRTHDAY)} THEN 'Birthday Love Note' WHEN {hits("told", D.CAREER)} > 0 THEN 'Career Step' WHEN {_M(D.FUTURE)} THEN 'Future on the Line' WHEN {_M(D.APOLOGY)} AND milestone_type = 'repair' THEN 'Repair Attempt'
  WHEN {_M(D.CHEER)} THEN 'Cheering From The Sidelines' WHEN {_M(D.AWAY)} THEN 'Pulling Away' {" ".join(f"WHEN milestone_type = {q(k)} THEN {q(t)}" for k, t in D.TYPE_TITLES.items())} ELSE {clean("title")} END AS display_title, {clean("summary")} AS clean_summary FROM mt),
mq AS (SELECT *, CASE {" ".join(f"WHEN display_title IN ({', '.join(map(q, t))}) THEN {q(w)} || strftime(ts, '%b %-d, %Y') || '.'" for t, w in D.TOLD)} ELSE {cut("clean_summary", 130)} END AS short_summary,
  CASE WHEN clean <> '' AND (NOT low OR career) AND words <= 26 AND (close > 0 OR regexp_matches(clean, {q("(?i)" + D.PRAISE)})) THEN {cut("clean", 96)} END AS display_quote,
  importance_score * 100e0{gain("milestone_type IN ('repair', 'support')", 18)}{gain("milestone_type IN ('affection', 'future')", 12)}{gain("career", 16)}{gain("low AND NOT career", -70)} AS quality FROM mu)"""


def fold(name: str, rows: str, limit: int, counts: dict[str, int], keys: str = "archive_id", free: str = "false") -> str:
    """A recursive CTE `name` (keys, rank, place) of the rows of `rows` (keys, rank from 1) that a greedy walk takes."""
    ks = keys.split(", ")
    at = " AND ".join(f"g.{k} = x.{k}" for k in ks)
    lists = "".join(f", CAST([] AS VARCHAR[]) AS l_{c}" for c in counts)
    fits = " AND ".join(f"len(list_filter(l_{c}, lambda y: y = x.{c})) < {n}" for c, n in counts.items())
    ok = f"(len(kept) < {limit} AND ({free} OR ({fits})))"
    more = "".join(f", CASE WHEN {ok} AND x.{c} IS NOT NULL THEN list_append(l_{c}, x.{c}) ELSE l_{c} END" for c in counts)
    return f""",
{name}_f AS (SELECT {keys}, CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS kept{lists} FROM (SELECT DISTINCT {keys} FROM {rows})
  UNION ALL SELECT {", ".join("g." + k for k in ks)}, g.rank + 1, CASE WHEN {ok} THEN list_append(kept, g.rank + 1) ELSE kept END{more} FROM {name}_f g JOIN {rows} x ON {at} AND x.rank = g.rank + 1),
{name} AS (SELECT {keys}, unnest(kept) AS rank, generate_subscripts(kept, 1) AS place FROM (SELECT {keys}, arg_max(kept, rank) AS kept FROM {name}_f GROUP BY {keys}))"""


def ranked_high(name: str, chars: int, source: str = "hq", keys: str = "archive_id", where: str = "true") -> str:
    return f""",
{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY quality DESC, first_rank) AS rank FROM (SELECT * EXCLUDE (rank, clean), clean AS display_quote, rank AS first_rank, {cut("clean", chars)} AS excerpt, coalesce(CAST(chapter_no AS VARCHAR), 'unassigned') AS c, coalesce(sender_id, 'system') AS s FROM {source} WHERE NOT low AND quality > 20 AND {where}))"""


def ranked_stones(name: str, careers: bool, source: str = "mq", keys: str = "archive_id", where: str = "true") -> str:
    return f""",
{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY quality DESC, first_rank) AS rank FROM (SELECT * EXCLUDE (rank), rank AS first_rank, coalesce(CAST(chapter_no AS VARCHAR), 'unassigned') AS c, lower(trim(display_title)) AS t FROM {source} WHERE (NOT low{" OR career" * careers}) AND quality > 10 AND {where}))"""


def shown(name: str, build, columns: str, sql: str, level: int = 3) -> None:
    """A query over (placed messages, sessions, segments with chapters).

    Annotated messages, sessions' segments and chapters are written once, so that no part of a page derives them again.
    """

    def make(x) -> DataFrame:
        a, s = x
        keep = written if level > 2 else lambda df: df
        seg = keep(N.with_segments(s))
        segments = keep(N.with_chapters(N.segment_summary(seg)))
        where = seg.select("archive_id", "session_no", "segment_no").join(segments.select("archive_id", "segment_no", "chapter_no"), ["archive_id", "segment_no"])
        return build(a.join(where, ["archive_id", "session_no"], "left"), s, segments)

    Q.rows(name, make, columns, PLACED + sql, level)
    Q.ORACLES[name] = Q.ORACLES[name].replace("WITH", "WITH RECURSIVE", 1)


def of_segments(name: str, build, columns: str, sql: str) -> None:
    """The same for a query that reads sessions and segments only, once: nothing is written."""
    shown(name, build, columns, sql, 2)


Q.column("clean_display_text", lambda: D.clean_display_text(F.concat(F.lit('"\xe2€œ '), F.col("text"), F.lit(" \xe2€\xa2 x\t\xe2€™ \xc2\xb7\""))), clean("'\"\xe2€œ ' || text || ' \xe2€\xa2 x\t\xe2€™ \xc2\xb7\"'"))
Q.add("build_excerpt", lambda m: m.select("archive_id", "seq", D.build_excerpt(F.col("text"), 38).alias("chip"), D.build_excerpt(F.col("text"), 160).alias("excerpt")), f", c AS (SELECT archive_id, seq, {clean('text')} AS c FROM m) SELECT archive_id, seq, {cut('c', 38)} AS chip, {cut('c', 160)} AS excerpt FROM c")
Q.rows("pattern_hits", lambda m: m.withColumn("c", D.clean_display_text(F.col("text"))).select("archive_id", "seq", *(D.pattern_hits(F.col("c"), p).alias(n) for n, p in (("broadcast", D.BROADCAST), ("relational", D.RELATIONAL), ("career_hits", D.CAREER), ("mojibake", D.MOJIBAKE)))), "archive_id seq broadcast relational career_hits mojibake",
       f", c AS (SELECT archive_id, seq, {clean('text')} AS c FROM m);;SELECT archive_id, seq, {hits('c', D.BROADCAST)} AS broadcast, {hits('c', D.RELATIONAL)} AS relational, {hits('c', D.CAREER)} AS career_hits, {hits('c', D.MOJIBAKE)} AS mojibake FROM c")
Q.rows("is_low_value_text", lambda m: m.select("archive_id", "seq", D.is_low_value_text(F.col("text")).alias("low")), "archive_id seq low", judged("m", "j") + ";;SELECT * FROM j")
shown("highlight_quality", lambda p, s, g: C.rated_highlights(N.highlights(p)).withColumnRenamed("low_value", "low"), "archive_id rank seq segment_no chapter_no display_quote low quality", HIGH + RATED_HIGH + ";;SELECT * EXCLUDE (clean), clean AS display_quote FROM hq")
shown("milestone_display", lambda p, s, g: C.rated_milestones(N.milestones(p)).withColumnRenamed("low_value", "low"), "archive_id rank milestone_id seq segment_no chapter_no milestone_type title summary display_title short_summary display_quote quality low", STONES + RATED_STONES + ";;SELECT * FROM mq")
shown("diverse_highlights", lambda p, s, g: C.diverse_highlights(N.highlights(p)), "archive_id place seq chapter_no emotion_label", HIGH + """,
dv AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY score DESC, first_rank) AS rank FROM (SELECT * EXCLUDE (rank), rank AS first_rank, CAST(chapter_no AS VARCHAR) AS c, emotion_label AS e, importance_score + CASE WHEN emotion_label IN ('romantic', 'funny', 'supportive') THEN 0.3e0 ELSE 0e0 END AS score FROM hl WHERE importance_score > 0.65 AND length(text) BETWEEN 10 AND 250))"""
      + fold("dk", "dv", 6, {"c": 1, "e": 1}, free="len(kept) >= 4") + ";;SELECT dv.*, place FROM dk JOIN dv USING (archive_id, rank)")
shown("curate_highlights", lambda p, s, g: C.curate_highlights(N.highlights(p)), "archive_id place seq excerpt quality", HIGH + RATED_HIGH + ranked_high("hr", 170) + fold("hk", "hr", 12, {"c": 2, "s": 2, "excerpt": 1}) + ";;SELECT hr.*, place FROM hk JOIN hr USING (archive_id, rank)")
shown("curate_milestones", lambda p, s, g: C.curate_milestones(N.milestones(p)), "archive_id place milestone_id display_title short_summary display_quote quality", STONES + RATED_STONES + ranked_stones("mr", False) + fold("mk", "mr", 8, {"c": 2, "t": 1}) + ";;SELECT mr.*, place FROM mk JOIN mr USING (archive_id, rank)")
shown("differentiate_titles", lambda p, s, g: C.differentiate_titles(C.rated_milestones(N.milestones(p))), "archive_id rank display_title", STONES + RATED_STONES + ";;SELECT archive_id, rank, CASE WHEN count(*) OVER (PARTITION BY archive_id, lower(trim(display_title))) >= 2 THEN display_title || ' • ' || strftime(ts, '%b %Y') ELSE display_title END AS display_title FROM mq")
_PICK = lambda titles, others, label, i: "CASE " + " ".join(f"WHEN {label} = {q(k)} THEN [{', '.join(map(q, v))}][({i}) % 3 + 1]" for k, v in titles.items()) + f" ELSE [{', '.join(map(q, others))}][({i}) % 3 + 1] END"
SEGMENTS = f""",
sx AS (SELECT archive_id, segment_no, session_no, unnest(topics) AS t, generate_subscripts(topics, 1) AS p FROM seg), ax AS (SELECT archive_id, segment_no, session_no, unnest(archetypes) AS t, generate_subscripts(archetypes, 1) AS p FROM seg),
stp AS (SELECT archive_id, segment_no, list(t ORDER BY r) AS topics FROM (SELECT archive_id, segment_no, t, row_number() OVER (PARTITION BY archive_id, segment_no ORDER BY count(*) DESC, min(session_no * 100 + p)) AS r FROM sx GROUP BY archive_id, segment_no, t) WHERE r <= 3 GROUP BY ALL),
sap AS (SELECT archive_id, segment_no, list(t ORDER BY r) AS archetypes FROM (SELECT archive_id, segment_no, t, row_number() OVER (PARTITION BY archive_id, segment_no ORDER BY count(*) DESC, min(session_no * 100 + p)) AS r FROM ax GROUP BY archive_id, segment_no, t) WHERE r <= 3 GROUP BY ALL),
sl AS (SELECT ch.archive_id, ch.segment_no, ch.chapter_no, ch.message_count, ch.dominant_emotion, topics, archetypes, {_PICK(N.SEGMENT_TITLES, N.OTHER_SEGMENTS, "archetypes[1]", "ch.segment_no - 1")} AS title,
  list_contains(archetypes, 'repair_reconnection') OR list_contains(archetypes, 'future_imagining') OR ch.dominant_emotion = 'conflict' AS turning_point,
  {_TITLED.format("ch.dominant_emotion")} || ' energy with ' || {title_case("archetypes[1]")} || ' moments and ' || {title_case("topics[1]")} || ' themes.' AS summary FROM ch JOIN stp USING (archive_id, segment_no) JOIN sap USING (archive_id, segment_no)),
sh AS (SELECT archive_id, session_no, seq, text, row_number() OVER (PARTITION BY archive_id, session_no ORDER BY importance_score DESC, seq) AS own FROM a WHERE highlight_candidate),
fh AS (SELECT archive_id, segment_no, seq, text, row_number() OVER (PARTITION BY archive_id, segment_no ORDER BY session_no, own) AS rank FROM sh JOIN seg USING (archive_id, session_no) WHERE own <= 5)"""


def _segments(p, s, g):
    return N.with_quotes(g, N.segment_highlights(N.with_segments(s), p.drop("segment_no", "chapter_no")), p)


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in ("topics", "archetypes")})


shown("segment_annotations", lambda p, s, g: _joined(_segments(p, s, g)), "archive_id segment_no title summary topics archetypes turning_point", SEGMENTS + """;;
SELECT sl.* REPLACE (array_to_string(topics, ',') AS topics, array_to_string(archetypes, ',') AS archetypes, summary || CASE WHEN coalesce(fh.text, '') <> '' THEN ' Representative line: "' || substr(fh.text, 1, 120) || '"' ELSE '' END AS summary) FROM sl LEFT JOIN fh ON fh.archive_id = sl.archive_id AND fh.segment_no = sl.segment_no AND rank = 1""")  # fmt: skip
shown("segment_highlights", lambda p, s, g: N.segment_highlights(N.with_segments(s), p.drop("segment_no", "chapter_no")), "archive_id segment_no rank seq", SEGMENTS + ";;SELECT * FROM fh WHERE rank <= 8")
CHAPTER_TEXT = SEGMENTS + f""",
cm AS (SELECT archive_id, chapter_no, dominant_emotion, row_number() OVER (PARTITION BY archive_id, chapter_no ORDER BY count(*) DESC, min(segment_no)) AS r FROM sl GROUP BY archive_id, chapter_no, dominant_emotion),
ct AS (SELECT archive_id, chapter_no, list(t ORDER BY o)[1:3] AS topics FROM (SELECT archive_id, chapter_no, t, min(segment_no * 10 + p) AS o FROM (SELECT archive_id, chapter_no, segment_no, unnest(topics) AS t, generate_subscripts(topics, 1) AS p FROM sl) GROUP BY ALL) GROUP BY ALL),
ca AS (SELECT archive_id, chapter_no, list(t ORDER BY o)[1:3] AS archetypes FROM (SELECT archive_id, chapter_no, t, min(segment_no * 10 + p) AS o FROM (SELECT archive_id, chapter_no, segment_no, unnest(archetypes) AS t, generate_subscripts(archetypes, 1) AS p FROM sl) GROUP BY ALL) GROUP BY ALL),
cc AS (SELECT archive_id, chapter_no, dominant_emotion, topics, archetypes, printf('chapter_%03d', chapter_no) AS chapter_id, {_PICK(N.CHAPTER_TITLES, N.OTHER_CHAPTERS, "archetypes[1]", "chapter_no - 1")} AS title FROM cm JOIN ct USING (archive_id, chapter_no) JOIN ca USING (archive_id, chapter_no) WHERE r = 1),
cd AS (SELECT *, printf('chapter-%02d-', chapter_no) || substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug, title || ' leans ' || dominant_emotion || ' with ' || {title_case("archetypes[1]")} || ' and ' || {title_case("topics[1]")} || ' shaping the phase.' AS summary,
  row_number() OVER (PARTITION BY archive_id, title ORDER BY chapter_no) AS occurrence FROM cc),
ce AS (SELECT *, CASE WHEN occurrence > 1 THEN title || ': ' || [{", ".join(map(q, C.SUFFIXES))}][least(occurrence - 1, {len(C.SUFFIXES)})] ELSE title END AS display_title FROM cd)"""
_WORDS = lambda label, table: f"CASE {label} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE replace({label}, '_', ' ') END"
_chapters = lambda p, s, g: C.decorate_titles(N.chapter_summary(g), "chapter_no")
of_segments("chapter_texts", lambda p, s, g: _joined(_chapters(p, s, g)), "archive_id chapter_no chapter_id dominant_emotion topics archetypes title slug summary", CHAPTER_TEXT + ";;SELECT * REPLACE (array_to_string(topics, ',') AS topics, array_to_string(archetypes, ',') AS archetypes) FROM ce")
of_segments("decorate_repeated_titles", _chapters, "archive_id chapter_no display_title occurrence", CHAPTER_TEXT + ";;SELECT * FROM ce")
of_segments("chapter_tones", lambda p, s, g: _chapters(p, s, g).withColumn("archetype", F.coalesce(F.get("archetypes", 0), F.lit("everyday_life"))), "archive_id chapter_no title dominant_emotion archetype", CHAPTER_TEXT + ";;SELECT *, archetypes[1] AS archetype FROM ce")
_LINE = f"CASE WHEN len(archetypes) = 1 THEN 'A ' || {_WORDS('dominant_emotion', C.EMOTION_WORDS)} || ' stretch carried by ' || {_WORDS('archetypes[1]', C.ARCHETYPE_WORDS)} || '.' ELSE 'A ' || {_WORDS('dominant_emotion', C.EMOTION_WORDS)} || ' stretch full of ' || {_WORDS('archetypes[1]', C.ARCHETYPE_WORDS)} || ' and ' || {_WORDS('archetypes[2]', C.ARCHETYPE_WORDS)} || '.' END"
of_segments("summarize_chapter", lambda p, s, g: C.summarize_chapters(_chapters(p, s, g)), "archive_id chapter_no line", CHAPTER_TEXT + f";;SELECT archive_id, chapter_no, CASE {' '.join(f'WHEN contains(lower(display_title), {q(a)}) THEN CASE WHEN occurrence > 1 THEN {q(c)} ELSE {q(b)} END' for a, b, c in C.CHAPTER_LINES)} ELSE {_LINE} END AS line FROM ce")
shown("homepage", lambda p, s, g: C.homepage(C.diverse_highlights(N.highlights(p)), N.milestones(p), N.chapter_summary(g)), "archive_id kind place item title", CHAPTER_TEXT + HIGH + STONES + """,
dv AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY score DESC, first_rank) AS rank FROM (SELECT * EXCLUDE (rank), rank AS first_rank, CAST(chapter_no AS VARCHAR) AS c, emotion_label AS e, importance_score + CASE WHEN emotion_label IN ('romantic', 'funny', 'supportive') THEN 0.3e0 ELSE 0e0 END AS score FROM hl WHERE importance_score > 0.65 AND length(text) BETWEEN 10 AND 250))"""
      + fold("dk", "dv", 6, {"c": 1, "e": 1}, free="len(kept) >= 4") + """;;SELECT archive_id, 'highlight' AS kind, place, printf('msg_%07d', seq + 1) AS item, text AS title FROM dk JOIN dv USING (archive_id, rank)
UNION ALL SELECT archive_id, 'milestone', rank, milestone_id, title FROM ml WHERE rank <= 4 UNION ALL SELECT archive_id, 'chapter', chapter_no, chapter_id, title FROM ce WHERE chapter_no <= 5""")  # fmt: skip
for _name, _build, _rows, _from, _k in (("chapter_milestones", N.milestones, STONES, "ml", 4), ("chapter_highlights", N.highlights, HIGH, "hl", 6)):
    _sql = f"{_rows};;SELECT * FROM (SELECT archive_id, chapter_no, seq, row_number() OVER (PARTITION BY archive_id, chapter_no ORDER BY rank) AS rank FROM {_from} WHERE chapter_no IS NOT NULL) WHERE rank <= {_k}"
    shown(_name, lambda p, s, g, b=_build, k=_k: C.previews(b(p), k), "archive_id chapter_no rank seq", _sql)
_IDS = lambda name, source, k: f"(SELECT archive_id, chapter_no, string_agg(printf('{name}_%04d', rank), ',' ORDER BY rank) AS {name}_ids FROM (SELECT archive_id, chapter_no, rank, row_number() OVER (PARTITION BY archive_id, chapter_no ORDER BY rank) AS k FROM {source} WHERE chapter_no IS NOT NULL) WHERE k <= {k} GROUP BY ALL)"
shown("chapter_links", lambda p, s, g: C.chapter_links(N.chapter_summary(g), N.highlights(p), N.milestones(p)), "archive_id chapter_no chapter_id highlight_ids milestone_ids", CHAPTER_TEXT + HIGH + STONES + f""";;
SELECT ce.archive_id, ce.chapter_no, chapter_id, coalesce(highlight_ids, '') AS highlight_ids, coalesce(milestone_ids, '') AS milestone_ids FROM ce LEFT JOIN {_IDS("highlight", "hl", 8)} h ON h.archive_id = ce.archive_id AND h.chapter_no = ce.chapter_no LEFT JOIN {_IDS("milestone", "ml", 5)} t ON t.archive_id = ce.archive_id AND t.chapter_no = ce.chapter_no""")
Q.rows("homepage_intro", C.homepage_intro, "archive_id subtitle time_span", """, hs AS (SELECT archive_id, sender_id, min(seq) AS seen FROM m WHERE sender_id IS NOT NULL GROUP BY ALL), hw AS (SELECT archive_id, string_agg(sender_id, ' and ' ORDER BY seen) AS who FROM hs GROUP BY 1),
ht AS (SELECT archive_id, strftime(arg_min(ts, seq), '%b %Y') || ' to ' || strftime(arg_max(ts, seq), '%b %Y') AS time_span FROM m GROUP BY 1);;
SELECT ht.archive_id, 'A curated journey through ' || coalesce(who, '') || ' across messages, moods, and milestones.' AS subtitle, time_span FROM ht LEFT JOIN hw USING (archive_id)""")
_CLUSTERS = """, tx AS (SELECT archive_id, seq, text, unnest(topic_tags) AS topic, generate_subscripts(topic_tags, 1) AS p FROM a),
tc AS (SELECT archive_id, topic, count(*) AS n, row_number() OVER (PARTITION BY archive_id ORDER BY count(*) DESC, min(seq * 100 + p)) AS first_rank FROM tx GROUP BY archive_id, topic),
tq AS (SELECT * FROM (SELECT archive_id, topic, seq, text, row_number() OVER (PARTITION BY archive_id, topic ORDER BY seq) AS rank FROM tx) WHERE rank <= 8),
tf AS (SELECT archive_id, topic, string_agg(text, ' ' ORDER BY rank) AS said FROM tq WHERE rank <= 5 GROUP BY ALL)""" + judged("tf", "tj", "said") + """,
ts AS (SELECT * FROM (SELECT tc.archive_id, topic, n, row_number() OVER (PARTITION BY tc.archive_id ORDER BY first_rank) AS rank FROM tc JOIN tj USING (archive_id, topic) WHERE n > 20 AND NOT low) WHERE rank <= 6)"""
Q.rows("topic_quotes", N.topic_quotes, "archive_id topic rank seq text", _CLUSTERS + ";;SELECT * FROM tq", 1)
Q.rows("curate_topic_clusters", lambda a: C.topic_page(a, N.topic_clusters(a))[0], "archive_id rank topic n", _CLUSTERS + ";;SELECT * FROM ts", 1)
Q.rows("topic_chips", lambda a: C.topic_page(a, N.topic_clusters(a))[1], "archive_id topic place chip", _CLUSTERS + judged("tq", "tv") + f";;SELECT archive_id, topic, place, {cut('clean', 38)} AS chip FROM (SELECT *, row_number() OVER (PARTITION BY archive_id, topic ORDER BY rank) AS place FROM tv SEMI JOIN ts USING (archive_id, topic) WHERE tv.rank <= 5 AND clean <> '' AND NOT low) WHERE place <= 3", 1)
_GRID = f"SELECT archive_id, unnest([{', '.join(map(q, L.ARCHETYPES))}]) AS archetype FROM (SELECT DISTINCT archive_id FROM a)"
Q.rows("story_lenses", C.story_lenses, "archive_id archetype n share dominant_emotion top_emotions top_topics", f""", lx AS (SELECT archive_id, seq, emotion_label, topic_tags, unnest(archetype_tags) AS archetype FROM a),
le AS (SELECT archive_id, archetype, emotion_label AS label, count(*) AS n, row_number() OVER (PARTITION BY archive_id, archetype ORDER BY count(*) DESC, min(seq)) AS r FROM lx GROUP BY archive_id, archetype, emotion_label),
lt AS (SELECT archive_id, archetype, label, count(*) AS n, row_number() OVER (PARTITION BY archive_id, archetype ORDER BY count(*) DESC, min(seq * 100 + p)) AS r FROM (SELECT archive_id, archetype, seq, unnest(topic_tags) AS label, generate_subscripts(topic_tags, 1) AS p FROM lx) GROUP BY archive_id, archetype, label),
ge AS (SELECT archive_id, archetype, sum(n) AS n, max(label) FILTER (r = 1) AS best, string_agg(label || ':' || n, ',' ORDER BY r) FILTER (r <= 3) AS tops FROM le GROUP BY ALL), gt AS (SELECT archive_id, archetype, string_agg(label || ':' || n, ',' ORDER BY r) FILTER (r <= 4) AS tops FROM lt GROUP BY ALL),
gn AS (SELECT archive_id, count(*) AS total FROM a GROUP BY ALL), gg AS ({_GRID});;
SELECT gg.archive_id, gg.archetype, coalesce(ge.n, 0) AS n, round(coalesce(ge.n, 0) / CAST(total AS DOUBLE), 6) AS share, coalesce(best, 'neutral') AS dominant_emotion, coalesce(ge.tops, '') AS top_emotions, coalesce(gt.tops, '') AS top_topics FROM gg JOIN gn USING (archive_id) LEFT JOIN ge USING (archive_id, archetype) LEFT JOIN gt USING (archive_id, archetype)""", 1)  # fmt: skip
_LENS_H = HIGH + RATED_HIGH + ", hx AS (SELECT *, unnest(archetype_tags) AS archetype FROM hq)" + ranked_high("lr", 150, "hx", "archive_id, archetype") + fold("lk", "lr", 5, {"c": 2, "s": 3, "excerpt": 1}, "archive_id, archetype")
_LENS_M = STONES + RATED_STONES + ", mx AS (SELECT *, unnest(archetype_tags) AS archetype FROM mq)" + ranked_stones("nr", True, "mx", "archive_id, archetype") + fold("nk", "nr", 4, {"c": 2, "t": 2}, "archive_id, archetype")
shown("lens_highlights", lambda p, s, g: C.lens_highlights(N.highlights(p)), "archive_id archetype place seq excerpt", _LENS_H + ";;SELECT lr.*, place FROM lk JOIN lr USING (archive_id, archetype, rank)")
shown("lens_milestones", lambda p, s, g: C.lens_milestones(N.milestones(p)), "archive_id archetype place seq display_title", _LENS_M + ";;SELECT nr.*, place FROM nk JOIN nr USING (archive_id, archetype, rank)")
shown("lens_chapters", lambda p, s, g: C.lens_chapters(C.lens_highlights(N.highlights(p)), C.lens_milestones(N.milestones(p))), "archive_id archetype chapter_no weight", _LENS_H + _LENS_M + ", lw AS (SELECT lr.archive_id, archetype, chapter_no, 1 AS w FROM lk JOIN lr USING (archive_id, archetype, rank) UNION ALL SELECT nr.archive_id, archetype, chapter_no, 2 FROM nk JOIN nr USING (archive_id, archetype, rank));;SELECT archive_id, archetype, chapter_no, sum(w) AS weight FROM lw WHERE chapter_no IS NOT NULL GROUP BY ALL")
from threadlake.plans.records import _HINTED  # noqa: E402

Q.rows("lens_motifs", lambda a: C.lens_motifs(X.hinted_motifs(a)), "archive_id archetype_hint rank phrase n", _HINTED + ";;SELECT * FROM (SELECT archive_id, archetype_hint, phrase, n, row_number() OVER (PARTITION BY archive_id, archetype_hint ORDER BY rank) AS rank FROM h WHERE archetype_hint IS NOT NULL) WHERE rank <= 8", 1)
Q.rows("display_motifs", lambda m: C.display_motifs(N.phrase_motifs(m)), "archive_id rank phrase n", _HINTED.replace("FROM a WHERE", "FROM m WHERE").split(",\nh AS")[0] + ";;SELECT * FROM (SELECT archive_id, phrase, n, row_number() OVER (PARTITION BY archive_id ORDER BY rank) AS rank FROM k WHERE n >= 20 AND len(string_split(phrase, ' ')) <= 5) WHERE rank <= 10")
Q.rows("archetype_share", C.archetype_share, "archive_id rank archetype n share", f", x AS (SELECT archive_id, seq, unnest(archetype_tags) AS archetype, generate_subscripts(archetype_tags, 1) AS p FROM {Q._AACT}), y AS (SELECT archive_id, archetype, count(*) AS n, min(seq * 100 + p) AS f FROM x GROUP BY ALL), z AS (SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY archive_id) AS DOUBLE), 6) AS share, row_number() OVER (PARTITION BY archive_id ORDER BY n DESC, f) AS rank FROM y);;SELECT * FROM z WHERE rank <= 6", 1)
_FIVE = STONES + RATED_STONES + ranked_stones("br", True) + fold("bk", "br", 5, {"c": 2, "t": 1}) + ranked_stones("or_", True, where="chapter_no IS NOT NULL", keys="archive_id, chapter_no")
shown("book_milestones", lambda p, s, g: C.book_milestones(N.milestones(p)), "archive_id chapter_no milestone_id source", _FIVE + """,
bb AS (SELECT archive_id, chapter_no, milestone_id, 0 AS source, row_number() OVER (PARTITION BY archive_id ORDER BY ts, place) AS o FROM bk JOIN br USING (archive_id, rank) UNION ALL SELECT archive_id, chapter_no, milestone_id, 1, 1 FROM or_ WHERE rank = 1);;
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id, chapter_no ORDER BY source, o) AS q FROM bb WHERE chapter_no IS NOT NULL) WHERE q = 1""")  # fmt: skip
shown("book_highlights", lambda p, s, g: C.book_highlights(N.highlights(p)), "archive_id chapter_no seq excerpt", HIGH + RATED_HIGH + ranked_high("bh", 88, keys="archive_id, chapter_no", where="chapter_no IS NOT NULL") + ";;SELECT * FROM bh WHERE rank = 1")
shown("closing_quote", lambda p, s, g: C.closing_quote(N.highlights(p)), "archive_id seq excerpt source", HIGH + RATED_HIGH + ranked_high("w1", 120, where="(emotion_label IN ('romantic', 'supportive') OR list_contains(archetype_tags, 'repair_reconnection'))") + ranked_high("w2", 120) + ", ww AS (SELECT archive_id, seq, excerpt, 0 AS source FROM w1 WHERE rank = 1 UNION ALL SELECT archive_id, seq, excerpt, 1 FROM w2 WHERE rank = 1);;SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY source) AS r FROM ww) WHERE r = 1")
