"""Sessions summarised, grouped into segments, and the tables of best messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import sentence_case, slugify, title_case, tokenize
from threadlake.operators.ranking import label_rank, top_k

KEYS = ("archive_id",)


#: Titles by archetype, dealt in turn; the last list is for other labels.
SEGMENT_TITLES = {
    "affection": ["Closer Orbit", "Warmth in Motion", "Tender Gravity"],
    "planning": ["Plans Taking Shape", "Maps and Maybe", "Shared Trajectory"],
    "humor_banter": ["Laughter Loops", "Playful Momentum", "Banter Season"],
    "reassurance": ["Holding Steady", "Quiet Support", "Soft Landing"],
    "conflict": ["Friction Lines", "Tension in Motion", "The Harder Edge"],
    "repair_reconnection": ["Finding the Way Back", "Mending the Thread", "Returning Warmth"],
    "longing_missing": ["Distance and Pull", "Missing Each Other", "Far but Present"],
    "future_imagining": ["Looking Ahead", "What If Us", "Future Shape"],
    "check-in": ["Daily Signals", "Checking In", "Small Openings"],
    "everyday_life": ["Everyday Gravity", "Ordinary Days, Real Closeness", "Shared Routine"],
}
OTHER_SEGMENTS = ["A New Chapter", "Another Turning", "Shared Time"]
CHAPTER_TITLES = {
    "affection": ["Early Warmth", "Closer Orbit", "Tender Gravity"],
    "planning": ["Plans Taking Shape", "Future Notes", "Shared Trajectory"],
    "humor_banter": ["Laughter Season", "Playful Momentum", "Banter in Bloom"],
    "reassurance": ["Holding Steady", "Quiet Support", "Soft Ground"],
    "conflict": ["The Tense Stretch", "Fracture Lines", "Hard Conversations"],
    "repair_reconnection": ["Finding the Way Back", "Mending Together", "Repair and Return"],
    "longing_missing": ["Distance and Pull", "Missing Each Other", "Longing in Motion"],
    "future_imagining": ["Looking Ahead", "Future Shape", "Dreaming Forward"],
    "check-in": ["Small Openings", "Daily Signals", "Checking In"],
    "everyday_life": ["Everyday Gravity", "Ordinary Days, Real Closeness", "Shared Routine"],
}
OTHER_CHAPTERS = ["Another Turn", "A New Phase", "Shared Time"]
MILESTONE_TITLES = {
    "repair": "A Return to Warmth", "conflict": "A Tense Exchange", "support": "A Strong Support Moment", "affection": "A Tender Moment", "future": "Looking Forward Together", "turning_point": "A Shift in the Story",
}


def title_of(archetype: Column, index: Column, titles: dict[str, list[str]], others: list[str]) -> Column:
    """The title for an archetype: the next of its list with each index."""
    at = (index % 3).cast("int")
    out = F.get(F.lit(others), at)
    for label, some in titles.items():
        out = F.when(archetype == label, F.get(F.lit(some), at)).otherwise(out)
    return out


def _ranked(all_: Column, kind: str, k: int | None = None) -> Column:
    """The labels of a kind in an array of (kind, label, n, seen): most common first, then first seen."""
    some = F.array_sort(F.transform(F.filter(all_, lambda x: x["kind"] == kind), lambda x: F.struct((-x["n"]).alias("m"), x["seen"].alias("seen"), x["label"].alias("label"))))
    labels = F.transform(some, lambda x: x["label"])
    return F.slice(labels, 1, k) if k else labels


def session_summaries(a: DataFrame) -> DataFrame:
    """One row a session, from one grouped pass over its messages' labels.

    Each message gives a row for its emotion, its sender and each of its tags; they are counted by label,
    some thirty for a session, and the counts meet in one array. Messages themselves are never gathered:
    highlights are the best five by a bounded partial aggregate.
    """
    by = ["archive_id", "session_no"]
    row = lambda kind, label, pos: F.struct(F.lit(kind).alias("kind"), label.alias("label"), F.lit(pos).cast("int").alias("pos") if isinstance(pos, int) else pos.cast("int").alias("pos"))
    many = lambda kind, c: F.transform(c, lambda x, i: row(kind, x, i))
    each = F.concat(F.array(row("emotion", F.col("emotion_label"), 0), row("sender", F.col("sender_id"), 0)), many("topic", "topic_tags"), many("archetype", "archetype_tags"))
    rows = a.select(*by, "seq", "ts", "importance_score", F.inline(each))
    counts = rows.groupBy(*by, "kind", "label").agg(
        F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("seen"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("ts", "seq").alias("start_ts"), F.max_by("ts", "seq").alias("end_ts"), F.sum("importance_score").alias("total"),
    )
    own = lambda c: F.when(F.col("kind") == "emotion", c)  # noqa: E731  every message has one emotion
    out = counts.groupBy(*by).agg(
        F.min(own(F.col("first_seq"))).alias("first_seq"), F.max(own(F.col("last_seq"))).alias("last_seq"), F.min_by("start_ts", "first_seq").alias("start_ts"), F.max_by("end_ts", "last_seq").alias("end_ts"),
        F.sum(own(F.col("n"))).alias("message_count"), F.sum(own(F.col("total"))).alias("total"), F.collect_list(F.struct("kind", "label", "n", "seen")).alias("all"),
    )
    hours = (F.unix_timestamp(F.col("end_ts").cast("timestamp")) - F.unix_timestamp(F.col("start_ts").cast("timestamp"))) / 3600.0
    senders = F.filter("all", lambda x: (x["kind"] == "sender") & x["label"].isNotNull())
    return out.select(
        *by, "first_seq", "last_seq", "start_ts", "end_ts", "message_count", (F.col("total") / F.col("message_count")).alias("mean_importance"), (F.col("message_count") / F.greatest(F.lit(1.0), hours)).alias("density"),
        F.get(_ranked(F.col("all"), "emotion"), 0).alias("dominant_emotion"), _ranked(F.col("all"), "topic", 3).alias("topics"), _ranked(F.col("all"), "archetype", 3).alias("archetypes"),
        F.map_from_entries(F.transform(senders, lambda x: F.struct(x["label"], x["n"]))).alias("sender_counts"),
    )


def session_highlights(a: DataFrame, k: int = 5) -> DataFrame:
    """(archive_id, session_no, rank, seq, importance_score): each session's candidates of most importance."""
    return top_k(a.where("highlight_candidate").select("archive_id", "session_no", "seq", "importance_score"), ["archive_id", "session_no"], [F.desc("importance_score"), "seq"], k)


def change_scores(s: DataFrame) -> DataFrame:
    """How much a session differs from the one before; the first scores 2."""
    w = Window.partitionBy("archive_id").orderBy("session_no")
    p = s.select("*", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("end_ts", "dominant_emotion", "topics", "archetypes", "density")))
    score = (
        F.when(F.datediff("start_ts", "p_end_ts") >= 2, 2).otherwise(0) + (F.col("p_dominant_emotion") != F.col("dominant_emotion")).cast("int") + (~F.arrays_overlap("p_topics", "topics")).cast("int")
        + (F.abs(F.col("p_density") - F.col("density")) >= 4).cast("int") + F.when(F.array_contains("p_archetypes", "conflict") & F.array_contains("archetypes", "repair_reconnection"), 2).otherwise(0)
    )
    return p.withColumn("change_score", F.when(F.col("p_end_ts").isNull(), 2).otherwise(score)).drop("p_end_ts", "p_dominant_emotion", "p_topics", "p_archetypes", "p_density")


def with_segments(s: DataFrame, size: int = 4) -> DataFrame:
    """Runs of sessions that change little, cut every `size` sessions; numbered from 1."""
    w = Window.partitionBy("archive_id").orderBy("session_no")
    run = change_scores(s).withColumn("run", F.sum((F.col("change_score") >= 2).cast("int")).over(w))
    at = F.row_number().over(Window.partitionBy("archive_id", "run").orderBy("session_no")) - 1
    part = run.withColumn("part", F.floor(at / size))
    return part.withColumn("segment_no", F.dense_rank().over(Window.partitionBy("archive_id").orderBy("run", "part"))).drop("run", "part")


def segment_summary(seg: DataFrame) -> DataFrame:
    """Sessions and messages of each segment, its labels by their sessions' vote, turns, title and summary."""
    by = ["archive_id", "segment_no"]
    row = lambda kind, label, pos: F.struct(F.lit(kind).alias("kind"), label.alias("label"), pos.cast("int").alias("pos"))
    many = lambda kind, c: F.transform(c, lambda x, i: row(kind, x, i))
    each = seg.select(*by, "session_no", "message_count", F.inline(F.concat(F.array(row("emotion", F.col("dominant_emotion"), F.lit(0))), many("topic", "topics"), many("archetype", "archetypes"))))
    counts = each.groupBy(*by, "kind", "label").agg(F.count("*").alias("n"), F.min(F.struct("session_no", "pos")).alias("seen"), F.min("session_no").alias("first"), F.max("session_no").alias("last"), F.sum("message_count").alias("messages"))
    own = lambda c: F.when(F.col("kind") == "emotion", c)
    has = lambda x: F.max((F.col("kind") == "archetype") & (F.col("label") == x))
    out = counts.groupBy(*by).agg(
        F.min("first").alias("first_session"), F.max("last").alias("last_session"), F.sum(own(F.col("n"))).alias("sessions"), F.sum(own(F.col("messages"))).alias("message_count"),
        (has("conflict") & has("repair_reconnection")).alias("conflict_repair_cycle"), F.collect_list(F.struct("kind", "label", "n", "seen")).alias("all"),
    )
    out = out.select(*by, "first_session", "last_session", "sessions", "message_count", F.get(_ranked(F.col("all"), "emotion"), 0).alias("dominant_emotion"), _ranked(F.col("all"), "topic", 3).alias("topics"), _ranked(F.col("all"), "archetype", 3).alias("archetypes"), "conflict_repair_cycle")
    out = out.withColumn("dominant_archetype", F.get("archetypes", 0))
    turn = F.array_contains("archetypes", "repair_reconnection") | F.array_contains("archetypes", "future_imagining") | (F.col("dominant_emotion") == "conflict")
    summary = F.concat(sentence_case(F.col("dominant_emotion")), F.lit(" energy with "), title_case(F.col("dominant_archetype")), F.lit(" moments and "), title_case(F.get("topics", 0)), F.lit(" themes."))
    return out.withColumn("turning_point", turn).withColumn("title", title_of(F.col("dominant_archetype"), F.col("segment_no") - 1, SEGMENT_TITLES, OTHER_SEGMENTS)).withColumn("summary", summary)


def segment_highlights(seg: DataFrame, a: DataFrame, k: int = 8) -> DataFrame:
    """(archive_id, segment_no, rank, seq): the first k of the sessions' highlights, session by session."""
    h = session_highlights(a).withColumnRenamed("rank", "own").join(seg.select("archive_id", "session_no", "segment_no"), ["archive_id", "session_no"])
    return top_k(h, ["archive_id", "segment_no"], ["session_no", "own"], k)


def with_quotes(segments: DataFrame, firsts: DataFrame, a: DataFrame) -> DataFrame:
    """Summaries ending with the first 120 characters of the segment's first highlight, where it has one."""
    best = firsts.where("rank = 1").select("archive_id", "segment_no", "seq").join(a.select("archive_id", "seq", "text"), ["archive_id", "seq"])
    line = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit(' Representative line: "'), F.substring("text", 1, 120), F.lit('"'))).otherwise("")
    return segments.join(best.select("archive_id", "segment_no", "text"), ["archive_id", "segment_no"], "left").withColumn("summary", F.concat("summary", line)).drop("text")


def with_chapters(segments: DataFrame, target: int = 6) -> DataFrame:
    """Segments (segment_no, message_count) with chapter_no: filled to an equal share of messages while segments last.

    Filling starts anew after each chapter, which no window can say, so it is a fold over the archive's
    segment counts. Its state holds at most `target` ends; an archive has some thousands of segments, 16 bytes each.
    """
    counts = F.transform(F.array_sort(F.collect_list(F.struct("segment_no", "message_count"))), lambda x: F.struct(x["segment_no"].cast("long").alias("no"), x["message_count"].cast("long").alias("n")))
    per_archive = segments.groupBy("archive_id").agg(counts.alias("counts"), F.sum("message_count").alias("total"), F.count("*").alias("size"))
    wanted = F.least(F.lit(target), F.col("size"))
    share = F.greatest(F.lit(1), F.ceil(F.col("total") / wanted))

    def step(state, x):
        running, left = state["running"] + x["n"], wanted - F.size(state["ends"]) - 1
        full = (running >= share) & ((F.col("size") - state["at"] - 1 >= left) | (left <= 0))
        ends = F.when(full, F.concat(state["ends"], F.array(x["no"]))).otherwise(state["ends"])
        return F.struct(F.when(full, F.lit(0).cast("long")).otherwise(running).alias("running"), (state["at"] + 1).alias("at"), ends.alias("ends"))

    start = F.struct(F.lit(0).cast("long").alias("running"), F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("ends"))
    ends = per_archive.select("archive_id", F.aggregate("counts", start, step)["ends"].alias("_ends"))
    before = F.size(F.filter("_ends", lambda e: e < F.col("segment_no")))
    return segments.join(ends, "archive_id").withColumn("chapter_no", (before + 1).cast("long")).drop("_ends")


def chapter_summary(chapters: DataFrame) -> DataFrame:
    """Of segments with chapter_no: extent, messages, the emotion most segments have (ties: met first), title, slug and summary.

    Topics and archetypes are the first three distinct ones in order. An archive has at most some chapters of
    some thousands of segments, of which each has three labels.
    """
    by = ["archive_id", "chapter_no"]
    base = chapters.groupBy(*by).agg(
        F.min("segment_no").alias("first_segment"), F.count("*").alias("segments"), F.sum("message_count").alias("message_count"),
        *(F.slice(F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct("segment_no", c)))[c])), 1, 3).alias(c) for c in ("topics", "archetypes")),
    )
    mood = label_rank(chapters, by, "dominant_emotion", F.col("segment_no"), 1)
    out = base.join(mood.select(*by, "dominant_emotion"), by)
    out = out.withColumn("title", title_of(F.get("archetypes", 0), F.col("chapter_no") - 1, CHAPTER_TITLES, OTHER_CHAPTERS))
    slug = F.concat(F.format_string("chapter-%02d-", "chapter_no"), slugify(F.col("title")))
    summary = F.concat("title", F.lit(" leans "), "dominant_emotion", F.lit(" with "), title_case(F.get("archetypes", 0)), F.lit(" and "), title_case(F.get("topics", 0)), F.lit(" shaping the phase."))
    return out.withColumn("chapter_id", F.format_string("chapter_%03d", "chapter_no")).withColumn("slug", slug).withColumn("summary", summary)


def highlights(a: DataFrame, limit: int = 60) -> DataFrame:
    """Candidates by importance, the best row of each text; filtered before the shuffle."""
    c = a.where("message_type = 'text' and highlight_candidate")
    best = top_k(c, ["archive_id", "normalized_text"], [F.desc("importance_score"), "seq"], 1).drop("rank")
    return top_k(best, KEYS, [F.desc("importance_score"), "seq"], limit)


def milestones(a: DataFrame, limit: int = 24) -> DataFrame:
    """The best candidate of each segment (column segment_no), with its type."""
    c = a.where("message_type = 'text' and milestone_candidate")
    best = top_k(c, ["archive_id", "segment_no"], [F.desc("importance_score"), "seq"], 1).drop("rank")
    has = lambda t: F.array_contains("archetype_tags", t)
    kind = F.when(F.col("repair_signal"), "repair").when(F.col("conflict_signal"), "conflict").when(F.col("support_signal"), "support").when(has("affection"), "affection").when(has("future_imagining"), "future").otherwise("turning_point")
    out = top_k(best, KEYS, [F.desc("importance_score"), "seq"], limit).withColumn("milestone_type", kind)
    title = F.lit(None).cast("string")
    for k, t in MILESTONE_TITLES.items():
        title = F.when(F.col("milestone_type") == k, t).otherwise(title)
    out = out.withColumn("milestone_id", F.format_string("milestone_%04d", "rank")).withColumn("title", title)
    told = F.concat("title", F.lit(" around "), F.date_format("ts", "MMM d, yyyy"), F.lit(" with "), "emotion_label", F.lit(" tone and "), title_case(F.get("archetype_tags", 0)), F.lit(" energy."))
    return out.withColumn("summary", told)


def topic_clusters(a: DataFrame) -> DataFrame:
    """Topics by their messages; ties go to the topic met first."""
    each = a.select("archive_id", "seq", F.posexplode("topic_tags").alias("pos", "topic"))
    counts = each.groupBy("archive_id", "topic").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("seen"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("archive_id").orderBy(F.desc("n"), "seen"))).drop("seen")


def first_of(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key by seq, without gathering a key's rows: Spark keeps k a task before it shuffles."""
    return top_k(rows, keys, ["seq"], k)


def topic_quotes(a: DataFrame, ids: int = 8) -> DataFrame:
    """(archive_id, topic, rank, seq, text): the first messages of each topic."""
    return first_of(a.select("archive_id", "seq", "text", F.explode("topic_tags").alias("topic")), ["archive_id", "topic"], ids)


def phrase_motifs(m: DataFrame, limit: int = 40, least: int = 3) -> DataFrame:
    """Repeated short phrases: counted first, ranked, and only then labelled."""
    t = m.where("message_type = 'text' and word_count between 2 and 8").select("archive_id", "seq", tokenize(F.col("text")).alias("t")).where(F.size("t").between(2, 8))
    n = t.groupBy("archive_id", F.array_join("t", " ").alias("phrase")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).where(F.col("n") >= least)
    return top_k(n, KEYS, [F.desc("n"), "first_seq"], limit).withColumn("label", sentence_case(F.col("phrase")))


def motif_messages(m: DataFrame, motifs: DataFrame, ids: int = 8) -> DataFrame:
    """(archive_id, phrase, rank, seq): the first messages of each kept motif; others are dropped before the window."""
    t = m.where("message_type = 'text' and word_count between 2 and 8").select("archive_id", "seq", tokenize(F.col("text")).alias("t")).where(F.size("t").between(2, 8))
    said = t.select("archive_id", "seq", F.array_join("t", " ").alias("phrase")).join(motifs.select("archive_id", "phrase"), ["archive_id", "phrase"], "left_semi")
    return first_of(said, ["archive_id", "phrase"], ids)


def session_extremes(s: DataFrame, by: str, k: int = 6) -> DataFrame:
    return top_k(s, KEYS, [F.desc(by), "session_no"], k).select("archive_id", "rank", "session_no", "message_count", F.round("density", 2).alias("density"))


def fastest_exchange_windows(a: DataFrame, least: int = 20, k: int = 6) -> DataFrame:
    s = a.where("message_type <> 'system'").groupBy("archive_id", "session_no").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("reply_gap_minutes"), F.lit(0.0)), 2).alias("average_reply_gap"))
    return top_k(s.where(F.col("n") >= least), KEYS, ["average_reply_gap", "session_no"], k)
