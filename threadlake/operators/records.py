"""Records and summaries over the rollups: months, peaks, manifests, motifs with hints, and the headline row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.operators import cube as C
from threadlake.operators.cube import time_cube
from threadlake.operators.narrative import phrase_motifs
from threadlake.operators.ranking import top_k
from threadlake.operators.rollups import active, count_by, emotion_timeline, late_night_trend, month_winners, monthly_split, overview_of, participant_overview, ratio, split_of, winners_of
from threadlake.operators.sessions import chunk_windows, longest_streak, streak_of
from threadlake.functions.text import format_compact, late_night, weekend
from threadlake.sources.store import written

KEYS = ("archive_id",)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def messages_manifest(m: DataFrame) -> DataFrame:
    """One row for each month's shard, with how many shards and messages its archive has."""
    shards = m.groupBy("archive_id", "month_key").agg(F.count("*").alias("n"), iso(F.min_by("ts", "seq")).alias("first_ts"), iso(F.max_by("ts", "seq")).alias("last_ts")).withColumn("shard_id", F.concat(F.lit("messages_"), "month_key"))
    whole = Window.partitionBy("archive_id")
    return shards.withColumns({"shard_count": F.count("*").over(whole), "total_messages": F.sum("n").over(whole)})


def source_manifest(m: DataFrame) -> DataFrame:
    return m.groupBy("archive_id").agg(F.count("*").alias("n"), F.countDistinct("sender_label").alias("participants"), iso(F.min_by("ts", "seq")).alias("first_ts"), iso(F.max_by("ts", "seq")).alias("last_ts"))


def chunk_manifest(m: DataFrame) -> DataFrame:
    """First and last row and time and the sessions of each chunk; sessions ascend with seq, so their order is that of first sight."""
    c = chunk_windows(m, columns=("session_no", "ts"))
    by = c.groupBy("archive_id", "chunk_no").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"), iso(F.min_by("ts", "seq")).alias("first_ts"), iso(F.max_by("ts", "seq")).alias("last_ts"), F.array_sort(F.collect_set("session_no")).alias("s"))
    return by.withColumn("session_ids", F.array_join(F.transform("s", lambda x: F.format_string("tech_%04d", x)), ",")).drop("s")


def participant_peak_windows(m: DataFrame, windows: int = 4, others: int = 3) -> DataFrame:
    """The busiest weekday and hour windows, weekdays and hours of each sender. Windows tie by the text `weekday:hour`."""
    n = count_by(active(m).where("sender_id is not null"), "sender_id", "weekday", "hour_of_day")
    keys, none = ["archive_id", "sender_id"], F.lit(None).cast("int")
    at = F.concat_ws(":", "weekday", "hour_of_day")
    both = top_k(n, keys, [F.desc("n"), at], windows).withColumn("kind", F.lit("window"))
    days = top_k(n.groupBy(*keys, "weekday").agg(F.sum("n").alias("n")), keys, [F.desc("n"), "weekday"], others).withColumn("kind", F.lit("weekday")).withColumn("hour_of_day", none)
    hours = top_k(n.groupBy(*keys, "hour_of_day").agg(F.sum("n").alias("n")), keys, [F.desc("n"), "hour_of_day"], others).withColumn("kind", F.lit("hour")).withColumn("weekday", none)
    return both.unionByName(days).unionByName(hours)


def most_balanced_month(m: DataFrame, floor: int = 200) -> DataFrame:
    """The month whose senders' counts differ least, among those not too quiet."""
    return balanced_of(monthly_split(m), floor)


def balanced_of(split: DataFrame, floor: int) -> DataFrame:
    months = split.groupBy("archive_id", "month_key").agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.first("total_messages").alias("total_messages"))
    least = F.greatest(F.lit(floor), F.floor(F.avg("total_messages").over(Window.partitionBy("archive_id")) * 0.35 + 0.5))
    fit = months.withColumn("least", least).where("total_messages >= least").withColumn("imbalance", (F.col("hi") - F.col("lo")) / F.greatest("hi", F.lit(1)))
    return top_k(fit, KEYS, ["imbalance", F.desc("total_messages"), "month_key"], 1)


def monthly_takeover(m: DataFrame) -> DataFrame:
    return takeover_of(month_winners(m))


def takeover_of(winners: DataFrame) -> DataFrame:
    return top_k(winners.where("winner is not null"), KEYS, [F.desc("margin"), F.desc("total_messages"), "month_key"], 1)


def night_owl_month(m: DataFrame, floor: int = 400) -> DataFrame:
    return owl_of(late_night_trend(m), floor)


def owl_of(trend: DataFrame, floor: int) -> DataFrame:
    return top_k(trend.where(F.col("total_messages") >= floor), KEYS, [F.desc("late_night_share"), F.desc("total_messages"), "month_key"], 1)


def hinted_motifs(a: DataFrame, limit: int = 40, least: int = 3) -> DataFrame:
    """Motifs with the first tag of the message that says each first."""
    hint = a.select("archive_id", F.col("seq").alias("first_seq"), F.element_at("archetype_tags", 1).alias("archetype_hint"))
    return phrase_motifs(a, limit, least).join(hint, ["archive_id", "first_seq"], "left")


def inside_jokes(a: DataFrame, limit: int = 18) -> DataFrame:
    return top_k(hinted_motifs(a).where("n >= 4 and archetype_hint = 'humor_banter'").withColumnRenamed("rank", "motif_rank"), KEYS, ["motif_rank"], limit)


def arc_summary(a: DataFrame) -> DataFrame:
    """First, middle and last weekly tone, and the week of highest intensity."""
    whole = Window.partitionBy("archive_id")
    t = emotion_timeline(a).withColumn("i", F.row_number().over(whole.orderBy("week_key")) - 1).withColumn("c", F.count("*").over(whole))
    t = t.withColumn("top", F.row_number().over(whole.orderBy(F.desc("mean_intensity"), "week_key")))
    pick = lambda c, v: F.max(F.when(c, F.col(v)))
    return t.groupBy("archive_id").agg(
        pick(F.col("i") == 0, "dominant_emotion").alias("opening_tone"), pick(F.col("i") == F.floor(F.col("c") / 2), "dominant_emotion").alias("middle_tone"),
        pick(F.col("i") == F.col("c") - 1, "dominant_emotion").alias("closing_tone"), pick(F.col("top") == 1, "week_key").alias("peak_week"), F.max("mean_intensity").alias("peak_intensity"),
    )


def peak_periods(a: DataFrame) -> DataFrame:
    """(archive_id, kind, period, value): the top month or week of each kind; ties go to the period met first.

    The most intense week is the one with most messages.
    """
    n = lambda c: F.sum(F.col(c).cast("int"))
    return periods_of(active(a).groupBy("archive_id", "month_key", "week_key").agg(F.count("*").alias("n"), n("support_signal").alias("support"), n("repair_signal").alias("repair"), F.min("seq").alias("seen")))


def periods_of(counts: DataFrame) -> DataFrame:
    """peak_periods from (archive_id, month_key, week_key, n, support, repair, seen), of which a period may have many rows."""
    n = lambda c: F.sum(c).cast("double")
    months = counts.groupBy("archive_id", F.col("month_key").alias("period")).agg(n("n").alias("most_active_month"), n("support").alias("support_month"), n("repair").alias("repair_month"), F.min("seen").alias("seen"))
    weeks = counts.groupBy("archive_id", F.col("week_key").alias("period")).agg(n("n").alias("value"), F.min("seen").alias("seen"))
    long = months.unpivot(["archive_id", "period", "seen"], ["most_active_month", "support_month", "repair_month"], "kind", "value").unionByName(weeks.withColumn("kind", F.lit("most_intense_week")))
    return top_k(long, ["archive_id", "kind"], [F.desc("value"), "seen"], 1)


def conflict_repair_cycles(s: DataFrame) -> DataFrame:
    before = F.lag("archetypes").over(Window.partitionBy("archive_id").orderBy("session_no"))
    cycle = F.array_contains("before", "conflict") & F.array_contains("archetypes", "repair_reconnection")
    return s.select("archive_id", "archetypes", before.alias("before")).groupBy("archive_id").agg(F.count(F.when(cycle, 1)).alias("n"))


def signature_headline(a: DataFrame, s: DataFrame) -> DataFrame:
    """One row an archive: totals, streak, top day and month, longest session, night share, support and cycles.

    Messages are read once, into counts by day; all else comes from the days and the sessions.
    """
    act = F.col("message_type") != "system"
    n = lambda c: F.sum(c.cast("int"))
    days = a.groupBy("archive_id", "day_key").agg(n(act).alias("n"), n(act & late_night(F.col("hour_of_day"))).alias("late"), n(F.col("support_signal")).alias("support"))
    some = days.where("n > 0")
    best = lambda c: F.min(F.struct((-F.col("n")).alias("m"), F.col(c).alias("at")))
    total = some.groupBy("archive_id").agg(F.sum("n").alias("total"), F.count("*").alias("days"), F.sum("late").alias("late"), best("day_key").alias("day"))
    months = some.groupBy("archive_id", F.substring("day_key", 1, 7).alias("month_key")).agg(F.sum("n").alias("n")).groupBy("archive_id").agg(best("month_key").alias("month"))
    support = days.groupBy("archive_id").agg(F.sum("support").alias("support_count"))
    longest = s.groupBy("archive_id").agg(F.max("message_count").alias("longest_session"))
    out = total
    for part in (months, streak_of(some), support, longest, conflict_repair_cycles(s).withColumnRenamed("n", "cycles")):
        out = out.join(part, "archive_id", "left")
    c = F.col
    return out.select(
        "archive_id", c("total").alias("total_messages"), ratio(c("total"), c("days"), False).alias("mean_per_day"), ratio(c("late"), c("total")).alias("late_night_share"), "longest_streak", c("day.at").alias("top_day"), (-c("day.m")).alias("top_day_count"),
        c("month.at").alias("top_month"), (-c("month.m")).alias("top_month_count"), "longest_session", "support_count", "cycles",
    )


#: Fixed values: (measure, column of the participants' overview, whether the least wins).
LEADERS = [
    ("who_sent_more", "total_messages", False), ("who_replied_faster", "average_reply_gap", True), ("who_used_more_emojis", "emoji_count", False), ("who_texted_later", "late_night_percentage", False), ("who_writes_longer", "chars_per_message", False),
    ("who_shares_more_links", "link_count", False), ("who_starts_more_conversations", "session_opener_count", False), ("who_sends_more_multiline", "multiline_count", False), ("who_owns_more_weekends", "weekend_percentage", False),
]
#: Record, label, detail (null: made from the data), page, and which messages support it.
RECORDS = [
    ("who_sent_more", "Who sent more", None, "/dashboard/", "all"),
    ("who_replied_faster", "Who replied faster", "Average reply gap across the archive", "/patterns/", "all"),
    ("who_used_more_emojis", "Who used more emojis", "Total emoji count across all sent messages", "/dashboard/", "emoji"),
    ("who_texted_later", "Who texted later", "Share of each participant's messages sent after 10 PM", "/timeline/", "late"),
    ("most_active_month", "Most active month", "The archive's loudest month by message volume", "/timeline/", "month"),
    ("most_intense_week", "Most intense week", "Peak weekly exchange volume", "/timeline/", "week"),
    ("most_balanced_month", "Most balanced month", "The closest split between both sides without dropping into a quiet period", "/dashboard/", "month"),
    ("highest_support_stretch", "Highest support stretch", "Where support signals clustered most heavily", "/lenses/reassurance/", "month"),
    ("strongest_repair_stretch", "Strongest repair stretch", "The stretch with the clearest repair energy", "/lenses/repair-reconnection/", "month"),
    ("who_writes_longer", "Who writes longer messages", "Average character length per sent message", "/dashboard/", "all"),
    ("who_shares_more_links", "Who shares more links", "Total links dropped across the archive", "/dashboard/", "link"),
    ("who_starts_more_conversations", "Who starts more conversations", "Who opens more technical sessions", "/dashboard/", "all"),
    ("who_sends_more_multiline", "Who sends more multiline notes", "Longer note-style messages instead of one-liners", "/moments/", "multiline"),
    ("who_owns_more_weekends", "Who owns more weekends", "Share of each person's messages sent on weekends", "/patterns/", "weekend"),
    ("biggest_monthly_takeover", "Biggest monthly takeover", None, "/timeline/", "month"),
    ("most_night_owl_month", "Most night-owl month", "Month with the highest late-night message share", "/timeline/", "month"),
]


def tenths(c: Column) -> Column:
    """A number as text with one decimal, rounded half up."""
    t = F.floor(c * 10.0 + 0.5)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), F.pmod(t, F.lit(10)).cast("string"))


def participant_leaders(m: DataFrame) -> DataFrame:
    """(archive_id, measure, sender_id, value): who leads in each measure; ties go to the participant met first.

    A participant without reply gaps has mean 0, and so replies fastest.
    """
    return leaders_of(participant_overview(m), active(m).where("sender_id is not null").groupBy("archive_id", "sender_id").agg(F.min("seq").alias("seen")))


def leaders_of(overview: DataFrame, seen: DataFrame) -> DataFrame:
    """participant_leaders from the overview and (archive_id, sender_id, seen)."""
    o = overview.join(seen, ["archive_id", "sender_id"])
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(c).cast("double").alias("value"), (F.col(c).cast("double") * (1.0 if least else -1.0)).alias("_o")) for k, c, least in LEADERS)))
    return top_k(o.select("archive_id", "sender_id", "seen", each), ["archive_id", "measure"], ["_o", "seen"], 1).select("archive_id", "measure", "sender_id", "value")


def supporting(m: DataFrame, k: int = 3, only: tuple[str, ...] | None = None) -> DataFrame:
    """(archive_id, kind, who, ids): the first k active messages of each participant, month and week, by what they support; of some kinds where `only` names them."""
    late, kinds = late_night(F.col("hour_of_day")), []
    sent = F.col("sender_id").isNotNull()
    for kind, who, fits in (
        ("all", "sender_id", sent), ("emoji", "sender_id", sent & (F.col("emoji_count") > 0)), ("late", "sender_id", sent & late), ("link", "sender_id", sent & F.col("has_url")), ("multiline", "sender_id", sent & F.col("is_multiline")),
        ("weekend", "sender_id", sent & weekend(F.col("weekday"))), ("month", "month_key", F.lit(True)), ("week", "week_key", F.lit(True)), ("any", "month_key", F.lit(True)), ("night", "month_key", late),
    ):
        if only and kind not in only:
            continue
        whose = F.lit("*") if kind in ("any", "night") else F.col(who)
        kinds.append(F.when(fits, F.struct(F.lit(kind).alias("kind"), whose.alias("who"))))
    each = active(m).select("archive_id", "seq", F.inline(F.array_compact(F.array(*kinds))))
    first = top_k(each, ["archive_id", "kind", "who"], ["seq"], k)
    ids = F.transform(F.array_sort(F.collect_list("seq")), lambda x: F.format_string("msg_%07d", x + 1))
    return first.groupBy("archive_id", "kind", "who").agg(F.array_join(ids, ",").alias("ids"))


def detective_records(a: DataFrame, balanced_floor: int = 200, night_floor: int = 400) -> DataFrame:
    """The sixteen records of an archive: id, label, value, detail, winner, page and first supporting messages; N/A without data.

    Messages are annotated once; every record is answered from the time cube, and the supporting ones from its narrow rows.
    """
    rows, cube = time_cube(a)
    overview, split = overview_of(C.sender_totals(cube), C.session_openers(cube)), split_of(C.month_counts(cube))
    n = lambda c: format_compact(F.col(c))
    share = overview.select("archive_id", "sender_id", F.col("message_share").alias("share"))
    lead = leaders_of(overview, C.first_seen(cube)).join(share, ["archive_id", "sender_id"])
    shown = {"average_reply_gap": F.concat(tenths(F.col("value")), F.lit(" min")), "chars_per_message": F.concat(tenths(F.col("value")), F.lit(" chars/msg")), "late_night_percentage": F.concat(tenths(F.col("value")), F.lit("%")), "weekend_percentage": F.concat(tenths(F.col("value")), F.lit("%"))}
    value = n("value")
    for k, c, _ in LEADERS:
        if c in shown:
            value = F.when(F.col("measure") == k, shown[c]).otherwise(value)
    none = F.lit(None).cast("string")
    people = lead.select("archive_id", F.col("measure").alias("record_id"), F.concat("sender_id", F.lit(" - "), value).alias("value"), F.when(F.col("measure") == "who_sent_more", F.concat(tenths(F.col("share")), F.lit("% of the archive"))).alias("own_detail"), F.col("sender_id").alias("winner"), F.col("sender_id").alias("who"))
    named = {"most_active_month": "most_active_month", "most_intense_week": "most_intense_week", "support_month": "highest_support_stretch", "repair_month": "strongest_repair_stretch"}
    kind = F.lit(None).cast("string")
    for k, v in named.items():
        kind = F.when(F.col("kind") == k, v).otherwise(kind)
    periods = periods_of(cube).select("archive_id", kind.alias("record_id"), F.concat("period", F.lit(" - "), n("value")).alias("value"), none.alias("own_detail"), none.alias("winner"), F.col("period").alias("who"))
    even = balanced_of(split, balanced_floor).select("archive_id", F.lit("most_balanced_month").alias("record_id"), F.concat("month_key", F.lit(" - "), n("total_messages")).alias("value"), none.alias("own_detail"), none.alias("winner"), F.col("month_key").alias("who"))
    over = takeover_of(winners_of(split)).select("archive_id", F.lit("biggest_monthly_takeover").alias("record_id"), F.concat("month_key", F.lit(" - "), "winner").alias("value"), F.concat(n("margin"), F.lit(" message lead")).alias("own_detail"), "winner", F.col("month_key").alias("who"))
    owl = owl_of(C.late_night_trend(cube), night_floor).select("archive_id", F.lit("most_night_owl_month").alias("record_id"), F.concat("month_key", F.lit(" - "), tenths(F.col("late_night_share")), F.lit("%")).alias("value"), none.alias("own_detail"), none.alias("winner"), F.col("month_key").alias("who"))
    found = people.unionByName(periods).unionByName(even).unionByName(over).unionByName(owl)
    told = F.inline(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(k).alias("record_id"), F.lit(label).alias("label"), F.lit(d).cast("string").alias("told"), F.lit(route).alias("route"), F.lit(kind).alias("kind")) for i, (k, label, d, route, kind) in enumerate(RECORDS))))
    grid = cube.select("archive_id").distinct().select("archive_id", told)
    missing = {"who_sent_more": "No data", "most_balanced_month": "No balanced month found", "biggest_monthly_takeover": "No clear monthly winner"}
    detail = F.coalesce("own_detail", "told")
    for k, v in missing.items():
        detail = F.when(F.col("value").isNull() & (F.col("record_id") == k), v).otherwise(detail)
    out = grid.join(found, ["archive_id", "record_id"], "left").join(supporting(rows), ["archive_id", "kind", "who"], "left")
    return out.select("archive_id", "place", "record_id", "label", F.coalesce("value", F.lit("N/A")).alias("value"), detail.alias("detail"), "winner", "route", F.coalesce("ids", F.lit("")).alias("ids"))


def story_spotlights(m: DataFrame) -> DataFrame:
    """(archive_id, place, label, value, ids): messages, streak, top month and late share, with first supporting messages.

    Messages are read once, into narrow rows from which all else is counted.
    """
    rows = written(active(m).select("archive_id", "seq", "message_type", "day_key", "month_key", "hour_of_day"))
    total = rows.groupBy("archive_id").agg(F.count("*").alias("n"), F.sum(late_night(F.col("hour_of_day")).cast("int")).alias("late"))
    month = top_k(count_by(rows, "month_key"), KEYS, [F.desc("n"), "month_key"], 1).select("archive_id", "month_key", F.col("n").alias("top"))
    one = total.join(longest_streak(rows), "archive_id").join(month, "archive_id")
    share = F.regexp_replace(tenths(F.col("late") * 100.0 / F.greatest("n", F.lit(1))), r"\.0$", "")
    row = lambda i, label, value, kind, who: F.struct(F.lit(i).alias("place"), F.lit(label).alias("label"), value.alias("value"), F.lit(kind).alias("kind"), who.alias("who"))
    each = one.select("archive_id", F.inline(F.array(
        row(1, "Messages shared", format_compact(F.col("n")), "any", F.lit("*")), row(2, "Longest streak", F.concat(F.col("longest_streak").cast("string"), F.lit(" days")), "any", F.lit("*")),
        row(3, "Most active month", F.concat("month_key", F.lit(" ("), format_compact(F.col("top")), F.lit(")")), "month", F.col("month_key")), row(4, "Late-night share", F.concat(share, F.lit("%")), "night", F.lit("*")),
    )))
    return each.join(supporting(rows, only=("any", "month", "night")), ["archive_id", "kind", "who"], "left").select("archive_id", "place", "label", "value", F.coalesce("ids", F.lit("")).alias("ids"))
