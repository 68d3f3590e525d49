"""Counts by day, week, month and hour, and per-participant statistics. Each is one grouped pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import late_night, weekend
from threadlake.operators.ranking import label_rank, top_k

KEYS = ("archive_id",)


def active(messages: DataFrame) -> DataFrame:
    return messages.where("message_type <> 'system'")


def ratio(a: Column, b: Column, percent: bool = True) -> Column:
    """a / max(b, 1), in percent, to two decimals."""
    q = F.coalesce(a, F.lit(0)).cast("double") / F.greatest(F.coalesce(b, F.lit(0)), F.lit(1)).cast("double")
    return F.round(q * 100.0 if percent else q, 2)


def count_by(messages: DataFrame, *by: str, keys=KEYS) -> DataFrame:
    return messages.groupBy(*keys, *by).agg(F.count("*").alias("n"))


def daily_counts(m: DataFrame) -> DataFrame:
    return count_by(active(m), "day_key")


def heatmap_bins(m: DataFrame) -> DataFrame:
    return count_by(m, "weekday", "hour_of_day")


def monthly_volume(m: DataFrame) -> DataFrame:
    return daily_counts(m).groupBy("archive_id", F.substring("day_key", 1, 7).alias("month_key")).agg(F.sum("n").alias("n"))


def frequency_summary(m: DataFrame) -> DataFrame:
    days = active(m).groupBy("archive_id").agg(F.countDistinct("day_key").alias("active_days"), F.count("*").alias("_a"))
    total = m.groupBy("archive_id").agg(F.count("*").alias("total_messages"))
    return total.join(days, "archive_id", "left").select("archive_id", "total_messages", F.coalesce("active_days", F.lit(0)).alias("active_days"), ratio(F.col("_a"), F.col("active_days"), False).alias("mean_per_day"))


def participants(m: DataFrame) -> DataFrame:
    """Numbered by first appearance of the label."""
    first = m.where("sender_label is not null").groupBy("archive_id", "sender_label").agg(F.min("seq").alias("first_seq"), F.count("*").alias("message_count"))
    n = F.row_number().over(Window.partitionBy("archive_id").orderBy("first_seq"))
    return first.withColumn("n", n).select("archive_id", F.format_string("participant_%02d", "n").alias("participant_id"), F.col("sender_label").alias("label"), "message_count", F.format_string("msg_%07d", F.col("first_seq") + 1).alias("first_message_id"))


def session_openers(m: DataFrame) -> DataFrame:
    """How many sessions each sender's first active message opens."""
    first = active(m).groupBy("archive_id", "session_no").agg(F.min_by("sender_id", "seq").alias("sender_id"))
    return first.groupBy("archive_id", "sender_id").agg(F.count("*").alias("n"))


def sender_totals(m: DataFrame) -> DataFrame:
    """Sums of each sender's active messages."""
    a = active(m)
    when = lambda c: F.sum(c.cast("int"))
    return a.where("sender_id is not null").groupBy("archive_id", "sender_id").agg(
        F.count("*").alias("n"), F.sum("word_count").alias("words"), F.sum("char_count").alias("chars"), F.sum("emoji_count").alias("emoji"), when(F.col("has_url")).alias("links"),
        when(weekend(F.col("weekday"))).alias("weekends"), when(late_night(F.col("hour_of_day"))).alias("late"), F.max("char_count").alias("longest"), when(F.col("is_multiline")).alias("multiline"), F.avg("reply_gap_minutes").alias("gap"),
    )


def participant_overview(m: DataFrame) -> DataFrame:
    return overview_of(sender_totals(m), session_openers(m))


def overview_of(totals: DataFrame, openers: DataFrame) -> DataFrame:
    """Shares and means of the senders, from their sums and the sessions they open."""
    per = totals.join(openers.withColumnRenamed("n", "opened"), ["archive_id", "sender_id"], "left")
    whole = Window.partitionBy("archive_id")
    total = lambda c: F.sum(c).over(whole)
    c = F.col
    return per.select(
        "archive_id", "sender_id", c("n").alias("total_messages"), ratio(c("n"), total("n")).alias("message_share"), c("words").alias("total_words"), ratio(c("words"), c("n"), False).alias("words_per_message"),
        ratio(c("chars"), c("n"), False).alias("chars_per_message"), c("emoji").alias("emoji_count"), ratio(c("emoji"), total("emoji")).alias("emoji_share"), c("links").alias("link_count"), ratio(c("links"), total("links")).alias("link_share"),
        ratio(c("weekends"), c("n")).alias("weekend_percentage"), ratio(c("late"), c("n")).alias("late_night_percentage"), F.coalesce("opened", F.lit(0)).alias("session_opener_count"), c("longest").alias("longest_message"), c("multiline").alias("multiline_count"), F.round(F.coalesce("gap", F.lit(0.0)), 2).alias("average_reply_gap"),
    )


def reply_gaps(m: DataFrame) -> DataFrame:
    return active(m).where("sender_id is not null").groupBy("archive_id", "sender_id").agg(F.round(F.coalesce(F.avg("reply_gap_minutes"), F.lit(0.0)), 2).alias("average_reply_gap"))


def monthly_split(m: DataFrame) -> DataFrame:
    """Months by senders, with zeros: the senders and months of one archive, so the grid is small. Messages are counted once."""
    return split_of(active(m).groupBy("archive_id", "month_key", "sender_id").agg(F.count("*").alias("n"), F.sum(late_night(F.col("hour_of_day")).cast("int")).alias("late")))


def split_of(counts: DataFrame) -> DataFrame:
    """monthly_split from (archive_id, month_key, sender_id, n, late)."""
    months = counts.groupBy("archive_id", "month_key").agg(F.sum("n").alias("total_messages"), F.sum("late").alias("late_night_count"))
    people = counts.where("sender_id is not null").select("archive_id", "sender_id").distinct()
    n = counts.drop("late")
    return months.join(people, "archive_id").join(n, ["archive_id", "month_key", "sender_id"], "left").select("archive_id", "month_key", "sender_id", "total_messages", "late_night_count", F.coalesce("n", F.lit(0)).alias("n"))


def month_winners(m: DataFrame) -> DataFrame:
    """The sender ahead in each month; a tie has no winner and no margin."""
    return winners_of(monthly_split(m))


def winners_of(split: DataFrame) -> DataFrame:
    w = Window.partitionBy("archive_id", "month_key").orderBy(F.desc("n"), "sender_id")
    ranked = split.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("n").over(w)).where("r = 1")
    tied = F.coalesce(F.col("n") == F.col("second"), F.lit(False))
    return ranked.select("archive_id", "month_key", F.when(~tied, F.col("sender_id")).alias("winner"), F.col("n").alias("winner_count"), F.when(tied, 0).otherwise(F.col("n") - F.coalesce("second", F.lit(0))).alias("margin"), "total_messages")


def late_night_trend(m: DataFrame) -> DataFrame:
    late = late_night(F.col("hour_of_day")).cast("int")
    return active(m).groupBy("archive_id", "month_key").agg(F.count("*").alias("total_messages"), F.sum(late).alias("late_night_messages"), ratio(F.sum(late), F.count("*")).alias("late_night_share"))


def late_night_by_sender(m: DataFrame) -> DataFrame:
    """Late-night messages of every listed sender in each month, zeros included."""
    a = active(m)
    counts = a.groupBy("archive_id", "month_key", "sender_id").agg(F.sum(late_night(F.col("hour_of_day")).cast("int")).alias("l"))
    months, senders = counts.select("archive_id", "month_key").distinct(), counts.where("sender_id is not null").select("archive_id", "sender_id").distinct()
    return months.join(senders, "archive_id").join(counts, ["archive_id", "month_key", "sender_id"], "left").select("archive_id", "month_key", "sender_id", F.coalesce("l", F.lit(0)).alias("late_night_messages"))


def dense(m: DataFrame, column: str, size: int) -> DataFrame:
    """Counts of active rows for every value below size, zeros included."""
    grid = m.select("archive_id").distinct().select("archive_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(column))
    return grid.join(count_by(active(m), column), ["archive_id", column], "left").select("archive_id", column, F.coalesce("n", F.lit(0)).alias("n"))


def window_extremes(m: DataFrame, k: int = 6, quiet: bool = False) -> DataFrame:
    """The weekday and hour windows with most active rows, or with fewest but some."""
    n = count_by(active(m), "weekday", "hour_of_day")
    return top_k(n, KEYS, [F.col("n") if quiet else F.desc("n"), "weekday", "hour_of_day"], k)


def highest_volume_days(m: DataFrame, k: int = 6) -> DataFrame:
    return top_k(daily_counts(m), KEYS, [F.desc("n"), "day_key"], k)


def emotion_timeline(a: DataFrame) -> DataFrame:
    """By week of active messages: mean intensity, the commonest emotion (the first met of equals), count. One pass by week and emotion."""
    each = active(a).groupBy("archive_id", "week_key", "emotion_label").agg(F.sum("emotion_intensity").alias("sum"), F.count("*").alias("n"), F.min("seq").alias("first"))
    first = F.min(F.struct(-F.col("n"), "first", "emotion_label"))["emotion_label"]
    return each.groupBy("archive_id", "week_key").agg(F.round(F.sum("sum") / F.sum("n"), 4).alias("mean_intensity"), first.alias("dominant_emotion"), F.sum("n").alias("n"))


def emotion_mix(a: DataFrame) -> DataFrame:
    """Counts by emotion, over all senders (sender_id `*`) and by sender, in one pass."""
    return active(a).select("archive_id", "emotion_label", F.explode(F.array(F.lit("*"), "sender_id")).alias("sender_id")).where("sender_id is not null").groupBy("archive_id", "sender_id", "emotion_label").agg(F.count("*").alias("n"))


def archetype_mix(a: DataFrame) -> DataFrame:
    """Counts by archetype tag, over all senders (sender_id `*`) and by sender, in one pass."""
    each = active(a).select("archive_id", F.explode("archetype_tags").alias("archetype"), F.array_compact(F.array(F.lit("*"), F.col("sender_id"))).alias("who"))
    return each.select("archive_id", "archetype", F.explode("who").alias("sender_id")).groupBy("archive_id", "sender_id", "archetype").agg(F.count("*").alias("n"))


def signals(a: DataFrame, by: str) -> DataFrame:
    return active(a).groupBy("archive_id", by).agg(*(F.sum(F.col(f"{s}_signal").cast("int")).alias(f"{s}_count") for s in ("support", "conflict", "repair")))


def distribution_by_sender(m: DataFrame, column: str, size: int) -> DataFrame:
    """(archive_id, sender_id, column, n): counts of active rows for every sender and value below size, zeros included."""
    a = active(m)
    grid = a.where("sender_id is not null").select("archive_id", "sender_id").distinct().select("archive_id", "sender_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(column))
    return grid.join(count_by(a, "sender_id", column), ["archive_id", "sender_id", column], "left").select("archive_id", "sender_id", column, F.coalesce("n", F.lit(0)).alias("n"))


def scope(rows: DataFrame, participant: str | None) -> DataFrame:
    """One participant's rows of a mix, or those over all (`*`) for None."""
    return rows.where(F.col("sender_id") == (participant or "*"))
