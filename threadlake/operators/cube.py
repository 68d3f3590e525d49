"""Messages counted in cells of a session, sender, day and hour, written once; the people, time and record tables are sums of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions.text import late_night, weekend
from threadlake.operators.rollups import active, ratio
from threadlake.sources.store import written

CELL = ["archive_id", "session_no", "sender_id", "day_key", "week_key", "month_key", "weekday", "hour_of_day"]
#: Columns of a message that its cell or its support for a record needs; signals only where it is annotated.
NARROW = [*CELL, "seq", "message_type", "word_count", "char_count", "emoji_count", "has_url", "is_multiline", "reply_gap_minutes"]
SIGNALS = ["support_signal", "conflict_signal", "repair_signal"]


def time_cube(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active messages without their texts, their cells), both written: messages are read, numbered and annotated once.

    A cell is the finest grain that all tables of counts share: any of them is a second sum over cells, of which there
    are at most as many as hours in which a sender spoke. Cells are counted a task before they are shuffled, and their key
    splits an archive of any share of all rows. Null senders and times have cells of their own. Means are kept as sum and count.
    Signals are 0 where the messages are not annotated.
    """
    has = [c for c in SIGNALS if c in m.columns]
    rows = written(active(m).select(*NARROW, *has))
    n = lambda c: F.sum(F.col(c).cast("int"))
    signals = [(n(c) if c in has else F.lit(0).cast("long")).alias(c.removesuffix("_signal")) for c in SIGNALS]
    cells = rows.groupBy(*CELL).agg(
        F.count("*").alias("n"), F.sum("word_count").alias("words"), F.sum("char_count").alias("chars"), F.sum("emoji_count").alias("emoji"), n("has_url").alias("links"), n("is_multiline").alias("multiline"),
        F.max("char_count").alias("longest"), F.sum("reply_gap_minutes").alias("gap_sum"), F.count("reply_gap_minutes").alias("gap_n"), F.min("seq").alias("seen"), *signals,
    )
    return rows, written(cells)


def messages_where(condition: Column) -> Column:
    """The sum of messages in cells of which the condition holds; null where it is null of all."""
    return F.sum(condition.cast("int") * F.col("n"))


def sender_totals(cube: DataFrame) -> DataFrame:
    """As rollups.sender_totals."""
    sums = [F.sum(c).alias(c) for c in ("n", "words", "chars", "emoji", "links", "multiline")]
    return cube.where("sender_id is not null").groupBy("archive_id", "sender_id").agg(
        *sums, messages_where(weekend(F.col("weekday"))).alias("weekends"), messages_where(late_night(F.col("hour_of_day"))).alias("late"), F.max("longest").alias("longest"), F.try_divide(F.sum("gap_sum").cast("double"), F.sum("gap_n").cast("double")).alias("gap"),
    )


def session_openers(cube: DataFrame) -> DataFrame:
    """As rollups.session_openers: the sender of the cell that holds a session's first message."""
    first = cube.groupBy("archive_id", "session_no").agg(F.min_by("sender_id", "seen").alias("sender_id"))
    return first.groupBy("archive_id", "sender_id").agg(F.count("*").alias("n"))


def first_seen(cube: DataFrame) -> DataFrame:
    return cube.where("sender_id is not null").groupBy("archive_id", "sender_id").agg(F.min("seen").alias("seen"))


def month_counts(cube: DataFrame) -> DataFrame:
    """(archive_id, month_key, sender_id, n, late), from which rollups.split_of makes the split."""
    return cube.groupBy("archive_id", "month_key", "sender_id").agg(F.sum("n").alias("n"), messages_where(late_night(F.col("hour_of_day"))).alias("late"))


def late_night_trend(cube: DataFrame) -> DataFrame:
    """As rollups.late_night_trend."""
    months = month_counts(cube).groupBy("archive_id", "month_key").agg(F.sum("n").alias("total_messages"), F.sum("late").alias("late_night_messages"))
    return months.withColumn("late_night_share", ratio(F.col("late_night_messages"), F.col("total_messages")))
