"""Published tables: messages by month, and counts of rows that break a table's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions.labels import ARCHETYPES, TOPICS
from threadlake.operators.chunks import CHUNK_EMOTIONS
from threadlake.operators.records import iso

#: Types of messages.
TYPES = ["text", "media_omitted", "deleted", "system"]


def month_rows(placed: DataFrame) -> DataFrame:
    """The public columns of messages that have segment_no and chapter_no."""
    return placed.select(
        "archive_id", "month_key", "message_id", iso(F.col("ts")).alias("timestamp_local"), "sender_id", "sender_label", "message_type", "text", "technical_session_id",
        F.format_string("segment_%04d", "segment_no").alias("narrative_segment_id"), F.format_string("chapter_%03d", "chapter_no").alias("chapter_id"), "seq",
    )


def write_month_shards(placed: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines below archive_id=.../month_key=..., rows in order of seq.

    A shard is dealt to `files` files by ranges of seq (one by default), so that a very large one is no single task.
    """
    rows = month_rows(placed)
    by = ["archive_id", "month_key"]
    dealt = rows.repartition(*by) if files is None else rows.withColumn("_f", F.pmod(F.floor(F.col("seq") / 4096), F.lit(files))).repartition(*by, "_f").drop("_f")
    dealt.sortWithinPartitions(*by, "seq").drop("seq").write.partitionBy(*by).json(path)


def _within(c: str, low: float, high: float | None = None) -> Column:
    return ~F.coalesce((F.col(c) >= low) if high is None else F.col(c).between(low, high), F.lit(False))


def _among(c: str, labels: list[str]) -> Column:
    return (F.size(c) < 1) | F.exists(c, lambda x: ~x.isin(labels))


#: Of each table: rule -> what breaks it.
RULES = {
    "messages": lambda: {
        **{f"{c} not null": F.col(c).isNull() for c in ("message_id", "text", "normalized_text", "has_url", "is_multiline", "technical_session_id", "day_key", "week_key", "month_key")},
        "message_type among types": ~F.coalesce(F.col("message_type").isin(TYPES), F.lit(False)), **{f"{c} not negative": _within(c, 0) for c in ("char_count", "word_count", "emoji_count")},
        "hour_of_day within 0 to 23": _within("hour_of_day", 0, 23), "weekday within 0 to 6": _within("weekday", 0, 6),
    },
    "annotations": lambda: {
        "emotion_label among labels": ~F.coalesce(F.col("emotion_label").isin(CHUNK_EMOTIONS), F.lit(False)), **{f"{c} within 0 to 1": _within(c, 0, 1) for c in ("emotion_intensity", "importance_score", "evidence_score")},
        "topic_tags some, among labels": _among("topic_tags", list(TOPICS)), "archetype_tags some, among labels": _among("archetype_tags", list(ARCHETYPES)),
        **{f"{c} not null": F.col(c).isNull() for c in ("highlight_candidate", "milestone_candidate", "support_signal", "conflict_signal", "repair_signal")},
    },
    "sessions": lambda: {"message_count positive": _within("message_count", 1), "mean_importance within 0 to 1": _within("mean_importance", 0, 1), "density not negative": _within("density", 0)},
}


def validate_table(df: DataFrame, table: str) -> DataFrame:
    """(table_name, rule, checked, violations): one pass over the table."""
    rules = RULES[table]()
    sums = df.agg(F.count("*").alias("checked"), *(F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("long")), F.lit(0)).alias(f"v{i}") for i, bad in enumerate(rules.values())))
    each = F.inline(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations")) for i, rule in enumerate(rules))))
    return sums.select(F.lit(table).alias("table_name"), "checked", each)
