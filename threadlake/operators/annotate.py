"""Rule-based message annotation: keyword hits, labels, intensity and importance. Columns only, no shuffle.

Each keyword is searched for once a row, in one array; everything else reads that array. The results are
made by a generator of one row, below which Catalyst pushes no filter and writes no expression out again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions.labels import ARCHETYPES, BANTER, EMOTIONS, INSTITUTIONAL, INTIMACY, REPAIR, SUPPORT, TOPICS

#: All keywords, each once; "hurt" is a conflict sign of its own.
KEYWORDS = sorted({k for table in (EMOTIONS, ARCHETYPES, TOPICS) for words in table.values() for k in words} | {*SUPPORT, *REPAIR, *INTIMACY, *BANTER, *INSTITUTIONAL, "hurt"})
ANNOTATIONS = ["emotion_label", "archetype_tags", "topic_tags", "emotion_intensity", "support_signal", "conflict_signal", "repair_signal", "importance_score", "highlight_candidate", "milestone_candidate", "evidence_score"]


def keyword_hits(text: Column) -> Column:
    """Whether each of KEYWORDS occurs anywhere in the text. The outer array binds the text, which would else be made anew for each keyword."""
    return F.transform(F.array(text), lambda t: F.transform(F.lit(KEYWORDS), lambda k: t.contains(k)))[0]


def count_hits(hits: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur."""
    total = F.lit(0)
    for k in keywords:
        total = total + F.get(hits, KEYWORDS.index(k)).cast("int")
    return total


def tags(hits: Column, table: dict[str, list[str]], default: str) -> Column:
    found = F.array_sort(F.array_compact(F.array(*(F.when(count_hits(hits, words) > 0, F.lit(label)) for label, words in table.items()))))
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def rounded(c: Column, digits: int = 4) -> Column:
    """Half up by plain arithmetic, so that other engines give the same last digit."""
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def match_counts(messages: DataFrame) -> DataFrame:
    """(archive_id, seq, kind, label, n): how many of a label's keywords occur in each message, where any does."""
    m = messages.select("archive_id", "seq", keyword_hits(F.col("normalized_text")).alias("_hits"))
    tables = (("emotion", EMOTIONS), ("archetype", ARCHETYPES), ("topic", TOPICS))
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), count_hits(F.col("_hits"), words).alias("n")) for kind, t in tables for label, words in t.items()))
    return m.select("archive_id", "seq", F.inline(each)).where("n > 0")


def annotate(messages: DataFrame, empty_label: str = "romantic") -> DataFrame:
    """Add the annotation columns. A text without emotion keywords gets empty_label, the first of the label order."""
    hits, n = F.col("_hits"), F.least("word_count", F.lit(40))
    m = messages.withColumn("_hits", keyword_hits(F.col("normalized_text")))
    m = m.withColumns({f"_{e}": count_hits(hits, words) for e, words in EMOTIONS.items()} | {
        "archetype_tags": tags(hits, ARCHETYPES, "everyday_life"), "topic_tags": tags(hits, TOPICS, "daily_life"), "support_signal": count_hits(hits, SUPPORT) > 0, "_repair": count_hits(hits, REPAIR) > 0,
        "_hurt": F.get(hits, KEYWORDS.index("hurt")), "_near": count_hits(hits, INTIMACY) > 0, "_play": count_hits(hits, BANTER) > 0, "_formal": count_hits(hits, INSTITUTIONAL) > 0,
    })
    m = m.withColumn("_best", F.greatest(*(f"_{e}" for e in EMOTIONS)))
    label = F.lit(empty_label)
    for e in reversed(EMOTIONS):
        label = F.when((F.col("_best") > 0) & (F.col(f"_{e}") == F.col("_best")), e).otherwise(label)
    m = m.withColumn("emotion_label", label)
    # The weights and thresholds below.
    shout = F.when((F.col("char_count") > 4) & (F.col("text") == F.upper("text")), 0.12).otherwise(0.0)
    feeling = F.when(F.col("emotion_label") != "neutral", 0.18).otherwise(0.0)
    intensity = F.lit(0.15) + F.col("emoji_count") * 0.04 + F.regexp_count("text", F.lit("!")) * 0.04 + F.regexp_count("text", F.lit(r"\?")) * 0.03 + shout + feeling + n / 140.0
    m = m.withColumn("_intensity", clamp(intensity))
    m = m.withColumn("conflict_signal", (F.col("emotion_label") == "conflict") | F.array_contains("archetype_tags", "conflict") | F.col("_hurt"))
    m = m.withColumn("repair_signal", F.array_contains("archetype_tags", "repair_reconnection") | F.col("_repair"))
    gain = lambda c, v: F.when(c, v).otherwise(0.0)
    score = F.lit(0.15) + F.col("_intensity") * 0.45 + n / 120.0 + gain(F.col("support_signal"), 0.16) + gain(F.col("conflict_signal"), 0.18) + gain(F.col("repair_signal"), 0.18)
    score = score + gain(F.col("_near"), 0.2) + gain(F.col("_play"), 0.15) - gain(F.col("_formal"), 0.5) - gain(F.col("word_count") > 60, 0.3)
    m = m.withColumn("_importance", clamp(score))
    out = {
        "highlight_candidate": (F.col("message_type") == "text") & (F.col("_importance") >= 0.67) & F.col("word_count").between(4, 50),
        "milestone_candidate": (F.col("_importance") >= 0.78) | F.col("support_signal") | F.col("conflict_signal") | F.col("repair_signal") | F.array_contains("archetype_tags", "affection"),
        "emotion_intensity": rounded(F.col("_intensity")), "importance_score": rounded(F.col("_importance")), "evidence_score": rounded(F.lit(0.3) + F.col("_importance") * 0.7),
    }
    return m.select(*messages.columns, F.inline(F.array(F.struct(*(out.get(c, F.col(c)).alias(c) for c in ANNOTATIONS)))))


def annotate_with(messages: DataFrame, annotator: Callable[[DataFrame], DataFrame] = annotate) -> DataFrame:
    """The annotator is a parameter: any function of a DataFrame that keeps its rows and adds the columns of ANNOTATIONS."""
    out = annotator(messages)
    if missing := [c for c in [*messages.columns, *ANNOTATIONS] if c not in out.columns]:
        raise ValueError(f"the annotator's result lacks {', '.join(missing)}")
    return out
