"""Rules of tables, written as data: compiled to one aggregate a table, and to SQL that counts the same."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions.labels import ARCHETYPES, TOPICS
from threadlake.operators.chunks import CHUNK_EMOTIONS


@dataclass(frozen=True)
class Rule:
    """What a value must be: within low and high, of the labels, a list of `least` or more values (each as `each` says), a map of
    such values, or a row whose fields keep their own rules. Null breaks a rule unless `null` allows it.
    """

    low: float | None = None
    high: float | None = None
    labels: tuple[str, ...] = ()
    each: Rule | None = None
    least: int = 0
    values: Rule | None = None
    fields: dict[str, Rule] = field(default_factory=dict)
    null: bool = False

    def __str__(self) -> str:
        parts = [f"{word} {bound:g}" for word, bound in (("at least", self.low), ("at most", self.high)) if bound is not None] + [f"among {len(self.labels)} labels"] * bool(self.labels)
        parts += [f"{self.least} or more, each {self.each}"] * bool(self.each) + [f"values {self.values}"] * bool(self.values) + [f"{k}: {r}" for k, r in self.fields.items()]
        return ", ".join([*parts, "null allowed" if self.null else "not null"])

    def broken(self, c: Column) -> Column:
        """Whether a value breaks the rule; never null."""
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (c < self.low)
        if self.high is not None:
            bad = bad | (c > self.high)
        if self.labels:
            bad = bad | ~c.isin(list(self.labels))
        if self.each:
            bad = bad | (F.size(c) < self.least) | F.exists(c, self.each.broken)
        if self.values:
            bad = bad | F.exists(F.map_values(c), self.values.broken)
        for k, r in self.fields.items():
            bad = bad | r.broken(c[k])
        return F.when(c.isNull(), F.lit(not self.null)).otherwise(bad)

    def sql(self, c: str, depth: int = 0) -> str:
        """The same in SQL."""
        x = f"x{depth}"
        bad = [f"{c} < {self.low}"] * (self.low is not None) + [f"{c} > {self.high}"] * (self.high is not None)
        if self.labels:
            bad.append(f"{c} NOT IN ({', '.join(repr(v) for v in self.labels)})")
        if self.each:
            bad.append(f"len({c}) < {self.least} OR len(list_filter({c}, lambda {x}: {self.each.sql(x, depth + 1)})) > 0")
        if self.values:
            bad.append(f"len(list_filter(map_values({c}), lambda {x}: {self.values.sql(x, depth + 1)})) > 0")
        bad += [r.sql(f"{c}.{k}", depth + 1) for k, r in self.fields.items()]
        return f"(CASE WHEN {c} IS NULL THEN {str(not self.null).lower()} ELSE {' OR '.join(f'({b})' for b in bad) or 'false'} END)"


TEXT, MAYBE, SHARE, PART = Rule(), Rule(null=True), Rule(0, 100), Rule(0, 1)
COUNT, SOME = Rule(low=0), Rule(low=1)
EMOTION, ARCHETYPE, TOPIC = (Rule(labels=tuple(x)) for x in (CHUNK_EMOTIONS, ARCHETYPES, TOPICS))
EMOTION_LIST, ARCHETYPE_LIST, TOPIC_LIST = (Rule(each=r, least=1) for r in (EMOTION, ARCHETYPE, TOPIC))
IDS, SOME_IDS = Rule(each=TEXT), Rule(each=TEXT, least=1)
HEAT = {"weekday": Rule(0, 6), "hour_of_day": Rule(0, 23), "n": COUNT}

#: Of each table, column -> rule.
TABLES: dict[str, dict[str, Rule]] = {
    "participants": {"participant_id": TEXT, "label": TEXT, "message_count": COUNT, "first_message_id": MAYBE},
    "chunk_manifest": {"chunk_no": SOME, "first_seq": COUNT, "last_seq": COUNT, "n": SOME, "first_ts": TEXT, "last_ts": TEXT, "session_ids": IDS},
    "chunk_hashes": {"chunk_no": SOME, "chunk_hash": TEXT, "message_ids": IDS},
    "chunk_annotations": {"emotions": EMOTION_LIST, "topics": TOPIC_LIST, "archetypes": ARCHETYPE_LIST, "highlights": IDS, "milestones": IDS, "turns": IDS, "summary": TEXT},
    "session_summaries": {"first_seq": COUNT, "last_seq": COUNT, "message_count": SOME, "dominant_emotion": EMOTION, "topics": TOPIC_LIST, "archetypes": ARCHETYPE_LIST, "mean_importance": PART, "density": COUNT},
    "session_senders": {"session_no": SOME, "sender_id": TEXT, "n": COUNT},
    "segment_summary": {"segment_no": SOME, "first_session": SOME, "sessions": SOME, "message_count": SOME, "dominant_emotion": EMOTION, "dominant_archetype": ARCHETYPE, "conflict_repair_cycle": TEXT},
    "segment_annotations": {"title": TEXT, "summary": TEXT, "topics": TOPIC_LIST, "archetypes": ARCHETYPE_LIST, "turning_point": TEXT},
    "highlights": {"seq": COUNT, "importance_score": PART},
    "milestones": {"milestone_type": TEXT, "seq": COUNT, "segment_no": Rule(low=1, null=True), "importance_score": PART},
    "milestone_display": {"milestone_id": TEXT, "title": TEXT, "summary": TEXT, "segment_no": Rule(low=1, null=True), "chapter_no": Rule(low=1, null=True)},
    "chapter_texts": {"chapter_id": TEXT, "slug": TEXT, "title": TEXT, "summary": TEXT, "dominant_emotion": EMOTION, "topics": TOPIC_LIST, "archetypes": ARCHETYPE_LIST},
    "chapter_summary": {"first_segment": SOME, "segments": SOME, "message_count": SOME},
    "topic_clusters": {"topic": TOPIC, "n": SOME},
    "topic_quotes": {"topic": TOPIC, "seq": COUNT, "text": TEXT},
    "phrase_motifs": {"phrase": TEXT, "label": TEXT, "n": SOME},
    "motif_hints": {"phrase": TEXT, "n": SOME, "archetype_hint": Rule(labels=ARCHETYPE.labels, null=True)},
    "inside_jokes": {"phrase": TEXT, "n": SOME},
    "emotion_timeline": {"week_key": TEXT, "mean_intensity": PART, "dominant_emotion": EMOTION, "n": COUNT},
    "frequency_summary": {"total_messages": COUNT, "active_days": COUNT, "mean_per_day": COUNT},
    "daily_counts": {"day_key": TEXT, "n": COUNT},
    "heatmap_bins": HEAT,
    "participant_overview": {"sender_id": TEXT, "total_messages": COUNT, "total_words": COUNT, "emoji_count": COUNT, "link_count": COUNT, "multiline_count": COUNT, "session_opener_count": COUNT, "longest_message": COUNT, "words_per_message": COUNT, "chars_per_message": COUNT,
                             "average_reply_gap": COUNT, **{c: SHARE for c in ("message_share", "emoji_share", "link_share", "weekend_percentage", "late_night_percentage")}},
    "message_frequency": {"summary": Rule(fields={"total_messages": COUNT, "active_days": COUNT, "mean_per_day": COUNT}), "daily_counts": Rule(each=Rule(fields={"day_key": TEXT, "n": COUNT})), "heatmap_bins": Rule(each=Rule(fields=HEAT))},
}


def count_broken(df: DataFrame, table: str, rules: dict[str, Rule] | None = None) -> DataFrame:
    """(table_name, rule, checked, violations) of a table, in one aggregate. A column that the table lacks is broken in every row."""
    rules = TABLES[table] if rules is None else rules
    bad = [rules[c].broken(F.col(c)) if c in df.columns else F.lit(True) for c in rules]
    sums = df.agg(F.count("*").alias("checked"), *(F.coalesce(F.sum(b.cast("long")), F.lit(0)).alias(f"v{i}") for i, b in enumerate(bad)))
    each = F.inline(F.array(*(F.struct(F.lit(f"{c} {r}").alias("rule"), F.col(f"v{i}").alias("violations")) for i, (c, r) in enumerate(rules.items()))))
    return sums.select(F.lit(table).alias("table_name"), "checked", each)


def count_orphans(df: DataFrame, table: str, keys: list[str], other: DataFrame, other_table: str, other_keys: list[str] | None = None) -> DataFrame:
    """(table_name, rule, checked, violations): rows whose keys no row of the other table has; nulls have nothing to be found."""
    theirs = other.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(other_keys or keys))).distinct().withColumn("_found", F.lit(True))
    match = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(keys)]
    given = F.lit(True)
    for c in keys:
        given = given & F.col(c).isNotNull()
    joined = df.select(*keys).where(given).join(theirs, match, "left")
    sums = joined.agg(F.count("*").alias("checked"), F.count(F.when(F.col("_found").isNull(), 1)).alias("violations"))
    return sums.select(F.lit(table).alias("table_name"), F.lit(f"{', '.join(keys)} in {other_table}").alias("rule"), "checked", "violations")
