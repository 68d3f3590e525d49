"""Choosing what is shown: greedy selections under quotas, titles, lenses and previews.

A greedy selection depends on what was taken before, which no window can say. It is a fold over the ranked
rows of one archive, the fold's state being what it has taken. Before it go the rows that no state could
take: later ones of those that fill the same quotas. What is left grows with quotas, not with candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import display as D
from threadlake.functions.labels import ARCHETYPES
from threadlake.operators.narrative import topic_quotes
from threadlake.operators.ranking import top_k
from threadlake.operators.rollups import active

KEYS = ["archive_id"]
#: What a repeated title gets, the last again and again; and words for labels in a chapter's summary.
SUFFIXES = ["Revisited", "Later", "Again", "Afterward"]
ARCHETYPE_WORDS = {
    "affection": "overt affection", "planning": "shared plans", "humor_banter": "playful banter", "reassurance": "mutual reassurance", "conflict": "moments of friction", "repair_reconnection": "repair and reconnection",
    "longing_missing": "missing each other", "everyday_life": "everyday closeness", "future_imagining": "future-facing talk",
}
EMOTION_WORDS = {"romantic": "romantic", "supportive": "supportive", "funny": "light", "conflict": "tense", "nostalgic": "nostalgic", "neutral": "steady"}
#: Fixed values: (part of a title, what is said at its first occurrence, and later).
CHAPTER_LINES = [
    ("everyday gravity", "This was the part where the rhythm started to feel natural, steady, and full of care.", "The familiar rhythm was still able to feel new."),
    ("ordinary days", "Comfort and play started living side by side here, easy and unforced.", "By then, even the ordinary days carried their own softness."),
    ("shared routine", "This was the phase where the routine started carrying more warmth and meaning.", "Routine stopped feeling ordinary here; it started feeling settled."),
]


def greedy(ranked: DataFrame, keys: list[str], columns: list[str], limit: int, fits: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows taken, with `place` from 1: by rank, each that fits what was taken before, up to limit.

    columns are what fits(taken, row) looks at; a key's ranked rows are held together, so leave out by first_of what can't fit.
    """
    rows = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("_r"))
    take = lambda done, x: F.when((F.size(done) < limit) & fits(done, x), F.concat(done, F.array(x))).otherwise(done)
    taken = F.aggregate("_r", F.filter("_r", lambda x: F.lit(False)), take)
    kept = rows.select(*keys, F.posexplode(F.transform(taken, lambda x: x["rank"])).alias("_p", "rank"))
    return ranked.join(kept, [*keys, "rank"]).withColumn("place", F.col("_p") + 1).drop("_p")


def ranked_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_of(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each key; columns as they were."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= k).drop("_nth")


def below(done: Column, x: Column, column: str, most: int) -> Column:
    return F.size(F.filter(done, lambda y: y[column] == x[column])) < most


def diverse_highlights(h: DataFrame, limit: int = 6, free: int = 4) -> DataFrame:
    """Highlights by importance and mood; of one chapter or emotion no second before `free` are taken.

    The first `free` are a fold over the best of each chapter and emotion; what is taken after these is what follows them.
    """
    score = F.col("importance_score") + F.when(F.col("emotion_label").isin("romantic", "funny", "supportive"), 0.3).otherwise(0.0)
    c = h.where((F.col("importance_score") > 0.65) & F.length("text").between(10, 250)).withColumnRenamed("rank", "first_rank").withColumn("score", score)
    order = [F.desc("score"), "first_rank"]

    def fits(done: Column, x: Column) -> Column:
        new = lambda column: ~F.exists(done, lambda y: y[column] == x[column])
        return (x["chapter_no"].isNull() | new("chapter_no")) & new("emotion_label")

    early = first_of(c, [*KEYS, "chapter_no", "emotion_label"], order, 1)
    taken = greedy(ranked_by(early, KEYS, order), KEYS, ["chapter_no", "emotion_label"], min(limit, free), fits)
    full = taken.where(F.col("place") == free).select(*KEYS, F.col("score").alias("_score"), F.col("first_rank").alias("_first"))
    after = (F.col("score") < F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("first_rank") > F.col("_first")))
    later = top_k(c.join(full, KEYS).where(after).drop("_score", "_first"), KEYS, order, max(0, limit - free)).withColumn("place", F.col("rank") + free)
    return taken.unionByName(later)


def rated_highlights(h: DataFrame) -> DataFrame:
    clean = h.withColumn("display_quote", D.clean_display_text(F.col("text")))
    c = F.col("display_quote")
    return clean.withColumn("quality", D.highlight_quality(F.col("importance_score"), c, F.col("archetype_tags"), F.col("emotion_label"))).withColumn("low_value", D.low_value(c))


def curate_highlights(h: DataFrame, limit: int = 12, max_chars: int = 170, per_chapter: int = 2, per_sender: int = 2, keys: list[str] = KEYS) -> DataFrame:
    """Highlights worth showing, best first, within quotas of chapter and sender and without a repeated excerpt.

    Of one chapter, sender and excerpt only the first can be taken; of one chapter and sender as many as the smaller
    quota, after at most `limit` whose excerpt is taken already.
    """
    r = rated_highlights(h).where(~F.col("low_value") & (F.col("quality") > 20)).withColumn("excerpt", D.cut_text(F.col("display_quote"), max_chars))
    r = r.withColumn("_c", F.coalesce(F.col("chapter_no").cast("string"), F.lit("unassigned"))).withColumn("_s", F.coalesce("sender_label", "sender_id", F.lit("system"))).withColumnRenamed("rank", "first_rank")
    order, pair = [F.desc("quality"), "first_rank"], [*keys, "_c", "_s"]
    r = first_of(first_of(r, [*pair, "excerpt"], order, 1), pair, order, limit + min(per_chapter, per_sender))
    return greedy(ranked_by(r, keys, order), keys, ["_c", "_s", "excerpt"], limit, lambda done, x: below(done, x, "_c", per_chapter) & below(done, x, "_s", per_sender) & below(done, x, "excerpt", 1)).drop("_c", "_s")


def rated_milestones(m: DataFrame) -> DataFrame:
    """With display title, summary, quote and quality."""
    clean = m.withColumn("clean_quote", D.clean_display_text(F.col("text"))).withColumn("display_title", D.milestone_title(F.col("title"), F.col("summary"), F.col("text"), F.col("milestone_type")))
    c = F.col("clean_quote")
    out = clean.withColumn("short_summary", D.milestone_summary(F.col("display_title"), F.col("summary"), F.col("ts"))).withColumn("display_quote", D.milestone_quote(c))
    return out.withColumn("quality", D.milestone_quality(F.col("importance_score"), c, F.col("milestone_type"))).withColumn("low_value", D.low_value(c)).withColumn("career", D.has_career(c))


def curate_milestones(m: DataFrame, limit: int = 8, per_chapter: int = 2, same_title: int = 1, careers: bool = False, keys: list[str] = KEYS) -> DataFrame:
    keep = ~F.col("low_value") | F.col("career") if careers else ~F.col("low_value")
    r = rated_milestones(m).where(keep & (F.col("quality") > 10)).withColumnRenamed("rank", "first_rank")
    r = r.withColumn("_c", F.coalesce(F.col("chapter_no").cast("string"), F.lit("unassigned"))).withColumn("_t", F.lower(F.trim("display_title")))
    order = [F.desc("quality"), "first_rank"]
    r = first_of(r, [*keys, "_c", "_t"], order, min(per_chapter, same_title))  # later ones find a quota full
    return greedy(ranked_by(r, keys, order), keys, ["_c", "_t"], limit, lambda done, x: below(done, x, "_c", per_chapter) & below(done, x, "_t", same_title)).drop("_c", "_t")


def curate_topic_clusters(clusters: DataFrame, quotes: DataFrame, limit: int = 6, least: int = 20) -> DataFrame:
    """Clusters (rank, topic, n) of more than `least` messages whose first five quotes are worth showing."""
    five = quotes.where("rank <= 5").groupBy("archive_id", "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("said"))
    some = clusters.where(F.col("n") > least).join(five, ["archive_id", "topic"]).where(~D.is_low_value_text(F.col("said"))).withColumnRenamed("rank", "first_rank")
    return top_k(some, KEYS, ["first_rank"], limit).drop("said", "first_rank")


def topic_chips(clusters: DataFrame, quotes: DataFrame, k: int = 3, chars: int = 38) -> DataFrame:
    """(archive_id, topic, place, chip): the first k of five quotes of each shown cluster that are worth it."""
    q = quotes.where("rank <= 5").withColumn("clean", D.clean_display_text(F.col("text"))).where((F.col("clean") != "") & ~D.low_value(F.col("clean"))).withColumnRenamed("rank", "first_rank")
    q = q.join(clusters.select("archive_id", "topic"), ["archive_id", "topic"], "left_semi")
    return top_k(q, ["archive_id", "topic"], ["first_rank"], k, "place").select("archive_id", "topic", "place", D.cut_text(F.col("clean"), chars).alias("chip"))


def decorate_titles(items: DataFrame, order: str) -> DataFrame:
    """display_title and occurrence: a title's second and later occurrences get a suffix."""
    n = F.row_number().over(Window.partitionBy("archive_id", "title").orderBy(order))
    suffix = F.element_at(F.lit(SUFFIXES), F.least(F.col("occurrence") - 1, F.lit(len(SUFFIXES))))
    out = items.withColumn("occurrence", n)
    return out.withColumn("display_title", F.when(F.col("occurrence") > 1, F.concat("title", F.lit(": "), suffix)).otherwise(F.col("title")))


def differentiate_titles(items: DataFrame) -> DataFrame:
    """Titles shared by two or more items of an archive, in any case, get the month."""
    n = F.count("*").over(Window.partitionBy("archive_id", F.lower(F.trim("display_title"))))
    month = F.concat("display_title", F.lit(" • "), F.date_format("ts", "MMM yyyy"))
    return items.withColumn("display_title", F.when(n >= 2, month).otherwise(F.col("display_title")))


def _words(label: Column, table: dict[str, str]) -> Column:
    out = F.regexp_replace(label, "_", " ")
    for k, v in table.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def summarize_chapters(chapters: DataFrame) -> DataFrame:
    """A line for each decorated chapter, as `line`."""
    title = F.lower(D.clean_display_text(F.col("display_title")))
    mood, a, b = _words(F.col("dominant_emotion"), EMOTION_WORDS), _words(F.get("archetypes", 0), ARCHETYPE_WORDS), _words(F.get("archetypes", 1), ARCHETYPE_WORDS)
    two = F.concat(F.lit("A "), mood, F.lit(" stretch full of "), a, F.lit(" and "), b, F.lit("."))
    one, none = F.concat(F.lit("A "), mood, F.lit(" stretch carried by "), a, F.lit(".")), F.concat(F.lit("A "), mood, F.lit(" stretch with its own rhythm and quiet turning points."))
    line = F.when(F.size("archetypes") == 0, none).when(F.size("archetypes") == 1, one).otherwise(two)
    line = F.when(~D.matches(F.col("summary"), D.GENERIC_SUMMARY), D.build_excerpt(F.col("summary"), 110)).otherwise(line)
    for part, first, later in reversed(CHAPTER_LINES):
        line = F.when(title.contains(part), F.when(F.col("occurrence") > 1, later).otherwise(first)).otherwise(line)
    return chapters.withColumn("line", line)


def previews(rows: DataFrame, k: int) -> DataFrame:
    """The first k ranked rows of each chapter."""
    return top_k(rows.where("chapter_no is not null").withColumnRenamed("rank", "first_rank"), ["archive_id", "chapter_no"], ["first_rank"], k)


def chapter_links(chapters: DataFrame, highlights: DataFrame, milestones: DataFrame, highlight_limit: int = 8, milestone_limit: int = 5) -> DataFrame:
    """Chapters with highlight_ids and milestone_ids: the first ranked ones that lie in each, comma-joined; empty where none does."""
    by = ["archive_id", "chapter_no"]

    def ids(rows: DataFrame, name: str, k: int) -> DataFrame:
        listed = F.array_sort(F.collect_list("first_rank"))
        return previews(rows, k).groupBy(*by).agg(F.array_join(F.transform(listed, lambda r: F.format_string(f"{name}_%04d", r)), ",").alias(f"{name}_ids"))

    out = chapters.join(ids(highlights, "highlight", highlight_limit), by, "left").join(ids(milestones, "milestone", milestone_limit), by, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("highlight_ids", "milestone_ids")})


def homepage_intro(m: DataFrame) -> DataFrame:
    """(archive_id, subtitle, time_span): whom an archive is by, in order of first sight, and its first and last month."""
    whole = m.groupBy("archive_id").agg(F.min_by("ts", "seq").alias("_from"), F.max_by("ts", "seq").alias("_to"))
    people = m.where("sender_label is not null").groupBy("archive_id", "sender_label").agg(F.min("seq").alias("seen"))
    named = people.groupBy("archive_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "sender_label"))), lambda x: x["sender_label"]), " and ").alias("_who"))
    subtitle = F.concat(F.lit("A curated journey through "), F.coalesce("_who", F.lit("")), F.lit(" across messages, moods, and milestones."))
    span = F.concat(F.date_format("_from", "MMM yyyy"), F.lit(" to "), F.date_format("_to", "MMM yyyy"))
    return whole.join(named, "archive_id", "left").select("archive_id", subtitle.alias("subtitle"), F.coalesce(span, F.lit("Conversation timeline")).alias("time_span"))


def homepage(chosen: DataFrame, milestones: DataFrame, chapters: DataFrame, milestone_limit: int = 4, chapter_limit: int = 5) -> DataFrame:
    """(archive_id, kind, place, item, title): an archive's first page, row by row."""
    high = chosen.select("archive_id", F.lit("highlight").alias("kind"), "place", F.format_string("msg_%07d", F.col("seq") + 1).alias("item"), F.col("text").alias("title"))
    stones = milestones.where(F.col("rank") <= milestone_limit).select("archive_id", F.lit("milestone").alias("kind"), F.col("rank").alias("place"), F.col("milestone_id").alias("item"), "title")
    parts = chapters.where(F.col("chapter_no") <= chapter_limit).select("archive_id", F.lit("chapter").alias("kind"), F.col("chapter_no").cast("int").alias("place"), F.col("chapter_id").alias("item"), "title")
    return high.unionByName(stones).unionByName(parts)


def story_lenses(a: DataFrame, emotions: int = 3, topics: int = 4) -> DataFrame:
    """One row an archive and archetype: messages, share of all, and its commonest emotions and topics (`label:count`, ties by first sight)."""
    grid = a.select("archive_id").distinct().select("archive_id", F.explode(F.lit(list(ARCHETYPES))).alias("archetype"))
    row = lambda kind, label, i: F.struct(F.lit(kind).alias("kind"), label.alias("label"), i.cast("int").alias("pos"))
    each = a.select("archive_id", "seq", "topic_tags", "emotion_label", F.explode("archetype_tags").alias("archetype"))
    each = each.select("archive_id", "archetype", "seq", F.inline(F.concat(F.array(row("emotion", F.col("emotion_label"), F.lit(0))), F.transform("topic_tags", lambda x, i: row("topic", x, i)))))
    counts = each.groupBy("archive_id", "archetype", "kind", "label").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("seen"))
    per = counts.groupBy("archive_id", "archetype").agg(F.sum(F.when(F.col("kind") == "emotion", F.col("n"))).alias("n"), F.collect_list(F.struct("kind", (-F.col("n")).alias("m"), "seen", "label")).alias("all"))
    top = lambda kind, k: F.slice(F.array_sort(F.filter("all", lambda x: x["kind"] == kind)), 1, k)
    listed = lambda kind, k: F.array_join(F.transform(top(kind, k), lambda x: F.concat(x["label"], F.lit(":"), (-x["m"]).cast("string"))), ",")
    total = a.groupBy("archive_id").agg(F.count("*").alias("total"))
    out = grid.join(per, ["archive_id", "archetype"], "left").join(total, "archive_id")
    return out.select(
        "archive_id", "archetype", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("share"), F.coalesce(F.get(top("emotion", 1), 0)["label"], F.lit("neutral")).alias("dominant_emotion"),
        F.coalesce(listed("emotion", emotions), F.lit("")).alias("top_emotions"), F.coalesce(listed("topic", topics), F.lit("")).alias("top_topics"),
    )


def by_lens(rows: DataFrame) -> DataFrame:
    """Each row once for every archetype it carries."""
    return rows.withColumn("archetype", F.explode("archetype_tags"))


def lens_highlights(h: DataFrame) -> DataFrame:
    return curate_highlights(by_lens(h), 5, 150, 2, 3, ["archive_id", "archetype"])


def lens_milestones(m: DataFrame) -> DataFrame:
    return curate_milestones(by_lens(m), 4, 2, 2, True, ["archive_id", "archetype"])


def lens_chapters(highlights: DataFrame, milestones: DataFrame) -> DataFrame:
    """(archive_id, archetype, chapter_no, weight) of what the lenses show: 1 a highlight, 2 a milestone."""
    one = highlights.select("archive_id", "archetype", "chapter_no", F.lit(1).alias("w")).unionByName(milestones.select("archive_id", "archetype", "chapter_no", F.lit(2).alias("w")))
    return one.where("chapter_no is not null").groupBy("archive_id", "archetype", "chapter_no").agg(F.sum("w").alias("weight"))


def lens_motifs(hinted: DataFrame, k: int = 8) -> DataFrame:
    some = hinted.where("archetype_hint is not null").withColumnRenamed("rank", "first_rank")
    return top_k(some, ["archive_id", "archetype_hint"], ["first_rank"], k)


def archetype_share(a: DataFrame, k: int = 6) -> DataFrame:
    """An archive's commonest archetype tags of active messages with their share of all tags."""
    c = active(a).select("archive_id", "seq", F.posexplode("archetype_tags").alias("pos", "archetype")).groupBy("archive_id", "archetype").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("seen"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("archive_id")), 6)
    return top_k(c.withColumn("share", share), KEYS, [F.desc("n"), "seen"], k).drop("seen")


def display_motifs(motifs: DataFrame, least: int = 20, words: int = 5, k: int = 10) -> DataFrame:
    some = motifs.where((F.col("n") >= least) & (F.size(F.split("label", " ")) <= words)).withColumnRenamed("rank", "first_rank")
    return top_k(some, KEYS, ["first_rank"], k).drop("first_rank")


def book_milestones(m: DataFrame) -> DataFrame:
    """One a chapter: of the book's five the earliest, else the chapter's best."""
    five = curate_milestones(m, 5, 2, 1, True).withColumn("source", F.lit(0)).withColumn("order", F.row_number().over(Window.partitionBy("archive_id").orderBy("ts", "place")))
    own = curate_milestones(m.where("chapter_no is not null"), 1, 1, 1, True, ["archive_id", "chapter_no"]).withColumn("source", F.lit(1)).withColumn("order", F.lit(1))
    both = five.unionByName(own).where("chapter_no is not null").drop("rank")
    return top_k(both, ["archive_id", "chapter_no"], ["source", "order"], 1)


def book_highlights(h: DataFrame) -> DataFrame:
    return curate_highlights(h.where("chapter_no is not null"), 1, 88, 1, 1, ["archive_id", "chapter_no"])


def closing_quote(h: DataFrame) -> DataFrame:
    """The best warm highlight of an archive, else its best one."""
    warm = F.col("emotion_label").isin("romantic", "supportive") | F.array_contains("archetype_tags", "repair_reconnection")
    best = [curate_highlights(x, 1, 120, 1, 1).withColumn("source", F.lit(i)).drop("rank") for i, x in enumerate((h.where(warm), h))]
    return top_k(best[0].unionByName(best[1]), KEYS, ["source"], 1)


def topic_page(a: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shown clusters and their chips."""
    quotes = topic_quotes(a)
    shown = curate_topic_clusters(clusters, quotes)
    return shown, topic_chips(shown, quotes)
