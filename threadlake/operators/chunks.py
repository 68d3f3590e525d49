"""Chunks of messages for annotators that look at more than one message: hashes, summaries, merging and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.labels import ARCHETYPES, CHUNK_OVERLAP, CHUNK_SIZE, TOPICS
from threadlake.operators.annotate import annotate, rounded
from threadlake.operators.ranking import top_k
from threadlake.operators.sessions import chunk_windows

KEYS = ["archive_id", "chunk_no"]
#: The order in which labels of equal count stand.
CHUNK_EMOTIONS = ["romantic", "supportive", "funny", "neutral", "conflict", "nostalgic"]


def in_chunks(rows: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Each row once for every chunk that holds it, with chunk_no: by arithmetic on seq, nothing joined."""
    return chunk_windows(rows, size=size, overlap=overlap, columns=[c for c in rows.columns if c not in ("archive_id", "seq")])


def chunk_hashes(m: DataFrame) -> DataFrame:
    """(archive_id, chunk_no, n, chunk_hash, message_ids): SHA-256 of the JSON list of a chunk's ids and normalised texts.

    A chunk has at most CHUNK_SIZE messages, which is what is gathered.
    """
    c = in_chunks(m.select("archive_id", "seq", "message_id", "normalized_text"))
    rows = F.array_sort(F.collect_list(F.struct("seq", "message_id", "normalized_text")))
    per = c.groupBy(*KEYS).agg(rows.alias("r"))
    text = F.to_json(F.transform("r", lambda x: F.struct(x["message_id"].alias("message_id"), x["normalized_text"].alias("text"))))
    return per.select(*KEYS, F.size("r").alias("n"), F.sha2(text, 256).alias("chunk_hash"), F.array_join(F.transform("r", lambda x: x["message_id"]), ",").alias("message_ids"))


def _top_labels(counted: Column, kind: str, labels: list[str], k: int) -> Column:
    """The k commonest labels; ties, and labels that don't occur, go by the order of labels."""
    n = lambda label: F.aggregate(F.filter(counted, lambda x: (x["kind"] == kind) & (x["label"] == label)), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    ranked = F.array_sort(F.transform(F.lit(labels), lambda label, i: F.struct((-n(label)).alias("m"), i.alias("i"), label.alias("label"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["label"])


def chunk_annotations(a: DataFrame) -> DataFrame:
    """One row a chunk: its commonest labels, candidates by importance, turns of mood, and a summary.

    A turn is a message whose emotion differs from the one before it in the chunk, where either is of importance 0.7.
    """
    c = in_chunks(a.select("archive_id", "seq", "message_id", "emotion_label", "importance_score", "topic_tags", "archetype_tags", "highlight_candidate", "milestone_candidate"))
    row = lambda kind, label: F.struct(F.lit(kind).alias("kind"), label.alias("label"))
    each = c.select(*KEYS, F.inline(F.concat(F.array(row("emotion", F.col("emotion_label"))), F.transform("topic_tags", lambda x: row("topic", x)), F.transform("archetype_tags", lambda x: row("archetype", x)))))
    counted = each.groupBy(*KEYS, "kind", "label").agg(F.count("*").alias("n")).groupBy(*KEYS).agg(F.collect_list(F.struct("kind", "label", "n")).alias("all"))
    tops = counted.select(*KEYS, *(_top_labels(F.col("all"), kind, list(labels), 3).alias(name) for name, kind, labels in (("emotions", "emotion", CHUNK_EMOTIONS), ("topics", "topic", TOPICS), ("archetypes", "archetype", ARCHETYPES))))
    w = Window.partitionBy(*KEYS).orderBy("seq")
    turned = (F.lag("emotion_label").over(w) != F.col("emotion_label")) & ((F.col("importance_score") >= 0.7) | (F.lag("importance_score").over(w) >= 0.7))
    c = c.withColumn("turned", F.coalesce(turned, F.lit(False)))
    picks = F.array_compact(F.array(*(F.when(F.col(flag), F.struct(F.lit(kind).alias("kind"), order.cast("double").alias("order"))) for flag, kind, order in (
        ("highlight_candidate", "highlights", -F.col("importance_score")), ("milestone_candidate", "milestones", -F.col("importance_score")), ("turned", "turns", F.col("seq"))))))
    picked = top_k(c.select(*KEYS, "seq", "message_id", F.inline(picks)), [*KEYS, "kind"], ["order", "seq"], 5).where("kind <> 'milestones' or rank <= 4")
    listed = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "message_id")))), lambda x: x["message_id"]), ",").alias(kind)
    ids = picked.groupBy(*KEYS).agg(*(listed(k) for k in ("highlights", "milestones", "turns")))
    out = tops.join(ids, KEYS, "left")
    summary = F.concat(F.format_string("Chunk chunk_%05d leaned ", "chunk_no"), F.get("emotions", 0), F.lit(" with "), F.get("archetypes", 0), F.lit(" exchanges and "), F.get("topics", 0), F.lit(" themes."))
    return out.select(*KEYS, *(F.array_join(c, ",").alias(c) for c in ("emotions", "topics", "archetypes")), *(F.coalesce(c, F.lit("")).alias(c) for c in ("highlights", "milestones", "turns")), summary.alias("summary"))


#: What observations of a message carry, besides (archive_id, seq, chunk_no).
MEANS, FLAGS, TAGS = ["emotion_intensity", "importance_score", "evidence_score"], ["highlight_candidate", "milestone_candidate", "support_signal", "conflict_signal", "repair_signal"], ["topic_tags", "archetype_tags"]


def merge_annotations(observed: DataFrame) -> DataFrame:
    """One row a message from its observations in chunks, taken in order of chunk_no.

    Scores are running means, rounded to 4 digits at each step; tags and chunks are united as met; flags
    are true where any is; the label is that of the last observation at least as important as the mean
    with it. A message has an observation for each chunk that holds it: two with the usual overlap.
    """
    fields = ["chunk_no", "emotion_label", *MEANS, *FLAGS, *TAGS]
    per = observed.groupBy("archive_id", "seq").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("o"))
    first = F.get("o", 0)
    start = F.struct(F.lit(1.0).alias("n"), first["emotion_label"].alias("emotion_label"), *(first[c].cast("double").alias(c) for c in MEANS), *(first[c].alias(c) for c in FLAGS + TAGS), F.array(first["chunk_no"]).alias("chunks"))

    def step(s: Column, x: Column) -> Column:
        mean = {c: rounded((s[c] * s["n"] + x[c]) / (s["n"] + 1.0)) for c in MEANS}
        return F.struct(
            (s["n"] + 1.0).alias("n"), F.when(x["importance_score"] >= mean["importance_score"], x["emotion_label"]).otherwise(s["emotion_label"]).alias("emotion_label"), *(mean[c].alias(c) for c in MEANS),
            *((s[c] | x[c]).alias(c) for c in FLAGS), *(F.array_union(s[c], x[c]).alias(c) for c in TAGS), F.array_union(s["chunks"], F.array(x["chunk_no"])).alias("chunks"),
        )

    return per.select("archive_id", "seq", F.inline(F.array(F.aggregate(F.slice("o", 2, F.size("o")), start, step)))).drop("n")


def annotate_new(m: DataFrame, stored: DataFrame, provider: str = "rules", version: str = "1", annotator: Callable[[DataFrame], DataFrame] = annotate) -> DataFrame:
    """The stored annotations with those of chunks that they lack: (provider, version, chunk_hash, archive_id, seq, chunk_no, ...).

    Only messages of chunks whose (provider, version, hash) isn't stored reach the annotator. Where a
    chunk is stored twice the rows of its last chunk_no count.
    """
    key = ["provider", "version", "chunk_hash"]
    chunks = chunk_hashes(m).select(*KEYS, "chunk_hash").withColumns({"provider": F.lit(provider), "version": F.lit(version)})
    new = chunks.join(stored.select(*key).distinct(), key, "left_anti")
    rows = in_chunks(m).join(new, KEYS)
    made = annotator(rows).select(*[c for c in stored.columns])
    both = stored.unionByName(made)
    last = F.row_number().over(Window.partitionBy(*key, "archive_id", "seq").orderBy(F.desc("chunk_no")))
    return both.withColumn("_r", last).where("_r = 1").drop("_r")
