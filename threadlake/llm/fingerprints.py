"""Document fingerprints: threshold-scaled sketches of word shingles. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import materialize

#: Shingles of five words; a sketch keeps the hashes below 2**-SCALE of their range.
WORDS, SCALE = 5, 4
BUCKET_BYTES, MAX_BUCKETS = 4 << 20, 1 << 16


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """Sorted distinct 63-bit shingle hashes below 2**(63 - scale).

    Words are split at white space and lower-cased; a text of fewer words is one shingle; where no hash
    is low enough the smallest is kept, so only wordless or null texts have an empty sketch. Sketches of
    parts merge by union.
    """
    def low(h: Column) -> Column:
        kept = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < (1 << (63 - scale)))))
        return F.when((F.size(kept) == 0) & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(kept)

    # one-element arrays bind the inner values, which would be computed again at each use
    return F.transform(_bound_hashes(text, words), low)[0]


def _bound_hashes(text: Column, words: int) -> Column:
    """An array of one element: the hashes of all shingles of the text."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))
        return F.when(F.size(w) > 0, F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(w, i + k) for k in range(words))), 1))).otherwise(F.array().cast("array<long>"))

    return F.transform(F.array(w), hashes)


def _stray(s: Column, scale: int = SCALE) -> Column:
    """Whether a sketch holds but the smallest hash of a text without low ones."""
    return F.coalesce(F.array_min(s) >= (1 << (63 - scale)), F.lit(False))


def _share(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def likeness(a: Column, b: Column, text_a: Column | None = None, text_b: Column | None = None) -> Column:
    """Share of the smaller sketch that is in the other: an estimate of containment; 1 for two empty ones.

    The lone hash of a text without low ones is in no sketch of a longer text. With the texts given, such
    a pair is compared by all its shingles.
    """
    if text_a is None or text_b is None:
        return _share(a, b)
    every = F.transform(F.array(F.struct(*(F.array_distinct(_bound_hashes(t, WORDS)[0]).alias(n) for t, n in ((text_a, "a"), (text_b, "b"))))), lambda p: _share(p["a"], p["b"]))[0]
    return F.when(_stray(a) | _stray(b), every).otherwise(_share(a, b))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merge(a: Column, b: Column) -> Column:
    """The sketch of both parts: the hash of a part without low ones goes where a lower one exists."""
    both = F.array_sort(F.array_union(a, b))
    return F.when(_stray(both), F.slice(both, 1, 1)).otherwise(F.filter(both, lambda x: x < (1 << (63 - SCALE))))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most key: by groups of bounds, then within the group."""
    if not bounds:
        return F.lit(0).cast("long")
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    top, rest = F.lit([g[0] for g in groups]), F.array(*(F.lit(g) for g in groups))
    g = F.size(F.filter(top, lambda b: b <= key))
    inside = F.size(F.filter(F.get(rest, g - 1), lambda b: b <= key))
    return F.when(g == 0, F.lit(0)).otherwise((g - 1) * step + inside).cast("long")


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each document with the next by ascending doc_id, the first after the last.

    Documents are cut into ranges of doc_id by approximate quantiles, at most MAX_BUCKETS. A range also
    gets the first document of the range after it, so no task needs more than its own range. Rows of one
    doc_id stand in the order of their texts; null ids come first; a lone row is next to itself.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"))
    total = d.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = min(MAX_BUCKETS, max(1, -(-total // bucket_bytes)))
    cuts = d.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    d = d.withColumn("b", _bucket(F.col("k"), sorted(set(cuts or []))))
    # The first id of each range, with the range before it: one row a range, MAX_BUCKETS at most.
    around = Window.orderBy("b")
    firsts = d.select("b", "k").groupBy("b").agg(F.min("k").alias("k"))
    last = F.max("b").over(Window.partitionBy(F.lit(0)))
    halo = materialize(firsts.select(F.col("k").alias("hk"), F.coalesce(F.lag("b").over(around), last).alias("hb")))
    both = d.join(F.broadcast(halo), d["k"] == F.col("hk"), "left")
    own, beyond = F.struct(F.col("b").alias("b"), F.lit(0).alias("beyond")), F.struct(F.col("hb").alias("b"), F.lit(1).alias("beyond"))
    placed = both.withColumn("sketch", sketch(F.col("text"))).select("doc_id", "k", "text", "sketch", F.explode(F.when(F.col("hb").isNull(), F.array(own)).otherwise(F.array(own, beyond))).alias("p"))
    flat = placed.select("doc_id", "k", "text", "sketch", F.col("p.b").alias("b"), F.col("p.beyond").alias("beyond"))
    w = Window.partitionBy("b").orderBy("beyond", "k", "text")
    ahead = flat.select("*", F.lead("text").over(w).alias("next_text"), F.lead("sketch").over(w).alias("next_sketch"))
    return ahead.where("beyond = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def edited(text: Column, following: Column) -> Column:
    """text with its last quarter of code points replaced by as many first ones of the following text, or all."""
    n = F.length(text)
    q = F.floor(n / 4).cast("int")
    return F.concat(text.substr(F.lit(1), n - q), following.substr(F.lit(1), q))


def fingerprint_documents(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Null texts are empty; two texts without words are alike (1), one without words is like no other (0).
    Rows of one doc_id, repeated ones too, stand in the order of their texts; null ids come first; a lone
    row is next to itself; no rows give none. Texts of any length are taken whole; other columns are ignored.
    """
    d = with_next(docs, bucket_bytes)
    d = d.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    d = d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", "next_text", "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch"), F.col("text"), F.col("next_text")).alias("near_next"),
    )
