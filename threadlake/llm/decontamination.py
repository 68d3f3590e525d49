"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark windows.

Words are maximal runs of 0-9, A-Z, a-z and characters past U+007F, lower-cased for A-Z. Each text is
scanned once; hits carry back to code-point offsets of the original text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.common import free_name, held, lower_ascii, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULT = "n_words long, n_hit long, items array<string>, starts array<long>, ends array<long>"
#: Bytes of windows that one automaton may have, and that are broadcast at once.
MOST_BYTES = 256 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def benchmark_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(window, items): each distinct run of `width` words with the ids that hold it; a shorter text is one window.

    Null or wordless texts have none; a null id counts as the empty string.
    """
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), 0).alias("w")).where("size(w) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))))
    return w.select("item", "w", at.alias("i")).select(F.array_join(F.slice("w", F.col("i"), width), " ").alias("window"), "item").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _automaton(key, windows):
    return held(("automaton", key), lambda: _built(windows))


def _built(windows):
    import ahocorasick

    a = ahocorasick.Automaton()
    for window, items in windows:
        a.add_word(f" {window} ", (window.count(" ") + 1, items))
    a.make_automaton()
    return a


def scan(text: str | None, automaton) -> tuple[int, int, list[str], list[int], list[int]]:
    """(words, words hit, items, starts and ends of the hit passages in the original)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not words:
        return 0, 0, [], [], []
    flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    found = list(automaton.iter(flat)) if len(automaton) else []
    if not found:
        return len(words), 0, [], [], []
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    items: set[str] = set()
    at, seen = 0, 0
    for end, (n, ids) in found:  # ends come in ascending order
        seen += flat.count(" ", at, end)
        at = end
        hit[seen - n] += 1
        hit[seen] -= 1
        items.update(ids)
    inside = np.cumsum(hit)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    where = [(m.start(), m.end()) for m in re.finditer(ANY_CASE, text)]
    return len(words), int(inside.sum()), sorted(items), [where[i][0] for i in edges[::2]], [where[i - 1][1] for i in edges[1::2]]


def _scanner(spark: SparkSession, windows: list[tuple[str, list[str]]]):
    shared = spark.sparkContext.broadcast(windows)
    key = shared._jbroadcast.id()

    @F.pandas_udf(RESULT)
    def hits(texts: pd.Series) -> pd.DataFrame:
        automaton = _automaton(key, shared.value)
        return pd.DataFrame([scan(t, automaton) for t in texts], columns=["n_words", "n_hit", "items", "starts", "ends"])

    return hits


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, passes: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, items, starts, ends in a struct column, named hits unless docs has that name.

    One automaton of all windows, which each text meets once. A benchmark of more than MOST_BYTES of windows
    is refused: give a number of passes, each with its own automaton of a share of the windows (by a hash)
    over all texts; their hits are joined on the key and a digest of the text. Null and empty texts have no
    words and no hits; texts of any length are scanned whole; of equal windows each item counts; repeated
    rows give repeated results; no rows give none; extra columns pass through.
    """
    spark, out = docs.sparkSession, free_name(docs, "hits")
    windows = materialize(benchmark_windows(benchmark, width))
    size = windows.agg(F.coalesce(F.sum(F.octet_length("window") + 24 * F.size("items")), F.lit(0))).first()[0]
    if size > MOST_BYTES * passes:
        raise ValueError(f"{size} bytes of windows need passes={-(-size // MOST_BYTES)} or more")
    if passes == 1:
        return docs.withColumn(out, _scanner(spark, [tuple(r) for r in windows.collect()])(F.col(text)))
    found = None
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    for b in range(passes):
        part = [tuple(r) for r in windows.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == b).collect()]
        one = materialize(slim.withColumn("h", _scanner(spark, part)(F.col("t"))).where("h.n_hit > 0").select("k", F.sha2("t", 256).alias("d"), "h.*"))
        found = one if found is None else found.unionByName(one)
    gathered = found.groupBy("k", "d").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    whose, got = free_name(docs, "whose"), free_name(docs, "got")
    own = F.struct(F.col(key).alias("k"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("d"))
    joined = docs.join(gathered.select(F.struct("k", "d").alias(whose), F.struct("items", "starts", "ends").alias(got)), own.eqNullSafe(F.col(whose)), "left")
    return joined.withColumn(out, _joined(F.col(text), *(F.col(got)[c] for c in ("items", "starts", "ends")))).drop(whose, got)


def _passages(text: str | None, items, starts, ends) -> tuple:
    """One set of passages from those of all blocks."""
    where = [(m.start(), m.end()) for m in re.finditer(ANY_CASE, text or "")]
    inside = np.zeros(len(where), dtype=np.int8)
    first, last = {a: n for n, (a, _) in enumerate(where)}, {b: n for n, (_, b) in enumerate(where)}
    for a, b in zip(starts if starts is not None else [], ends if ends is not None else []):
        inside[first[a] : last[b] + 1] = 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside, [0]))))
    return len(where), int(inside.sum()), list(items) if items is not None else [], [where[x][0] for x in edges[::2]], [where[x - 1][1] for x in edges[1::2]]


def _joined(*columns: Column) -> Column:
    @F.pandas_udf(RESULT)
    def join(texts: pd.Series, items: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_passages(*row) for row in zip(texts, items, starts, ends)], columns=["n_words", "n_hit", "items", "starts", "ends"])

    return join(*columns)


def digest(hits: Column) -> Column:
    """SHA-256 of the item ids, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(hits["items"], ","), 256)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of docs without a benchmark passage, columns as they were."""
    name = free_name(docs, "hits")
    return find_contamination(docs, benchmark, **params).where(F.col(name)["n_hit"] == 0).select(*docs.columns)
