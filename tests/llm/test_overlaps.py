"""The pipeline's near copies against a brute-force version."""

import random
import re
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadlake.llm import common, overlaps

SF = "/root/testdata/sf0.001"


def brute_set(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Smallest id of each component of links of 5-word Jaccard 0.8 or more."""
    comp, sets = {d: d for d in rows}, {d: brute_set(t) for d, t in rows.items()}
    for a, b in combinations(sorted(rows), 2):
        x, y = sets[a], sets[b]
        if comp[a] != comp[b] and (x == y or len(x & y) / len(x | y) >= 0.8):
            low, high = sorted((comp[a], comp[b]))
            comp.update({d: low for d, c in comp.items() if c == high})
    return sorted(set(comp.values()))


@pytest.mark.parametrize("crowd", [2, 64])
def test_near_copies(spark, monkeypatch, crowd):
    """Planted copies with 1 to 9 words of 200 replaced, chains of edits, a line common to many, and the small table."""
    monkeypatch.setattr(overlaps, "CROWD", crowd)
    rng = random.Random(3)
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    at = max(rows) + 1
    line = " ".join(f"line{i}" for i in range(60))
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for k in range(10):
            new = list(base)
            for i in rng.sample(range(200), k):
                new[i] = f"x{rng.randrange(10**6)}"
            rows[at] = " ".join(new)
            at += 1
            if g % 3 == 0:
                base = new
    for i in range(90):
        rows[at + i] = line + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 30)))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = brute_kept(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()) == want


def test_near_copies_odd(spark):
    data = [(1, None), (2, ""), (3, " \n"), (5, "a b"), (5, "a b"), (6, "A  b"), (7, "a b c"), (None, "a b"), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in overlaps.drop_near_copies(docs).collect()) == [0, 0, 1, 5, 7]
    assert overlaps.drop_near_copies(docs.limit(0)).count() == 0


def test_crowded_copies(spark, monkeypatch):
    """400 edits of one text, half of them too far from it: pairs compared grow with the texts, and no link is lost."""
    compared, real = [], overlaps._verified

    def verified(pairs, sets, least):
        compared.append(pairs.count())
        return real(pairs, sets, least)

    monkeypatch.setattr(overlaps, "_verified", verified)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = {1: " ".join(base)}
    for d in range(2, 402):
        new = list(base)
        for i in rng.sample(range(150), 1 + d % 6):
            new[i] = f"x{rng.randrange(10**6)}"
        rows[d] = " ".join(new)
    for d in range(402, 432):  # another's edits and one more: links between texts that are far from the base
        new = rows[d - 397].split()
        new[rng.randrange(150)] = f"y{d}"
        rows[d] = " ".join(new)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in overlaps.drop_near_copies(docs).collect()) == brute_kept(rows)
    assert sum(compared) < 10 * len(rows)


def test_common_runs(spark, monkeypatch):
    """300 unrelated texts with a run of common words each, and an edit of some: texts of any length aren't told from unrelated hubs, and no link is lost."""
    told, real = [], overlaps._apart

    def apart(rows):
        told.append(rows.count())
        return real(rows)

    monkeypatch.setattr(overlaps, "_apart", apart)
    monkeypatch.setattr(overlaps, "CROWD", 16)
    monkeypatch.setattr(overlaps, "COMMON", 0)  # as where more runs are common than are put last
    rng = random.Random(7)
    runs = [" ".join(f"and{r}of{i}" for i in range(9)) for r in range(10)]
    rows = {}
    for d in range(0, 600, 2):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 200))]
        at = rng.randrange(len(w))
        rows[d] = " ".join([*w[:at], runs[d % 20 // 2], *w[at:]])
        if d % 14 == 0:
            rows[d + 1] = rows[d].replace(w[0], "x", 1)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in overlaps.drop_near_copies(docs).collect())
    assert kept == brute_kept(rows) and len(kept) < len(rows)
    assert sum(told) < 10 * len(rows)


@pytest.mark.parametrize("crowd", [1, 4])
def test_crowded_alone(spark, monkeypatch, crowd):
    """Texts of few phrases, so that most keys are crowded: pairs that share no other key are found."""
    monkeypatch.setattr(overlaps, "CROWD", crowd)
    rng = random.Random(crowd)
    phrases = [" ".join(f"p{k}q{i}" for i in range(4 + k)) for k in range(14)]
    rows = {}
    for d in range(160):
        rows[d] = " ".join([rng.choice(phrases[:6]), *rng.sample(phrases, rng.randrange(2, 6)), *(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(3)))])
        if d % 4 == 3:
            rows[d] = rows[rng.randrange(d)] + f" z{rng.randrange(3)}" * rng.randrange(1, 4)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in overlaps.drop_near_copies(docs).collect()) == brute_kept(rows)


def test_shuffles_go(spark):
    """The shuffle files of a table that was written are deleted, and the session's setting is as it was."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_\d+", blocks.getAllFiles().mkString(" ")))
    before, setting = shuffles(), spark.conf.get(common.SHUFFLE_CLEANUP)
    got = common.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert got.count() == 7 and spark.conf.get(common.SHUFFLE_CLEANUP) == setting
