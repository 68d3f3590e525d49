"""The later operators against plain versions: prefix trie, ranked search, language model."""

import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.llm import common, ngrams, prefix_trie, ranked


def brute_trie(rows):
    """Nodes of (conv_id, turn, role, text) rows, turns of one number by digest."""
    digest = lambda r, t: hashlib.sha256((f"{len(r)}:" + r + t).encode()).hexdigest()[:32]
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), len(text or "")))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    name, leaves, saved = {p: min(m) for p, m in members.items()}, Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (p[-1][1] if p else 0)
    ended = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(seqs[c]) == len(p))))
    return sorted((name[p], len(p), name[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ended(p).encode()).hexdigest()) for p, m in members.items())


@pytest.mark.parametrize("longest", [1, 2, 9, 37])
def test_prefix_trie(spark, longest):
    rng = random.Random(longest)
    rows = []
    for c in [*range(100, 160), *range(200, 230), 305, 400, 9]:
        for t in range(1 if c % 9 == 0 else rng.randint(1, longest)):
            text = rng.choice(["", None, "ok", "näh 😀", "x" * 5000]) if t > 2 else rng.choice("ab")
            rows.append((c, None if t == 0 and c % 4 == 0 else t, rng.choice(["user", None]) if t % 2 else "user", text, 1))
    rows += [rows[0], rows[1], rows[1], (None, 1, "user", "a", 1)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key int").repartition(3)
    got = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.turns_of(convs)), pack=3)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(brute_trie([r[:4] for r in rows]), key=lambda r: r[:2])


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.turns_of(none))).count() == 0
    # the head is absent and all of its own turns are before its h: only a root, where it ends
    c = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 6 > 0)
    one = spark.createDataFrame([(c, 0, "user", "a")], none.schema)
    got = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.turns_of(one))).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def brute_ranks(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    have = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n, total = len(have), sum(sum(c.values()) for _, c in have)
    df = Counter(w for _, c in have for w in c)
    terms = defaultdict(set)
    for i, t in items:
        if i is not None:
            terms[i] |= set(words(t))
    out = []
    for i, ts in terms.items():
        scored = []
        for d, c in have:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            scored.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c), d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("postings,pass_bytes,seed", [(60, 1 << 20, 1), (1 << 20, 1 << 20, 2), (500, 40, 3)])
def test_ranked_search(spark, postings, pass_bytes, seed):
    rng = random.Random(seed)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["Straße", "ÉTÉ", "été", "don", "t"]
    docs = [(i, " ".join(rng.choice(vocab) + rng.choice(["", ",", "-X", "'"]) for _ in range(rng.choice([1, 5, 40, 400])))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, " .,; "), (None, "w1 w2 w3"), docs[7], docs[7], (903, "w1 " * 50_000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 25])))) for i in range(12)] + [(20, None), (21, "..."), (22, "nowhere"), (3, "w1 w2"), (None, "w1")]
    d = spark.createDataFrame([(*x, 0.5, "z") for x in docs], "doc_id long, text string, score double, rank string").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, ranked.rank_documents(d, q, 4, pass_bytes, postings).collect()), key=lambda r: r[:2])
    assert got == brute_ranks(docs, items, 4)
    assert ranked.rank_documents(d.limit(0), q).count() == 0 and ranked.rank_documents(d, q.limit(0)).count() == 0


def test_blocks_are_skipped():
    """With a known k-th score, blocks of lists that can't matter stay compressed, and the best come out the same."""
    rng = np.random.default_rng(4)
    n = 20_000
    term = np.concatenate((np.zeros(n, int), np.full(40, 1)))
    doc = np.concatenate((np.arange(n), np.sort(rng.choice(n, 40, replace=False))))
    tf = np.concatenate((rng.integers(1, 4, n), rng.integers(5, 9, 40)))
    lists = ranked.Lists(term, doc, tf, np.full(n, 100, np.int64))
    every, scores = ranked.best_of(lists, [(0, 3), (1, 900)], 5, 0)
    want = np.zeros(n, np.int64)
    np.add.at(want, doc, np.where(term == 0, 3, 900) * ((10**9 * tf) // (1000 * tf + 800)))
    best = lambda d, s: sorted(zip(-s, d))[:5]
    stats: dict = {}
    some, found = ranked.best_of(lists, [(0, 3), (1, 900)], 5, int(np.sort(want)[-5]), stats)
    assert best(every, scores) == best(some, found) == best(np.arange(n), want) and stats["skipped"] > 100


def brute_scores(docs, train, order):
    """By plain dictionaries of n-grams, with probabilities rounded as in the levels."""
    words = lambda t: ["<s>", *re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"]
    c = Counter()
    for d, t in docs:
        if train(d):
            w = words(t)
            c.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    n = sum(v for k, v in c.items() if len(k) == 1 and k != ("<s>",))
    v = sum(1 for k in c if len(k) == 1 and k != ("<s>",))
    base = lambda w: math.log10((c[(w,)] + 0.1) / (n + 0.1 * (v + 1)))
    step = lambda x: min(255, max(0, round(-ngrams.STEPS * x)))

    def code(g):
        shorter = step(base(g[-1])) if len(g) == 2 else code(g[1:])
        return step(math.log10((c[g] + ngrams.PRIOR * 10 ** (-shorter / ngrams.STEPS)) / (c[g[:-1]] + ngrams.PRIOR)))

    def lp(g):
        if len(g) == 1:
            return base(g[0])
        if c[g]:
            return -code(g) / ngrams.STEPS
        return lp(g[1:]) + (math.log10(ngrams.PRIOR / (c[g[:-1]] + ngrams.PRIOR)) if c[g[:-1]] else 0)

    out = []
    for d, t in docs:
        w = words(t)
        out.append((d, not train(d), len(w) - 1, sum(c[(x,)] > 0 for x in w[1:]), n, sum(map(base, w[1:])), sum(lp(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(1, len(w)))))
    return out


@pytest.mark.parametrize("order,block,shard", [(3, 50, 40), (3, 1 << 21, 1 << 20), (2, 300, 100), (4, 90, 25)])
def test_language_model(spark, order, block, shard):
    rng = random.Random(order)
    words = ["the", "The", "of", "é", "a,b"] + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(words[min(len(words) - 1, int(rng.paretovariate(0.6)) - 1)] for _ in range(rng.choice([0, 1, 2, 9, 60])))) for i in range(120)]
    docs += [(500, None), (501, " \t\n"), (502, "nowhere else seen\u00a0x"), docs[3], docs[3], (503, "the of " * 3000), (None, "the of")]
    train = lambda d: d is not None and d % 10 != 0 and d != 502
    df = spark.createDataFrame([(*x, 1.0, "k") for x in docs], "doc_id long, text string, score double, train string").repartition(3)
    model, got = ngrams.learn_and_score(df, (F.col("doc_id") % 10 != 0) & (F.col("doc_id") != 502), order, block, shard)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = sorted(brute_scores(docs, train, order), key=key)
    rows = sorted(map(tuple, got.collect()), key=key)
    assert [r[:5] for r in rows] == [r[:5] for r in want]
    for a, b in zip(rows, want):
        assert a[5:] == pytest.approx(b[5:], abs=1e-6)
    again = sorted(map(tuple, ngrams.score(df, model, 200).collect()), key=key)
    assert [r[6] for r in again] == pytest.approx([r[6] for r in rows]) and all(r[1] for r in again)
    ngrams.delete_model(df, model)


def test_language_model_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert ngrams.learn_and_score(df.limit(0), F.lit(True))[1].count() == 0
    rows = ngrams.learn_and_score(df, F.lit(None).cast("boolean"))[1].collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in sorted(rows)] == [(3, 0, 0, 0, 0), (1, 0, 0, 0, 0)]


@pytest.mark.parametrize("top", [1, 200, 1 << 20, 1 << 62])
def test_monotone_codes(top):
    v = np.sort(np.random.default_rng(top % 97).integers(0, top, 3000)).astype(np.uint64)
    for x in (v, v[:1], v[:0], np.zeros(5, np.uint64)):
        assert (ngrams.decode_monotone(*ngrams.encode_monotone(x)) == x).all()


def test_language_model_leaves_no_files(spark, tmp_path, monkeypatch):
    """Questions and answers go level by level, over many tasks; the scores alone stay."""
    asked, real = [], ngrams.materialize

    def materialize(df):
        out = real(df)
        if df.columns == ["shard", "block", "file", "start", "size"]:
            asked.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(ngrams, "materialize", materialize)
    for module in (common, ngrams):
        monkeypatch.setattr(module, "shared_dir", lambda spark: f"file://{tmp_path}/threadlake-{uuid.uuid4().hex}")
    df = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(40))) for i in range(200)], "doc_id long, text string").repartition(8)
    model, scores = ngrams.learn_and_score(df, F.col("doc_id") % 10 != 0, 3, 200, 500)
    assert scores.count() == 200
    ngrams.delete_model(df, model)
    assert len(asked) == 3 and min(asked) > 1
    assert [p.name for p in tmp_path.iterdir()] == [scores.inputFiles()[0].split("/")[-2]]


def test_packed_arrays():
    x = {"a": np.array([], np.uint8), "b": np.array([1, 300, 70000], np.uint32), "c": np.array([-5, 2**40], np.int64), "d": np.array([True, False])}
    got = ngrams.unpack(ngrams.pack(**x))
    assert {k: (v.dtype, v.tolist()) for k, v in got.items()} == {k: (v.dtype, v.tolist()) for k, v in x.items()}
    node = np.array([4, 9, -1, 7, 0, -1, 8])
    assert ngrams.unstepped(ngrams.narrow(ngrams.steps(node, node >= 0))).tolist() == node.tolist()
