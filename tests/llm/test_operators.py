"""Each operator against a brute-force version, on the small tables and on awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.llm import decontamination, fingerprints, secrets, sentencepieces, separators, sharding, simhash, toxicity, url_filters, wavelets
from threadlake.llm.common import prefix_sum
from threadlake.llm.components import connected_components
from threadlake.llm.queries import QUERIES
from threadlake.llm.tokens import tiktoken_encoding, tokenizer, vocabulary_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, score double"
RANKS, BPE, PIECES = (vocabulary_path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = "one two  three\n\nfour\tfive   six seven eight nine ten eleven password = abcdefgh12 " * 3000
    data = [(1, None), (2, ""), (3, "   \n "), (4, long), (5, "a b"), (5, "a b"), (5, "a b c"), (6, "a b"), (None, "lost text"), (None, None), (7, "x\0y \0z \x1c w  "), (8, "▁ mark 日本 \U0001f600 é"), (9, " lead"), (10, "Trail  "), (11, "a<|endoftext|>b")]
    return spark.createDataFrame([(i, t, None, None, None, "x", 1.0) for i, t in data], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return re.findall(decontamination.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_contamination(text, items, width=10):
    w = words_of(text)
    hit, ids = set(), set()
    for item, t in items:
        b = words_of(t)
        for i in range(max(1, len(b) - width + 1) if b else 0):
            win = b[i : i + width]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    ids.add(str(item))
    return len(w), hit, sorted(ids)


@pytest.mark.parametrize("passes", [1, 3])
def test_decontamination(spark, docs, rows, passes):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").union(spark.createDataFrame([("short", "The and"), (None, None), ("none", "...")], "item_id string, text string"))
    items = [tuple(r) for r in bench.collect()]
    got = decontamination.find_contamination(docs, bench, passes=passes).collect()
    assert len(got) == len(rows)
    some = 0
    for r in got:
        n, hit, ids = brute_contamination(r["text"], items)
        h = r["hits"]
        assert (h["n_words"], h["n_hit"], list(h["items"])) == (n, len(hit), ids)
        spans = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", r["text"])]
        inside = {i for i, (a, z) in enumerate(spans) if any(s <= a and z <= e for s, e in zip(h["starts"], h["ends"]))}
        assert inside == hit
        some += bool(hit)
    assert some > 3


def test_decontamination_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "A  b"), (1, "a b c"), (None, "lost"), (2, "")], "item_id long, text string")
    got = {(r["doc_id"], r["text"]): r["hits_"] for r in decontamination.find_contamination(odd, bench).collect()}
    assert got[5, "a b c"]["n_hit"] == 3 and got[5, "a b"]["items"] == ["1"] and got[None, "lost text"]["items"] == [""] and got[1, None]["n_words"] == 0
    assert decontamination.find_contamination(none, bench).count() == 0
    clash = odd.withColumns({"_d": F.lit(1), "got": F.lit(2), "whose": F.lit(3)})
    again = decontamination.find_contamination(clash, bench, passes=2)
    assert again.columns == [*clash.columns, "hits_"] and again.where("_d = 1 and got = 2 and whose = 3").count() == odd.count()
    with pytest.raises(ValueError, match="passes"):
        decontamination.find_contamination(none, bench.withColumn("text", F.repeat(F.lit("w "), 1)), passes=0)
    assert decontamination.drop_contaminated(odd, bench).count() == odd.count() - 5
    assert decontamination.drop_contaminated(odd, bench.limit(0)).count() == odd.count()


PAGES = [
    (1, "http://a.example.org/es/1", "<link rel='canonical' href='https://x.net/p'>"),
    (2, "https://www.x.net/p/?utm_source=f#top", ""),
    (3, "https://y.net/q", '<META http-equiv="refresh" content="0; URL=https://x.net/p">'),
    (4, "https://z.org/ok", '<link href="https://y.net/q" rel="canonical">'),
    (5, "HTTP://EXAMPLE.ORG/en/12", ""),
    (6, "nothing", "<link rel=canonical href=/root>"),
    (7, None, None),
    (8, "https://com/fr/x", None),
    (9, "https://w.net/a", "<link rel=canonical href=/b>"),
    (9, "https://w.net/a", "<link rel=canonical href=/b>"),
    (10, "https://r.net/a/b/c.html?x=1", "<link rel=canonical href='../d.html'>"),
    (11, "https://r.net/a/d.html", "<link rel=canonical href='?id=1&amp;k=2'>"),
    (12, "https://r.net/a/d.html?id=1&k=2", "<link rel=\"canonical\" href=\"https://example.org/es/9\">"),
    (13, "https://s.net/x", "<!-- <link rel=canonical href=https://example.org/es/9> --><script>'<link rel=canonical href=https://example.org/es/9>'</script>"),
    (14, "https://t.net/x", "<base href='https://example.org/es/'><link rel=canonical href=y.html>"),
    (15, "https://u.net/x/y", "<link rel=canonical href=mailto:a@b.c><link rel='alternate' href='https://example.org/es/1'>"),
    (16, "https://www.r.net/a/d.html", ""),
]


def test_url_filters(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, node string")
    got = {r["page_id"]: r for r in url_filters.judge_urls(pages).collect()}
    blocked = {1, 3, 5, 10, 11, 12, 14}
    assert {k: r["verdict"] for k, r in got.items()} == {p[0]: "block" if p[0] in blocked else "allow" for p in PAGES}
    assert got[7]["alias"] is None and got[6]["alias"] is None
    wide = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(pages, address=url_filters.common_address).collect()}
    assert {k for k, v in wide.items() if v == "block"} == blocked | {2, 16}
    assert (got[5]["host"], got[5]["path"], got[5]["rule"], got[7]["host"], got[6]["path"]) == ("example.org", "/en/12", "example.org/en/1", "", "")
    more = spark.createDataFrame([("https://w.net/b", "https://q.com/de/1")], "url string, target string")
    assert {r["verdict"] for r in url_filters.judge_urls(pages, redirects=more).where("page_id = 9").collect()} == {"block"}
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_url_propagation(spark):
    """Random links, rules and redirects against a closure by repeated passes."""
    rng = np.random.default_rng(8)
    hosts = [f"https://h{i}.{'org' if i % 5 == 0 else 'net'}" for i in range(12)]
    urls = [f"{h}/{p}" for h in hosts for p in ("es/1", "a/2", "b/c/3")]
    pages, edges = [], []
    for i, u in enumerate(urls):
        to = urls[int(rng.integers(len(urls)))] if rng.random() < 0.4 else None
        pages.append((i, u, f'<link rel="canonical" href="{to}">' if to else None))
        edges += [(u, to)] if to else []
    moved = [(urls[int(a)], urls[int(b)]) for a, b in rng.integers(0, len(urls), (6, 2))]
    rules = [("allow", "org", "/"), ("block", "h1.net", "/es/"), ("block", "h2.net", "/"), ("block", "h5.org", "/es/1")]

    def own(u):
        m = re.search(r"://([^/]*)(.*)", u)
        fits = [(len(h + p), v) for v, h, p in rules if (m[1] == h or m[1].endswith("." + h)) and m[2].startswith(p)]
        return max(fits)[1] if fits else None

    bad = {u for u in urls if own(u) == "block"}
    while more := {x for a, b in edges + moved for x in (a, b) if (a in bad or b in bad)} - bad:
        bad |= more
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules, spark.createDataFrame(moved, "url string, target string")).collect()}
    assert got == {i: own(u) or ("block" if u in bad else "allow") for i, u, _ in pages} and len(bad) > 6


def test_url_filters_on_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    url = {r["page_id"]: r["url"] for r in pages.collect()}
    for r in QUERIES["op2_url_filters"](spark, SF).collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", url[r["page_id"]])
        host, path = m[1].lower(), m[2]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == (max(fits)[1:] if fits else (None, r["verdict"]))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 3), (3, 5), (9, 7), (7, 8), (8, 9), (3, 2), (20, 1)], [(i * 7 % 101, i * 13 % 101) for i in range(70)]])
def test_components(spark, edges):
    want = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {x: got.get(x, x) for x in want} == want


def test_secrets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = secrets.find_secrets(docs, RANKS).select("text", "secrets.*").collect()
    kinds = 0
    for r in found:
        t, want = r["text"], []
        for k, pattern, least in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0), ("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)):
            for m in re.finditer(pattern, t, re.I | re.A if k == "assign" else 0):
                if len(m[2]) >= 8 if k == "assign" else m.end() - m.start() >= least:
                    want.append((k, *m.span()))
        assert sorted(x for x in zip(r["kinds"], r["starts"], r["ends"]) if x[0] != "random") == sorted(want)
        kinds += len(want)
    assert kinds


def test_random_strings():
    """Added spans against a plain version: what base matches leave of each run, tested by its ratio."""
    enc = tiktoken_encoding(RANKS)
    rng = np.random.default_rng(2)
    caught = 0
    for i in range(300):
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "0123456789" * (i % 2)
        word = "".join(rng.choice(list(letters), int(rng.integers(16, 40))))
        t = f"see AKIAABCDEFGHIJKL/{word} and 0123456789abcdef0123456789abcdef-{word}, internationalizations"
        want = set()
        for at in (t.index(word), t.rindex(word)):
            for a, b in [(at - 1, at + len(word))] if any(c.isdigit() for c in word) else [(at, at + len(word))]:
                if b - a <= (2.2 if b - a > len(word) else 2.0) * len(enc.encode_ordinary(t[a:b])):
                    want.add((a, b))
        got = {(a, b) for a, k, b in secrets.scan(t, enc) if k == 3}
        assert got == want
        caught += len(got) == 2
    assert caught > 290


def test_secret_kinds(spark, odd):
    enc = tiktoken_encoding(RANKS)
    t = "see PassWord: 'hunter22x' AKIAABCDEFGHIJKL9 d41d8cd98f00b204e9800998ecf8427e 550e8400-e29b-41d4-a716-446655440000 q8Zx7Kp2Vw9Tj4Lm6Rb3 internationalization_2024_overview Kapi-key=short"
    got = [(secrets.KINDS[k], t[s:e]) for s, k, e in secrets.scan(t, enc)]
    assert got == [("assign", "PassWord: 'hunter22x"), ("access", "AKIAABCDEFGHIJKL9"), ("hex", "d41d8cd98f00b204e9800998ecf8427e"), ("random", "q8Zx7Kp2Vw9Tj4Lm6Rb3")]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(odd, RANKS).collect()}
    assert "abcdefgh12" not in clean[4] and clean[4].count("[SECRET]") == 3000 and clean[1] is None


@pytest.mark.parametrize("block", [64, separators.BLOCK_BYTES])
def test_separators(spark, docs, rows, odd, none, block):
    enc = tiktoken_encoding(RANKS)
    dealt = docs.repartition(5, F.col("doc_id") % 7)  # so that files don't follow the ids
    got = separators.count_tokens(dealt, RANKS, 50256, file_bytes=60_000, block_bytes=block).orderBy("doc_index").collect()
    assert [r["doc_id"] for r in got] == sorted(rows)
    total = 0
    for i, r in enumerate(got):
        assert (r["doc_index"], r["start"], r["n_tokens"]) == (i, total, len(enc.encode_ordinary(rows[r["doc_id"]])) + 1)
        total += r["n_tokens"]
    got = [(r["doc_id"], r["n_tokens"]) for r in separators.count_tokens(odd, RANKS, 50256, block_bytes=block).collect()]
    assert sorted(got, key=str) == sorted(((r["doc_id"], len(enc.encode_ordinary(r["text"] or "")) + 1) for r in odd.collect()), key=str)
    assert separators.count_tokens(none, RANKS, 50256).count() == 0


def test_separators_tail(spark, tmp_path):
    ids = np.array([5, 6, 0, 0, 7, 8, 9, 10, 11, 0, 3, 4], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(ids[:3].tobytes())
    files = spark.createDataFrame([(str(tmp_path / "a.bin"), 24), (str(tmp_path / "b.bin"), 6), ("gone", 0)], "file string, n_bytes long")
    got = sorted((r["file"][-5:], r["doc_index"], r["start"], r["n_tokens"], r["terminated"]) for r in separators.scan_separators(files, 0, block_bytes=4).collect())
    assert got == [("a.bin", 0, 0, 3, True), ("a.bin", 1, 3, 1, True), ("a.bin", 2, 4, 6, True), ("a.bin", 3, 10, 2, False), ("b.bin", 0, 0, 3, True)]


def brute_edit(t, n):
    q = len(t) // 4
    return t[: len(t) - q] + n[:q]


@pytest.mark.parametrize("bucket", [10_000, 1 << 30])
def test_fingerprints(spark, docs, rows, bucket):
    ids = sorted(rows)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs, bucket).collect()}
    assert sorted(got) == ids
    near, far = [], []
    for i, d in enumerate(ids):
        nxt = ids[(i + 1) % len(ids)]
        e = brute_edit(rows[d], rows[nxt])
        assert got[d]["n_chars"] == len(rows[d]) and got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        if len(rows[d]) > 2000:
            near.append(got[d]["near_edited"])
            far.append(got[d]["near_next"])
    assert 0.65 < np.mean(near) < 0.95 and np.mean(far) < 0.1
    text = {}
    for d in ids:
        assert text.setdefault(rows[d], got[d]["fingerprint"]) == got[d]["fingerprint"]


def test_fingerprints_odd(spark, odd, none):
    got = fingerprints.fingerprint_documents(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by[r["doc_id"]].add(r["fingerprint"])
    assert by[1] == by[2] == by[3] == {""} and len(by[5]) == 2
    assert fingerprints.fingerprint_documents(none).count() == 0
    assert fingerprints.fingerprint_documents(odd.limit(1)).count() == 1


def test_sketch_merges(spark):
    a, b = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(2996, 6000))
    df = spark.createDataFrame([(a, b, " ".join(f"w{i}" for i in range(6000)))], "a string, b string, ab string")
    s = df.select(*(fingerprints.sketch(F.col(c)).alias(c) for c in df.columns))
    r = s.select(fingerprints.merge(F.col("a"), F.col("b")).alias("m"), "ab", fingerprints.likeness(F.col("a"), F.col("ab")).alias("in")).first()
    assert r["m"] == r["ab"] and r["in"] == 1.0


def test_sketch_of_short_texts(spark):
    """Texts of 10 words inside a long one: most have no hash below the threshold."""
    w = [f"w{i}" for i in range(1000)]
    data = [(2 * i, " ".join(w[25 * i : 25 * i + 10])) for i in range(40)] + [(2 * i + 1, " ".join(w)) for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["near_next"] for r in fingerprints.fingerprint_documents(docs).collect()}
    assert len(got) == 80 and set(got.values()) == {1.0}
    low, stray, other = [5, 9], [(1 << 60) + 3], [(1 << 60) + 1]
    r = spark.createDataFrame([(low, stray, other)], "a array<long>, b array<long>, c array<long>").select(fingerprints.merge(F.col("a"), F.col("b")), fingerprints.merge(F.col("b"), F.col("c")), fingerprints.merge(F.array().cast("array<long>"), F.array().cast("array<long>"))).first()
    assert tuple(r) == (low, other, [])


def test_sentencepiece(spark, docs, odd, none):
    sp = sentencepieces.model(PIECES).sp
    for df in (docs, odd):
        for r in sentencepieces.encode_documents(df, PIECES).collect():
            ids = sp.encode(r["text"] or "")
            got = np.frombuffer(r["pieces"]["ids"], "<u2").tolist()
            assert got == ids and r["pieces"]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["pieces"]["exact"] == (sp.decode(ids) == (r["text"] or "")) == ("▁" not in (r["text"] or ""))
    coded = sentencepieces.encode_documents(odd, PIECES).select("text", sentencepieces.decode_ids(PIECES)(F.col("pieces.ids")).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "").replace("▁", " ") for r in coded)
    assert sentencepieces.encode_documents(none, PIECES).count() == 0


def test_sentencepiece_words():
    m = sentencepieces.model(PIECES)
    rng = np.random.default_rng(1)
    words = sorted({"▁" + "".join(rng.choice(list("aabcdeeehinorsté日"), rng.integers(1, 14))) for _ in range(3000)})
    for w, ids in zip(words, m.encode_sorted(words)):
        assert np.frombuffer(ids, "<u2").tolist() == m.sp.encode(w[1:])


@pytest.mark.parametrize("seed", range(4))
def test_best_paths(seed):
    """The forward scores of a hand-made unigram vocabulary against all ways to cut each word."""
    rng = np.random.default_rng(seed)
    pieces = sorted({"".join(rng.choice(list("ab▁c"), int(rng.integers(1, 4)))) for _ in range(30)} | {"a", "b"})
    ids, scores = {p: i for i, p in enumerate(pieces)}, rng.uniform(-9, -1, len(pieces)).tolist()
    m = sentencepieces.Model.__new__(sentencepieces.Model)
    m.pieces = pieces
    m._trie(ids)
    words = sorted({"".join(rng.choice(list("ab▁cz"), int(rng.integers(1, 9)))) for _ in range(300)})

    def brute(w):
        if not w:
            return 0.0
        ways = [scores[ids[w[:k]]] + brute(w[k:]) for k in range(1, min(3, len(w)) + 1) if w[:k] in ids]
        return max([*ways, -30.0 + brute(w[1:])])

    for w, path in zip(words, sentencepieces.best_paths(words, m.go, m.fail, m.outs, scores, -30.0)):
        assert "".join(pieces[p] if p >= 0 else chr(-1 - p) for p in path) == w
        assert sum(scores[p] if p >= 0 else -30.0 for p in path) == pytest.approx(brute(w))


def check_shards(got, texts, shards):
    total = defaultdict(int)
    slots = defaultdict(list)
    for r in got:
        assert r["size"] == len((texts[r["doc_id"]] if r["doc_id"] in texts else "").encode()) + 16
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return [total[i] for i in range(shards)]


@pytest.mark.parametrize("slot_rows", [3, 4096])
def test_sharding(spark, docs, rows, slot_rows):
    got = sharding.shard_documents(docs, 7, slot_rows=slot_rows).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
    assert all(r["text_crc32"] == zlib.crc32(rows[r["doc_id"]].encode()) for r in got)
    size = check_shards(got, rows, 7)
    assert max(size) - min(size) < 2 * max(len(t.encode()) + 16 for t in rows.values())
    assert len({r["shard"] for r in sharding.shard_documents(docs, None, target_bytes=60_000).collect()}) == -(-sum(size) // 60_000)


def test_sharding_cuts(spark):
    """Every cut against a plain one: widest dimension, weighted median within the tolerance, copies together."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    meta = sharding.metadata(docs)
    points, n = sharding._coordinates(meta)
    rows = [(tuple(r[f"c{i}"] for i in range(n)), r["size"], r["text_crc32"]) for r in points.collect()]
    tree = sharding.build_tree(points, n, 40)

    def walk(node, some):
        if tree.left[node] < 0:
            return [some]
        widths = [(max(c[d] for c, _, _ in some) >> 40) - (min(c[d] for c, _, _ in some) >> 40) for d in range(n)]
        assert widths[tree.dim[node]] == max(widths)
        left = [x for x in some if x[0][tree.dim[node]] < tree.cut[node]]
        total, share = sum(x[1] for x in some), (tree.k[node] // 2) / tree.k[node]
        best = min(abs(sum(x[1] for x in some if x[0][tree.dim[node]] < c) - share * total) for c in {x[0][tree.dim[node]] for x in some})
        assert abs(sum(x[1] for x in left) - share * total) <= max(best, sharding.NEAR_GROUPS * total / tree.k[node])
        return walk(tree.left[node], left) + walk(tree.right[node], [x for x in some if x[0][tree.dim[node]] >= tree.cut[node]])

    leaves = walk(0, rows)
    assert len(leaves) == 40
    where = defaultdict(set)
    for i, leaf in enumerate(leaves):
        for _, _, crc in leaf:
            where[crc].add(i)
    copies = [crc for crc in where if sum(x[2] == crc for x in rows) > 1]
    parted = sum(len(where[c]) > 1 for c in copies)
    assert len(copies) > 40 and parted <= 0.15 * len(copies), (parted, len(copies))


def test_sharding_odd(spark, odd, none):
    got = sharding.shard_documents(odd, 4).collect()
    assert len(got) == odd.count() and all(r["grown_shard"] is None and 0 <= r["shard"] < 4 for r in got)
    assert sharding.shard_documents(none, 4).count() == 0
    same = spark.createDataFrame([(i, "same text", "en", "s") for i in range(900)], "doc_id long, text string, lang string, source string")
    n = defaultdict(int)
    for r in sharding.shard_documents(same, 6).collect():
        n[r["shard"]] += 1
    assert max(n.values()) - min(n.values()) <= 6


@pytest.mark.parametrize("n", [0, 1, 7, 5000, wavelets.BLOCK + 3])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50257).astype(np.uint32)
    w = wavelets.WaveletMatrix(wavelets.pack(ids, [n], [3]))
    assert (w.decode() == ids).all() and w.keys == [3]
    for i in rng.integers(0, n, min(n, 40)).tolist():
        t = int(ids[i])
        where = np.flatnonzero(ids == t)
        assert w.access(i) == t and w.rank(t, i) == (ids[:i] == t).sum() and w.count(t, 0, n) == len(where)
        k = int(rng.integers(0, len(where)))
        assert w.select(t, k) == where[k] and w.select(t, len(where)) == -1
    assert w.count(70000, 0, n) == 0


def test_token_files(spark, docs, rows, odd, none):
    t = tokenizer(BPE)
    for df, texts in ((docs, [(d, rows[d]) for d in sorted(rows)]), (odd, sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")))):
        files = wavelets.write_wavelet_files(df, BPE, file_bytes=60_000)
        got = wavelets.document_checksums(files).orderBy("start").collect()
        start = 0
        assert len(got) == len(texts)
        for r, (d, text) in zip(got, texts):
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert wavelets.document_checksums(wavelets.write_wavelet_files(none, BPE)).count() == 0


def test_prefix_sum(spark):
    df = spark.range(50).select(F.col("id").alias("i"), (F.col("id") % 7).alias("v"))
    got = sorted((r["i"], r["s"]) for r in prefix_sum(df, "i", "v", "s", group=8).collect())
    assert got == [(i, sum(j % 7 for j in range(i))) for i in range(50)]


def test_kernel():
    assert toxicity.kernel("idiot", "idxiot") > 0 and toxicity.kernel("idiot", "zzzz") == 0
    a, b = toxicity.features(" idiot "), toxicity.features(" id.i-ot ")
    assert a == b
    brute = defaultdict(float)
    s = toxicity.symbols("abcabd")
    for c in combinations(range(len(s)), 4):
        if c[-1] - c[0] < toxicity.SPAN:
            brute[tuple(s[list(c)])] += toxicity.DECAY ** (c[-1] - c[0] + 1)
    assert sorted(brute.values()) == pytest.approx(sorted(toxicity.features("abcabd").values()))


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    some = d.join(lab, "doc_id", "left_semi")
    m = toxicity.fit(some, lab)
    got = toxicity.score_documents(some.where(toxicity.held_out(F.col("doc_id"))), m).join(lab, "doc_id").select("toxic", "score").toPandas()
    hit = (got["score"] >= toxicity.THRESHOLD) == (got["toxic"] == 1)
    ranks = got["score"].rank()
    n1, n0 = (got["toxic"] == 1).sum(), (got["toxic"] == 0).sum()
    auc = (ranks[got["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    print("held out", len(got), "accuracy", hit.mean(), "auc", auc)
    assert hit.mean() > 0.95 and auc > 0.95


def test_toxicity_sentences(spark):
    """More toxic sentences than the bound: both classes still have their half, and no long document takes it all."""
    data = [(i, " ".join(f"{'word' if i else 'long'}{i} number{j}." for j in range(3000 if i == 0 else 40)), int(i < 30)) for i in range(90)]
    sample = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    for bound, want in ((200, (100, 100)), (5000, (2600, 2400)), (100_000, (3000 + 29 * 40, 2400))):
        got, toxic, clean = toxicity._sentences(sample, bound)
        rows = got.collect()
        assert (toxic, clean) == want == (sum(r["toxic"] for r in rows), sum(1 - r["toxic"] for r in rows))
        if bound == 200:
            assert sum("long" in r["s"] for r in rows) < 30


def test_toxicity_bound(spark):
    """The bound lies below the toxic sentences, as it does on inputs of more than 12,000 learnable labels."""
    sf = "/root/testdata/sf0.1"
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    some = d.join(lab, "doc_id", "left_semi")
    m = toxicity.fit(some, lab, sentences=6000)
    got = toxicity.score_documents(some.where(toxicity.held_out(F.col("doc_id"))), m).join(lab, "doc_id").select("toxic", "score").toPandas()
    ranks, n1, n0 = got["score"].rank(), (got["toxic"] == 1).sum(), (got["toxic"] == 0).sum()
    auc = (ranks[got["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    print("held out", len(got), "accuracy", ((got["score"] >= toxicity.THRESHOLD) == (got["toxic"] == 1)).mean(), "auc", auc)
    assert auc > 0.93


def test_toxicity_odd(spark, odd, none):
    lab = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (lab, lab.limit(0), lab.limit(1)):
        m = toxicity.fit(odd, labels)
        got = toxicity.score_documents(odd, m).collect()
        assert len(got) == odd.count() and all(0 <= r["score_"] <= 1 for r in got)
    assert toxicity.score_documents(none, m).count() == 0
    assert toxicity.drop_toxic(odd, m).columns == odd.columns


def brute_simhash(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(prints):
    comp = {d: d for d, _ in prints}
    changed = True
    links = [(a, b) for (a, x), (b, y) in combinations(prints, 2) if bin(x ^ y).count("1") <= 2]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return comp


def test_simhash(spark, docs, rows):
    prints = [(d, brute_simhash(t)) for d, t in sorted(rows.items())]
    comp = brute_components(prints)
    got = QUERIES["op10_simhash"](spark, SF).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{x:016x}" for d, x in prints}
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    kept = simhash.drop_near_duplicates(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp.values())) and kept.columns == docs.columns


@pytest.mark.parametrize("bucket", [2, 256])
def test_near_pairs(spark, bucket):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    prints = {b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(40)}
    prints = [(simhash._signed(p), p) for p in sorted(prints)]
    df = spark.createDataFrame([(s,) for s, _ in prints], "fp long")
    got = dict(map(tuple, connected_components(simhash.near_pairs(df, bucket=bucket)).collect()))
    assert {s: got.get(s, s) for s, _ in prints} == brute_components(prints)


def test_simhash_odd(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    comp = defaultdict(set)
    for r in got:
        comp[r["doc_id"]].add(r["component_id"])
    assert comp[1] == comp[2] == comp[3] == {1} and comp[6] == {5}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id is null").count() == 2
