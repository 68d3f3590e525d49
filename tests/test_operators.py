"""Hand-made cases with literal answers: values that must be right whatever constants both engines share."""

import json
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from threadlake.functions import display as D
from threadlake.functions import text as T
from threadlake.operators import annotate as A
from threadlake.operators import chunks as K
from threadlake.operators import curation as C
from threadlake.operators import sessions as S
from threadlake.sources import rules as V
from threadlake.sources import shards, store, tables


@pytest.fixture(scope="module")
def messages(spark):
    """Three archives, of which one holds nine rows of ten; odd gaps, system rows and a row that goes back in time."""
    rows, at = [], datetime(2024, 1, 1)
    for i in range(300):
        archive = "big" if i % 10 else ("b", "c")[i // 10 % 2]
        at += timedelta(minutes=(i * 7919) % 500 - (30 if i % 50 == 49 else 0))
        rows.append((archive, at, None if i % 17 == 0 else f"p{i % 3}", f"text {i}"))
    seq: dict = {}
    data = []
    for a, t, s, x in rows:
        seq[a] = seq.get(a, -1) + 1
        data.append((a, seq[a], t, s, x))
    return spark.createDataFrame(data, "archive_id string, seq long, ts timestamp_ntz, sender_id string, text string")


def sessions_of(rows, gap):
    """A plain loop over an archive's rows in order."""
    out, before, own, session = [], None, {}, 0
    wait = lambda t, p: None if p is None else max(0, round((t - p).total_seconds() / 60)) if t else 0
    for i, r in enumerate(sorted(rows, key=lambda r: r["seq"])):
        g = wait(r["ts"], before)
        session += g is None or g >= gap
        out.append((r["archive_id"], r["seq"], g, session, wait(r["ts"], own.get(r["sender_id"])) if r["sender_id"] else None, f"tech_{session:04d}", i))
        before, own[r["sender_id"]] = r["ts"], r["ts"]
    return out


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_sessions_in_blocks(messages, block):
    """Also with a message without time, holes in the order, and columns of the names that are added."""
    m = messages.withColumn("ts", F.when(F.col("seq") % 41 != 13, F.col("ts"))).withColumn("at", F.col("seq") * 3 + 5).withColumns({"session_no": F.lit(-1), "gap_minutes": F.lit("x")})
    rows = [r.asDict() for r in m.collect()]
    want = sorted(x for a in ("big", "b", "c") for x in sessions_of([r for r in rows if r["archive_id"] == a], 360))
    got = S.with_sessions(m, gap=360, order="at", number="place", block_rows=block)
    assert sorted(map(tuple, got.select("archive_id", "seq", "gap_minutes", "session_no", "reply_gap_minutes", "technical_session_id", "place").collect())) == want
    assert len({x[3] for x in want}) > 20 and S.with_sessions(m.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 7, 50, 1 << 20])
def test_silence_in_blocks(messages, block):
    """Blocks without active rows, and of one row, lie between neighbours."""
    m = messages.withColumn("message_type", F.when((F.col("seq") % 5 == 0) | F.col("seq").between(100, 130), "system").otherwise("text"))
    want = []
    for a in ("big", "b", "c"):
        rows = sorted((r["seq"], r["ts"]) for r in m.where("message_type = 'text'").where(F.col("archive_id") == a).collect())
        gaps = sorted((-int((t - p).total_seconds() // 60), s, q) for (q, p), (s, t) in zip(rows, rows[1:]))[:6]
        want += [(a, i + 1, q, s, float(-g)) for i, (g, s, q) in enumerate(gaps) if g < 0]
    got = S.silence_gaps(m, block_rows=block).select("archive_id", "rank", "from_seq", "seq", "gap_minutes")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 18


@pytest.mark.parametrize("name", ["sessionize", "silence_gaps", "chunk_windows", "reply_gap"])
def test_no_messages_window_by_archive(spark, name):
    """Every window keyed by an archive alone stands on a table of blocks, or keeps no more than a few ranks."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    whole = [i for i, x in enumerate(plan.splitlines()) if "Window [" in x and "_block" not in x.split("], [")[1].split("]")[0] and "sender_id" not in x.split("], [")[1].split("]")[0]]
    lines = plan.splitlines()
    assert whole or name == "chunk_windows"
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i in whole:
        below = []
        for x in lines[i + 1 :]:
            if depth(x) <= depth(lines[i]):
                break
            below.append(x)
        first = next(x for x in below if "Aggregate [" in x or "Filter (((_best" in x or "Window [" in x and "_block" in x.split("], [")[1] or "Relation" in x)
        assert "Aggregate" in first or "_best" in first, (name, lines[i], first)


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize("n,want", [(0, "0"), (999, "999"), (1000, "1K"), (1364, "1.4K"), (271_129, "271.1K"), (999_949, "999.9K"), (999_950, "1M"), (12_500_000, "12.5M"), (3_000_000_000, "3B")])
def test_format_compact(spark, n, want):
    assert spark.createDataFrame([(n,)], "x long").select(T.format_compact(F.col("x"))).first()[0] == want


def test_display(spark):
    shown = lambda x: one(spark, x, D.clean_display_text)
    assert shown('"a \xe2€œb\xe2€\x9d \xe2€\xa2 c\xe2€\xa6\n"') == 'a "b" / c...' and shown("x\xc2\xb7y \xe2€™s") == "x / y 's"
    cut = lambda x, n: one(spark, x, lambda c: D.build_excerpt(c, n))
    assert cut("short", 10) == "short" and cut("aaa bbb ccc ddd eee fff", 20) == "aaa bbb ccc ddd eee..." and cut("a " + "b" * 60, 40) == "a " + "b" * 20 + "..."
    low = lambda x: one(spark, x, D.is_low_value_text)
    assert [low(x) for x in ("hi everyone in the team", "the quiz is today", "I love the quiz", "a job quiz", "teammate", "see https://x.org", "love https://x.org", "a: b: c; d: e", "plain words")] == [True, True, False, False, False, True, False, True, False]
    assert low("word " * 61) and not low("word " * 60) and not low("love and miss " + "word " * 61) and low("love and miss " + "word " * 101)


def test_annotation(spark):
    """Labels, scores and flags worked out by hand."""
    rows = [("i love you so much!", 1), ("where are you", 2), ("that hurt, sorry", 3), ("please find attached the deadline", 4)]
    m = spark.createDataFrame(rows, "text string, seq long").withColumns({"archive_id": F.lit("a"), "message_type": F.lit("text")})
    m = m.withColumns({"normalized_text": T.normalize_text(F.col("text")), "char_count": T.char_count(F.col("text")), "word_count": T.word_count(F.col("text")), "emoji_count": T.count_emoji(F.col("text"))})
    got = {r["seq"]: r for r in A.annotate(m).collect()}
    assert (got[1]["emotion_label"], got[1]["archetype_tags"], got[1]["topic_tags"]) == ("romantic", ["affection"], ["relationship"])
    assert got[1]["emotion_intensity"] == pytest.approx(round(0.15 + 0.04 + 0.18 + 5 / 140, 4))
    assert got[1]["importance_score"] == pytest.approx(0.15 + 0.45 * (0.37 + 5 / 140) + 5 / 120 + 0.2, abs=6e-5)
    assert got[2]["archetype_tags"] == ["check-in"] and got[2]["emotion_label"] == "romantic" and not got[2]["milestone_candidate"]
    assert (got[3]["conflict_signal"], got[3]["repair_signal"], got[3]["emotion_label"], got[3]["milestone_candidate"]) == (True, True, "conflict", True)
    assert got[4]["importance_score"] == pytest.approx(max(0, 0.15 + 0.45 * (0.33 + 5 / 140) + 5 / 120 - 0.5), abs=6e-5)
    assert [(r["kind"], r["label"], r["n"]) for r in A.match_counts(m).where("seq = 1").orderBy("kind").collect()] == [("archetype", "affection", 1), ("emotion", "romantic", 1), ("topic", "relationship", 1)]
    with pytest.raises(ValueError, match="evidence_score"):
        A.annotate_with(m, lambda x: A.annotate(x).drop("evidence_score"))
    assert A.annotate_with(m, lambda x: A.annotate(x, "funny")).where("seq = 2").first()["emotion_label"] == "funny"


def test_keywords_once(spark):
    """Filters and projections on top don't write the keyword search out again."""
    m = spark.range(3).select(F.lit("a").alias("archive_id"), F.col("id").alias("seq"), F.lit("text").alias("message_type"), F.concat(F.lit("love "), F.col("id").cast("string")).alias("text"))
    m = m.withColumns({"normalized_text": T.normalize_text(F.col("text")), "char_count": T.char_count(F.col("text")), "word_count": T.word_count(F.col("text")), "emoji_count": T.count_emoji(F.col("text"))})
    plan = A.annotate(m).where("highlight_candidate or milestone_candidate").select("emotion_label", "importance_score", "topic_tags")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") <= 1


def greedy(rows, limit, per_chapter, per_sender):
    """Ranked (chapter, sender, excerpt): the places taken."""
    taken, chapters, senders, seen = [], {}, {}, set()
    for i, (c, s, e) in enumerate(rows):
        if len(taken) < limit and chapters.get(c, 0) < per_chapter and senders.get(s, 0) < per_sender and e not in seen:
            taken.append(i + 1)
            chapters[c], senders[s] = chapters.get(c, 0) + 1, senders.get(s, 0) + 1
            seen.add(e)
    return taken


def test_greedy(spark):
    rows = [("1", "a", "x"), ("1", "b", "x"), ("1", "b", "y"), ("1", "c", "z"), ("2", "a", "w"), ("2", "a", "v"), ("-", "c", "u"), ("2", "b", "t"), ("3", "c", "s"), ("3", "c", "r")]
    df = spark.createDataFrame([("k", i + 1, *r) for i, r in enumerate(rows)], "archive_id string, rank int, _c string, _s string, excerpt string")
    for limit, c, s in ((10, 2, 2), (3, 2, 2), (10, 1, 9), (10, 9, 1), (1, 1, 1)):
        got = C.greedy(df, ["archive_id"], ["_c", "_s", "excerpt"], limit, lambda done, x: C.below(done, x, "_c", c) & C.below(done, x, "_s", s) & C.below(done, x, "excerpt", 1))
        assert [r["rank"] for r in got.orderBy("place").collect()] == greedy(rows, limit, c, s)
    assert C.greedy(df.limit(0), ["archive_id"], ["_c"], 3, lambda done, x: F.lit(True)).count() == 0


def test_diverse(spark):
    """Eight rows of one chapter and emotion: no second before the fourth place, so only one."""
    rows = [("k", i + 1, 1, "romantic", 0.9, "a quote of some length") for i in range(8)]
    h = spark.createDataFrame(rows, "archive_id string, rank int, chapter_no int, emotion_label string, importance_score double, text string")
    assert C.diverse_highlights(h).count() == 1
    many = [("k", i + 1, i + 1, ["romantic", "funny", "conflict", "nostalgic", "funny", "conflict", "romantic"][i], 0.9 - i / 100, "a quote of some length") for i in range(7)]
    got = C.diverse_highlights(spark.createDataFrame(many, h.schema)).orderBy("place").collect()
    assert [r["first_rank"] for r in got] == [1, 2, 3, 4, 6]  # 5 and 7 repeat a mood before four are taken, 6 comes after that


def fold_merge(obs):
    """Observations in order, merged one by one."""
    out = dict(obs[0], n=1, chunks=[obs[0]["chunk_no"]])
    for o in obs[1:]:
        for c in K.MEANS:
            out[c] = int((out[c] * out["n"] + o[c]) / (out["n"] + 1) * 10000 + 0.5) / 10000
        if o["importance_score"] >= out["importance_score"]:
            out["emotion_label"] = o["emotion_label"]
        for c in K.FLAGS:
            out[c] = out[c] or o[c]
        for c in K.TAGS:
            out[c] = list(dict.fromkeys(out[c] + o[c]))
        out["chunks"] = list(dict.fromkeys([*out["chunks"], o["chunk_no"]]))
        out["n"] += 1
    return out


def test_merge(spark):
    """One, two and three observations with differing scores, labels and tags; equal ones give the row back."""
    base = {"emotion_label": "romantic", "emotion_intensity": 0.5, "importance_score": 0.6, "evidence_score": 0.7, "highlight_candidate": False, "milestone_candidate": True, "support_signal": False, "conflict_signal": False, "repair_signal": False, "topic_tags": ["humor"], "archetype_tags": ["planning"]}
    sets = [
        [base], [base, dict(base, emotion_label="funny", importance_score=0.9, topic_tags=["travel", "humor"], support_signal=True)], [base, dict(base, emotion_label="funny", importance_score=0.1)],
        [base, dict(base, emotion_intensity=0.3333, emotion_label="conflict", importance_score=0.61), dict(base, importance_score=0.605, archetype_tags=["affection"], highlight_candidate=True)], [base, base, base],
    ]
    rows = [{"archive_id": "a", "seq": i, "chunk_no": k + 1, **o} for i, obs in enumerate(sets) for k, o in enumerate(obs)]
    kind = "archive_id string, seq long, chunk_no int, emotion_label string, emotion_intensity double, importance_score double, evidence_score double, highlight_candidate boolean, milestone_candidate boolean, support_signal boolean, conflict_signal boolean, repair_signal boolean, topic_tags array<string>, archetype_tags array<string>"
    names = [f.split(" ")[0] for f in kind.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in reversed(rows)], kind)
    for r in K.merge_annotations(df).collect():
        want = fold_merge([dict(o, chunk_no=k + 1) for k, o in enumerate(sets[r["seq"]])])
        assert {c: r[c] for c in [*K.MEANS, *K.FLAGS, *K.TAGS, "emotion_label", "chunks"]} == {c: want[c] for c in [*K.MEANS, *K.FLAGS, *K.TAGS, "emotion_label", "chunks"]}


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (120, 1), (121, 2), (225, 2), (226, 3)])
def test_chunk_counts(spark, n, want):
    m = spark.range(n).select(F.lit("a").alias("archive_id"), F.col("id").alias("seq"))
    assert S.chunk_windows(m).select("chunk_no").distinct().count() == want


def test_annotate_new(spark):
    """Only messages of chunks that aren't stored reach the annotator."""
    m = spark.range(240).select(F.lit("a").alias("archive_id"), F.col("id").alias("seq"), F.format_string("msg_%07d", F.col("id") + 1).alias("message_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("normalized_text"))
    kind = "provider string, version string, chunk_hash string, archive_id string, seq long, chunk_no int, label string"
    seen = spark.sparkContext.accumulator(0)

    def annotator(x):
        seen.add(x.count())
        return x.withColumn("label", F.lit("new"))

    first = K.annotate_new(m, spark.createDataFrame([], kind), annotator=annotator)
    stored = spark.createDataFrame(first.collect(), kind)
    assert stored.count() == 120 + 120 + 30 and seen.value == 270
    again = K.annotate_new(m, stored, annotator=annotator)
    assert again.count() == 270 and seen.value == 270
    changed = m.withColumn("normalized_text", F.when(F.col("seq") == 239, "other").otherwise(F.col("normalized_text")))
    more = K.annotate_new(changed, stored, annotator=annotator)
    assert seen.value == 300 and more.count() == 300


def test_month_shards(spark, tmp_path):
    rows = [("a", "2024-01", i, f"msg_{i}", datetime(2024, 1, 1, 0, i), None, "text", f"said {i}", "tech_0001", 1, None) for i in range(5)] + [("a", "2024-02", 5, "msg_5", datetime(2024, 2, 1), "p", "text", "x", "tech_0002", None, 2)]
    placed = spark.createDataFrame(rows, "archive_id string, month_key string, seq long, message_id string, ts timestamp_ntz, sender_id string, message_type string, text string, technical_session_id string, segment_no int, chapter_no int").withColumn("sender_label", F.col("sender_id"))
    tables.write_month_shards(placed, str(tmp_path / "m"))
    files = list((tmp_path / "m").glob("archive_id=a/month_key=2024-01/*.json"))
    assert len(files) == 1 and [json.loads(x)["text"] for x in files[0].read_text().splitlines()] == [f"said {i}" for i in range(5)]
    bad = placed.withColumns({"normalized_text": F.lit(None).cast("string"), "has_url": F.lit(True), "is_multiline": F.lit(False), "day_key": F.lit("d"), "week_key": F.lit("w"), "char_count": F.lit(-1), "word_count": F.lit(1), "emoji_count": F.lit(0), "hour_of_day": F.lit(24), "weekday": F.lit(6)})
    got = {r["rule"]: r["violations"] for r in tables.validate_table(bad, "messages").collect()}
    assert {k for k, v in got.items() if v} == {"normalized_text not null", "char_count not negative", "hour_of_day within 0 to 23"} and set(got.values()) == {0, 6}


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_sized_shards(spark, tmp_path, block):
    """Files of at most the size and a line, in order, as the manifest says; a broken run is not read, and a changed file is refused."""
    rows = [(a, None if i % 40 == 39 else f"2024-0{1 + i // 25}", i, f"msg_{i}", datetime(2024, 1, 1, 0, i % 60), "text", "é\n" + "x" * (i * 7919 % 90), f"s{i}", i, 1) for a in ("a", "b/c +%") for i in range(50)]
    placed = spark.createDataFrame(rows, "archive_id string, month_key string, seq long, message_id string, ts timestamp_ntz, message_type string, text string, technical_session_id string, segment_no int, chapter_no int").withColumns({"sender_id": F.lit(None).cast("string"), "sender_label": F.lit("p")})
    run = shards.publish(placed, str(tmp_path), 700, block)
    got: dict = {}
    for r in shards.read_shards(spark, str(tmp_path), run).collect():
        got.setdefault(r["path"].rsplit("/", 1)[0], []).append(r["value"])
    manifest = spark.read.parquet(f"{tmp_path}/run={run}/manifest").collect()
    assert len(manifest) == len(got) > 12 and {r["total_messages"] for r in manifest} == {50} and {r["shard_count"] for r in manifest} == {3}
    for r in manifest:
        lines = got[r["path"].rsplit("/", 1)[0]]
        assert len(lines) == r["n"] and sum(len(x.encode()) + 1 for x in lines) == r["bytes"] and sum(zlib.crc32(x.encode()) for x in lines) == r["checksum"]
        ids = [int(json.loads(x)["message_id"][4:]) for x in lines]
        assert ids == sorted(ids) and r["bytes"] - len(lines[-1].encode()) - 1 <= 700
    assert sorted(json.loads(x)["message_id"] for v in got.values() for x in v) == sorted(r[3] for r in rows)
    again = shards.publish(placed, str(tmp_path), 700, block)
    assert again != run and shards.read_shards(spark, str(tmp_path), run).count() == shards.read_shards(spark, str(tmp_path), again).count() == 100
    some = next(tmp_path.glob(f"run={again}/data/*/*/*/*.txt"))
    some.write_bytes(some.read_bytes() + b"{}\n")
    (some.parent / f".{some.name}.crc").unlink(missing_ok=True)
    with pytest.raises(FileNotFoundError):
        shards.read_shards(spark, str(tmp_path), again)
    empty = shards.publish(placed.limit(0), str(tmp_path), 700)
    assert spark.read.parquet(f"{tmp_path}/run={empty}/manifest").count() == 0


def test_rules(spark):
    """A violation of each kind of rule is counted once, by hand; lists, maps, rows and their nulls too; and by SQL the same."""
    import duckdb

    table = {
        "t": V.TEXT, "m": V.MAYBE, "n": V.Rule(0, 10), "e": V.Rule(labels=("a", "b")), "l": V.Rule(each=V.Rule(labels=("a", "b")), least=1), "c": V.Rule(values=V.COUNT),
        "r": V.Rule(fields={"d": V.TEXT, "k": V.Rule(low=1)}), "rs": V.Rule(each=V.Rule(fields={"k": V.COUNT})), "lacks": V.TEXT,
    }
    rows = [
        ("x", None, 0, "a", ["a"], {"p": 0}, ("d", 1), []),
        (None, None, 11, "c", [], {"p": -1}, (None, 1), [(-1,), (2,)]),
        ("", "y", -1, None, ["a", None], {}, ("d", 0), [(None,)]),
        ("x", "y", None, "b", ["c", "c"], None, None, None),
    ]
    df = spark.createDataFrame(rows, "t string, m string, n int, e string, l array<string>, c map<string,int>, r struct<d:string,k:int>, rs array<struct<k:int>>")
    got = {r["rule"].split(" ")[0]: (r["checked"], r["violations"]) for r in V.count_broken(df, "made", table).collect()}
    assert got == {"t": (4, 1), "m": (4, 0), "n": (4, 3), "e": (4, 2), "l": (4, 3), "c": (4, 2), "r": (4, 3), "rs": (4, 3), "lacks": (4, 4)}
    assert {(r["checked"], r["violations"]) for r in V.count_broken(df.limit(0), "made", table).collect()} == {(0, 0)}
    con = duckdb.connect()
    con.register("made", df.toArrow())
    sql = ", ".join(f"sum(CAST({r.sql(c)} AS INT))" for c, r in table.items() if c != "lacks")
    assert list(con.execute(f"SELECT {sql} FROM made").fetchone()) == [v for k, (_, v) in got.items() if k != "lacks"]
    ours, theirs = spark.createDataFrame([(1,), (2,), (2,), (None,)], "a int"), spark.createDataFrame([(1,), (1,), (None,)], "b int")
    assert [tuple(r) for r in V.count_orphans(ours, "o", ["a"], theirs, "p", ["b"]).collect()] == [("o", "a in p", 3, 2)]


def test_store(spark, tmp_path):
    """Only touched parts get new files, nothing new writes nothing, a broken run isn't read, and other providers have rows of their own."""
    schema = "provider string, version string, chunk_hash string, archive_id string, seq long, chunk_no long, label string"
    rows = lambda n, edit=None: spark.createDataFrame([("a", i, f"msg_{i}", "edited" if i == edit else f"text {i}") for i in range(n)], "archive_id string, seq long, message_id string, normalized_text string")
    seen = []

    def annotator(x):
        seen.append(x.count())
        return x.withColumn("label", F.concat(F.lit("of "), "normalized_text"))

    path = str(tmp_path / "store")
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    assert store.read_store(spark, path, schema).count() == 0
    assert store.annotate_into(rows(1000), path, schema, annotator=annotator) == 1
    first = files()
    assert store.annotate_into(rows(1000), path, schema, annotator=annotator) == 1 and files() == first and len(seen) == 1
    assert store.annotate_into(rows(1000, edit=500), path, schema, annotator=annotator) == 2 and seen[1] == 120
    after = files()
    assert {f: after[f] for f in first} == first and 0 < len([f for f in after if f not in first and "/data/" in f]) <= 8
    newest, parts = store.manifest(spark, path)
    assert newest == 2 and len(parts) >= 9 and len(set(parts.values())) == 2 and len([r for r in parts.values() if list(parts.values()).count(r) == 1]) == 1
    got = store.stored_annotations(rows(1000, edit=500), path, schema).collect()
    want = sorted((r["seq"], r["chunk_no"]) for r in K.in_chunks(rows(1000)).collect())
    assert sorted((r["seq"], r["chunk_no"]) for r in got) == want and {r["label"] for r in got if r["seq"] == 500} == {"of edited"}
    assert len(store.stored_annotations(rows(1000), path, schema).collect()) == len(want)
    (tmp_path / "store/data/run=broken/part=1").mkdir(parents=True)
    assert store.annotate_into(rows(1000), path, schema, provider="other", annotator=annotator) == 3 and store.read_store(spark, path, schema).count() == 2 * len(want) + 120
    # an update in place of rows with the same keys
    one = store.read_store(spark, path, schema).where("provider = 'rules' and seq = 3").limit(1).withColumn("label", F.lit("new"))
    assert store.upsert(spark, path, one, schema, ["provider", "version", "chunk_hash", "archive_id", "seq"]) == 4
    assert store.read_store(spark, path, schema).where("label = 'new'").count() == 1 and store.read_store(spark, path, schema).count() == 2 * len(want) + 120


def test_selections_of_many(spark):
    """500 candidates, limits of 100 and 7, against plain loops: nothing is cut before the selection."""
    import random

    rng = random.Random(5)
    moods = ["romantic", "funny", "supportive", "neutral"]
    rows = []
    for i in range(500):
        text = f"I love you and miss you, together number {rng.randrange(240)} ok"
        rows.append((1, i + 1, i, rng.choice([None, *range(1, 40)]), rng.choice(["ann", "bo", "cy", None]), rng.choice(moods), rng.choice([0.7, 0.8, 0.9]), text, ["affection"]))
    h = spark.createDataFrame(rows, "archive_id long, rank int, seq long, chapter_no int, sender_label string, emotion_label string, importance_score double, text string, archetype_tags array<string>").withColumn("sender_id", F.col("sender_label"))
    rated = sorted((r for r in C.rated_highlights(h).collect() if not r["low_value"] and r["quality"] > 20), key=lambda r: (-r["quality"], r["rank"]))
    assert len(rated) > 400
    for limit, a, b in ((100, 3, 40), (7, 1, 2)):
        taken = []
        for r in rated:
            n = lambda f: sum(f(x) == f(r) for x in taken)  # noqa: B023, E731
            if len(taken) < limit and n(lambda x: x["chapter_no"]) < a and n(lambda x: x["sender_label"]) < b and not n(lambda x: x["display_quote"]):
                taken.append(r)
        got = C.curate_highlights(h, limit, 170, a, b).orderBy("place").collect()
        assert [r["seq"] for r in got] == [r["seq"] for r in taken] and len(got) > limit // 2
    plain = sorted(rows, key=lambda r: (-(r[6] + (0.3 if r[5] != "neutral" else 0.0)), r[1]))
    for limit in (3, 6, 100):
        taken = []
        for r in plain:
            if len(taken) < limit and (len(taken) >= 4 or (r[3] is None or all(x[3] != r[3] for x in taken)) and all(x[5] != r[5] for x in taken)):
                taken.append(r)
        assert [r["seq"] for r in C.diverse_highlights(h, limit).orderBy("place").collect()] == [r[2] for r in taken]


def test_time_cube(messages, spark):
    """Cells sum to the tables that messages give, with senders, times and gaps missing; and to nothing for no messages."""
    from threadlake.operators import cube as Q
    from threadlake.operators import records as X
    from threadlake.operators import rollups as R
    from threadlake.sources.messages import features

    m = messages.withColumn("ts", F.when(F.col("seq") % 41 != 13, F.col("ts"))).withColumn("message_type", F.when(F.col("seq") % 23 == 5, "system").otherwise("text"))
    a = A.annotate(features(m.withColumns({"sender_label": F.col("sender_id"), "is_multiline": F.col("seq") % 9 == 4}))).cache()
    plain = lambda df: sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    for some in (a, a.limit(0)):
        rows, cube = Q.time_cube(some)
        assert sum(r["n"] for r in cube.collect()) == rows.count() == R.active(some).count()
        split = R.split_of(Q.month_counts(cube))
        pairs = [
            (Q.session_openers(cube), R.session_openers(some)), (R.overview_of(Q.sender_totals(cube), Q.session_openers(cube)), R.participant_overview(some)), (split, R.monthly_split(some)), (Q.late_night_trend(cube), R.late_night_trend(some)),
            (X.leaders_of(R.overview_of(Q.sender_totals(cube), Q.session_openers(cube)), Q.first_seen(cube)), X.participant_leaders(some)), (X.periods_of(cube), X.peak_periods(some)), (X.supporting(rows), X.supporting(some)),
            (X.balanced_of(split, 5), X.most_balanced_month(some, 5)), (X.takeover_of(R.winners_of(split)), X.monthly_takeover(some)),
        ]
        for got, want in pairs:
            assert plain(got) == plain(want)
    assert plain(Q.month_counts(Q.time_cube(a.drop(*Q.SIGNALS))[1])) == plain(Q.month_counts(Q.time_cube(a)[1]))
    a.unpersist()


@pytest.mark.parametrize("name", ["detective_records", "story_spotlights", "milestones", "homepage"])
def test_messages_are_read_once(spark, name):
    """What these queries hand back reads tables written once; the messages and their source are not read or annotated again."""
    files = entry.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "/testdata/" in f]
