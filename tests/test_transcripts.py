"""The parser and the chapter fold on small invented inputs."""

from datetime import datetime

import pytest

from threadlake.operators.narrative import with_chapters
from threadlake.sources import transcripts as P

LINES = [
    "before any header", "1/2/2024, 12:05 am - Group made", "1/2/2024, 12:06\u202fPM - Bo: hi  there", "second line", "31/02/2024, 1:00pm - Al: <Media omitted>",
    "2/3/2024, 9:00 am - Al: This message was deleted", "2/3/2024, 9:01 am - note: from nobody", "",
]


def test_canonical(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("\r\n".join(LINES).encode())
    lines = P.read_transcripts(spark, str(tmp_path))
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == LINES
    got = [tuple(r) for r in P.canonical(lines).orderBy("seq").select("message_id", "source_line_start", "source_line_end", "ts", "sender_label", "sender_id", "message_type", "text", "is_multiline").collect()]
    assert got == [
        ("msg_0000001", 2, 2, datetime(2024, 2, 1, 0, 5), None, None, "system", "Group made", False),
        ("msg_0000002", 3, 4, datetime(2024, 2, 1, 12, 6), "Bo", "participant_01", "text", "hi there second line", True),
        ("msg_0000003", 5, 5, datetime(2024, 3, 2, 13, 0), "Al", "participant_02", "media_omitted", "<Media omitted>", False),
        ("msg_0000004", 6, 6, datetime(2024, 3, 2, 9, 0), "Al", "participant_02", "deleted", "This message was deleted", False),
        ("msg_0000005", 7, 8, datetime(2024, 3, 2, 9, 1), "note", "participant_03", "text", "from nobody", True),
    ]


def test_no_lines(spark):
    none = spark.createDataFrame([], "archive_id string, line_no long, line string")
    assert P.canonical(none).count() == 0
    odd = spark.createDataFrame([("a", 1, "1/1/2024, 1:00 am - x: y"), ("a", 2, None)], none.schema)
    assert [(r["text"], r["source_line_end"]) for r in P.canonical(odd).collect()] == [("y", 2)]


@pytest.mark.parametrize("counts,want", [([50, 1, 1, 1, 1, 1, 1, 60], [1, 2, 2, 2, 2, 2, 2, 2]), ([10], [1]), ([5] * 20, None)])
def test_chapters(spark, counts, want):
    df = spark.createDataFrame([("a", i + 1, n) for i, n in enumerate(counts)], "archive_id string, segment_no long, message_count long")
    got = [r["chapter_no"] for r in with_chapters(df).orderBy("segment_no").collect()]
    assert got == (want or [i // 4 + 1 for i in range(20)])


def plain_lines(data: bytes):
    return list(enumerate(data.decode().replace("\r\n", "\n").split("\n"), 1)) if data else []


def test_files_in_blocks(spark, tmp_path):
    """Files split into blocks of 16 to 64 bytes: carriage returns across borders, long and empty lines, with and without a last line feed."""
    head = "1/2/2024, 9:05 am - "
    texts = {
        "a.txt": f"before\r\n{head}Ann: one\r\n\r\nmore\n{head}Bob: {'long ' * 60}\n\n\n{head}left\n", "b.txt": f"{head}Cid: a\rb\n{head}Ann: no end", "c.txt": "\n", "d.txt": "", "e.txt": "x",
        "f.txt": "".join(f"{head}{'ABC'[i % 3]}: {i}" + "\r\n" * (1 + i % 2) for i in range(200)),
    }
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    want = sorted((name, n, line) for name, t in texts.items() for n, line in plain_lines(t.encode()))
    whole, old = None, {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (16, 33, 64, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            lines = P.read_transcripts(spark, str(tmp_path))
            assert sorted(map(tuple, lines.collect())) == want
            if size < 1 << 20:
                assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
            for block in (1, 3, 1 << 20) if size == 33 else (7,):
                got = sorted(map(tuple, P.canonical(lines, block).collect()), key=lambda r: (r[0], r[1]))
                whole = whole or got
                assert got == whole and len(got) == 204
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [(r[0], r[-1]) for r in whole if r[0] == "f.txt"][:4] == [("f.txt", f"participant_0{i}") for i in (1, 2, 3, 1)]


def test_no_archive_in_one_task(spark, tmp_path):
    """No window of the parser is keyed by the archive alone over lines: such windows stand on tables of blocks and senders."""
    lines = spark.createDataFrame([("a", 1, "x")], "archive_id string, line_no long, line string")
    plan = P.assemble_records(P.parse_lines(lines))._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window" in x]
    assert len(windows) == 2 and sum("[archive_id" in x and "_block" not in x.split("[archive_id")[-1].split("]")[0] for x in windows) == 1
