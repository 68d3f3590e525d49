"""Chat exports as plain text: lines to records to canonical messages, all per archive.

A header line starts a record and other lines continue it; lines before the first header are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.functions.labels import SPACES
from threadlake.functions.text import normalize_whitespace

#: The header line `d/m/yyyy, h:mm am - rest` and the texts that name a type.
HEADER = rf"(?i)\A([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}),[{SPACES}]+([0-9]{{1,2}}:[0-9]{{2}})[{SPACES}]*(am|pm)[{SPACES}]+-[{SPACES}]+([^\n\r\x{{2028}}\x{{2029}}]*)\z"
#: Lines that one task numbers records of.
BLOCK_LINES = 1 << 20
MEDIA, DELETED = "<Media omitted>", "message was deleted"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(archive_id, line_no, line) of text files, an archive each, named by the file; lines count from 1.

    Lines end with a line feed, or a carriage return and one; after a last one comes an empty line. An empty file has
    no lines. Files are split like any text: a line is counted in the block of the file where it begins, and moved
    by the lines of the blocks before, so neither a file nor an archive meets in one task.
    """
    meta = ["file_path", "file_name", "file_block_start", "file_size"]
    raw = spark.read.option("lineSep", "\n").text(path).select("value", *(F.col(f"_metadata.{c}").alias(c) for c in meta))
    block = ["file_path", "file_block_start"]
    counts = raw.groupBy(*block, "file_name", "file_size").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("size"))
    ahead = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*block, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*block).orderBy("at"))
    placed = raw.withColumn("at", F.monotonically_increasing_id()).withColumn("place", place).join(before, block)
    lines = placed.select(F.col("file_name").alias("archive_id"), (F.col("place") + F.col("before")).cast("long").alias("line_no"), F.regexp_replace("value", r"\r\z", "").alias("line"))
    # all lines with a line feed each are as long as the file only if the last one has it too
    files = counts.groupBy("file_path", "file_name", "file_size").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    last = files.where("size = file_size").select(F.col("file_name").alias("archive_id"), (F.col("n") + 1).cast("long").alias("line_no"), F.lit("").alias("line"))
    return lines.unionByName(last)


def render_lines(m: DataFrame) -> DataFrame:
    """The lines of an export with these messages; a text breaks after each sentence."""
    ts = F.col("ts")
    stamp = F.concat(F.day(ts), F.lit("/"), F.month(ts), F.lit("/"), F.year(ts), F.lit(", "), (F.hour(ts) + 11) % 12 + 1, F.lit(":"), F.date_format(ts, "mm"), F.when(F.hour(ts) < 12, " am").otherwise(" pm"), F.lit(" - "))
    body = F.concat(stamp, F.coalesce(F.concat("sender_label", F.lit(": ")), F.lit("")), F.regexp_replace("text", "([.!?]) ", "$1\n"))
    pieces = m.select("archive_id", "seq", F.split(body, "\n").alias("pieces"))
    before = F.sum(F.size("pieces")).over(Window.partitionBy("archive_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    numbered = pieces.withColumn("before", F.coalesce(before, F.lit(0)))
    return numbered.select("archive_id", "before", F.posexplode("pieces").alias("at", "line")).select("archive_id", (F.col("before") + F.col("at") + 1).cast("long").alias("line_no"), "line")


def parse_lines(lines: DataFrame) -> DataFrame:
    """is_header and, for headers, timestamp_raw and rest. A null line continues a record with nothing."""
    line = F.coalesce("line", F.lit(""))
    # the parts of a header by one replacement; NUL is in none but the last, which keeps its own
    parts = F.when(line.rlike(HEADER), F.split(F.regexp_replace(line, HEADER, "$1, $2 \0$3\0$4"), "\0", 3))
    cut = lines.select("archive_id", "line_no", line.alias("line"), parts.alias("p"))
    p = F.col("p")
    return cut.select("archive_id", "line_no", p.isNotNull().alias("is_header"), F.concat(p[0], F.lower(p[1])).alias("timestamp_raw"), F.coalesce(p[2], "line").alias("rest"))


def assemble_records(parsed: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """A row a record, which is a header and the lines up to the next one.

    Records are counted within blocks of lines, and on from the headers of the blocks before; the lines of one that
    lies in several blocks then meet by its number. So no task has more than a block's lines, or a record's.
    """
    p = parsed.withColumn("_block", F.floor((F.col("line_no") - 1) / block_lines))
    header = F.col("is_header").cast("long")
    ahead = Window.partitionBy("archive_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = p.groupBy("archive_id", "_block").agg(F.sum(header).alias("_n")).select("archive_id", "_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    own = F.sum(header).over(Window.partitionBy("archive_id", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    numbered = p.withColumn("_own", own).join(counts, ["archive_id", "_block"]).withColumn("record_no", F.col("_own") + F.col("_before"))
    some = numbered.where("record_no > 0").groupBy("archive_id", "record_no")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "rest"))), lambda x: x["rest"]), "\n")
    return some.agg(F.min("line_no").alias("source_line_start"), F.max("line_no").alias("source_line_end"), F.max("timestamp_raw").alias("timestamp_raw"), text.alias("body"))


def split_sender(records: DataFrame) -> DataFrame:
    """sender_label before the first ": " of the header line, if anything is; raw_text after it."""
    at = F.locate(": ", F.substring_index("body", "\n", 1))
    label = F.when(at > 1, F.col("body").substr(F.lit(1), at - 1))
    return records.select("*", label.alias("sender_label"), F.when(at > 1, F.col("body").substr(at + 2, F.length("body"))).otherwise(F.col("body")).alias("raw_text")).drop("body")


def parse_timestamp(raw: Column) -> Column:
    """Day, month and hour beyond their range roll over; built by calendar arithmetic, since a cast would give null."""
    n = lambda k: F.regexp_extract(raw, r"\A(\d+)/(\d+)/(\d+), (\d+):(\d+) ([ap]m)\z", k)
    day, month, year, hour, minute = (n(k).cast("int") for k in range(1, 6))
    hour = F.when((n(6) == "pm") & (hour != 12), hour + 12).when((n(6) == "am") & (hour == 12), 0).otherwise(hour)
    date = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute)


def detect_type(sender: Column, text: Column) -> Column:
    return F.when(sender.isNull(), "system").when(text == MEDIA, "media_omitted").when(F.lower(text).contains(DELETED), "deleted").otherwise("text")


def number_senders(messages: DataFrame) -> DataFrame:
    """(archive_id, sender_label, sender_id): senders by first appearance, from one row a sender."""
    first = messages.where("sender_label is not null").groupBy("archive_id", "sender_label").agg(F.min("seq").alias("first"))
    rank = F.row_number().over(Window.partitionBy("archive_id").orderBy("first"))
    return first.select("archive_id", "sender_label", F.format_string("participant_%02d", rank).alias("sender_id"))


def canonical(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Messages of a table of lines: (archive_id, seq, message_id, source lines, ts, sender_id, sender_label, message_type, text, is_multiline)."""
    r = split_sender(assemble_records(parse_lines(lines), block_lines))
    text = normalize_whitespace(F.col("raw_text"))
    m = r.select("archive_id", (F.col("record_no") - 1).alias("seq"), F.format_string("msg_%07d", "record_no").alias("message_id"), "source_line_start", "source_line_end", "timestamp_raw", parse_timestamp(F.col("timestamp_raw")).alias("ts"), "sender_label", text.alias("text"), (F.col("source_line_end") > F.col("source_line_start")).alias("is_multiline"))
    m = m.withColumn("message_type", detect_type(F.col("sender_label"), F.col("text")))
    return m.join(number_senders(r.select("archive_id", (F.col("record_no") - 1).alias("seq"), "sender_label")), ["archive_id", "sender_label"], "left").select(*m.columns, "sender_id")
