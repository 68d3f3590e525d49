"""Gaps, sessions, chunks and streaks of an archive's messages in order, by blocks of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.labels import CHUNK_OVERLAP, CHUNK_SIZE, SESSION_GAP

KEYS = ("archive_id",)
#: Messages of an archive that one task orders.
BLOCK_ROWS = 1 << 20


def minutes(later: Column, earlier: Column) -> Column:
    """Whole minutes between two timestamps without zone, rounded half up."""
    seconds = F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))
    return F.floor(seconds / 60.0 + 0.5)


def since(later: Column, earlier: Column) -> Column:
    """Minutes from earlier to later, 0 if it goes back; null where nothing is earlier."""
    return F.when(earlier.isNotNull(), F.greatest(F.lit(0), minutes(later, earlier)).cast("int"))


def in_blocks(rows: DataFrame, order: str, block_rows: int) -> DataFrame:
    """Rows with _block: ranges of `order`, so that no block of an archive has more than block_rows of them."""
    return rows.withColumn("_block", F.floor(F.col(order) / block_rows))


def block_edges(m: DataFrame, keys, gap: int, order: str) -> tuple[DataFrame, DataFrame]:
    """Of rows with _block, two tables of a row a block: the last time before it, with rows and sessions before it; and its senders' last times before it.

    A block is summed up by its rows, first and last time and the sessions that start within it. Blocks are put
    together by sums over their summaries, of which an archive has one for each block_rows messages.
    """
    by = [*keys, "_block"]
    within, blocks = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*keys).orderBy("_block")
    ahead = blocks.rowsBetween(Window.unboundedPreceding, -1)
    starts = lambda g: (g.isNull() | (g >= gap)).cast("int")
    rows = m.select(*by, order, "ts", starts(since(F.col("ts"), F.lag("ts").over(within))).alias("_new"), F.row_number().over(within).alias("_place"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(F.when(F.col("_place") > 1, F.col("_new")).otherwise(0)).alias("_new"), F.min_by("ts", order).alias("_from"), F.max_by("ts", order).alias("_to"))
    sums = sums.withColumn("_last", F.lag("_to").over(blocks))
    sums = sums.withColumn("_first", starts(since(F.col("_from"), F.col("_last"))))
    before = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    sums = sums.select(*by, "_last", before(F.col("_n")).alias("_rows"), (before(F.col("_new") + F.col("_first")) + F.col("_first")).alias("_sessions"))
    own = m.where("sender_id is not null").groupBy(*by, "sender_id").agg(F.max_by("ts", order).alias("_to"))
    own = own.withColumn("_to", F.lag("_to").over(Window.partitionBy(*keys, "sender_id").orderBy("_block"))).where("_to is not null")
    own = own.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("sender_id", "_to"))).alias("_own"))
    # a group is one row; named as a group, Spark sees that the key is unique and leaves a join out where nothing of it is used
    sums = sums.groupBy(*by).agg(*(F.first(c).alias(c) for c in ("_last", "_rows", "_sessions")))
    return sums, own


#: What with_sessions adds; columns of these names are replaced.
ADDED = ["gap_minutes", "session_no", "reply_gap_minutes", "technical_session_id"]


def with_sessions(messages: DataFrame, keys=KEYS, gap: int = SESSION_GAP, order: str = "seq", number: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add gap_minutes, session_no, reply_gap_minutes and technical_session_id; with `number` also each row's place from 0.

    `order` is a whole number, unique within an archive, not null. Rows are dealt to blocks of its ranges, so an archive of any
    share of all rows is many tasks: gaps and sessions are counted within blocks, and what a block needs of those
    before comes from a small table of the blocks. Messages are shuffled once, and read once more for that table
    (their times and senders only). A message without time has gap 0, the one after it none. Keys are not null.
    """
    by = [*keys, "_block"]
    kept = [c for c in messages.columns if c not in ADDED]
    m = in_blocks(messages.select(*kept), order, block_rows)
    sums, own_ends = block_edges(m, keys, gap, order)
    within, own = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by, "sender_id").orderBy(order)
    m = m.repartition(*by).withColumns({"_gap": since(F.col("ts"), F.lag("ts").over(within)), "_place": F.row_number().over(within)})
    new = (F.col("_place") > 1) & (F.col("_gap").isNull() | (F.col("_gap") >= gap))
    m = m.withColumns({"_new": F.sum(new.cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0)), "_reply": since(F.col("ts"), F.lag("ts").over(own)), "_own_place": F.row_number().over(own)})
    m = m.join(sums, by, "left").join(own_ends, by, "left")
    session = (F.col("_new") + F.coalesce("_sessions", F.lit(1))).cast("int")
    reply = F.when(F.col("_own_place") > 1, F.col("_reply")).otherwise(since(F.col("ts"), F.col("_own")[F.col("sender_id")]))
    out = {
        "gap_minutes": F.when(F.col("_place") > 1, F.col("_gap")).otherwise(since(F.col("ts"), F.col("_last"))), "session_no": session,
        "reply_gap_minutes": F.when(F.col("sender_id").isNotNull(), reply), "technical_session_id": F.format_string("tech_%04d", session),
    }
    if number:
        kept = [c for c in kept if c != number]
        out[number] = (F.col("_place") - 1 + F.coalesce("_rows", F.lit(0))).cast("long")
    return m.select(*kept, *(c.alias(n) for n, c in out.items()))


def silence_gaps(messages: DataFrame, keys=KEYS, limit: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The longest gaps between neighbouring active messages: (keys, seq, from_seq, gap_minutes, rank).

    A block of rows is summed up by its longest gaps and its first and last row; neighbours in different blocks meet
    among these, at most limit + 2 rows a block.
    """
    by = [*keys, "_block"]
    m = in_blocks(messages.where("message_type <> 'system'").select(*keys, "seq", "ts"), "seq", block_rows)
    within = Window.partitionBy(*by).orderBy("seq")
    wait = lambda earlier: F.round(minutes(F.col("ts"), earlier).cast("double"), 2)
    pairs = m.select(*by, "seq", "ts", F.lag("seq").over(within).alias("from_seq"), wait(F.lag("ts").over(within)).alias("gap_minutes"), F.lead("seq").over(within).isNull().alias("_end"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("gap_minutes"), "seq"))
    some = pairs.withColumn("_best", best).where((F.col("_best") <= limit) | F.col("from_seq").isNull() | F.col("_end"))
    whole = Window.partitionBy(*keys).orderBy("seq")
    begins = F.col("from_seq").isNull()
    # what stands before a block's first row here is the last row of the block before
    some = some.select(*keys, "seq", F.when(begins, F.lag("seq").over(whole)).otherwise(F.col("from_seq")).alias("from_seq"), F.when(begins, wait(F.lag("ts").over(whole))).otherwise(F.col("gap_minutes")).alias("gap_minutes"))
    top = Window.partitionBy(*keys).orderBy(F.desc("gap_minutes"), "seq")
    return some.where("gap_minutes > 0").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= limit)


def chunk_windows(messages: DataFrame, keys=KEYS, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, columns=()) -> DataFrame:
    """(keys, seq, columns, chunk_no from 1): overlapping row windows, by arithmetic on seq and an archive's count, which is one row of it."""
    step = max(size - overlap, 1)
    counts = messages.groupBy(*keys).agg(F.count("*").alias("_n"))
    last = F.when(F.col("_n") <= size, 0).otherwise(F.ceil((F.col("_n") - size) / step))
    low = F.greatest(F.lit(0), F.ceil((F.col("seq") - size + 1) / step))
    high = F.least(last, F.floor(F.col("seq") / step))
    counted = messages.select(*keys, "seq", *columns).join(counts, [*keys])
    return counted.select(*keys, "seq", *columns, F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("_k")).select(*keys, "seq", *columns, (F.col("_k") + 1).alias("chunk_no"))


def longest_streak(messages: DataFrame, keys=KEYS) -> DataFrame:
    """The longest run of consecutive days with active messages; the days are few, and made distinct before they are shuffled."""
    return streak_of(messages.where("message_type <> 'system'").select(*keys, "day_key").distinct(), keys)


def streak_of(days: DataFrame, keys=KEYS) -> DataFrame:
    """The longest run of consecutive days in a table of (keys, day_key)."""
    days = days.select(*keys, F.to_date("day_key").alias("d"))
    runs = days.withColumn("run", F.date_sub("d", F.row_number().over(Window.partitionBy(*keys).orderBy("d"))))
    return runs.groupBy(*keys, "run").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("longest_streak"))
