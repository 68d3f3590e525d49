"""Text and calendar features as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions.labels import EMOJI, LATE_HOURS, SPACES, STOP_WORDS

#: Double-decoded punctuation and what it stood for; the fifth catches what the last three would.
REPAIRS = [("â€™", "’"), ("â€˜", "‘"), ("â€œ", "“"), ("â€\x9d", "”"), ("â€", "”"), ("â€”", "—"), ("â€“", "–"), ("â€¦", "…")]


def normalize_whitespace(c: Column) -> Column:
    for wrong, right in REPAIRS:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return F.trim(F.regexp_replace(c, f"[{SPACES}]+", " "))


def normalize_text(c: Column) -> Column:
    return normalize_whitespace(F.lower(c))


def count_emoji(c: Column) -> Column:
    """What can't be an emoji goes first, by a class of few ranges; the long class sees only the rest."""
    rest = F.regexp_replace(c, r"[\x00-\xA8\xAA-\xAD\xAF-\x{203B}]+", "")
    return F.regexp_count(rest, F.lit(EMOJI)).cast("int")


def has_url(c: Column) -> Column:
    return c.rlike(r"(?i)(https?://|www\.)")


def words_in(normal: Column) -> Column:
    """Words of a text whose white space is normal already, in whatever case."""
    return F.size(F.filter(F.split(normal, " "), lambda x: x != ""))


def word_count(c: Column) -> Column:
    return words_in(normalize_whitespace(c))


def char_count(c: Column) -> Column:
    """UTF-16 code units."""
    return (F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("int")


def tokenize(c: Column) -> Column:
    plain = F.regexp_replace(normalize_text(c), rf"[^\p{{L}}\p{{N}}{SPACES}]", " ")
    return F.filter(F.split(plain, f"[{SPACES}]+"), lambda x: (char_count(x) > 1) & ~x.isin(STOP_WORDS))


def slugify(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(normalize_text(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def title_case(c: Column) -> Column:
    parts = F.filter(F.split(c, rf"[_\-{SPACES}]+"), lambda x: x != "")
    return F.array_join(F.transform(parts, sentence_case), " ")


def format_compact(c: Column) -> Column:
    """1234 as 1.2K: at most one decimal, rounded before the unit is chosen."""
    out = F.format_string("%d", c.cast("long"))
    for power, unit, least in ((3, "K", 1000), (6, "M", 999_950), (9, "B", 999_950_000), (12, "T", 999_950_000_000)):
        scaled = F.regexp_replace(F.format_string("%.1f", F.round(c / F.lit(float(10**power)), 1)), r"\.0$", "")
        out = F.when(F.abs(c) >= least, F.concat(scaled, F.lit(unit))).otherwise(out)
    return out


def weekday(ts: Column) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(ts) - 1).cast("int")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def week_key(ts: Column) -> Column:
    return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def late_night(hour: Column) -> Column:
    return hour.isin(LATE_HOURS)


def weekend(day: Column) -> Column:
    return day.isin(0, 6)
