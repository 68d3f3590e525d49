"""URL filters: host and path rules, and block decisions carried over redirect and canonical links. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import lower_ascii, materialize
from threadlake.llm.components import connected_components

Rule = tuple[str, str, str]
#: (verdict, host, path)
RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
TRACKING = r"(?:utm_[a-z]+|fbclid|gclid|ref)=[^&#]*"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Rules are a parameter, a few hundred at most."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def same_address(url: Column) -> Column:
    """The address without its fragment, scheme and host lower-cased; null without ://."""
    scheme = F.lower(F.regexp_extract(url, "^[^/?#]*?://", 0))
    tail = F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(scheme, host_of(url), tail))


def common_address(url: Column) -> Column:
    """The address that common redirects lead to: no scheme, www. or fragment, no tracking parameters, no final /."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(?<=^|&){TRACKING}(?:&|$)", ""), "&+$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", ""), "/+$", "")
    full = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.locate("://", url) > 0, full)


def _without_dots(path: Column) -> Column:
    """The path with . and .. segments carried out; it begins with /."""

    def step(done: Column, x: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(x == "..", up).when(x == ".", done).otherwise(F.concat(done, F.array(x)))

    kept = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    return F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))


def resolve(reference: Column, base: Column) -> Column:
    """The absolute address of a reference on a page at base, or null for other schemes and bases without ://."""
    root = F.regexp_extract(base, "^[^/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract(path_of(base), "^.*/", 0)
    page = F.regexp_extract(base, "^[^?#]*", 0)
    path, tail = F.regexp_extract(reference, "^[^?#]*", 0), F.regexp_extract(reference, "^[^?#]*(.*)$", 1)
    at_root = F.concat(root, _without_dots(path), tail)
    beside = F.concat(root, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)), tail)
    found = (
        F.when(reference.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), reference).when(reference.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(reference.startswith("//"), F.concat(F.regexp_extract(base, "^[^/?#]*?:", 0), reference)).when(reference.startswith("/"), at_root)
        .when(reference.startswith("?") | reference.startswith("#") | (reference == ""), F.concat(page, reference)).otherwise(beside)
    )
    return F.when((F.locate("://", base) > 0) | reference.contains("://"), found)


def links(pages: DataFrame) -> DataFrame:
    """(url, target): the canonical links and meta refreshes of the pages, whole addresses.

    References are resolved against the page, or its <base href>. What stands in comments and scripts doesn't count.
    """
    href = r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
    canonical = rf"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b)[^>]*{href}"""
    refresh = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""
    with_head = pages.select("url", "html").where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|http-equiv"))
    plain = with_head.select("url", F.regexp_replace("html", r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)", " ").alias("html"))
    value = lambda x: F.replace(F.replace(F.trim(x), F.lit("&amp;"), F.lit("&")), F.lit("&#38;"), F.lit("&"))
    groups = F.arrays_zip(*(F.regexp_extract_all("html", F.lit(canonical), k).alias(f"g{k}") for k in (1, 2, 3)))
    named = F.transform(groups, lambda g: F.concat(g["g1"], g["g2"], g["g3"]))
    base = F.expr(rf"""regexp_extract(html, r'(?i)<base\b[^>]*\bhref\s*=\s*["\x27]?([^"\x27\s>]+)', 1)""")
    found = plain.select("url", base.alias("base"), F.explode(F.concat(named, F.regexp_extract_all("html", F.lit(refresh), 1))).alias("ref"))
    at = F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(resolve(value(F.col("base")), F.col("url")), F.col("url")))
    return found.select("url", resolve(value(F.col("ref")), at).alias("target")).where("target is not null")


def judge_urls(pages: DataFrame, rules: list[Rule] = RULES, redirects: DataFrame | None = None, address=same_address) -> DataFrame:
    """page_id, host, path, rule, verdict, alias (the group's first address) of every page.

    Canonical links, meta refreshes and the rows of `redirects` (url, target) join addresses; all addresses
    of a component with an address that a rule blocks are blocked, unless a rule of their own allows them.
    address says which urls are one address: by default those that differ in the fragment or in the case
    of the host; common_address also joins those that sites commonly redirect to one another, on no
    evidence but their form. A url that is null or has no :// has empty host and path, belongs to no group,
    and is allowed unless a rule fits. Null html has no links, html of any length is read whole; repeated
    rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    edges = materialize(edges.distinct())
    hops = edges.select(address(F.col("url")).alias("a"), address(F.col("target")).alias("b"))
    groups = materialize(connected_components(hops))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # a url without an address meets no group: a key of its own keeps such rows from one task
    lone = F.concat(F.lit("\0"), F.xxhash64("page_id", "url").cast("string"))
    known = pages.select("page_id", "url", host.alias("host"), path.alias("path"), F.coalesce(address(F.col("url")), lone).alias("node")).withColumn("rule", rule).withColumn("own", verdict)
    others = edges.select(F.col("target").alias("url"), host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path"), address(F.col("target")).alias("node")).withColumn("own", verdict)
    seeds = known.select("node", "own").unionByName(others.select("node", "own")).where("own = 'block' and node is not null").select("node").distinct()
    blocked = materialize(seeds.join(groups, "node", "left").select(F.coalesce("component", "node").alias("alias")).distinct())
    placed = known.join(groups, "node", "left").withColumn("alias", F.coalesce("component", "node"))
    judged = placed.join(blocked.withColumn("hit", F.lit(True)), "alias", "left")
    said = F.coalesce("own", F.when(F.col("hit"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", said.alias("verdict"), F.when(~F.col("alias").startswith("\0"), F.col("alias")).alias("alias"))
