"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

The filter of the listed canonical URLs is itself a table: a row for each block of eight 64-bit words, in which a URL sets one bit in
each word.  It grows with the list.  Probing is a hash join on the block's number, by a broadcast while the filter is small and by a
shuffle beyond that; only rows whose eight bits are set go on to the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialised

LANES = 8
#: Blocks of 64 bytes that are broadcast at most (4 MB), and listed URLs among the hits.
MOST_BLOCKS, MOST_LISTED = 1 << 16, 100_000
URLS_PER_BLOCK = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that don't change a page.
TRACKING = "(utm_[a-z]+|ref|fbclid|gclid)"


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a closing slash or ``.html``, and the query without tracking parameters; null stays null."""
    host = F.regexp_replace(host_of(url), r"\A(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html?)?/*\z", "")
    query = F.regexp_extract(after_scheme(url), r"\A[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(rf"\A{TRACKING}="))), "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def bits(key: Column) -> list[Column]:
    """One bit of each of the eight words."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(key, 6 * i).bitwiseAND(F.lit(63))).cast("int")) for i in range(LANES)]


def bloom_filter(listed: DataFrame, url: str = "url", most: float = float("inf")) -> tuple[DataFrame, int]:
    """block and word0..word7 of the listed canonical URLs, and the number of blocks; a row for each block that isn't empty.
    With ``most`` blocks the filter grows no further and lets more through."""
    n = listed.count()
    blocks = 1
    while blocks * URLS_PER_BLOCK < n and blocks < most:
        blocks *= 2
    keyed = listed.select(F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block"), F.xxhash64(url, F.lit(1)).alias("key"))
    words = [F.bit_or(b).alias(f"word{i}") for i, b in enumerate(bits(F.col("key")))]
    return keyed.groupBy("block").agg(*words), blocks


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.  rules: (verdict, host, path); they become one expression."""
    expr = None
    for verdict, of, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        value = F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))
        expr = F.when(fits, value) if expr is None else expr.when(fits, value)
    return expr if expr is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_known(rows: DataFrame, ones: DataFrame, key: Column, own: str, small: bool) -> DataFrame:
    """rows, each with the row of ``ones`` whose column ``own`` is its key, if any.  Rows with a null key, which may be nearly all, have
    no part in a shuffle."""
    if small:
        return rows.join(F.broadcast(ones), key == F.col(own), "left")
    return rows.filter(key.isNotNull()).join(ones, key == F.col(own), "left").unionByName(rows.filter(key.isNull()), allowMissingColumns=True)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", listed_url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict ("allow" or "block").

    A rule decides where one fits, the longest first; else a URL is blocked if its canonical form is that of a listed URL.
    Null URL or one without ``://``: empty host and path, no rule, allowed.  Null listed URLs are ignored; repeated ones count once.
    Empty tables give what their rows give.  Other columns of pages pass through, whatever their names; those named like an added one
    are replaced.  Rules become one expression of the plan, so there are 1000 at most; a longer list of rules raises.
    """
    if len(rules) > 1000:
        raise ValueError("1000 rules at most: they are compiled into the plan")
    names = materialised(listed.select(canonical(F.col(listed_url)).alias("name")).filter("name is not null").distinct())
    words, blocks = bloom_filter(names, "name")
    pages = pages.drop("host", "path", "rule", "verdict")
    own, of, bits_of, hit = (free_name(c, pages) for c in ("__own", "__block", "__words", "__hit"))
    rows = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    said = matching_rule(F.col("host"), F.col("path"), rules)
    name = F.when(said.isNull() & (F.col("host") != ""), canonical(F.col(url)))
    rows = rows.withColumn(own, F.struct(said.alias("said"), name.alias("name")))
    name = F.col(f"{own}.name")
    block = F.when(name.isNotNull(), F.pmod(F.xxhash64(name), F.lit(blocks)))
    held = words.select(F.col("block").alias(of), F.struct(*[F.col(f"word{i}") for i in range(LANES)]).alias(bits_of))
    probed = with_known(rows, held, block, of, blocks <= MOST_BLOCKS)
    set_all = F.lit(True)
    for i, b in enumerate(bits(F.xxhash64(name, F.lit(1)))):
        set_all = set_all & (F.col(f"{bits_of}.word{i}").bitwiseAND(b) != 0)
    may = F.when(set_all, name)
    # the hits that the filter lets through, once each, meet the list; the answer goes back to the rows
    exact = materialised(probed.select(may.alias(hit)).filter(F.col(hit).isNotNull()).distinct().join(names.withColumnRenamed("name", hit), hit, "left_semi"))
    out = with_known(probed, exact, may, hit, exact.count() <= MOST_LISTED)
    verdict = F.coalesce(F.col(f"{own}.said.verdict"), F.when(F.col(hit).isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], "host", "path", F.col(f"{own}.said.rule").alias("rule"), verdict.alias("verdict"))


#: The rules of OP7's SQL, which blocks net/de/; the query goes by its contract's, which allows it.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
CONTRACT_RULES = [("allow", of, start) if of + start == "net/de/" else (verdict, of, start) for verdict, of, start in RULES]
LISTED_HOST = r"(\A|\.)spam-farm\."


def op7_urls(spark, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of all pages of spam-farm hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = pages.filter(host_of(F.col("url")).rlike(LISTED_HOST)).select("url")
    return filter_urls(pages, listed, CONTRACT_RULES).select("page_id", "host", "path", "rule", "verdict")
