"""Quality rules by cross-document line frequency, in DataFrame functions only.

Base rules judge a text alone.  The method looks across documents: normalised lines are hashed, the distinct documents of each host
that hold a line are counted, lines above the host's limit are taken away, and a document of which too little stays is rejected.
Copies of a document count as one: documents are told apart by a hash of the whole text, so that a page which was merely crawled often
doesn't make its own lines look like boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialised

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of a repeated window.
WINDOW = 8
#: A line is taken away if more distinct documents of its host hold it than both this number and this share of them.
LEAST, SHARE = 20, 0.05
#: Frequent lines, and documents that lose some, that are broadcast at most; beyond that they are joined by a shuffle.
MOST_BROADCAST = 100_000


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in windows that the text holds twice or more.  Sorting (hash, place) puts equal windows side by side."""

    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    def covered(win: Column) -> Column:
        pairs = F.array_sort(F.transform(win, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, i)["v"] == F.get(s, j)["v"], F.lit(False))
        places = let(pairs, lambda s: F.array_sort(F.transform(F.filter(s, lambda _, i: same(s, i, i - 1) | same(s, i, i + 1)), lambda x: x["i"])))
        steps = let(places, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct((a["n"] + x + WINDOW - F.greatest(x, a["end"])).alias("n"), (x + WINDOW).alias("end")))["n"])
        return steps

    distinct = lambda win: F.size(F.array_distinct(win)) == F.size(win)
    found = let(hashed_words(words), lambda h: let(hashed(h), lambda win: F.when(distinct(win), F.lit(0)).otherwise(covered(win))))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(found)


def hashed_words(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, " " + SPACES, "") != "")
    words = free_name("__words", docs)
    return (
        docs.withColumn(words, words_of(t))
        .withColumn("n_words", F.size(words).cast("long"))
        .withColumn("word_chars", F.length(F.translate(t, " " + SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col(words)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .drop(words)
    )


def normalised(line: Column) -> Column:
    """Lines are compared without case, digits and the amount of white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), "[\\x20\\x09-\\x0D]+", " "))


def document_lines(docs: DataFrame, row: str, text: str, host: str) -> DataFrame:
    """row, line (hash of host and normalised line), own (hash of the document's text), words and place of each line with a word."""
    t = F.coalesce(F.col(text), F.lit(""))
    own_lines = F.filter(F.transform(F.split(t, "\n"), normalised), lambda x: x != "")
    hashes = lambda lines: F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("w")))
    both = let(own_lines, lambda lines: F.struct(F.xxhash64(t).alias("own"), hashes(lines).alias("lines")))
    rows = docs.select(F.col(row).alias("row"), F.col(host).alias("host"), both.alias("both")).select("row", "host", "both.own", F.posexplode("both.lines").alias("place", "x"))
    return rows.select("row", "host", F.xxhash64(F.coalesce("host", F.lit("")), "x.h").alias("line"), "own", F.col("x.w").alias("words"), "place")


def frequent_lines(lines: DataFrame, hosts: DataFrame, least: int, share: float) -> DataFrame:
    """Lines in more than max(least, share of the host's distinct documents) distinct documents of a host."""
    pairs = lines.groupBy("host", "line", "own").agg(F.lit(1).alias("one"))
    counts = pairs.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    limits = hosts.select(F.col("host").alias("of"), "docs")
    return counts.join(limits, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > share * F.col("docs")).select("line").distinct()


def quality_rules(docs: DataFrame, text: str = "text", id_col: str = "doc_id", host: str = "source", least: int = LEAST, share: float = SHARE, keep_share: float = 0.3, min_words: int = 20) -> DataFrame:
    """Judges each document by the base rules and by how much of it stays without its host's frequent lines.

    docs: any columns; id_col, text and host are used, all others pass through (an input column named like an added one is replaced).
    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words (long), base_failed, kept (boolean).
    least, share: a line goes if more distinct documents of its host hold it than both ``least`` and ``share`` of the host's distinct documents.
    A document is rejected if base_failed, or if it lost words that way and keeps fewer than ``min_words`` words or than ``keep_share``
    of its words.
    Null, empty or blank text: no words, so base_failed and not kept.  Null host: a host of its own.  Null or repeated ids: each row is
    judged; equal rows (id, host, text) get equal results.  An empty table gives an empty result.  A text of any length is read whole.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")
    row = free_name("__row", docs)
    keyed = docs.withColumn(row, F.xxhash64(F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")), F.coalesce(F.col(host).cast("string"), F.lit("\0")), F.coalesce(F.col(text), F.lit("\0")))))
    lines = document_lines(keyed, row, text, host)
    own = docs.select(F.col(host).alias("host"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own")).distinct()
    hosts = own.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    frequent = materialised(frequent_lines(lines, hosts, least, share))
    n = frequent.count()
    base = base_rules(keyed, text)
    if n:
        known = F.broadcast(frequent) if n <= MOST_BROADCAST else frequent
        hits = lines.join(known, "line", "left_semi").groupBy("row", "place").agg(F.max("words").alias("words"))
        lost = materialised(hits.groupBy(F.col("row").alias(row)).agg(F.sum("words").cast("long").alias("removed_words")))
        # texts are only dealt out if too many of them lose a line
        base = base.join(F.broadcast(lost) if lost.count() <= MOST_BROADCAST else lost, row, "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    else:
        base = base.withColumn("removed_words", F.lit(0).cast("long"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < min_words) | (left < keep_share * F.col("n_words")))
    return base.withColumn("kept", ~F.col("base_failed") & ~depleted).drop(row)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = quality_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
