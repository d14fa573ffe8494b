"""A training corpus from raw documents: quality rules, language identification, near-duplicate removal, substring
deduplication and packing, each stage on what the one before it kept.

All stages take the columns of ``documents``; other columns are left out, whatever their names, and an empty table gives an empty
result.  Null or repeated ids are documents of their own.  Texts of any length are read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import materialised
from sedimenta.llm.jaccard import keep_one
from sedimenta.llm.language import UNKNOWN, fold, identify
from sedimenta.llm.packing import pack
from sedimenta.llm.quality import quality_rules
from sedimenta.llm.substrings import drop_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its best language has no more than this share.
LEAST_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject: among them those with a null, empty or short text.  Repeated rows share a verdict."""
    return quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: a null text, one without a letter, or one whose best language isn't likelier than all others
    together (so ties go).  lang becomes the one identified; a null lang or id is fine, repeated rows share a verdict."""
    learn = F.coalesce(fold() != 0, F.lit(True))
    found = identify(docs.select(*COLUMNS), learn).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") > LEAST_SHARE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that with the smallest id, a null id last, any of equal ids; of equal rows one.
    Documents without words (null or empty texts) are in no group and all stay."""
    return keep_one(docs.select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; a document of which nothing stays keeps its row, with an empty text.  Texts that repeat
    nothing (empty and null ones too, whose n_chars is null) stay as they are; equal rows empty each other."""
    out = drop_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences; a null or empty text is its end id alone.  Pieces of equal length are taken by
    id and piece."""
    import public_tokenizers

    return pack(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]

#: Learned languages, similarity groups and packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
