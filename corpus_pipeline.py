"""A corpus pipeline over documents: language, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.language import UNKNOWN, learn, predict
from tessera.llm.mixing import in_mixed_order, mix
from tessera.llm.neardup import near_duplicates
from tessera.llm.packing import pack, tokenizer_path
from tessera.llm.personal import find_personal, masked


#: The least cosine of a text with so many distinct n-grams or more, and of those with fewer the least that names a language.
#: Cosines with unrelated text scatter by 1/32 around 0, so that 0.125 is four times that. Measured with profiles of 2,500
#: documents of sf0.1: of 3,500 other documents those with 16 n-grams or more score at least 0.145, from 32 on 0.233, from
#: 128 on 0.491 (with profiles of 30 to 400 documents 0.167, 0.227 and 0.495). 1 to 20,000 random Cyrillic, Greek or Han
#: words score at most 0.15, random Latin letters at most 0.211, 0.195 and 0.23 in the three classes. So junk of Latin
#: letters with 16 to 31 n-grams may pass. Shorter texts can't be told apart. On check_s 21 of 51,282 labelled documents come
#: below, 20 of them with the label of the nearest language.
LEAST_COSINE = ((128, 0.3), (32, 0.2), (16, 0.125))
NAMING_COSINE = 0.125


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that resemble a language learned from the labelled ones. Those without a letter go, and those whose cosine
    with every language is one that unrelated text of their size reaches too (``LEAST_COSINE``; half of it suffices where the
    nearest language is the document's own label, as short or repetitive texts come below it). Texts with fewer than 16
    distinct n-grams are too short to tell and stay. A missing ``lang`` becomes the predicted one, or ``und`` for short
    texts without a clear one; the others stay."""
    profiles = learn(docs, "text", "lang")
    found = predict(docs, "text", profiles, "__lang", "__score", "__grams")
    least = F.lit(0.0)
    for grams, cosine in reversed(LEAST_COSINE):
        least = F.when(F.col("__grams") >= grams, F.lit(cosine)).otherwise(least)
    confirmed = F.coalesce(F.col("lang") == F.col("__lang"), F.lit(False))
    kept = found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= F.when(confirmed, least / 2).otherwise(least)))
    named = F.when(F.col("__score") >= NAMING_COSINE, F.col("__lang")).otherwise(F.lit(UNKNOWN))
    return kept.withColumn("lang", F.coalesce("lang", named)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 of five-word shingles): the one with the smallest id,
    of one id the one with the smallest hash of its text, and of rows with one id and one text the first by the other
    columns. Ids are only names here: rows that share an id, or have none, are decided by their own texts. Texts without a
    word have no near-duplicates but rows with the same id and text."""
    scratch = Scratch(spark, "near_dedup")
    found = near_duplicates(docs, "doc_id", "text", by_print=True)
    marks = found.groupBy(F.col("doc_id").alias("__id"), F.col("print").alias("__its_print")).agg(
        F.bool_and("kept").alias("__kept"), F.count(F.lit(1)).alias("__n")
    )
    marks = scratch.keep(marks.where(~F.col("__kept") | (F.col("__n") > 1)))
    repeated = scratch.keep(marks.where(F.col("__kept")))
    printed = docs.withColumn("__print", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__its_print"))
    out = printed.join(scratch.small(marks), same, "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return out
    own = Window.partitionBy("doc_id", "__print").orderBy(*docs.columns)
    first = printed.join(scratch.small(repeated), same, "left_semi").withColumn("__place", F.row_number().over(own))
    return out.unionByName(first.where("__place = 1").select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind in brackets; ``n_chars`` follows the text."""
    scratch = Scratch(spark, "personal_data")
    found = find_personal(docs, "doc_id", "text", scratch=scratch)
    clean = masked(docs, "doc_id", "text", found, scratch)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in mixed order, every one at least once, those of small sources again until all sources are through.
    The documents' columns stay as they are, also ones named like those that the mix adds."""
    own = docs.toDF(*(f"__own_{c}" for c in docs.columns))
    mixed = mix(own.withColumn("__print", F.xxhash64("__own_text")), "__own_source", ["__own_doc_id", "__print"])
    return in_mixed_order(mixed).select(*own.columns).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents packed into sequences of at most 2048 tokens, with the pieces' places."""
    return pack(docs, "doc_id", "text", tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the language profiles nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of the folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
