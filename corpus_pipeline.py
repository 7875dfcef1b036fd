"""A training corpus from raw documents: each stage works on all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps; the last returns packed pieces. Rows are told
apart by id and text, so rows with a null id, or with one id and other texts, are documents of their own. An empty table
gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footstats.llm.common import cut, remainder, table, tokenizer_path
from footstats.llm.contamination import find_contamination
from footstats.llm.jaccard import row_key, similar_rows
from footstats.llm.language import is_accepted, learn_languages
from footstats.llm.packing import pack_documents
from footstats.llm.personal import learn_personal, redact, with_spans

#: Column that tells rows apart inside a stage.
KEY = "row_key_"


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or far from every learned language go."""
    models = learn_languages(docs, remainder("doc_id", 4) != 2)
    return docs.where(is_accepted(models, spark)("text"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one row stays: that of the smallest id (null last), of
    equal ids that of the smallest row key; of equal rows one. Texts without words are no copies and all stay."""
    rows, sets = similar_rows(docs, width=5, percent=80)
    order = F.struct(F.col("r.doc_id").isNull(), F.col("r.doc_id"), F.col("r.key"))
    first = rows.alias("r").join(sets.select("set_id", "root"), "set_id").groupBy("root").agg(F.min_by("r.key", order).alias(KEY)).select(KEY)
    keyed = docs.withColumn(KEY, row_key())
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    copies = keyed.where(worded).join(first, KEY, "left_semi").dropDuplicates([KEY])
    return copies.unionByName(keyed.where(~worded)).drop(KEY)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    keyed = docs.withColumn(KEY, row_key())
    found = find_contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=KEY)
    return keyed.join(found.where("contaminated").select(KEY), KEY, "left_anti").drop(KEY)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars`` follows the text."""
    found = with_spans(docs, learn_personal(docs), spans_col="personal_spans_")
    changed = F.size("personal_spans_") > 0
    return found.withColumn("text", redact(F.col("text"), F.col("personal_spans_"))).withColumn(
        "n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens for training."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_languages),
    ("near_copies", without_near_copies),
    ("decontamination", without_test_items),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: No stage of language models, components or tokens can be said in SQL; the tests run brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
