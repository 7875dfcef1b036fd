"""The registered queries of this subpackage, over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footstats.llm.common import remainder, table, tokenizer_path
from footstats.llm import bitslices, contamination, jaccard, mining, nearest, prefix_trie
from footstats.llm.bitslices import top_products
from footstats.llm.contamination import find_contamination
from footstats.llm.jaccard import similarity_classes
from footstats.llm.language import identify_languages, learn_languages
from footstats.llm.lattice import score_documents
from footstats.llm.licenses import scan_licenses
from footstats.llm.mining import mine_negatives
from footstats.llm.nearest import nearest_neighbours
from footstats.llm.packing import pack_documents
from footstats.llm.personal import BASE_KINDS, digest, find_personal
from footstats.llm.prefix_trie import conversation_trie
from footstats.llm.tokens import count_edited_tokens, editorial_edits
from footstats.llm.toxicity import learn_toxicity, score_toxicity


def op1_edited_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", editorial_edits(F.col("text")))
    return count_edited_tokens(docs, tokenizer_path("byte_bpe_50k.tiktoken"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = learn_languages(docs, remainder("doc_id", 4) != 2)
    return identify_languages(docs, models).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted", "bits"
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 3) == 1
    model = learn_toxicity(docs, labels, ~held_out)
    return score_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(k) for k in BASE_KINDS], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans")
    )


def op7_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 5) == 1
    scored = score_documents(table(spark, sf_dir, "documents"), ~held_out, tokenizer_path("piece_bpe_32k.model"))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"), width=3, percent=90)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches, and in ``n_near`` the windows found with all but a fifth of their words within two words of their places."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slack=2)


def op10_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which near matches were first registered; the rows are those of ``op10_decontamination``."""
    return op10_decontamination(spark, sf_dir)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def op12_bitsliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_edited_tokens": op1_edited_tokens,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_personal_data": op6_personal_data,
    "op7_vantage_search": op7_vantage_search,
    "op8_lattice_score": op8_lattice_score,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontamination": op10_decontamination,
    "op10_near_passages": op10_near_passages,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_bitsliced_search": op12_bitsliced_search,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op7_vantage_search": nearest.ORACLE_SQL,
    "op9_jaccard_join": jaccard.ORACLE_SQL,
    "op10_decontamination": contamination.ORACLE_SQL,
    "op10_near_passages": contamination.ORACLE_SQL,
    "op11_hard_negatives": mining.ORACLE_SQL,
    "op12_bitsliced_search": bitslices.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
