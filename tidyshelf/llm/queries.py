"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyshelf.llm.common import table
from tidyshelf.llm.cotraining import score_quality
from tidyshelf.llm.decontaminate import find_hits, hit_columns
from tidyshelf.llm.language_model import score_held_out
from tidyshelf.llm.minmax_dedup import near_duplicates
from tidyshelf.llm.ngram_join import jaccard_components
from tidyshelf.llm.packing import pack_documents
from tidyshelf.llm.periodic_runs import periodic_runs
from tidyshelf.llm.quality_rules import judge_documents
from tidyshelf.llm.spelling import spelling_variants
from tidyshelf.llm.suffix_dedup import measure_repeats
from tidyshelf.llm.token_counts import count_tokens
from tidyshelf.llm.toxicity import score_toxicity
from tidyshelf.llm.warc import read_warc, write_warc
from tidyshelf.storage import Workspace


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_repeats(table(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Workspace(spark)
    pages = table(spark, sf_dir, "pages")
    manifest = write_warc(pages, f"{store.root}/archives", workspace=store)
    kind = pages.schema["page_id"].dataType.simpleString()
    records = read_warc(spark, manifest, with_payload=False)
    return records.select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hit_columns(found).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), thinned=31)


def op12_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup, "op2_language_model": op2_language_model, "op3_packing": op3_packing,
    "op4_cotraining": op4_cotraining, "op5_quality_rules": op5_quality_rules, "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts, "op8_decontaminate": op8_decontaminate, "op9_toxicity": op9_toxicity,
    "op10_ngram_join": op10_ngram_join, "op11_spelling_variants": op11_spelling_variants,
    "op12_minmax_dedup": op12_minmax_dedup, "op13_periodic_runs": op13_periodic_runs,
}
