"""The corpus pipeline: five stages over ``documents``, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidyshelf.llm.common import ship_package, table, unused
from tidyshelf.llm.decontaminate import clean_documents
from tidyshelf.llm.ngram_join import jaccard_components
from tidyshelf.llm.packing import pack_documents
from tidyshelf.llm.queries import vocabulary
from tidyshelf.llm.suffix_dedup import remove_repeats
from tidyshelf.llm.toxicity import keep_clean
from tidyshelf.storage import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on ``labels``, rejects go."""
    ship_package(spark)
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that which gives the group its name."""
    ship_package(spark)
    named = jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    # an id that stands in several rows stays with one of them; the join's partitions serve the window too
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    [first] = unused(docs, "place")
    rows = docs.join(named, "doc_id", "left_semi").withColumn(first, place).filter(F.col(first) == 1)
    # a row without an id cannot be named by its group; it stays
    return rows.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte below a 200-byte string that starts anywhere else goes; all documents stay."""
    ship_package(spark)
    return remove_repeats(docs).select(docs.columns).withColumn("n_chars", F.char_length("text").cast("long"))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents lose their hit spans; others, with short chance hits, stay as they are."""
    ship_package(spark)
    cut = clean_documents(docs, table(spark, sf_dir, "benchmark"))
    return cut.withColumn("n_chars", F.char_length("text").cast("long"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut and packed into windows of 4096 tokens."""
    ship_package(spark)
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic), ("ngram_join", one_of_each_group), ("suffix_dedup", cut_repeats),
    ("decontaminate", cut_benchmark), ("packing", pack_windows),
]

#: Learned scores, hashes of token ids and window numbers are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    store, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.freeze(stage(spark, docs, sf_dir), name)
    return docs
