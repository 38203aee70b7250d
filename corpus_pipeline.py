"""A corpus pipeline: toxic documents go, repeated passages go, one document of each near-duplicate group stays, and the rest
is packed into sequences. Each stage's result is written as Parquet and read again as the next one's documents.

Of every stage: all columns of documents pass through, whatever their names, and none but doc_id and text is needed; a null or empty
text is a document like any other (it has no terms, no passages and no n-grams, and is packed as its end mark alone); rows with a
null doc_id are never compared with others and stay; rows of equal doc_id and text are one document and share its fate; a text of any
length is handled whole; ties go to the smallest doc_id; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm.entries import packed_pieces
from ostinato.llm.key_filter import without
from ostinato.llm.line_dedup import deduplicated
from ostinato.llm.shingle_join import shingle_components
from ostinato.llm.toxic_terms import learn, without_toxic
from ostinato.runtime import persist_table, ship_package, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learned on the labelled ones of them doesn't reject."""
    ship_package(spark)
    return without_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; n_chars, if there, is that of the text that is left. One that had nothing
    else goes; one that was empty stays."""
    ship_package(spark)
    names = docs.columns
    numbered = docs.toDF(*[f"d{k}" for k in range(len(names))])
    place = {n: f"d{k}" for k, n in enumerate(names)}
    cut = deduplicated(numbered, place["doc_id"], place["text"])
    text = F.col(place["text"])
    left = cut.where(~((F.col("deleted_words") > 0) & (F.trim(text) == "")))
    if "n_chars" in place:
        own = place["n_chars"]
        left = left.withColumn(own, F.when(F.col("deleted_words") > 0, F.length(text)).otherwise(F.col(own)).cast(docs.schema["n_chars"].dataType))
    return left.select(numbered.columns).toDF(*names)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by sets of five-word n-grams at a similarity of 0.8 or more."""
    ship_package(spark)
    names = docs.columns
    groups = shingle_components(docs, "doc_id", "text", 5, 80)
    later = groups.where("component_id <> doc_id").select("doc_id", "text_hash").distinct()
    numbered = docs.toDF(*[f"d{k}" for k in range(len(names))])
    told = numbered.withColumns({"doc_id": F.col(f"d{names.index('doc_id')}"), "text_hash": F.xxhash64(f"d{names.index('text')}")})
    later = persist_table(later.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "later")
    on = ["doc_id", "text_hash"]
    keys = groups.select("doc_id", "text_hash").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    # documents that can't be among the later ones go by without a shuffle of their texts
    return without(told, on, later, on, keys).select(numbered.columns).toDF(*names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences and places."""
    ship_package(spark)
    return packed_pieces(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("packing", packing)]

#: SQL can't express the learned score, the alignment or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
