"""Passage collections: fixed-width passages, line-numbered collections and registered copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def word_passages(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, passage, text): consecutive runs of `width` blank-separated words, from 0."""
    from ..functions.text import let
    cut = let(F.split(text_col, " "), lambda w: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(w) - 1) / width).cast("int")),
        lambda i: F.array_join(F.slice(w, i * width + 1, F.lit(width)), " ")))
    return docs.select(F.col(id_col), F.posexplode(cut).alias("passage", "text"))


def read_collection(spark: SparkSession, path: str, form: str = "tsv") -> DataFrame:
    """(pid, text) of a passage collection, tab-separated or JSON lines."""
    if form == "tsv":
        return spark.read.schema("pid string, text string").option("sep", "\t").option("quote", "").csv(path)
    return spark.read.schema("doc_id string, text string").json(path).select(F.col("doc_id").alias("pid"), "text")


def collection_gaps(collection: DataFrame) -> DataFrame:
    """What is wrong with a collection whose ids must be its line numbers 0..n-1: one row of counts, all zero if sound.

    Ids that are exactly 0..n-1 without repeats are the line numbers in some order; no row needs a global position.
    """
    number = F.col("pid").try_cast("bigint")
    return collection.agg(
        F.count_if(number.isNull()).alias("not_numbers"),
        (F.count(F.lit(1)) - F.count_distinct(number)).alias("repeats"),
        (F.coalesce(F.max(number), F.lit(-1)) + 1 - F.count_distinct(number)).alias("gaps"))


def registered_copies(rows: DataFrame, digest: str = "digest", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Each row with the document that registers its content: the first id of the digest."""
    # Distinct sources are combined per digest before counting, so a digest with many copies stays small.
    per_source = rows.groupBy(digest, source).agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = per_source.groupBy(digest).agg(F.min("first").alias("document"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("sources"))
    return rows.join(groups, digest).select(id_col, "document", (F.col(id_col) != F.col("document")).alias("duplicate"), "copies", "sources")


def new_documents(staged: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, duplicates) of staged sources by document id: one staged source per id creates the document."""
    known = stored.select("document_id").withColumn("__known", F.lit(True))
    one = staged.groupBy("document_id").agg(F.min("source_id").alias("__first"))
    marked = staged.join(one, "document_id").join(known, "document_id", "left")
    fresh = F.col("__known").isNull() & (F.col("source_id") == F.col("__first"))
    return (marked.where(fresh).select(staged.columns), marked.where(~fresh).select(staged.columns))
