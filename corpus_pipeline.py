"""From raw documents to training sequences: drop toxic texts and texts in no known language, keep one of each group of near
duplicates, pack what is left. Every stage works on all rows its predecessor kept; all but the last return the columns of `documents`.

Rows with null ids or texts pass the filters like empty clean texts would: a null text is not toxic, and goes at the
language stage, as it has no letter. A text in no learned language goes where its cosine is no better than that of shuffled letters;
one of too few different n-grams to tell (about 32) stays.
"""

from __future__ import annotations

import uuid

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession, functions as F

from lorekeep.llm import language, ngram_join, packing, queries, toxicity
from lorekeep.session import cut_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of all documents, does not mark."""
    model = toxicity.learn(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels").where(queries.id_crc(5) != 0))
    return toxicity.score(docs, model, keep=tuple(COLUMNS)).where("score < 0.5").select(COLUMNS)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labels of all documents; a missing `lang` is filled in."""
    labelled = queries.table(spark, sf_dir, "documents").where(queries.id_crc(3) != 1)
    model = language.learn(labelled, "text", "lang")  # all labelled rows, as for the least cosines
    found = language.predict(docs, model, keep=tuple(COLUMNS), least=language.least_cosines(labelled, model))
    known = found.where(F.col("lang_pred") != language.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; documents without an id are in no group."""
    groups = ngram_join.near_duplicates(docs)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    kept = kept.select(F.col("doc_id").alias("kept"), "rows")
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept"))).select(*COLUMNS, "rows")
    # Repeated ids are rare, so only their rows are compared: the first by text stays.
    again = rows.where("rows > 1 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*[c for c in COLUMNS if c != "doc_id"])).alias("r"))
    return rows.where("rows = 1 or doc_id is null").select(COLUMNS).union(again.select("doc_id", "r.*").select(COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, as query op10_packing shows them."""
    return queries.piece_digests(packing.pack(docs, vocabulary("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("language", drop_unidentified), ("near_duplicates", keep_one), ("packing", pack)]

#: Learned models decide what stays, which SQL can't express; tests compare run() with the same steps on single documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet below the checkpoint folder and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{cut_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
