"""Hooks for user models: cached structured inference, embeddings with checks, degradation rules and offline defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let, literals, words
from ..functions.vectors import hash_embedding, valid_vector
from ..session import cut_lineage


def cache_key(operation: str, version: str, model: str, payload: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(version), F.lit(model), F.lit(operation), payload), 256)


def cached_inference(rows: DataFrame, fn: Callable[[str], str], schema: str, cache: DataFrame, operation: str, version: str = "1",
                     model: str = "default", payload: str = "payload", tries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(answered rows, fresh cache rows). Each distinct payload that is not cached is asked once.

    `fn` maps a JSON payload to JSON; output that does not parse to `schema` is retried, then kept as an error. Answered
    rows carry `result` (struct) and `error`; fresh rows are to be appended to the cache table. Repeated payloads meet
    one cached answer, so a payload shared by many rows costs one call.
    """
    keyed = rows.withColumn("key", cache_key(operation, version, model, F.col(payload)))
    todo = keyed.select("key", F.col(payload).alias("payload")).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        for pdf in batches:
            outputs, errors = [], []
            for text in pdf["payload"]:
                output, error = None, None
                for _ in range(tries):
                    try:
                        output, error = fn(text), None
                        json.loads(output)
                        break
                    except PermissionError:  # an account refusal fails the job, no fallback may hide it
                        raise
                    except Exception as exc:
                        output, error = None, f"{type(exc).__name__}: {exc}"
                outputs.append(output)
                errors.append(error)
            yield pd.DataFrame({"key": pdf["key"].to_numpy(), "output": pd.Series(outputs, dtype=object), "error": pd.Series(errors, dtype=object)})

    fresh = todo.mapInPandas(ask, "key string, output string, error string")
    fresh = cut_lineage(fresh)  # paid answers are never asked again by a later stage
    usable = fresh.where("error is null").select("key", "output")
    answers = cache.select("key", "output").unionByName(usable)
    failed = fresh.where("error is not null").select("key", "error")
    joined = keyed.join(answers, "key", "left").join(failed, "key", "left")
    parsed = F.from_json("output", schema)
    return joined.withColumn("result", parsed).withColumn(
        "error", F.coalesce("error", F.when(parsed.isNull(), F.lit("invalid output")))).drop("output"), usable


def embed(rows: DataFrame, cache: DataFrame | None = None, fn: Callable[[pd.Series], pd.Series] | None = None, text: str = "text",
          stamp: str = "hash:64", dimensions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with vec, fresh cache rows): each distinct text is embedded once; unusable vectors become null."""
    keyed = rows.withColumn("__key", F.sha2(F.concat(F.lit(stamp + ":"), F.col(text)), 256))
    todo = keyed.select("__key", F.col(text).alias("__t")).dropDuplicates(["__key"])
    if cache is not None:
        todo = todo.join(cache.select(F.col("key").alias("__key")), "__key", "left_anti")
    vector = hash_embedding(F.col("__t")) if fn is None else F.pandas_udf(fn, "array<double>")(F.col("__t"))
    fresh = todo.select(F.col("__key").alias("key"), vector.alias("vec")).withColumn("vec", F.when(valid_vector(F.col("vec"), dimensions), F.col("vec")))
    if fn is not None:
        fresh = cut_lineage(fresh)  # a given model answers each text once, for the rows and for the cache alike
    known = fresh if cache is None else cache.select("key", "vec").unionByName(fresh)
    return keyed.join(known.withColumnRenamed("key", "__key"), "__key", "left").drop("__key"), fresh


def changed_embeddings(concepts: DataFrame, stored: DataFrame, stamp: str, text: str = "text") -> DataFrame:
    """Concepts that are new, changed or embedded by another model: (id, key, text)."""
    keyed = concepts.select("id", F.substring(F.sha2(F.concat(F.lit(stamp + ":"), F.col(text)), 256), 1, 24).alias("key"), F.col(text).alias("text"))
    return keyed.join(stored.select("id", "key"), ["id", "key"], "left_anti")


# --- Offline defaults ---
def lexical_relevance(need: Column, text_words: Column) -> Column:
    """At least two content words of the need are among a text's words (one when it has only one)."""
    wanted = F.array_except(words(need), literals(_stop()))
    return let(wanted, lambda w: (F.size(w) > 0) & (F.size(F.array_intersect(w, text_words)) >= F.least(F.lit(2), F.size(w))))


def _stop():
    from ..functions.text import STOP_WORDS
    return [*STOP_WORDS, "about"]


def score_policy(score: Column, retrievable: Column, floor: float = 0.16) -> Column:
    """Default navigation: SELECT a leaf or EXPAND a container that scores enough, else PRUNE."""
    return F.when(score >= floor, F.when(retrievable, F.lit("SELECT")).otherwise(F.lit("EXPAND"))).otherwise(F.lit("PRUNE"))


def question_as_need(questions: DataFrame) -> DataFrame:
    """Default decomposition: parts joined by `and` become needs N1, N2...; also what a failed decomposition falls back to."""
    parts = F.filter(F.transform(F.split("text", r"\s+and\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return questions.select("query_id", F.posexplode(parts).alias("need_no", "description")).withColumn(
        "need_id", F.concat(F.lit("N"), (F.col("need_no") + 1).cast("string")))


def excerpt_answer(context: DataFrame) -> DataFrame:
    """What an answer falls back to: every packed excerpt with its id; the context budget bounds it."""
    from ..sources.conversations import ordered_text
    line = F.concat("text", F.lit(" ["), "evidence_id", F.lit("]"))
    return context.groupBy("query_id").agg(F.concat(F.lit("Synthesis unavailable. Evidence excerpts:\n"), ordered_text(F.col("place"), line, "\n")).alias("answer"))


def assertion_rejects(assertions: DataFrame, leaves: DataFrame, known: DataFrame) -> DataFrame:
    """Extracted assertions that may not be stored: quote absent, unknown contradiction, inverted range."""
    joined = assertions.join(leaves.select(F.col("id").alias("leaf_id"), F.col("text").alias("__t")), "leaf_id", "left")
    targets = (assertions.select("assertion_id", F.explode("contradicts_ids").alias("id")).join(known.select("id"), "id", "left_anti")
               .select("assertion_id").distinct().withColumn("__unknown", F.lit(True)))
    reason = (F.when(~F.coalesce(F.col("__t").contains(F.col("supporting_quote")), F.lit(False)), F.lit("quote_absent"))
              .when(F.col("__unknown"), F.lit("unknown_contradiction"))
              .when(F.col("valid_from") > F.col("valid_to"), F.lit("inverted_range")))
    return joined.join(targets, "assertion_id", "left").withColumn("reason", reason).where(F.col("reason").isNotNull()).select("assertion_id", "reason")


def assertion_edges(assertions: DataFrame, about: DataFrame) -> DataFrame:
    """SUPPORTED_BY, ABOUT (the leaf's concepts) and CONTRADICTS edges of accepted assertions."""
    support = assertions.select(F.col("assertion_id").alias("src"), F.col("leaf_id").alias("dst"), F.lit("SUPPORTED_BY").alias("relation"))
    concepts = assertions.join(about.select(F.col("src").alias("leaf_id"), "dst"), "leaf_id").select(F.col("assertion_id").alias("src"), "dst", F.lit("ABOUT").alias("relation"))
    against = assertions.select(F.col("assertion_id").alias("src"), F.explode("contradicts_ids").alias("dst"), F.lit("CONTRADICTS").alias("relation"))
    return support.unionByName(concepts).unionByName(against).distinct()


def enrichment_candidates(hits: DataFrame, leaves: DataFrame, done: DataFrame, threshold: int = 3) -> DataFrame:
    """Leaves used often enough and not enriched yet."""
    often = hits.where(F.col("navigation_hits") + F.col("successful_retrievals") >= threshold).select(F.col("node_id").alias("id"))
    return leaves.join(often, "id", "left_semi").join(done.select("id"), "id", "left_anti")
