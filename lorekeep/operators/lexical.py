"""BM25 statistics and top-k over whole collections, word frequencies, verbatim passage lookup."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.text import BM25_STOP_WORDS, let, terms
from ..session import cut_lineage
from .nearest import blocked_topk

K1, B = 1.2, 0.75  # fixed values: BM25 saturation and length normalisation
#: Cells of a dense part of a block's term weights.
CELLS = 4_000_000


def tokens_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per BM25 token occurrence: (id, term)."""
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z0-9]+"), F.lit(0))
    return (docs.select(F.col(id_col), F.explode(found).alias("term"))
            .where(~F.col("term").isin(BM25_STOP_WORDS)))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    return tokens_of(queries, id_col, text_col).distinct()


def postings(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, length, term, tf) of the vocabulary's terms in each document, plus one row with a null term per document.

    Tokens are counted where the text is read: one partial aggregate per (document, term) before anything moves, and
    words outside the vocabulary never leave their task.
    """
    found = F.filter(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z0-9]+"), F.lit(0)),
                     lambda t: ~t.isin(BM25_STOP_WORDS))
    tokens = docs.select(F.col(id_col), found.alias("tokens")).select(
        id_col, F.size("tokens").alias("length"),
        F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("tokens"))).alias("term"))
    wanted = vocabulary.select(F.col("term").alias("wanted")).unionByName(
        docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("wanted")))
    return (tokens.join(wanted, F.col("term").eqNullSafe(F.col("wanted")), "left_semi")
            .groupBy(id_col, "length", "term").agg(F.count(F.lit(1)).alias("tf")))


def _weighed(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_col: str, query_text: str) -> tuple[DataFrame, DataFrame]:
    """Documents (id, numbers, weights) and queries (id, numbers, weights): the numbers of their terms in the queries' vocabulary, the weights as arrays of
    the same length. A score is the sum over common terms of the products of both weights.

    The collection is read once: its postings are written as one row per document, from which statistics and weights are made.
    """
    wanted = cut_lineage(query_terms(queries, query_col, query_text))
    vocabulary = cut_lineage(wanted.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    counted = postings(docs, vocabulary, id_col, text_col).join(vocabulary, "term", "left")
    whole = F.col("term").isNull()
    entry = F.when(~whole, F.struct("number", "tf", "length"))
    held = cut_lineage(counted.groupBy(id_col).agg(
        F.collect_list(entry).alias("entries"), F.sum(F.when(whole, F.col("tf"))).alias("copies"),
        F.sum(F.when(whole, F.col("length") * F.col("tf"))).alias("size")))
    totals = held.agg(F.sum("copies").alias("n"), F.sum("size").alias("total"))
    n, average = totals.select("n").scalar(), totals.select(F.col("total") / F.col("n")).scalar()
    frequency = held.select(F.explode("entries.number").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = (wanted.join(vocabulary, "term").join(frequency, "number").select(query_col, "number", idf.alias("weight"))
             .groupBy(query_col).agg(F.collect_list(F.struct("number", "weight")).alias("entries"))
             .select(query_col, F.col("entries.number").alias("numbers"), F.col("entries.weight").alias("weights")))

    def part(e):
        return e["tf"] * (K1 + 1) / (e["tf"] + K1 * (1 - B + B * e["length"] / F.col("__average")))

    rows = held.where(F.size("entries") > 0).withColumn("__average", average).select(
        id_col, F.col("entries.number").alias("numbers"), F.transform("entries", part).alias("weights"))
    return rows, asked


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                query_col: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query, document, score) for every document that shares a term with a query. Whoever wants the best ones only takes `bm25_topk`, which makes no pairs."""
    rows, asked = _weighed(docs, queries, id_col, text_col, query_col, query_text)

    def flat(df, key, name):
        return df.select(key, F.explode(F.arrays_zip("numbers", "weights")).alias("e")).select(key, F.col("e.numbers").alias("number"), F.col("e.weights").alias(name))

    # A frequent term's postings stay spread over their documents; the few weights are copied to every part.
    parts = 16
    dealt = flat(rows, id_col, "tf_weight").withColumn("__part", F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int"))
    weighted = flat(asked, query_col, "idf").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return (dealt.join(weighted, ["number", "__part"])
            .groupBy(query_col, id_col).agg(F.sum(F.col("idf") * F.col("tf_weight")).alias("score")))


def _entries(block: dict, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the block, term number, weight) of all entries, of terms of the vocabulary when one is given."""
    numbers = np.concatenate([np.asarray(x, dtype=np.int64) for x in block["numbers"]])
    weights = np.concatenate([np.asarray(x, dtype=np.float64) for x in block["weights"]])
    owner = np.repeat(np.arange(len(block["numbers"])), [len(x) for x in block["numbers"]])
    if vocabulary is not None:
        known = np.isin(numbers, vocabulary)
        owner, numbers, weights = owner[known], numbers[known], weights[known]
    return owner, numbers, weights


def weight_products(query_key: str):
    """Score of every query of a block with every row of another: -inf without a common term, or where the row names the query in `apart`."""

    def score(queries: dict, rows: dict) -> np.ndarray:
        owner, numbers, weights = _entries(queries)
        vocabulary, place = np.unique(numbers, return_inverse=True)
        asked = np.zeros((len(queries["numbers"]), len(vocabulary)))
        asked[owner, place] = weights
        owner, numbers, weights = _entries(rows, vocabulary)
        place = np.searchsorted(vocabulary, numbers)
        n = len(rows["numbers"])
        out = np.zeros((len(asked), n))
        # Rows become dense some at a time, so that the size of the queries' vocabulary bounds no memory.
        step = max(1, CELLS // max(len(vocabulary), 1))
        for start in range(0, n, step):
            a, b = np.searchsorted(owner, [start, start + step])
            size = min(step, n - start)
            dense = np.bincount((owner[a:b] - start) * len(vocabulary) + place[a:b], weights[a:b], minlength=size * len(vocabulary))
            out[:, start:start + size] = asked @ dense.reshape(size, len(vocabulary)).T
        out[out <= 0] = -np.inf
        if "apart" in rows:
            at = {x: i for i, x in enumerate(list(queries[query_key]))}
            for i, names in enumerate(rows["apart"]):
                out[[at[x] for x in names if x in at], i] = -np.inf
        return out

    return score


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
              query_col: str = "query_id", query_text: str = "text") -> DataFrame:
    """The k best documents per query. Blocks of documents meet blocks of queries in one matrix product, so no (query, document) pair ever moves."""
    rows, asked = _weighed(docs, queries, id_col, text_col, query_col, query_text)
    fields = ["numbers", "weights"]
    return blocked_topk(rows, asked, k, weight_products(query_col), fields, fields, id_col, query_col, unrounded=True)


def hard_negatives(docs: DataFrame, queries: DataFrame, gold: DataFrame, k: int = 4, id_col: str = "doc_id",
                   text_col: str = "text", query_col: str = "query_id", query_text: str = "text") -> DataFrame:
    """The best-scoring documents per query that are not its gold; ties go to the larger id text."""
    rows, asked = _weighed(docs, queries, id_col, text_col, query_col, query_text)
    apart = gold.groupBy(id_col).agg(F.collect_set(query_col).alias("apart"))
    none = F.array().cast(apart.schema["apart"].dataType)
    rows = rows.join(apart, id_col, "left").withColumn("apart", F.coalesce("apart", none))
    return blocked_topk(rows, asked, k, weight_products(query_col), ["numbers", "weights", "apart"], ["numbers", "weights"], id_col, query_col,
                        unrounded=True, last_text=True)


def missing_gold(gold: DataFrame, corpus: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Gold documents absent from the corpus; a sound preparation has none."""
    return gold.join(corpus.select(id_col), id_col, "left_anti")


def document_frequency(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", group: str | None = None) -> DataFrame:
    """In how many rows each content term occurs, per group when one is named."""
    keys = [group, "term"] if group else ["term"]
    exploded = docs.select(*([group] if group else []), F.explode(terms(F.col(text_col))).alias("term"))
    return exploded.groupBy(*keys).agg(F.count(F.lit(1)).alias("df"))


def too_short(passages: DataFrame, passage_text: str = "text") -> DataFrame:
    """The passages without an inner word, those of less than three words: `containing` looks for them in every text."""
    return passages.where(F.size(F.filter(F.split(F.coalesce(passage_text, F.lit("")), r"\s+"), lambda w: w != "")) < 3)


def containing(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               passage_col: str = "item_id", passage_text: str = "text", width: int = 4) -> DataFrame:
    """(passage, document) pairs where the document holds the passage verbatim.

    A passage's inner words stand whole in any text that holds it, so both sides meet on a run of inner words and
    only those pairs are compared in full. Shorter passages use shorter runs. A passage of less than three words has no inner
    word (`too_short` lists those): each such wording, once however many passages share it, is looked for in every text where that is read, and only
    pairs that hold travel. An empty passage stands in every text, a null one in none.
    """
    def pieces(c):
        return F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def run_of(tokens, start, n):
        return F.xxhash64(F.array_join(F.slice(tokens, start, n), " "))

    sized = (passages.select(F.col(passage_col), F.col(passage_text).alias("__passage"), pieces(F.col(passage_text)).alias("__w"))
             .where(F.col("__passage").isNotNull())
             .withColumn("__n", F.greatest(F.least(F.lit(width), F.size("__w") - 2), F.lit(0))))
    widths = [r[0] for r in sized.select("__n").distinct().collect()]  # at most `width` + 1 values
    short = sized.where("__n = 0").select(passage_col, "__passage") if 0 in widths else None
    widths = [n for n in widths if n]
    asked = sized.where("__n >= 1").select(passage_col, "__passage", "__n", run_of(F.col("__w"), F.lit(2), F.col("__n")).alias("__run"))

    def runs(tokens, n):
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
        found = F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), run_of(tokens, i, F.lit(n)).alias("run")))
        return F.when(F.size(tokens) >= n, found).otherwise(F.array().cast("array<struct<n:int,run:bigint>>"))

    all_runs = let(pieces(F.col(text_col)), lambda w: F.flatten(F.array(*[runs(w, n) for n in widths or [width]])))
    # The texts stay behind: only (id, run) pairs that some passage asks for travel to the match.
    keyed = (docs.select(F.col(id_col), F.explode(all_runs).alias("r"))
             .select(id_col, F.col("r.n").alias("__n"), F.col("r.run").alias("__run")))
    near = keyed.join(asked, ["__n", "__run"]).select(passage_col, "__passage", id_col).distinct()
    texts = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    found = near.join(texts, id_col).where(F.col("__text").contains(F.col("__passage"))).select(passage_col, id_col)
    if short is None:
        return found
    wordings = cut_lineage(short.select("__passage").distinct())
    held = texts.join(wordings, F.col("__text").contains(F.col("__passage"))).select(id_col, "__passage")
    return found.unionByName(held.join(short.distinct(), "__passage").select(passage_col, id_col))
