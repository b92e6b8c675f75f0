"""Exact nearest rows by vector and by the hybrid score, many queries at once.

Rows are packed into blocks of bounded size. Blocks are dealt to a grid of at most `SPREAD` x `SPREAD` cells, so a block travels
at most `SPREAD` times however many there are, and all pairs of a cell meet inside its task: one matrix product each, of which only the best
rows per query so far are kept. Nothing is collected, no pair of rows is ever emitted, and a block's size does not depend on how the keys are distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import terms, words
from .skew import shuffled, top_per_group

BLOCK_ROWS, BLOCK_QUERIES, SPREAD = 2048, 512, 16
#: Best rows that a task holds before it hands them on; handed on early they are only compared once more.
HELD = 2_000_000


def _packed(df: DataFrame, key: str, rows: int, fields: list[str], name: str, group: list[str]) -> DataFrame:
    """Blocks of about `rows` rows: (group, block number, one array per field, vectors end to end with their sizes)."""
    block = F.pmod(F.xxhash64(key), F.greatest(F.ceil(F.col("__n") / rows), F.lit(1)))
    if group:
        sized = df.join(df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")), group)
    else:
        sized = df.withColumn("__n", df.agg(F.count(F.lit(1)).alias("n")).scalar())
    packed = sized.withColumn(f"__{name}", block).groupBy(*group, f"__{name}").agg(F.collect_list(F.struct(key, *fields)).alias("__packed"))
    none = F.array().cast("array<double>")

    def column(field):
        if field == "vec":
            return F.flatten(F.transform("__packed", lambda r: F.coalesce(r["vec"].cast("array<double>"), none)))
        return F.transform("__packed", lambda r: r[field])

    sizes = [F.transform("__packed", lambda r: F.size(F.coalesce(r["vec"].cast("array<double>"), none))).alias(f"{name}_sizes")] if "vec" in fields else []
    return packed.select(*group, f"__{name}", *[column(f).alias(f"{name}_{f}") for f in [key, *fields]], *sizes)


def _matrix(block: dict, width: int) -> np.ndarray:
    """The block's vectors as rows; missing vectors and those of another width become zero."""
    sizes, flat = np.asarray(block["sizes"]), np.asarray(block["vec"], dtype=np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out, ends = np.zeros((len(sizes), width)), np.cumsum(sizes)
    for i in np.flatnonzero(sizes == width):
        out[i] = flat[ends[i] - width:ends[i]]
    return out


def _normalised(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def cosine_scores(queries: dict, rows: dict) -> np.ndarray:
    """Cosine of every query with every row of two blocks; 0 for a missing or zero vector."""
    out = np.zeros((len(queries["sizes"]), len(rows["sizes"])))
    # Vectors are compared with those of their own length, so a block's other members make no difference.
    for width in np.unique(np.asarray(queries["sizes"], dtype=np.int64)):
        if width > 0:
            out += _normalised(_matrix(queries, width)) @ _normalised(_matrix(rows, width)).T
    return out


def hybrid_scores(lexical: float = 0.5, semantic: float = 0.35, label: float = 0.1, hit: float = 0.0025, hit_cap: int = 20):
    """The hybrid ranking: share of the query's terms found, cosine, share found in the label, past hits."""

    def score(queries: dict, rows: dict) -> np.ndarray:
        vocabulary = {t: i for i, t in enumerate(sorted({t for q in queries["terms"] for t in q}))}
        asked = np.zeros((len(queries["terms"]), max(len(vocabulary), 1)), dtype=np.float32)
        for i, q in enumerate(queries["terms"]):
            asked[i, [vocabulary[t] for t in q]] = 1
        share = np.maximum(asked.sum(axis=1, keepdims=True), 1).astype(np.float64)

        def found(field):
            held = np.zeros((len(rows[field]), asked.shape[1]), dtype=np.float32)
            for i, r in enumerate(rows[field]):
                held[i, [vocabulary[t] for t in r if t in vocabulary]] = 1
            return held

        in_label, in_text = found("label_words"), found("content_words")
        overlap = (asked @ np.maximum(in_label, in_text).T).astype(np.float64) / share
        labelled = (asked @ in_label.T).astype(np.float64) / share
        hits = np.minimum(np.array([h or 0 for h in rows["hits"]], dtype=np.float64), hit_cap)
        return (lexical * overlap + semantic * np.maximum(cosine_scores(queries, rows), 0)
                + label * labelled + hit * hits[None, :])

    return score


def _merged(best: tuple | None, scores: np.ndarray, ids: np.ndarray, k: int, exact: np.ndarray, last_text: bool = False) -> tuple[np.ndarray, ...]:
    """The best k rows of each query among those kept so far and a block's: (query's place, id, score), sorted by place, the least score that still counts,
    and the scores as they were before rounding.

    Scores of -inf never count; ties go to the smaller id, or to the id whose text comes last.
    """
    n = len(scores)
    cut = np.full(n, -np.inf) if best is None else best[3]
    open_ = np.flatnonzero(np.isneginf(cut))
    if len(open_) and scores.shape[1] > k:  # until k rows are known, the k-th best of the block bounds them
        cut = cut.copy()
        cut[open_] = np.partition(scores[open_], -k, axis=1)[:, -k]
    at, of = np.nonzero((scores >= cut[:, None]) & (scores > -np.inf))
    found, values, exact = ids[of], scores[at, of], exact[at, of]
    if best is not None:
        if not len(at):
            return best
        at, found, values, exact = (np.concatenate([old, new]) for old, new in zip((best[0], best[1], best[2], best[4]), (at, found, values, exact)))
    place = -_sortable(np.array([None if x is None else str(x) for x in found.tolist()], dtype=object)) if last_text else _sortable(found)
    order = np.lexsort((place, -values, at))
    at, found, values, exact = at[order], found[order], values[order], exact[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    kept = rank < k
    least = np.full(n, -np.inf)
    least[at[rank == k - 1]] = values[rank == k - 1]
    return at[kept], found[kept], values[kept], least, exact[kept]


def _sortable(ids: np.ndarray) -> np.ndarray:
    """Numbers that sort as the ids do, null first."""
    if ids.dtype != object:
        return ids
    places = {x: i for i, x in enumerate(sorted(set(ids.tolist()), key=lambda x: (x is not None, x)))}
    return np.fromiter((places[x] for x in ids.tolist()), np.int64, len(ids))


def blocked_topk(rows: DataFrame, queries: DataFrame, k: int, score: Callable, row_fields: list[str],
                 query_fields: list[str], row_key: str = "doc_id", query_key: str = "query_id",
                 group: list[str] | None = None, threshold: float | None = None, exclude_same: bool = False,
                 unrounded: bool = False, last_text: bool = False) -> DataFrame:
    """The k best rows per query (query key, row key, score, rank), exactly, inside each group when groups are named.

    Scores are compared at nine digits and returned so, or as they are (`unrounded`). Ties go to the smaller id, or to the id whose text comes
    last (`last_text`). Pairs that `score` gives -inf never count.
    """
    group = group or []
    row_blocks = _packed(rows, row_key, BLOCK_ROWS, row_fields, "rows", group)
    query_blocks = _packed(queries, query_key, BLOCK_QUERIES, query_fields, "queries", group)
    # Few queries, or one large group, would be a single key: row blocks are dealt to `SPREAD` parts of each key, and the
    # query blocks, copied to every part, meet each row block once.
    row_blocks = row_blocks.withColumn("__part", F.pmod(F.col("__rows"), F.lit(SPREAD)))
    query_blocks = query_blocks.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    if group:
        pairs = row_blocks.join(shuffled(query_blocks), [*group, "__part"])
    else:
        # Every row block meets every query block. Query blocks are dealt to bands, `SPREAD` at most, and a row block goes to every band.
        n = queries.agg(F.count(F.lit(1)).alias("n")).select(
            F.greatest(F.least(F.ceil(F.col("n") / BLOCK_QUERIES), F.lit(SPREAD)), F.lit(1)).cast("long")).scalar()
        pairs = (row_blocks.withColumn("__band", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
                 .join(shuffled(query_blocks.withColumn("__band", F.pmod(F.col("__queries"), n))), ["__band", "__part"]))
    row_type, query_type = rows.schema[row_key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()

    names = [c for c in pairs.columns if c.startswith(("rows_", "queries_"))]
    block = [*group, "__queries"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple, list] = {}  # per block of queries its ids and what `_merged` keeps

        def handed() -> Iterator[pd.DataFrame]:
            for asked, kept in best.values():
                if len(kept[0]):
                    yield pd.DataFrame({query_key: pd.Series(asked[kept[0]], dtype=object), row_key: pd.Series(kept[1], dtype=object), "score": kept[2], "__exact": kept[4]})
            best.clear()

        held = 0
        for pdf in batches:
            for record in pdf.to_dict("records"):
                r = {c[5:]: v for c, v in record.items() if c.startswith("rows_")}
                q = {c[8:]: v for c, v in record.items() if c.startswith("queries_")}
                # Rounded, so copies of one row tie whatever their place in a block.
                exact = np.asarray(score(q, r), dtype=np.float64)
                values = np.round(exact, 9)
                ids, asked = _ids(r[row_key]), _ids(q[query_key])
                if exclude_same:
                    place = {}
                    for i, x in enumerate(ids.tolist()):
                        place.setdefault(x, []).append(i)
                    for i, x in enumerate(asked.tolist()):
                        values[i, place.get(x, [])] = -np.inf
                if threshold is not None:
                    values = np.where(values >= threshold, values, -np.inf)
                name = tuple(record[c] for c in block)
                before = best.get(name, (None, None))[1]
                best[name] = asked if before is None else best[name][0], _merged(before, values, ids, k, exact, last_text)
                held += len(best[name][1][0]) - (0 if before is None else len(before[0]))
                if held > HELD:
                    yield from handed()
                    held = 0
        yield from handed()

    found = pairs.select(*block, *names).mapInPandas(run, f"{query_key} {query_type}, {row_key} {row_type}, score double, __exact double")
    tie = F.col(row_key).cast("string").desc() if last_text else F.col(row_key)
    best = top_per_group(found, [query_key], [F.col("score").desc(), tie], k)
    return best.select(query_key, row_key, F.col("__exact" if unrounded else "score").alias("score"), "rank")


def _ids(values) -> np.ndarray:
    """Ids as integers where they are, else as objects."""
    found = np.asarray(values)
    return found if found.dtype.kind in "iu" else np.array(list(values), dtype=object)


def vector_topk(rows: DataFrame, queries: DataFrame, k: int, row_key: str = "doc_id", query_key: str = "query_id",
                group: list[str] | None = None, threshold: float | None = None, exclude_same: bool = False) -> DataFrame:
    """Exact top-k by cosine; `rows` and `queries` carry an array column `vec`."""
    return blocked_topk(rows, queries, k, cosine_scores, ["vec"], ["vec"], row_key, query_key, group, threshold, exclude_same)


def similar_records(records: DataFrame, queries: DataFrame, limit: int = 10, threshold: float = 0.94,
                    record_key: str = "key", query_key: str = "query_id") -> DataFrame:
    """Records of a scope at least `threshold` close to a question of the same scope."""
    return vector_topk(records, queries, limit, record_key, query_key, ["scope"], threshold)


def rank_inputs(nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """What the hybrid score reads of a node: label words, content words, vector and past hits."""
    label = F.concat_ws(" ", F.col("label"), F.array_join(F.coalesce(F.col("aliases"), F.array().cast("array<string>")), " "))
    content = F.concat_ws(" ", "routing_summary", "summary", "text")
    return nodes.select(key, words(label).alias("label_words"), words(content).alias("content_words"),
                        F.col("embedding").alias("vec"), F.col("hits"))


def hybrid_topk(nodes: DataFrame, queries: DataFrame, limit: int = 20, node_key: str = "node_id",
                query_key: str = "query_id", group: list[str] | None = None, weights: dict | None = None) -> DataFrame:
    """Hybrid candidates per query. `nodes` come from `rank_inputs`; `queries` carry text and vec.

    Words that no query asks for are dropped where the nodes are read, so a block carries vectors and matched words only.
    """
    asked = queries.select(query_key, *(group or []), terms(F.col("text")).alias("terms"), "vec")
    vocabulary = asked.select(F.explode("terms").alias("word")).distinct()
    tagged = F.concat(F.transform("label_words", lambda w: F.struct(w.alias("word"), F.lit(True).alias("label"))),
                      F.transform("content_words", lambda w: F.struct(w.alias("word"), F.lit(False).alias("label"))))
    matched = (nodes.select(node_key, F.explode(tagged).alias("t")).select(node_key, "t.word", "t.label")
               .join(vocabulary, "word", "left_semi")
               .groupBy(node_key).agg(F.collect_set(F.when(F.col("label"), F.col("word"))).alias("label_words"),
                                      F.collect_set(F.when(~F.col("label"), F.col("word"))).alias("content_words")))
    nothing = F.array().cast("array<string>")
    rows = (nodes.drop("label_words", "content_words").join(matched, node_key, "left")
            .withColumns({c: F.coalesce(c, nothing) for c in ("label_words", "content_words")}))
    return blocked_topk(rows, asked, limit, hybrid_scores(**(weights or {})),
                        ["label_words", "content_words", "vec", "hits"], ["terms", "vec"], node_key, query_key, group)
