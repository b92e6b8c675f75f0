"""Packing evidence: ordering, greedy budgets, the model's view of a context and coverage roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .skew import top_per_group


def greedy_budget(items: DataFrame, budget: int, query_col: str = "query_id", id_col: str = "doc_id", size: str = "size",
                  order: str = "rank") -> DataFrame:
    """(query, id) of the items a greedy pass takes: in order, each item that still fits, others skipped.

    Once an item of some size does not fit, no later item of that size does, so of each size only the first
    budget/size items can ever be taken. That bounds a query to about budget·ln(budget) rows before the fold,
    however long its ranking is. Items without size always fit and need no fold.
    """
    free = items.where(F.col(size) <= 0).select(query_col, id_col)
    sized = items.where((F.col(size) > 0) & (F.col(size) <= budget)).select(query_col, id_col, size, order)
    few = top_per_group(sized, [query_col, size], [F.col(order), F.col(id_col)], budget, "__place").where(
        F.col("__place") <= F.floor(F.lit(budget) / F.col(size)))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(id_col).alias("id"), F.col(size).cast("long").alias("s"))))
    id_type = items.schema[id_col].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{id_type}>").alias("ids"))
    fold = F.aggregate(F.col("rows"), start, lambda acc, x: F.when(
        acc["used"] + x["s"] <= budget,
        F.struct((acc["used"] + x["s"]).alias("used"), F.concat(acc["ids"], F.array(x["id"])).alias("ids"))).otherwise(acc))
    taken = few.groupBy(query_col).agg(rows.alias("rows")).select(query_col, F.explode(fold["ids"]).alias(id_col))
    return taken.unionByName(free)


def context_order(evidence: DataFrame, query_col: str = "query_id") -> DataFrame:
    """Round-robin order across groups with contradicting items next to each other.

    evidence: query, evidence_id, group_no (the need's or document's place), position (place inside its group, by
    relevance), found (order of discovery), contradicts (array of evidence ids). One row per item and group; the node
    budget of an exploration bounds a query's evidence, so its order is a fold over that array.
    """
    item = evidence.groupBy(query_col, "evidence_id").agg(
        F.min(F.struct("position", "group_no")).alias("at"), F.min("found").alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("contradicts")))).alias("contradicts"))
    packed = item.groupBy(query_col).agg(
        F.array_sort(F.collect_list(F.struct("at", F.col("evidence_id").alias("id"), "contradicts"))).alias("placed"),
        F.transform(F.array_sort(F.collect_list(F.struct("found", F.col("evidence_id").alias("id")))), lambda x: x["id"]).alias("known"))
    def step(seen, x):
        others = F.filter(F.col("known"), lambda k: F.array_contains(x["contradicts"], k) & ~F.array_contains(seen, k) & (k != x["id"]))
        return F.when(F.array_contains(seen, x["id"]), seen).otherwise(F.concat(seen, F.array(x["id"]), others))
    ordered = F.aggregate(F.col("placed"), F.array().cast("array<string>"), step)
    return packed.select(query_col, F.posexplode(ordered).alias("place", "evidence_id"))


def grouped_by_need(evidence: DataFrame, needs: DataFrame, query_col: str = "query_id") -> DataFrame:
    """Places of evidence inside each need, most relevant first. needs: query, need_id, need_no."""
    by_need = evidence.withColumn("need_id", F.explode("need_ids")).join(needs, [query_col, "need_id"])
    window = Window.partitionBy(query_col, "need_id").orderBy(F.col("relevance").desc(), "found")
    return by_need.withColumn("position", F.row_number().over(window)).withColumnRenamed("need_no", "group_no")


def grouped_by_source(evidence: DataFrame, query_col: str = "query_id") -> DataFrame:
    """Places of evidence inside each source document, documents by their best passage."""
    window = Window.partitionBy(query_col, "document_id").orderBy(F.col("relevance").desc(), "found")
    placed = evidence.withColumn("position", F.row_number().over(window))
    best = evidence.groupBy(query_col, "document_id").agg(F.max("relevance").alias("__best"), F.min("found").alias("__first"))
    numbered = best.withColumn("group_no", F.row_number().over(Window.partitionBy(query_col).orderBy(F.col("__best").desc(), "__first")))
    return placed.join(numbered.drop("__best", "__first"), [query_col, "document_id"])


def view_tokens(*columns: str) -> Column:
    """Tokens of an item's view besides its text: the names and values of its other fields, as the model reads them."""
    return F.regexp_count(F.to_json(F.struct(*columns)), F.lit(r"[^\s{}\[\]\",:]+"))


def pack_context(items: DataFrame, budget: int, query_col: str = "query_id", id_col: str = "evidence_id",
                 text_tokens: str = "text_tokens", overhead: str = "overhead", order: str = "place",
                 spare: int = 16, smallest: int = 40) -> DataFrame:
    """Greedy context with truncation: an item that does not fit is cut when more than `smallest` tokens remain.

    overhead: tokens of an item's view besides its text. Returns (query, id, place, kept_tokens, truncated). Items of
    one shape (text and overhead) that stop fitting never fit again, and only the first of them can be cut, so the
    fold sees a bounded number of rows per query.
    """
    cost = (F.col(text_tokens) + F.col(overhead) + 1).cast("long")
    rows = items.select(query_col, id_col, order, F.col(text_tokens).cast("long").alias("t"), F.col(overhead).cast("long").alias("o"),
                        cost.alias("c")).withColumn("shape", F.when(F.col("c") <= budget, F.col("t")).otherwise(F.lit(-1)))
    few = top_per_group(rows, [query_col, "shape", "o"], [F.col(order), F.col(id_col)], budget + 1, "__place").where(
        F.col("__place") <= F.floor(F.lit(budget) / F.greatest(F.col("c"), F.lit(1))) + 1)
    id_type = items.schema[id_col].dataType.simpleString()
    picked = f"array<struct<id:{id_type},place:bigint,kept:bigint,truncated:boolean>>"
    start = F.struct(F.lit(1).cast("long").alias("used"), F.array().cast(picked).alias("got"))

    def take(acc, x, kept, used, cut):
        one = F.struct(x["id"].alias("id"), x["p"].cast("long").alias("place"), kept.cast("long").alias("kept"), F.lit(cut).alias("truncated"))
        return F.struct(used.cast("long").alias("used"), F.concat(acc["got"], F.array(one)).alias("got"))

    def step(acc, x):
        left = F.lit(budget) - acc["used"] - (x["c"] - x["t"]) - spare
        return (F.when(acc["used"] + x["c"] <= budget, take(acc, x, x["t"], acc["used"] + x["c"], False))
                .when(left > smallest, take(acc, x, F.least(left, x["t"]), acc["used"] + F.least(left, x["t"]) + x["o"] + 1, True))
                .otherwise(acc))

    folded = few.groupBy(query_col).agg(F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("p"), F.col(id_col).alias("id"), "t", "o", "c"))).alias("rows"))
    return folded.select(query_col, F.explode(F.aggregate(F.col("rows"), start, step)["got"]).alias("g")).select(
        query_col, F.col("g.id").alias(id_col), F.col("g.place").alias("place"), F.col("g.kept").alias("kept_tokens"), F.col("g.truncated").alias("truncated"))


def model_view(context: DataFrame, query_col: str = "query_id", order: str = "place") -> DataFrame:
    """Short ids E1..En, bare attribution of the first source, short ids of contradicting items."""
    numbered = context.withColumn("alias", F.concat(F.lit("E"), F.row_number().over(
        Window.partitionBy(query_col).orderBy(order)).cast("string")))
    names = numbered.groupBy(query_col).agg(F.map_from_entries(F.collect_list(F.struct("node_id", "alias"))).alias("__names"))
    view = numbered.join(names, query_col)
    section = F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > ")
    contradicts = F.filter(F.transform(F.coalesce("contradictions", F.array().cast("array<string>")), lambda i: F.element_at(F.col("__names"), i)),
                           lambda a: a.isNotNull())
    def present(c):
        return F.when(F.length(c.cast("string")) > 0, c)
    return view.select(
        query_col, "evidence_id", "alias", "text",
        F.struct(present(F.col("title")).alias("title"), present(F.col("uri")).alias("uri"), present(F.col("author")).alias("author"),
                 F.col("published_at"), F.substring(F.col("retrieved_at").cast("string"), 1, 10).alias("retrieved_at"),
                 present(section).alias("section")).alias("source"), contradicts.alias("contradicts"))


def coverage_rollup(needs: DataFrame, verdicts: DataFrame, context: DataFrame, query_col: str = "query_id") -> DataFrame:
    """One verdict per need: the first one given, invented evidence dropped, unsupported claims of coverage undone.

    verdicts: query, need_id, at (order given), status, evidence_ids, missing; context: query, evidence_id.
    """
    first = verdicts.groupBy(query_col, "need_id").agg(F.min_by(F.struct("status", "evidence_ids", "missing"), "at").alias("v"))
    known = (first.select(query_col, "need_id", F.explode("v.evidence_ids").alias("evidence_id"))
             .join(context.select(query_col, "evidence_id").distinct(), [query_col, "evidence_id"], "left_semi")
             .groupBy(query_col, "need_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids")))
    has_context = context.select(query_col).distinct().withColumn("__any", F.lit(True))
    rows = (needs.join(first, [query_col, "need_id"], "left").join(known, [query_col, "need_id"], "left")
            .join(has_context, query_col, "left"))
    ids = F.when(F.col("__any"), F.coalesce("evidence_ids", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    undone = (F.col("v.status") != "MISSING") & (F.size(ids) == 0)
    missing = F.coalesce(F.col("v.missing"), F.lit(""))
    return rows.select(
        query_col, "need_id",
        F.when(F.col("v").isNull() | undone | F.col("__any").isNull(), F.lit("MISSING")).otherwise(F.col("v.status")).alias("status"),
        ids.alias("evidence_ids"),
        F.when(F.col("__any").isNull(), F.col("description")).when(F.col("v").isNull(), F.lit("Coverage was not assessed"))
        .when(undone & (missing == ""), F.lit("No supporting evidence was cited")).otherwise(missing).alias("missing"))


def overall_status(coverage: DataFrame, query_col: str = "query_id") -> DataFrame:
    return coverage.groupBy(query_col).agg(F.when(F.bool_and(F.col("status") == "COVERED"), F.lit("SUFFICIENT")).otherwise(
        F.lit("INSUFFICIENT")).alias("overall_status"))


def context_passages(context: DataFrame, k: int, query_col: str = "query_id", order: str = "place", width: int = 100) -> DataFrame:
    """Context items cut into passages of 100 words, the first k per query."""
    pieces = F.split("text", " ")
    cut = context.select(query_col, "doc_id", order, F.posexplode(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / width).cast("int")),
        lambda i: F.array_join(F.slice(pieces, i * width + 1, F.lit(width)), " "))).alias("n", "passage"))
    return top_per_group(cut, [query_col], [F.col(order), F.col("n")], k, "place_out")


def numbered_block(rows: DataFrame, letter: str, line: Column, query_col: str, order: list[Column]) -> DataFrame:
    """Rows as "[H1] ..." lines in one text per query; the lists are capped reports, so a block stays short."""
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(query_col).orderBy(*order)))
    label = F.concat(F.lit(letter), F.col("__n").cast("string"))
    return numbered.withColumn("label", label).withColumn("line", F.concat(F.lit("["), F.col("label"), F.lit("] "), line)).drop("__n")
