"""Ranking metrics, paired tests, calibration, leaderboards and the recall funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .skew import top_per_group


def _gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1)


def retrieval_scores(rankings: DataFrame, gold: DataFrame, query_col: str = "query_id", id_col: str = "doc_id",
                     arm_col: str = "arm", cutoffs=(5, 10), ndcg_at: int = 10) -> DataFrame:
    """any@k, all@k and ndcg@k per (arm, query) that has gold. `rankings` carry a rank from 1."""
    wanted = gold.select(query_col, id_col).distinct()
    sizes = wanted.groupBy(query_col).agg(F.count(F.lit(1)).alias("gold"))
    arms = rankings.select(arm_col).distinct()
    hits = rankings.join(wanted, [query_col, id_col]).groupBy(arm_col, query_col).agg(
        *[F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"hits_{k}") for k in cutoffs],
        F.sum(F.when(F.col("rank") <= ndcg_at, _gain(F.col("rank"))).otherwise(0.0)).alias("dcg"))
    # Every arm is scored on every query with gold, also where it found nothing. Arms are a handful by nature.
    asked = sizes.withColumn(arm_col, F.explode(arms.select(F.collect_set(arm_col).alias("a")).scalar()))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(ndcg_at)).cast("int")), F.lit(0.0),
                        lambda s, r: s + _gain(r))
    filled = asked.join(hits, [arm_col, query_col], "left").fillna(0)
    return filled.select(
        arm_col, query_col, "gold",
        *[(F.col(f"hits_{k}") > 0).cast("double").alias(f"any_at_{k}") for k in cutoffs],
        *[(F.col(f"hits_{k}") >= F.col("gold")).cast("double").alias(f"all_at_{k}") for k in cutoffs],
        (F.col("dcg") / ideal).alias(f"ndcg_at_{ndcg_at}"))


def session_scores(rankings: DataFrame, gold: DataFrame, session: str, query_col: str = "query_id", id_col: str = "doc_id",
                   cutoffs=(3, 5)) -> DataFrame:
    """Whether all gold sessions are among the first sessions of a ranking."""
    first = rankings.groupBy(query_col, session).agg(F.min("rank").alias("first_rank"))
    order = top_per_group(first, [query_col], [F.col("first_rank"), F.col(session)], max(cutoffs), "place")
    wanted = gold.select(query_col, session).distinct()
    placed = wanted.join(order, [query_col, session], "left")
    return placed.groupBy(query_col).agg(*[
        F.min(F.when(F.col("place") <= k, 1.0).otherwise(0.0)).alias(f"s_all_at_{k}") for k in cutoffs])


def budget_scores(chosen: DataFrame, gold: DataFrame, query_col: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """Whether all gold items, and which share of them, are in the packed context."""
    inside = chosen.select(query_col, id_col, F.lit(1.0).alias("inside")).distinct()
    return (gold.select(query_col, id_col).distinct().join(inside, [query_col, id_col], "left")
            .groupBy(query_col).agg(F.min(F.coalesce("inside", F.lit(0.0))).alias("budget_all"),
                                    F.avg(F.coalesce("inside", F.lit(0.0))).alias("budget_frac")))


def mean_report(scores: DataFrame, metrics: list[str], arm_col: str = "arm", type_col: str | None = None) -> DataFrame:
    """Means per arm, and per arm and type when a type is named (null type: all)."""
    means = [F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics]]
    if type_col is None:
        return scores.groupBy(arm_col).agg(*means)
    return scores.groupingSets([[arm_col], [arm_col, type_col]], arm_col, type_col).agg(*means)


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Exact two-sided p-value of two paired outcomes (booleans), from the discordant counts.

    The tail is Σ C(n,i)/2ⁿ; terms are built from logarithms, so large counts neither overflow nor underflow early.
    """
    counts = pairs.agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(F.col(b) & ~F.col(a)).alias("only_b"))
    n, low = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    state = F.struct((-n * F.log(F.lit(2.0))).alias("log_term"), F.exp(-n * F.log(F.lit(2.0))).alias("tail"))

    def step(s, i):
        term = s["log_term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(term.alias("log_term"), (s["tail"] + F.exp(term)).alias("tail"))

    steps = F.when(low >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(low, F.lit(1)))).otherwise(
        F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, state, step)["tail"]
    return counts.select("only_a", "only_b", F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p_value"))


def accuracy_report(judged: DataFrame, arm_col: str = "arm", query_col: str = "query_id", type_col: str = "type",
                    label: str = "label") -> DataFrame:
    """Accuracy per arm and type on the questions every arm answered; `_abs` questions form the type abstention."""
    arms = judged.select(F.count_distinct(arm_col)).scalar()
    complete = judged.groupBy(query_col).agg(F.count_distinct(arm_col).alias("n")).where(F.col("n") == arms).select(query_col)
    typed = judged.join(complete, query_col).withColumn(
        type_col, F.when(F.col(query_col).cast("string").endswith("_abs"), F.lit("abstention")).otherwise(F.col(type_col)))
    return typed.groupingSets([[arm_col], [arm_col, type_col]], arm_col, type_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("accuracy"))


def calibration(labelled: DataFrame, confidence: str = "confidence", ok: str = "ok", low: int = 50, high: int = 95,
                step: int = 5) -> DataFrame:
    """Accepted rows and precision at each confidence step."""
    # Rows are counted once per reached step before anything moves; steps are accumulated on those few counts.
    reached = F.least(F.lit(high), F.floor(F.round(F.col(confidence) * 100, 6) / step) * step).cast("int")
    counted = (labelled.select(reached.alias("top"), F.col(ok).cast("int").alias("good")).where(F.col("top") >= low)
               .groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")))
    return (counted.withColumn("percent", F.explode(F.sequence(F.lit(low), F.col("top"), F.lit(step))))
            .groupBy("percent").agg(F.sum("n").alias("accepted"), (F.sum("good") / F.sum("n")).alias("precision"))
            .select((F.col("percent") / 100).alias("threshold"), "accepted", "precision"))


def chosen_threshold(steps: DataFrame, precision: float = 0.9, rows: int = 5) -> DataFrame:
    """The lowest threshold with enough precision and rows, null when none qualifies."""
    fine = (F.col("precision") >= precision) & (F.col("accepted") >= rows)
    return steps.agg(F.min(F.when(fine, F.col("threshold"))).alias("threshold"))


def gold_recall(gold: Column, retrieved: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(gold), retrieved)) / F.size(F.array_distinct(gold))


def verdicts(answers: DataFrame, passageless=("closed_book",)) -> DataFrame:
    """One verdict per answer: a win is correct, complete and fully sourced. Null when its sourcing check is pending. The sentences are fixed values.

    Columns: method, qid, correct, major_omission, reason, supported, grounded (the check has returned), fallback.
    """
    why = (F.when(F.col("correct").isNull(), F.lit(None).cast("string"))
           .when(F.col("reason") == "no answer", F.lit("no answer"))
           .when(F.coalesce("fallback", F.lit(False)), F.lit("no answer: the answer step failed and returned raw evidence"))
           .when(~F.col("correct"), F.concat(F.lit("incorrect: "), F.col("reason")))
           .when(F.col("major_omission"), F.concat(F.lit("major omission: "), F.col("reason")))
           .when(~F.col("grounded") & F.col("method").isin(list(passageless)), F.lit("correct but unsourced (no passages)"))
           .when(~F.col("grounded"), F.lit(None).cast("string"))
           .when(F.col("supported") < 1, F.concat(F.lit("unsupported claims ("), F.round(100 * F.col("supported")).cast("int").cast("string"),
                                                  F.lit("% supported)")))
           .otherwise(F.lit("correct, complete and sourced")))
    return answers.withColumn("why", why).withColumn(
        "win", F.when(F.col("why").isNotNull(), F.col("why") == "correct, complete and sourced"))


def leaderboard(graded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per method (and domain): wins, correctness, omissions, unsupported answers, recall, length, time, cost, errors."""
    known = F.col("win").isNotNull()
    return graded.groupBy("method", *(by or [])).agg(
        F.count_if(known).alias("graded"),
        F.count_if(known & F.col("win")).alias("wins"),
        F.count_if(known & F.col("correct")).alias("correct"),
        F.count_if(known & F.col("correct") & F.col("major_omission")).alias("omissions"),
        F.count_if(known & (F.col("supported") < 1)).alias("unsupported"),
        F.avg("gold_recall").alias("gold_recall"), F.avg("words").alias("words"), F.avg("seconds").alias("seconds"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.count_if(F.col("error").isNotNull()).alias("errors"))


FUNNEL = (  # fixed values: where a missed gold document was lost, first match wins
    ("found", "evidence found but not in final context"),
    ("spawned", "explored, relevance check rejected"),
    ("pruned_policy", "candidate, pruned by navigation policy"),
    ("pruned_budget", "candidate, cut by breadth cap"),
    ("candidate", "candidate, never scheduled (global budget)"),
)


def recall_funnel(missed: DataFrame, events: DataFrame, closure: DataFrame) -> DataFrame:
    """Stage at which each missed gold document was lost.

    missed: (query_id, doc_id); events: (query_id, node_id, stage) with the stages of FUNNEL; closure: (doc_id, node_id).
    Events are reduced to one row of flags per (query, node) before they meet the documents' nodes.
    """
    names = [name for name, _ in FUNNEL]
    flags = events.groupBy("query_id", "node_id").agg(*[F.max(F.col("stage") == n).alias(n) for n in names])
    seen = (missed.join(closure, "doc_id").join(flags, ["query_id", "node_id"])
            .groupBy("query_id", "doc_id").agg(*[F.bool_or(n).alias(n) for n in names]))
    chain = F.lit("never a candidate")
    for name, text in reversed(FUNNEL):
        chain = F.when(F.col(name), F.lit(text)).otherwise(chain)
    return missed.join(seen, ["query_id", "doc_id"], "left").select("query_id", "doc_id", chain.alias("stage"))


def comparable_rows(rows: DataFrame, configs: DataFrame, current: DataFrame) -> DataFrame:
    """Cached rows made with the settings of the current run; rows of other settings must not share a table."""
    same = configs.join(current.select("kind", "settings_hash"), ["kind", "settings_hash"], "left_semi")
    return rows.join(same.select("run_id", "kind"), ["run_id", "kind"], "left_semi")


def work_estimate(texts: DataFrame, cache: DataFrame, price_per_token: float, key: str = "key", text: str = "text") -> DataFrame:
    """Rows, characters and cost of everything not cached yet (four characters per token)."""
    return texts.dropDuplicates([key]).join(cache.select(key), key, "left_anti").agg(
        F.count(F.lit(1)).alias("todo"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"),
        (F.coalesce(F.sum(F.length(text)), F.lit(0)) / 4 * price_per_token).alias("cost"))
