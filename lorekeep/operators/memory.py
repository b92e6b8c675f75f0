"""Long-lived memory: counters, episodes, searches, facts, working memory, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .skew import top_per_group


# --- Counters and host know-how ---
COUNTERS = ["found", "accepted", "rejected", "failed", "used", "forgotten"]  # fixed values


def counters(events: DataFrame) -> DataFrame:
    """Event-sourced totals per (kind, name); blank names are not counted."""
    named = events.where(F.length(F.coalesce("name", F.lit(""))) > 0)
    return named.groupBy("kind", "name").agg(*[F.sum(F.when(F.col("counter") == c, F.col("n")).otherwise(0)).alias(c) for c in COUNTERS])


def usefulness() -> Column:
    """Share of found sources that proved useful, with a neutral prior, damped by what was forgotten."""
    return (F.col("accepted") + F.col("used") + 1) / (F.col("found") + 2) / (1 + F.col("forgotten"))


def current_blocks(events: DataFrame) -> DataFrame:
    """Latest manual block or unblock per host: (name, reason); an unblocked host has no row."""
    return (events.groupBy("name").agg(F.max_by("reason", "at").alias("reason"), F.max_by(F.col("reason").isNotNull(), F.col("at")).alias("on"))
            .where("on").select("name", "reason"))


def host_gate(sources: DataFrame, stats: DataFrame, blocks: DataFrame, min_trials: int = 5) -> DataFrame:
    """Adds `skip_reason` to found sources: blocked hosts and hosts that were never useful."""
    hosts = stats.where(F.col("kind") == "host").select(F.col("name").alias("host"), "found", "accepted", "used", "forgotten")
    joined = sources.join(hosts, "host", "left").join(blocks.select(F.col("name").alias("host"), F.col("reason").alias("blocked")), "host", "left")
    never = (F.lit(min_trials) > 0) & (F.col("found") >= min_trials) & (F.coalesce("accepted", F.lit(0)) == 0) & (F.coalesce("used", F.lit(0)) == 0)
    reason = (F.when(F.col("blocked").isNotNull(), F.concat(F.lit("host blocked: "), F.col("blocked")))
              .when(never, F.concat(F.lit("host never useful (0 of "), F.col("found").cast("string"), F.lit(" found sources accepted)"))))
    filled = joined.fillna(0, ["found", "accepted", "used", "forgotten"])
    return filled.withColumn("skip_reason", reason).withColumn("host_score", usefulness()).drop("found", "accepted", "used", "forgotten", "blocked")


def external_sources(found: DataFrame, forgotten: DataFrame, limit: int, need: str = "need_id") -> DataFrame:
    """Sources worth reading per need: not forgotten, not gated, the most useful hosts first."""
    fresh = found.join(forgotten.select("url_key"), "url_key", "left_anti").where(F.col("skip_reason").isNull())
    return top_per_group(fresh, [need], [F.col("host_score").desc(), F.col("place"), F.col("url")], limit)


def used_documents(context: DataFrame) -> DataFrame:
    return context.select("query_id", F.explode("documents").alias("document_id")).distinct()


def mark_used(searches: DataFrame, context: DataFrame) -> DataFrame:
    """Searches whose documents reached a context of the query that made them are marked used."""
    hit = (searches.select("query_id", "key", F.explode("documents").alias("document_id"))
           .join(used_documents(context), ["query_id", "document_id"], "left_semi").select("key").distinct().withColumn("__used", F.lit(True)))
    return searches.join(hit, "key", "left").withColumn("used", F.col("used") | F.coalesce("__used", F.lit(False))).drop("__used")


# --- Events ---
def event_sequence(events: DataFrame, query_col: str, at: str, event_id: str, block: Column | None = None) -> DataFrame:
    """Gap-free sequence numbers from 1 per query, counted inside time blocks so that a long trace is spread."""
    from .skew import blocked_running_sum
    block = F.date_trunc("day", F.col(at)) if block is None else block
    return blocked_running_sum(events, [query_col], block, [F.col(at), F.col(event_id)], F.lit(1), "sequence")


def _seconds(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))


def sessionize(events: DataFrame, key: list[str], at: str, event_id: str, gap_seconds: int, block: str = "day") -> DataFrame:
    """Adds `run`: a number that grows when more than the gap passed since the key's previous event.

    The previous event is looked up inside time blocks; only each block's first event needs the end of an earlier one.
    """
    rows = events.withColumn("__block", F.date_trunc(block, F.col(at)))
    inside = Window.partitionBy(*key, "__block").orderBy(at, event_id)
    ends = rows.groupBy(*key, "__block").agg(F.max(at).alias("__end"))
    previous = ends.select(*key, "__block", F.lag("__end").over(Window.partitionBy(*key).orderBy("__block")).alias("__last"))
    before = F.coalesce(F.lag(at).over(inside), F.col("__last"))
    opened = (rows.join(previous, [*key, "__block"]).withColumn("__before", before)
              .withColumn("__opens", F.when(F.col("__before").isNull() | (F.col(at) - F.col("__before") > _seconds(gap_seconds)), 1).otherwise(0)).drop("__last", "__before"))
    from .skew import blocked_running_sum
    return blocked_running_sum(opened, key, F.date_trunc(block, F.col(at)), [F.col(at), F.col(event_id)], F.col("__opens"), "run").drop("__opens", "__block")


def working_memory(updates: DataFrame, key: list[str], at: str = "at", update_id: str = "update_id", hours: float = 3,
                   decay: float = 0.5, size: int = 40, block: str = "day") -> DataFrame:
    """The state of each encounter after its last update: its strongest cues with their activation.

    updates: key, update_id, at, cue, activation (several cues share an update). An update multiplies what is held by
    `decay` and keeps the larger of old and new; after a gap of more than `hours` it starts over. Decay is the same
    for every cue, so a cue's final value is its largest activation · decay^(updates since), and a cue that once falls
    out of the strongest `size` never returns: cutting at the end equals cutting at every update. Everything is
    therefore a partial aggregate per (encounter, cue), with no ordered pass over an encounter.
    """
    moments = updates.select(*key, update_id, at).distinct()
    runs = sessionize(moments, key, at, update_id, int(hours * 3600), block)
    from .skew import blocked_running_sum
    numbered = blocked_running_sum(runs, key, F.date_trunc(block, F.col(at)), [F.col(at), F.col(update_id)], F.lit(1), "n")
    last = numbered.groupBy(*key).agg(F.max("run").alias("run"), F.max("n").alias("last_n"), F.max(at).alias("updated_at"))
    current = numbered.join(last, [*key, "run"]).select(*key, update_id, "n", "last_n", "updated_at")
    held = (updates.join(current, [*key, update_id])
            .groupBy(*key, "cue", "updated_at").agg(F.max(F.col("activation") * F.pow(F.lit(decay), F.col("last_n") - F.col("n"))).alias("activation")))
    return top_per_group(held, key, [F.round("activation", 12).desc(), F.col("cue")], size, "place")


# --- Episodes, searches, reuse ---
def episodes(asked: DataFrame, keep_queries: int = 50) -> DataFrame:
    """One row per episode key: count, first and last time, latest result, the last query ids.

    asked: scope, key, query_id, at, question, answer. Only the newest ids per key are gathered.
    """
    totals = asked.groupBy("scope", "key").agg(
        F.count(F.lit(1)).alias("count"), F.min("at").alias("first_at"), F.max("at").alias("asked_at"),
        F.max_by(F.struct("query_id", "question", "answer"), F.struct("at", "query_id")).alias("latest"))
    newest = top_per_group(asked.select("scope", "key", "query_id", "at"), ["scope", "key"], [F.col("at").desc(), F.col("query_id").desc()], keep_queries)
    ids = newest.groupBy("scope", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "query_id"))), lambda x: x["query_id"]).alias("query_ids"))
    return totals.join(ids, ["scope", "key"]).select("scope", "key", "count", "first_at", "asked_at", "latest.query_id", "latest.question", "latest.answer", "query_ids")


def change_markers(changes: DataFrame) -> DataFrame:
    return changes.groupBy("scope").agg(F.max("at").alias("changed_at"))


def reusable_episode(questions: DataFrame, episodes: DataFrame, changes: DataFrame, hours: float = 24, threshold: float = 0.94,
                     similar: DataFrame | None = None) -> DataFrame:
    """The earlier episode that may answer a question again.

    questions: query_id, scope, options, key, at; episodes: key, scope, options, at, completed, context_size, ...;
    similar: (query_id, key, score) of paraphrases. Exact keys count as similarity 1. Guards: scope and options equal,
    within the hours, newer than the last change of the scope or the shared memory, completed with a context.
    """
    exact = questions.select("query_id", "key", F.lit(1.0).alias("score"))
    close = exact if similar is None else exact.unionByName(similar.select("query_id", "key", "score").where(F.col("score") >= threshold))
    pairs = close.groupBy("query_id", "key").agg(F.max("score").alias("score"))
    asked = questions.select("query_id", "scope", "options", F.col("at").alias("asked_at"))
    marks = change_markers(changes)
    shared = marks.where(F.col("scope") == "shared").agg(F.max("changed_at").alias("at")).scalar()
    candidates = (pairs.join(asked, "query_id").join(episodes, ["key", "scope", "options"])
                  .join(marks, "scope", "left")
                  .where((F.col("at") < F.col("asked_at")) & (F.col("at") >= F.col("asked_at") - F.make_dt_interval(secs=F.lit(hours * 3600).cast("decimal(18,6)")))
                         & F.col("completed") & (F.col("context_size") > 0)
                         & (F.col("changed_at").isNull() | (F.col("at") > F.col("changed_at")))
                         & (shared.isNull() | (F.col("at") > shared))))
    return top_per_group(candidates, ["query_id"], [F.col("score").desc(), F.col("at").desc(), F.col("key")], 1).drop("rank", "changed_at")


def as_of_reuse(asked: DataFrame, key: list[str], at: str, event_id: str, window_seconds: int, block: str = "day") -> DataFrame:
    """Each event's latest earlier event of the same key, when it lies within the window.

    Only time blocks' last events travel between blocks, so a key of any size is spread over its days.
    """
    rows = asked.withColumn("__block", F.date_trunc(block, F.col(at)))
    inside = Window.partitionBy(*key, "__block").orderBy(at, event_id)
    stamp = F.struct(F.col(at).alias("at"), F.col(event_id).alias("id"))
    ends = rows.groupBy(*key, "__block").agg(F.max(stamp).alias("__end"))
    earlier = ends.select(*key, "__block", F.lag("__end").over(Window.partitionBy(*key).orderBy("__block")).alias("__last"))
    found = (rows.withColumn("__inside", F.lag(stamp).over(inside)).join(earlier, [*key, "__block"])
             .withColumn("__p", F.coalesce("__inside", "__last")))
    close = F.col(at) - F.col("__p.at") <= _seconds(window_seconds)
    return found.select(*asked.columns, F.when(close, F.col("__p.id")).alias("reused_id"), F.when(close, F.col("__p.at")).alias("reused_at"))


def retention(queries: DataFrame, events: DataFrame, as_of: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Query records and traces that stay: running queries, and others created within the days."""
    first = events.groupBy("query_id").agg(F.min("at").alias("__first"))
    born = F.coalesce("created_at", "__first")
    kept = (queries.join(first, "query_id", "left")
            .where((F.col("status") == "running") | born.isNull() | (born >= as_of - F.make_dt_interval(F.lit(days)))).select(queries.columns))
    return kept, events.join(kept.select("query_id"), "query_id", "left_semi")


def retained_episodes(rows: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    return rows.where(F.col("asked_at") >= as_of - F.make_dt_interval(F.lit(days)))


def fail_interrupted(queries: DataFrame, job_start: Column) -> DataFrame:
    """Queries still running from before this job are explicit failures."""
    lost = (F.col("status") == "running") & (F.col("created_at") < job_start)
    return queries.withColumn("error", F.when(lost, F.lit("Service restarted during query")).otherwise(F.col("error"))).withColumn(
        "status", F.when(lost, F.lit("failed")).otherwise(F.col("status")))


# --- User facts ---
def add_facts(stored: DataFrame, proposed: DataFrame) -> DataFrame:
    """Facts with the proposals that are new: same text (case-folded) among non-rejected ones is a repeat, and an
    inferred proposal must cite at least one question."""
    from ..functions.text import casefold
    folded = casefold(F.col("text"))
    known = stored.where(F.col("status") != "rejected").select("scope", folded.alias("__k")).distinct()
    sound = proposed.where((F.col("origin") != "inferred") | (F.size("evidence") > 0)).withColumn("__k", folded)
    first = top_per_group(sound.join(known, ["scope", "__k"], "left_anti"), ["scope", "__k"], [F.col("created_at"), F.col("id")], 1)
    return stored.unionByName(first.select(stored.columns))


def change_facts(stored: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Partial updates by (scope, id); a change with `deleted` removes the fact."""
    latest = changes.groupBy("scope", "id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"__{c}") for c in ("kind", "text", "status", "deleted")])
    rows = stored.join(latest.withColumn("__hit", F.lit(True)), ["scope", "id"], "left").where(~F.coalesce("__deleted", F.lit(False)))
    for c in ("kind", "text", "status"):
        rows = rows.withColumn(c, F.coalesce(f"__{c}", c))
    return rows.withColumn("updated_at", F.when(F.col("__hit"), at).otherwise(F.col("updated_at"))).select(stored.columns)


def user_context(facts: DataFrame) -> DataFrame:
    """Active facts of private scopes as lines; read them by `created_at`, `id`. Rows, so no scope is gathered."""
    active = facts.where((F.col("status") == "active") & (F.col("scope") != "shared"))
    return active.select("scope", "created_at", "id", F.concat_ws(": ", "kind", "text").alias("line"))


# --- Metrics ---
def usage_metrics(usage: DataFrame, searches: DataFrame) -> DataFrame:
    calls = usage.agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
                      F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), F.sum(F.coalesce("estimated_cost", F.lit(0.0))).alias("reported_cost"),
                      F.count_if(F.col("estimated_cost").isNull()).alias("calls_without_cost"))
    found = searches.agg(F.struct(F.count(F.lit(1)).alias("needs"), F.sum(F.coalesce("reused", F.lit(0))).alias("skipped_as_recent"),
                                  F.count_if(F.coalesce("used", F.lit(False))).alias("reached_context")).alias("s")).scalar()
    return calls.withColumn("__s", found).select(*calls.columns, "__s.needs", "__s.skipped_as_recent", "__s.reached_context")


def hits(events: DataFrame) -> DataFrame:
    """Navigation hits and successful retrievals per node."""
    return events.groupBy("node_id").agg(F.count_if(~F.col("success")).alias("navigation_hits"), F.count_if("success").alias("successful_retrievals"))
