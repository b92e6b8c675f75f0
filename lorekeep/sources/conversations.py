"""Conversations: rounds, round texts, session keys, extraction transcripts and packed histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_TURNS = 1024


def with_rounds(turns: DataFrame, session: str = "session", turn: str = "turn") -> DataFrame:
    """Adds `round`: a user turn opens a round, leading other turns form round 0.

    User turns are counted inside blocks of turns and the counts of earlier blocks are added, so one endless session
    is spread over many tasks.
    """
    rows = turns.withColumn("__block", F.floor(F.col(turn) / BLOCK_TURNS))
    is_user = F.when(F.col("role") == "user", 1).otherwise(0)
    blocks = rows.groupBy(session, "__block").agg(F.sum(is_user).alias("__users"), F.min_by("role", turn).alias("__head"))
    by_block = Window.partitionBy(session).orderBy("__block")
    offsets = blocks.select(
        session, "__block",
        (F.sum("__users").over(by_block) - F.col("__users")).alias("__before"),
        F.first("__head").over(by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__first"))
    inside = Window.partitionBy(session, "__block").orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("__inside", F.sum(is_user).over(inside)).join(offsets, [session, "__block"])
            .withColumn("round", (F.col("__inside") + F.col("__before") - F.when(F.col("__first") == "user", 1).otherwise(0)).cast("long"))
            .drop("__block", "__inside", "__before", "__first"))


def ordered_text(order: Column, text: Column, separator: str) -> Column:
    """Texts of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def round_texts(rounds: DataFrame, session: str = "session", turn: str = "turn", content: str = "content") -> DataFrame:
    """One row per round: its turns as `role: content` lines."""
    return rounds.groupBy(session, "round").agg(
        ordered_text(F.col(turn), F.concat(F.col("role"), F.lit(": "), F.col(content)), "\n").alias("text"),
        F.count(F.lit(1)).alias("turns"))


def session_sizes(turns: DataFrame, session: str = "session", max_turns: int = 300) -> tuple[DataFrame, DataFrame]:
    """Sessions an interface that takes 1 to `max_turns` turns accepts, and those it rejects. Transcripts and keys take all."""
    sizes = turns.groupBy(session).agg(F.count(F.lit(1)).alias("turns"))
    return sizes.where(F.col("turns") <= max_turns), sizes.where(F.col("turns") > max_turns)


def transcripts(rounds: DataFrame, session: str = "session", day: str = "day", turn: str = "turn", content: str = "content",
                user_chars: int = 3000, assistant_chars: int = 1000) -> DataFrame:
    """The text a memory extraction reads: session date, round headings, each turn cut to its role's limit. All sessions."""
    limit = F.when(F.col("role") == "user", user_chars).otherwise(assistant_chars)
    cut = F.when(F.length(content) <= limit, F.col(content)).otherwise(F.concat(F.substring(F.col(content), F.lit(1), limit), F.lit(" [...]")))
    line = F.concat(F.upper("role"), F.lit(": "), cut)
    by_round = rounds.groupBy(session, day, "round").agg(ordered_text(F.col(turn), line, "\n").alias("lines"))
    heading = F.concat(F.lit("Session date: "), F.date_format(day, "yyyy-MM-dd (EEE)"))
    body = ordered_text(F.col("round"), F.concat(F.lit("\n[round "), F.col("round").cast("string"), F.lit("]\n"), F.col("lines")), "\n")
    return by_round.groupBy(session, day).agg(body.alias("body")).select(session, day, F.concat_ws("\n", heading, "body").alias("transcript"))


def session_keys(turns: DataFrame, session: str = "session", day: str = "day", turn: str = "turn", content: str = "content") -> DataFrame:
    """Content key: the same turns on another date get another key."""
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.array("role", content).alias("m")))), lambda x: x["m"]))
    return turns.groupBy(session, day).agg(F.sha1(F.concat(F.col(day).cast("string"), body).cast("binary")).alias("key"))


def packed_history(chosen: DataFrame, query_col: str = "query_id", session: str = "session", stamp: str = "stamp") -> DataFrame:
    """Chosen rounds as one text per query: sessions in date order, rounds in order inside. The budget bounds it."""
    by_session = chosen.groupBy(query_col, session).agg(F.min(stamp).alias(stamp), ordered_text(F.col("round"), F.col("text"), "\n").alias("content"))
    numbered = by_session.withColumn("n", F.row_number().over(Window.partitionBy(query_col).orderBy(stamp, session)))
    part = F.concat(F.lit("### Session "), F.col("n").cast("string"), F.lit(":\nSession Date: "), F.col(stamp).cast("string"),
                    F.lit("\nSession Content:\n"), F.col("content"))
    return numbered.groupBy(query_col).agg(ordered_text(F.col("n"), part, "\n").alias("history"), F.count(F.lit(1)).alias("sessions"))


def haystack_turns(questions: DataFrame) -> DataFrame:
    """Turns of a question set whose rows hold parallel arrays of session ids, dates and turn lists."""
    sessions = questions.select("question_id", "question", "question_type", F.explode(F.arrays_zip(
        "haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("s"))
    return sessions.select(
        "question_id", "question_type", F.col("s.haystack_session_ids").alias("session"), F.col("s.haystack_dates").alias("stamp"),
        F.posexplode("s.haystack_sessions").alias("turn", "t")).select(
        "question_id", "question_type", "session", "stamp", "turn", F.col("t.role").alias("role"), F.col("t.content").alias("content"),
        F.coalesce(F.col("t.has_answer"), F.lit(False)).alias("has_answer"))
