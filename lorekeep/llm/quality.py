"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Counts that the result shows are taken for every document; the rules follow as one conditional expression that stops at
the first rule that rejects. Their order is chosen on a sample: each rule's cost is the work it does there (characters,
words or lines it passes over, by fixed weights) and its selectivity the share it rejects; rules with the most rejections
per cost come first. The order changes how much work is done, never the verdict.

Cases: a null or empty text has no words and fails the base; a rule on a share passes where there is nothing to share out;
repeated rows are judged alike; on an empty table the rules keep their listed order; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
RUN = 5
SAMPLE_ROWS = 2_000
#: Positions of a text's words take these low bits of a sort key, the rest is hash.
PLACE_BITS = 25


@dataclass(frozen=True)
class Rule:
    """A named rejection. `cost` is the work per document, `rejects` true for documents that the rule turns away."""
    name: str
    cost: Column
    rejects: Column


def occurrences(text: Column, pattern: str) -> Column:
    """How often a one-character pattern occurs."""
    return F.size(F.split(text, pattern)) - 1


def rules() -> list[Rule]:
    text, lines, words = F.col("text"), F.col("lines"), F.col("words")
    characters, n_words, n_lines = F.length("text"), F.col("n_words"), F.size("lines")
    none = F.lit(1)
    return [
        Rule("symbols", none, F.col("n_symbols") * 10 > n_words),
        Rule("word_length", none, (F.col("word_chars") < n_words * 2) | (F.col("word_chars") > n_words * 15)),
        # A line or two that come again, as headings and refrains do, are no fault of a short text.
        Rule("repeated_lines", none, (F.col("n_dup_lines") > 2) & (F.col("n_dup_lines") * 100 > n_lines * 30)),
        Rule("stutter", n_words * 5, F.size(F.filter(words, lambda w, i: F.coalesce(w == F.get("words", i - 1), F.lit(False)))) * 10 > n_words * 4),
        Rule("marks", characters, occurrences(text, "[!?]") * 2 > n_words),
        Rule("digits", characters, occurrences(text, "[0-9]") * 10 > F.col("word_chars") * 3),
        Rule("braces", characters, occurrences(text, r"[{}\[\]]") * 5 > n_words),
        Rule("capitals", characters * 2, occurrences(text, r"\p{Lu}") * 2 > F.col("word_chars")),
        Rule("filler", characters, F.lower(text).contains("lorem ipsum")),
        Rule("bullets", n_lines * 20, F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•‣·]"))) * 10 > n_lines * 9),
        Rule("broken_lines", n_lines * 20, F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))) * 10 > n_lines * 3),
        Rule("letterless", n_words * 20, F.size(F.filter(words, lambda x: x.rlike(r"\p{L}"))) * 10 < n_words * 6),
    ]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, also where the optimizer copies the whole expression (as it does when a
    filter on the result moves below the projection)."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_run_words(words: Column, run: int = RUN) -> Column:
    """How many words lie in runs of `run` words that the text holds twice or more."""
    place = (1 << PLACE_BITS) - 1
    zero = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.coalesce(F.least(F.get(places, i + 1) - p, F.lit(run)), F.lit(run)).cast("long")), zero, lambda a, b: a + b)

    def of_repeated(runs: Column) -> Column:
        # Sort keys order the runs by hash and place; neighbours are compared by the whole hash.
        keys = F.sort_array(F.transform(runs, lambda h, i: h.bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long"))))

        def places(sorted_keys: Column) -> Column:
            at = lambda i: F.get(runs, F.get(sorted_keys, i).bitwiseAND(F.lit(place)).cast("int"))
            same = lambda i, j: F.coalesce(at(i) == at(j), F.lit(False))
            hits = F.filter(F.sequence(F.lit(0), F.size(sorted_keys) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            return F.sort_array(F.transform(hits, lambda i: F.get(sorted_keys, i).bitwiseAND(F.lit(place))))

        return F.when(F.size(F.array_distinct(runs)) < F.size(runs), let(keys, lambda k: let(places(k), covered))).otherwise(zero)

    runs = F.transform(F.sequence(F.lit(0), F.size(words) - run), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(run)]))
    return F.when(F.size(words) < run, zero).otherwise(let(runs, of_repeated))


def measured(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text, words, lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    words = let(F.btrim("text", F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_GAP)))
    split = text.select("id", "text", words.alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(HAS_WORD)).alias("lines"))
    counted = split.select(
        "*", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        occurrences(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_run_words(F.col("words")).alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def cascade_order(counts: DataFrame, listed: list[Rule]) -> list[Rule]:
    """The rules by rejections per cost on `counts`, a sample; ties keep the listed order."""
    passed = ~F.col("base_failed")
    row = counts.agg(F.count(F.when(passed, 1)).alias("rows"), *[F.count(F.when(passed & r.rejects, 1)).alias(f"r_{r.name}") for r in listed],
                     *[F.sum(F.when(passed, r.cost.cast("double"))).alias(f"c_{r.name}") for r in listed]).first()
    if not row["rows"]:
        return listed
    return sorted(listed, key=lambda r: -row[f"r_{r.name}"] / max(row[f"c_{r.name}"], 1.0))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: the id, the counts, `base_failed`, `kept` and `failed_rule`, the first rule of the cascade that rejected."""
    total = docs.count()
    share = max(1, total // sample_rows)
    sample = docs.where(F.pmod(F.xxhash64(F.col(id_column)), F.lit(share)) == 0) if total > sample_rows else docs
    ordered = cascade_order(measured(sample, id_column, text_column), rules())
    verdict = F.when(F.col("base_failed"), "base")
    for rule in ordered:
        verdict = verdict.when(rule.rejects, rule.name)
    return (measured(docs, id_column, text_column).withColumn("failed_rule", verdict)
            .select(F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    F.col("failed_rule").isNull().alias("kept"), "failed_rule"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
c AS (SELECT *, len(w) AS n, length(array_to_string(w, '')) AS chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS sym, len(l) - len(list_distinct(l)) AS dup FROM s),
x AS (SELECT doc_id, unnest(range(1, n - 3)) AS i, w FROM c WHERE n >= 5),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], chr(10)) AS run FROM x),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS many FROM g),
p AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS part FROM h WHERE many > 1),
r AS (SELECT doc_id, sum(part) AS rep FROM p GROUP BY doc_id),
b AS (SELECT c.*, coalesce(rep, 0) AS rep, n < 10 OR 100 * coalesce(rep, 0) > 20 * n AS failed FROM c LEFT JOIN r USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, sym::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words,
       failed AS base_failed,
       NOT (failed OR sym * 10 > n OR chars < n * 2 OR chars > n * 15 OR (dup > 2 AND dup * 100 > len(l) * 30)
            OR 10 * len(list_filter(range(2, n + 1), lambda i: w[i] = w[i - 1])) > 4 * n
            OR 2 * (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) > n
            OR 10 * (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) > 3 * chars
            OR 5 * (length(text) - length(regexp_replace(text, '[{}\[\]]', '', 'g'))) > n
            OR 2 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) > chars
            OR contains(lower(text), 'lorem ipsum')
            OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•‣·]'))) > 9 * len(l)
            OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 3 * len(l)
            OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 6 * n) AS kept
FROM b
"""
