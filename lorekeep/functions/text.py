"""Word sets, normalisation, numbers, time cues and text checks as JVM-side column expressions."""

from __future__ import annotations

import calendar
import functools
import unicodedata

from pyspark.sql import Column, functions as F

# Question and function words left out of lexical overlap (English and French).
STOP_WORDS = (
    "a an and are as at be by can do does for from how i in is it of on or should the them to "
    "what when where which who why with au aux ce de des du en est et la le les un une qui que quoi "
    "comment pourquoi pour par sur dans"
).split()

# Stop words of the BM25 tokens.
BM25_STOP_WORDS = (
    "a an the of to in on for and or is are was were be been it its this that with as by at from how what why "
    "when where which who whom do does did can could should would will i you your my me we our not no if so"
).split()

# Words that never name an entity.
RECALL_STOP_WORDS = STOP_WORDS + "my me you your we our was were did has have had am get got i'm i've".split()
IGNORED_NAMES = ["user", "assistant", "the user", "the assistant", "i", "me", "you"]

# Function words that tell English from French.
ENGLISH_WORDS = "the and was with after during this that of to is are for learner lesson".split()
FRENCH_WORDS = "le la les de et est une un des du l que pour dans avec leçon apprenant".split()

# Patterns of degenerate text (code or markup debris, a cut-off ending) and of CJK script.
DEBRIS_PATTERN = r"\(\)|\]\]|~~|\[s\d+\]|\[date\]|\">|[a-z][A-Z][a-z]+\(|(\.\.\.|…)\s*$"
CJK_PATTERN = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"

# Time cue vocabulary.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
COUNT_WORDS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "couple of": 2, "a couple of": 2, "few": 3, "a few": 3,
}
COUNT_PATTERN = r"(\d+|a couple of|couple of|a few|few|an?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"

WORD_PATTERN = r"[\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """Evaluates `value` once and hands it to `body`; keeps a reused expression from being computed twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# --- Folding tables, derived once from the Unicode database ---
def _letters():
    return (chr(c) for c in range(0x80, 0x10000) if not 0xAC00 <= c <= 0xD7AF and not 0xD800 <= c <= 0xDFFF)


@functools.lru_cache(maxsize=1)
def _casefold_table():
    """(single characters, their folds, multi-character folds) where case folding differs from lower case."""
    differs = [c for c in _letters() if c.casefold() != c.lower() and c == c.lower()]
    single = [c for c in differs if len(c.casefold()) == 1]
    return "".join(single), "".join(c.casefold() for c in single), [(c, c.casefold()) for c in differs if len(c.casefold()) > 1]


@functools.lru_cache(maxsize=1)
def _accent_table():
    """(characters, replacements, multi-character folds): NFKD without combining marks, of lower-case characters."""
    source, target, dropped, longer = [], [], [], []
    for c in _letters():
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if folded == c or c != c.lower():
            continue
        if not folded:
            dropped.append(c)
        elif len(folded) == 1:
            source.append(c)
            target.append(folded)
        else:
            longer.append((c, folded))
    return "".join(source + dropped), "".join(target), longer


def _ranges(characters) -> str:
    """A character class of code-point ranges, which a regex engine checks faster than single characters."""
    points, spans = sorted(ord(c) for c in characters), []
    for p in points:
        if spans and spans[-1][1] == p - 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _rare(text: Column, characters) -> Column:
    """Whether a text holds one of the characters. A class of many ranges is slow, so texts of Latin-1 letters pass a plain one first."""
    latin = [c for c in characters if c <= "\xff"]
    beyond = text.rlike("[^\\x00-\\xff]")
    for c in latin:
        beyond = beyond | text.contains(c)
    return beyond & text.rlike(_ranges(characters))


def _replace_all(text: Column, pairs) -> Column:
    """Multi-character folds, applied only to the rare texts that hold such a character; ß, which is common, goes first and alone."""
    rare = [(c, r) for c, r in pairs if c != "ß"]
    # One literal keeps the plan small: each entry is a character followed by its fold.
    table = F.split(F.lit("\x01".join(c + r for c, r in rare)), "\x01")

    def fixed(t: Column) -> Column:
        folded = F.aggregate(table, t, lambda acc, p: F.replace(acc, F.substring(p, 1, 1), F.substring(p, 2, 100)))
        return F.when(_rare(t, [c for c, _ in rare]), folded).otherwise(t)

    sharp = dict(pairs).get("ß")
    if sharp is None:
        return let(text, fixed)
    return let(F.when(text.contains("ß"), F.replace(text, F.lit("ß"), F.lit(sharp))).otherwise(text), fixed)


def casefold(text: Column) -> Column:
    """Python-style case folding (ß → ss, final sigma, ligatures)."""
    source, target, longer = _casefold_table()

    def folded(lowered: Column) -> Column:
        # Translating walks a text letter by letter, so it is left to the few texts that hold a letter to translate.
        return let(F.when(_rare(lowered, source), F.translate(lowered, source, target)).otherwise(lowered), lambda t: _replace_all(t, longer))

    return let(F.lower(text), lambda lowered: F.when(_ascii(lowered), lowered).otherwise(folded(lowered)))


def fold_accents(text: Column) -> Column:
    """Lower case, compatibility-decomposed, combining marks removed."""
    source, target, longer = _accent_table()

    def folded(lowered: Column) -> Column:
        return let(F.translate(lowered, source, target), lambda t: _replace_all(t, longer))

    return let(F.lower(text), lambda lowered: F.when(_ascii(lowered), lowered).otherwise(folded(lowered)))


# --- Word sets ---
def word_list(text: Column) -> Column:
    return F.regexp_extract_all(casefold(text), F.lit(WORD_PATTERN), F.lit(0))


def words(text: Column) -> Column:
    """The set of letter/digit runs of a case-folded text."""
    return F.array_distinct(word_list(text))


def terms(text: Column) -> Column:
    """Content words: the word set without stop words, or the whole set when nothing else is left."""
    return let(words(text), lambda w: let(
        F.array_except(w, literals(STOP_WORDS)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(w)))


def bm25_tokens(text: Column) -> Column:
    """Lower-case ASCII tokens without stop words, duplicates kept in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)),
                    lambda t: ~t.isin(BM25_STOP_WORDS))


def taxonomy_forms(word: Column) -> Column:
    """A word and its naive singular or plural form."""
    singular = (F.length(word) > 3) & word.endswith("s")
    return F.array(word, F.when(singular, F.substring(word, F.lit(1), F.length(word) - 1))
                   .otherwise(F.concat(word, F.lit("s"))))


def norm_words(text: Column) -> Column:
    """Accent-free lower-case words, a final plural s dropped."""
    found = F.regexp_extract_all(fold_accents(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.transform(found, lambda w: F.when(
        (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"),
        F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def norm(text: Column) -> Column:
    return F.array_join(norm_words(text), " ")


def ngrams(tokens: Column, longest: int = 6, stop=()) -> Column:
    """All 1..longest-word n-grams of a token array as strings, n-grams made only of stop words left out."""
    stop_words = list(stop)

    def of_length(words, n):
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        runs = F.transform(starts, lambda i: F.slice(words, i, n))
        if stop_words:
            runs = F.filter(runs, lambda g: F.exists(g, lambda w: ~w.isin(stop_words)))
        return F.when(F.size(words) >= n, F.transform(runs, lambda g: F.array_join(g, " "))).otherwise(
            F.array().cast("array<string>"))

    # The token array is bound once: an expensive expression must not be evaluated again for every position.
    return let(tokens, lambda words: F.array_distinct(F.flatten(F.array(*[of_length(words, n) for n in range(1, longest + 1)]))))


def numbers(text: Column) -> Column:
    """The set of figures in a text, decimal comma read as a point, sorted so that equal sets compare equal."""
    found = F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(".")))))


def iso_date(value: Column) -> Column:
    """The date of an ISO text's first ten characters, null when they are none."""
    head = F.substring(value, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


# --- Text quality ---
def english_lean(text: Column) -> Column:
    """English minus French function words, every occurrence counted."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]+"), F.lit(0))
    return F.aggregate(found, F.lit(0), lambda n, w: n + F.when(w.isin(ENGLISH_WORDS), 1).otherwise(0)
                       - F.when(w.isin(FRENCH_WORDS), 1).otherwise(0))


def corrupted(memory: Column, session: Column) -> Column:
    """Debris, a cut-off sentence, a script the session never uses, or English about a French session."""
    return (memory.rlike(DEBRIS_PATTERN)
            | (memory.rlike(CJK_PATTERN) & ~session.rlike(CJK_PATTERN))
            | ((english_lean(memory) > 1) & (english_lean(session) < -5)))


def rendered_words(text: Column) -> Column:
    """Whitespace-separated words, as lengths of answers are counted."""
    trimmed = F.regexp_replace(F.trim(text), r"\s+", " ")
    return F.when(F.trim(trimmed) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(trimmed), " "))


def token_count(text: Column) -> Column:
    """Default size of a text in budget units: its whitespace-separated words."""
    return F.regexp_count(text, F.lit(r"\S+"))


def truncate_tokens(text: Column, limit: Column | int) -> Column:
    """The longest prefix of a text that holds at most `limit` default tokens."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    pieces = F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))
    return F.when(token_count(text) <= limit, text).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.greatest(limit, F.lit(0))), ""))


# --- Time cues ---
def _count(word: Column) -> Column:
    chain = None
    for name, value in COUNT_WORDS.items():
        chain = F.when(word == name, F.lit(value)) if chain is None else chain.when(word == name, F.lit(value))
    return chain.otherwise(word.try_cast("int"))


def _unit(word: Column) -> Column:
    chain = None
    for name, value in UNIT_DAYS.items():
        chain = F.when(word == name, F.lit(value)) if chain is None else chain.when(word == name, F.lit(value))
    return chain


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def time_window(text: Column, now: Column) -> Column:
    """The (start, end) dates a text points at relative to `now`, or null. The first rule that matches wins."""
    t = F.lower(text)
    # Fixed patterns: the wordings that count as time cues.
    ago = r"\b" + COUNT_PATTERN + r" (day|week|month|year)s? ago"
    past = r"\b(?:last|past) " + COUNT_PATTERN + r" (day|week|month|year)s?"
    last = r"(?:last|past|previous) (day|week|month|year)\b"
    this = r"this (week|month|year)\b"
    months = [m.lower() for m in calendar.month_name if m]
    named = r"\b(?:in|during|of|since) (" + "|".join(months) + r")(?:,? (\d{4}))?\b"

    days = _count(F.regexp_extract(t, ago, 1)) * _unit(F.regexp_extract(t, ago, 2))
    slack = F.when(_unit(F.regexp_extract(t, ago, 2)) > 1, F.greatest(F.lit(1), F.floor(days / 7).cast("int"))).otherwise(1)
    center = F.date_sub(now, days)
    month = F.array_position(literals(months), F.regexp_extract(t, named, 1)).cast("int")
    year_text = F.regexp_extract(t, named, 2)
    year = F.when(year_text != "", year_text.try_cast("int")).otherwise(
        F.year(now) - F.when(month > F.month(now), 1).otherwise(0))
    first = F.make_date(year, month, F.lit(1))
    return (F.when(t.rlike(ago), _span(F.date_sub(center, slack), F.date_add(center, slack)))
            .when(t.rlike(past), _span(F.date_sub(now, _count(F.regexp_extract(t, past, 1)) * _unit(F.regexp_extract(t, past, 2))), now))
            .when(t.rlike(last), _span(F.date_sub(now, _unit(F.regexp_extract(t, last, 1))), now))
            .when(t.rlike(this), _span(F.date_sub(now, _unit(F.regexp_extract(t, this, 1))), now))
            .when(t.contains("yesterday"), _span(F.date_sub(now, 1), F.date_sub(now, 1)))
            .when(t.contains("today"), _span(now, now))
            .when(t.rlike(named), _span(first, F.last_day(first))))
