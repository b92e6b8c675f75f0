"""Deterministic ids and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import terms

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value: the RFC 4122 URL namespace, as hex
DEFAULT_PREFIX = "lorekeep"


def uuid5_url(name: Column) -> Column:
    """RFC 4122 version-5 UUID of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]),
                           (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
                    F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
                    F.substring(digest, 21, 12))


def stable_id(kind: Column | str, key: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return uuid5_url(F.concat(F.lit(prefix + ":"), kind, F.lit(":"), key))


def edge_id(src: Column, relation: Column, dst: Column, predicate: Column | None = None, row_id: Column | None = None,
            prefix: str = DEFAULT_PREFIX) -> Column:
    """Edge identity; typed semantic relations also carry their predicate and source row."""
    base = F.concat(src, F.lit(":"), relation, F.lit(":"), dst)
    if predicate is not None:
        row_id = F.lit("") if row_id is None else row_id
        typed = F.concat(base, F.lit(":"), F.coalesce(predicate, F.lit("")), F.lit(":"), F.coalesce(row_id, F.lit("")))
        base = F.when(relation == "SEMANTIC_RELATION", typed).otherwise(base)
    return stable_id("edge", base, prefix)


def document_id(scope: Column, parser_version: str, mime: Column, content_hash: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    """Identical content of one type is one document per scope."""
    private = F.when(scope == "shared", F.lit("")).otherwise(F.concat(scope, F.lit(":")))
    return stable_id("document", F.concat(private, F.lit(parser_version + ":"), mime, F.lit(":"), content_hash), prefix)


def source_id(scope: Column, uri: Column, filename: Column, title: Column, content_hash: Column,
              prefix: str = DEFAULT_PREFIX) -> Column:
    shared = stable_id("source", F.concat(F.coalesce(uri, filename, title, F.lit("")), F.lit(":"), content_hash), prefix)
    return F.when(scope == "shared", shared).otherwise(
        stable_id("source", F.concat(scope, F.lit(":"), shared), prefix))


def search_key(description: Column, scope: Column, limit: int = 500) -> Column:
    """The scope and the need's content words in order, so reordered repeats match. A key is defined by its first `limit`
    characters of words; the description itself stays whole."""
    return F.concat(scope, F.lit("|"), F.substring(F.array_join(F.array_sort(terms(description)), " "), 1, limit))


def episode_options(mode: Column, synthesize: Column, answer_max_words: Column, allow_external: Column,
                    original_sources_only: Column) -> Column:
    def text(c):  # as Python prints them, since keys are compared across writers
        return F.coalesce(F.initcap(c.cast("string")), F.lit("None"))
    return F.concat_ws("|", mode, text(synthesize), text(answer_max_words), text(allow_external), text(original_sources_only))


def episode_key(scope: Column, options: Column, question: Column) -> Column:
    """One episode per distinct question and options in a scope."""
    plain = F.concat(options, F.lit("|"), F.array_join(F.array_sort(terms(question)), " "))
    return F.concat(scope, F.lit("|"), F.substring(F.sha2(plain, 256), 1, 32))


def url_key(url: Column) -> Column:
    return F.sha2(url, 256)


def memory_id(session: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat(session, F.lit("|"), text)), 1, 12)


def digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", *[p.cast("string") for p in parts]), 256), 1, 16)


def host(url: Column) -> Column:
    """Host name in lower case without port and `www.`; empty when the address has none."""
    name = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    return F.coalesce(name, F.lit(""))


def safe_url(url: Column, allowed_hosts=(), public_web: bool = True) -> Column:
    """https only, no credentials, port 443, no control characters or backslashes, host on the allow-list."""
    authority = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    plain = F.regexp_extract(authority, r"^([^@:]+)(?::443)?$", 1)
    ok = (plain != "") & ~url.rlike(r"[\x00-\x1f\\]")
    return F.coalesce(ok if public_web else ok & F.lower(plain).isin(list(allowed_hosts)), F.lit(False))


def safe_filename(name: Column) -> Column:
    """The last path part with unusual characters replaced, at most 200 characters; null when empty."""
    last = F.element_at(F.split(F.coalesce(name, F.lit("")), r"[/\\]"), -1)
    cleaned = F.substring(F.regexp_replace(last, r"[^\p{L}\p{N}_. -]", "_"), 1, 200)
    return F.when(cleaned != "", cleaned)


SCOPE_PATTERN = r"^(shared|[a-z][a-z0-9_-]{0,30}:[A-Za-z0-9_.@-]{1,120})$"  # fixed value: valid scopes


def valid_scope(scope: Column) -> Column:
    return scope.rlike(SCOPE_PATTERN)
