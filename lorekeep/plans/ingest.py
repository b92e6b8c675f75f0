"""Ingestion jobs: page text, structure, chunks, registration, images and recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ids
from ..functions.vectors import hash_embedding
from ..operators.inference import embed
from ..sources import extraction, media, passages, structure
from .registry import query
from .search import STOP_SQL, WORDS_SQL


def ingest(sources: DataFrame, stored: DataFrame | None = None, parser_version: str = "1", light: bool = True, fetched_for: str | None = None,
           cache: DataFrame | None = None) -> dict[str, DataFrame]:
    """Sources (source_key, content, mime, title, uri, filename, scope) to graph rows.

    Extracted, registered once per content and scope, cut into a tree and embedded. Light ingestion leaves summaries and
    concepts to a later structuring of documents that other queries use.
    """
    digest = F.sha2(F.col("content").cast("binary"), 256)
    named = sources.where(ids.valid_scope(F.col("scope"))).withColumns({
        "content_hash": digest, "filename": ids.safe_filename(F.col("filename")),
        "document_id": ids.document_id(F.col("scope"), parser_version, F.col("mime"), digest)})
    named = named.withColumn("source_id", ids.source_id(F.col("scope"), F.col("uri"), F.col("filename"), F.col("title"), F.col("content_hash")))
    known = stored if stored is not None else named.select("document_id").where(F.lit(False))
    fresh, duplicates = passages.new_documents(named, known)
    texts = extraction.extract_texts(fresh, "document_id")
    good = texts.where("error is null").join(fresh.select("document_id", "title", "scope"), "document_id")
    parsed = structure.parse_structure(good.select("document_id", "title", "text"))
    nodes, edges = structure.graph_rows(parsed)
    ready = nodes.withColumns({"routing_summary": F.lit(""), "summary": F.lit(""), "description": F.lit("")}).withColumn("probe", structure.embedding_text())
    embedded, fresh_vectors = embed(ready, cache, text="probe")
    flagged = embedded.drop("probe").withColumns({"light": F.lit(light), "fetched_for": F.lit(fetched_for).cast("string")})
    provides = named.join(good.select("document_id").unionByName(known.select("document_id")).distinct(), "document_id", "left_semi").select(
        F.col("source_id").alias("src"), F.col("document_id").alias("dst"), F.lit("PROVIDES").alias("relation")).distinct()
    rejects = (texts.where("error is not null").select("document_id", "error")
               .unionByName(parsed.where("error is not null").select("document_id", "error")))
    return {"nodes": flagged, "edges": edges.unionByName(provides), "duplicates": duplicates.select("source_id", "document_id"), "rejects": rejects, "vectors": fresh_vectors}


def to_structure(documents: DataFrame, used: DataFrame) -> DataFrame:
    """Light documents that a query other than the one that fetched them has used."""
    pairs = used.select("document_id", F.col("query_id").cast("string").alias("used_by")).distinct()
    return (documents.where("light").join(pairs, "document_id").where(F.col("used_by") != F.coalesce("fetched_for", F.lit("")))
            .select("document_id").distinct())


def page_sources(t) -> DataFrame:
    title = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    return t.pages.select(F.col("page_id").alias("source_key"), F.col("html").alias("content"), F.lit("text/html").alias("mime"), title.alias("title"),
                          F.col("url").alias("uri"), F.lit(None).cast("string").alias("filename"), F.lit("shared").alias("scope"))


PAGE_SQL = r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?(-->|$)', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)\s*>', '', 'gsi') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(h, '<(nav|footer|aside|form|svg|noscript|template)[^>]*>.*?(</(nav|footer|aside|form|svg|noscript|template)\s*>|$)', '', 'gsi') AS h FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '<h1[^>]*>', chr(10) || chr(10) || '# ', 'gi'), '<h2[^>]*>', chr(10) || chr(10) || '## ', 'gi'), '</h[1-6]\s*>', chr(10) || chr(10), 'gi') AS h FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '<(p|div|br|tr|section)([\s/][^>]*)?>', chr(10) || chr(10), 'gi'), '<li([\s/][^>]*)?>', chr(10) || '- ', 'gi'),
  '</?(b|strong)([\s/][^>]*)?>', '**', 'gi') AS h FROM c),
e AS (SELECT page_id, regexp_replace(regexp_replace(h, '</?[A-Za-z][^<>]*>|<![^>]*>', '', 'g'), '</?[A-Za-z][^<>]*$', '') AS h FROM d),
f AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM e)
SELECT page_id, length(text)::INTEGER AS chars, md5(text) AS digest, 0 AS metas, NULL::VARCHAR AS error FROM f"""


@query("page_text", PAGE_SQL)
def _page_text(t):
    rows = t.pages.select("page_id", F.col("html").alias("content"), F.lit("text/html").alias("mime"))
    found = extraction.extract_texts(rows, "page_id")
    return found.select("page_id", F.length("text").alias("chars"), F.md5("text").alias("digest"), F.size("meta").alias("metas"), "error")


@query("chunk_rebuild", r"""SELECT doc_id AS document_id, md5(regexp_replace(text, '\s+', '', 'g')) AS digest FROM documents""")
def _chunks(t):
    from ..sources.conversations import ordered_text
    rows = structure.chunk_table(t.documents.select(F.col("doc_id").alias("document_id"), "text"), 60, 90)
    joined = rows.groupBy("document_id").agg(ordered_text(F.col("n"), F.col("text"), "").alias("text"))
    return joined.select("document_id", F.md5(F.regexp_replace("text", r"\s+", "")).alias("digest"))


@query("document_tree")
def _tree(t):
    parsed = structure.parse_structure(t.documents.select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), "text"), 120, 180, 100)
    nodes, _ = structure.graph_rows(parsed)
    return nodes.groupBy("document_id").agg(F.count_if(F.col("kind") == "Section").alias("sections"), F.count_if(F.col("kind") == "Chunk").alias("chunks"),
                                            F.bool_or("retrieval_leaf").alias("leaf"))


@query("ingest_pages")
def _ingest(t):
    found = ingest(page_sources(t))
    return found["nodes"].groupBy("document_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("image_registration", """WITH i AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN from_hex('89504E470D0A1A0A') WHEN 1 THEN from_hex('FFD8FF') WHEN 2 THEN encode('GIF89a') ELSE encode('%PDF') END || encode(text) AS c FROM documents)
SELECT sha256(c) AS sha256, CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'image/gif' END AS mime_type, octet_length(c) AS bytes FROM i WHERE doc_id % 4 <> 3""")
def _images(t):
    head = F.when(F.col("doc_id") % 4 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(F.col("doc_id") % 4 == 1, F.unhex(F.lit("FFD8FF"))).when(
        F.col("doc_id") % 4 == 2, F.encode(F.lit("GIF89a"), "UTF-8")).otherwise(F.encode(F.lit("%PDF"), "UTF-8"))
    rows = t.documents.select(F.concat(head, F.encode("text", "UTF-8")).alias("content"), F.lit("generated").alias("origin"), F.lit(None).cast("string").alias("url"), F.lit("shared").alias("scope"))
    return media.register_images(rows)[0].select("sha256", "mime_type", F.col("bytes").cast("long").alias("bytes"))


UUID_SQL = "left(d, 8) || '-' || d[9:12] || '-5' || d[14:16] || '-' || substr('89ab', ('0x' || d[17])::INTEGER % 4 + 1, 1) || d[18:20] || '-' || d[21:32]"


@query("recipe_lookup", f"""WITH parts AS (SELECT doc_id, source, lang, chunk, list_transform(range(100 * chunk, least(100 * (chunk + 1), (length(text) + 5999) // 6000)), lambda i: substr(text, 6000 * i + 1, 6000)) AS texts
  FROM documents, unnest(range(0, (length(text) + 599999) // 600000)) AS u(chunk)),
r AS (SELECT doc_id, to_json({{'name': source, 'ingredients_text': [lang], 'instructions': texts, 'yield_servings': 4.0::DOUBLE, 'yield_text': '', 'image_url': ''}})::VARCHAR AS j,
  sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('lorekeep:document:recipe:https://example.org/r/' || doc_id || '/' || chunk)) AS d FROM parts),
t AS (SELECT {UUID_SQL} AS id, unnest(list_filter({WORDS_SQL.format('j')}, lambda x: x NOT IN ({STOP_SQL}))) AS term FROM r),
w AS (SELECT item_id AS query_id, {WORDS_SQL.format('text')} AS w FROM benchmark), k AS (SELECT query_id, w, list_filter(w, lambda x: x NOT IN ({STOP_SQL})) AS kept FROM w),
q AS (SELECT query_id, unnest(CASE WHEN len(kept) > 0 THEN kept ELSE w END) AS term FROM k),
s AS (SELECT query_id, id, count(*) AS shared FROM t JOIN q USING (term) GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id) AS rank FROM s)
SELECT query_id, id, shared, rank FROM p WHERE rank <= 10""")
def _recipes(t):
    """Every document as recipes: its text in instructions of 6,000 characters, the most that one may have, a hundred to a recipe."""
    parts = F.ceil(F.length("text") / 6000).cast("int")
    rows = t.documents.where(F.length("text") > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(parts / 100).cast("int") - 1)))
    cut = F.transform(F.sequence(100 * F.col("chunk"), F.least(100 * (F.col("chunk") + 1), parts) - 1), lambda i: F.substring(F.col("text"), 6000 * i + 1, F.lit(6000)))
    body = F.struct(F.col("source").alias("name"), F.array(F.col("lang")).alias("ingredients_text"), cut.alias("instructions"),
                    F.lit(4.0).alias("yield_servings"), F.lit("").alias("yield_text"), F.lit("").alias("image_url"))
    recipes = rows.select(F.concat(F.lit("https://example.org/r/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("chunk").cast("string")).alias("url"), body.alias("body"))
    nodes, _ = media.recipe_graph(recipes)
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return media.recipe_lookup(queries, nodes.where("kind = 'Document'"), 10)


@query("reembedding", """WITH d AS (SELECT doc_id, text, lang FROM documents), s AS (SELECT doc_id, substr(sha256('m:64:' || text), 1, 24) AS key FROM d WHERE lang = 'en')
SELECT doc_id AS id, substr(sha256('m:64:' || text), 1, 24) AS key FROM d WHERE lang <> 'en'""")
def _reembed(t):
    from ..operators.inference import changed_embeddings
    rows = t.documents.select(F.col("doc_id").alias("id"), "text", "lang")
    stored = rows.where("lang = 'en'").select("id", F.substring(F.sha2(F.concat(F.lit("m:64:"), "text"), 256), 1, 24).alias("key"))
    return changed_embeddings(rows, stored, "m:64").select("id", "key")


@query("cached_embeddings", """SELECT count(*) AS rows, count(DISTINCT text) AS texts FROM documents""")
def _cached(t):
    rows, fresh = embed(t.documents.select("doc_id", "text"))
    return rows.where(F.size("vec") == 64).agg(F.count(F.lit(1)).alias("rows")).withColumn("texts", fresh.agg(F.count(F.lit(1))).scalar())


def embedded_documents(t) -> DataFrame:
    return t.documents.select("doc_id", hash_embedding(F.col("text")).alias("vec"))
