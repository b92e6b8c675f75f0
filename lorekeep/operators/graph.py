"""Property-graph tables: merges, validation, neighbourhoods, closures, depths, cycles and provenance.

Edges are (edge_id, src, dst, relation, ...); nodes are (id, kind, label, ..., scope, excluded, origin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, drop_table, is_empty
from .skew import top_per_group

# Which kinds of node a relation may join.
ALLOWED_ENDPOINTS = {
    "PROVIDES": (["Source"], ["Document"]),
    "CONTAINS": (["Document", "Section"], ["Section", "Chunk"]),
    "ABOUT": (["Document", "Section", "Chunk", "Assertion"], ["Concept"]),
    "MENTIONS": (["Document", "Section", "Chunk"], ["Concept"]),
    "BROADER_THAN": (["Concept"], ["Concept"]),
    "RELATED_TO": (["Concept"], ["Concept"]),
    "SEMANTIC_RELATION": (["Concept"], ["Concept"]),
    "HAS_MEMBER": (["TaxonomyGroup"], ["Concept", "TaxonomyGroup"]),
    "EXACT_MATCH": (["Concept"], ["ExternalConcept"]),
    "CLOSE_MATCH": (["Concept"], ["ExternalConcept"]),
    "SUPPORTED_BY": (["Assertion"], ["Document", "Chunk"]),
    "CONTRADICTS": (["Assertion"], ["Assertion"]),
}
HIERARCHY = ["BROADER_THAN", "CONTAINS", "HAS_MEMBER"]  # fixed values: relations that must stay acyclic


# --- Writes ---
def merge_nodes(stored: DataFrame, staged: DataFrame) -> DataFrame:
    """Create-only merge: stored rows win, new ids are added, local concepts unite their aliases."""
    columns = stored.columns
    rows = stored.withColumn("__new", F.lit(False)).unionByName(staged.withColumn("__new", F.lit(True)))
    packed = F.struct(*[F.col(c) for c in columns if c not in ("id", "aliases")])
    # Stored sorts before staged; among staged copies the smallest label decides, so a rerun gives the same row.
    first = rows.groupBy("id").agg(
        F.min_by(packed, F.struct("__new", F.coalesce("label", F.lit("")))).alias("n"),
        F.min_by("aliases", F.struct("__new", F.coalesce("label", F.lit("")))).alias("own"))
    # Repeated aliases fall together before they move, so a concept named by most rows stays small.
    united = (rows.select("id", F.explode("aliases").alias("alias")).distinct()
              .groupBy("id").agg(F.sort_array(F.collect_list("alias")).alias("united")))
    local = (F.col("n.kind") == "Concept") & (F.coalesce(F.col("n.origin"), F.lit("LOCAL")) == "LOCAL")
    return first.join(united, "id", "left").select("id", *[
        F.when(local, F.coalesce("united", "own")).otherwise(F.col("own")).alias(c) if c == "aliases" else F.col(f"n.{c}").alias(c)
        for c in columns if c != "id"])


def upsert(stored: DataFrame, staged: DataFrame, keys: list[str], version: Column, keep_when_null: list[str] = ()) -> DataFrame:
    """Last write wins per key; columns of `keep_when_null` (a vector) keep their last non-null value."""
    columns = [c for c in stored.columns if c not in keys]
    rows = stored.unionByName(staged.select(stored.columns)).withColumn("__v", version)
    kept = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__v"))).alias(c) for c in columns if c in keep_when_null]
    whole = [c for c in columns if c not in keep_when_null]
    merged = rows.groupBy(*keys).agg(F.max_by(F.struct(*whole), F.col("__v")).alias("__row"), *kept)
    return merged.select(*[F.col(k) for k in keys],
                         *[F.col(c) if c in keep_when_null else F.col(f"__row.{c}").alias(c) for c in columns])


def rewrite_nodes(stored: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """New values for existing ids only; a null in `updates` keeps the stored value."""
    changed = [c for c in updates.columns if c != key]
    joined = stored.join(updates.select(key, *[F.col(c).alias(f"__{c}") for c in changed]), key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in stored.columns])


def lookup(nodes: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return nodes.join(ids.select(key), key, "left_semi")


def records_after(records: DataFrame, category: str, prefix: str = "", after: str | None = None) -> DataFrame:
    """Records of one category in key order, from a key prefix and after a cursor; both reach the scan."""
    rows = records.where((F.col("category") == category) & F.col("key").startswith(prefix))
    if after is not None:
        rows = rows.where(F.col("key") > after)
    return rows.orderBy("key")


def delete_records(records: DataFrame, category: str, prefix: str = "") -> DataFrame:
    return records.where(~((F.col("category") == category) & F.col("key").startswith(prefix)))


# --- Filters ---
def visible(scope: Column, excluded: Column, scopes: list[str]) -> Column:
    return scope.isin(scopes) & ~F.coalesce(excluded, F.lit(False))


def content_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Retrieval candidates: no sources or external concepts; imported entries only with content attached."""
    rows = nodes.where(~F.col("kind").isin("Source", "ExternalConcept"))
    local = F.coalesce("origin", F.lit("LOCAL")) == "LOCAL"
    about = edges.where(F.col("relation") == "ABOUT").select(F.col("dst").alias("id"))
    return rows.where(local).unionByName(rows.where(~local).join(about, "id", "left_semi"))


def retrievable(kind: Column, text: Column, leaf: Column) -> Column:
    return (F.length(F.coalesce(text, F.lit(""))) > 0) & ((kind != "Document") | F.coalesce(leaf, F.lit(False)))


def original_sources(provenance: DataFrame) -> DataFrame:
    """Provenance rows whose source is an original one: not generated and with a web address."""
    return provenance.where((F.coalesce("source_type", F.lit("")) != "generated") & ~F.coalesce("generated", F.lit(False))
                            & F.coalesce(F.col("uri").rlike("^https?://"), F.lit(False)))


# --- Validation ---
def edge_rejects(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that may not be stored, with the reason: dangling, wrong endpoint kinds, self links."""
    pairs = [(r, a, b) for r, (left, right) in ALLOWED_ENDPOINTS.items() for a in left for b in right]
    allowed = F.array(*[F.lit(f"{r}|{a}|{b}") for r, a, b in pairs])
    ends = nodes.select("id", "kind", F.coalesce("origin", F.lit("LOCAL")).alias("origin"))
    a = ends.select(F.col("id").alias("src"), F.col("kind").alias("src_kind"), F.col("origin").alias("src_origin"))
    b = ends.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
    joined = edges.join(a, "src", "left").join(b, "dst", "left")
    authority = F.col("authority") if "authority" in edges.columns else F.lit(None).cast("string")
    imported_loop = (F.col("relation") == "RELATED_TO") & (F.col("src_origin") != "LOCAL") & F.coalesce(authority == F.col("src_origin"), F.lit(False))
    reason = (F.when(F.col("src_kind").isNull() | F.col("dst_kind").isNull(), F.lit("dangling"))
              .when(~F.array_contains(allowed, F.concat_ws("|", "relation", "src_kind", "dst_kind")), F.lit("endpoint_kinds"))
              .when((F.col("src") == F.col("dst")) & ~imported_loop, F.lit("self_link")))
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*edges.columns, "reason")


def protected_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links into imported concepts that only an importer may write."""
    origin = nodes.select("id", F.coalesce("origin", F.lit("LOCAL")).alias("origin"))
    guarded = edges.where(F.col("relation").isin("BROADER_THAN", "RELATED_TO", "HAS_MEMBER", "SEMANTIC_RELATION"))
    joined = (guarded.join(origin.select(F.col("id").alias("src"), F.col("origin").alias("__a")), "src", "left")
              .join(origin.select(F.col("id").alias("dst"), F.col("origin").alias("__b")), "dst", "left")
              .fillna("LOCAL", ["__a", "__b"]))
    open_kind = F.col("relation").isin("RELATED_TO", "SEMANTIC_RELATION")
    return joined.where((F.col("__b") != "LOCAL") & (~open_kind | (F.col("__a") != "LOCAL"))).select(edges.columns)


def snapshot_problems(nodes: DataFrame, edges: DataFrame, authority: str) -> DataFrame:
    """Counts of everything a taxonomy snapshot must not hold; all zero when it is sound."""
    if not authority.strip() or authority == "LOCAL" or len(authority) > 80:
        raise ValueError("an authority other than LOCAL, at most 80 characters, is required")
    bad = ~F.col("kind").isin("Concept", "TaxonomyGroup") | (F.col("origin") != authority) | F.col("uri").isNull() | (F.col("uri") == "")
    wrong = nodes.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("n")).select(F.lit("node").alias("problem"), "n")
    ids = nodes.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("duplicate_id").alias("problem"), "n")
    uris = nodes.groupBy("uri").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("duplicate_uri").alias("problem"), "n")
    relations = edges.agg(F.count_if(~F.col("relation").isin("BROADER_THAN", "HAS_MEMBER", "RELATED_TO", "SEMANTIC_RELATION")).alias("n")).select(F.lit("relation").alias("problem"), "n")
    return wrong.unionByName(ids).unionByName(uris).unionByName(relations)


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes left after peeling nodes without a parent again and again: the cycles and everything below them.

    Each round keeps the edges whose source still has a parent, so the work shrinks with the graph and the rounds end
    when nothing more falls away, however deep it is.
    """
    left = edges.select("src", "dst").distinct()
    size = None
    while True:
        left = cut_lineage(left)
        count = left.count()
        if count == 0 or count == size:
            break
        size = count
        left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    return left.select(F.col("dst").alias("id")).distinct()


# --- Neighbourhoods ---
def both_directions(edges: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Every edge seen from both ends as (node, neighbour, ...)."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), *extra)
    back = edges.where(F.col("src") != F.col("dst")).select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), *extra)
    return out.unionByName(back)


def neighbours(edges: DataFrame, asked: DataFrame, limit: int = 100, order: list[Column] | None = None) -> DataFrame:
    """At most `limit` edges per asked node, both directions."""
    extra = [c for c in edges.columns if c not in ("src", "dst")]
    rows = both_directions(edges, extra).join(asked.select("node").distinct(), "node", "left_semi")
    return top_per_group(rows, ["node"], order or [F.col("neighbour")], limit)


def degrees(edges: DataFrame) -> DataFrame:
    return both_directions(edges).groupBy("node").agg(F.count_distinct("neighbour").alias("degree"))


def specificity(degree: Column, fan0: int = 5) -> Column:
    """Fan-out inhibition of generic nodes."""
    return 1 / (1 + F.log(F.greatest(F.lit(1.0), degree / fan0)))


# --- Closures ---
def closure(starts: DataFrame, edges: DataFrame, key: str = "start", max_depth: int | None = None,
            include_self: bool = True, shrink: bool = False, stored: bool = False) -> DataFrame:
    """(key, node, depth): everything reachable from each start along src → dst with its shortest depth.

    Breadth-first, all starts together: a round joins only the newest pairs with the edges, combines duplicates before
    the shuffle and drops pairs seen earlier. Each round is cut, so its inputs are the previous round's files.

    shrink: for many edges in few layers. A round's edges leave from where the last round's edges ended, so the others are dropped
    before it; in a graph without cycles the edges fall away layer by layer.

    stored: the edges are a table already, so they are not written again, and move only in rounds that some of them leave from.
    """
    steps = edges.select("src", "dst") if stored else cut_lineage(edges.select("src", "dst").distinct())  # read again in every round
    heads = cut_lineage(steps.select(F.col("src").alias("node")).distinct()) if stored else None
    frontier = cut_lineage(starts.select(F.col(key), F.col("node")).distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        fresh = (frontier.join(steps, F.col("node") == F.col("src")).select(key, F.col("dst").alias("node")).distinct()
                 .join(seen.select(key, "node"), [key, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        frontier = cut_lineage(fresh)
        if is_empty(frontier):
            break
        seen = seen.unionByName(frontier)
        if stored:
            frontier = cut_lineage(frontier.join(heads, "node", "left_semi"))
            if is_empty(frontier):
                break
        if shrink:
            wider, steps = steps, cut_lineage(following(steps))
            if not stored:
                drop_table(wider)
            if is_empty(steps):
                break
    # The rounds are written, so nothing reads the edges again.
    if not stored:
        drop_table(steps)
    return seen if include_self else seen.where(F.col("depth") > 0)


def following(steps: DataFrame) -> DataFrame:
    """The edges that leave from where another edge of the table ends."""
    return steps.join(steps.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def subtree(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, node, depth) along CONTAINS, the document itself included."""
    return closure(documents.select("document_id", F.col("document_id").alias("node")),
                   edges.where(F.col("relation") == "CONTAINS"), "document_id")


def taxonomy_ancestors(nodes: DataFrame, edges: DataFrame, concepts: DataFrame, authority: str) -> DataFrame:
    """(concept, ancestor) along BROADER_THAN, the concept included, ancestors of one authority only."""
    up = reversed_edges(edges.where(F.col("relation") == "BROADER_THAN").select("src", "dst"))
    found = closure(concepts.select("concept", F.col("concept").alias("node")), up, "concept")
    official = nodes.where((F.col("kind") == "Concept") & (F.col("origin") == authority)).select(F.col("id").alias("node"))
    return found.join(official, "node", "left_semi").select("concept", F.col("node").alias("ancestor"), "depth")


def taxonomy_roots(nodes: DataFrame, edges: DataFrame, authority: str, limit: int = 100) -> DataFrame:
    """Domain groups when there are any, else concepts without a parent."""
    own = nodes.where(F.col("origin") == authority)
    groups = own.where((F.col("kind") == "TaxonomyGroup") & (F.col("group_type") == "domain")).select("id")
    children = edges.where(F.col("relation") == "BROADER_THAN").select(F.col("dst").alias("id"))
    tops = own.where(F.col("kind") == "Concept").select("id").join(children, "id", "left_anti").orderBy("id").limit(limit)
    has_groups = groups.agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    return groups.unionByName(tops.where(~has_groups))


def provenance(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node, ancestor): everything a node's origin runs through — itself, containers and sources above it, and the leaves its
    assertions rest on, to a fixpoint.

    Leaves of one container share all that lies above it, so only the distinct nodes one step from a leaf are closed; what they
    reach is joined back to the leaves.
    """
    up = edges.where(F.col("relation").isin("CONTAINS", "PROVIDES")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = up.unionByName(edges.where(F.col("relation") == "SUPPORTED_BY").select("src", "dst"))
    steps = cut_lineage(steps)
    own = leaves.select(F.col("id").alias("node")).distinct()
    # Dealt by the leaf alone, so that its steps are made distinct and counted where they are joined.
    first = own.join(steps, F.col("node") == F.col("src")).select("node", F.col("dst").alias("via")).distinct()
    first = cut_lineage(first.withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("node")) > 1))
    # Of the edges only those above a first step are climbed: a leaf's own edges, mostly the most of all, stay behind.
    above = closure(first.select(F.col("via"), F.col("via").alias("node")), following(steps), "via", shrink=True).select("via", F.col("node").alias("ancestor"))
    drop_table(steps)  # what follows reads the first steps and the closure, both written
    # One step reaches each ancestor once; only what leaves of several steps reach has to be compared.
    reached = first.join(above, "via").where(~F.col("node").eqNullSafe(F.col("ancestor")))
    return (own.select("node", F.col("node").alias("ancestor")).unionByName(reached.where("not several").select("node", "ancestor"))
            .unionByName(reached.where("several").select("node", "ancestor").distinct()))


def section_paths(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node, path): the containers of each leaf, outermost first; a leaf in several containers has a row for each way up, one in none an empty path.

    Pointer doubling over the containers alone: in every round a container's known stretch is joined with the stretch of its topmost node,
    so a tree of depth d takes log2(d) rounds. A way up that would enter a node again ends below that node.
    """
    none = F.array().cast("array<string>")
    links = edges.where((F.col("relation") == "CONTAINS") & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("node"), F.col("src").alias("top"))
    links = cut_lineage(links.repartition("node").distinct())  # dealt by the node alone, as the joins want it
    inner = links.select(F.col("top").alias("node")).distinct()
    hops = cut_lineage(links.join(inner, "node", "left_semi").withColumn("path", F.array("top")).withColumn("ended", F.lit(False)))
    done = hops.limit(0)
    while not is_empty(hops):
        stretches = hops.unionByName(done).select(F.col("node").alias("top"), F.col("top").alias("__top"), F.col("path").alias("__path"), F.col("ended").alias("__ended"))
        above = F.coalesce("__path", none)
        # Bound first: inside a lambda the new column `path` would stand for the old one.
        grown = hops.drop("ended").join(stretches, "top", "left").withColumn("__again", _last_known(above, F.concat("path", F.array("node"))))
        grown = grown.select("node", F.coalesce("__top", "top").alias("top"), F.concat(_after(above, F.col("__again")), "path").alias("path"),
                             (F.coalesce("__ended", F.lit(True)) | (F.col("__again") > 0)).alias("ended"))
        grown = cut_lineage(grown.distinct())
        done, hops = done.unionByName(grown.where("ended")), grown.where("not ended")
    near = F.when(F.col("top").isNull(), none).otherwise(F.array("top"))
    outer = F.coalesce("__path", none)
    placed = leaves.select(F.col("id").alias("node")).distinct().join(links, "node", "left").join(done.select(F.col("node").alias("top"), F.col("path").alias("__path")), "top", "left")
    return placed.select("node", F.concat(_after(outer, _last_known(outer, F.concat(near, F.array("node")))), near).alias("path")).distinct()


def _last_known(path: Column, known: Column) -> Column:
    """Position (from 1) of the last entry of `path` that stands in `known`, else 0."""
    return F.coalesce(F.array_max(F.transform(path, lambda x, i: F.when(F.array_contains(known, x), i + 1).otherwise(0))), F.lit(0))


def _after(path: Column, position: Column) -> Column:
    return F.slice(path, position + 1, F.size(path) - position)


def contradicted(edges: DataFrame, leaves: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(node, path, other, other_path): each leaf with a leaf it contradicts, either way round, and where both stand.

    paths: the section paths of both sides where they are known already.
    """
    pairs = contradictions(edges).select("node", F.col("neighbour").alias("other")).where("node <> other")
    both = cut_lineage(pairs.join(leaves.select(F.col("id").alias("node")).distinct(), "node", "left_semi"))
    if paths is None:
        ends = both.select(F.col("node").alias("id")).unionByName(both.select(F.col("other").alias("id")))
        paths = cut_lineage(section_paths(edges, ends))
    return both.join(paths, "node").join(paths.select(F.col("node").alias("other"), F.col("path").alias("other_path")), "other").select("node", "path", "other", "other_path")


def contradictions(edges: DataFrame) -> DataFrame:
    return both_directions(edges.where(F.col("relation") == "CONTRADICTS")).distinct()


def documents_from(nodes: DataFrame, edges: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, document) for addresses whose sources provide documents."""
    sources = nodes.where(F.col("kind") == "Source").select(F.col("id").alias("src"), F.col("uri").alias("url"))
    return (sources.join(urls.select("url").distinct(), "url", "left_semi")
            .join(edges.where(F.col("relation") == "PROVIDES").select("src", "dst"), "src")
            .select("url", F.col("dst").alias("document_id")).distinct())


# --- Deletes and visibility changes ---
def deletion_closure(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Ids a hard delete removes: the subtrees, assertions resting on them, sources that provide nothing else.

    edges: a stored table, as they are read several times. The documents share one start, as it does not matter here whose subtree a node is in.
    """
    contains = edges.where(F.col("relation") == "CONTAINS")
    inside = closure(documents.select(F.lit(0).alias("start"), F.col("document_id").alias("node")), contains, stored=True).select(F.col("node").alias("id"))
    gone_ids = inside.select(F.col("id").alias("dst"))
    assertions = edges.where(F.col("relation") == "SUPPORTED_BY").join(gone_ids, "dst", "left_semi").select(F.col("src").alias("id"))
    provides = edges.where(F.col("relation") == "PROVIDES").select("src", "dst")
    marked = provides.join(documents.select(F.col("document_id").alias("dst"), F.lit(True).alias("__gone")).distinct(), "dst", "left")
    # A source goes when all it provides goes; repeated edges change nothing.
    sources = marked.groupBy("src").agg(F.bool_and(F.coalesce("__gone", F.lit(False))).alias("gone")).where("gone").select(F.col("src").alias("id"))
    return cut_lineage(inside.unionByName(assertions).unionByName(sources).distinct())  # dropped by both ends of an edge


def drop_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = nodes.join(ids.select("id"), "id", "left_anti")
    links = (edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti")
             .join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select(edges.columns))
    return kept, links


def set_excluded(nodes: DataFrame, edges: DataFrame, documents: DataFrame, excluded: bool = True) -> DataFrame:
    """Soft forget or restore: the flag of the documents' whole subtrees."""
    inside = subtree(edges, documents).select(F.col("node").alias("id"), F.lit(excluded).alias("excluded")).distinct()
    return rewrite_nodes(nodes, inside)


def erase_scope(table: DataFrame, scope: str) -> DataFrame:
    if scope == "shared":
        raise ValueError("the shared memory cannot be erased as a scope")
    return table.where(F.col("scope") != scope)


def stale_embeddings(nodes: DataFrame, dimensions: int) -> DataFrame:
    return nodes.where((F.size("embedding") > 0) & (F.size("embedding") != dimensions))


def kahn_layers(items: DataFrame, parents: DataFrame) -> DataFrame:
    """(document_id, label, layer): parents named in the same document come first; a cyclic remainder is one layer."""
    left = cut_lineage(items.select("document_id", "label").distinct())
    done, layer = None, 0
    while not is_empty(left):
        waiting = (parents.join(left.select("document_id", F.col("label").alias("parent")), ["document_id", "parent"], "left_semi")
                   .where(F.col("parent") != F.col("label")).select("document_id", "label").distinct())
        blocked = cut_lineage(left.join(waiting, ["document_id", "label"], "left_semi"))
        ready = left.join(blocked, ["document_id", "label"], "left_anti")
        # Documents whose remainder is a cycle have no ready item: their remainder forms the last layer.
        stuck = blocked.join(ready.select("document_id").distinct(), "document_id", "left_anti")
        out = cut_lineage(ready.unionByName(stuck).withColumn("layer", F.lit(layer)))
        done = out if done is None else done.unionByName(out)
        left = cut_lineage(blocked.join(stuck, ["document_id", "label"], "left_anti"))
        layer += 1
    return done if done is not None else items.select("document_id", "label").withColumn("layer", F.lit(0)).limit(0)


def node_projection(nodes: DataFrame) -> DataFrame:
    """Stored projection: folded label and alias keys, the exclusion flag, no vector."""
    from ..functions.text import casefold
    return nodes.drop("embedding").withColumns({
        "label_key": casefold(F.col("label")),
        "alias_keys": F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a)),
        "excluded": F.coalesce("excluded", F.lit(False))})


def previews(nodes: DataFrame, excerpt_tokens: int = 80, compact: bool = False) -> DataFrame:
    """What a navigation decision reads of a node; the compact form is what traces keep."""
    from ..functions.text import truncate_tokens
    leaf = F.col("kind").isin("Chunk", "Assertion") | ((F.col("kind") == "Document") & F.coalesce("retrieval_leaf", F.lit(False)))
    excerpt = F.when(leaf & (F.length("text") > 0), truncate_tokens(F.col("text"), excerpt_tokens))
    return nodes.select(
        F.col("id").alias("node_id"), "label", "kind", "origin",
        (F.substring("routing_summary", 1, 300) if compact else F.col("routing_summary")).alias("routing_summary"),
        (F.slice("aliases", 1, 5) if compact else F.col("aliases")).alias("aliases"),
        retrievable(F.col("kind"), F.col("text"), F.col("retrieval_leaf")).alias("retrievable"),
        (F.substring(excerpt, 1, 300) if compact else excerpt).alias("excerpt"))
