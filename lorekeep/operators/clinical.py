"""Clinical records over a terminology: term resolution, expansion, patient facts, headers and applicability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import norm, norm_words
from ..sources.taxonomies import IS_A
from ..session import cut_lineage
from .graph import closure

# Semantic tags that stand for one another.
TAG_GROUPS = [
    ["disorder", "finding", "situation", "morphologic abnormality"],
    ["substance", "product", "medicinal product", "medicinal product form", "clinical drug"],
    ["procedure", "regime/therapy"], ["organism"], ["body structure"], ["physical object"], ["observable entity"],
    ["qualifier value"], ["specimen"],
]
# How far a condition's state lets a recommendation apply.
STATE_FACTORS = {"met": 1.0, "text": 0.9, "possible": 0.6, "unknown": 0.35, "unmet": 0.2, "absent": 0.05}


def tag_group(tag: Column) -> Column:
    """The group a tag belongs to, the tag itself when it has none."""
    chain = tag
    for i, group in enumerate(TAG_GROUPS):
        chain = F.when(tag.isin(group), F.lit(f"#{i}")).otherwise(chain)
    return chain


def resolve_terms(mentions: DataFrame, terms: DataFrame, concepts: DataFrame, overlap: float = 0.6) -> DataFrame:
    """(mention_id, code): the concept a term names.

    Exact normalised synonyms first, tag-compatible ones preferred, the full name and then the deeper concept winning;
    else the terms sharing at least `overlap` of the words, tag-compatible only, the closest and then the shallower
    winning. Equal wordings are compared once, on both sides. Fuzzy matches meet on a wording's rarest words: two word
    sets with that overlap share one of the rarest (1 - overlap) + 1 words of either, so common words rarely join.
    """
    known = concepts.select(F.col("id").alias("concept"), tag_group(F.coalesce("tag", F.lit(""))).alias("group"), "depth")
    asked = mentions.select("mention_id", norm(F.col("term")).alias("norm"), tag_group(F.coalesce("tag", F.lit(""))).alias("wanted")).where("norm <> ''")
    # One row per wording and tag group: its best concept for an exact and for a fuzzy match.
    wordings = (terms.select("norm", "concept", "fsn").join(known, "concept").groupBy("norm", "group").agg(
        F.max(F.struct("fsn", "depth", "concept")).alias("exact"), F.max(F.struct((-F.col("depth")).alias("near"), "concept")).alias("fuzzy")))
    wordings = cut_lineage(wordings)
    wanted = cut_lineage(asked.select("norm", "wanted").distinct())
    fits = (F.col("wanted") == "") | (F.col("group") == F.col("wanted"))
    best = wanted.join(wordings, "norm").groupBy("norm", "wanted").agg(F.max_by("exact.concept", F.struct(fits, "exact")).alias("code"))

    rest = wanted.join(best.select("norm", "wanted"), ["norm", "wanted"], "left_anti")
    words = F.array_distinct(F.split("norm", " "))
    known_words = wordings.select("norm").distinct().withColumn("words", words)
    frequency = known_words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def rarest(rows, key):
        """|A∩B| ≥ t·|A|, so leaving out the ⌈t·|A|⌉ - 1 most common words of A still hits a shared one."""
        listed = rows.select(key, F.size("words").alias("size"), F.explode("words").alias("word")).join(frequency, "word", "left").fillna(0, ["df"])
        order = Window.partitionBy(key).orderBy("df", "word")
        kept = listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("size") - F.ceil(F.lit(overlap) * F.col("size")) + 1)
        return kept.select(key, "word", "size")

    open_words = rest.select("norm").distinct().withColumn("words", words).withColumnRenamed("norm", "mine")
    left, right = rarest(open_words, "mine"), rarest(known_words, "norm")
    pairs = (left.withColumnRenamed("size", "my_size").join(right, "word")
             .where((F.least("size", "my_size") >= F.lit(overlap) * F.greatest("size", "my_size"))).select("mine", "norm").distinct())
    mine, theirs = F.array_distinct(F.split("mine", " ")), F.array_distinct(F.split("norm", " "))
    near = pairs.withColumn("overlap", F.size(F.array_intersect(mine, theirs)) / F.size(F.array_union(mine, theirs))).where(F.col("overlap") >= overlap)
    scored = near.join(wordings, "norm").join(rest.select(F.col("norm").alias("mine"), "wanted"), "mine").where(fits)
    fuzzy = scored.groupBy(F.col("mine").alias("norm"), "wanted").agg(F.max_by("fuzzy.concept", F.struct("overlap", "fuzzy")).alias("code"))
    return asked.join(best.unionByName(fuzzy), ["norm", "wanted"]).select("mention_id", "code")


def coded_mentions(mentions: DataFrame, resolved: DataFrame, concepts: DataFrame) -> DataFrame:
    """Adds key (`sct:code` or `txt:words`), and the concept's tag when resolved; terms without words fall away."""
    rows = mentions.join(resolved, "mention_id", "left").join(concepts.select(F.col("id").alias("code"), F.col("tag").alias("__tag")), "code", "left")
    text = norm(F.col("term"))
    key = F.when(F.col("code").isNotNull(), F.concat(F.lit("sct:"), "code")).when(text != "", F.concat(F.lit("txt:"), text))
    return rows.withColumn("key", key).withColumn("tag", F.coalesce("__tag", "tag")).drop("__tag").where(F.col("key").isNotNull())


def ancestor_closure(relations: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, ancestor): each code with itself and everything it is a kind of."""
    up = relations.where(F.col("type") == IS_A).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return closure(codes.select("code", F.col("code").alias("node")), up, "code").select("code", F.col("node").alias("ancestor"))


def expansion_links(codes: DataFrame, relations: DataFrame, concepts: DataFrame, weights: dict, levels: int = 3, min_depth: int = 4) -> DataFrame:
    """(src, dst, kind) of recorded concepts' neighbourhood: is-a up to `levels`, weighted attributes from the concept
    itself only; targets nearer the root than `min_depth` are too generic."""
    live = [k[4:] for k, w in weights.items() if k.startswith("sct:") and w > 0]
    usable = relations.where(F.col("type").isin(live)).join(concepts.where(F.col("depth") >= min_depth).select(F.col("id").alias("target")), "target", "left_semi")
    frontier, out = codes.select(F.col("code").alias("source")).distinct(), None
    for level in range(levels):
        step = usable if level == 0 else usable.where(F.col("type") == IS_A)
        found = step.join(frontier, "source", "left_semi").select("source", "type", "target").distinct()
        out = found if out is None else out.unionByName(found)
        frontier = found.where(F.col("type") == IS_A).select(F.col("target").alias("source")).distinct()
    def node(c):
        return F.concat(F.lit("e:sct:"), c)
    return out.distinct().select(node(F.col("source")).alias("src"), node(F.col("target")).alias("dst"), F.concat(F.lit("sct:"), "type").alias("kind"))


def own_statements(memories: DataFrame) -> DataFrame:
    """What the record says about the patient: no guideline, no generated text, nobody else."""
    return memories.where(~F.col("source").isin("guideline", "ai") & (F.col("subject") == "patient"))


def code_of(key: str) -> Column:
    """What follows the four characters of a key's system mark, whole."""
    return F.substring(key, F.lit(5), F.length(key))


def patient_facts(memories: DataFrame, relations: DataFrame) -> DataFrame:
    """(patient, state, code): present and possible codes with their ancestors, absent codes as recorded.

    memories: patient, memory_id, text, state, subject, source, concepts array<struct<key,term,tag>>.
    """
    coded = (own_statements(memories).where(F.col("state").isin("present", "possible", "absent"))
             .select("patient", "state", F.explode("concepts").alias("c")).where(F.col("c.key").startswith("sct:")).select("patient", "state", code_of("c.key").alias("code")))
    up = ancestor_closure(relations, coded.where("state <> 'absent'").select("code").distinct())
    # Rows meet their ancestors as they are read and are made distinct once, behind that.
    above = up.groupBy("code").agg(F.collect_list("ancestor").alias("above"))
    closed = F.when(F.col("state") == "absent", F.array("code")).otherwise(F.col("above"))
    return coded.join(above, "code", "left").select("patient", "state", F.explode(closed).alias("code")).distinct()


def applicability(recommendations: DataFrame, patients: DataFrame, facts: DataFrame, memories: DataFrame) -> DataFrame:
    """(patient, rec_id, factor, met, possible, unverified, not_met, excluded_by).

    recommendations: rec_id, conditions, exclusions (array<struct<key,term>>); patients: (patient, rec_id) pairs to judge.
    An exclusion that holds makes the factor 0; else it is the product over the conditions of their states' factors.
    """
    empty = F.array().cast("array<struct<key:string,term:string>>")
    def parts(column, role):
        items = F.transform(F.coalesce(column, empty), lambda c, i: F.struct(c["key"].alias("key"), c["term"].alias("term"), i.alias("n")))
        return recommendations.select("rec_id", F.lit(role).alias("role"), F.explode(items).alias("c")).select("rec_id", "role", "c.key", "c.term", "c.n")
    wanted = parts("conditions", "condition").unionByName(parts("exclusions", "exclusion")).where(F.col("key").isNotNull())
    coded = F.col("key").startswith("sct:")
    # Only what a recommendation names is kept of a patient's facts.
    named = facts.select("patient", "state", F.concat(F.lit("sct:"), "code").alias("key")).join(wanted.select("key").distinct(), "key", "left_semi")
    strongest = F.min(F.when(F.col("state") == "present", 0).when(F.col("state") == "absent", 1).when(F.col("state") == "possible", 2))
    states = named.groupBy("patient", "key").agg(strongest.alias("s")).where("s is not null").select(
        "patient", "key", F.element_at(F.array(F.lit("met"), F.lit("absent"), F.lit("possible")), F.col("s") + 1).alias("state"))

    # A free-text item holds when one present finding has all its words: count shared words per (finding, item).
    free = wanted.where(~coded).withColumn("words", F.array_distinct(F.filter(F.split(code_of("key"), " "), lambda w: w != "")))
    terms_ = free.select("rec_id", "key", F.size("words").alias("size"), F.explode("words").alias("word"))
    findings = (own_statements(memories).where("state = 'present'").select("patient", "memory_id", F.explode(F.array_distinct(norm_words(F.col("text")))).alias("word"))
                .join(terms_.select("word").distinct(), "word", "left_semi"))
    sought = patients.join(terms_, "rec_id").select("patient", "key", "size", "word").distinct()
    held = (sought.join(findings, ["patient", "word"]).groupBy("patient", "key", "size", "memory_id").agg(F.count(F.lit(1)).alias("n"))
            .where("n = size").select("patient", "key", F.lit("text").alias("state")).distinct())

    # A patient's states of the named items in one row, beside the items of each recommendation: pairs are judged where they meet, no item travels.
    known = states.unionByName(held).groupBy("patient").agg(F.map_from_entries(F.collect_list(F.struct("key", "state"))).alias("__known"))
    items = wanted.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("n", "term", "key", "role"))).alias("__items"))
    rows = patients.join(items, "rec_id", "left").join(known, "patient", "left")
    none = F.array().cast("array<string>")
    def state_of(c):
        return F.coalesce(F.element_at("__known", c["key"]), F.when(c["key"].startswith("sct:"), "unmet").otherwise("unknown"))
    asked = F.when(F.col("patient").isNotNull(), F.transform("__items", lambda c: F.struct(c["role"].alias("role"), c["term"].alias("term"), state_of(c).alias("state"))))
    rows = rows.select("patient", "rec_id", F.coalesce(asked, F.array().cast("array<struct<role:string,term:string,state:string>>")).alias("__asked"))
    def terms_of(states_, role="condition"):
        return F.transform(F.filter("__asked", lambda c: (c["role"] == role) & c["state"].isin(states_)), lambda c: c["term"])
    table = F.create_map(*[F.lit(x) for pair in STATE_FACTORS.items() for x in pair])
    conditions = F.filter("__asked", lambda c: c["role"] == "condition")
    product = F.aggregate(conditions, F.lit(1.0), lambda p, c: p * F.element_at(table, c["state"]))
    rows = rows.withColumn("excluded_by", terms_of(["met", "text"], "exclusion"))
    excluded = F.size("excluded_by") > 0
    factor = F.when(excluded, 0.0).when(F.size(conditions) == 0, STATE_FACTORS["unknown"]).otherwise(product)
    def shown(states_, name):
        return F.when(excluded, none).otherwise(terms_of(states_)).alias(name)
    return rows.select("patient", "rec_id", factor.alias("factor"), shown(["met", "text"], "met"), shown(["possible"], "possible"), shown(["unknown"], "unverified"),
                       shown(["unmet", "absent"], "not_met"), "excluded_by")


def header_slots(memories: DataFrame, relations: DataFrame, allergy_roots: list[str], header_codes: list[str]) -> DataFrame:
    """Adds `slot` to the patient's statements: a stored one, else allergies, results or problems by their concepts."""
    rows = memories.where((F.col("source") != "ai") & (F.col("subject") == "patient") & F.col("state").isin("present", "possible"))
    # What lies below the roots is fewer than what lies above all recorded codes.
    listed = F.array(*[F.lit(r) for r in allergy_roots]).cast("array<string>")
    roots = relations.sparkSession.range(1).select(F.explode(listed).alias("root")).withColumn("node", F.col("root"))
    down = relations.where(F.col("type") == IS_A).select(F.col("target").alias("src"), F.col("source").alias("dst"))
    allergic = closure(roots, down, "root").select(F.concat(F.lit("sct:"), "node").alias("key")).distinct()
    flagged = (rows.select("memory_id", F.explode("concepts").alias("c")).select("memory_id", F.col("c.key").alias("key"))
               .join(allergic, "key", "left_semi").select("memory_id").distinct().withColumn("__allergy", F.lit(True)))
    disorder = F.exists("concepts", lambda c: c["tag"] == "disorder")
    result = F.exists("concepts", lambda c: c["key"].isin(header_codes or [""]))
    slot = F.coalesce("header", F.when(F.col("__allergy"), F.lit("allergies")).when(disorder, F.lit("problems")).when(result, F.lit("results")))
    return rows.join(flagged, "memory_id", "left").withColumn("slot", slot).drop("__allergy").where(
        F.col("slot").isNotNull() & ((F.col("state") != "possible") | (F.col("slot") == "problems")))


def patient_header(slots: DataFrame, header_codes: list[str]) -> DataFrame:
    """(patient, slot, item, ...): every allergy and medication, the latest statement per problem and per result code."""
    def first_key(test):
        return F.get(F.transform(F.filter("concepts", test), lambda c: c["key"]), 0)
    item = F.when(F.col("slot") == "results", F.coalesce(first_key(lambda c: c["key"].isin(header_codes or [""])), F.col("memory_id"))).when(
        F.col("slot") == "problems", F.coalesce(first_key(lambda c: c["tag"] == "disorder"), F.col("memory_id"))).otherwise(F.col("memory_id"))
    latest = F.struct("doc_date", "memory_id")
    return slots.withColumn("item", item).groupBy("patient", "slot", "item").agg(
        F.max_by(F.struct("memory_id", "text", "date", "source", "state"), latest).alias("m")).select("patient", "slot", "item", "m.*")


def quarantined_answers(answers: DataFrame, question_chars: int = 150, text_chars: int = 600) -> DataFrame:
    """Generated answers as memories: hypothetical, half confidence, source `ai`, without concepts.

    `text` is the preview such memories are shown by, cut as the parameters say; question and answer stay whole beside it.
    """
    text = F.substring(F.concat(F.lit('AI suggestion to "'), F.substring("question", 1, question_chars), F.lit('": '), "answer"), 1, text_chars)
    return answers.select("patient", F.concat(F.col("answer_id"), F.lit(":0")).alias("memory_id"), text.alias("text"), "question", "answer", F.lit("hypothetical").alias("state"),
                          F.lit("patient").alias("subject"), F.col("day").alias("date"), F.lit(0.5).alias("confidence"), F.lit("ai").alias("source"),
                          F.array().cast("array<struct<key:string,term:string,tag:string>>").alias("concepts"))
