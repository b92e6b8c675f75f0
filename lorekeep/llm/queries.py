"""The registered queries of this subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as vocabulary
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import chat, fingerprints, language, licenses, ngram_join, packing, quality, seekable, sentencepieces, toxicity, turn_repair, turn_trie, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return piece_digests(packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json")))


def piece_digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op1_near_duplicates")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def id_crc(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


@query("op2_language")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    held_out = id_crc(3) == 1
    documents = table(spark, folder, "documents")
    found = language.predict(documents, language.learn_sample(documents.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    held_out = id_crc(5) == 0
    model = toxicity.learn(table(spark, folder, "documents"), table(spark, folder, "labels").where(~held_out))
    found = toxicity.score(table(spark, folder, "documents"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op8_sentencepiece")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    coded = sentencepieces.decode(sentencepieces.encode(table(spark, folder, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op3_quality", quality.SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).drop("failed_rule")


@query("op9_fingerprints")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprints.edited(table(spark, folder, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                        "near_edited", "near_next")


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op6_urls")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), URL_RULES)


CHAT_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length(role) + length(text) + 17 + length(text || role) - length(replace(text || role, '\', ''))
             + list_sum([(length(role) - length(replace(role, k, ''))) // length(k) + (length(text) - length(replace(text, k, ''))) // length(k)
                         for k in ['<|turn|>', '<|end|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<|im_start|>', '<|im_end|>', '<|endoftext|>',
                                   '<|startoftext|>', '<|eot_id|>', '<|start_header_id|>', '<|end_header_id|>', '<unk>', '<pad>', '<bos>', '<eos>']])) AS chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM c
"""


@query("op7_chat", CHAT_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    ok = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(ok).alias("text"))
                                                      for t, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    read = chat.read_back(chat.formatted(chat.chain(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


@query("op4_licenses")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    words, base = F.col("places.word"), F.col("places.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.greatest(F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)), F.when(F.size(words) > 0, 0.5).otherwise(0.0))
    return found.select("doc_id", "n_words", F.size(words).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
                        joined(base).alias("base_labels"), joined(F.concat(base, F.col("detections.label"))).alias("labels"), score.alias("score"))


@query("op11_token_files")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    files = seekable.write(documents, vocabulary("byte_bpe_50k.json"))
    return seekable.read(files, documents.schema["doc_id"].dataType.simpleString()).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: The table of CRC-32 as common table expressions, and the digest of an ASCII text by it.
CRC_TABLE = """bits(i, k, v) AS (
  SELECT range, 0, range::UBIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
crcs AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    return f"""xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({text}, ''), lambda s: ascii(s)::UBIGINT)),
                   lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT"""


TRIE_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
ids AS (
  SELECT c, {crc_sql("c::VARCHAR")} % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), crcs),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), said) AS p, said, chars
  FROM (SELECT conv_id, turn, role, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS said, length(coalesce(text, '')) AS chars
        FROM conversations WHERE conv_id IS NOT NULL)),
rebuilt AS (
  SELECT ids.c, p, said, chars FROM ids JOIN turns ON turns.c = ids.c - ids.c % 100 AND p <= h
  UNION ALL SELECT ids.c, p + 100, said, chars FROM ids JOIN turns ON turns.c = ids.c AND p > h),
rows AS (
  SELECT ids.c, coalesce(list(said ORDER BY p) FILTER (said IS NOT NULL), []) AS s, coalesce(list(chars ORDER BY p) FILTER (said IS NOT NULL), []) AS l
  FROM ids LEFT JOIN rebuilt USING (c) GROUP BY ids.c),
prefixes AS (SELECT c, s, l, unnest(range(0, len(s) + 1)) AS d FROM rows),
members AS (SELECT c, d, array_to_string(s[1:d], '') AS k, s[1:d] AS path, CASE WHEN d > 0 THEN l[d] ELSE 0 END AS chars, len(s) = d AS here FROM prefixes),
nodes AS (
  SELECT d, k, any_value(path) AS path, min(c) AS conv, count(*) AS n, (count(*) - 1) * any_value(chars) AS saves,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (here), '') AS ends, CASE WHEN d > 0 THEN array_to_string(any_value(path)[1:d - 1], '') END AS up
  FROM members GROUP BY d, k),
children AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d, up),
below AS (
  SELECT a.d, a.k, sum(CASE WHEN ch.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(saves) AS saved
  FROM (SELECT nodes.d AS own, nodes.k AS own_key, saves, d2 AS d, array_to_string(path[1:d2], '') AS k FROM nodes, unnest(range(0, nodes.d + 1)) AS u(d2)) a
  LEFT JOIN children ch ON ch.d = a.own AND ch.k = a.own_key GROUP BY a.d, a.k)
SELECT nodes.conv AS conv_id, nodes.d AS depth, p.conv AS parent_conv_id, nodes.n AS n_convs, coalesce(ch.n, 0) AS n_children, below.leaves::BIGINT AS n_leaves,
       below.saved::BIGINT AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN below USING (d, k) LEFT JOIN children ch USING (d, k) LEFT JOIN nodes p ON p.d = nodes.d - 1 AND p.k = nodes.up
"""


@query("op12_turn_trie", TRIE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = turn_trie.trie(turn_trie.regrafted(turn_trie.turns(table(spark, folder, "conversations")), 100, F.crc32(F.col("conv").cast("string")) % 6))
    return found.withColumn("ends_sha256", F.sha2(F.col("ends").cast("binary"), 256)).drop("ends")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, without sentence ends, doubled or given to the user, by the digest of their place."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
                                F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text")).alias("text"),
                                F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _way(state: str, cost: str, letter: str, row: str = "''") -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 's': {state}.s || '{letter}', 'x': {state}.x || {row}}} END"


def _with_inserts(level: str) -> str:
    """The four places of a row of `level` after at most one more insert."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    return f"""* REPLACE (list_min([a2, {", ".join(_way(a, "5", "I", user) for a in ("a0", "a1", "a3"))}]) AS a2, list_min([a3, {_way("a2", "5", "I", assistant)}]) AS a3) FROM {level}"""


_KEEP = {"a1": ("a0", "s"), "a2": ("a0 a1 a3", "u"), "a3": ("a2", "a")}
_ROWS = "chr(10) || {} || ':' || txt"


def _after(place: str) -> str:
    """The best way to a place after one row: deleted, kept or given the role that is needed there."""
    ways = [_way(place, "2", "D")]
    for before in _KEEP.get(place, ("", ""))[0].split():
        ways.append(f"CASE WHEN NOT gone AND role[1] = '{_KEEP[place][1]}' THEN {_way(before, '5 * cut', 'K', _ROWS.format('role'))} END")
        if place in ("a2", "a3"):
            named = {"a2": "'user'", "a3": "'assistant'"}[place]
            ways.append(f"CASE WHEN NOT gone THEN {_way(before, '1 + 5 * cut', 'R', _ROWS.format(named))} END")
    return f"list_min([{', '.join(ways)}])"


#: The same repair as a table over all places: (cost, edits) of each after every row, the least of which is the answer.
REPAIR_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
marked AS (
  SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
         {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crcs),
copied AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt
  FROM marked, unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, txt ORDER BY i) AS nth, rtrim(txt, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid
  FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, txt) AS i FROM copied)),
items AS (
  SELECT c, turn, i, role, txt, solid = '' AS blank, solid <> '' AND nth > 1 AS again, (solid <> '' AND nth = 1 AND right(solid, 1) NOT IN ('.', '!', '?'))::BIGINT AS cut,
         solid = '' OR nth > 1 AS gone, lag(role) OVER (PARTITION BY c ORDER BY i) AS earlier FROM placed),
ways(c, i, a0, a1, a2, a3) AS (
  SELECT c, 0::BIGINT, {{'c': 0::BIGINT, 's': '', 'x': ''}}, NULL::STRUCT(c BIGINT, s VARCHAR, x VARCHAR), NULL::STRUCT(c BIGINT, s VARCHAR, x VARCHAR), NULL::STRUCT(c BIGINT, s VARCHAR, x VARCHAR)
  FROM (SELECT DISTINCT c FROM marked)
  UNION ALL
  SELECT c, i, {_after("a0")}, {_after("a1")}, {_after("a2")}, {_after("a3")}
  FROM (SELECT {_with_inserts(f"(SELECT {_with_inserts('(SELECT w.c, items.i, role, txt, gone, cut, a0, a1, a2, a3 FROM ways w JOIN items ON items.c IS NOT DISTINCT FROM w.c AND items.i = w.i + 1)')})")})),
ends AS (
  SELECT c, list_min([a0, a3]) AS best FROM (SELECT {_with_inserts(f"(SELECT {_with_inserts('(SELECT c, a0, a1, a2, a3 FROM ways QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1)')})")})),
figures AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, sum(cut)::BIGINT AS truncated,
         count(*) FILTER (earlier IS NOT NULL AND left(earlier, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM items GROUP BY c)
SELECT e.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.c AS cost, best.s AS audit, sha256(substr(best.x, 2)) AS repaired_sha256
FROM ends e LEFT JOIN figures f ON f.c IS NOT DISTINCT FROM e.c
"""


@query("op13_turn_repair", REPAIR_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = turn_repair.repair(damaged(table(spark, folder, "conversations")), copies="copies")
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
