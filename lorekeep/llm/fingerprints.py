"""Order MinHash fingerprints of documents, in DataFrame functions only.

A text is cut into tokens (runs of non-blank characters, at most `TOKEN` long; longer runs are cut where the content says, see `cuts`), its k-mers are runs of `K` tokens, and a
k-mer that occurs again is numbered, so that all elements differ. Element hashes fall into `BINS` bins by their leading
bits; in every bin the `PICK` smallest elements are taken, put back into text order and hashed together. A signature so
changes when its elements swap places, which makes the likeness follow the edit distance rather than set overlap. The
fingerprint lists the signatures of the bins that hold elements; the likeness of two texts is the share of equal
signatures among the bins that either fills.

Per text the work is a few array functions with one primitive sort; nothing is exploded. A hash and a place share one
64-bit sort key (`PLACE_BITS` bits for the place), so beyond 2**25 tokens places repeat; fingerprints of equal texts
stay equal. A run longer than `TOKEN` is held character by character while it is cut, some 100 bytes each.

For each document `edited` also gets the text with its second half replaced by the start of the next document in
descending id order. That order is made by id ranges: quantiles of the ids cut the table into many parts of about
`PART_ROWS` rows, a window runs inside each part, and each part gets a copy of the next part's first row.

Cases: a null or empty text has an empty fingerprint, alike (1) only to another empty one; a text of fewer than `K` tokens
is one k-mer; equal ids follow each other by a hash of the text; rows without an id come after all others; a single row is
its own next; repeated rows get equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let

TOKEN = 16
#: A place in a longer run is a cut if its pair of letters has a smaller hash than the pairs at this many places on either side.
REACH = 4
K = 3
BINS = 64
PICK = 2
PLACE_BITS = 25
PART_ROWS = 1_000
MOST_PARTS = 10_000
PLACE = (1 << PLACE_BITS) - 1


def _next(array: str, i: Column) -> Column:
    return F.get(array, (i + 1).cast("int"))


def _starts(array: str, key) -> Column:
    """Positions in a sorted array at which `key` of the element changes."""
    return F.filter(F.sequence(F.lit(0), F.size(array) - 1), lambda i: (i == 0) | (key(F.get(array, i)) != key(F.get(array, i - 1))))


def cuts(run: Column) -> Column:
    """The tokens of a run longer than `TOKEN`, as in text without blanks: cut where a pair of letters has the smallest hash around, so that an
    inserted letter moves only the cuts next to it; what is longer still, as one letter repeated, is cut every `TOKEN` characters."""
    def tokens(letters: Column) -> Column:
        pairs = F.transform(letters, lambda x, i: F.xxhash64(x, F.get(letters, i + 1)))
        around = [j for j in range(-REACH, REACH + 1) if j]
        return let(pairs, lambda h: let(F.concat(
            F.array(F.lit(0)), F.transform(F.filter(F.sequence(F.lit(REACH), F.size(letters) - 2 - REACH), lambda i: F.get(h, i) < F.least(*[F.get(h, i + j) for j in around])),
                                           lambda i: i + 1), F.array(F.size(letters))), lambda ends: pieces(letters, ends)))

    def pieces(letters: Column, ends: Column) -> Column:
        spans = F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda start, i: F.struct(start.alias("start"), F.get(ends, i + 1).alias("end")))
        return F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(s["start"], s["end"] - 1, F.lit(TOKEN)), lambda at: F.array_join(
            F.slice(letters, at + 1, F.least(F.lit(TOKEN), s["end"] - at)), ""))))

    return let(F.split(run, ""), tokens)


def sketched(rows: DataFrame, text_column: str, name: str) -> DataFrame:
    """`rows` with an array column `name`: a number per filled bin, the bin in its upper half, the signature in the lower."""
    tokens, runs, order, starts, elements, heads = (f"__{name}_{x}" for x in ("tokens", "runs", "order", "starts", "elements", "heads"))
    cut = rows.withColumn(tokens, F.regexp_extract_all(F.coalesce(F.col(text_column), F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % TOKEN), F.lit(0)))
    whole = F.regexp_extract_all(F.col(text_column), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = cut.withColumn(tokens, F.when(F.exists(tokens, lambda x: F.length(x) == TOKEN), F.flatten(F.transform(
        whole, lambda run: F.when(F.length(run) > TOKEN, cuts(run)).otherwise(F.array(run))))).otherwise(F.col(tokens)))
    kmers = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - K, F.lit(0))),
                        lambda i: F.xxhash64(*[F.coalesce(F.get(tokens, i + j), F.lit("")) for j in range(K)]))
    hashed = cut.withColumn(runs, F.when(F.size(tokens) > 0, kmers).otherwise(F.array().cast("array<bigint>"))).drop(tokens)
    keyed = F.sort_array(F.transform(runs, lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("bigint"))))
    sorted_runs = hashed.withColumn(order, keyed).withColumn(starts, F.when(F.size(runs) > 0, _starts(order, lambda x: F.shiftright(x, PLACE_BITS))))

    def element(key: Column, number: Column) -> Column:
        mixed = F.xxhash64(F.shiftright(key, PLACE_BITS), number)
        return mixed.bitwiseAND(F.lit(~PLACE)).bitwiseOR(key.bitwiseAND(F.lit(PLACE)))

    numbered = F.when(F.size(starts) == F.size(order), F.transform(order, lambda x: element(x, F.lit(0)))).otherwise(F.flatten(F.transform(
        starts, lambda s, r: F.transform(F.slice(order, s + 1, F.coalesce(_next(starts, r), F.size(order)) - s), lambda x, n: element(x, n)))))
    chosen = sorted_runs.withColumn(elements, F.sort_array(numbered)).drop(runs, order, starts)
    # The leading bits name the bin, so a bin's elements stand together, the smallest first.
    bin_of = lambda x: F.shiftright(x, 64 - BINS.bit_length() + 1)
    headed = chosen.withColumn(heads, F.when(F.size(elements) > 0, _starts(elements, bin_of)))

    def signature(start: Column, r: Column) -> Column:
        many = F.least(F.lit(PICK), F.coalesce(_next(heads, r), F.size(elements)) - start)
        picked = F.transform(F.slice(elements, start + 1, many), lambda x: F.struct(x.bitwiseAND(F.lit(PLACE)).alias("p"), F.shiftright(x, PLACE_BITS).alias("h")))
        joined = F.xxhash64(F.transform(F.array_sort(picked), lambda x: x["h"]))
        return F.shiftleft(bin_of(F.get(elements, start)) + BINS // 2, 32).bitwiseOR(joined.bitwiseAND(F.lit(0xFFFFFFFF)))

    return headed.withColumn(name, F.coalesce(F.transform(heads, signature), F.array().cast("array<bigint>"))).drop(elements, heads)


def printed(sketch: str) -> Column:
    """A fingerprint as text: hexadecimal bin and signature of each filled bin."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "-")


def likeness(a: str, b: str) -> Column:
    """The share of equal signatures among the bins that either text fills; 1 for two empty fingerprints."""
    bins = lambda c: F.transform(c, lambda x: F.shiftright(x, 32))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / filled, 6))


def followed(rows: DataFrame, key: str, tie: str, carried: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """`rows` with `next_<column>` for each carried column: that of the next row by `key` descending (then `tie`), the first
    row's after the last. Rows without a key come last."""
    total = rows.count()
    parts = min(MOST_PARTS, max(1, total // part_rows))
    cuts = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    bounds = sorted(set(cuts or []))
    # Parts count downwards with the key, so that they stand in the order of the rows; missing keys make the last part.
    part = F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(
        len(bounds) - F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b <= F.col(key))))
    placed = rows.withColumn("__part", part).withColumn("__copy", F.lit(0))
    order = [F.col(key).desc_nulls_last(), F.col(tie).desc()]
    # The first row of each part, at most MOST_PARTS rows of an id and a hash.
    heads = placed.groupBy("__part").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(tie).alias("t")), F.struct(F.coalesce(F.col(key), F.lit(0)), F.col(tie))).alias("h"))
    before = F.lag("__part").over(Window.orderBy("__part"))
    last = F.max("__part").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("h", F.coalesce(before, last).alias("__to"))
    copies = (placed.join(F.broadcast(heads), F.col(key).eqNullSafe(F.col("h.k")) & (F.col(tie) == F.col("h.t")))
              .withColumn("__part", F.col("__to")).withColumn("__copy", F.lit(1)).select(placed.columns)
              .dropDuplicates(["__part", key, tie]))
    inside = Window.partitionBy("__part").orderBy("__copy", *order)
    led = placed.unionByName(copies).select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in carried])
    return led.where("__copy = 0").drop("__part", "__copy")


def edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """Per row: the id, n_chars, `edited` (the edited text), `fingerprint`, `edited_fingerprint`, `near_edited` and `near_next`."""
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    led = followed(sketched(rows, "text", "sketch"), "id", "tie", ["text", "sketch"], part_rows)
    half = F.floor(F.length("text") / 2).cast("int")
    changed = led.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    changed = sketched(changed.withColumn("n_chars", F.length("text").cast("long")).drop("text", "next_text"), "edited", "changed")
    return changed.select(F.col("id").alias(id_column), "n_chars", "edited", printed("sketch").alias("fingerprint"), printed("changed").alias("edited_fingerprint"),
                          likeness("sketch", "changed").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"))
