"""N-gram Jaccard join by PartEnum signatures: groups of documents whose shingle sets reach a similarity.

Two sets of sizes a <= b with Jaccard similarity >= p/100 differ in at most (a + b)(100 - p)/(100 + p) elements and their
sizes differ by a factor p/100 at most. Sizes are cut into bands; a set signs for its own band and, as the larger partner,
for the band below. In a band that allows k differences the 64-bit hash domain of the shingles is cut into
n1 > k/2 first-level parts, so some part holds at most one difference; every part is cut into three, and whichever third
holds the difference, the other two agree. The three unions of two thirds are the part's signatures: two similar sets
share at least one. That is exact, so every link is found; links are then checked on the whole sets.

What keeps this linear:

- Equal sets meet by their key first. Only one of them per task signs, and only one per signature is paired. A set goes by
  48 bits of its key until pairs are found, so neither document ids nor whole keys travel with signatures.
- Signatures travel as packed arrays, cut into buckets by their value; the number of buckets follows their number. Each
  task hands on one entry per frequent signature (more than `CROWD` sets) and the chain that joins its holders, so a hot
  signature never gathers in one place.
- Frequent signatures prove nothing that rare ones don't: a set with more than k/2 parts left whose signatures are all rare
  shares a rare one with every similar set. Sets short of that (mostly in large groups of near copies) take a second pass:
  those that frequent signatures chain together form families, families whose sets lie in different components are cut
  by band into blocks of bounded size, and blocks meet pairwise to compare sketches. Signatures of empty unions are
  written only for sets that have too few others.
- Pairs are thinned by a lower bound of the difference (the bits in which parity sketches of the sets differ) before the
  sets themselves are read. Of the texts only those move that a table of bits, of bounded size, holds likely to be asked for.

Cases: a null or wordless text has an empty set, links with nothing and is its own component; a text of fewer than `words`
words is one shingle; rows with one id count as one document with all their texts; rows without an id link with nothing
and have no component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..session import cut_lineage
from .arrays import FOLD_CASE, flat, mix, pieces, span_hashes, strings, word_bounds

WORDS = 5
SIMILAR = 80
#: A signature held by more sets than this is frequent.
CROWD = 12
#: What a fact says about its pair, where it isn't about a spoiled part.
RARE, CHAIN = -1, -2
#: Sets of one block of the second pass, about.
BLOCK = 512
#: Bits of the table that tells which texts to move, at most, as a power of two.
MOST_SLOTS = 25
#: Signatures of one bucket, about, and signatures a task holds before it hands them on.
BUCKET_SIGNATURES = 500_000
HELD_SIGNATURES = 600_000
ORDER_KEYS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(array: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each text as sorted 64-bit hashes."""
    data, offsets = flat(array)
    data = FOLD_CASE[data]
    starts, ends, first = word_bounds(data, offsets)
    hashes = span_hashes(data, starts, ends)
    runs = np.zeros(len(hashes), np.uint64)
    whole = max(0, len(hashes) - words + 1)
    for j in range(words):
        runs[:whole] += hashes[j:j + whole] * ORDER_KEYS[j]
    runs = mix(runs)
    found, sizes = [], np.zeros(len(array) + 1, np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a >= words:
            own = np.sort(runs[a:b - words + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            own = mix(np.sum(hashes[a:b] * ORDER_KEYS[words:words + b - a], keepdims=True) + np.uint64(b - a))
        else:
            continue
        found.append(own)
        sizes[i + 1] = len(own)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.cumsum(sizes)


def bands(similar: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """(lowest size, allowed differences) of each band up to a size."""
    low, lows, allowed = 1, [], []
    while low <= max(upto, 1):
        high = low * 100 // similar
        lows.append(low)
        allowed.append((high + high * 100 // similar) * (100 - similar) // (100 + similar))
        low = high + 1
    return np.array(lows, np.int64), np.array(allowed, np.int64)


def signatures(hashes: np.ndarray, offsets: np.ndarray, similar: int):
    """Signatures of sorted sets: (signature, text, lower, filled, part) and, per text and side, (spare parts, needed parts).

    `lower` tells whether the text signs as the larger partner for the band below. `filled` is false for unions without
    elements.
    """
    sizes = np.diff(offsets)
    lows, allowed = bands(similar, int(sizes.max(initial=0)))
    own = np.searchsorted(lows, sizes, "right") - 1
    high32 = (hashes >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes), out=sums[1:])
    out, whole, needed = [], np.zeros((len(sizes), 2), np.int64), np.zeros((len(sizes), 2), np.int64)
    for lower in (0, 1):
        band = own - lower
        # Where no difference is allowed only equal sets link, and those meet by their key.
        texts = np.flatnonzero((sizes > 0) & (band >= 0) & (allowed[np.maximum(band, 0)] > 0))
        if not len(texts):
            continue
        need = allowed[band[texts]] // 2 + 1
        parts = need + need // 8 + (need > 1)
        needed[texts, lower] = need
        cells = 3 * parts
        first = np.concatenate([[0], np.cumsum(cells)])
        width = sizes[texts]
        of = np.repeat(np.arange(len(texts)), width)
        place = np.repeat(offsets[texts] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(len(of))
        cell = first[of] + (high32[place] * cells[of] >> 32)
        count = np.bincount(cell, minlength=first[-1])
        # Cells of a text follow each other as its sorted elements do, so cell sums are differences of running sums.
        before = np.cumsum(count) - count
        text_of_cell = np.repeat(np.arange(len(texts)), cells)
        shift = offsets[texts] - np.concatenate([[0], np.cumsum(width)[:-1]])
        start = before + shift[text_of_cell]
        total = (sums[start + count] - sums[start]).reshape(-1, 3)
        count = count.reshape(-1, 3)
        part_text = text_of_cell[::3]
        part = np.arange(len(part_text)) - first[part_text] // 3
        salt = mix((band[texts][part_text].astype(np.uint64) << np.uint64(34)) + (part.astype(np.uint64) << np.uint64(2)))
        all_three, all_count = total.sum(axis=1, dtype=np.uint64), count.sum(axis=1)
        good = np.ones(len(part), bool)
        for j in range(3):
            filled = all_count > count[:, j]
            good &= filled
            out.append((mix(all_three - total[:, j] + salt + np.uint64(j)), texts[part_text], np.full(len(part), lower), filled, part))
        whole[texts, lower] = np.bincount(part_text[good], minlength=len(texts))
    joined = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, bool, np.int64)]
    return (*joined, whole, needed)


def parities(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A bit per cell of a hash table of about twice the set's size: whether the cell holds an odd number of elements."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if a == b:
            out.append(b"")
            continue
        bits = 1 << max(6, int(2 * (b - a) - 1).bit_length())
        out.append(np.packbits(np.bincount((hashes[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1,
                               bitorder="little").tobytes())
    return out


def far_apart(left: bytes, right: bytes, sizes: int, similar: int) -> bool:
    """Whether the sketches prove that the sets differ in more elements than two similar sets of these sizes can."""
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum()) * (100 + similar) > sizes * (100 - similar)


def shingle_sets(docs: DataFrame, words: int, similar: int) -> DataFrame:
    """(id, n, set_key, sketch, whole, needed) per row; `whole` and `needed` count parts for the own and the lower band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for low, high in pieces(texts):
                hashes, offsets = shingles(texts.slice(low, high - low), words)
                *_, whole, needed = signatures(hashes, offsets, similar)
                keys = []
                for extra in (0, 0x9E3779B97F4A7C15):
                    sums = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(mix(hashes + np.uint64(extra)), out=sums[1:])
                    keys.append(mix(sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.diff(offsets)), pa.array(keys[0]), pa.array(keys[1]),
                     pa.array(parities(hashes, offsets), pa.binary()), *[pa.array(c) for x in (whole, needed) for c in x.T.copy()]],
                    ["id", "n", "key_a", "key_b", "sketch", "whole_0", "whole_1", "need_0", "need_1"])

    return docs.mapInArrow(
        run, "id long, n long, key_a long, key_b long, sketch binary, whole_0 long, whole_1 long, need_0 long, need_1 long")


def _crowds(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group start per group, size per group) of equal signatures; `order` is stable."""
    order = np.argsort(signature, kind="stable")
    ordered = signature[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return order, first, np.diff(np.concatenate([first, [len(ordered)]]))


def _chains(order: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of the given groups with the first member of each."""
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return order[np.repeat(first, size)], order[np.repeat(first, size) + inside]


#: Bits of a set's key that name the set where its signatures meet.
NAME = (1 << 48) - 1
#: An entry of a bucket: signature, document, its set's key, band side and part, and whether the signature is frequent.
ENTRY = np.dtype([("sig", "<u8"), ("doc", "<i8"), ("set", "<i8"), ("part", "<i4"), ("hot", "u1")])


def first_candidates(docs: DataFrame, words: int, similar: int, buckets: int) -> DataFrame:
    """(a, b, side, part) of set names: pairs that share a rare signature (side -1) or are chained by a frequent one (-2), all to
    be checked, and parts of set a (side 0 or 1) that a frequent signature spoils."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        spoiled: list[tuple] = []
        seen: set[int] = set()
        count = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            sig, doc, part = (np.concatenate(x) for x in zip(*held))
            order, first, size = _crowds(sig)
            keep, hot = np.ones(len(sig), bool), np.zeros(len(sig), np.uint8)
            crowd = size > CROWD
            head, member = _chains(order, first[crowd], size[crowd])
            keep[member[member != head]] = False
            hot[head] = 1
            entry = np.zeros(int(keep.sum()), ENTRY)
            # 24 bits of a signature: its bucket and part tell it too, and one that meets another by chance only costs a check.
            short = sig >> np.uint64(40) << np.uint64(24)
            for name, values in (("sig", short), ("doc", doc), ("set", doc), ("part", part), ("hot", hot)):
                entry[name] = values[keep]
            bucket = (sig[keep] % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((entry["doc"], bucket))
            entry, bucket = entry[by], bucket[by]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(bucket))
            blobs = [_packed(entry[a:b]) for a, b in zip(cut.tolist(), ends.tolist())]
            yield rows(bucket[cut], blobs, [None] * len(cut))
            # The chains of this task's frequent signatures: to be checked, and parts that they spoil.
            linked = member != head
            ends = np.stack([doc[head[linked]], doc[member[linked]]])
            chain = np.stack([ends.min(axis=0), ends.max(axis=0), np.full(ends.shape[1], CHAIN), np.zeros(ends.shape[1], np.int64)])
            spoil = np.stack([doc[member], doc[member], part[member] & 1, part[member] >> 1])
            facts = np.unique(np.concatenate([chain, spoil], axis=1).T, axis=0).astype("<i8")
            if len(facts):
                place = mix(facts[:, 0].astype(np.uint64)) % np.uint64(buckets)
                by = np.argsort(place, kind="stable")
                facts, place = facts[by], place[by].astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                ends = np.append(cut[1:], len(place))
                yield rows(place[cut], [None] * len(cut), [facts[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist())])

        def rows(bucket, entries, facts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(entries, pa.binary()), pa.array(facts, pa.binary())],
                                              ["bucket", "entries", "facts"])

        for batch in batches:
            texts = strings(batch.column(1))
            for low, high in pieces(texts):
                hashes, offsets = shingles(texts.slice(low, high - low), words)
                known = np.array(batch.column(0).slice(low, high - low).is_valid())
                sums = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(mix(hashes), out=sums[1:])
                keys = mix(sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)
                for i, key in enumerate(keys.tolist()):  # of equal sets in this task one signs
                    known[i] &= key not in seen
                    if known[i]:
                        seen.add(key)
                sig, text, lower, filled, part, whole, needed = signatures(hashes, offsets, similar)
                use = known[text] & (filled | (whole < needed)[text, lower])
                text = text[use]
                held.append((sig[use], (keys & NAME)[text], (part[use] << 1 | lower[use]).astype(np.int64)))
                count += len(text)
                if count >= HELD_SIGNATURES:
                    yield from hand_on()
                    held, count = [], 0
        if held:
            yield from hand_on()

    def meet(table: pa.Table) -> pa.Table:
        blobs = [x for x in table.column("entries").to_pylist() if x is not None]
        entry = np.concatenate([_unpacked(x) for x in blobs]) if blobs else np.zeros(0, ENTRY)
        done = [np.frombuffer(x, "<i8").reshape(-1, 4) for x in table.column("facts").to_pylist() if x is not None]
        entry["sig"] |= (entry["part"] >> 1).astype(np.uint64) << np.uint64(24)
        entry = entry[np.lexsort((entry["doc"], entry["sig"]))]
        sig, doc, key = entry["sig"], entry["doc"], entry["set"]
        order, first, size = _crowds(sig)
        group = np.repeat(np.arange(len(first)), size)
        # Equal sets are one another's links already; of each only the first stays.
        by = np.lexsort((doc, key, group))
        again = np.zeros(len(entry), bool)
        again[by[1:]] = (group[by[1:]] == group[by[:-1]]) & (key[by[1:]] == key[by[:-1]])
        hot_group = np.bincount(group, weights=entry["hot"], minlength=len(first)) > 0
        lead = np.flatnonzero(~again)
        group, doc, part = group[lead], doc[lead], entry["part"][lead].astype(np.int64)
        size = np.bincount(group, minlength=len(first))
        first = np.cumsum(size) - size
        hot_group |= size > CROWD
        crowd = hot_group & (size > 0)
        head, member = _chains(np.arange(len(lead)), first[crowd], size[crowd])
        linked = member != head
        pairs = [np.stack([doc[head[linked]], doc[member[linked]], np.full(int(linked.sum()), CHAIN)])]
        few = ~hot_group & (size > 1)
        for step in range(1, CROWD):  # members of a small group with the `step`-th after them
            left = np.flatnonzero(few[group] & (np.arange(len(group)) + step < (first + size)[group]))
            pairs.append(np.stack([doc[left], doc[left + step], np.full(len(left), RARE)]))
        pairs = np.concatenate(pairs, axis=1)
        pairs = np.stack([pairs[:2].min(axis=0), pairs[:2].max(axis=0), pairs[2], np.zeros(pairs.shape[1], np.int64)])
        spoil = np.stack([doc[member], doc[member], part[member] & 1, part[member] >> 1])
        facts = np.unique(np.concatenate([pairs.T, spoil.T, *done]), axis=0)
        facts = facts[(facts[:, 2] >= 0) | (facts[:, 0] != facts[:, 1])]
        return pa.table([pa.array(np.ascontiguousarray(facts[:, j])) for j in range(4)], ["a", "b", "side", "part"])

    signed = docs.mapInArrow(sign, "bucket long, entries binary, facts binary")
    return signed.groupBy("bucket").applyInArrow(meet, "a long, b long, side long, part long").distinct()


def _planes(values: np.ndarray, least: int = 0) -> tuple[int, bytes]:
    """(bytes per value, the values' lowest bytes, then their next ones, ...): as many as the largest needs. Bytes that are mostly
    zero lie together, where the shuffle's compression takes them."""
    width = max(least, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return width, values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


#: What stands before the columns of packed entries: their number, the documents' and the first document, bytes per value of each column.
HEAD = np.dtype([("entries", "<u4"), ("docs", "<u4"), ("least", "<u8"), ("width", "u1", 5)])


def _packed(entry: np.ndarray) -> bytes:
    """Entries in document order, column by column: documents as steps from one to the next, each with the number of its entries and,
    unless it goes by it, its set's name once. Columns are as wide as their values need."""
    first = np.flatnonzero(np.concatenate([[True], entry["doc"][1:] != entry["doc"][:-1]]))
    docs, names = entry["doc"][first].view(np.uint64), entry["set"][first].view(np.uint64) & np.uint64(NAME)
    own = (0, b"") if (names == docs).all() else _planes(names, 1)
    columns = [_planes(np.diff(docs)), own, *[_planes(x) for x in (np.diff(np.append(first, len(entry))), entry["sig"] >> np.uint64(24), entry["part"])]]
    head = np.array([(len(entry), len(first), docs[0], [width for width, _ in columns])], HEAD)
    return b"".join([head.tobytes(), *[x for _, x in columns], np.packbits(entry["hot"]).tobytes()])


def _unpacked(blob: bytes) -> np.ndarray:
    head = np.frombuffer(blob, HEAD, 1)[0]
    count, docs, width = int(head["entries"]), int(head["docs"]), head["width"].tolist()
    at = HEAD.itemsize

    def take(column: int, number: int) -> np.ndarray:
        nonlocal at
        found = np.zeros((number, 8), np.uint8)
        found[:, :width[column]] = np.frombuffer(blob, np.uint8, number * width[column], at).reshape(width[column], number).T
        at += number * width[column]
        return found.reshape(-1).view("<u8")

    ids = np.cumsum(np.concatenate([head["least"][None], take(0, docs - 1)]), dtype=np.uint64)
    names = take(1, docs) if width[1] else ids & np.uint64(NAME)
    times = take(2, docs).astype(np.int64)
    entry = np.zeros(count, ENTRY)
    entry["doc"], entry["set"] = np.repeat(ids.view(np.int64), times), np.repeat(names.view("<i8"), times)
    entry["sig"], entry["part"] = take(3, count), take(4, count)
    entry["hot"] = np.unpackbits(np.frombuffer(blob, np.uint8, (count + 7) // 8, at), count=count)
    return entry


def close_candidates(sets: DataFrame, lead: DataFrame, pairs: DataFrame, similar: int) -> DataFrame:
    """(a, b): documents that stand for the sets of the (a, b) pairs of names, where neither sizes nor sketches rule the pair out."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            keep = [not far_apart(x, y, s, similar) for x, y, s in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    sized = pairs
    for end in ("a", "b"):
        sized = sized.join(lead.select(F.col("name").alias(end), F.col("id").alias(f"id_{end}"), F.col("n").alias(f"n_{end}")), end)
    sized = sized.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similar).where("id_a <> id_b")
    sized = cut_lineage(sized.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b"))
    # All sketches move once, for both joins: fewer bytes than to move them, and those asked for again, to pick these first.
    sized = (sized.join(sets.select(F.col("id").alias("a"), F.col("sketch").alias("s_a")), "a")
             .join(sets.select(F.col("id").alias("b"), F.col("sketch").alias("s_b")), "b"))
    return sized.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(near, "a long, b long").distinct()


def linked_pairs(docs: DataFrame, close: DataFrame, words: int, similar: int) -> DataFrame:
    """Those of the (a, b) pairs whose sets reach the similarity, checked on the whole sets."""
    close = cut_lineage(close)
    ids = close.select(F.col("a").alias("id")).union(close.select(F.col("b").alias("id"))).distinct()
    # An inner join, as Spark would do a semi join first, with all texts.
    content = hashed_sets(likely_rows(docs, ids, 2 * close.count()).join(ids, "id"), words)
    both = (close.join(content.select(F.col("id").alias("b"), F.col("hashes").alias("h_b")), "b")
            .join(content.select(F.col("id").alias("a"), F.col("hashes").alias("h_a")), "a"))
    # Row by row in the JVM: batches of whole sets would be as large as the longest texts make them.
    shared, sizes = F.size(F.array_intersect("h_a", "h_b")), F.size("h_a") + F.size("h_b")
    return both.where(100 * shared >= similar * (sizes - shared)).select("a", "b")


def likely_rows(rows: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The rows whose id is one of at most so many `ids`, and up to about one in eight of the others; beyond four million ids the
    table of bits stays as large and lets more through."""
    slots = 1 << min(MOST_SLOTS, max(6, (8 * most).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(slots))
    bits = (ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, int(slot % 64)))").alias("bits")))
    held = rows.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(bits), "word")
    return held.where(F.expr("getbit(bits, int(slot % 64)) = 1")).select(rows.columns)


def hashed_sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, hashes): each text's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column(1))
            for low, high in pieces(column):
                hashes, offsets = shingles(column.slice(low, high - low), words)
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), sets], ["id", "hashes"])

    return texts.select("id", "text").mapInArrow(run, "id long, hashes array<long>")


def folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches of one length, shortened to `words` 64-bit words: a row each."""
    rows = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def close_pairs(left: dict, right: dict, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that lie in different components, whose sizes fit and whose sketches don't rule them out."""
    found = [], []
    for size_a in np.unique(left["bytes"]):
        for size_b in np.unique(right["bytes"]):
            rows, columns = np.flatnonzero(left["bytes"] == size_a), np.flatnonzero(right["bytes"] == size_b)
            words = int(min(size_a, size_b)) // 8
            b = folded([right["sketch"][j] for j in columns], words)
            step = max(1, (1 << 21) // max(1, len(columns) * words))
            for low in range(0, len(rows), step):
                part = rows[low:low + step]
                a = folded([left["sketch"][i] for i in part], words)
                apart = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
                n, m = left["n"][part][:, None], right["n"][columns][None, :]
                fits = (apart * (100 + similar) <= (n + m) * (100 - similar)) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * similar)
                i, j = np.nonzero(fits & (left["component"][part][:, None] != right["component"][columns][None, :]))
                found[0].append(part[i])
                found[1].append(columns[j])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def second_candidates(sets: DataFrame, short: DataFrame, chained: DataFrame, found: DataFrame, similar: int) -> DataFrame:
    """(a, b): pairs of the documents in `short` whose sets frequent signatures chain together, whose components differ so far and
    whose sizes and sketches do not rule them out."""
    family = connected_components(chained.select(F.col("a").alias("id")).union(chained.select(F.col("b").alias("id"))), chained)
    rows = (sets.join(short, ["id", "name"], "left_semi").select("id", "name", "n", "sketch")
            .join(family.select(F.col("id").alias("name"), F.col("component").alias("family")), "name").join(found, "id"))
    lows, _ = bands(similar, int(rows.agg(F.max("n")).first()[0] or 1))
    # The bands of a set and, as the larger partner, the one below: similar sets have one in common.
    band = F.size(F.filter(F.array(*[F.lit(int(x)) for x in lows]), lambda x: x <= F.col("n")))
    rows = cut_lineage(rows.withColumn("band", F.explode(F.array(band, band - 1))))
    key = ["family", "band"]
    sized = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("many"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    placed = (rows.join(sized.select(*key, F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks")), key)
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")))

    def compare(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_numpy() for c in ("id", "n", "component", "block", "lo")}
        sketch = table.column("sketch").to_pylist()

        def side(keep: np.ndarray) -> dict:
            at = np.flatnonzero(keep)
            return {"sketch": [sketch[i] for i in at], "bytes": np.array([len(sketch[i]) for i in at], np.int64)} | {c: column[c][at] for c in ("id", "n", "component")}

        low = column["block"] == column["lo"]
        whole = bool(low.all())
        first, second = side(low), side(low if whole else ~low)
        i, j = close_pairs(first, second, similar)
        a, b = first["id"][i], second["id"][j]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    met = placed.select("family", "band", "lo", "hi", "block", "id", "n", "component", "sketch").groupBy("family", "band", "lo", "hi")
    return met.applyInArrow(compare, "a long, b long").where("a < b").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                    similar: int = SIMILAR) -> DataFrame:
    """(id_column, n_shingles, component_id) per row of `docs`: the smallest id that links lead to, itself included."""
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    sets = cut_lineage(shingle_sets(docs, words, similar))
    total = sets.agg(F.sum(F.col("need_0") + F.col("need_1"))).first()[0] or 0
    buckets = max(64, 4 * total // BUCKET_SIGNATURES)
    filled = sets.where("n > 0 and id is not null").withColumn("name", F.col("key_a").bitwiseAND(NAME))
    key = ["key_a", "key_b"]
    # The document with the smallest id stands for all with its set.
    lead = cut_lineage(filled.groupBy(*key, "name").agg(F.min("id").alias("id"), (F.max("id") > F.min("id")).alias("copied"), *[
        F.first(c).alias(c) for c in ("n", "whole_0", "whole_1", "need_0", "need_1")]))
    copies = filled.join(lead.where("copied").select(*key, F.col("id").alias("b")), key).where("id <> b").select(F.col("id").alias("a"), "b")
    facts = cut_lineage(first_candidates(docs, words, similar, buckets))
    close = close_candidates(filled, lead, facts.where("side < 0").select("a", "b").distinct(), similar)
    links = cut_lineage(linked_pairs(docs, close, words, similar).union(copies).distinct())
    found = connected_components(filled.select("id"), links)

    # Sets that frequent signatures leave too few parts.
    spoiled = facts.where("side >= 0").groupBy(F.col("a").alias("name")).agg(
        *[F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(f"hot_{s}") for s in (0, 1)])
    short = cut_lineage(lead.join(spoiled, "name", "left").where(" or ".join(f"whole_{s} - coalesce(hot_{s}, 0) < need_{s}" for s in (0, 1)))
                        .select("id", "name"))
    if short.take(1):
        chained = facts.where(F.col("side") == CHAIN).select("a", "b")
        more = second_candidates(filled, short, chained, found, similar)
        later = cut_lineage(linked_pairs(docs, more, words, similar))
        if later.take(1):
            found = connected_components(filled.select("id"), links.union(later))
    return (sets.select("id", "n").join(found, "id", "left")
            .select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")))
