"""Toxicity by subword-bag embeddings and a linear softmax, trained together in numpy.

A word is the mean of the vectors of its character n-grams (with border marks) and of the word itself, all hashed into one
table; a window of `WINDOW` consecutive words is the mean of its distinct words, missing ones counted as neutral; a linear
softmax over that mean gives two classes.
A document is as toxic as its worst window, so a slur does not drown in a long text. Misspelt words share most n-grams
with known ones and get their vectors.

Training sees document labels only: at first random windows carry their document's label, then the worst window of each
toxic document (towards the end unless even that looks clean: such labels are noise) and the worst ones of each clean
document. It runs in
one task on a sample of at most about `SAMPLE_ROWS` labelled documents and `SAMPLE_CHARS` characters per class, no text beyond `TEXT_CHARS`, and returns the embedding table and
the softmax. As both layers are linear, scoring needs one number per table row: the embedding times the difference of the
two softmax columns.

Cases: a null text or a text without words scores 0; without labelled texts of both classes, or without a word in them, every document scores 0; an id
with several labels counts with the largest, null labels are not used; repeated rows are scored alike; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .arrays import FOLD_CASE, IN_WORD, annotate, flat, mix, pieces, span_hashes, strings, word_bounds

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSIONS = 8
WINDOW = 16
SAMPLE_ROWS = 2_500
#: Characters of the sample, about, per class, and of the longest text that is learned from. Every text is scored whole.
SAMPLE_CHARS, TEXT_CHARS = 30_000_000, 2_000_000
EPOCHS = 40
SEED = 11

LETTERS = IN_WORD.copy()
LETTERS[list(b".,;:?\"()[]{}<>|/\\")] = False
LETTERS[:0x20] = False
OPEN, CLOSE = 0x3C, 0x3E
KEYS = (mix(np.arange(1, 256 * 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).reshape(8, 256)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((hashes ^ (hashes >> np.uint32(13))) * np.uint32(0x297A2D39)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))


def marked_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the words one after the other, each between border marks."""
    sizes = ends - starts + 2
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(offsets[-1], np.uint8)
    inner = np.ones(len(out), bool)
    inner[offsets[:-1]] = inner[offsets[1:] - 1] = False
    border = np.zeros(len(data) + 1, np.int8)
    border[starts] = 1
    border[ends] -= 1
    out[inner] = data[np.cumsum(border[:-1], dtype=np.int8).astype(bool)]
    out[offsets[:-1]], out[offsets[1:] - 1] = OPEN, CLOSE
    return out, offsets


def _gram_buckets(marked: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram length: (whether an n-gram of one word starts there, its bucket) for each byte."""
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(marked))
    hashes = KEYS[0][marked]
    for j in range(1, max(GRAMS)):
        hashes[:max(0, len(hashes) - j)] += KEYS[j][marked[j:]]
        if j + 1 in GRAMS:
            yield left > j, _bucket(hashes + np.uint32(j))


def _word_buckets(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return (span_hashes(marked, offsets[:-1], offsets[1:]) % np.uint64(BUCKETS)).astype(np.int64)


def word_scores(table: np.ndarray, marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mean table value of each word's n-grams and the word itself."""
    sums = np.zeros(len(marked), np.float32)
    counts = np.ones(len(offsets) - 1, np.int64)
    for n, (valid, bucket) in zip(GRAMS, _gram_buckets(marked, offsets)):
        sums += np.where(valid, table[bucket], np.float32(0))
        counts += np.maximum(np.diff(offsets) - n + 1, 0)
    return (np.add.reduceat(sums, offsets[:-1]) + table[_word_buckets(marked, offsets)]) / counts


def word_features(marked: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): the table rows of each word."""
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    owners, buckets = [np.arange(len(offsets) - 1)], [_word_buckets(marked, offsets)]
    for valid, bucket in _gram_buckets(marked, offsets):
        owners.append(word[valid])
        buckets.append(bucket[valid].astype(np.int64))
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    return buckets[np.argsort(owners, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(offsets) - 1))])


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window, first window of each text): texts cut into runs of `size` words, the last one shorter."""
    words = np.diff(first)
    many = -(-words // size)
    start = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(words)), many)
    return first[text] + size * (np.arange(start[-1]) - start[text]), start


def repeats(words: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Whether a word stands earlier in its window."""
    again = np.zeros(len(words), bool)
    for j in range(1, min(WINDOW, len(words))):
        again[j:] |= (words[j:] == words[:-j]) & (window[j:] == window[:-j])
    return again


class Trainer:
    """Joint gradient steps (Adagrad) on the embedding table and the softmax."""

    def __init__(self, texts: pa.Array, toxic: np.ndarray):
        # Slice by slice, so that only the numbers of words and the features of distinct ones are held at once.
        known: dict[int, int] = {}
        words, counts, buckets, sizes = [], [np.zeros(1, np.int64)], [], []
        for low, high in pieces(texts):
            data, offsets = flat(texts.slice(low, high - low))
            data = FOLD_CASE[data]
            starts, ends, first = word_bounds(data, offsets, LETTERS)
            distinct, lead, at = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            new = np.array([h not in known for h in distinct.tolist()], bool)
            order = np.argsort(lead[new])  # spans in text order, as `marked_words` expects
            known.update(zip(distinct[new][order].tolist(), range(len(known), len(known) + len(order))))
            if len(order):
                found, spans = word_features(*marked_words(data, starts[lead[new][order]], ends[lead[new][order]]))
                buckets.append(found.astype(np.int32))
                sizes.append(np.diff(spans))
            words.append(np.array([known[h] for h in distinct.tolist()], np.int64)[at])
            counts.append(np.diff(first))
        none = np.zeros(0, np.int64)
        self.word = np.concatenate([none, *words])
        self.buckets, self.spans = np.concatenate([none, *buckets]), np.concatenate([[0], np.cumsum(np.concatenate([none, *sizes]))])
        first = np.cumsum(np.concatenate(counts))
        self.first, self.start = windows(first, WINDOW)
        self.size = np.diff(np.append(self.first, first[-1]))
        self.again = repeats(self.word, np.repeat(np.arange(len(self.first)), self.size))
        self.toxic = toxic
        self.random = np.random.default_rng(SEED)
        self.table = self.random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.soft = self.random.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.table_pace, self.soft_pace, self.bias_pace = np.full(self.table.shape, 1e-4, np.float32), np.full(self.soft.shape, 1e-4, np.float32), np.full(2, 1e-4, np.float32)

    def window_logits(self) -> np.ndarray:
        row = self.table @ (self.soft[:, 1] - self.soft[:, 0])
        word = np.add.reduceat(row[self.buckets], self.spans[:-1]) / np.diff(self.spans)
        return np.add.reduceat(np.where(self.again, 0, word[self.word]), self.first) / WINDOW + self.bias[1] - self.bias[0]

    def step(self, chosen: np.ndarray, label: np.ndarray, rate: float):
        sizes = self.size[chosen]
        window = np.repeat(np.arange(len(chosen)), sizes)
        place = np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.first[chosen][window]
        fresh = ~self.again[place]
        window, words = window[fresh], self.word[place[fresh]]
        many = np.diff(self.spans)[words]
        owner = np.repeat(np.arange(len(words)), many)
        feature = self.buckets[np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + self.spans[words][owner]]
        weight = (1 / (many * WINDOW)).astype(np.float32)[owner]
        of = window[owner]
        used, feature = np.unique(feature, return_inverse=True)
        rows = self.table[used]
        mean = np.stack([np.bincount(of, rows[feature, d] * weight, len(chosen)) for d in range(DIMENSIONS)], axis=1)
        logits = mean @ self.soft + self.bias
        share = np.exp(logits - logits.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        importance = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
        error = (share - np.eye(2)[label]) * (importance * len(label))[:, None]
        back = error @ self.soft.T
        grad = np.stack([np.bincount(feature, back[of, d] * weight, len(used)) for d in range(DIMENSIONS)], axis=1)
        for value, pace, change, at in ((self.table, self.table_pace, grad, used), (self.soft, self.soft_pace, mean.T @ error, slice(None)),
                                        (self.bias, self.bias_pace, error.sum(axis=0), slice(None))):
            pace[at] += change ** 2
            value[at] -= rate * change / np.sqrt(pace[at])

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = np.flatnonzero(np.diff(self.start) > 0)
        many = np.diff(self.start)
        for epoch in range(EPOCHS):
            chosen = []
            if epoch < EPOCHS // 4:
                for _ in range(3):
                    chosen.append(self.start[texts] + (self.random.random(len(texts)) * many[texts]).astype(np.int64))
                chosen = np.concatenate(chosen)
            else:
                logits = self.window_logits()
                text = np.repeat(np.arange(len(many)), many)
                order = np.lexsort((-logits, text))
                rank = np.arange(len(order)) - self.start[text[order]]
                clean = self.toxic[text[order]] == 0
                sure = (logits[order] > -1) | (epoch < 3 * EPOCHS // 4)
                chosen = order[np.where(clean, rank < 3, (rank < 1) & sure)]
            owner = np.searchsorted(self.start, chosen, "right") - 1
            shuffled = self.random.permutation(len(chosen))
            for part in np.array_split(shuffled, max(1, min(16, len(chosen) // 32), len(chosen) // 1024)):
                self.step(chosen[part], self.toxic[owner[part]], 0.1)
        return self.table, self.soft, self.bias


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
          sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(embedding table, softmax weights, softmax bias), or None without examples of both classes."""
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).groupBy(id_column).agg(F.max(label_column).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64(F.col(id_column), F.lit(SEED)), F.lit(1 << 30))
    shares = [F.when((F.col("label") == c) & (place < int(min(1.0, sample_rows / n) * (1 << 30))), True) for c, n in counts.items()]
    if len(shares) < 2:
        return None
    chosen = known.where(F.coalesce(*shares, F.lit(False))).select(F.col(id_column).alias("of"), "label")
    # About 2 * sample_rows labels at most, so the texts stay where they are read. Names of other columns can't clash here.
    texts = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text")).where(F.length("text") <= TEXT_CHARS)
    sample = cut_lineage(texts.join(F.broadcast(chosen), F.col("key") == F.col("of")).select(F.col("key").cast("string").alias("id"), "text", "label"))
    chars = {r["label"]: r["chars"] for r in sample.groupBy("label").agg(F.sum(F.length("text")).alias("chars")).collect()}
    if any(n > sample_chars for n in chars.values()):
        again = F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(1 << 30))
        sample = sample.where(F.coalesce(*[F.when((F.col("label") == c) & (again < int(min(1.0, sample_chars / max(1, n)) * (1 << 30))), True) for c, n in chars.items()], F.lit(False)))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        if rows.num_rows:
            rows = rows.sort_by([("id", "ascending"), ("text", "ascending")])
            trainer = Trainer(strings(rows.column("text")), rows.column("label").to_numpy().astype(np.int64))
            if not len(trainer.word):
                return
            table, soft, bias = trainer.run()
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes()]) for x in (table, soft, bias)], ["embedding", "soft", "bias"])

    found = sample.repartition(1).mapInArrow(train, "embedding binary, soft binary, bias binary").collect()
    if not found:
        return None
    table, soft, bias = (np.frombuffer(x, "<f4") for x in found[0])
    return table.reshape(BUCKETS, -1), soft.reshape(-1, 2), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns `keep` and `score`, the toxic share of the softmax in the document's worst window."""
    if model is None:
        return docs.select(*[c for c in keep if c != "score"], F.lit(0.0).alias("score"))
    table = (model[0] @ (model[1][:, 1] - model[1][:, 0])).astype(np.float32)
    bias = float(model[2][1] - model[2][0])

    def worst(texts: pa.Array) -> list[pa.Array]:
        data, offsets = flat(texts)
        data = FOLD_CASE[data]
        starts, ends, first = word_bounds(data, offsets, LETTERS)
        out = np.zeros(len(texts))
        if len(starts):
            begin, start = windows(first, WINDOW)
            again = repeats(span_hashes(data, starts, ends), np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(starts)))))
            words = word_scores(table, *marked_words(data, starts, ends))
            means = np.add.reduceat(np.where(again, 0.0, words), begin) / WINDOW
            some = np.flatnonzero(np.diff(start) > 0)
            out[some] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(means, start[some]) + bias, -30, 30)))
        return [pa.array(out.round(6))]

    return annotate(docs, text_column, "score double", worst, list(keep))
