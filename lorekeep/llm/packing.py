"""Best-fit decreasing packing of token sequences into windows of fixed length.

Documents longer than a window are cut into full windows first. What remains of each document goes, longest first, into
the open window with the least room that still takes it; a segment tree over the remaining capacities finds that window
in logarithmic time. Every Spark task packs the documents of its own partition, in rounds of bounded size, so nothing is
shuffled, a lost task is packed again alike, and no task holds more than one round's remainders. What this gives away
against one global packing is the few half-full windows at the end of a round.

Cases: a null or empty text is the end id alone; equal texts and repeated rows are packed each on its own; an empty table
gives no rows; null ids and other columns of the input do no harm, only `id_column` and `text_column` are read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrays import flat, pieces, strings, word_bounds
from .wordtable import WordTable, with_end

WINDOW = 2048
ROUND_PIECES = 1 << 16
ROUND_BYTES = 64 << 20


class Vacancies:
    """Open windows by remaining capacity: a segment tree over capacities whose nodes tell whether any window is below."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _mark(self, capacity: int, present: int):
        node = self.leaves + capacity
        self.any[node] = present
        while node > 1:
            node >>= 1
            now = self.any[2 * node] | self.any[2 * node + 1]
            if self.any[node] == now:
                return
            self.any[node] = now

    def add(self, capacity: int, window: int):
        if not self.windows[capacity]:
            self._mark(capacity, 1)
        self.windows[capacity].append(window)

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window that takes `length`, which is then no longer listed."""
        node = self.leaves + length
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            self._mark(capacity, 0)
        return capacity, window


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """(window number, offset in it) of each length, and the number of windows: best fit, longest first."""
    vacancies, opened = Vacancies(window), 0
    places, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = vacancies.take(lengths[i])
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, places[i] = found
        offsets[i] = window - capacity
        if capacity > lengths[i]:
            vacancies.add(capacity - lengths[i], places[i])
    return places, offsets, opened


def _letters(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level vocabularies use: printable Latin-1 bytes stand for themselves,
    the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens:
    """Token ids of whole texts by a vocabulary that lower-cases and splits texts into words; words are encoded once.

    Plain Latin texts are split at blanks; what stands between two blanks is looked up in a table, else cut by the
    vocabulary's own pattern into words, which the tokenizers library encodes. Texts with other letters, odd control
    characters or control strings are encoded whole by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.library = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.byte_letters = _byte_letters()
        size = self.library.get_vocab_size()
        self.closes = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        letter, number, blank = _letters("L"), _letters("N"), "\t\n\x0b\x0c\r "
        self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{blank}{letter}{number}]+").findall
        self.table = WordTable("<u4")

    def _learn(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of what stands between blanks: all words are encoded as one text; every word ends in one closing token."""
        cut = [self.find(c.decode()) for c in chunks]
        words = {w: i for i, w in enumerate({w for ws in cut for w in ws})}
        spelled = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.byte_letters) for w in words]
        ids = np.array(self.bare.encode(" ".join(spelled), add_special_tokens=False).ids, "<u4")
        ends = np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1]).tolist()
        if len(ends) != len(words) + 1:
            raise ValueError("the vocabulary does not close its words")
        of = [ids[a:b] for a, b in zip(ends, ends[1:])]
        return [of[words[ws[0]]] if len(ws) == 1 else np.concatenate([of[words[w]] for w in ws]) for ws in cut]

    def ids(self, array: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text, closed by the end id."""
        plain, texts = plain_latin(array), array.to_pylist()
        lowered = [t.lower().replace("\xa0", " ").replace("\x85", " ").encode() for t, p in zip(texts, plain) if p]
        data = np.frombuffer(b"".join(lowered), np.uint8)
        starts, ends, first = word_bounds(data, np.concatenate([[0], np.cumsum([len(t) for t in lowered], dtype=np.int64)]))
        ids, offsets = with_end(*self.table.ids(data, starts, ends, self._learn), first, end_id)
        whole = zip(offsets.tolist(), offsets[1:].tolist())
        return [ids[slice(*next(whole))] if p else np.array([*self.library.encode(t, add_special_tokens=False).ids, end_id], "<u4")
                for t, p in zip(texts, plain)]


def plain_latin(array: pa.Array) -> list[bool]:
    """Whether each text holds only code points below U+0180 but the dotted and dotless i, no separator controls and no
    control strings: lower-casing and splitting then follow simple rules."""
    data, offsets = flat(array)
    odd = ODD[data]
    odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] >> 1 == 0xB0 >> 1)
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    plain = np.ones(len(array), bool)
    plain[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = False
    return plain.tolist()


#: Bytes of code points from U+0180 on, and the separator controls.
ODD = np.zeros(256, bool)
ODD[0xC6:] = ODD[0x1C:0x20] = True

_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per Python worker, kept between tasks."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW,
         end_id: int = 1) -> DataFrame:
    """One row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset).

    `ids` are the piece's token ids (little-endian unsigned 32-bit); the end id closes each document. Pieces with one
    sequence_id form a sequence of at most `window` ids, without gaps from offset 0.
    """
    id_type = docs.schema[id_column].dataType
    schema = f"`{id_column}` {id_type.simpleString()}, {PIECES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary)
        first = TaskContext.get().partitionId() << 40
        used, held = 0, 0
        ready: list[tuple] = []
        tails: list[tuple] = []

        def rows(found: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*found))
            kinds = [ids, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        def close() -> list[tuple]:
            nonlocal used
            places, offsets, opened = best_fit([t[2] for t in tails], window)
            out = [(*t, first + used + p, o) for t, p, o in zip(tails, places, offsets)]
            used += opened
            tails.clear()
            return out

        for batch in batches:
            kind = batch.column(0).type
            texts = strings(batch.column(1))
            for low, high in pieces(texts):
                encoded = tokens.ids(texts.slice(low, high - low), end_id)
                for key, ids in zip(batch.column(0).slice(low, high - low).to_pylist(), encoded):
                    count, ids = len(ids), ids.tobytes()
                    for start in range(0, count - window + 1, window):
                        ready.append((key, start, window, ids[4 * start:4 * (start + window)], count, first + used, 0))
                        used += 1
                        held += 4 * window
                    if rest := count % window:
                        tails.append((key, count - rest, rest, ids[4 * (count - rest):], count))
                        held += 4 * rest
                    if len(tails) >= ROUND_PIECES or held >= ROUND_BYTES:
                        yield rows(ready + close(), kind)
                        ready, held = [], 0
        if ready or tails:
            yield rows(ready + close(), kind)

    return docs.select(id_column, text_column).mapInArrow(run, schema)
