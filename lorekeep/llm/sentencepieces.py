"""SentencePiece BPE encoding by backtracking, and decoding.

Merging by rank has one result per text: the only sequence of vocabulary pieces in which every two neighbours are
compatible, that is, merging the text of the pair again leaves the border between them. So a text is read left to right:
an Aho-Corasick automaton gives the longest piece at each position; a piece is taken if it is compatible with the one
before, else the next shorter prefix piece is tried; when none is left, the position is marked as failed in a bitfield
and the last piece is shortened instead. Compatibility is found by undoing merges from the two sides of the border, later merges
first, and remembered per pair.

No piece of such a vocabulary holds a word border inside, so texts are encoded word by word and words are looked up in a
bounded table of flat arrays; a vocabulary that breaks this rule is encoded text by text. Characters outside the vocabulary become
byte pieces (or the unknown piece where there are none).

Cases: a null or empty text is the end id alone and decodes to an empty text; a text of blanks only or without blanks is
encoded whole like any word; equal texts and repeated rows get equal ids; null ids and other columns do no harm; an empty
table gives no rows. Decoding leaves out control pieces, drops the blank that encoding puts in front, and turns bytes that
are no UTF-8 into replacement characters.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import flat, pieces as ranges, strings, word_bounds
from .wordtable import WordTable, with_end

SPACE = "▁"
CACHED_WORDS = 100_000
NO_BLANK = np.ones(256, bool)
NO_BLANK[0x20] = False
CACHED_PAIRS = 400_000


def _replace_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("piece_bytes", _replace_byte)


class Vocabulary:
    """The pieces of a model in rank order: single characters first, then merged pieces by score."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end_id, self.unknown_id = model.eos_id(), model.unk_id()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        plain = {model.id_to_piece(i): i for i in range(size) if not special[i]}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.texts = [model.id_to_piece(i).replace(SPACE, " ").encode() if not special[i] else b"" for i in range(size)]
        for byte, i in self.bytes.items():
            self.texts[i] = bytes([byte])
        self.texts[self.unknown_id] = " ⁇ ".encode()

        self.spaced = {i for p, i in plain.items() if p[0] == SPACE}

        merged = sorted((p for p in plain if len(p) > 1), key=lambda p: (-model.get_score(plain[p]), plain[p]))
        letters = sorted({c for p in plain for c in p})
        self.rank = {p: r for r, p in enumerate([*letters, *merged])}
        self.words = not any(SPACE in p.lstrip(SPACE) for p in merged)
        count = len(self.rank)
        # How merging builds each piece; pieces it never reaches are left out.
        self.left, self.right = list(range(count)), list(range(count))
        self.joined: dict[int, int] = {}
        reached = set(letters)
        for piece in merged:
            split = self._last_merge(piece)
            if split:
                r = self.rank[piece]
                self.left[r], self.right[r] = split
                self.joined[split[0] << 32 | split[1]] = r
                reached.add(piece)
        self.length = [len(p) for p in self.rank]
        self.ids = [[plain[p]] if p in plain else self.spelled(p) for p in self.rank]
        self.shorter = [next((self.rank[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in reached), -1) for p in self.rank]
        self.automaton = ahocorasick.Automaton()
        for piece in reached:
            self.automaton.add_word(piece, self.rank[piece])
        self.automaton.make_automaton()
        self.known = re.compile("[" + "".join(map(re.escape, letters)) + "]+")
        self.pairs: dict[int, bool] = {}
        self.table = WordTable("<i4")
        self.seen: dict[str, list[int]] = {}

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two ranks whose merge gives the piece when its text is merged alone, if that gives the piece."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(((self.rank.get(a + b, len(self.rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == len(self.rank):
                return None
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def spelled(self, text: str) -> list[int]:
        """Ids of characters outside the vocabulary."""
        if self.bytes:
            return [self.bytes[b] for b in text.encode("utf-8", "surrogatepass")]
        return [self.unknown_id] * bool(text)

    def compatible(self, first: int, second: int) -> bool:
        """Whether merging leaves a border between two neighbouring pieces.

        The pair is taken apart from the border outwards, the later merge first. If at some point the two inner parts
        merge earlier than what has been undone so far, merging would have crossed the border.
        """
        key = first << 32 | second
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            limit, a, b, found = len(self.left), first, second, None
            while found is None:
                over = self.joined.get(a << 32 | b)
                if over is not None and over < limit:
                    found = False
                # Of two merges the later one is undone; on equal ranks the left one was made first.
                elif a > b:
                    limit, inner = a, self.right[a]
                    if inner == a:
                        found = True
                    a = inner
                else:
                    limit, inner = b + 1, self.left[b]
                    if inner == b:
                        limit, inner = a, self.right[a]
                        if inner == a:
                            found = True
                        a = inner
                    else:
                        b = inner
            self.pairs[key] = found
        return found

    def _ranks(self, text: str) -> list[int]:
        """Ranks of a text of known characters."""
        compatible = self.compatible
        greedy = [r for _, r in self.automaton.iter_long(text)]
        if all(map(compatible, greedy, greedy[1:])) and sum(self.length[r] for r in greedy) == len(text):
            return greedy
        longest = [0] * len(text)
        for end, r in self.automaton.iter(text):  # ends ascend, so the last entry of a start is its longest piece
            longest[end + 1 - self.length[r]] = r
        length, shorter = self.length, self.shorter
        alive = bytearray(b"\x01") * (len(text) + 1)
        taken: list[int] = []
        at, piece = 0, longest[0]
        while True:
            while piece >= 0:
                end = at + length[piece]
                if alive[end] and (not taken or compatible(taken[-1], piece)):
                    break
                piece = shorter[piece]
            if piece < 0:  # nothing fits here: whatever led to this position is given up
                alive[at] = 0
                piece = shorter[last := taken.pop()]
                at -= length[last]
                continue
            taken.append(piece)
            at = end
            if at == len(text):
                return taken
            piece = longest[at]

    def word_ids(self, word: str) -> list[int]:
        out, at, ids = [], 0, self.ids
        for run in self.known.finditer(word):
            if run.start() > at:
                out += self.spelled(word[at:run.start()])
            for r in self._ranks(run.group()):
                out += ids[r]
            at = run.end()
        if at < len(word):
            out += self.spelled(word[at:])
        return out

    def encode(self, text: str) -> list[int]:
        """Ids without the end id."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if not self.words:
            return self.word_ids(text)
        seen, out = self.seen, []
        for word in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text):
            ids = seen.get(word)
            if ids is None:
                if len(seen) >= CACHED_WORDS:
                    seen.clear()
                ids = seen[word] = self.word_ids(word)
            out += ids
        return out

    def _learn(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(self.word_ids(SPACE + w.decode()), np.int32) for w in words]

    def encode_all(self, array: pa.Array) -> list[np.ndarray]:
        """Ids of each text with the end id. Texts whose words stand one blank apart are looked up together."""
        texts = array.to_pylist()
        single = [self.words and "  " not in t and not t.startswith(" ") and not t.endswith(" ") and SPACE not in t for t in texts]
        data, offsets = flat(array.filter(pa.array(single, pa.bool_())))
        starts, ends, first = word_bounds(data, offsets, NO_BLANK)
        ids, offsets = with_end(*self.table.ids(data, starts, ends, self._learn), first, self.end_id)
        whole = zip(offsets.tolist(), offsets[1:].tolist())
        return [ids[slice(*next(whole))] if s else np.array([*self.encode(t), self.end_id], np.int32) for t, s in zip(texts, single)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.texts.__getitem__, ids))
        first = next((i for i in ids if self.texts[i]), None)
        return (text[1:] if first in self.spaced else text).decode("utf-8", "piece_bytes")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """One per Python worker, kept between tasks."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id and `ids`, the token ids of the whole text with the end id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary_of(vocabulary)
        for batch in batches:
            texts = strings(batch.column(1))
            for low, high in ranges(texts):
                found = model.encode_all(texts.slice(low, high - low))
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), ids], [id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Per row: the id, the ids as they came and `text`, what they decode to; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary_of(vocabulary)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = part.column(1)
                flat_ids, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
                texts = [model.decode(flat_ids[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], [id_column, ids_column, "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, `{ids_column}` array<int>, text string")
