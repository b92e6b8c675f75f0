"""Arrow string columns as flat byte arrays, and the vector hashing the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

SLICE_BYTES = 1 << 20


def strings(column) -> pa.Array:
    """The column as one string array, nulls as empty texts."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    return pc.fill_null(array, "") if array.null_count else array


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; text i is bytes[offsets[i]:offsets[i + 1]]."""
    wide = pa.types.is_large_string(array.type)
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(array: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges of about `most` bytes; a longer text is a range of its own, so scratch arrays stay small."""
    _, offsets = flat(array)
    start, rows = 0, len(array)
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, rows)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
FOLD_CASE = np.arange(256, dtype=np.uint8)
FOLD_CASE[65:91] += 32
#: Bytes of a word: everything but blank, tab, line feed, vertical tab, form feed and carriage return.
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False

UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[np.uint64, np.ndarray] = {}


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base ** 0, 1, 2, ... modulo 2 ** 64, more than `count` of them. Those of usual slices are kept, longer ones are not, so a
    worker doesn't hold the memory of its longest text for ever."""
    held = _powers.get(base)
    if held is None or len(held) <= count:
        held = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(count + (count >> 2), base, np.uint64)]))
        if count <= 2 * SLICE_BYTES:
            _powers[base] = held
    return held


def word_bounds(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text): maximal runs of word bytes; a text's border ends a word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = in_word[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * powers(BASE, len(data))[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(UNBASE, len(data))[starts])


def annotate(docs: DataFrame, text_column: str, added: str, work: Callable[[pa.Array], list[pa.Array]], keep: list[str], most: int = SLICE_BYTES) -> DataFrame:
    """The columns `keep` of `docs` with those that `work` makes from bounded slices of the texts (nulls as empty ones).

    `added` is the schema of the new columns; a kept column of the same name gives way.
    """
    fresh = T.StructType.fromDDL(added)
    keep = [c for c in keep if c not in fresh.names]
    source = docs.select(*keep, *([] if text_column in keep else [text_column]))
    at = source.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(at))
            for low, high in pieces(texts, most):
                made = work(texts.slice(low, high - low))
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[:len(keep)], *made], [*keep, *fresh.names])

    return source.mapInArrow(run, T.StructType([*source.select(keep).schema.fields, *fresh.fields]))
