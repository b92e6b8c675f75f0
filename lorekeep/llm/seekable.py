"""Token ids in seekable files: independent zstandard frames, a trailing seek table and a checksum per frame.

A file holds the token ids of documents one after the other, little-endian, 2 bytes each where the vocabulary allows it and 4 otherwise,
cut every `FRAME_IDS` ids into frames that decompress on their own. The last of these frames is the index, an Arrow stream of
(id, n_tokens) in file order. A skippable frame ends the file: the seek table of the public "zstd seekable format", with the packed size,
the plain size and the low 32 bits of the XXH64 of every frame. A reader takes the table, the index and then only the frames
in which a requested document lies; a frame that doesn't match its checksum fails the read. Any zstandard tool unpacks the whole.

`write` sorts documents over range partitions, each task writes its own files below a folder that all executors share,
and the manifest, written last as a table, names the files that count: what a lost or doubled task left behind is never read. A task
holds one batch of texts, one frame and the index of one file, which is closed at `FILE_DOCS` documents or `FILE_IDS` ids.

Cases: a null or empty text is the end id alone; null ids come first; rows with one id are ordered by a hash of their text, equal rows stay as often as
they occur and may lie in several partitions; very long texts run over many frames; an empty table gives no file and no
rows; only the id and text columns are read, others may have any name.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_folder, cut_lineage
from .arrays import pieces, strings
from .packing import _byte_letters

FRAME_IDS = 1 << 16
FILE_DOCS = 1 << 18
FILE_IDS = 1 << 28
BATCH_BYTES = 4 << 20
#: Fixed value: how byte-level vocabularies of this kind split texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed values of the seekable format: magic number of its skippable frame, its closing magic number, the flag for checksums.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_FOOTER = struct.Struct("<IBI")


class BytePairTokens:
    """Token ids of whole texts by a byte-level vocabulary of the tokenizers library.

    The vocabulary's tokens are in the order of their merges, so tiktoken encodes with the same ranks and the same pattern, four times as
    fast. Texts that hold a control string of the vocabulary go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        control = {t.content for t in self.library.get_added_tokens_decoder().values()}
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in self.library.get_vocab().items() if token not in control}
        self.encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.control = re.compile("|".join(map(re.escape, control)) or "(?!)")
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"

    def ids(self, text: str, end_id: int) -> np.ndarray:
        found = self.library.encode(text, add_special_tokens=False).ids if self.control.search(text) else self.encode(text)
        return np.array([*found, end_id], self.kind)


class FrameWriter:
    """One seekable file. `add` takes a document's ids, `close` writes index and seek table."""

    def __init__(self, out, width: str, level: int = 3):
        import zstandard
        self.out, self.width = out, np.dtype(width)
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.waiting: list[np.ndarray] = []
        self.entries: list[tuple[int, int, int]] = []
        self.keys, self.counts = [], []
        self.held = self.tokens = self.bytes = 0

    def add(self, key, ids: np.ndarray):
        self.keys.append(key)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        if self.held >= FRAME_IDS:
            joined = np.concatenate(self.waiting)
            whole = len(joined) // FRAME_IDS * FRAME_IDS
            for at in range(0, whole, FRAME_IDS):
                self._frame(joined[at:at + FRAME_IDS].astype(self.width).tobytes())
            self.waiting, self.held = [joined[whole:]], len(joined) - whole

    def _frame(self, plain: bytes):
        import xxhash
        packed = self.pack(plain)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.bytes += len(packed)
        self.out.write(packed)

    def close(self, key_type: pa.DataType):
        if self.held:
            self._frame(np.concatenate(self.waiting).astype(self.width).tobytes())
        schema = pa.schema([("id", key_type), ("n_tokens", pa.int64())], {"width": self.width.str})
        index = pa.BufferOutputStream()
        with pa.ipc.new_stream(index, schema) as stream:
            stream.write_batch(pa.record_batch([pa.array(self.keys, key_type), pa.array(self.counts, pa.int64())], schema=schema))
        self._frame(index.getvalue().to_pybytes())
        table = np.array(self.entries, _ENTRY).tobytes() + _FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.bytes += len(table) + 8
        self.out.close()


class FrameReader:
    """Reads documents of one seekable file; decompresses the frames they lie in and no others."""

    def __init__(self, file):
        import zstandard
        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        size = file.size()
        count, flags, magic = _FOOTER.unpack(self._bytes(size - _FOOTER.size, _FOOTER.size))
        if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
            raise ValueError("the file has no seek table with checksums")
        self.entries = np.frombuffer(self._bytes(size - _FOOTER.size - count * _ENTRY.itemsize, count * _ENTRY.itemsize), _ENTRY)
        self.places = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        index = pa.ipc.open_stream(self.frame(count - 1))
        self.width = np.dtype(index.schema.metadata[b"width"].decode())
        table = index.read_all()
        self.keys, counts = table["id"], table["n_tokens"].to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def _bytes(self, at: int, count: int) -> bytes:
        self.file.seek(int(at))
        found = self.file.read(int(count))
        if len(found) != count:
            raise ValueError("the file is shorter than its seek table says")
        return found

    def frame(self, number: int) -> bytes:
        import xxhash
        entry = self.entries[number]
        plain = self.unpack(self._bytes(self.places[number], entry["packed"]), max_output_size=int(entry["plain"]))
        if len(plain) != entry["plain"] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {number} does not match its checksum")
        return plain

    def documents(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of the given rows of the index, which ascend; a frame is decompressed once for neighbouring documents."""
        held, ids = -1, None
        for row in rows.tolist():
            at, end, parts = int(self.starts[row]), int(self.starts[row + 1]), []
            while at < end:
                if at // FRAME_IDS != held:
                    held = at // FRAME_IDS
                    ids = np.frombuffer(self.frame(held), self.width)
                stop = min(end, (held + 1) * FRAME_IDS)
                parts.append(ids[at - held * FRAME_IDS:stop - held * FRAME_IDS])
                at = stop
            yield row, np.concatenate(parts) if parts else np.zeros(0, self.width)


MANIFEST = "part int, number int, file string, n_docs long, n_tokens long, n_bytes long"


def write(docs: DataFrame, vocabulary: str, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2) -> DataFrame:
    """Encodes the texts and writes the files below `folder` (by default the application's shared one), in ascending order of the ids.

    Returns the manifest, one row per file: its place in the order (part, number), address, documents, ids and bytes.
    """
    spark = docs.sparkSession
    folder = f"{(folder or cut_folder(spark)).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    # The row's place in the scan tells equal rows apart, so that a group of copies isn't bound to one partition.
    rows = docs.select(id_column, F.col(text_column).alias("_text")).select(F.col(id_column).alias("_id"), "_text", F.xxhash64("_text").alias("_hash"),
                                                                           F.monotonically_increasing_id().alias("_place"))
    order = ["_id", "_hash", "_place"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        tokens, writer, done, kind = BytePairTokens(vocabulary), None, [], None

        def close():
            nonlocal writer
            writer.close(kind)
            done.append((task.partitionId(), len(done), f"{folder}/{name}", len(writer.keys), writer.tokens, writer.bytes))
            writer = None

        for batch in batches:
            kind, texts = batch.column(0).type, strings(batch.column(1))
            for low, high in pieces(texts):
                for key, text in zip(batch.column(0).slice(low, high - low).to_pylist(), texts.slice(low, high - low).to_pylist()):
                    if writer is None:
                        name = f"{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.zst"
                        writer = FrameWriter(store.open_output_stream(f"{base}/{name}", compression=None), tokens.kind)
                    writer.add(key, tokens.ids(text, end_id))
                    if len(writer.keys) >= FILE_DOCS or writer.tokens >= FILE_IDS:
                        close()
        if writer is not None:
            close()
        if done:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["part", "number", "file", "n_docs", "n_tokens", "n_bytes"])

    return cut_lineage(ranged.mapInArrow(run, MANIFEST))


def read(manifest: DataFrame, id_type: str = "bigint", id_column: str = "doc_id", wanted: list | None = None) -> DataFrame:
    """(id, start, n_tokens, ids): the documents of the manifest's files, `ids` as little-endian unsigned 32-bit integers.

    `start` counts the ids of all documents before, over all files. `wanted`, a short list of ids, reads only the frames those lie in.
    """
    earlier = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "number", "file", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("before"))
    # One row per file: as many partitions as files, which adaptive execution would else merge into one task.
    files = files.repartitionByRange(max(1, manifest.count()), "part", "number").select("file", "before")
    names = [id_column, "start", "n_tokens", "ids"]
    sought = None if wanted is None else set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = fs.FileSystem.from_uri(file if "://" in file or file.startswith("file:") else f"file://{file}")
                with store.open_input_file(place) as opened:
                    reader = FrameReader(opened)
                    keys = reader.keys.combine_chunks()
                    if isinstance(keys, pa.ChunkedArray):
                        keys = pa.concat_arrays(keys.chunks)
                    rows = np.arange(len(keys)) if sought is None else np.flatnonzero([k in sought for k in keys.to_pylist()])
                    found, ids, held = [], [], 0

                    def flush():
                        at = np.array(found, np.int64)
                        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(before + reader.starts[at]), pa.array(reader.starts[at + 1] - reader.starts[at]),
                                                           pa.array(ids, pa.binary())], names)

                    for row, tokens in reader.documents(rows):
                        found.append(row)
                        ids.append(tokens.astype("<u4").tobytes())
                        held += len(ids[-1])
                        if held >= BATCH_BYTES or len(found) >= 10_000:
                            yield flush()
                            found, ids, held = [], [], 0
                    if found:
                        yield flush()

    return files.mapInArrow(run, f"`{id_column}` {id_type}, start long, n_tokens long, ids binary")
