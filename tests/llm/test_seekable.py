import glob
import random
import zlib

import numpy as np
import pytest
import zstandard
from public_tokenizers import path as vocabulary
from tokenizers import Tokenizer

from lorekeep.llm import queries, seekable
from tests.llm.helpers import SMALL

BYTE_PAIRS = vocabulary("byte_bpe_50k.json")
ODD = [None, "", " ", "  ", "\n", " \n", "\n ", "a  b", "a\nb", "a \n b", "a\n\nb", "a\t b ", "it's  we'll\n\n\n", "naïve café 你好  x y", "x<|endoftext|>y <| z",
       "1234 a1b2 -- !!\r\n\r\n(x)", "\x00\x1c \x1d​", "word " * 40000, "z" * 30000, "a  b", "\n" * 500]


def expected(rows):
    """Brute force: (id, start, count, crc) in ascending order of the ids, by the library alone."""
    library, start, out = Tokenizer.from_file(BYTE_PAIRS), 0, []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], "doc_id long, text string, _text string, ids string, start string").repartition(5)


def test_query_equals_the_library(spark):
    rows = queries.table(spark, SMALL, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    found = queries.QUERIES["op11_token_files"](spark, SMALL).collect()
    assert sorted(map(tuple, found)) == expected(rows)


def test_odd_texts_and_every_token():
    random.seed(3)
    library, fast = Tokenizer.from_file(BYTE_PAIRS), seekable.BytePairTokens(BYTE_PAIRS)
    tokens = [library.decode([i], skip_special_tokens=False) for i in range(library.get_vocab_size())]
    texts = [t or "" for t in ODD] + ["".join(random.choices("ab'é \n\t 1.-", k=random.randrange(30))) for _ in range(3000)]
    texts += tokens + ["".join(random.choices(tokens, k=5)) for _ in range(5000)] + [" " * 300_000 + "x", "ab" * 200_000, "\n \t" * 100_000]
    for text, whole in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert fast.ids(text, 2).tolist() == [*whole.ids, 2]


def test_whole_table_with_nulls_copies_and_clashing_names(spark):
    rows = [(None, "none"), *[(7, t) for t in ("a", "a", "b")], *[(i + 100, t) for i, t in enumerate(ODD)]]
    found = sorted(map(tuple, seekable.read(seekable.write(frame(spark, rows), BYTE_PAIRS)).drop("ids").collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [r[0] for r in rows]
    assert [(r[0], r[1], r[2]) for r in found if r[0] != 7] == [r[:3] for r in expected(rows) if r[0] != 7]
    assert [a[1] + a[2] for a in found[:-1]] == [b[1] for b in found[1:]]


def test_only_frames_of_requested_documents_are_read(spark, tmp_path, monkeypatch):
    rows = [(i, "some words here " * 3000) for i in range(40)]
    files = seekable.write(frame(spark, rows).coalesce(1), BYTE_PAIRS, str(tmp_path))
    whole = {r.doc_id: bytes(r.ids) for r in seekable.read(files).collect()}
    some = {r.doc_id: bytes(r.ids) for r in seekable.read(files, wanted=[5, 31, 999]).collect()}
    assert some == {5: whole[5], 31: whole[31]}
    seen, real = [], seekable.FrameReader.frame
    monkeypatch.setattr(seekable.FrameReader, "frame", lambda self, n: seen.append(n) or real(self, n))
    for path in glob.glob(f"{tmp_path}/*/*.zst"):
        reader = seekable.FrameReader(seekable.fs.LocalFileSystem().open_input_file(path))
        seen.clear()
        list(reader.documents(np.array([len(reader.keys) - 1])))
        assert len(seen) <= 1 + reader.starts[-1] // seekable.FRAME_IDS - reader.starts[-2] // seekable.FRAME_IDS


def test_any_tool_unpacks_and_damage_is_found(spark, tmp_path):
    files = seekable.write(frame(spark, [(i, f"text number {i} " * 500) for i in range(300)]), BYTE_PAIRS, str(tmp_path)).collect()
    paths = [r.file for r in files]
    assert sum(r.n_docs for r in files) == 300
    data = open(paths[0], "rb").read()
    plain = b"".join(iter(lambda r=zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True): r.read(1 << 16), b""))
    assert len(plain) > 2 * files[0].n_tokens
    broken = bytearray(data)
    broken[len(data) // 3] ^= 1
    (tmp_path / "broken.zst").write_bytes(broken)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader = seekable.FrameReader(seekable.fs.LocalFileSystem().open_input_file(str(tmp_path / "broken.zst")))
        list(reader.documents(np.arange(len(reader.keys))))
    (tmp_path / "short.zst").write_bytes(data[:-3])
    with pytest.raises(ValueError):
        seekable.FrameReader(seekable.fs.LocalFileSystem().open_input_file(str(tmp_path / "short.zst")))


def test_files_are_closed_at_their_limits(spark, monkeypatch):
    assert seekable.read(seekable.write(frame(spark, []) , BYTE_PAIRS)).collect() == []
    class Out:
        def __init__(self): self.data = b""
        def write(self, data): self.data += data
        def close(self): pass
    monkeypatch.setattr(seekable, "FRAME_IDS", 4)
    out = Out()
    writer = seekable.FrameWriter(out, "<u4")
    docs = [np.arange(n, dtype="<u4") for n in (0, 1, 9, 4, 3, 0, 12)]
    for i, d in enumerate(docs):
        writer.add(f"k{i}", d)
    writer.close(seekable.pa.string())
    reader = seekable.FrameReader(seekable.pa.BufferReader(out.data))
    assert [d.tolist() for _, d in reader.documents(np.arange(7))] == [d.tolist() for d in docs]
    assert reader.keys.to_pylist() == [f"k{i}" for i in range(7)] and writer.bytes == len(out.data)
