"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +-1; a letter n-gram is the element-wise product (binding) of its letters' vectors,
each rotated by its place (permutation), so the order of the letters counts; a text is the sum (bundle) of its n-grams.
A language's prototype is the sum of the unit vectors of its texts, less the mean over all languages; a document is
compared with every prototype by cosine after the same centring. Letter vectors come from the letter's code and a seed
alone, so they are the same in every task and need no table.

Texts are lower-cased; everything that is not a letter separates words, and a run of it counts as one blank. N-grams of
whole texts are counted and multiplied with the n-gram vectors as matrices, a bounded slice of texts at a time. The
prototypes (languages x dimensions numbers) are all that is passed to the driver; they are learned from a sample of at most about
`SAMPLE_ROWS` labelled rows of each language, taken by a hash of the id, and at least the first row by that hash.

The cosine of a text in no language is noise, and how far a clean text rises above it depends on its evidence: the number of n-grams that
count, which is small for short and for repetitive texts. `least_cosines` learns a threshold per power of two of the evidence
from all labelled texts, starts of them and the same with their letters shuffled: what hardly a shuffled start reaches, but no more than
what nearly all clean ones do. Below about 32 n-grams the two overlap, and such texts stay.

Cases: a null text or a text without a letter gets `und` with score 0; without any labelled row every text gets `und`;
equal cosines go to the language that sorts first; repeated rows are judged alike; null languages are not learned from; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import annotate, mix, pieces, strings

UNKNOWN = "und"
DIMENSIONS = 512
GRAM = 3
SAMPLE_ROWS = 20_000
#: Texts compared at once while the least cosines are learned, and the lengths of the starts taken of them.
CONTRAST_SLICE = 256
STARTS = (4, 8, 16, 32, 64, 128, 256, 512)
#: Powers of two of the evidence that have a least cosine of their own; the share of clean texts below it and of shuffled ones above.
LEVELS = 24
SPARED, PASSED = 0.005, 0.01
SLICE_BYTES = 1 << 20
#: Cells of a slice's count matrix, at most, and n-grams whose vectors are held at once.
CELLS = 1 << 20
GRAMS = 1 << 13

_letters: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letter_vectors(codes: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """A +-1 vector per code point; the blank (code 32) has one too."""
    blocks = np.arange(dimensions // 64, dtype=np.uint64)
    bits = mix(mix(codes.astype(np.uint64)[:, None] + np.uint64(seed << 32)) + blocks * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").astype(np.float32) * 2 - 1


def text_vectors(texts: list[str], dimensions: int, gram: int, seed: int) -> np.ndarray:
    """The bundle of each text's letter n-grams (a row each); zero for texts without letters."""
    return counted_vectors(texts, dimensions, gram, seed)[0]


def counted_vectors(texts: list[str], dimensions: int, gram: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """`text_vectors` and the number of n-grams in each."""
    out = np.zeros((len(texts), dimensions), np.float32)
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(is_letter()[codes], codes, np.uint32(32))
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    # One blank for a run of separators; a text starts and ends with one, so that word borders count.
    keep = np.ones(len(codes), bool)
    if len(codes):
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (of[1:] != of[:-1])
    codes, of = codes[keep], of[keep]
    lettered = np.bincount(of[codes != 32], minlength=len(texts)) > 0
    present = np.zeros(0x110000, bool)
    present[codes] = True
    present[32] = True
    alphabet = np.flatnonzero(present)
    index = np.zeros(0x110000, np.int64)
    index[alphabet] = np.arange(len(alphabet))
    blank = int(index[32])
    # A blank between texts: n-grams that span two texts start or end there and are dropped below.
    starts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
    letters = np.full(len(codes) + 2 * len(texts), blank, np.int64)
    shift = 2 * of.astype(np.int64) + 1
    letters[np.arange(len(codes)) + shift] = index[codes]
    owner = np.repeat(np.arange(len(texts)), np.diff(starts) + 2)
    count = max(0, len(letters) - gram + 1)
    grams = np.zeros(count, np.int64)
    for j in range(gram):
        grams = grams * len(alphabet) + letters[j:j + count]
    same = owner[:count] == owner[gram - 1:] if count else np.zeros(0, bool)
    grams, owner = grams[same], owner[:count][same]
    if len(alphabet) ** gram <= 1 << 22:
        seen = np.zeros(len(alphabet) ** gram, bool)
        seen[grams] = True
        distinct = np.flatnonzero(seen)
        number = np.cumsum(seen) - 1
        grams = number[grams]
    else:
        distinct, grams = np.unique(grams, return_inverse=True)
    basis = letter_vectors(alphabet, dimensions, seed)
    rotated = [np.roll(basis, gram - 1 - j, axis=1) for j in range(gram)]
    rows = max(1, CELLS // max(1, min(len(distinct), GRAMS)))
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for low in range(0, len(distinct), GRAMS):  # n-grams, then texts, in blocks of bounded size
        high = min(low + GRAMS, len(distinct))
        vectors, rest = np.ones((high - low, dimensions), np.float32), distinct[low:high].copy()
        for j in reversed(range(gram)):
            vectors *= rotated[j][rest % len(alphabet)]
            rest //= len(alphabet)
        for first in range(0, len(texts), rows):
            last = min(first + rows, len(texts))
            part = slice(bounds[first], bounds[last])
            g, o = grams[part], owner[part] - first
            if high - low < len(distinct):
                inside = (g >= low) & (g < high)
                g, o = g[inside] - low, o[inside]
            counts = np.bincount(o * (high - low) + g, minlength=(last - first) * (high - low)).reshape(last - first, high - low)
            out[first:last] += counts.astype(np.float32) @ vectors
    out[~lettered] = 0
    return out, np.diff(bounds)


def levels(vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The power of two of each bundle's evidence: its n-grams if all differ, fewer the more they repeat."""
    squares = np.fromiter((v @ v for v in vectors), float, len(vectors))  # row by row: no second copy of the bundles
    evidence = counts.astype(float) ** 2 * vectors.shape[1] / np.maximum(squares, 1)
    return np.clip(np.log2(np.maximum(evidence, 1)).astype(int), 0, LEVELS - 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def learn(labelled: DataFrame, text_column: str, lang_column: str, dimensions: int = DIMENSIONS, gram: int = GRAM,
          seed: int = 7) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes): the sum of the unit vectors of each language's texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = strings(batch.column(0))
            langs = np.array(batch.column(1).to_pylist(), object)
            for low, high in pieces(texts, SLICE_BYTES):
                vectors = unit(text_vectors(texts.slice(low, high - low).to_pylist(), dimensions, gram, seed))
                for lang in set(langs[low:high]):
                    sums[lang] = sums.get(lang, 0) + vectors[langs[low:high] == lang].sum(axis=0, dtype=np.float64)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))], ["lang", "sum"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": frame["lang"][:1], "sum": [np.sum(np.stack(frame["sum"].to_list()), axis=0).round(6)]})

    known = labelled.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull()).select(text_column, lang_column)
    parts = known.mapInArrow(run, "lang string, sum array<double>")
    found = sorted(parts.groupBy("lang").applyInPandas(add, "lang string, sum array<double>").collect())
    return [r["lang"] for r in found], np.array([r["sum"] for r in found], np.float64).reshape(len(found), dimensions)


def bounded_sample(rows: DataFrame, key: str, group: str, most: int) -> DataFrame:
    """About `most` rows of each group at most, the same ones each time: those whose hashed key is low enough, or the lowest."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("many"), F.min(place).alias("lowest")).collect()
    bounds = {r[group]: max(int((1 << 30) * most / r["many"]), r["lowest"] + 1) for r in counts if r["many"] > most}
    if not bounds:
        return rows
    bound = F.try_element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), F.col(group))
    return rows.where(F.coalesce(place < bound, F.lit(True)))


def examples(labelled: DataFrame, id_column: str, text_column: str, lang_column: str) -> DataFrame:
    """The rows that have a text and a language."""
    return labelled.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(id_column, text_column, lang_column)


def learn_sample(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
                 sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """`learn` from a bounded sample of each language's rows."""
    known = examples(labelled, id_column, text_column, lang_column)
    return learn(bounded_sample(known, id_column, lang_column, sample_rows), text_column, lang_column)


def shuffled(text: str) -> str:
    """The text with its characters in a random order, the same one each time."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.random.default_rng(len(codes)).permutation(codes.copy()).tobytes().decode("utf-32-le", "surrogatepass")


def least_cosines(labelled: DataFrame, model: tuple[list[str], np.ndarray], id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
                  gram: int = GRAM, seed: int = 7) -> np.ndarray:
    """Per level of evidence the least cosine of a text in a known language, from all labelled texts."""
    kinds = 3  # whole texts, starts, shuffled texts and starts
    compare = comparer(model, gram, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(0))
            for low, high in pieces(texts, SLICE_BYTES):
                whole = texts.slice(low, high - low).to_pylist()
                starts = [t[:n] for t in whole for n in STARTS if n < len(t)]
                for kind, some in enumerate((whole, starts, [shuffled(t) for t in whole + starts])):
                    some = [t for t in some if any(map(str.isalpha, t))]
                    for at in range(0, len(some), CONTRAST_SLICE):
                        _, best, level = compare(some[at:at + CONTRAST_SLICE])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), kind)), pa.array(level), pa.array(best.astype(float))], ["kind", "level", "score"])

    known = examples(labelled, id_column, text_column, lang_column)
    found = known.select(text_column).mapInArrow(run, "kind long, level long, score double").groupBy("kind", "level").agg(
        F.percentile_approx("score", [SPARED, 1 - PASSED], 10_000).alias("scores"))
    at = {(r["kind"], r["level"]): r["scores"][r["kind"] == kinds - 1] for r in found.collect()}
    least, last = np.zeros(LEVELS), 0.0
    for level in range(LEVELS):  # where a level has no examples, that of the next lower one holds
        clean = [at[k, level] for k in range(kinds - 1) if (k, level) in at]
        if clean and (kinds - 1, level) in at:
            last = min(at[kinds - 1, level], *clean)
        least[level] = last
    return least


def comparer(model: tuple[list[str], np.ndarray], gram: int, seed: int):
    """A function from texts to (nearest language's number, cosine with it, level of evidence) of each."""
    languages, sums = model
    dimensions = sums.shape[1]
    scaled = unit(sums)
    centre = scaled.mean(axis=0) if len(languages) > 1 else np.zeros(dimensions)
    prototypes = unit(scaled - centre).astype(np.float32)
    centre = centre.astype(np.float32)

    def compare(texts: list[str], leveled: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        vectors, counts = counted_vectors(texts, dimensions, gram, seed)
        known = vectors.any(axis=1) & bool(languages)
        level = levels(vectors, counts) if leveled else None
        if not languages:
            return np.full(len(texts), -1), np.zeros(len(texts)), level
        cosines = unit(unit(vectors) - centre) @ prototypes.T
        best = cosines.argmax(axis=1)
        scores = np.where(known, np.clip(cosines[np.arange(len(best)), best], 0, 1).round(6), 0.0)
        return np.where(known, best, -1), scores, level

    return compare


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_column: str = "text", keep: tuple[str, ...] = ("doc_id",), gram: int = GRAM,
            seed: int = 7, least: np.ndarray | None = None) -> DataFrame:
    """Per row: the columns `keep`, `lang_pred` and `score`, the cosine with the chosen prototype (0 to 1). With `least` (of `least_cosines`)
    a text below the least cosine of its level of evidence is `und`, too."""
    languages, compare = model[0], comparer(model, gram, seed)

    def nearest(texts: pa.Array) -> list[pa.Array]:
        best, scores, level = compare(texts.to_pylist(), least is not None)
        if least is not None:
            best = np.where(scores < least[level], -1, best)
        return [pa.array([languages[b] if b >= 0 else UNKNOWN for b in best.tolist()], pa.string()), pa.array(scores.astype(float))]

    return annotate(docs, text_column, "lang_pred string, score double", nearest, list(keep), SLICE_BYTES)
