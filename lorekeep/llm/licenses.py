"""License detection by ordered signature rules.

Three phrases are counted in every text, word by word. On top of them stand hand-written rules for the notices, headers, grants,
conditions and disclaimers of each license (`license_rules`) and a set of signatures made from each license's title, which look for
identifiers, grants, later-version clauses, references and bare titles. An Aho-Corasick automaton finds which keywords occur, and only the
signatures of those keywords are run; every wording, title and form holds one of its keywords, so nothing else decides which texts are
looked at closer. `all rights reserved` right before a notice belongs to the notice. Where detections overlap, one that lies inside another of the same or higher priority gives way, and so does one that
holds another of higher priority; what is left carries the license's label and the signature's confidence.

Ties: detections of the same span and priority keep the first label by name; several labels of one text all stay. A very long text is searched
whole; a wording reaches over at most 1,500 characters at each of its gaps, so the work grows with the text.

Cases: a null or empty text has no words, places or detections; a text in capitals is found like any other (A-Z are lower-cased
first); equal detections count once; repeated rows are scanned alike; an empty table gives no rows; null ids and other
columns do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import license_rules
from .arrays import FOLD_CASE, flat, pieces, strings, word_bounds

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: A word: digits, lower-case letters and everything beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# Label, keywords (each title and form but the identifier holds one of them; | between), title as it appears in lower-cased text, identifier.
LICENSES = [
    ("mit", "mit licen|mit/x11 licen|expat", r"(?:mit|expat)(?: license| licence|/x11 license)", r"mit"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[cs]e)?", r"mit-0"),
    ("x11", "x11 licen", r"x11 licen[cs]e", r"x11"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", r"apache"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v\.? ?)1\.1", r"apache-1\.1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?", r"apache-2\.0"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", r"gpl"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:version |v\.? ?)1(?:\.0)?\b", r"gpl-1\.0(?:-only|-or-later)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:version |v\.? ?)2(?:\.0)?\b", r"gpl-2\.0(?:-only|-or-later)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:version |v\.? ?)3(?:\.0)?\b", r"gpl-3\.0(?:-only|-or-later)?"),
    ("gpl", "gpl", r"\bgpl(?: licen[cs]e)?\b", r"gpl"),
    ("gpl-2.0", "gpl", r"\bgpl ?-?v?2(?:\.0)?\b", r"gplv2"),
    ("gpl-3.0", "gpl", r"\bgpl ?-?v?3(?:\.0)?\b", r"gplv3"),
    ("lgpl", "lesser general|library general", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", r"lgpl"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v\.? ?)2\.1", r"lgpl-2\.1(?:-only|-or-later)?"),
    ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v\.? ?)3(?:\.0)?\b", r"lgpl-3\.0(?:-only|-or-later)?"),
    ("lgpl-2.1", "lgpl", r"\blgpl ?-?v?2\.1\b", r"lgplv2\.1"),
    ("lgpl-3.0", "lgpl", r"\blgpl ?-?v?3(?:\.0)?\b", r"lgplv3"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?:,? (?:version |v\.? ?)3(?:\.0)?\b)?", r"agpl-3\.0(?:-only|-or-later)?"),
    ("agpl-3.0", "agpl", r"\bagpl ?-?v?3(?:\.0)?\b", r"agplv3"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", r"gfdl-1\.[123](?:-only|-or-later)?"),
    ("bsd", "bsd", r"bsd(?:-style)? licen[cs]e", r"bsd"),
    ("0bsd", "bsd", r"(?:0bsd|zero-clause bsd|bsd zero clause)(?: licen[cs]e)?", r"0bsd"),
    ("bsd-2-clause", "bsd", r"(?:bsd[ -]2[ -]clause|2[ -]clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", r"bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:bsd[ -]3[ -]clause|3[ -]clause bsd|(?:new|modified|revised) bsd)(?: licen[cs]e)?", r"bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:bsd[ -]4[ -]clause|4[ -]clause bsd|original bsd)(?: licen[cs]e)?", r"bsd-4-clause"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r"mpl"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,? (?:version |v\.? ?)1\.1", r"mpl-1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e,? (?:version |v\.? ?)2(?:\.0)?", r"mpl-2\.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e(?: -)?,? (?:version |v\.? ?)1(?:\.0)?", r"epl-1\.0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: -)?,? (?:version |v\.? ?)2(?:\.0)?", r"epl-2\.0"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", r"cddl-1\.[01]"),
    ("eupl", "european union", r"european union public licen[cs]e(?:,? (?:version |v\.? ?)1\.[12])?", r"eupl-1\.[12]"),
    ("isc", "isc licen", r"\bisc licen[cs]e", r"isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", r"zlib"),
    ("bsl-1.0", "boost software", r"boost software licen[cs]e(?:,? (?:-? ?version |v\.? ?)1(?:\.0)?)?", r"bsl-1\.0"),
    ("unlicense", "unlicense", r"\b(?:the )?unlicense\b", r"unlicense"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b", r"wtfpl"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e,?(?: (?:version )?2(?:\.0)?)?", r"artistic-2\.0"),
    ("psf-2.0", "python software", r"python software foundation licen[cs]e", r"psf-2\.0"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?:,? (?:version |v\.? ?)1\.1)?", r"ofl-1\.1"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms-pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms-rl"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?:,? (?:version |v\.? ?)3(?:\.0)?)?", r"afl-3\.0"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?:,? (?:version |v\.? ?)3(?:\.0)?)?", r"osl-3\.0"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)? licen[cs]e", r"ncsa"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl"),
    ("php-3.01", "php licen", r"php licen[cs]e(?:,? version 3\.01)?", r"php-3\.01"),
    ("ruby", "ruby licen", r"ruby licen[cs]e", r"ruby"),
    ("vim", "vim licen", r"vim licen[cs]e", r"vim"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[cs]e", r"w3c"),
    ("odbl-1.0", "open database", r"open database licen[cs]e", r"odbl-1\.0"),
    ("pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[cs]e", r"pddl-1\.0"),
    ("cc0-1.0", "cc0", r"\bcc0(?: 1\.0)?(?: universal)?", r"cc0-1\.0"),
    ("cc-by", "cc by|cc-by", r"\bcc[ -]by(?:[ -][1-4]\.[0-9])?\b(?![ -](?:sa|nc|nd))", r"cc-by-[1-4]\.[0-9]"),
    ("cc-by-sa", "cc by|cc-by", r"\bcc[ -]by[ -]sa(?:[ -][1-4]\.[0-9])?\b", r"cc-by-sa-[1-4]\.[0-9]"),
    ("cc-by-nd", "cc by|cc-by", r"\bcc[ -]by[ -]nd(?:[ -][1-4]\.[0-9])?\b", r"cc-by-nd-[1-4]\.[0-9]"),
    ("cc-by-nc", "cc by|cc-by", r"\bcc[ -]by[ -]nc(?:[ -][1-4]\.[0-9])?\b(?![ -](?:sa|nd))", r"cc-by-nc-[1-4]\.[0-9]"),
    ("cc-by-nc-sa", "cc by|cc-by", r"\bcc[ -]by[ -]nc[ -]sa(?:[ -][1-4]\.[0-9])?\b", r"cc-by-nc-sa-[1-4]\.[0-9]"),
    ("cc-by-nc-nd", "cc by|cc-by", r"\bcc[ -]by[ -]nc[ -]nd(?:[ -][1-4]\.[0-9])?\b", r"cc-by-nc-nd-[1-4]\.[0-9]"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4]\.[0-9])?(?: international| unported)?", r"ccby"),
    ("cc-by-sa", "creative commons", r"creative commons attribution[ -]share ?alike(?: [1-4]\.[0-9])?", r"ccbysa"),
    ("cc-by-nc", "creative commons", r"creative commons attribution[ -]non ?commercial(?: [1-4]\.[0-9])?", r"ccbync"),
    ("cc-by-nd", "creative commons", r"creative commons attribution[ -]no ?deriv(?:ative)?s(?: [1-4]\.[0-9])?", r"ccbynd"),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", r"publicdomain"),
    ("proprietary", "all rights reserved", r"all rights reserved", r"proprietary"),
]
# Kind of evidence, priority, confidence, pattern around a title (T) or identifier (I).
FORMS = [
    ("identifier", 4, 1.0, r"spdx-licen[cs]e-identifier:\s*I(?![\w.-])"),
    ("grant", 3, 0.95, r"(?:re)?licen[cs]ed (?:to you )?under (?:the )?(?:terms of )?(?:the |an? )?T"),
    ("release", 3, 0.95, r"(?:released|distributed|published|provided|available|offered|shared) under (?:the )?(?:terms of )?(?:the |an? )?T"),
    ("terms", 3, 0.9, r"(?:subject to|governed by|according to|under) the terms (?:and conditions )?of (?:the )?T"),
    ("later", 3, 0.9, r"T,? (?:\(at your option\) )?or (?:any )?(?:later|newer)(?: version)?"),
    ("reference", 2, 0.7, r"(?:see|read|copy of) the T(?: for)?"),
    ("title", 1, 0.6, r"T"),
]
#: Kind of evidence of a hand-written rule, by priority.
KINDS = {1: "sentence", 2: "clause", 3: "notice", 4: "body", 5: "body", 6: "body"}


class Scanner:
    """All signatures, compiled once per Python worker, by the keyword that gates them."""

    def __init__(self):
        self.gated: dict[str, list[tuple[str, str, int, float, re.Pattern]]] = {}
        for label, keywords, title, identifier in LICENSES:
            for form, priority, confidence, pattern in FORMS:
                compiled = re.compile(pattern.replace("I", identifier).replace("T", title))
                for gate in ["spdx"] if form == "identifier" else keywords.split("|"):
                    self.gated.setdefault(gate, []).append((label, form, priority, confidence, compiled))
        for label, keywords, priority, confidence, wording in license_rules.RULES:
            for gate in keywords.split("|"):
                self.gated.setdefault(gate, []).append((label, KINDS[priority], priority, confidence, license_rules.compiled(wording)))
        self.keywords = ahocorasick.Automaton()
        for keyword in self.gated:
            self.keywords.add_word(keyword, keyword)
        self.keywords.make_automaton()

    def detections(self, text: str) -> list[dict]:
        """What remains after suppression, in text order; `text` is lower-cased."""
        found = {}
        for keyword in {k for _, k in self.keywords.iter(text)}:
            for label, form, priority, confidence, pattern in self.gated[keyword]:
                for hit in pattern.finditer(text):
                    start = hit.start()
                    if form in KINDS.values():
                        before = license_rules.RESERVED.search(text, max(0, start - license_rules.RESERVED_SPAN), start)
                        start = before.start() if before else start
                    found[label, form, start, hit.end()] = (priority, confidence)
        spans = [(start, end, priority, label, form, confidence) for (label, form, start, end), (priority, confidence) in found.items()]
        return [{"label": s[3], "form": s[4], "start": s[0], "end": s[1], "confidence": s[5]} for s in suppressed(spans)]

    def places(self, text: str) -> tuple[list[dict], int]:
        """(label and first word of each phrase place, words): `text` is lower-cased."""
        words = WORDS.findall(text)
        out = []
        for phrase, label in PHRASES.items():
            first, *rest = phrase.split()
            out += [{"label": label, "word": i} for i, w in enumerate(words) if w == first and words[i + 1:i + 1 + len(rest)] == rest]
        return sorted(out, key=lambda p: (p["word"], p["label"])), len(words)


def suppressed(spans: list[tuple]) -> list[tuple]:
    """Of (start, end, priority, ...) those that no other span outranks: none of the same or higher priority holds them,
    none of higher priority lies inside them. Two passes, so the work grows with the number of spans."""
    levels = sorted({s[2] for s in spans})
    kept = []
    reach = dict.fromkeys(levels, -1)
    for span in sorted(spans, key=lambda s: (s[0], -s[1], -s[2], *map(str, s[3:]))):
        if not any(reach[p] >= span[1] for p in levels if p >= span[2]):
            kept.append(span)
        reach[span[2]] = max(reach[span[2]], span[1])
    out = []
    nearest = dict.fromkeys(levels, float("inf"))
    for span in sorted(kept, key=lambda s: (-s[0], s[1], -s[2])):
        if not any(nearest[p] <= span[1] for p in levels if p > span[2]):
            out.append(span)
        nearest[span[2]] = min(nearest[span[2]], span[1])
    return out[::-1]


_scanner: list[Scanner] = []


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, `n_words`, `places` (label, word) of the phrases, and `detections` (label, form, start, end, confidence)
    with spans in code points of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        scanner = _scanner[0]
        place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        detection = pa.list_(pa.struct([("label", pa.string()), ("form", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())]))
        for batch in batches:
            texts = strings(batch.column(1))
            for low, high in pieces(texts):
                data, offsets = flat(texts.slice(low, high - low))
                data = FOLD_CASE[data]
                *_, first = word_bounds(data, offsets, WORD_BYTES)
                whole = data.tobytes()
                places, found = [], []
                for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                    text = whole[a:b].decode()
                    found.append(scanner.detections(text))
                    places.append(scanner.places(text)[0] if "license" in text else [])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(first)), pa.array(places, place), pa.array(found, detection)],
                                                 [id_column, "n_words", "places", "detections"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(
        run, f"`{id_column}` {kind}, n_words long, places array<struct<label:string,word:long>>, "
             "detections array<struct<label:string,form:string,start:long,end:long,confidence:double>>")
