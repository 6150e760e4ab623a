"""Operator 9, license scans: fuzzy search for short notices.

A notice that may hold k edits splits into k + 1 pieces, so one piece stands in every fuzzy occurrence unchanged
(pigeonhole). One automaton over the pieces of all notices locates the candidates, and the regex library's bounded-error
matching verifies each one in a window around its piece and gives edits and span.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.shared import table

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Notice:
    """A label and the parts of a notice, in words of small letters and digits; each part with its edits at most.

    What tells licenses apart is a part of its own with few edits or none, so that one isn't taken for another.
    """

    label: str
    parts: tuple[tuple[str, int], ...]

    @property
    def text(self) -> str:
        return "".join(p for p, _ in self.parts)

    @property
    def edits(self) -> int:
        return sum(k for _, k in self.parts)

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): the text cut into one piece more than there are edits."""
        t, n = self.text, self.edits + 1
        cuts = [len(t) * i // n for i in range(n + 1)]
        return [(a, t[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def pattern(self) -> regex.Pattern:
        body = "".join(f"(?:{regex.escape(p)}){{e<={k}}}" if k else f"(?:{regex.escape(p)})" for p, k in self.parts)
        return regex.compile(rf"(?b)(?<=^|\x20){body}(?=\x20|$)")


#: The notices that are searched by default.
NOTICES = [
    Notice("mit", (("released under the ", 3), ("mit", 0), (" license", 1))),
    Notice("mit", (("licensed under the ", 3), ("mit", 0), (" license", 1))),
    Notice("mit", (("permission is hereby granted free of charge to any person obtaining a copy of this software", 9),)),
    Notice("apache", (("licensed under the ", 3), ("apache", 1), (" license version 2 0", 3))),
    Notice("gpl", (("licensed under the ", 3), ("gnu general", 2), (" public license", 2))),
    Notice("gpl", (("under the terms of the ", 3), ("gnu general", 2), (" public license", 2))),
    Notice("lgpl", (("gnu lesser", 1), (" general public license", 3))),
    Notice("agpl", (("gnu affero", 1), (" general public license", 3))),
    Notice("bsd", (("redistribution and use in source and binary forms with or without modification are permitted", 9),)),
    Notice("mpl", (("mozilla", 1), (" public license", 2))),
    Notice("epl", (("eclipse", 1), (" public license", 2))),
    Notice("isc", (("permission to use copy modify and or distribute this software for any purpose", 7),)),
    Notice("unlicense", (("this is free and unencumbered software released into the public domain", 6),)),
    Notice("cc-by", (("licensed under ", 2), ("cc by 4", 0), (" 0", 0))),
    Notice("cc-by-sa", (("licensed under ", 2), ("cc by sa", 0))),
    Notice("cc-by-nc", (("licensed under ", 2), ("cc by nc", 0))),
    Notice("cc0", (("cc0 1 0 universal", 2),)),
]
_TO_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal_words(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text whose A-Z are lower-cased."""
    return (text or b"").translate(_TO_SPACE).split()


class Search:
    """Compiled notices; ``find`` takes the words of a text joined by blanks."""

    def __init__(self, notices: list[Notice]):
        self.notices = notices
        self.patterns = [n.pattern() for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for offset, piece in n.pieces():
                seeds.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.automaton.add_word(piece, (len(piece), places))
        if seeds:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, str]]:
        """``(start, end, edits, label)`` of the matches, sorted; in characters. Candidate windows of a notice that overlap
        are searched as one, and matches of one notice don't overlap."""
        if not len(self.automaton):
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                n = self.notices[i]
                a = max(0, end + 1 - size - offset - n.edits)
                b = min(len(text), a + len(n.text) + 3 * n.edits + 1)
                own = windows.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(a, own[-1][0]), max(b, own[-1][1])
                else:
                    own.append([a, b])
        out = []
        for i, spans in windows.items():
            for a, b in spans:
                # the blank before and after belong to the context, not to the window
                for m in self.patterns[i].finditer(text, max(0, a - 1), min(len(text), b + 1)):
                    out.append((m.start(), m.end(), sum(m.fuzzy_counts), self.notices[i].label))
        return sorted(set(out))


def base_places(text: bytes, phrase: str) -> list[int]:
    """Offsets in `` words joined and framed by blanks `` at which the phrase's words stand, overlapping ones too."""
    out, key, at = [], f" {phrase} ".encode(), -1
    while (at := text.find(key, at + 1)) >= 0:
        out.append(at)
    return out


def describe(text: bytes | None, search: Search) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, notices of one text."""
    words = normal_words(text)
    framed = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in BASE.items():
        if got := base_places(framed, phrase):
            places += got
            base.add(label)
    body = framed[1:-1].decode("utf-8", "replace")
    found = search.find(body) if words else []
    index = lambda at: framed.count(b" ", 0, at)
    first, last = (index(min(places)), index(max(places))) if places else (None, None)
    starts = [i for i, c in enumerate(body) if c == " "] if found else []
    word = lambda at: bisect_right(starts, at)
    score = max([1.0 if base else 0.0, *(1 - k / max(1, b - a) for a, b, k, _ in found)])
    notices = ",".join(f"{x}:{word(a)}:{word(b - 1) + 1}:{k}" for a, b, k, x in found)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | {x[3] for x in found})), min(1.0, max(0.0, score)), notices


def scan(docs: DataFrame, notices: list[Notice] = NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices`` for every row of ``docs``.

    ``notices`` lists the fuzzy matches as label:first word:end word:edits. The score is 1 with a base phrase, else the
    largest share of unchanged characters among the matches, 0 without one. A null text counts as empty; repeated rows stay
    repeated; an empty table gives an empty result; other columns are ignored. Texts are searched whole, within their row.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(own.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string"
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(notices)
        for b in batches:
            rows = [describe(t.as_py(), search) for t in b.column(1).cast(pa.binary())]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return own.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


SQL = None
