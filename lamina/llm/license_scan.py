"""License notices in texts: exact pieces locate candidates, bounded-error matching verifies them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_key, slices

# Phrases of the base labels, and the short notices that are searched with edits, as words joined by single spaces.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution"),
]
#: A notice may differ by one edit for so many of its characters, and by so many at most.
CHARS_AN_EDIT, MOST_EDITS = 16, 3

_table = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def edits(notice: str) -> int:
    return min(MOST_EDITS, len(notice) // CHARS_AN_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """Offsets and texts of one piece more than there may be edits: edits in all but one leave that one whole."""
    n = edits(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices=NOTICES, phrases=PHRASES):
        import ahocorasick
        import regex

        self.phrases = {f" {p} ": label for p, label in phrases.items()}
        self.notices = [(label, text, edits(text), regex.compile(f"(?e)(?:{regex.escape(text, literal_spaces=True)}){{e<={edits(text)}}}")) for label, text in notices]
        seeds: dict[str, list] = {}
        for i, (_, text) in enumerate(notices):
            for offset, piece in pieces(text):
                seeds.setdefault(piece, []).append((i, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def candidates(self, line: str) -> dict[int, list[list[int]]]:
        """By notice, disjoint rising stretches of the line that hold every place where the notice may stand."""
        found: dict[int, list[list[int]]] = {}
        for end, (n, uses) in self.seeds.iter(line):
            for i, offset in uses:
                _, text, k, _ = self.notices[i]
                start = end + 1 - n - offset
                found.setdefault(i, []).append([max(0, start - k), min(len(line), start + len(text) + k)])
        for i, spans in found.items():
            spans.sort()
            out = spans[:1]
            for a, b in spans[1:]:
                if a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([a, b])
            found[i] = out
        return found

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        raw = (text or "").encode()
        words = raw.translate(_table).split()
        line = f" {b' '.join(words).decode()} " if words else ""
        places, base = [], set()
        for phrase, label in self.phrases.items():
            at = line.find(phrase)
            while at >= 0:
                places.append(at)
                base.add(label)
                at = line.find(phrase, at + 1)
        hits = []
        for i, spans in self.candidates(line).items():
            label, notice, _, pattern = self.notices[i]
            for a, b in spans:
                for m in pattern.finditer(line, a, b):
                    hits.append((m.start() + (line[m.start()] == " "), m.end() - (line[m.end() - 1] == " "), label, sum(m.fuzzy_counts), len(notice)))
        starts = self._word_numbers(line, [p + 1 for p in places])
        spans = []
        if hits:
            first, last = self._word_numbers(line, [h[0] for h in hits]), self._word_numbers(line, [h[1] - 1 for h in hits])
            own = [m.span() for m in _word.finditer(text)]
            spans = [{"label": label, "first_word": first[a], "last_word": last[b - 1], "start": own[first[a]][0], "end": own[last[b - 1]][1], "edits": e, "similarity": 1 - e / n} for a, b, label, e, n in sorted(hits)]
        number = [starts[p + 1] for p in places]
        score = 1.0 if base else max((s["similarity"] for s in spans), default=0.0)
        return len(words), len(places), min(number, default=None), max(number, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s["label"] for s in spans})), score, spans

    @staticmethod
    def _word_numbers(line: str, at: list[int]) -> dict[int, int]:
        """By place in the line, which starts with a space, the number of the word there; one pass over the line."""
        out, before, n = {}, 0, -1
        for p in sorted(set(at)):
            n += line.count(" ", before, p)
            out[p], before = n, p
        return out


SPAN = "struct<label:string,first_word:long,last_word:long,start:long,end:long,edits:int,similarity:double>"
_span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())])


def license_scan(docs: DataFrame, text: str = "text", key: str = "doc_id", notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """One row per input row, in one pass without a shuffle: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, letters A-Z made small. Base
    places are those of ``phrases`` as consecutive words. ``spans`` are the whole words that hold a notice with
    at most ``edits(notice)`` edits: their numbers, code points in the text as given, and the edits. The score is 1
    with a base place, else the best span's similarity, 0 without any.
    Null or empty text: no words, no labels, score 0. Repeated rows and null ids stay as they come; other columns
    are not read. Notices are configuration; each must be longer than its edits plus one.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(_span)]

    def run(batches):
        scanner = Scanner(notices, phrases)
        for batch in batches:
            for part in slices(batch):
                rows = [scanner.scan(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    return docs.select(long_key(docs, key), F.col(text)).mapInArrow(run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>")
