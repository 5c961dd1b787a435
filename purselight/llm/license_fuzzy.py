"""License scans: exact phrases, and short notices found with bounded errors.

Texts are normalised to words of digits, a-z (A-Z lower-cased) and non-ASCII characters, with one space between. A
notice that may have k errors is split into k + 1 pieces; a text within k errors must hold one of them unchanged. All
pieces of all notices are sought in one pass (Aho-Corasick). Around each hit, in a window just large enough for the
notice, the places are found where an alignment within k errors ends (Myers' bit vectors, one step a character, so that
a text of near misses costs no more than any other); the stretch before such a place goes to the regex library, whose
bounded-error matching confirms the notice and gives its span and errors.

Defined results: null and empty texts have no words and no labels, and score 0; repeated rows are scanned each; texts are
scanned whole, however long; of matches that overlap the first counts; notices of one label at one place give a span
each; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselight.llm.common import binaries, blocks, map_batches

#: Phrases whose every exact occurrence counts, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices sought with errors, as (label, notice).
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Bytes of words: others become spaces, A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPAN = "struct<label:string,first_word:long,last_word:long,errors:int,similarity:double>"


def normalise(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def allowed_errors(length: int) -> int:
    """One error for each 15 characters, 8 at most."""
    return min(8, length // 15)


@dataclass
class Notice:
    label: str
    text: str
    errors: int
    patterns: list[regex.Pattern]  #: of the text with 0, 1, ... errors at most
    places: dict[str, int]  #: bits of the places at which a character stands

    @classmethod
    def of(cls, label: str, text: str) -> Notice:
        text = b" ".join(normalise(text.encode())).decode()
        k = allowed_errors(len(text))
        places = {c: sum(1 << i for i, x in enumerate(text) if x == c) for c in set(text)}
        return cls(label, text, k, [regex.compile(f"(?:{regex.escape(text, literal_spaces=True)}){{e<={e}}}") for e in range(k + 1)], places)

    def pieces(self) -> list[tuple[int, str]]:
        """k + 1 pieces as (start, text)."""
        n, m = len(self.text), self.errors + 1
        return [(n * i // m, self.text[n * i // m : n * (i + 1) // m]) for i in range(m)]


    def ends(self, line: str, a: int, b: int) -> list[list[int]]:
        """Runs [first, last, least errors] of the places in a..b at which an alignment with line[a:b] within the errors ends.

        Ends as close as one occurrence may have are one run.
        """
        m, places, most = len(self.text), self.places, self.errors
        every, top = (1 << m) - 1, 1 << (m - 1)
        up, down, distance = every, 0, m  # differences along a column of the distance matrix
        out: list[list[int]] = []
        for at in range(a, b):
            x = places.get(line[at], 0) | down
            diagonal = (((x & up) + up) ^ up) | x
            fall, rise = up & diagonal, down | ~(up | diagonal) & every
            if rise & top:
                distance += 1
            elif fall & top:
                distance -= 1
            rise <<= 1
            up, down = (fall << 1 | ~(rise | diagonal)) & every, rise & diagonal & every
            if distance <= most:
                if out and at - out[-1][1] <= 2 * most:
                    out[-1][1:] = at + 1, min(out[-1][2], distance)
                else:
                    out.append([at + 1, at + 1, distance])
        return out

    def matches(self, line: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """(start, end, errors) of the notice in line[a:b], not overlapping: for each run of ends the first with the least errors."""
        out, free = [], a
        for first, last, least in self.ends(line, a, b):
            found = self.patterns[least].search(line, max(free, first - len(self.text) - self.errors), last)
            if found:
                out.append((found.start(), found.end(), sum(found.fuzzy_counts)))
                free = found.end()
        return out


class Scanner:
    def __init__(self, notices=NOTICES, phrases=None):
        self.notices = [Notice.of(*x) for x in notices]
        self.phrases = {f" {p} ": label for p, label in (phrases or PHRASES).items()}
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for start, piece in notice.pieces():
                seeds.setdefault(piece, []).append((i, start))
        for p in self.phrases:
            seeds.setdefault(p, []).append((-1, 0))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (piece, uses))
        self.automaton.make_automaton()

    def windows(self, text: str) -> tuple[dict[int, list[list[int]]], list[tuple[int, str]]]:
        """For each notice, merged windows where it may stand, in order; and places of phrases."""
        found: dict[int, list[list[int]]] = {}
        places = []
        for end, (piece, uses) in self.automaton.iter(text):
            at = end + 1 - len(piece)
            for i, start in uses:
                if i < 0:
                    places.append((at, self.phrases[piece]))
                    continue
                notice = self.notices[i]
                a, b = max(0, at - start - notice.errors), at - start + len(notice.text) + notice.errors
                found.setdefault(i, []).append([a, b])
        for i, spans in found.items():
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            found[i] = merged
        return found, places

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, int, float]]]:
        """(words, places of phrases as (word, label), spans of notices as (label, first word, last word, errors, similarity))."""
        words = normalise(text)
        if not words:
            return 0, [], []
        line = f" {b' '.join(words).decode('utf-8', 'replace')} "
        windows, places = self.windows(line)
        spans = []
        for i, merged in windows.items():
            notice = self.notices[i]
            for a, b in merged:
                for start, end, errors in notice.matches(line, a, min(b, len(line))):
                    spans.append((notice.label, start, end, errors, 1 - errors / len(notice.text)))
        if not places and not spans:
            return len(words), [], []
        spaces = np.array([i for i, c in enumerate(line) if c == " "])
        word = lambda at: max(0, int(np.searchsorted(spaces, at, "right")) - 1)  # noqa: E731  of the character there, or after the space there
        return len(words), [(word(a), label) for a, label in places], sorted((x, word(a), min(word(b - 1), len(words) - 1), e, s) for x, a, b, e, s in spans)


_SCANNERS: dict[tuple, Scanner] = {}


def scanner(notices: tuple) -> Scanner:
    if notices not in _SCANNERS:
        _SCANNERS[notices] = Scanner(notices)
    return _SCANNERS[notices]


def scan(docs: DataFrame, notices: tuple = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score is 1 with an exact phrase, else the similarity (1 - errors / length) of the best notice, else 0.
    """

    def f(batch: pa.RecordBatch):
        it = scanner(notices)
        for a, b in blocks(batch.num_rows, 1000):
            part = batch.slice(a, b - a)
            rows = []
            for text in binaries(part, "text"):
                n, places, spans = it.scan(text)
                base, words = {x for _, x in places}, [w for w, _ in places]
                labels = base | {s[0] for s in spans}
                score = 1.0 if places else max((s[4] for s in spans), default=0.0)
                keys = ("label", "first_word", "last_word", "errors", "similarity")
                rows.append((n, len(places), min(words, default=None), max(words, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [dict(zip(keys, s, strict=True)) for s in spans]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("similarity", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>"
    return map_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text")), f, schema)
