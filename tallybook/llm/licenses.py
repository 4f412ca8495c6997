"""License scans: exact phrases and fuzzy short notices.

A notice that may differ by ``k`` edits is split into ``k + 1`` parts; by the pigeonhole principle any
match holds one part unchanged.  One Aho-Corasick pass finds the parts, and only around
them does the ``regex`` library's bounded-error matching verify the notice and report its span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType)

#: Base phrases and their labels (fixed values of the task).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that the method searches for: label, words, edits allowed (characters); of a short notice the part before a bar is exact.
NOTICES = [
    ("gpl", "gnu general public license", 2),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", 6),
    ("apache", "licensed under the apache license", 3),
    ("apache", "apache license version 2 0", 2),
    ("cc-by", "licensed under cc by", 1),
    ("cc-by", "creative commons attribution", 2),
    ("cc-by-sa", "creative commons attribution sharealike", 3),
    ("cc-by-nc", "licensed under cc by nc", 1),
    ("mit", "released under the mit license", 2),
    ("mit", "licensed under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 6),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 6),
    ("mpl", "mozilla public license", 2),
    ("epl", "eclipse public license", 2),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5),
    ("copyright", "all rights reserved", 1),
    ("cc-by", "creative commons by", 1),
    ("mit", "mit |license", 2),
    ("apache", "apache |license", 2),
]
WORD = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: UTF-8 bytes: A-Z lower-cased, bytes outside words turned to blanks.
TO_WORDS = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c in WORD else 0x20) for c in range(256))


def words_text(text: str) -> bytes:
    """The words of a text, lower-cased (A-Z), in UTF-8, each between single blanks."""
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split()) + b" "


@dataclass
class Span:
    label: str
    first_word: int
    n_words: int
    edits: int
    score: float


class Scanner:
    """Finds base phrases and notices in one text; built once per worker process."""

    def __init__(self, notices=NOTICES, base=BASE):
        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (label, phrase, edits) in enumerate(notices):
            head, _, rest = phrase.rpartition("|")
            phrase = head + rest
            if edits >= len(rest):
                raise ValueError(f"{phrase!r} is shorter than its edits")
            rule = regex.compile(f"(?e)(?<= ){regex.escape(head, literal_spaces=True)}(?:{regex.escape(rest, literal_spaces=True)}){{e<={edits}}}(?= )")
            self.notices.append((label, phrase, edits, rule))
            # an exact beginning is the seed; else of edits + 1 parts one is untouched
            bounds = [0, len(head)] if head else [round(i * len(phrase) / (edits + 1)) for i in range(edits + 2)]
            for a, b in zip(bounds, bounds[1:]):
                seeds.setdefault(phrase[a:b], []).append((n, a))
        self.machine = ahocorasick.Automaton()
        for part, where in seeds.items():
            self.machine.add_word(part, (len(part), where))
        self.machine.make_automaton()

    def exact(self, flat: bytes) -> tuple[int, list[int], set[str]]:
        """Places of base phrases: how many, where they start (bytes into ``flat``), their labels."""
        starts, labels = [], set()
        for phrase, label in self.base:
            at = flat.find(phrase)
            while at >= 0:
                starts.append(at)
                labels.add(label)
                at = flat.find(phrase, at + 1)
        return len(starts), starts, labels

    def windows(self, flat: str) -> dict[int, list[list[int]]]:
        """By notice, the merged stretches of ``flat`` that can hold a match."""
        near: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.machine.iter(flat):
            for n, a in where:
                _, phrase, edits, _ = self.notices[n]
                lo = max(0, end + 1 - size - a - edits - 1)
                hi = min(len(flat), end + 1 - size - a + len(phrase) + edits + 1)
                spans = near.setdefault(n, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1][0] = min(lo, spans[-1][0])
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
        return near

    def fuzzy(self, flat: str) -> list[Span]:
        """Verified matches of notices on word borders, in the order of their starts."""
        found = []
        for n, spans in self.windows(flat).items():
            label, phrase, edits, rule = self.notices[n]
            done = 0
            for lo, hi in sorted(spans):
                at = max(lo, done)
                while (m := rule.search(flat, at, hi)) is not None:
                    errors = sum(m.fuzzy_counts)
                    part = m.group().strip()
                    first = flat.count(" ", 0, m.start() + len(m.group()) - len(m.group().lstrip())) - 1
                    found.append(Span(label, first, part.count(" ") + 1, errors, 1 - errors / len(phrase)))
                    done = at = max(m.end(), m.start() + 1)
        return sorted(found, key=lambda s: (s.first_word, s.label, s.edits))


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


RESULT = [StructField(c, LongType()) for c in ("n_words", "n_base", "first_word", "last_word")] + [
    StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType()),
    StructField("spans", ArrayType(StructType([
        StructField("label", StringType()), StructField("first_word", LongType()), StructField("n_words", IntegerType()),
        StructField("edits", IntegerType())])))]


def scan_text(text: str | None, find: Scanner) -> tuple:
    flat = words_text(text or "")
    n_base, starts, base = find.exact(flat)
    spans = find.fuzzy(flat.decode("utf-8", "surrogatepass"))
    word = lambda at: flat.count(b" ", 0, at)
    labels = base | {s.label for s in spans}
    score = 1.0 if base else max((s.score for s in spans), default=0.0)
    return (flat.count(b" ") - 1 if len(flat) > 2 else 0, n_base,
            word(min(starts)) if starts else None, word(max(starts)) if starts else None,
            ",".join(sorted(base)), ",".join(sorted(labels)), score,
            [{"label": s.label, "first_word": s.first_word, "n_words": s.n_words, "edits": s.edits} for s in spans])


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df`` with its license phrases and notices.

    Columns: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans``.  Whole texts are read, long ones too.  A null or empty text has no words, no
    labels (empty strings), null ends and score 0.  ``labels`` joins base labels and those of notices within
    their edits; ``score`` is 1 with a base phrase, else 1 minus the best match's share of edited
    characters.  Two notices may cover the same place.  Repeated rows are scanned one by one, other columns are not read;
    an empty table gives an empty result.
    """
    schema = StructType([StructField("doc_id", df.schema[id_col].dataType), *RESULT])
    out = to_arrow_schema(schema)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner()
        for t in tables:
            rows = [scan_text(x.as_py(), find) for x in t.column(1)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [t.column(0).cast(out.types[0]), *(pa.array(c, k) for c, k in zip(zip(*rows), out.types[1:]))], schema=out)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
