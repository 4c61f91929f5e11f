"""License scans by a positional index of rare words.

Templates and phrases are lists of words. Each is posted under its words of highest
inverse document frequency (counted over all files) with their positions. A file's
words that are posted vote for (template, place of its first word); places with
enough votes are compared word by word, and templates also need their mandatory key
phrases. A phrase stands only where its rarest word stands, so no place of a phrase
is missed, however common that word is in this corpus.

Words are runs of a-z, 0-9 and everything outside ASCII, after A-Z became a-z. Null
text is the empty text; it has no words and no labels. Rows are judged one by one,
so ids may be null or repeated. Without files all frequencies are equal.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docfathom.llm.text import ALNUM, raw_texts

#: Phrases that give a label wherever they stand.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


TEMPLATES = (
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
        ("free software", "general public license"),
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in "
        "compliance with the license",
        ("apache license", "except in compliance"),
    ),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
        ("hereby granted", "without restriction"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        ("source and binary forms", "conditions are met"),
    ),
    Template(
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons", "attribution"),
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted",
        ("any purpose", "without fee"),
    ),
)
#: Rare words that a template is posted under, and how many have to agree on a place.
POSTED, AGREEING = 5, 2
#: Share of a template's words that have to stand in their places.
LEAST_SHARE = 0.8


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(ALNUM).split()


@dataclass(frozen=True)
class Entry:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    is_phrase: bool
    votes: int


class LicenseIndex:
    """Postings of rare words: word -> (entry, position)."""

    def __init__(self, frequency: dict[bytes, int], n_files: int, phrases=PHRASES, templates=TEMPLATES):
        self.entries: list[Entry] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)

        def idf(word):
            return math.log((n_files + 1) / (frequency.get(word, 0) + 1))

        for phrase, label in phrases.items():
            self._add(Entry(label, tuple(phrase.encode().split()), (), True, 1), idf, 1)
        for t in templates:
            words = tuple(t.text.encode().split())
            keys = tuple(tuple(k.encode().split()) for k in t.keys)
            self._add(Entry(t.label, words, keys, False, AGREEING), idf, POSTED)

    def _add(self, entry: Entry, idf, posted: int) -> None:
        rare = sorted(range(len(entry.words)), key=lambda p: (-idf(entry.words[p]), p))[:posted]
        for place in rare:
            self.postings[entry.words[place]].append((len(self.entries), place))
        self.entries.append(entry)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places of phrases as (first word, label), and the best share of each label."""
        postings = self.postings
        hits = [(i, w) for i, w in enumerate(words) if w in postings]
        votes = Counter((e, i - p) for i, w in hits for e, p in postings[w])
        places, shares = [], {}
        for (e, start), n in votes.items():
            entry = self.entries[e]
            if n < entry.votes:
                continue
            if entry.is_phrase:
                if start >= 0 and tuple(words[start : start + len(entry.words)]) == entry.words:
                    places.append((start, entry.label))
                    shares[entry.label] = 1.0
                continue
            there = words[max(start, 0) : start + len(entry.words)]
            same = sum(a == b for a, b in zip(entry.words[max(-start, 0) :], there))
            share = same / len(entry.words)
            if share >= LEAST_SHARE and all(
                any(tuple(there[k : k + len(key)]) == key for k in range(len(there) - len(key) + 1))
                for key in entry.keys
            ):
                shares[entry.label] = max(share, shares.get(entry.label, 0.0))
        return sorted(places), shares


def build_index(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> LicenseIndex:
    """The index, with document frequencies over all of ``docs``.

    What reaches the driver is a count for each word of the templates.
    """
    vocabulary = {w for text in [*phrases, *(t.text for t in templates)] for w in text.encode().split()}

    def run(batches):
        counts: Counter = Counter()
        files = 0
        for batch in batches:
            files += batch.num_rows
            for raw in raw_texts(batch):
                counts.update(vocabulary.intersection(words_of(raw)))
        rows = [*counts.items(), (None, files)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"]
        )

    counted = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {None if r.word is None else bytes(r.word): r.n for r in counted.collect()}
    return LicenseIndex(found, found.pop(None, 0), phrases, templates)


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double"
)


def scan(docs: DataFrame, index: LicenseIndex) -> DataFrame:
    """One row per file: its words, the places of phrases, labels and best share."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
                words = words_of(raw)
                places, shares = index.scan(words)
                starts = [p for p, _ in places]
                out.append(
                    (
                        doc_id,
                        len(words),
                        len(places),
                        starts[0] if starts else None,
                        starts[-1] if starts else None,
                        ",".join(sorted({label for _, label in places})),
                        ",".join(sorted(shares)),
                        max(shares.values(), default=0.0),
                    )
                )
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
