"""1. License scans with a positional rare-token index.

Templates are licence texts and notices with mandatory key phrases; their words and
positions make an index of postings (word -> template, position). A first pass over all
texts counts in how many documents each template word occurs, so that words have a corpus
IDF. The second pass takes the licence words that a file holds by falling IDF and looks up
their postings; file positions less template positions are relative positions, and those
of a template's first ``RARE`` words that the file brings are intersected. Each one left
is a candidate place, which counts if the mandatory key phrases stand there word by word.
A phrase's words all stand at each of its places, so the intersection loses none.

A place's score is the IDF-weighted share of the whole template found at its relative
positions; a base phrase scores as the best template of its family there, or 1 if there
is none. Base labels come from key phrases; the method's labels (with versions) need the
whole template's score to reach ``MIN_SCORE``.

Defined results: null and empty texts have no words, no labels and score 0;
repeated rows are scanned alike; an empty table gives an empty result (all IDFs
equal). Long texts take time in proportion to words and places. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpairs.llm.words import plain_words as words
from farpairs.tables import table

#: Base phrases: label -> words that must stand consecutively.
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
#: Templates: label -> (text, mandatory key phrases). Fixed public licence notices.
TEMPLATES = {
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    "lgpl": ("this work is licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    "agpl": ("this work is licensed under the gnu affero general public license", ["gnu affero general public license"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    "cc-by-4.0": ("licensed under cc by 4 0", ["cc by 4 0"]),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    "cc0-1.0": ("released under cc0 1 0 universal", ["cc0 1 0"]),
    "mit-notice": ("released under the mit license", ["mit license"]),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        ["permission is hereby granted free of charge"],
    ),
    "bsd-2-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ["redistribution and use in source and binary forms"],
    ),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
}
#: Least IDF-weighted share of a template, and words whose places are intersected for each template.
MIN_SCORE, RARE = 0.6, 3


def _vocabulary(base: dict, templates: dict) -> frozenset[bytes]:
    return frozenset(w for t in [*base.values(), *(x for x, _ in templates.values())] for w in words(t))


def document_frequency(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """(documents, documents holding each word of the bounded ``vocabulary``), over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = defaultdict(int)
        for batch in batches:
            n[""] += batch.num_rows
            for x in batch.column(0):
                for w in vocabulary.intersection(words(x.as_py())):
                    n[w.decode()] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found.pop(b"", 0), found


class Index:
    """Postings of the templates' key words, with the IDF of every template word."""

    def __init__(self, base: dict, templates: dict, documents: int, frequency: dict[bytes, int]):
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1 for w in _vocabulary(base, templates)}
        self.texts, self.phrases, self.labels = [], [], []
        for label, phrase in base.items():
            self._add(label, True, words(phrase), [words(phrase)])
        for label, (text, phrases) in templates.items():
            self._add(label, False, words(text), [words(p) for p in phrases])
        # of the words of each first mandatory phrase, which is at every place that counts
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for t, phrases in enumerate(self.phrases):
            for i, w in enumerate(phrases[0][0], phrases[0][1]):
                self.postings[w][t].append(i)
        self.rare = frozenset(self.postings)
        self.needed = [min(RARE, len(set(phrases[0][0]))) for phrases in self.phrases]
        self.whole = [sum(self.idf[w] for w in text) for text in self.texts]
        # templates of a base phrase's family, with the phrase's place in them
        self.family = [[(u, i) for u, (other, b) in enumerate(self.labels) if base_ and not b and other.startswith(f"{label}-") for i in range(len(self.texts[u])) if self.texts[u][i : i + len(self.texts[t])] == self.texts[t]] for t, (label, base_) in enumerate(self.labels)]

    def _add(self, label: str, base: bool, text: list[bytes], phrases: list[list[bytes]]) -> None:
        self.labels.append((label, base))
        self.texts.append(text)
        self.phrases.append([(p, next(i for i in range(len(text)) if text[i : i + len(p)] == p)) for p in phrases])

    def candidates(self, own: list[bytes]) -> dict[int, set[int]]:
        """template -> places of its first word that its rarest words in this file agree on."""
        held: dict[bytes, list[int]] = {w: [] for w in self.rare.intersection(own)}
        if not held:
            return {}
        for i, w in enumerate(own):
            if w in held:
                held[w].append(i)
        found: dict[int, set[int]] = {}
        taken: dict[int, int] = defaultdict(int)
        for w in sorted(held, key=lambda w: (-self.idf[w], w)):
            for t, offsets in self.postings[w].items():
                if taken[t] < self.needed[t]:
                    taken[t] += 1
                    for q in offsets:
                        here = {i - q for i in held[w]}
                        found[t] = found[t] & here if t in found else here
        return {t: x for t, x in found.items() if x and taken[t] == self.needed[t]}

    def share(self, t: int, start: int, own: list[bytes]) -> float:
        """IDF-weighted share of a template that stands at its relative positions."""
        return sum(self.idf[w] for k, w in enumerate(self.texts[t]) if 0 <= start + k < len(own) and own[start + k] == w) / self.whole[t]

    def scan(self, own: list[bytes]) -> tuple[list[tuple[int, int, float]], int]:
        """(template, place of its first word, score) for each place whose phrases stand."""
        places = []
        for t, starts in self.candidates(own).items():
            for start in starts:
                if all(start + q >= 0 and own[start + q : start + q + len(p)] == p for p, q in self.phrases[t]):
                    score = max((self.share(u, start - q, own) for u, q in self.family[t]), default=1.0) if self.labels[t][1] else self.share(t, start, own)
                    places.append((t, start, score))
        return places, len(own)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", base: dict = BASE, templates: dict = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places).

    ``places`` lists (label, start, score) of every match, in order.
    """
    index = Index(base, templates, *document_frequency(docs, text, _vocabulary(base, templates)))
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("places", place)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, x in zip(batch.column(0), batch.column(1)):
                found, n = index.scan(words(x.as_py()))
                starts = [s for t, s, _ in found if index.labels[t][1]]
                base_labels = {index.labels[t][0] for t, _, _ in found if index.labels[t][1]}
                more = [(index.labels[t][0], s, score) for t, s, score in found if not index.labels[t][1] and score >= MIN_SCORE]
                labels = base_labels | {label for label, _, _ in more}
                score = max([0.0, *(x[2] for x in found)])
                listed = sorted([(index.labels[t][0], s, v) for t, s, v in found if index.labels[t][1]] + more, key=lambda p: (p[1], p[0]))
                out.append((i.as_py(), n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(1.0, score), [{"label": a, "start": b, "score": c} for a, b, c in listed]))
            cols = list(zip(*out)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:long,score:double>>")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("places")
