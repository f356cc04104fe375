"""License scans through a positional index of rare licence words.

Every template's words are posted as (word, template, position). The index is as large as the
templates, whatever the corpus. For each template its words of highest inverse document
frequency (counted over all files), a share of them that is a parameter, are looked up in a file,
so that one notice never crowds out another; each occurrence votes for its template at a relative
position (place in the file less place in the template). Votes whose positions differ by a
parameter's number of words at most chain one after another, as words that were put in or left
out shift what follows; shifts add up along a notice. The template of a chain
with enough of its rare words is reported once one of its key phrases stands in the file. The key phrases of the base labels are templates of their own: their rarest word is the
anchor, and every place of it is intersected with the postings of the others.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Phrases that name a licence, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of public licences: label, notice, key phrases of which one must stand in the file.
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge"]),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["apache license version 2 0", "apache license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gnu general public license"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license"]),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["gnu general public license"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["lesser general public license", "library general public license"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["lesser general public license"]),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["affero general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["affero general public license"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["may be used to endorse or promote products"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ["redistribution and use in source and binary forms"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license"]),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ["permission is granted to anyone to use this software"]),
    ("boost", "Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software", ["boost software license", "person or organization obtaining a copy"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ["eclipse public license"]),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.", ["dedicated all copyright and related"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["free and unencumbered software"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ["cc by sa"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution"]),
]

# words put in or left out at one place that a chain passes
DRIFT = 25

KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
TO_SPACE = bytes(b if b in KEEP else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, with A-Z in lower case."""
    return (text or b"").lower().translate(TO_SPACE).split()


class Index:
    def __init__(self, templates: list, base: dict[str, str]) -> None:
        self.templates = [(label, words_of(text.encode()), [words_of(k.encode()) for k in keys]) for label, text, keys in templates]
        self.base = [(words_of(p.encode()), label) for p, label in base.items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, ws, _) in enumerate(self.templates):
            for k, w in enumerate(ws):
                self.postings[w].append((n, k))
        self.vocabulary = frozenset(self.postings) | {w for p, _ in self.base for w in p} | {w for _, _, ks in self.templates for k in ks for w in k}


def document_frequencies(docs: DataFrame, index: Index, text_col: str = "text") -> dict[bytes, int]:
    """Number of rows that hold each word of the index (as many as the templates have), and of all rows under b''."""
    vocabulary = index.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            count[b""] += b.num_rows
            for t in b.column(0).to_pylist():
                count.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "word binary, n long")
    return {bytes(r.word): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def places(at: dict[bytes, list[int]], phrase: list[bytes], idf: dict[bytes, float]) -> list[int]:
    """Starts of a phrase: places of its rarest word at which all others stand at their relative position."""
    if any(w not in at for w in phrase):
        return []
    k = max(range(len(phrase)), key=lambda i: (idf[phrase[i]], -i))
    sets = [(i - k, set(at[w])) for i, w in enumerate(phrase) if i != k]
    return [p - k for p in at[phrase[k]] if all(p + d in s for d, s in sets)]


def rarest_words(index: Index, idf: dict[bytes, float], share: float) -> list[frozenset[bytes]]:
    """For each template the given share of its words, 8 at least, rarest first, however common they are."""
    return [frozenset(sorted(set(ws), key=lambda w: (-idf[w], w))[: max(8, math.ceil(share * len(set(ws))))]) for _, ws, _ in index.templates]


def near_weight(votes: list[tuple[int, int, bytes]], idf: dict[bytes, float], width: int) -> float:
    """The largest weight of the different words of votes (place, position in the template, word) whose relative positions lie within `width`: no chain that spans less weighs more."""
    best = weight = 0.0
    held: Counter = Counter()
    by = sorted((p - k, w) for p, k, w in votes)
    start = 0
    for at, w in by:
        while by[start][0] < at - width:
            gone = by[start][1]
            held[gone] -= 1
            if not held[gone]:
                weight -= idf[gone]
            start += 1
        if not held[w]:
            weight += idf[w]
        held[w] += 1
        best = max(best, weight)
    return best


def best_chain(votes: list[tuple[int, int, bytes]], worth: dict[bytes, float], drift: int) -> float:
    """The largest worth of a chain of votes (place, position in the template, word).

    Along a chain places and positions rise, and the relative position (place less position)
    moves by at most `drift` from one vote to the next, by any number in all. Of votes at one relative
    position the later one has the better chain, so only the last that precedes counts.
    """
    lines: dict[int, tuple[list[int], list[float]]] = {}
    best = 0.0
    for p, k, w in sorted(votes):
        own = p - k
        got = 0.0
        for r in range(own - drift, own + drift + 1):
            if r in lines:
                at, sums = lines[r]
                # place before p, position before k
                i = bisect.bisect_left(at, min(p, k + r)) - 1
                if i >= 0 and sums[i] > got:
                    got = sums[i]
        at, sums = lines.setdefault(own, ([], []))
        at.append(p)
        sums.append(got + worth[w])
        best = max(best, sums[-1])
    return best


def scan_words(words: list[bytes], index: Index, idf: dict[bytes, float], rarest: list[frozenset[bytes]], coverage: float, drift: int = DRIFT) -> tuple[list[int], list[str], list[str], float]:
    """Starts of base phrases, base labels, all labels, score."""
    present = index.vocabulary.intersection(words)
    # a template counts only with one of its key phrases
    open_ = {n for n, (_, _, keys) in enumerate(index.templates) if any(present.issuperset(k) for k in keys)}
    if not open_ and not any(present.issuperset(p) for p, _ in index.base):
        return [], [], [], 0.0
    at: dict[bytes, list[int]] = defaultdict(list)
    for k, w in enumerate(words):
        if w in present:
            at[w].append(k)
    starts, base = [], set()
    for p, label in index.base:
        if found := places(at, p, idf):
            starts += found
            base.add(label)
    labels, score = set(base), 0.5 * bool(base)
    top = {w: {n for n in open_ if w in rarest[n]} for w in present if w in index.postings}
    votes: dict[int, list[tuple[int, int, bytes]]] = defaultdict(list)
    for w, voters in top.items():
        for n, k in index.postings[w]:
            if n in voters:
                votes[n] += [(p, k, w) for p in at[w]]
    for n, v in votes.items():
        label, own, keys = index.templates[n]
        total = max(sum(idf[w] for w in rarest[n]), 1e-9)
        # a chain of this template moves by less than its votes times the drift
        if near_weight(v, idf, drift * (len(own) - 1)) < coverage * total - 1e-9 or not any(places(at, k, idf) for k in keys):
            continue
        # a word that stands in the template several times counts once in all
        times = Counter(own)
        share = min(1.0, best_chain(v, {w: idf[w] / times[w] for _, _, w in v}, drift) / total)
        if share >= coverage:
            labels.add(label)
            score = max(score, share)
    return starts, sorted(base), sorted(labels), min(1.0, score)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list = TEMPLATES, base: dict[str, str] = BASE, rare: float = 0.6, coverage: float = 0.6, drift: int = DRIFT) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    A null or blank text has no words and gives 0, 0, null, null, '', '', 0.0. Ids may be null or
    repeat, and every row has its own result; texts are read whole, whatever their length; of
    templates that tie all labels stand; an empty table gives an empty result; other columns are
    not read. rare: the share of each template's words, rarest first, that are looked up for its
    votes; base phrases are found at every place, whatever the share. drift: the words put in or left
    out at one place that a notice is still followed over.
    """
    index = Index(templates, base)
    df = document_frequencies(docs, index, text_col)
    total = max(df.get(b"", 0), 1)
    # above 0 even for a word of every row
    idf = {w: 1 + math.log((1 + total) / (1 + df.get(w, 0))) for w in index.vocabulary}
    rarest = rarest_words(index, idf, rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                ws = words_of(t)
                starts, own, labels, score = scan_words(ws, index, idf, rarest, coverage, drift)
                out.append((len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(labels), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True))], names)

    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
