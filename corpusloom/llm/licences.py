"""Licence scans: exact phrase places, and template containment by an exact set-similarity join.

A template's tokens are its distinct pairs of neighbouring words, so order counts. A *block* is any
``2 * words`` (at least ``BLOCK``) places in a row of the whole text, whatever line breaks, marks or
comment signs lie between. A block gets a template's label if it holds at least ``THRESHOLD`` of its
tokens and all of its *deciding* ones (the licence's name and version, where others differ in these
alone).

Templates are few and fixed, so they are the indexed side. Their tokens are ordered by how many
documents of the whole corpus hold them, rarest first. A text can hold ``need = ceil(threshold *
|T|)`` tokens of T only if it holds one of T's first ``|T| - need + 1`` (prefix filter), ``need`` of
them at all (length filter), and ``need`` from its rarest on (positional filter). For what passes, a
block slides over the places of T's tokens and the most that it holds is counted exactly, so nothing
is lost.

Defined results: null and empty texts have no words and no labels; repeated rows each keep their
own; the places and labels of a text depend on it alone, its templates' order on the whole corpus
only for speed; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, encoded, steps

# Phrases whose places count, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Label, deciding phrases, text of each template.
TEMPLATES = (
    ("mit", ["the mit license"], "Released under the MIT License"),
    ("mit", ["the mit license"], "Licensed under the MIT License"),
    (
        "mit",
        ["permission is hereby granted free of charge"],
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software.""",
    ),
    (
        "mit",
        ["permission is hereby granted free of charge"],
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    (
        "isc",
        ["permission to use copy modify"],
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    ("apache-2", ["apache license version 2"], "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        ["the apache license version 2"],
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at""",
    ),
    ("gpl-3", ["gnu general public license", "version 3"], "This work is licensed under the GNU General Public License version 3"),
    (
        "gpl-3",
        ["gnu general public license", "version 3"],
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    ("gpl-2", ["gnu general public license", "version 2"], "This work is licensed under the GNU General Public License version 2"),
    (
        "gpl-2",
        ["gnu general public license", "version 2"],
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ),
    (
        "lgpl",
        ["gnu lesser general public license"],
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version of the License, or (at your option) any later version.""",
    ),
    (
        "agpl-3",
        ["gnu affero general public license", "version 3"],
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    (
        "mpl-2",
        ["mozilla public license v 2"],
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at""",
    ),
    (
        "bsd",
        ["redistribution and use in source and binary forms"],
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ),
    (
        "bsd",
        ["redistribution and use in source and binary forms"],
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    (
        "unlicense",
        ["released into the public domain"],
        "This is free and unencumbered software released into the public domain.",
    ),
    ("cc-by-nc", ["cc by nc"], "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", ["creative commons attribution noncommercial"], "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", ["cc by 4"], "Licensed under CC BY 4.0"),
    ("cc-by", ["creative commons attribution 4"], "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", ["cc by sa"], "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", ["creative commons attribution sharealike"], "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("all-rights-reserved", ["all rights reserved"], "All rights reserved"),
)
#: Share of a template's tokens that a block must hold.
THRESHOLD = 0.8
#: Places of a block, unless twice a template's words are more.
BLOCK = 16

Pair = tuple[bytes, bytes]


def _words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def _pairs(text: str) -> list[Pair]:
    w = _words(text.encode())
    return list(zip(w, w[1:], strict=False))


class _Places:
    """Where template tokens stand in a text."""

    def __init__(self, tokens: frozenset[Pair]):
        self.tokens, self.first = tokens, frozenset(a for a, _ in tokens)

    def __call__(self, words: list[bytes]) -> list[tuple[int, Pair]]:
        first, tokens = self.first, self.tokens
        return [(i, x) for i, w in enumerate(words[:-1]) if w in first and (x := (w, words[i + 1])) in tokens]


def template_tokens(templates=TEMPLATES) -> frozenset[Pair]:
    return frozenset(x for _, _, t in templates for x in _pairs(t))


def template_frequencies(df: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[Pair, int]:
    """For each template token, the number of documents in the whole corpus that hold it."""
    tokens = template_tokens(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, places = dict.fromkeys(tokens, 0), _Places(tokens)
        for part in steps(batches, "text"):
            for t in encoded(part.column(0)):
                for x in {x for _, x in places(_words(t))}:
                    n[x] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(x).decode() for x in n]), pa.array(list(n.values()), pa.int64())], names=["w", "n"])

    rows = df.select(df[text_col].alias("text")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(tokens, 0) | {tuple(r.w.encode().split()): r.n for r in rows}


@dataclass
class Template:
    label: str
    tokens: list[Pair]  # rarest first
    deciding: frozenset[Pair]
    need: int
    block: int
    rank: dict[Pair, int] = field(init=False)

    def __post_init__(self):
        self.rank = {x: i for i, x in enumerate(self.tokens)}


class Matcher:
    """The template index: tokens in global order, prefixes, and the filters."""

    def __init__(self, frequency: dict[Pair, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        self.places = _Places(template_tokens(templates))
        self.templates: list[Template] = []
        self.index: dict[Pair, list[int]] = {}
        for label, deciding, text in templates:
            t = sorted(set(_pairs(text)), key=lambda x: (frequency[x], x))
            need = math.ceil(threshold * len(t) - 1e-9)
            for x in t[: len(t) - need + 1]:
                self.index.setdefault(x, []).append(len(self.templates))
            block = max(BLOCK, 2 * len(_words(text.encode())))
            self.templates.append(Template(label, t, frozenset(x for d in deciding for x in _pairs(d)), need, block))

    def scan(self, words: list[bytes]) -> dict[str, float]:
        """For each label the largest share of a template that a block holds, if it reaches the threshold."""
        found: dict[str, float] = {}
        at = self.places(words)
        own = {x for _, x in at}
        for k in sorted({k for x in self.index.keys() & own for k in self.index[x]}):
            t = self.templates[k]
            ranks = [t.rank[x] for x in own if x in t.rank]
            if len(ranks) >= t.need <= len(t.tokens) - min(ranks) and t.deciding <= own:
                most = self._most(t, [(i, x) for i, x in at if x in t.rank or x in t.deciding])
                if most >= t.need:
                    found[t.label] = max(found.get(t.label, 0.0), most / len(t.tokens))
        return found

    @staticmethod
    def _most(t: Template, at: list[tuple[int, Pair]]) -> int:
        """Most distinct tokens within ``block`` places in a row that hold all deciding ones."""
        held: dict[Pair, int] = {}
        most = first = have = decided = 0
        for i, x in at:
            while at[first][0] <= i - t.block:
                old = at[first][1]
                held[old] -= 1
                if not held[old]:
                    have -= old in t.rank
                    decided -= old in t.deciding
                first += 1
            if not held.get(x):
                have += x in t.rank
                decided += x in t.deciding
            held[x] = held.get(x, 0) + 1
            if decided == len(t.deciding):
                most = max(most, have)
        return most


def places(words: list[bytes], phrases: dict[bytes, list[tuple[list[bytes], str]]]) -> list[tuple[int, str]]:
    return [(i, label) for i, w in enumerate(words) if w in phrases for p, label in phrases[w] if words[i : i + len(p)] == p]


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_words, places of phrases, base labels, all labels, score.

    The score is the largest share of a template that a block holds; a whole phrase counts as 1.
    """
    matcher = Matcher(template_frequencies(df, text_col, templates), templates, threshold)
    phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for p, label in PHRASES.items():
        phrases.setdefault(p.split()[0].encode(), []).append((p.encode().split(), label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            texts = encoded(part.column(1))
            rows = []
            for t in texts:
                words = _words(t)
                hits = places(words, phrases)
                found = matcher.scan(words)
                base = {label for _, label in hits}
                rows.append((len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted(base)), ",".join(sorted(base | found.keys())), 1.0 if hits else max(found.values(), default=0.0)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, schema)

