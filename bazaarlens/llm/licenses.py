"""Licence notices in documents: a trained paragraph classifier, confirmed against licence templates.

Paragraphs (lines with words that follow each other) are cut into segments of ``SEGMENT`` words, overlapping by half. A multinomial logistic regression
on sparse word n-grams (one to three words, those of the templates) gives each segment the chance of every
licence family and of ``unknown``. An L1 penalty leaves few n-grams, so segments without any are unknown by
their bias alone and need no scoring. The chances are calibrated by a temperature fitted on held-out
segments. A segment is judged only where ``unknown`` is not the likelier side. A family counts if its calibrated chance is
at least ``LEAST_CHANCE`` and the segment confirms one of its templates: it holds ``LEAST_SHARE`` of the template's word
n-grams and ``LEAST_RUNS`` of those of three words (the words in order, not just the words), and the stretch where they
stand has the same ``NAMING`` words as the template, so a notice with one more of them is not taken for the laxer licence. Of several the one
with the largest share is taken, its place is left out and the rest of the segment judged again, until no family
counts. What two segments share is found in both: of notices that overlap, the one with most of its template stays.

It is trained in numpy on variants of the templates and, as ``unknown``, on a bounded sample of the corpus: segments
of the ``SAMPLE_ROWS`` documents (of at most ``SAMPLE_BYTES`` each) with the smallest hash, at most ``SAMPLE_SEGMENTS``
of them, without those that resemble a template. Scoring reads every row and whole texts, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.shared import filled, in_tasks, keyed
from bazaarlens.llm.words import LETTERS, as_bytes, mixed, portions, runs, slices, word_hashes

SEGMENT, STRIDE = 64, 32
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_SEGMENTS = 1000, 1 << 15, 4000
MOST_UNKNOWN, LEAST_CHANCE = 0.5, 0.05
LEAST_SHARE, LEAST_RUNS = 0.6, 0.4
VARIANTS, STEPS, RATE, LASSO = 60, 250, 0.1, 2e-4
SEED = 42
GAP = 4  # words without an n-gram of its template inside a notice, at most

# Customary notices of the licence families.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0.",
    ),
    "cc_by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    ),
    "cc_by_nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.",
    ),
    "cc_by_nc_nd": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.",
    ),
    "cc_by_nc_sa": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.",
    ),
    "cc_by_nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License.",
    ),
    "cc_by_sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": ("All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."),
}
# Words that tell licences apart. A notice has exactly those of its template.
NAMING = (
    "affero agpl apache bsd cc0 eclipse epl gpl isc lesser lgpl mit mozilla mpl nc nd noderivatives noderivs noncommercial sa sharealike"
).split()
# Sentences that share words with notices and are none.
NEAR_MISSES: tuple[str, ...] = (
    "She renewed her driving license at the public office under the new law.",
    "The general version of this work was released in the year 2.0 of the project.",
    "Permission to enter the building is granted by the person at the desk, free of charge.",
    "The software is distributed under the name of its author on every computer.",
    "The foundation published the terms of the prize in writing for the public.",
    "Under the law all copies of the notice are included in the file of the office.",
    "The apache tribe lived in the open country under the mountains.",
    "The conditions in this part of the country are general and the public is free to use it.",
    "You may use this form to apply for a work license or a fishing license.",
    "The rights of the author were reserved for the second version of the book.",
    "The company reserved all rights to use its logo under the terms of the sale.",
    "The eclipse was seen by the public under the open sky, and materials of the program were made available.",
    "The lesser known works of the author are provided without fee for any purpose.",
)


@dataclass
class LicenseModel:
    families: list[str]  # the last is unknown
    grams: np.ndarray  # sorted hashes of the n-grams with a weight
    weights: np.ndarray  # grams x families, divided by the temperature
    bias: np.ndarray
    known_words: np.ndarray  # sorted hashes of the words that templates have
    template_grams: list[np.ndarray]  # distinct n-grams of each template
    template_family: list[int]
    template_names: list[str]
    template_runs: list[np.ndarray]  # the n-grams of three words among them
    naming: np.ndarray  # sorted n-grams of one word, those of NAMING


def _grams(hashes: np.ndarray, line: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of one to three known words in one paragraph: their hash and the place of their first word."""
    found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(hashes) and len(known):
        at = np.flatnonzero(_member(hashes, known)[0])
        gram = mixed(hashes[at] + np.uint64(1))
        for n in range(1, 4):
            found.append(gram)
            places.append(at)
            if n == 3:
                break
            following = at + n
            keep = following < len(hashes)
            keep[keep] = (line[following[keep]] == line[at[keep]]) & _member(hashes[following[keep]], known)[0]
            at, gram = at[keep], gram[keep]
            gram = mixed(gram * np.uint64(0x9E3779B97F4A7C15) + hashes[at + n])
    return np.concatenate(found), np.concatenate(places)


def _member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values a sorted table has, and where."""
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def _words_in_lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and line (counted in the text, empty ones too) of every word."""
    hashes, numbers, lines = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    seen = np.zeros(len(texts) + 1, np.int64)
    for parts in slices(texts, LETTERS):
        raw, start, _, _, text, found = runs(parts, LETTERS)
        breaks = np.concatenate(([0], np.cumsum(raw == 10)))
        lengths = np.fromiter((len(p) + 1 for _, p in parts), np.int64, len(parts))
        first = np.cumsum(lengths) - lengths
        part = np.searchsorted(first, start, side="right") - 1
        before = np.fromiter((seen[i] for i, _ in parts), np.int64, len(parts)) - breaks[first]
        lines.append(breaks[start] + before[part])
        for k, (i, p) in enumerate(parts):
            seen[i] += breaks[first[k] + len(p)] - breaks[first[k]]
        hashes.append(found)
        numbers.append(text)
    return np.concatenate(hashes), np.concatenate(numbers), np.concatenate(lines)


def _numbered(line: np.ndarray, number: np.ndarray, step: int) -> np.ndarray:
    """Running number over all texts, a new one where a word's line is ``step`` or more after the word before it."""
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] - line[:-1] >= step) | (number[1:] != number[:-1])
    return np.cumsum(new) - 1


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and line (counted over all texts) of every word; and each text's lines that have a word."""
    return _lines_and_paragraphs(texts)[:4]


def _lines_and_paragraphs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """What ``lines_of`` gives, and the paragraph of every word: a line without words ends one, a line break does not."""
    found, number, raw = _words_in_lines(texts)
    line = _numbered(raw, number, 1)
    head = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    return found, number, line, np.bincount(number[head], minlength=len(texts)), _numbered(raw, number, 2)


def _segments(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the last segment it is in, and whether it is in the one before as well.

    Segment s of a line holds its words s * STRIDE to s * STRIDE + SEGMENT - 1; numbers go up by lines.
    """
    head = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(line)))
    inside = np.arange(len(line)) - np.repeat(head, size)
    count = np.maximum(1, -(-(size - (SEGMENT - STRIDE)) // STRIDE))
    base = np.cumsum(count) - count
    last = np.minimum(inside // STRIDE, np.repeat(count, size) - 1)
    return np.repeat(base, size) + last, (last > 0) & (inside < last * STRIDE + (SEGMENT - STRIDE))


def _scores(model: LicenseModel, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Chances of the families for n segments with the given (segment, gram) pairs."""
    z = np.tile(model.bias, (n, 1))
    for f in range(z.shape[1]):
        z[:, f] += np.bincount(rows, model.weights[columns, f], minlength=n)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def scan(texts: list[bytes], model: LicenseModel) -> tuple[np.ndarray, list[list[dict]]]:
    """Lines with words of each text, and its confirmed notices."""
    hashes, text, line, n_lines, paragraph = _lines_and_paragraphs(texts)
    gram, place = _grams(hashes, paragraph, model.known_words)
    last, also = _segments(paragraph)
    segment = np.concatenate((last[place], last[place[also[place]]] - 1))
    gram, place = np.concatenate((gram, gram[also[place]])), np.concatenate((place, place[also[place]]))
    found: list[list[dict]] = [[] for _ in texts]
    if not len(gram) or not len(model.grams):
        return n_lines, found
    has, at = _member(gram, model.grams)
    pair = np.unique((segment[has] << 16) | at[has])
    of, row = np.unique(pair >> 16, return_inverse=True)
    chance = _scores(model, row, pair & 0xFFFF, len(of))
    hits = np.flatnonzero(chance[:, -1] <= MOST_UNKNOWN)
    if not len(hits):
        return n_lines, found
    order = np.argsort(segment, kind="stable")
    sorted_segment = segment[order]
    notices = []
    for hit in hits:
        low, high = np.searchsorted(sorted_segment, [of[hit], of[hit] + 1])
        own = order[low:high]
        notices += _notices(model, gram[own], place[own], chance[hit])
    for family, likely, template, share, p, _ in _apart(notices):
        begin = np.searchsorted(line, line[p])
        i = int(text[p])
        found[i].append(
            {
                "line": int(line[p] - line[np.searchsorted(text, i)]),
                "word": int(p - begin),
                "family": model.families[family],
                "chance": likely,
                "template": model.template_names[template],
                "share": share,
            }
        )
    return n_lines, found


_Notice = tuple[int, float, int, float, int, int]  # family, chance, template, share, first and last place


def _apart(notices: list[_Notice]) -> list[_Notice]:
    """In order of place, of notices that overlap the one with the largest share, then the longest, then the first."""
    kept: list[_Notice] = []
    best = sorted(notices, key=lambda n: (-n[3], n[4] - n[5], n[4], n[0], n[2], -n[1]))
    firsts: list[int] = []
    for notice in best:
        at = bisect(firsts, notice[5])
        # Those kept do not overlap, so of the ones that begin before its end only the last can reach into it.
        if at and kept[at - 1][5] >= notice[4]:
            continue
        firsts.insert(at, notice[4])
        kept.insert(at, notice)
    return kept


def _notices(model: LicenseModel, gram: np.ndarray, place: np.ndarray, chance: np.ndarray) -> Iterator[_Notice]:
    """The notices of a segment, the one with the largest share first."""
    while len(gram) and chance[-1] <= MOST_UNKNOWN:
        taken = _closest(model, gram, place, chance)
        if taken is None:
            return
        yield taken
        p, last = taken[4:]
        rest = (place < p) | (place > last)
        gram, place = gram[rest], place[rest]
        has, at = _member(gram, model.grams)
        column = np.unique(at[has])
        chance = _scores(model, np.zeros(len(column), np.int64), column, 1)[0]


def _span(gram: np.ndarray, place: np.ndarray, template: np.ndarray) -> tuple[int, int]:
    """First and last place of the run of words with most of the template's n-grams, the shortest of those."""
    mine = np.isin(gram, template)
    gram, place = gram[mine], place[mine]
    best = (0, 0, 0, 0)
    for p in np.unique(place):
        behind = place >= p
        near = np.sort(_first_places(gram[behind], place[behind]))
        near = near[near < p + len(template)]
        # Words far behind the others belong to something else.
        cut = np.flatnonzero(np.diff(near) > GAP)
        near = near[: cut[0] + 1] if len(cut) else near
        best = max(best, (len(near), -int(near[-1] - p), int(p), int(near[-1])))
    return best[2], best[3]


def _first_places(gram: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first place of every distinct n-gram."""
    order = np.lexsort((place, gram))
    _, head = np.unique(gram[order], return_index=True)
    return place[order][head]


def _closest(model: LicenseModel, gram: np.ndarray, place: np.ndarray, chance: np.ndarray) -> _Notice | None:
    """The notice whose template the segment confirms with the largest share, of the families that are likely enough."""
    own = np.unique(gram)
    likely = []
    for t, family in enumerate(model.template_family):
        if chance[family] >= LEAST_CHANCE:
            share = float(np.isin(model.template_grams[t], own).mean())
            if share >= LEAST_SHARE and np.isin(model.template_runs[t], own).mean() >= LEAST_RUNS:
                likely.append((share, float(chance[family]), t))
    # Of templates held alike the longer one says more.
    for share, own_chance, t in sorted(likely, key=lambda c: (c[0], len(model.template_grams[c[2]]), c[1], -c[2]), reverse=True):
        p, last = _span(gram, place, model.template_grams[t])
        names = np.unique(gram[(place >= p) & (place <= last)])
        if np.array_equal(names[np.isin(names, model.naming)], model.naming[np.isin(model.naming, model.template_grams[t])]):
            return model.template_family[t], own_chance, t, share, p, last
    return None


def _variants(rng: np.random.Generator, template: str, filler: list[str]) -> Iterator[str]:
    """The template as it occurs: whole, with words lost, and inside other text."""
    words = template.split()
    for k in range(VARIANTS):
        kept = [w for w in words if k % 3 == 0 or len(words) < 6 or rng.random() > 0.08]
        around = rng.integers(0, 20, 2) if filler and k % 2 else (0, 0)
        before, after = (list(rng.choice(filler, n)) if n else [] for n in around)
        yield " ".join([*before, *kept, *after])


def train(sample: list[str]) -> LicenseModel:
    """Fit on variants of the templates and on sampled segments of the corpus; the same sample gives the same model."""
    rng = np.random.default_rng(SEED)
    families = [*TEMPLATES, "unknown"]
    flat = [(f, k, t) for f, name in enumerate(TEMPLATES) for k, t in enumerate(TEMPLATES[name])]
    named = word_hashes([" ".join(NAMING).encode()])[0]
    known = np.unique(np.concatenate((word_hashes([t.encode() for *_, t in flat])[0], named)))
    in_order = [_grams(h := word_hashes([t.encode()])[0], np.zeros(len(h), np.int64), known)[0] for *_, t in flat]
    grams = [np.unique(g) for g in in_order]
    # n words have n n-grams of one word, n - 1 of two and n - 2 of three, in this order.
    of_three = [np.unique(g[-(len(g) // 3 - 1) :]) for g in in_order]
    naming = np.unique(mixed(named + np.uint64(1)))
    vocabulary = np.unique(np.concatenate(grams))
    model = LicenseModel(families, vocabulary, np.zeros((len(vocabulary), len(families))), np.zeros(len(families)), known, grams, [f for f, *_ in flat], [f"{families[f]}/{k}" for f, k, _ in flat], of_three, naming)

    holds = np.stack([np.isin(vocabulary, g) for g in grams]).astype(np.float32)
    share = _presence(sample[:SAMPLE_SEGMENTS], known, vocabulary) @ holds.T / holds.sum(axis=1)
    background = [s for s, most in zip(sample, share.max(axis=1), strict=False) if most < LEAST_SHARE / 2]
    filler = [w for s in background[:200] for w in s.split()]
    given = [(v, f) for f, _, t in flat for v in _variants(rng, t, filler)]
    given += [(v, len(families) - 1) for t in NEAR_MISSES for v in _variants(rng, t, filler)]
    given += [(s, len(families) - 1) for s in background]
    label = np.array([f for _, f in given])
    every = _presence([s for s, _ in given], known, vocabulary)
    held = rng.random(len(given)) < 0.25
    fit_row, dense = np.flatnonzero(~held), every[~held]
    target = np.zeros((len(fit_row), len(families)), np.float32)
    target[np.arange(len(fit_row)), label[fit_row]] = 1
    weights, bias = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        z = dense @ weights + bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = (z / z.sum(axis=1, keepdims=True) - target) / len(fit_row)
        gradient = dense.T @ error
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        move = RATE / (np.sqrt(second / (1 - 0.99**step)) + 1e-4)
        weights = weights - move * first / (1 - 0.9**step)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - move * LASSO, 0)
        bias -= error.sum(axis=0) * 2
    used = np.flatnonzero(np.abs(weights).sum(axis=1) > 0)
    model.grams, model.weights, model.bias = vocabulary[used], weights[used].astype(float), bias.astype(float)

    heat = _temperature(every[held][:, used] @ model.weights + model.bias, label[held])
    model.weights, model.bias = model.weights / heat, model.bias / heat
    return model


def _presence(segments: list[str], known: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Which n-grams of the vocabulary each segment has, as a table of ones and zeros."""
    hashes, number = word_hashes([s.encode() for s in segments])
    gram, place = _grams(hashes, number.astype(np.int64), known)
    has, at = _member(gram, vocabulary)
    table = np.zeros((len(segments), len(vocabulary)), np.float32)
    table[number[place[has]], at[has]] = 1
    return table


def _temperature(scores: np.ndarray, label: np.ndarray) -> float:
    """The divisor of the scores under which the held-out labels are likeliest."""

    def loss(heat: float) -> float:
        z = scores / heat
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(label)), label]).mean())

    return float(min(np.geomspace(0.25, 8, 41), key=loss))


def corpus_sample(docs: DataFrame, text: str = "text") -> list[str]:
    """Segments of at most ``SAMPLE_ROWS`` bounded texts, those with the smallest hash."""
    rows = docs.select(filled(F.col(text)).alias("text")).filter(F.octet_length("text").between(1, SAMPLE_BYTES))
    rows = rows.withColumn("hash", F.xxhash64("text", F.lit("licences")))
    drawn = F.broadcast(rows.select("hash").distinct().orderBy("hash").limit(SAMPLE_ROWS))  # so many numbers
    chosen = rows.join(drawn, "hash").groupBy("hash").agg(F.min("text").alias("text"))
    texts = [r.text for r in chosen.orderBy("hash").collect()]
    segments = []
    for t in texts:
        for paragraph in re.split(r"\n[^\S\n]*\n", t):
            words = paragraph.split()
            segments += [" ".join(words[k : k + SEGMENT]) for k in range(0, len(words), SEGMENT)]
    rng = np.random.default_rng(SEED)
    return [segments[k] for k in sorted(rng.permutation(len(segments))[:SAMPLE_SEGMENTS])]


_NOTICES = "array<struct<line:bigint,word:bigint,family:string,chance:double,template:string,share:double>>"


def license_scan(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: LicenseModel | None = None) -> DataFrame:
    """One row per row of ``docs``: its licence families and confirmed notices.

    ``line`` and ``word`` of a notice count from 0, lines being those with a word. Null, empty and wordless texts have
    no lines and no families. Copies are scanned alike; an empty table gives an empty result; other columns are
    not read. Columns: file, row, doc_id, n_lines, n_notices, families (sorted, comma-joined; empty for none),
    family (that of the likeliest notice, null for none), chance, share, notices.
    """
    fitted = spark.sparkContext.broadcast(model or train(corpus_sample(docs, text)))  # n-grams of the templates
    rows = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    fields = [("line", pa.int64()), ("word", pa.int64()), ("family", pa.string()), ("chance", pa.float64()), ("template", pa.string()), ("share", pa.float64())]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            n_lines, found = scan(as_bytes(batch.column("text")), fitted.value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("file", "row", "doc_id")), pa.array(n_lines, pa.int64()), pa.array(found, pa.list_(pa.struct(fields)))],
                names=["file", "row", "doc_id", "n_lines", "notices"],
            )

    scanned = in_tasks(rows, per_batch, f"file long, row long, doc_id {kind}, n_lines long, notices {_NOTICES}")
    best = F.array_max(F.transform("notices", lambda n: F.struct(n["chance"].alias("chance"), n["share"].alias("share"), n["family"].alias("family"))))
    return scanned.withColumn("best", best).select(
        "file",
        "row",
        "doc_id",
        "n_lines",
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("notices.family")), ",").alias("families"),
        F.col("best.family").alias("family"),
        F.col("best.chance").alias("chance"),
        F.col("best.share").alias("share"),
        "notices",
    )
