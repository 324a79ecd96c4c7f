"""Operator 8, license scans: a trained paragraph classifier confirmed by template comparison.

Paragraphs (lines with a word; long ones in overlapping windows) become sparse binary word 1- to
3-grams. A multinomial logistic regression, trained in numpy on variations of the family templates,
on hard negatives and on a bounded sample of corpus paragraphs as the ``unknown`` class, gives family
probabilities; a temperature fitted on a held-out fifth of the training rows calibrates them. A
paragraph is reported when a family beats unknown with at least ``min_probability`` and shares at
least ``min_overlap`` of its (or the template's, if shorter) word pairs with a template of that family.

Every template has one of the cue words, and confirmation needs a template's cue in the paragraph, so
paragraphs without cues are settled without scoring. Rows are judged alone; only the training sample
(``sample_docs`` documents of at most ``max_chars`` characters) reaches the driver, and the model sent
to the tasks has a fixed size.

Defined results: null and empty texts have no paragraphs; repeated rows are reported each; ties of
probability go to the first family by name; with an empty table the result is empty; extra columns are
ignored. Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubrisk.llm.common import map_batches


@dataclass(frozen=True)
class LicenseParams:
    buckets: int = 1 << 14
    variations: int = 40          # training rows per template
    sample_docs: int = 300        # corpus documents that give unknown paragraphs
    max_chars: int = 4000         # longer documents are not used for training
    epochs: int = 200
    rate: float = 0.5
    l2: float = 1e-4
    min_probability: float = 0.6
    min_overlap: float = 0.5
    window: int = 48              # words
    seed: int = 7


UNKNOWN = "unknown"

#: Typical notices of each family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL": ("This program is licensed under the GNU Affero General Public License, version 3.",
             "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
             "SPDX-License-Identifier: AGPL-3.0-only"),
    "Apache": ("Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
               "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause license.",
            "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "Licensed under CC BY 4.0."),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0."),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
            "Released under CC0 1.0 into the public domain.", "This work is dedicated to the public domain."),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.",
            "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
            "Released under the GPL version 2.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
            "Released under the ISC License."),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License, version 2.1.",
             "You can redistribute it under the terms of the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-only"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT"),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Released under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("Copyright, all rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission.",
                    "This document is confidential and proprietary; no license is granted."),
}
#: Sentences with cue words that grant nothing.
NEGATIVES = (
    "He lost his driving license after the accident.", "The city council granted a license to the new restaurant.",
    "The court discussed copyright and permission to publish.", "She is licensed to practice medicine in two states.",
    "The manufacturer gives a two year warranty on parts.", "The apache helicopter landed near the village.",
    "Students at MIT presented a new engine.", "Public parks are in the public domain of the town, said the mayor.",
    "The license plate of the car was never found.", "Poetic license allows a writer to change the facts.",
)
CUE = re.compile(r"licen[sc]|copyright|\bgnu\b|gpl\b|\bmit\b|\bapache\b|\bmozilla\b|creative commons|\bcc[ -]by|\bcc0|spdx|"
                 r"public domain|redistribut|rights reserved|permission", re.I)
LINE = re.compile(r"[^\n]*[^\x20\x09-\x0D][^\n]*")
TOKEN = re.compile(r"[a-z0-9]+(?:[-.][a-z0-9]+)*", re.I)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in TOKEN.findall(text)]


def features(words: list[str], buckets: int) -> np.ndarray:
    grams = {" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(g) % buckets for g in sorted(grams)), np.int64, len(grams)))


def logits(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Features of a row count 1 / sqrt(their number), so long paragraphs do not dominate."""
    out = np.tile(bias, (len(rows), 1))
    for k, f in enumerate(rows):
        if len(f):
            out[k] += weights[f].sum(0) / np.sqrt(len(f))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(unknown: list[str], p: LicenseParams) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(classes, weights, bias, temperature)."""
    rng = np.random.default_rng(p.seed)
    classes = sorted(TEMPLATES) + [UNKNOWN]
    fillers = [w for t in unknown for w in words_of(t)] or ["word"]
    texts: list[tuple[list[str], int]] = []
    for c, family in enumerate(sorted(TEMPLATES)):
        for template in TEMPLATES[family]:
            base = words_of(template)
            for k in range(p.variations):
                words = [w for w in base if k == 0 or rng.random() > 0.05]
                if k % 3 == 1:  # inside a longer paragraph
                    pad = [fillers[int(i)] for i in rng.integers(0, len(fillers), int(rng.integers(1, 9)))]
                    words = words + pad if k % 2 else pad + words
                texts.append((words, c))
    texts += [(words_of(t), len(classes) - 1) for t in unknown]
    for t in NEGATIVES:
        texts += [([w for w in words_of(t) if k == 0 or rng.random() > 0.1], len(classes) - 1) for k in range(p.variations)]
    rows = [features(w, p.buckets) for w, _ in texts]
    y = np.array([c for _, c in texts])
    held = rng.random(len(rows)) < 0.2
    fit = np.nonzero(~held)[0]
    flat = np.concatenate([rows[i] for i in fit])
    owner = np.repeat(np.arange(len(fit)), [len(rows[i]) for i in fit])
    value = 1 / np.sqrt(np.bincount(owner, minlength=len(fit)).clip(1))[owner]
    # Only features of the training rows get weights; the matrix is dense over those.
    used, at = np.unique(flat, return_inverse=True)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(used)))
    row_starts = np.searchsorted(owner, np.arange(len(fit)))
    w, b = np.zeros((len(used), len(classes))), np.zeros(len(classes))
    target = np.eye(len(classes))[y[fit]]
    share = (1 / np.bincount(y[fit], minlength=len(classes)).clip(1))[y[fit]]
    share *= len(fit) / share.sum()
    moment_w, moment_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(p.epochs):
        z = np.add.reduceat(w[at] * value[:, None], row_starts) + b
        g = (softmax(z) - target) * share[:, None] / len(fit)
        gw = np.add.reduceat((g[owner] * value[:, None])[order], starts) + p.l2 * w
        gb = g.sum(0)
        moment_w += gw * gw
        moment_b += gb * gb
        w -= p.rate * gw / np.sqrt(moment_w + 1e-10)
        b -= p.rate * gb / np.sqrt(moment_b + 1e-10)
    weights = np.zeros((p.buckets, len(classes)))
    weights[used] = w
    test = np.nonzero(held)[0]
    z = logits(weights, b, [rows[i] for i in test])

    def loss(t: float) -> float:
        return float(-np.log(softmax(z / t)[np.arange(len(test)), y[test]] + 1e-12).mean()) if len(test) else 0.0
    return classes, weights, b, min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)


def overlap(words: list[str], template: list[str]) -> float:
    """Share of word pairs in common, of the shorter of both."""
    a, b = set(zip(words, words[1:])), set(zip(template, template[1:]))
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def units(text: str, window: int) -> Iterator[tuple[int, int, int]]:
    """(paragraph, start, end) of lines with a cue; lines of over twice the window's words give the
    windows around their cues."""
    for k, line in enumerate(LINE.finditer(text)):
        if not CUE.search(line.group()):
            continue
        tokens = [m.span() for m in TOKEN.finditer(text, *line.span())]
        if len(tokens) <= 2 * window:
            yield k, line.start(), line.end()
            continue
        starts, last = [a for a, _ in tokens], -1
        for cue in CUE.finditer(text, *line.span()):
            j = max(0, int(np.searchsorted(starts, cue.start())) - window // 3)
            if j > last:
                last = j + window // 2
                yield k, tokens[j][0], tokens[min(len(tokens), j + window) - 1][1]


FOUND = "doc_id long, family string, paragraph long, start long, end long, probability double, overlap double"


def sample_paragraphs(docs: DataFrame, p: LicenseParams) -> list[str]:
    """Paragraphs without cues of the ``sample_docs`` documents with the smallest id hashes."""
    short = docs.filter(F.length("text").between(1, p.max_chars))
    top = short.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(p.sample_docs).agg(F.max("h")).first()[0]
    if top is None:
        return []
    rows = short.filter(F.xxhash64("doc_id") <= top).select("doc_id", "text").orderBy(
        F.xxhash64("doc_id"), "text").limit(p.sample_docs).collect()
    return [m.group() for r in rows for m in LINE.finditer(r.text) if not CUE.search(m.group())][:4 * p.sample_docs]


def license_scan(docs: DataFrame, params: LicenseParams = LicenseParams(), doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per confirmed paragraph (or window): family, place, calibrated probability, overlap."""
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sent = src.sparkSession.sparkContext.broadcast(train(sample_paragraphs(src, params), params))  # fixed size
    templates = {f: [words_of(t) for t in ts] for f, ts in TEMPLATES.items()}
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[list[list]]) -> Iterator[dict]:
        classes, weights, bias, temperature = sent.value
        for ids, texts in batches:
            out: dict[str, list] = {n: [] for n in names}
            for i, t in zip(ids, texts):
                if not t or not CUE.search(t):
                    continue
                places = list(units(t, params.window))
                words = [words_of(t[a:b]) for _, a, b in places]
                prob = softmax(logits(weights, bias, [features(w, params.buckets) for w in words]) / temperature)
                for (k, a, b), w, pr in zip(places, words, prob):
                    c = int(np.argmax(pr))
                    if classes[c] == UNKNOWN or pr[c] < params.min_probability:
                        continue
                    share = max(overlap(w, x) for x in templates[classes[c]])
                    if share >= params.min_overlap:
                        for n, v in zip(names, (i, classes[c], k, a, b, float(pr[c]), share)):
                            out[n].append(v)
            yield out
    return map_batches(src, run, FOUND)
