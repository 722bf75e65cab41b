"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of a text, or consecutive lines up to a blank one; long ones are read in overlapping windows of two
sizes, and so are the words of a wrapped paragraph across its line breaks. Its features are hashed word 1-, 2- and
3-grams. A multinomial logistic regression over licence families and "no licence" is fitted on variants of the templates
below (words dropped and put in, names and years set) and on a bounded sample of the table's own lines; a temperature and
the probability from which a family is believed are calibrated by a fit that has not seen one notice of each family. A paragraph that is no plain text but
whose family is not believed, or whose words do not bear out any template of it, is of family ``unknown`` if it shares a
quarter of a template's word pairs or has a word of licences (``LEGAL``); other windows that are no plain text are junk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents
from .textops import U64, Chunk, Hasher, chunks, mix

# Names and notices of public licences, as their stewards word them.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd-3-clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only"],
    "lgpl-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.", "Copyright. All rights reserved."],
}
#: Plain sentences in which words of licences occur.
PLAIN = [
    "The license plate of the car was found near the public road.", "She lost her driving license and asked for a new version.", "The permission of the general was granted by the public office.",
    "This work is a study of the general public and its rights.", "A free copy of the software came with the book.", "The fishing license costs two dollars in version one of the price list.",
    "He was under the impression that the terms were fair.", "All parts of the source were published by the foundation in May.", "The file was released to the press under the new law.", "The commons were open to all, attribution or not.",
]
LEGAL = "license licence licensed licenced licensing licenses licences sublicense copyright copyleft copyrighted warranty warranties redistribute redistribution redistributed".split()
NONE, UNKNOWN = "none", "unknown"
CLASSES = [NONE, *TEMPLATES]
FEATURES, GRAMS = 1 << 15, 3
LONG, STRIDE = 64, 32  # words in a window of a long line, and from one to the next
SHORT, STEP, SHORT_LINE = 12, 4, 16  # the same for notices inside longer text; lines up to SHORT_LINE words are read once
#: Windows of lines that stand for plain text in the fit, at most, and the texts of the table that they come from.
PLAIN_LINES, PLAIN_TEXTS = 1500, 400
VARIANTS, ROUNDS, RATE, DECAY = 24, 80, 2.0, 1e-5
CONFIRMED = 0.6  # of a template's word pairs
HELD_NOTICE = 1  # of each family, for the calibration

_CLEAN = bytes((c + 32 if 65 <= c < 91 else c) if 97 <= c < 123 or 65 <= c < 91 or 48 <= c < 58 or c >= 128 or c == 10 else 32 for c in range(256))


class Paragraphs:
    """Windows of the lines of some texts: features by window, and the word range of each."""

    def __init__(self, texts: list[bytes], hasher: Hasher, fine: bool = True):
        self.chunk = chunk = Chunk([t.translate(_CLEAN) for t in texts])
        words = hasher.words(chunk)
        line = np.cumsum(chunk.buf == 10)[chunk.starts] if len(words) else np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(words) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(words)))
        begin, end, which = [], [], []
        for wide, step, lines in ((LONG, STRIDE, np.arange(len(size))), (SHORT, STEP, np.flatnonzero(size > SHORT_LINE) if fine else np.zeros(0, np.int64))):
            windows = np.maximum(1, -(-(size[lines] - wide) // step) + 1)
            nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            begin.append(np.repeat(first[lines], windows) + nth * step)
            end.append(np.minimum(begin[-1] + wide, np.repeat((first + size)[lines], windows)))
            which.append(np.repeat(lines, windows))
        self.begin, self.end, self.line = np.concatenate(begin), np.concatenate(end), np.concatenate(which)
        of_word = np.repeat(np.arange(len(size)), size)
        if fine and len(words):
            doc = chunk.doc_of_word()
            wrapped = (np.diff(line[first]) == 1) & (doc[first][1:] == doc[first][:-1])
            top = np.flatnonzero(np.concatenate([[True], ~wrapped]))
            start, length = first[top], np.add.reduceat(size, top)
            for wide, step in ((LONG, STRIDE), (SHORT, STEP)):
                windows = np.maximum(1, -(-(length - wide) // step) + 1)
                nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
                a = np.repeat(start, windows) + nth * step
                b = np.minimum(a + wide, np.repeat(start + length, windows))
                across = of_word[a] < of_word[b - 1]
                begin, end, which = [*begin, a[across]], [*end, b[across]], [*which, of_word[a[across]]]
            self.begin, self.end, self.line = np.concatenate(begin), np.concatenate(end), np.concatenate(which)
        self.line_of_word = of_word
        self.doc = chunk.doc_of_word()[self.begin] if len(words) else np.zeros(0, np.int64)
        self.grams = [(hasher.windows(words, k) >> U64(64 - 15)).astype(np.int64) for k in range(1, GRAMS + 1)]
        self.words = words

    def logits(self, weights: np.ndarray) -> np.ndarray:
        out, n = np.zeros((len(self.begin), weights.shape[1]), np.float32), np.zeros(len(self.begin), np.int64)
        for k, bucket in enumerate(self.grams, 1):
            total = np.zeros((len(bucket) + 1, weights.shape[1]), np.float64)
            np.cumsum(weights[bucket], axis=0, out=total[1:])
            a, b = np.minimum(self.begin, len(bucket)), np.minimum(np.maximum(self.end - k + 1, self.begin), len(bucket))
            out += (total[b] - total[a]).astype(np.float32)
            n += b - a
        return out / np.sqrt(np.maximum(n, 1))[:, None]

    def sparse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature and value of every gram of every window."""
        rows, cols, n = [], [], np.zeros(len(self.begin))
        for i, (a, b) in enumerate(zip(self.begin.tolist(), self.end.tolist(), strict=True)):
            own = [g[a : max(a, b - k)] for k, g in enumerate(self.grams)]
            cols += own
            n[i] = sum(map(len, own))
            rows.append(np.full(int(n[i]), i))
        row = np.concatenate(rows)
        return row, np.concatenate(cols), 1 / np.sqrt(n[row])


def variants(rng: np.random.Generator, template: str, filler: list[str]) -> list[str]:
    """The template and changed copies: words dropped, years, names and plain words put in front or behind."""
    words, out = template.split(), [template]
    for _ in range(VARIANTS - 1):
        own = [w for w in words if len(words) < 4 or rng.random() > 0.08]
        if rng.random() < 0.3:
            own = [f"Copyright (c) {rng.integers(1990, 2030)}", "The Authors.", *own]
        if rng.random() < 0.3:
            own = [*own, *["See the file for details.", "for more information", "and its contributors"][int(rng.integers(3)) :][:1]]
        if rng.random() < 0.4 and len(own) < LONG // 2:
            some = [filler[int(i)] for i in rng.integers(len(filler), size=LONG - len(own))]
            cut = int(rng.integers(len(some) + 1))
            own = [*some[:cut], *own, *some[cut:]]
        out.append(" ".join(own) or template)
    return out


def _part(rng: np.random.Generator, words: list[str], size: int) -> str:
    at = int(rng.integers(max(1, len(words) - size + 1)))
    return " ".join(words[at : at + size])


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _fit(grams: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Weights by feature and class, from the windows that ``used`` marks: logistic regression, plain and other windows of equal weight."""
    row, col, value = grams
    keep = used[row]
    row, col, value = row[keep], col[keep], value[keep]
    target = np.eye(len(CLASSES))[y]
    weight_of = np.where(y == 0, len(y) / (2 * max(1, (y == 0).sum())), len(y) / (2 * max(1, (y > 0).sum()))) / max(1, used.sum())
    w, speed = np.zeros((FEATURES, len(CLASSES))), np.zeros((FEATURES, 1))
    cells, where = np.unique(col, return_inverse=True)
    for _ in range(ROUNDS):
        off = (_softmax(_gather(row, len(y), w[col] * value[:, None])) - target) * weight_of[:, None]
        g = _gather(where, len(cells), off[row] * value[:, None]) + DECAY * w[cells]
        speed[cells] += (g**2).sum(1, keepdims=True)
        w[cells] -= RATE * g / np.sqrt(speed[cells] + 1e-12)
    return w.astype(np.float32)


class Model:
    """Weights, temperature, the least probability of a believed family and the templates' word pairs."""

    def __init__(self, plain: list[str], seed: int = 5):
        rng, hasher = np.random.default_rng(seed), Hasher(31)
        plain = [t if rng.random() < 0.5 else _part(rng, t.split(), SHORT) for t in plain]  # the scan reads windows of both sizes
        texts, y = list(plain) + PLAIN * 20, [0] * (len(plain) + 20 * len(PLAIN))
        filler, notice = " ".join(texts).split(), [-1] * len(texts)
        for family, templates in TEMPLATES.items():
            for i, t in enumerate(templates):
                own = [" ".join(v.split()[:LONG]) for v in variants(rng, t, filler)]
                texts, y, notice = texts + own, y + [CLASSES.index(family)] * len(own), notice + [i] * len(own)
        full = Paragraphs([t.replace("\n", " ").encode() for t in texts], hasher, fine=False)
        y, notice = np.array(y)[full.doc], np.array(notice)[full.doc]
        # Temperature and cutoff come of notices whose family the weights know by its other notices alone, and of other plain text.
        held = np.where(notice < 0, rng.random(len(y)) < 0.2, notice == HELD_NOTICE)
        grams = full.sparse()
        logit = full.logits(_fit(grams, y, ~held))[held]
        grid, pick = np.geomspace(0.2, 5, 41), (np.arange(held.sum()), y[held])
        self.temperature = float(grid[int(np.argmin([-np.log(_softmax(logit / t)[pick] + 1e-12).mean() for t in grid]))])
        p = _softmax(logit / self.temperature)
        right = (p.argmax(1) == y[held]) & (y[held] > 0)
        self.believed = float(max(0.5, np.quantile(p.max(1)[right], 0.01))) if right.any() else 0.5
        self.weights = _fit(grams, y, np.ones(len(y), bool))
        self.legal = set(Paragraphs([" ".join(LEGAL).encode()], hasher, fine=False).words.tolist())
        self.pairs = {f: [_pairs(Paragraphs([t.encode()], hasher)) for t in ts] for f, ts in TEMPLATES.items()}
        every = np.array([x for ts in self.pairs.values() for t in ts for x in t], U64)
        self.codes, self.words = np.unique(_code(every[:, 0], every[:, 1])), np.array(sorted(self.legal), U64)

    def hopeful(self, paragraphs: "Paragraphs") -> np.ndarray:
        """Windows that hold a word pair of some template or a word of licences; no other can be named or called unknown."""
        words = paragraphs.words
        pair = np.concatenate([[0], np.cumsum(np.isin(_code(words[:-1], words[1:]), self.codes))])
        word = np.concatenate([[0], np.cumsum(np.isin(words, self.words))])
        a, b = paragraphs.begin, paragraphs.end
        return (word[b] > word[a]) | (pair[np.maximum(b - 1, a)] > pair[a])

    def families(self, paragraphs: Paragraphs) -> Iterator[tuple[int, int, str, float]]:
        """``(text, line, family, probability)`` of the windows that aren't plain text. A notice across line breaks is named at
        each line that it touches; lines that hold a notice of their own don't count for another one.
        """
        if not len(paragraphs.begin):
            return
        p = _softmax(paragraphs.logits(self.weights) / self.temperature)
        line_of, named, marked, loose = paragraphs.line_of_word, set(), set(), set()
        last = line_of[paragraphs.end - 1]
        odd = np.flatnonzero((p[:, 0] < 0.5) & self.hopeful(paragraphs))
        for i in odd[np.argsort(paragraphs.line[odd] < last[odd], kind="stable")]:  # single lines first
            best = 1 + int(p[i, 1:].argmax())
            begin, end, lines = int(paragraphs.begin[i]), int(paragraphs.end[i]), range(int(paragraphs.line[i]), int(last[i]) + 1)
            joined = len(lines) > 1
            words = paragraphs.words[begin:end].tolist()
            at = line_of[begin:end].tolist()
            steps = [(j, (x, y)) for j, (x, y) in enumerate(zip(words, words[1:], strict=False)) if not joined or at[j] not in named and at[j + 1] not in named]
            own = {pair for _, pair in steps} if joined else _pairs(paragraphs, begin, end)
            template = max(self.pairs[CLASSES[best]], key=lambda t: len(own & t) / max(1, len(t)))
            match = len(own & template) / max(1, len(template))
            if p[i, best] >= self.believed and match >= CONFIRMED:
                touched = sorted({at[k] for j, pair in steps if pair in template for k in (j, j + 1)} | loose.intersection(lines)) if joined else lines
                if not joined:
                    named.update(touched)
                marked.update(touched)
                for line in touched:
                    yield int(paragraphs.doc[i]), line, CLASSES[best], float(p[i, best])
            elif not joined or marked.isdisjoint(lines):
                near = max(len(own & t) / max(1, len(t)) for ts in self.pairs.values() for t in ts)
                if near > 0.25 or not self.legal.isdisjoint(words):
                    marked.update(lines)
                    loose.update(() if joined else lines)
                    yield int(paragraphs.doc[i]), lines[0], UNKNOWN, float(1 - p[i, 0])


def _code(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U64(0x9E3779B97F4A7C15) + right)


def _gather(row: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(row, x[:, c], minlength=n) for c in range(x.shape[1])], 1)


def _pairs(paragraphs: Paragraphs, begin: int = 0, end: int | None = None) -> set[tuple[int, int]]:
    words = paragraphs.words[begin:end].tolist()
    return set(zip(words, words[1:], strict=False)) or set(zip(words, words, strict=True))


def _word_pairs(text: str) -> set[tuple[str, str]]:
    words = re.findall(r"\w+", text.lower())
    return set(zip(words, words[1:], strict=False))


FOUND = "doc_id bigint, n_lines bigint, n_licence bigint, families array<string>, probability double"


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(31)
        for table, texts in chunks(batches, size=1 << 19):
            paragraphs = Paragraphs(texts, hasher)
            found: dict[int, dict[int, dict[str, float]]] = {}
            for doc, line, family, p in model.value.families(paragraphs):
                own = found.setdefault(doc, {}).setdefault(line, {})
                own[family] = max(p, own.get(family, 0.0))
            for lines in found.values():
                for own in lines.values():  # a part of a notice that another window knows
                    if len(own) > 1:
                        own.pop(UNKNOWN, None)
            seen = [found.get(i, {}) for i in range(len(texts))]
            read = np.bincount(np.unique(np.stack([paragraphs.doc, paragraphs.line]), axis=1)[0], minlength=len(texts))
            named = [sorted({f for own in x.values() for f in own}) for x in seen]
            best = [max((p for own in x.values() for p in own.values()), default=0.0) for x in seen]
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(read, pa.int64()), pa.array([len(x) for x in seen], pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array(best, pa.float64())], names=["doc_id", "n_lines", "n_licence", "families", "probability"])

    return run


def licence_scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``n_lines`` with words, ``n_licence`` of them with a licence notice, the sorted
    distinct ``families`` (``unknown`` among them) and the highest ``probability``.

    Whole texts are read; a text of any length is read in one piece by its task. The fit sees ``PLAIN_LINES`` windows of ``PLAIN_TEXTS``
    texts of the table at most, by hash of id and content, from anywhere in these texts. Null and empty texts have no lines and no families. Repeated rows are read alike; null ids
    are allowed. An empty table gives an empty one.
    """
    ids = docs.filter("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(19), "doc_id"), "doc_id").limit(PLAIN_TEXTS)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])  # PLAIN_TEXTS ids
    lines = chosen.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    windows = F.regexp_extract_all("line", F.lit(rf"(\S+(?:\s+\S+){{0,{LONG - 1}}})"))
    lines = lines.select(F.explode(windows).alias("line")).distinct()
    notice = F.lower("line").rlike("licen[cs]|copyright|spdx|all rights reserved|permission is hereby|public domain")
    plain = [r.line for r in lines.filter(~notice & (F.length("line") > 3)).orderBy(F.xxhash64("line"), "line").limit(PLAIN_LINES).collect()]
    pairs = {x for ts in TEMPLATES.values() for t in ts for x in _word_pairs(t)}
    plain = [x for x in plain if len(pairs & _word_pairs(x)) < 3]  # lines of wrapped notices
    model = docs.sparkSession.sparkContext.broadcast(Model(plain))
    return docs.select("doc_id", "text").mapInArrow(_scan(model), FOUND)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(documents(spark, sf_dir)).select("doc_id", "n_licence", F.array_join("families", ",").alias("families"))


OP1_SQL = """
WITH line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
hit AS (
  SELECT doc_id, CASE trim(line)
    WHEN 'Licensed under the Apache License, Version 2.0.' THEN 'apache-2.0'
    WHEN 'Licensed under CC BY-NC 4.0.' THEN 'cc-by-nc-4.0'
    WHEN 'All rights reserved.' THEN 'proprietary'
    WHEN 'Released under the MIT License.' THEN 'mit'
    WHEN 'This work is licensed under the GNU General Public License, version 3.' THEN 'gpl-3.0' END AS family
  FROM line)
SELECT d.doc_id, count(family) AS n_licence, coalesce(string_agg(DISTINCT family, ',' ORDER BY family), '') AS families
FROM documents AS d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id
"""
