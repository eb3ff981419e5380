"""Licence statements found by a trained paragraph classifier and confirmed against templates.

Method: lines are classified whole; statements that wrap over lines, or share one, are looked up by
the shingles of templates in runs of lines with words, and the span of words they cover is
classified. A multinomial logistic regression on the presence of word 1- to
3-grams of the templates' words tells licence families from one unknown class. It is trained on
the driver on the templates with words dropped, changed and added, against shuffled and random
word sequences; a temperature and the unknown class's offset are calibrated on a held-out part. A
prediction counts when its calibrated probability is at least ``least`` and a template of that
family has at least ``similarity`` of its five-word shingles in the line or span. A hit is numbered by
its first line; one of the same family on the same line is not repeated.

A line without a known bigram can only be unknown and is passed over. Words are runs of
letters or digits, lower-cased; numbers are one word. Null text: no paragraphs. Repeated rows get
a result each; texts are read whole.
"""

from __future__ import annotations

import random
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Usual licence statements by family.
TEMPLATES = {
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the AGPL, version 3."),
    "all-rights-reserved": ("All rights reserved.", "All rights reserved. No part of this publication may be reproduced", "Unauthorized copying of this file is strictly prohibited."),
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under the Apache License 2.0.", "This work is licensed under the Apache License, Version 2.0."),
    "bsd": ("Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "This work is licensed under the BSD license."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under CC BY 4.0."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under CC BY-NC 4.0."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Released under CC BY-SA 4.0."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GNU General Public License.", "Licensed under the GPL, version 3."),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License."),
    "lgpl": ("This work is licensed under the GNU Lesser General Public License, version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the LGPL, version 3."),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "This work is licensed under the MIT License."),
    "mpl": ("Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License."),
    "public-domain": ("This work is dedicated to the public domain.", "Released into the public domain.", "Licensed under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain."),
}
UNKNOWN = "unknown"
_TOKEN = re.compile(r"[^\W_]+|\n")


def tokens(text: str) -> list[str]:
    """Words and line ends; a word of digits is 0."""
    return ["0" if w.isdigit() else w for w in _TOKEN.findall(text.lower())]


def shingles(words: list[str], n: int = 5) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def contained(template: list[str], words: list[str], n: int = 5) -> float:
    """The share of the template's shingles that stand in ``words``."""
    n = min(n, len(template))
    want = shingles(template, n)
    return len(want & shingles(words, n)) / len(want) if len(words) >= n else 0.0


class Classifier:
    """Weights of known n-grams by family, unknown last."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, seed: int = 11, copies: int = 24, rounds: int = 250):
        self.families = [*sorted(templates), UNKNOWN]
        self.templates = {f: [tokens(t) for t in templates[f]] for f in self.families[:-1]}
        rng = random.Random(seed)
        known = sorted({w for ts in self.templates.values() for t in ts for w in t})
        self.grams: dict[tuple[str, ...], int] = {}
        for ts in self.templates.values():
            for t in ts:
                for n in (1, 2, 3):
                    for i in range(len(t) - n + 1):
                        self.grams.setdefault(tuple(t[i : i + n]), len(self.grams))
        rows, labels = [], []
        for k, f in enumerate(self.families[:-1]):
            for t in self.templates[f]:
                for _ in range(copies):
                    some = [w for w in t if rng.random() > 0.06] or t
                    rows.append(["x"] * rng.randrange(4) + some + ["x"] * rng.randrange(4))
                    labels.append(k)
                for _ in range(copies // 2):
                    mixed = rng.sample(t, len(t))
                    rows.append(mixed[: rng.randint(1, len(mixed))])
                    labels.append(len(self.families) - 1)
        for _ in range(copies * 30):
            rows.append([rng.choice(known) if rng.random() < 0.5 else "x" for _ in range(rng.randint(1, 14))])
            labels.append(len(self.families) - 1)
        x = np.zeros((len(rows), len(self.grams) + 1), np.float32)
        for r, w in enumerate(rows):
            x[r, self.active(w)] = 1
        x[:, -1] = 1
        y = np.array(labels)
        held = np.arange(len(y)) % 4 == 0
        one = np.eye(len(self.families), dtype=np.float32)[y]
        w = np.zeros((x.shape[1], len(self.families)), np.float32)
        speed = np.zeros_like(w)
        a, b = x[~held], one[~held]
        for _ in range(rounds):
            speed = 0.9 * speed - (a.T @ (self._soft(a @ w) - b) / len(a) + 1e-4 * w)
            w += 0.5 * speed
        self.weights = w
        # Calibration: temperature and unknown offset of least held-out loss.
        logits = x[held] @ w
        def loss(t: float, u: float) -> float:
            z = logits / t
            z[:, -1] += u
            return float(-np.log(self._soft(z)[np.arange(len(z)), y[held]] + 1e-12).mean())

        self.temperature, self.offset = min(((t, u) for t in np.linspace(0.2, 3, 29) for u in np.linspace(-2, 2, 17)), key=lambda p: loss(*p))
        self.accuracy = float((logits.argmax(1) == y[held]).mean())

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def active(self, words: list[str]) -> list[int]:
        got = {self.grams.get(tuple(words[i : i + n]), -1) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        return sorted(got - {-1})

    def predict(self, words: list[str]) -> tuple[str, float]:
        z = (self.weights[self.active(words)].sum(0) + self.weights[-1]) / self.temperature
        z[-1] += self.offset
        p = self._soft(z[None])[0]
        k = int(p.argmax())
        return self.families[k], float(p[k])

    def confirm(self, family: str, words: list[str]) -> float:
        return max((contained(t, words) for t in self.templates.get(family, ())), default=0.0)


class Spans:
    """Spans of words that hold most shingles of a template, wherever lines break."""

    def __init__(self, model: Classifier, similarity: float):
        self.at: dict[tuple[str, ...], list[int]] = {}
        self.need: list[tuple[int, float]] = []
        for t in (t for ts in model.templates.values() for t in ts):
            n = min(5, len(t))
            want = shingles(t, n)
            for g in want:
                self.at.setdefault(g, []).append(len(self.need))
            self.need.append((2 * len(t), similarity * len(want)))
        self.sizes = sorted({len(g) for g in self.at})

    def find(self, words: list[str], line: np.ndarray, known: np.ndarray) -> set[tuple[int, int]]:
        """(start, end) of spans; ``line``: each word's line; ``known``: whether a word and the next one, over line ends too, are in a template."""
        met: dict[tuple[int, int], list[tuple[int, tuple[str, ...]]]] = {}
        block = np.cumsum(np.r_[0, np.diff(line) > 1])
        starts = np.flatnonzero(known[:-1] & known[1:] & (block[:-2] == block[2:])) if len(known) > 1 else ()
        for i in map(int, starts):
            for n in self.sizes:
                g = tuple(words[i : i + n])
                if g in self.at and len(g) == n and block[i + n - 1] == block[i]:
                    for t in self.at[g]:
                        met.setdefault((int(block[i]), t), []).append((i, g))
        out = set()
        for (_, t), places in met.items():
            width, need = self.need[t]
            k = 0
            while k < len(places):
                inside = [p for p in places[k:k + width] if p[0] + len(p[1]) <= places[k][0] + width]
                if len({g for _, g in inside}) >= need - 1e-9:
                    out.add((inside[0][0], inside[-1][0] + len(inside[-1][1])))
                    k += len(inside)
                else:
                    k += 1
        return out


HIT = "paragraph int, family string, probability double, similarity double, text string"


def license_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, similarity: float = 0.8, model: Classifier | None = None) -> DataFrame:
    """(id, n_paragraphs, hits): the confirmed statements of every row, paragraphs numbered from 0."""
    model = model or Classifier()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        vocab = {w: k + 2 for k, w in enumerate(sorted({w for g in model.grams for w in g}))}
        vocab["\n"] = 1
        width = len(vocab) + 2
        spans = Spans(model, similarity)
        pair = np.zeros(width * width, bool)
        for g in model.grams:
            if len(g) == 2:
                pair[vocab[g[0]] * width + vocab[g[1]]] = True
        get = vocab.get
        seen: dict[tuple, tuple] = {}

        def judge(key: tuple) -> tuple:
            if key not in seen:
                if len(seen) > 10_000:
                    seen.clear()
                family, probability = model.predict(list(key))
                seen[key] = (family, probability, model.confirm(family, list(key)))
            return seen[key]

        for batch in batches:
            counts, hits = [], []
            for _, texts in text_slices(batch, 1):
                for text in texts:
                    lines = (text or "").split("\n")
                    counts.append(sum(1 for p in lines if p.strip()))
                    found = []
                    all_words = tokens(text or "")
                    all_ids = np.fromiter(map(get, all_words, repeat(0)), np.int64, len(all_words))
                    word = np.flatnonzero(all_ids != 1)
                    ids, line = all_ids[word], np.cumsum(all_ids == 1)[word]
                    known = pair[ids[:-1] * width + ids[1:]]
                    if known.any():
                        words = [all_words[k] for k in word.tolist()]
                        tried = [(int(a), int(b)) for a, b in ((np.searchsorted(line, p), np.searchsorted(line, p, "right")) for p in np.unique(line[:-1][known & (line[:-1] == line[1:])]))]
                        taken = set()
                        for a, b in [*tried, *sorted(spans.find(words, line, known))]:
                            family, probability, match = judge(tuple(words[a:b]))
                            first, last = int(line[a]), int(line[b - 1])
                            if family != UNKNOWN and probability >= least and match >= similarity and not any((family, p) in taken for p in range(first, last + 1)):
                                taken.update((family, p) for p in range(first, last + 1))
                                found.append({"paragraph": first, "family": family, "probability": probability, "similarity": match, "text": "\n".join(lines[first : last + 1])})
                        found.sort(key=lambda h: h["paragraph"])
                    hits.append(found)
            kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("text", pa.string())]))
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, kind)], names=["id", "n_paragraphs", "hits"])

    fields = ", ".join(f.replace(" ", ": ", 1) for f in HIT.split(", "))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, n_paragraphs long, hits array<struct<{fields}>>")
