"""Licence notices in texts, by Dice coefficient over word bigrams.

Texts and templates are normalised alike: lower case, letters and digits only.
A template is compared with runs of words, wherever lines break, from one bigram
that they share to another. The coefficient 2|A and B| / (|A| + |B|) can reach
the threshold only if the run has between t / (2 - t) and (2 - t) / t times the
template's bigrams, so runs outside of these sizes are never compared, nor are
runs that share too few.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Notices by which common licences are granted (public wording).
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-long": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-long": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-long": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = re.compile(r"[^\W_]+")


def bigrams(text: str) -> Counter:
    """Word pairs of the normalised text, with their counts; one word counts as a pair with nothing."""
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter((w, "") for w in words)


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Templates:
    """Templates with an index from bigram to templates."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold = threshold
        self.grams = {k: g for k, t in sorted(texts.items()) if (g := bigrams(t))}
        self.size = {k: sum(g.values()) for k, g in self.grams.items()}
        self.single = {k for k, g in self.grams.items() if any(b == "" for _, b in g)}
        self.having: dict[tuple, list[str]] = {}
        for k, g in self.grams.items():
            for pair in g:
                self.having.setdefault(pair, []).append(k)

    def find(self, text: str) -> list[tuple[int, int, str, float]]:
        """(first line, last line, template, coefficient): the best run of words of each template, then the best template of each run."""
        words: list[str] = []
        starts: list[int] = []
        for line in text.lower().split("\n"):
            starts.append(len(words))
            words += _WORD.findall(line)
        shared: dict[str, list[int]] = {}
        pairs = list(zip(words, words[1:]))
        for each in (pairs, [(w, "") for w in words] if self.single else []):
            for i, pair in enumerate(each):
                for k in self.having.get(pair, ()):
                    shared.setdefault(k, []).append(i)
        found = []
        for k, at in shared.items():
            least = self.size[k] * self.threshold / (2 - self.threshold)
            most = 1 if k in self.single else self.size[k] * (2 - self.threshold) / self.threshold
            grams, size, wide = self.grams[k], self.size[k], 0 if k in self.single else 1
            for f, first in enumerate(at):
                # The pairs in common are at least `least` too.
                if bisect_left(at, first + most, f) - f < least:
                    continue
                seen: dict[tuple, int] = {}
                common = 0
                for last in at[f:]:
                    n = last - first + 1
                    if n > most:
                        break
                    pair = pairs[last] if wide else (words[last], "")
                    seen[pair] = seen.get(pair, 0) + 1
                    common += seen[pair] <= grams[pair]
                    score = 2 * common / (n + size)
                    if score >= self.threshold:
                        found.append((first, last + wide, k, score))
        # Best first; runs that overlap a better one are left out.
        found.sort(key=lambda f: (-f[3], f[1] - f[0], f[0], f[2]))
        taken: list[tuple[int, int, str, float]] = []
        used: set[int] = set()
        for f in found:
            if f[0] not in used and f[1] not in used and used.isdisjoint(range(f[0], f[1] + 1)):
                taken.append(f)
                used.update(range(f[0], f[1] + 1))
        return [(bisect_right(starts, a) - 1, bisect_right(starts, b) - 1, k, score) for a, b, k, score in sorted(taken)]


def _scanned(texts: dict[str, str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts, threshold)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for first, last, name, score in templates.find(text.as_py() or ""):
                    for c, v in zip(out, (doc, name, score, first, last)):
                        c.append(v)
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "license", "dice", "first_line", "last_line"]
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per licence notice in ``docs`` (doc_id, text, ...): doc_id, license, dice, first_line, last_line.

    A notice is a run of words, within a line or over several, whose coefficient
    with a template is at least ``threshold``; of runs that overlap, the closest to a template stays (ties:
    the shorter run, then the earlier, then the template's name). ``templates``
    maps names to texts and is sent to every task: keep it to what a licence
    list holds, megabytes at most. Null and empty texts have no notice; repeated
    rows are scanned again; a null doc_id stays null; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = TEMPLATES if templates is None else templates
    if sum(map(len, texts.values())) > 50_000_000:
        raise ValueError("the templates are too large to send to every task")
    return rows.mapInArrow(_scanned(texts, threshold), "doc_id long, license string, dice double, first_line long, last_line long")
