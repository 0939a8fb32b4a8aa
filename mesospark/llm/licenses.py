"""Licence scan: Dice coefficient over word bigrams against licence templates.

A line is parted after each of its sentences, and every run of consecutive parts
is a unit, from one sentence to the whole text. A unit of a bigrams reaches a Dice coefficient t with a template of b only if
``a`` lies between ``b t / (2 - t)`` and ``b (2 - t) / t`` and at least
``b t / (2 - t)`` bigrams are shared; a text that shares fewer is left at once
for that template. Only units that begin and end with a shared bigram's
part are scored, as cutting other parts off can't lower the score. A unit matches a
GNU notice only if it holds the words that tell it from the family's others: which
licence, and which version.

Defined cases: null, empty and wordless texts match nothing; a unit of one word
has that word as its only "bigram"; repeated rows are scanned each; null ids
pass through; other columns are ignored.
"""

import pkgutil
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from mesospark.llm.decontaminate import words_of

#: Notices by which well-known licences are named.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved."],
}
#: Full texts of licences, in license_texts.
FULL_TEXTS = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0"]
for _name in FULL_TEXTS:
    TEMPLATES.setdefault(_name, []).append(pkgutil.get_data(__package__, f"license_texts/{_name}.txt").decode())


#: Notices of one family differ in a word or two, which decide: the name after GNU, and the version.
FAMILY = ("AGPL-", "GPL-", "LGPL-")
NOTICE = 80  # words; longer templates are full texts


def deciding(name: str, words: list) -> set:
    """The bigrams that a text must hold to be matched with a notice, however alike it is otherwise."""
    if not name.startswith(FAMILY) or len(words) > NOTICE:
        return set()
    version = [k for k, w in enumerate(words[:-1]) if w == b"version" and words[k + 1].isdigit()]
    after = {(words[k + 1], words[k + 2]) for k in version if k + 2 < len(words) and words[k + 2].isdigit()}
    return {(words[k], words[k + 1]) for k in version} | after | {p for p in zip(words, words[1:], strict=False) if p[0] == b"gnu"}


PARTS = re.compile(r"\n|(?<=[.;:!?])\s+")


def bigrams(words: list) -> set:
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {(w,) for w in words}


class Scanner:
    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.templates = [(name, bigrams(words_of(t))) for name, texts in sorted(templates.items()) for t in texts]
        self.deciding = [deciding(name, words_of(t)) for name, texts in sorted(templates.items()) for t in texts]
        self.of = defaultdict(list)
        for i, (_, b) in enumerate(self.templates):
            for x in b:
                self.of[x].append(i)
        t, sizes = threshold, [len(b) for _, b in self.templates]
        self.needed = [n * t / (2 - t) - 1e-9 for n in sizes]
        self.most = [n * (2 - t) / t + 1e-9 for n in sizes]
        self.single = any(len(x) == 1 for x in self.of)

    def near(self, words: list) -> list[int]:
        """The templates of which a text of these words holds enough bigrams."""
        shared: dict[int, int] = defaultdict(int)
        own = set(zip(words, words[1:], strict=False))
        if self.single:
            own |= {(w,) for w in words}
        for x in own & self.of.keys():
            for i in self.of[x]:
                shared[i] += 1
        return [i for i, n in shared.items() if n >= self.needed[i]]

    def runs(self, i: int, lines: list[list]) -> tuple[float, set[int]]:
        """The best score of a run of the lines with a template (0 below the threshold), and the lines that match it alone."""
        template, needed, most = self.templates[i][1], self.needed[i], self.most[i]
        best, alone = 0.0, {k for k, w in enumerate(lines) if len(w) == 1 and (w[0],) in template and len(template) == 1}
        if alone:
            return 1.0, alone
        words = [w for line in lines for w in line]
        ids: dict = {}
        pair = [ids.setdefault(x, len(ids)) for x in zip(words, words[1:], strict=False)]
        hit = {k for x, k in ids.items() if x in template}
        if not all(x in ids for x in self.deciding[i]):
            return 0.0, set()
        decide = {ids[x] for x in self.deciding[i]}
        # the pairs of lines a to b are those from begin[a] to last[b] - 1
        begin, last, at = [], [], 0
        for line in lines:
            begin.append(at)
            at += len(line)
            last.append(at - 1)
        begin.append(len(pair))
        ends = {k for k, line in enumerate(lines) if any(pair[p] in hit for p in range(max(0, begin[k] - 1), last[k]))}
        # the next place of each pair: a first line all of whose pairs come again adds nothing
        again, place = [len(pair)] * len(pair), {}
        for p in reversed(range(len(pair))):
            again[p] = place.get(pair[p], len(pair))
            place[pair[p]] = p
        # distinct pairs, and shared ones, in the longest window from each line that is not too large
        held: dict[int, int] = defaultdict(int)
        stop = shared = 0
        for k in range(len(lines)):
            while stop < len(pair) and (pair[stop] in held or len(held) < most):
                shared += pair[stop] in hit and pair[stop] not in held
                held[pair[stop]] += 1
                stop += 1
            if shared >= needed and any(pair[p] in hit for p in range(begin[k], min(begin[k + 1], len(pair)))):
                own: set = set()
                n, p, size = 0, begin[k], -1
                needs = max((self._beyond(again, p, begin[k + 1]) for p in range(begin[k], min(begin[k + 1], len(pair)))), default=0)
                for j in range(k, len(lines)):
                    if p > needs or (j > k and last[j - 1] > needs):
                        break
                    while p < last[j]:
                        if pair[p] not in own:
                            own.add(pair[p])
                            n += pair[p] in hit
                        p += 1
                    if len(own) > most:
                        break
                    if j in ends and len(own) != size:
                        size, score = len(own), 2 * n / (len(own) + len(template))
                        if score >= self.threshold and decide <= own:
                            best = max(best, score)
                            if j == k:
                                alone.add(k)
            for p in range(begin[k], min(begin[k + 1], len(pair))):
                if p < stop:
                    held[pair[p]] -= 1
                    if not held[pair[p]]:
                        del held[pair[p]]
                        shared -= pair[p] in hit
                else:
                    stop = p + 1
        return best, alone

    @staticmethod
    def _beyond(again: list[int], p: int, end: int) -> int:
        while p < end:
            p = again[p]
        return p

    def scan(self, text: str | None) -> tuple[dict[str, float], int]:
        """Best score of each licence found, and the number of lines or sentences that match one by themselves."""
        found: dict[str, float] = {}
        near = self.near(words_of(text)) if text else []
        if not near:
            return found, 0
        lines, alone = [w for x in PARTS.split(text) if (w := words_of(x))], set()
        for i in near:
            score, own = self.runs(i, lines)
            alone |= own
            if score:
                name = self.templates[i][0]
                found[name] = max(found.get(name, 0.0), score)
        return found, len(alone)


def scan_licenses(documents: DataFrame, *, templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """``doc_id, licenses array<string>`` (in order), ``license string`` (the best, ties to the first name), ``score double, n_lines long``."""
    held = documents.sparkSession.sparkContext.broadcast(Scanner(templates, threshold))

    def run(batches):
        scanner = held.value
        for batch in batches:
            names, best, score, lines = [], [], [], []
            for text in batch.column("text").to_pylist():
                found, n = scanner.scan(text)
                names.append(sorted(found))
                best.append(min(found, key=lambda k: (-found[k], k)) if found else None)
                score.append(max(found.values(), default=0.0))
                lines.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.list_(pa.string())), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(lines, pa.int64())], names=["doc_id", "licenses", "license", "score", "n_lines"])

    source = documents.select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, licenses array<string>, license string, score double, n_lines long")
