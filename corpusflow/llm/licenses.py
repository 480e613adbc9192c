"""License scans: sparse TF-IDF cosine to templates, then directory inheritance.

Every line of every whole text, and every run of neighbouring licence-like lines,
is compared with the templates by the cosine of sparse TF-IDF vectors. So is every
stretch of words round a cue, of up to one and a half times a template's length and
wherever the line ends are, that starts and ends in words of the template: a notice
is found inside a longer line. As such a stretch is cut to fit, its cosine must
reach ``WINDOW`` if that is above the threshold. Document
frequencies of the templates' terms come from one pass over all documents; a term
that no template has weighs as one that no document has. Lines without a rare
template term can't reach the threshold (checked against the templates' norms)
and aren't scored. Versions of a licence are told apart by templates of their own
and by words that must be there (``MUST``).

A file whose text is mostly licence, or that is named like one, licenses its
directory. Other files without a licence of their own inherit from the nearest
ancestor directory, by joins over paths: distinct directories find their
ancestors first, then files join their directory with the key salted.

Defined cases: null or empty texts have no licence of their own and may inherit;
a null path is a file of no directory; repeated rows each get a row; of equal
cosines the longer template wins, then the first by name; of several licence files in a directory
the largest cosine, then the first name.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import lists, materialize, record

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD2 = (
    _BSD + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def _gnu(what: str, name: str, version: str) -> str:
    return f"{what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."


# versions and variants have templates of their own, which score higher than their relatives' where the text tells them apart
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        _gnu("This program", "General Public License", "3"),
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        _gnu("This program", "General Public License", "2"),
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        _gnu("This library", "Lesser General Public License", "2.1"),
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        _gnu("This library", "Lesser General Public License", "3"),
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        _gnu("This program", "Affero General Public License", "3"),
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD2),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", _BSD, _BSD2 + _BSD3),
    "ISC": (
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": (
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
}
# without one word of each group what was compared isn't that licence, however similar its relatives' texts are
MUST: dict[str, tuple[frozenset[bytes], ...]] = {
    "GPL-2.0": (frozenset([b"2"]),),
    "GPL-3.0": (frozenset([b"3"]),),
    "LGPL-2.1": (frozenset([b"lesser", b"lgpl"]), frozenset([b"2"])),
    "LGPL-3.0": (frozenset([b"lesser", b"lgpl"]), frozenset([b"3"])),
    "AGPL-3.0": (frozenset([b"affero", b"agpl"]),),
}
LICENSE_NAME = r"(?i)^(un)?licen[cs]e|^copying|^notice"
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c == 10 or 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SALTS = 16
WINDOW = 0.8


def flat(text: str | None) -> bytes:
    """Lower case, with everything but letters, digits and line ends as a space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS)


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.rows = sorted((name, tuple(flat(t).split())) for name, ts in templates.items() for t in ts)
        self.must = [MUST.get(name, ()) for name, _ in self.rows]
        self.vocab = {w: i for i, w in enumerate(sorted({w for _, ws in self.rows for w in ws}))}

    def weigh(self, df: np.ndarray, n: int, threshold: float) -> None:
        self.idf = np.log((1 + n) / (1 + df)) + 1
        self.unseen = math.log(1 + n) + 1
        self.vectors, self.names = [], [name for name, _ in self.rows]
        for _, ws in self.rows:
            v = {}
            for w in ws:
                v[w] = v.get(w, 0) + float(self.idf[self.vocab[w]])
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append({w: x / norm for w, x in v.items()})
        cut = np.sort(self.idf)[::-1].tolist()
        self.cues = frozenset(self.vocab)
        for c in cut:  # the fewest rare terms without one of which no cosine reaches the threshold
            cues = frozenset(w for w, i in self.vocab.items() if self.idf[i] >= c)
            if all(sum(x * x for w, x in v.items() if w not in cues) < threshold**2 for v in self.vectors):
                self.cues = cues
                break
        self.by_word: dict[bytes, list[tuple[int, float]]] = {}
        for k, v in enumerate(self.vectors):
            for w, x in v.items():
                self.by_word.setdefault(w, []).append((k, x))

    def order(self, cosine: float, k: int) -> tuple[float, int, int]:
        """What is better: the larger cosine, then the longer template, then the first by name."""
        return round(cosine, 12), len(self.rows[k][1]), -k

    def best(self, ws: list[bytes]) -> tuple[float, int]:
        """The largest cosine of the words with a template, and which."""
        tf: dict[bytes, int] = {}
        for w in ws:
            tf[w] = tf.get(w, 0) + 1
        dot: dict[int, float] = {}
        norm = 0.0
        for w, c in tf.items():
            i = self.vocab.get(w)
            x = c * (self.unseen if i is None else float(self.idf[i]))
            norm += x * x
            for k, y in self.by_word.get(w, ()):
                dot[k] = dot.get(k, 0.0) + x * y
        dot = {k: x for k, x in dot.items() if not any(g.isdisjoint(tf) for g in self.must[k])}
        if not dot:
            return 0.0, -1
        k = max(dot, key=lambda k: self.order(dot[k], k))
        return dot[k] / math.sqrt(norm), k

    def windows(self, ws: list[bytes], cues: list[int], bar: float) -> list[tuple[float, int, int, int]]:
        """(cosine, template, first word, last word + 1) of a template's stretches round the cues, best ones first, without overlaps."""
        out, present = [], {w for w in set(ws) if w in self.vocab}
        for k, v in enumerate(self.vectors):
            if sum(x * x for w, x in v.items() if w in present) < bar**2 - 1e-9:  # no stretch of this text has a larger cosine
                continue
            reach = len(self.rows[k][1]) * 3 // 2
            starts = {i for c in cues if ws[c] in v for i in range(max(0, c - reach + 1), c + 1) if ws[i] in v}
            fits = []
            for i in starts:
                tf: dict[bytes, int] = {}
                dot, norm, best = 0.0, 0.0, (0.0, 0)
                for j in range(i, min(len(ws), i + reach)):
                    w = ws[j]
                    c = tf.get(w, 0)
                    tf[w] = c + 1
                    n = self.vocab.get(w)
                    x = self.unseen if n is None else float(self.idf[n])
                    norm += (2 * c + 1) * x * x
                    if w in v:
                        dot += x * v[w]
                        if dot / math.sqrt(norm) > best[0]:
                            best = (dot / math.sqrt(norm), j + 1)
                if best[0] >= bar and not any(g.isdisjoint(ws[i : best[1]]) for g in self.must[k]):
                    fits.append((best[0], k, i, best[1]))
            taken: list[tuple[float, int, int, int]] = []
            for f in sorted(fits, key=lambda f: (-round(f[0], 12), f[2])):
                if all(f[3] <= t[2] or f[2] >= t[3] for t in taken):
                    taken.append(f)
            out += taken
        return out

    def scan(self, text: str | None, threshold: float) -> tuple[str | None, float, int, int]:
        """(licence, cosine, words in licence lines, words) of a text."""
        b = flat(text)
        ws = b.split()
        if self.cues.isdisjoint(ws):
            return None, 0.0, 0, len(ws)
        top, run, at = (0.0, -1), [], 0
        held, exact = bytearray(len(ws)), bytearray(len(ws))
        for line in [*b.split(b"\n"), b""]:
            own = line.split()
            at += len(own)
            if own and not self.cues.isdisjoint(own):
                run.append(own)
                continue
            if run:
                ends = np.cumsum([len(x) for x in run]) + at - len(own) - sum(map(len, run))
                spans = [(int(e) - len(x), int(e)) for x, e in zip(run, ends)]
                found = [self.best(x) for x in run]
                if len(run) > 1:
                    found.append(self.best([w for x in run for w in x]))
                    spans.append((spans[0][0], spans[-1][1]))
                for (c, _), (i, j) in zip(found, spans):
                    if c >= threshold:
                        held[i:j] = b"\1" * (j - i)
                    if c >= 1 - 1e-9:
                        exact[i:j] = b"\1" * (j - i)
                for c, k in found:
                    if k >= 0 and self.order(c, k) > self.order(*top):
                        top = (c, k)
                run = []
        for c, k, i, j in self.windows(ws, [i for i, w in enumerate(ws) if w in self.cues and not exact[i]], max(WINDOW, threshold)):
            held[i:j] = b"\1" * (j - i)
            if self.order(c, k) > self.order(*top):
                top = (c, k)
        if top[0] < threshold:
            return None, top[0], 0, len(ws)
        return self.names[top[1]], top[0], sum(held), len(ws)


def _frequencies(t: Templates):
    def run(batches):
        df, n, vocab = np.zeros(len(t.vocab), np.int64), 0, frozenset(t.vocab)
        for b in batches:
            for text in lists(b, "text")[0]:
                n += 1
                for w in vocab.intersection(flat(text).split()):
                    df[t.vocab[w]] += 1
        yield record(term=(np.arange(-1, len(df)), pa.int64()), n=(np.r_[n, df], pa.int64()))

    return run


def _scan(t: Templates, threshold: float):
    def run(batches):
        for b in batches:
            ids, paths, texts = lists(b, "doc_id", "path", "text")
            got = [t.scan(x, threshold) for x in texts]
            yield record(
                doc_id=(ids, pa.int64()), path=(paths, pa.string()), own=([g[0] for g in got], pa.string()), cosine=([g[1] for g in got], pa.float64()),
                license_words=([g[2] for g in got], pa.int64()), n_words=([g[3] for g in got], pa.int64()),
            )

    return run


def scan_licenses(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.6, file_share: float = 0.5) -> DataFrame:
    """One row per file: doc_id, path, own, cosine, is_license_file, license, inherited_from (a directory, or null)."""
    t = Templates(TEMPLATES if templates is None else templates)
    d = files.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), path.cast("string").alias("path"), F.col(f"`{text_col}`").alias("text"))
    df, n = np.zeros(len(t.vocab), np.int64), 0
    for r in d.select("text").mapInArrow(_frequencies(t), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row per template term
        if r[0] < 0:
            n = r[1]
        else:
            df[r[0]] = r[1]
    t.weigh(df, n, threshold)
    found = d.mapInArrow(_scan(t, threshold), "doc_id long, path string, own string, cosine double, license_words long, n_words long")
    name = F.regexp_extract(F.coalesce("path", F.lit("")), r"[^/]*$", 0)
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/+$", "")
    is_file = F.col("own").isNotNull() & (name.rlike(LICENSE_NAME) | (F.col("license_words") >= file_share * F.col("n_words")))
    found = materialize(found.withColumn("dir", folder).withColumn("is_license_file", is_file).withColumn("row", F.monotonically_increasing_id()), "licenses")
    order = Window.partitionBy("dir").orderBy(F.col("cosine").desc(), "own")
    tops = found.filter("is_license_file AND dir IS NOT NULL").groupBy("dir", "own").agg(F.max("cosine").alias("cosine"))  # few rows a directory before the window
    licensed = tops.withColumn("k", F.row_number().over(order)).filter("k = 1").select(F.col("dir").alias("above"), F.col("own").alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))
    dirs = found.filter("dir IS NOT NULL AND own IS NULL").select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.*")
    nearest = dirs.join(licensed, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    files_ = found.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).withColumn("key", F.when(F.col("own").isNull(), F.col("dir")))
    out = files_.join(salted.withColumnRenamed("dir", "key"), ["key", "salt"], "left")
    return out.select("doc_id", "path", "own", "cosine", "is_license_file", F.coalesce("own", F.col("near.given")).alias("license"), F.col("near.above").alias("inherited_from"))
