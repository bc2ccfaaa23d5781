"""License scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

A unit is a window of a text's words as long as the template it is held against; line breaks and comment marks do not
count, so a wrapped notice is found like any other. Words that no template has weigh as the middling word of the templates,
so a window with foreign words is less like a template. A template also has words that decide: without its version number
or variant a window does not match, and neither does it with the word of a sister licence.

All windows are scored, by running sums: a word's product with the template's is added as it enters and taken off as it leaves.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import Workspace, column, sliced, texts


@dataclass(frozen=True)
class Template:
    """A notice: every word of need must be in a window, and none of bar in it or right after it. elsewhere, absent: words that the whole text must have or must not have."""

    licence: str
    text: str
    need: str
    bar: str = ""
    elsewhere: str = ""
    absent: str = ""


# Names and notices of public licences, in the words that their authors ask for.
_GNU = [  # SPDX name, name in words, version, what tells it from its sisters
    ("GPL-2.0", "GNU General Public License", "2", "", "lesser affero library"),
    ("GPL-3.0", "GNU General Public License", "3", "", "lesser affero library"),
    ("LGPL-2.0", "GNU Library General Public License", "2", "library", "lesser affero"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "lesser", "affero"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "lesser", "affero"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "affero", "lesser"),
]
_GNU_NOTICES = [
    "Licensed under the {name}, version {version}.",
    "This work is licensed under the {name}, version {version}.",
    "{name} Version {version}",
    "{name} v{version}",
    "This program is free software; you can redistribute it and/or modify it under the terms of the {name} version {version}",
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
]
_CREATIVE = [  # SPDX name, short name, variant, the variants it is not
    ("CC-BY-4.0", "CC BY 4.0", "Attribution 4.0 International", "sa nc nd sharealike noncommercial noderivatives noderivs"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Attribution-ShareAlike 4.0 International", "nc nd noncommercial noderivatives noderivs"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Attribution-NonCommercial 4.0 International", "sa nd sharealike noderivatives noderivs"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0", "Attribution-NoDerivatives 4.0 International", "sa nc sharealike noncommercial"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "Attribution-NonCommercial-ShareAlike 4.0 International", "nd noderivatives noderivs"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0", "Attribution-NonCommercial-NoDerivatives 4.0 International", "sa sharealike"),
]
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_OTHERS = [
    Template("MIT", "Released under the MIT License.", "mit"),
    Template("MIT", "Licensed under the MIT license.", "mit"),
    Template("MIT", "The MIT License (MIT) Copyright", "mit"),
    Template("MIT", _GRANT + " (the Software), to deal in the Software without restriction", "permission granted charge deal"),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2"),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "apache 2"),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004", "apache 2"),
    Template("BSD-3-Clause", _BSD, "redistribution binary permitted", elsewhere="neither endorse"),
    Template("BSD-2-Clause", _BSD, "redistribution binary permitted", absent="neither"),
    Template("BSD-3-Clause", "Released under the BSD 3-Clause License.", "bsd 3 clause"),
    Template("BSD-2-Clause", "Released under the BSD 2-Clause License.", "bsd 2 clause"),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", "permission fee granted provided"),
    Template("ISC", "Released under the ISC License.", "isc"),
    Template("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS", "permission fee granted as", bar="notice"),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered domain"),
    Template("Unlicense", "Released under the Unlicense.", "unlicense"),
    Template("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "authors liable arising"),
    Template("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", "boost 1"),
    Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost 1"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2"),
    Template("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla 2"),
    Template("EPL-1.0", "Eclipse Public License - v 1.0", "eclipse 1"),
    Template("EPL-2.0", "Eclipse Public License - v 2.0", "eclipse 2"),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse 2"),
    Template("CC0-1.0", "Dedicated to the public domain under CC0 1.0.", "cc0 1"),
    Template("CC0-1.0", "CC0 1.0 Universal", "cc0 1"),
]
#: Names of licence files, in any case, with or without an ending.
FILE_NAMES = ("license", "licence", "copying", "unlicense")
THRESHOLD = 0.8
#: Words of a text that are scored at once.
AT_ONCE = 1 << 16
_WORD = re.compile(r"[^\W_]+")


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _templates() -> list[Template]:
    """All notices: those above and the regular ones of the GNU and Creative Commons families."""
    made = list(_OTHERS)
    for licence, name, version, own, others in _GNU:
        number = version.replace(".", " ")
        for notice in _GNU_NOTICES:
            tail = f"v{version}".split(".")[0] if " v{" in notice else number.split()[0]
            need = f"general public {own} {tail} {' '.join(number.split()[1:])}"
            made.append(Template(licence, notice.format(name=name, version=version), need, others))
    for licence, short, long, others in _CREATIVE:
        made.append(Template(licence, f"Licensed under {short}.", " ".join(terms(short)), others))
        made.append(Template(licence, f"Creative Commons {long}", "creative commons " + " ".join(terms(long)), others))
        made.append(Template(licence, f"This work is licensed under a Creative Commons {long} License.", "creative commons " + " ".join(terms(long)), others))
    return made


TEMPLATES = _templates()
VOCABULARY = sorted({w for t in TEMPLATES for w in terms(f"{t.text} {t.need} {t.bar} {t.elsewhere} {t.absent}")})


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many of all documents each vocabulary word occurs, and how many there are. As many rows as words come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        known = frozenset(VOCABULARY)
        for batch in sliced(batches):
            for t in texts(batch):
                counts.update(known.intersection(terms(t)))
            counts[""] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    plain = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    found = {r["word"]: r["n"] for r in plain.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop("", 0)


def _cosines(words: np.ndarray, size: int, gain: np.ndarray, weight: np.ndarray, twins: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The cosine of each window of `size` words to a template (unit vector times weight: gain), by running sums.

    words: numbers, 0 for foreign words, each of which counts by itself. twins: places (p, q), p < q, of equal known words.
    """
    starts = len(words) - size + 1
    square = weight[words] ** 2
    total = lambda x: np.append(0, np.cumsum(x))
    dot, norm = total(gain[words]), total(square)
    dot, norm = dot[size:] - dot[:-size], norm[size:] - norm[:-size]
    p, q = twins
    near = q - p < size
    p, q = p[near], q[near]
    low, high = np.maximum(q - size + 1, 0), np.minimum(p, starts - 1)  # windows that hold both
    fits = low <= high
    step = np.zeros(starts + 1)
    np.add.at(step, low[fits], 2 * square[p[fits]])
    np.add.at(step, high[fits] + 1, -2 * square[p[fits]])
    return dot / np.sqrt(np.maximum(norm + np.cumsum(step)[:-1], 1e-12))


def _twins(words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal known words less than `reach` apart."""
    at = np.flatnonzero(words)
    at = at[np.argsort(words[at], kind="stable")]
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for lag in range(1, reach):
        p, q = at[:-lag], at[lag:]
        near = (words[p] == words[q]) & (q - p < reach)
        if not near.any():
            break
        left.append(p[near])
        right.append(q[near])
    return np.concatenate(left), np.concatenate(right)


@dataclass
class Index:
    """Templates as unit vectors over VOCABULARY; weight[0] is that of a foreign word."""

    weight: np.ndarray

    @classmethod
    def build(cls, frequencies: dict[str, int], documents: int) -> Index:
        idf = [math.log((1 + documents) / (1 + frequencies.get(w, 0))) + 1 for w in VOCABULARY]
        return cls(np.array([float(np.median(idf)), *idf]))

    @functools.cached_property
    def number(self) -> dict[str, int]:
        return {w: i + 1 for i, w in enumerate(VOCABULARY)}

    @functools.cached_property
    def vectors(self) -> list[tuple[Template, int, np.ndarray, list[list[int]]]]:
        """Each template with its size, its unit vector times the weights, and the numbers of its deciding words."""
        out = []
        for t in TEMPLATES:
            own = np.zeros(len(self.weight))
            for w, n in Counter(terms(t.text)).items():
                own[self.number[w]] = n * self.weight[self.number[w]]
            out.append((t, len(terms(t.text)), own / np.linalg.norm(own) * self.weight, [[self.number[w] for w in terms(x)] for x in (t.need, t.bar, t.elsewhere, t.absent)]))
        return out

    @functools.cached_property
    def sign(self) -> re.Pattern:
        """What a text must have one of to match at all: each template's first deciding words, as words of their own."""
        first = sorted({w for t in TEMPLATES for w in [max(terms(t.need), key=lambda w: (len(w), w))]})
        return re.compile(rf"(?<![^\W_])(?:{'|'.join(first)})(?![^\W_])")

    def scan(self, text: str) -> tuple[float, str]:
        """The best cosine of any window and its licence, the first name of equals; (0, '') under the threshold."""
        best = (0.0, "")
        low = text.lower()
        if not self.sign.search(low):
            return best
        words = _WORD.findall(low)
        ids = np.array([self.number.get(w, 0) for w in words], dtype=np.int64)
        held = set(np.unique(ids).tolist())
        able = [v for v in self.vectors if held.issuperset(v[3][0] + v[3][2]) and held.isdisjoint(v[3][3])]
        if not able:
            return best
        longest = max(size for _, size, _, _ in able)
        for at in range(0, len(ids), AT_ONCE):
            part = ids[at : at + AT_ONCE + longest]  # a window that begins in this run ends in it
            twins = _twins(part, longest)
            for template, size, gain, (need, bar, _, _) in able:
                size = min(size, len(part))
                found = _cosines(part, size, gain, self.weight, twins)
                for i in np.flatnonzero(found >= max(THRESHOLD, best[0] - 1e-9)).tolist():
                    window = set(part[i : i + size].tolist())
                    if not window.issuperset(need) or not window.isdisjoint(bar) or part[i + size : i + size + 1].tolist() in [[b] for b in bar]:
                        continue
                    x = float(found[i])
                    if x > best[0] + 1e-9 or (abs(x - best[0]) <= 1e-9 and template.licence < best[1]):
                        best = (x, template.licence)
        return best


_FOUND = "row long, doc_id long, path string, is_file boolean, licence string, cosine double"


def is_licence_file(path):
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.regexp_replace(name, r"\..*$", "").isin(*FILE_NAMES)


def scan_notices(docs: DataFrame, index: Index, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """A row per document: its own licence by notice or licence file, null for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [index.scan(t) for t in texts(batch)]
            kept = [column(batch, n) for n in ("row", "_id", "path", "is_file")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([n or None for _, n in found], pa.string()), pa.array([x for x, _ in found], pa.float64())], names=["row", "doc_id", "path", "is_file", "licence", "cosine"])

    path = F.regexp_replace(F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")), "/+", "/")
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("_id"), path.alias("path"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    return plain.withColumn("is_file", is_licence_file(F.col("path"))).select("row", "_id", "path", "is_file", "_text").mapInArrow(run, _FOUND)


def inherit(found: DataFrame) -> DataFrame:
    """Adds basis and licence_dir: rows without a licence take that of the nearest directory above with a licence file.

    Directories are made distinct before they meet their ancestors, so a directory with a third of all rows is one row in
    the path joins; only the last join, which hands a directory's licence to its rows, sees them all, and it can be split.
    """
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    rows = found.withColumn("dir", parent)
    stated = rows.where("is_file and licence is not null").groupBy("dir").agg(F.max(F.struct(F.col("cosine"), F.col("licence"))).alias("best"))
    stated = stated.select(F.col("dir").alias("licence_dir"), F.col("best.licence").alias("dir_licence"))
    parts = F.split("dir", "/")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit("")))
    asked = rows.where("licence is null").select("dir").distinct()
    met = asked.select("dir", F.explode(F.array_distinct(above)).alias("licence_dir")).join(stated, "licence_dir")
    nearest = met.groupBy("dir").agg(F.max(F.struct(F.length("licence_dir"), "licence_dir", "dir_licence")).alias("n")).select("dir", "n.licence_dir", "n.dir_licence")
    own = F.col("licence").isNotNull()
    joined = rows.join(nearest, "dir", "left")
    basis = F.when(own & F.col("is_file"), "file").when(own, "notice").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return joined.select("doc_id", "path", F.coalesce("licence", "dir_licence").alias("licence"), basis.alias("basis"), "cosine", F.when(own, F.when(F.col("is_file"), F.col("dir"))).otherwise(F.col("licence_dir")).alias("licence_dir"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """doc_id, path, licence (null for none), basis (file, notice, inherited, none), cosine, licence_dir for each row of docs.

    A row's own licence is that of the window of its text that is most like a template, at a cosine of THRESHOLD or more; of
    equal ones the first name. A text with fewer words than a template is one window, however long its lines are. A null text is empty; a null path is a file without a name in the root, so it inherits the root's licence at most.
    Rows that repeat an id or a path stay apart. Two licence files in a directory: the higher cosine counts, then the
    later name. Empty table: empty result. Other columns are not read.
    """
    space = Workspace(docs.sparkSession, "licences")
    index = Index.build(*document_frequencies(docs, text_col))
    return inherit(space.save(scan_notices(docs, index, id_col, text_col, path_col), "found"))
