import math
import textwrap
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from chronoframe.llm import licences

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("dir", T.StringType()), T.StructField("licence", T.StringType())])
ROWS = [
    (1, "a/LICENSE", "This work is licensed under the GNU General Public License, version 3.", "", ""),
    (2, "a/b/x.py", "plain code", "", ""),
    (3, "a/b/LICENCE.txt", "Notes\nReleased under the MIT License.\nmore", "", ""),
    (4, "a/b/c/d.py", "", "", ""),
    (5, "a/y.py", None, "", ""),
    (6, "other/z.py", "the license of the version", "", ""),
    (7, "other/w.py", "filler words here\nLicensed under CC BY-NC 4.0.", "", ""),
    (8, "ab/x.py", "not below a", "", ""),
    (9, None, "no path", "", ""),
    (None, "a//b/q", "null id", "", ""),
    (10, "other/long.py", "many words " * 40 + "Licensed under the Apache License, Version 2.0. " + "and more " * 40, "", ""),
    (2, "a/b/x.py", "plain code", "", ""),
]


def slow_best(rows, text):
    """Cosine of every window to every template, word by word."""
    docs = [set(licences.terms(r[2] or "")) for r in rows]
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1 for w in licences.VOCABULARY}
    foreign = float(np.median(list(idf.values())))

    def vector(words):
        own = {w: n * idf[w] for w, n in Counter(w for w in words if w in idf).items()}
        return own, math.sqrt(sum(x * x for x in own.values()) + foreign**2 * sum(w not in idf for w in words))

    words, best = licences.terms(text), (0, "")
    for t in licences.TEMPLATES:
        own, size = vector(licences.terms(t.text))
        n = min(len(licences.terms(t.text)), len(words))
        need, bar, elsewhere, absent = (set(licences.terms(x)) for x in (t.need, t.bar, t.elsewhere, t.absent))
        if not n or not elsewhere <= set(words) or absent & set(words):
            continue
        for i in range(len(words) - n + 1):
            window = words[i : i + n]
            if not need <= set(window) or bar & set(words[i : i + n + 1]):
                continue
            here, norm = vector(window)
            x = sum(v * own.get(w, 0) for w, v in here.items()) / (size * norm)
            if x >= licences.THRESHOLD and (x > best[0] + 1e-9 or (abs(x - best[0]) <= 1e-9 and t.licence < best[1])):
                best = (x, t.licence)
    return best


def test_notices_files_and_inheritance(spark):
    got = licences.scan(spark.createDataFrame(ROWS, DOCS)).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: (r["licence"], r["basis"], r["licence_dir"]) for r in got}
    assert by == {
        1: ("GPL-3.0", "file", "a"), 2: ("MIT", "inherited", "a/b"), 3: ("MIT", "file", "a/b"), 4: ("MIT", "inherited", "a/b"), 5: ("GPL-3.0", "inherited", "a"),
        6: (None, "none", None), 7: ("CC-BY-NC-4.0", "notice", None), 8: (None, "none", None), 9: (None, "none", None), None: ("MIT", "inherited", "a/b"), 10: ("Apache-2.0", "notice", None),
    }


def wrapped(text, columns, mark):
    return "\n".join(mark + line for line in textwrap.wrap(text, columns))


def test_own_licence_against_every_window(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i, t in enumerate(licences.TEMPLATES):
        body = f"line {i} of a text.\n" + wrapped(t.text, int(rng.integers(40, 100)), ("", "# ", " * ", "// ")[i % 4]) + "\nthe public domain software files"
        rows.append((i, f"d{i}/f.py", body + (" neither the name may be used to endorse" if t.elsewhere else ""), "", ""))
        words = t.text.split()
        words[rng.integers(0, len(words))] = "other"
        rows.append((1000 + i, f"e{i}/f.py", " ".join(words) + " and the license and the license of the the the version 2 2 2 software", "", ""))
    rows += [(5000, "e/f", "Licensed under the terms of a License", "", ""), (5001, "e/g", "MIT", "", ""), (5002, "e/h", "license", "", ""), (5003, "e/i", "mit apache gnu " * 50, "", "")]
    got = {r["doc_id"]: (r["licence"] or "", r["cosine"]) for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect()}
    for r in rows:
        cosine, name = slow_best(rows, r[2])
        assert got[r[0]][0] == name and abs(got[r[0]][1] - cosine) < 1e-6, r
    assert all(got[i][0] == t.licence for i, t in enumerate(licences.TEMPLATES))


def test_sister_licences_are_told_apart():
    index = licences.Index.build({"the": 900, "license": 30, "under": 500, "of": 900, "and": 900, "to": 900, "or": 700, "version": 20, "2": 200, "3": 200}, 1000)
    for text, name in [
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("licensed under the GNU General Public License, version 3", "GPL-3.0"),
        ("Licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"), ("Licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
        ("Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"), ("Released under the BSD 2-Clause License.", "BSD-2-Clause"), ("Released under the BSD 3-Clause License.", "BSD-3-Clause"),
        ("Eclipse Public License - v 2.0", "EPL-2.0"), ("Licensed under the Apache License, Version 1.1", ""), ("Licensed under the GNU General Public License, version 4", ""), ("licensed under CC BY 2.0", ""),
    ]:
        assert index.scan(text)[1] == name, text
        assert index.scan("some words before " * 3000 + wrapped(text, 60, "# ") + " and words behind" * 30)[1] == name, text
    bsd = wrapped(licences._BSD + ": Redistributions of source code must retain the above copyright notice.", 60, " * ")
    assert index.scan(bsd)[1] == "BSD-2-Clause" and index.scan(bsd + " Neither the name of the holder may be used to endorse products")[1] == "BSD-3-Clause"


def test_runs_of_a_long_text_lose_no_window(monkeypatch):
    index = licences.Index.build({}, 10)
    text = "filler word " * 40 + "Licensed under the Apache License, Version 2.0." + " more" * 50
    whole = index.scan(text)
    for run in (1, 7, 64, 83):
        monkeypatch.setattr(licences, "AT_ONCE", run)
        assert index.scan(text) == whole and whole[1] == "Apache-2.0"


def test_ties_nulls_and_clashing_columns(spark):
    text = "Released under the MIT License. Released under the ISC License."
    rows = [(1, "a/LICENSE", "Released under the MIT License.", "", ""), (2, "a/COPYING", "Released under the ISC License.", "", ""), (3, "a/x", None, "", ""), (3, "a/x", None, "", ""), (4, "b/x", text, "", "")]
    got = {(r["doc_id"], r["licence"]) for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect()}
    mine = {r["doc_id"]: r["cosine"] for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert abs(mine[1] - mine[2]) < 1e-9 and (3, "MIT") in got and (4, "ISC") in got


def test_root_licence_and_empty_table(spark):
    rows = [(1, "COPYING", "Released under the MIT License.", "", ""), (2, "x/y/z", "", "", ""), (3, None, None, "", "")]
    assert {(r["doc_id"], r["licence"], r["licence_dir"]) for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect()} == {(1, "MIT", ""), (2, "MIT", ""), (3, "MIT", "")}
    assert licences.scan(spark.createDataFrame([], DOCS)).collect() == []
