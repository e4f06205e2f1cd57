"""Licence scans of whole licences and of documents, against brute force."""

import random
import re
import time

import pytest

from graphspark.llm import license_scan
from tests.llm.test_whole import _most_covered


@pytest.fixture(scope="module")
def scanner():
    return license_scan.Scanner()


def test_whole_licences_are_found_where_they_stand(scanner):
    for label, text in license_scan.full_texts():
        n = len(license_scan.words_of(text))
        assert (label, 3, 3 + n, 1.0) in scanner.scan(f"zzz yyy xxx {text} www vvv")[2], label
        half = " ".join(text.split()[: len(text.split()) // 2])
        assert label not in [x[0] for x in scanner.scan(half)[2] if x[2] - x[1] > 60], label


def test_licences_with_changed_words_are_found(scanner):
    rng = random.Random(3)
    for label, text in license_scan.full_texts():
        words = text.split()
        for i in rng.sample(range(len(words)), len(words) // 100):
            words[i] = "qqqq"
        spans = [x for x in scanner.scan(" ".join(words))[2] if x[0] == label and x[2] - x[1] > 60]
        assert spans and spans[0][3] < 1, label


@pytest.mark.parametrize("text,label", [
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"), ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0"),
    ("under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa-4.0"), ("a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"), ("Creative Commons Attribution-NoDerivatives 4.0 International", "cc-by-nd-4.0"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"), ("CC BY 4.0", "cc-by-4.0"), ("cc-by-nc-nd 4.0", "cc-by-nc-nd-4.0"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("licensed under the GNU Affero General Public License, version 3", "agpl-3.0"), ("licensed under the GNU General Public License, version 3", "gpl-3.0"), ("licensed under the GNU Lesser General Public License version 2.1", "lgpl-2.1"),
    ("made available under the terms of the Eclipse Public License 2.0", None), ("Eclipse Public License - v 2.0", "epl-2.0"),
    ("// SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: AGPL-3.0-only", "agpl-3.0"), ("SPDX-License-Identifier: EPL-2.0", "epl-2.0"), ("SPDX-License-Identifier: Zlib", None),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"), ("released under the MIT license", "mit"), ("released under the not so MIT license", None),
])
def test_each_licence_has_its_own_label(scanner, text, label):
    assert {x[0] for x in scanner.scan(f"some words before {text} and after")[2]} == ({label} if label else set())


def test_no_whole_licence_is_labelled_as_another(scanner):
    kin = {"gpl-2.0": {"gpl"}, "gpl-3.0": {"gpl"}, "lgpl-2.1": {"lgpl"}}
    for label, text in license_scan.full_texts():
        assert {x[0] for x in scanner.scan(text)[2]} <= {label, *kin.get(label, ())}, label
        # With words of another one put in, as a kin of it has: not the same at full coverage.
        changed = text.replace("General Public License", "Affero General Public License").replace("GENERAL PUBLIC LICENSE", "AFFERO GENERAL PUBLIC LICENSE")
        if changed != text:
            assert all(x[3] < 1 for x in scanner.scan(changed)[2] if x[0] == label and x[2] - x[1] > 60)


def test_outermost_equals_pairs():
    rng = random.Random(9)
    for _ in range(300):
        spans = list({(rng.choice("abc"), a := rng.randint(0, 12), a + rng.randint(1, 8), rng.choice([0.9, 1.0])) for _ in range(8)})
        inside = lambda s, k: k[0] != s[0] and k[1] <= s[1] and k[2] >= s[2] and (k[1:3] != s[1:3] or k[3] > s[3])
        want = {s for s in spans if not any(inside(s, k) for k in spans)}
        assert set(license_scan.outermost(spans)) == want


def test_documents_equal_brute_force(spark, scanner):
    """Of every document: places of base phrases, and the coverage of notices; and no whole licence where none can be."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    lists = [license_scan.words_of(t) for _, t in license_scan.TEMPLATES]
    known = {w for t in lists for w in t}
    got = {r.doc_id: r for r in license_scan.scan_texts(docs).collect()}
    for r in docs.collect():
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = sorted((i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        assert got[r.doc_id].n_words == len(words) and sorted((p.start, p.label) for p in got[r.doc_id].places) == places
        # Words that no notice has divide a text into parts; a chain bridges GAP of them.
        encoded, parts, part, gap = [w.encode() for w in words], [], [], 0
        for w in encoded:
            gap = 0 if w in known else gap + 1
            if gap > license_scan.GAP:
                parts, part = parts + [part], []
            else:
                part = part + [w]
        want = max((n / len(t) for p in [*parts, part] if len(p) > 4 for n, t in zip(_most_covered(p[:400], lists), lists)), default=0)
        found = max((s.coverage for s in got[r.doc_id].spans), default=0)
        assert found == pytest.approx(want if want >= license_scan.COVERAGE else 0)


def test_edges(spark):
    mega = "permission is hereby granted free of charge to any person " * 20_000
    rows = [(1, None, 1), (2, "", 2), (None, "All rights\nreserved", 3), (None, "All rights\nreserved", 3), (5, mega, 4), (6, "x" * 1_000_000, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    began = time.time()
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels) for r in license_scan.licenses(frame).collect())
    assert got == [(0, 3, 1, "reserved"), (0, 3, 1, "reserved"), (1, 0, 0, ""), (2, 0, 0, ""), (5, 200_000, 0, ""), (6, 1, 0, "")] and time.time() - began < 60
    assert license_scan.licenses(frame.limit(0)).count() == 0
