"""Cases where an operator once did less than its whole job."""

import hashlib
import random

from graphspark.llm import exact_dedup, license_scan, secret_scan


def _most_covered(words, templates):
    """By brute force: the worth of each template's best chain of longest runs, in order and with gaps of at most GAP words of the text, which cost SKIP_COST each."""
    gap, best = license_scan.GAP, [[] for _ in templates]
    held = {tuple(t[a:b]) for t in templates for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    longest = [max((n for n in range(1, i + 1) if tuple(words[i - n : i]) in held), default=0) for i in range(len(words) + 1)] + [0]
    for after, n in enumerate(longest[:-1]):
        if n < license_scan.ANCHOR or longest[after + 1] > n:
            continue
        for chains, t in zip(best, templates):
            for end in [e for e in range(n, len(t) + 1) if t[e - n : e] == words[after - n : after]]:
                chains.append((after, end, max([n] + [c + min(n, after - a, end - e) - license_scan.SKIP_COST * max(0, after - n - a) for a, e, c in chains if after - n <= a + gap and min(n, after - a, end - e) > 0])))
    return [max((c for _, _, c in chains), default=0) for chains in best]


def test_license_notices_after_stray_matches():
    scanner = license_scan.Scanner()
    apache = '(the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
    assert [x[::3] for x in scanner.scan(apache)[2]] == [("apache-2.0", 1.0)]
    assert [x[1:] for x in scanner.scan(f"Licensed under the Apache License, Version 2.0 {apache}")[2]] == [(0, 8, 1.0), (10, 39, 1.0)]
    assert [x[::3] for x in scanner.scan("of this software and this program is free software you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation")[2]] == [("gpl", 1.0)]
    assert [x[::3] for x in scanner.scan("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation")[2]] == [("lgpl", 1.0)]
    for label, text in license_scan.TEMPLATES:
        assert [x[::3] for x in scanner.scan(text)[2]] == [(label, 1.0)]
        for stray in ("the license you may", "of the software the", "this is free", "licensed under", text[: len(text) // 3]):
            assert (label, 1.0) in [x[::3] for x in scanner.scan(f"{stray} {text} {text}")[2]], (label, stray)
            assert sum(x[0] == label and x[3] == 1 for x in scanner.scan(f"{text} {stray} {text}")[2]) >= 2


def test_license_chains_equal_brute_force():
    scanner, rng = license_scan.Scanner(), random.Random(5)
    lists = [license_scan.words_of(text) for _, text in license_scan.TEMPLATES]
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 6)):
            t = rng.choice(lists)
            a = rng.randrange(len(t))
            words += t[a : a + rng.choice([2, 4, 40])] if rng.random() < 0.7 else t
            words += [b"zzz"] * rng.choice([0, 0, 1, 7])
        want = max(n / len(t) for n, t in zip(_most_covered(words, lists), lists))
        got = max((x[3] for x in scanner.scan(b" ".join(words).decode())[2]), default=0)
        assert got == (want if want >= license_scan.COVERAGE else 0)


def test_every_candidate_of_a_word(spark):
    key = "ghp_" + "a1B2" * 9
    texts = [
        (f'{{"user":"svc-account-01","token":"{key}"}}', [(0, "svc-account-01"), (0, key)]),
        ("a=1234567890ab;b=1234567890cd;b=1234567890cd", [(0, "a=1234567890ab"), (0, "b=1234567890cd"), (0, "b=1234567890cd")]),
        ("x https://h.example/p?id=12345678901&token=abcdef123456 y", [(1, "id=12345678901"), (1, "token=abcdef123456")]),
        ("password=hunterxy", [(0, "hunterxy")]), ("the password: Sh0rt!ab and", [(2, "Sh0rt!ab")]), ('PWD = "correct-horse"', [(2, "correct-horse")]), ('"abcdefgh","password":"abcdefgh"', [(0, "abcdefgh")]),
        ("the \1\2 1234567890ab\1\2", [(2, "1234567890ab")]), ("password=short", []), ("secretariat authoritative keyboards", []), (None, []), ("", []),
    ]
    rows = secret_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.word_index, r.finding_sha256))
    for i, (text, want) in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted((w, hashlib.sha256(f.encode()).hexdigest()) for w, f in want), text


def test_labels_of_fields(spark):
    key = "ghp_" + "a1B2" * 9
    rows = [(1, f'{{"user":"svc-account-01","token":"{key}"}}'), (2, '{"token":"short","user":"svc-account-01"}'), (3, "the secret ingredient"), (4, "password=hunterxy"), (5, 'PWD = "correct-horse"')]
    found = secret_scan.candidates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.finding): r.label for r in found.withColumn("label", secret_scan.weak_labels(found)).collect()}
    assert got == {(1, "svc-account-01"): None, (1, key): 1.0, (2, "svc-account-01"): None, (3, "ingredient"): 0.0, (4, "hunterxy"): 1.0, (5, "correct-horse"): 1.0}


def test_buckets_follow_the_arrivals(spark, monkeypatch):
    """A history of one row, or of none: the arrivals are dealt out all the same."""
    asked = []
    look_up = exact_dedup.look_up
    monkeypatch.setattr(exact_dedup, "BUCKET", 50)
    monkeypatch.setattr(exact_dedup, "look_up", lambda index, arrivals, buckets: asked.append(buckets) or look_up(index, arrivals, buckets))
    monkeypatch.setattr(exact_dedup, "_halves", lambda rows: (rows.where("doc_id < 0"), rows.where("doc_id IS NULL OR doc_id >= 0")))
    for ids in ([-(10**9)] + list(range(10**9, 10**9 + 400)), [None] * 401):
        rows = exact_dedup.deduplicate_one(spark.createDataFrame([(i, f"text {n % 300}") for n, i in enumerate(ids)], "doc_id long, text string")).collect()
        assert asked.pop() == 6 and len(rows) == 401 and sum(r.kept for r in rows) == 300
        assert sorted(r.group_size for r in rows) == [1] * 199 + [2] * 202
