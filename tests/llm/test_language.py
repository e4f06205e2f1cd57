"""Language ID on words of any length and pieces of any rarity, against sums in logs by brute force."""

import math
import time

import numpy as np
import pytest

from graphspark.llm import language_id

PIECES = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bc", b"cab", "日本".encode(), "語".encode()]


def _sums(word, log_p):
    """Logs of forward sums at each place and of backward sums from each place, place by place."""
    text, known = b" " + word, {x: i for i, x in enumerate(PIECES)}
    n, reach = len(text), max(map(len, PIECES))
    add = lambda values: (top := max(values)) + math.log(sum(math.exp(v - top) for v in values))
    arcs = [(i, j, known[text[i:j]]) for i in range(n) for j in range(i + 1, min(n, i + reach) + 1) if text[i:j] in known]
    into, out = {}, {}
    for a in arcs:
        into.setdefault(a[1], []).append(a)
        out.setdefault(a[0], []).append(a)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        alpha[j] = add([alpha[i] + log_p[x] for i, _, x in into[j]])
    for i in range(n - 1, -1, -1):
        beta[i] = add([beta[j] + log_p[x] for _, j, x in out[i]])
    return arcs, alpha, beta


def _rare(seed=3, least=1e-12):
    p = np.random.default_rng(seed).random((len(PIECES), 2)) * least
    p[200] = 1 - p.sum(0)
    return p


def test_sums_of_rare_pieces_and_long_words_are_exact():
    lattice, p = language_id.Lattice(PIECES), _rare()
    words = [b"", b"abcabcb", "😀".encode() * 10, "日本語".encode() * 60, b"abc" * 700, b"x" * 159, b"x" * 160, b"x" * 161]
    got = lattice.log_likelihood(words, p)
    assert np.isfinite(got).all()
    for word, row in zip(words, got):
        for k in (0, 1):
            assert row[k] == pytest.approx(_sums(word, np.log(p[:, k]))[1][-1], rel=1e-9)


@pytest.mark.parametrize("least", [1e-3, 1e-12])
def test_fitting_takes_words_of_any_length(monkeypatch, least):
    """One round of expectation maximisation from given probabilities, against expected counts by brute force."""
    lattice, words, counts = language_id.Lattice(PIECES), [b"abcab", "日本語".encode() * 40, b"abc" * 200, "語".encode()], [3, 1, 2, 5]
    p = _rare(least=least)[:, 0]
    monkeypatch.setattr(language_id.np, "full", lambda shape, value, *a: p[:, None] if shape == (len(PIECES), 1) else np.ones(shape) * value)
    want = np.zeros(len(PIECES))
    for word, n in zip(words, counts):
        arcs, alpha, beta = _sums(word, np.log(p))
        for i, j, x in arcs:
            want[x] += n * math.exp(alpha[i] + math.log(p[x]) + beta[j] - alpha[-1])
    want = (want + language_id.SMOOTHING) / (want.sum() + language_id.SMOOTHING * len(PIECES))
    assert lattice.fit(words, np.array(counts), rounds=1) == pytest.approx(want, rel=1e-9)


def test_a_language_without_spaces_is_learned_and_told(spark):
    """Sentences of about 90 bytes without any space: two languages over the same signs."""
    rng = np.random.default_rng(1)
    signs = [chr(0x4E00 + i) for i in range(40)]
    rows = []
    for i in range(400):
        lang = "xa" if i % 2 else "xb"
        weight = np.arange(1, 41) if lang == "xa" else np.arange(40, 0, -1)
        rows.append((i, "".join(rng.choice(signs, 29, p=weight / weight.sum())), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = docs.where(language_id.held_out())
    got = language_id.predict(held, docs.where(~language_id.held_out()), ["doc_id", "lang"]).collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_a_word_of_a_megabyte(spark):
    lattice, word = language_id.Lattice(PIECES), b"abcab" * 200_000
    began = time.time()
    total = np.zeros(len(PIECES))
    lattice.expected(word, np.log(_rare(least=1e-3)[:, 0]).tolist(), 1, total)
    assert total @ np.array([len(x) for x in PIECES]) == pytest.approx(len(word) + 1, rel=1e-4)
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the" * 350_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(docs, docs).collect()}
    assert got[3].lang_pred == "en" and 0 <= got[3].score <= 1 and time.time() - began < 120


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 1)
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", "de")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language_id.predict(docs, docs)
