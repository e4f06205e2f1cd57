"""Toxicity: folding, the automaton against plain search, learned exceptions, held-out accuracy, and odd tables."""

import random

import pytest

from graphspark.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_folding_undoes_disguises():
    plain = toxicity.fold("You IDIOT, total loser!")
    for text in ("you 1d10t total l0ser", "ｙｏｕ ｉｄｉｏｔ total 1os3r", "you іdіоt tоtаl lоsеr", "you ídíöt tötàl lóser", "you id​iot total lo­ser", "you !d!ot total 1oser", "you id1ot, total 1oser..."):
        assert toxicity.fold(text) == plain, text
    assert toxicity.fold("12 34 !! -- 5") == " " == toxicity.fold("") and toxicity.fold("page 10, 20 items!") == " page items "


def plain_hits(weights, exceptions, folded):
    """The longest entry at each space, unless an exception phrase covers it."""
    found = {}
    for at in (i for i, c in enumerate(folded) if c == " "):
        fits = [e for e in weights if folded.startswith(e, at) and e not in exceptions]
        if fits:
            found[at] = weights[max(fits, key=len)]
    for p in exceptions:
        for at in range(len(folded)):
            if folded.startswith(p, at):
                for k in range(at, at + len(p) - 1):
                    found.pop(k, None)
    return {k: w for k, w in found.items() if w}


def test_hits_equal_plain_search():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
    for _ in range(200):
        weights = {e: rng.choice([0.0, 1.0, 2.0]) for e in (f" {word()}" + rng.choice(["", " "]) for _ in range(8))}
        exceptions = [f" {word()} {word()} " for _ in range(3)]
        folded = toxicity.fold(" ".join(word() for _ in range(40)))
        assert toxicity.Lexicon(weights, exceptions).hits(folded) == plain_hits(weights, exceptions, folded)


def test_held_out_accuracy(spark):
    """On rows that nothing was learned from: of toxic texts most are found, of the others hardly any is taken."""
    got = {r.doc_id: r for r in queries.op11_toxicity(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(got[i], y) for i, y in labels.items() if got[i].held_out]
    toxic, clean = [r.predicted for r, y in held if y], [r.predicted for r, y in held if not y]
    assert len(toxic) > 50 and sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


@pytest.fixture(scope="module")
def learned(spark):
    """Two words in toxic texts; one of them harmless beside another word."""
    rng, rows, labels = random.Random(5), [], []
    filler = [f"{a}{b}{c}" for a in "bdfg" for b in "aeou" for c in ("rn", "nd", "mp", "st")]
    for i in range(600):
        words = [rng.choice(filler) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(30), rng.choice(["grotbag", "weasel"]))
        elif i % 4 == 1:
            words.insert(15, "least weasel")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, marks, toxicity.fit(docs, marks)


def test_weights_and_exceptions_are_learned(spark, learned):
    docs, marks, model = learned
    assert " grotbag " in model[0] and " ieast weasei " in model[1]
    asked = [(1, "a grotbag and a weasel and a grotbag"), (2, "a least weasel in the field"), (3, "a plain text on fields"), (4, "GR0TBAG gr0tbаg weasel wéasel"), (5, None), (6, "")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[i].predicted for i in range(1, 7)] == [1, 0, 0, 1, 0, 0] and got[4].hits == "grotbag weasei" and got[2].n_hits == 0 and got[5].score == got[6].score
    given = toxicity.fit(docs, marks, exceptions=["Total grotbag"])
    assert toxicity.Lexicon(*given[:2]).hits(toxicity.fold("a total GROTBAG")) == {} and len(toxicity.Lexicon(*given[:2]).hits(toxicity.fold("a grotbag"))) == 1


def test_odd_tables(spark, learned):
    names = "doc_id long, text string, score string, hits int, toxic string, part int, label int, entry int, predicted string"
    long = "grotbag and other words " * 50_000
    rows = [(None, None), (None, "text"), (1, ""), (2, long), (3, "x" * 1_000_000), (3, "x" * 1_000_000), (4, "é\u0000😀 ​")]
    docs = spark.createDataFrame([(*r, "s", 1, "t", 2, 3, 4, "p") for r in rows], names)
    got = toxicity.score(docs, learned[2]).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows) and {r.n_hits for r in got if r.doc_id == 2} == {50_000}
    marks = spark.createDataFrame([(2, 1), (2, 0), (3, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    for labels, want in ((marks, {1.0}), (marks.limit(0), {0.0}), (marks.where("toxic = 0 AND doc_id = 2"), {0.0})):
        assert {round(r.score, 6) for r in toxicity.predict(docs, labels).collect()} == want
    assert toxicity.predict(docs.limit(0), marks).count() == 0 and toxicity.predict(docs.limit(0), marks.limit(0)).count() == 0
