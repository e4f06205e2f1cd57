"""Every operator and every stage of the pipeline on nulls in any column, empty and very long texts, repeated rows, clashing names and no rows."""

import hashlib
import time

import numpy as np
import pytest

from graphspark.llm import bpe, exact_dedup, hilbert_shard, language_id, license_scan, mixing, quality_rules, secret_scan, simhash

LONG = "the quick brown fox and the lazy dog of the house " * 21_000
ROWS = [
    (None, None, None, None, None), (None, "One two three", "en", "a", 13), (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "  \n\t ", "de", None, 5), (4, LONG, "en", "b", len(LONG)), (5, "x" * 1_000_000, "en", "b", 1_000_000),
    (6, "der hund und die katze von der stadt", "de", "a", 36), (6, "der hund und die katze von der stadt", "de", "a", 36), (6, "another text with the same id", "en", "a", 29), (7, "ONE TWO THREE", "en", None, 13), (8, "é́😀 \u0000 � 日本語", None, "c", 12),
]


@pytest.fixture(scope="module")
def docs(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, kept int, shard2 int, ids_ string, fp string, digest string, words string, k int, row int, path string, __row string, size string, label string"
    return spark.createDataFrame([(*r, 1, 2, "x", "y", "z", "w", 3, 4, "p", "q", "s", "l") for r in ROWS], names)


@pytest.mark.parametrize("run", [
    bpe.bpe_digests, exact_dedup.deduplicate_one, quality_rules.quality, simhash.components, license_scan.licenses, hilbert_shard.shard, lambda d: language_id.predict(d, d), lambda d: mixing.mix(mixing.sized(d)),
], ids=["bpe", "exact_dedup", "quality_rules", "simhash", "license_scan", "hilbert_shard", "language_id", "mixing"])
def test_a_row_for_each_row(docs, run):
    began = time.time()
    rows = run(docs).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r.doc_id for r in rows), key=key) == sorted((r[0] for r in ROWS), key=key) and time.time() - began < 150
    assert run(docs.limit(0)).count() == 0


def test_secrets(docs):
    found = secret_scan.scan(docs)
    assert {(r.doc_id, r.finding_length) for r in found.collect()} == {(5, 1_000_000)} and secret_scan.scan(docs.limit(0)).count() == 0


def test_long_and_odd_texts_are_encoded_whole(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in bpe.bpe_digests(docs.where("doc_id IN (4, 5, 8)")).collect()}
    for i, text in ((4, LONG), (5, "x" * 1_000_000), (8, ROWS[-1][1])):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_of_the_pipeline(spark, docs, tmp_path):
    """Each on all that the one before kept; clashing columns go through up to the last."""
    import corpus_pipeline

    kept, columns = docs.drop("__row"), docs.drop("__row").columns
    texts = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, kept.limit(0), "")
        assert empty.count() == 0
        stage(spark, kept, "").write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == (["doc_id", "source", "lang", "token_ids", "n_tokens"] if name == "bpe" else columns) and empty.columns == kept.columns
        texts[name] = sorted(((r.doc_id or -1, r.text) for r in kept.select("doc_id", "text").collect()), key=str) if name != "bpe" else kept.count()
    assert {i for i, _ in texts["language_id"]} <= {-1, 4, 5, 6, 7, 8} and (4, LONG) in texts["language_id"] and not any(t is None or not t.strip() for _, t in texts["language_id"])
    lower = [t.lower() if t.isascii() else t for _, t in texts["exact_dedup"]]
    assert len(set(lower)) == len(lower) and set(lower) == {t.lower() if t.isascii() else t for _, t in texts["language_id"]}
    assert set(texts["simhash_near_dedup"]) <= set(texts["exact_dedup"]) and texts["bpe"] == len(texts["mixing"])
    assert all(any(part in t for j, t in texts["simhash_near_dedup"] if j == i) for i, part in texts["mixing"])


def test_other_shingles_and_radii(spark):
    """Fingerprints of five-word shingles that differ in up to five bits, against all pairs."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    base = [[words[i] for i in rng.integers(0, 400, 150)] for _ in range(6)]
    rows = []
    for n in range(60):
        text = list(base[n % 6])
        for i in rng.integers(0, 150, n // 12):
            text[i] = words[int(rng.integers(0, 400))]
        rows.append((n, " ".join(text)))
    prints = {i: simhash.fingerprint(t, 5) & (1 << 64) - 1 for i, t in rows}
    left, want = set(prints), {}
    while left:
        group = front = {left.pop()}
        while front:
            front = {y for y in left if any((prints[x] ^ prints[y]).bit_count() <= 5 for x in front)}
            left -= front
            group = group | front
        want.update({x: min(group) for x in group})
    got = {r.doc_id: r.component_id for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 5).collect()}
    assert got == want and len(set(want.values())) < 60
