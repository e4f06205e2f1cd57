"""The corpus operators against brute force, library results and SQL, with their edges."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from graphspark.llm import bpe, exact_dedup, hilbert_shard, html_extract, language_id, license_scan, mixing, quality_rules, queries, secret_scan, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "One", None, "a"), (4, "Same text here", "en", "b"), (5, "sAME TEXT HERE", "en", "b"), (6, "12 34 !!", "de", "b"),
    (7, "a b c d e f " * 3000, "en", "a"), (8, "É é   x\u001cy\nline\nline", "fr", "c"), (9, "All rights\nreserved. CC-BY, cc by", "en", "c"), (9, "All rights\nreserved. CC-BY, cc by", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def edges(spark):
    """Odd rows, with extra columns of clashing names."""
    names = "doc_id long, text string, lang string, source string, size int, shard int, ids string, fp string, digest string, kept int, label string, key string"
    return spark.createDataFrame([(*r, 1, 2, "x", "y", "z", 0, "l", "k") for r in EDGES], names)


@pytest.fixture(scope="module")
def none(edges):
    return edges.limit(0)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    key = sorted(want.columns)
    assert sorted(got[key].astype(str).values.tolist()) == sorted(want[key].astype(str).values.tolist())


def test_every_operator_on_edges_and_on_no_rows(edges, none):
    runs = [secret_scan.scan, bpe.bpe_digests, exact_dedup.deduplicate_one, exact_dedup.keep_one, quality_rules.quality, lambda d: mixing.mix(mixing.sized(d)), mixing.take, simhash.components, simhash.keep_one, license_scan.licenses, hilbert_shard.shard, lambda d: language_id.predict(d, d), language_id.keep_identified]
    for run in runs:
        assert run(none).count() == 0
        run(edges).collect()
    for run in (bpe.bpe_digests, exact_dedup.deduplicate_one, quality_rules.quality, simhash.components, license_scan.licenses, hilbert_shard.shard):
        assert run(edges).count() == len(EDGES)


def test_bpe_equals_the_library(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in bpe.bpe_digests(docs).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    codec = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    for text in ["", "<|endoftext|>a<|endoftext|>", "aaaa" * 900, "日本 é́ 😀 \n\n\t x", "xyzzy" * 50, " " * 40]:
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids and codec.decode(codec.encode(text)) == text


def test_unpack(spark):
    df = spark.createDataFrame([(bytes([1, 0, 0, 0, 2, 1, 0, 0]),), (b"",)], "ids binary").select(bpe.unpack("ids").alias("a"))
    assert [r.a for r in df.collect()] == [[1, 258], []]


def test_perfect_hash_has_a_slot_for_each_digest():
    table = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    levels, slots = exact_dedup.build(table[:4000])
    assert sorted(slots) == list(range(4000))
    unpacked = exact_dedup._unpack(exact_dedup._pack(levels))
    assert (exact_dedup.find(unpacked, table[:4000]) == slots).all()
    stored, at = table[:4000][np.argsort(slots)], exact_dedup.find(unpacked, table[4000:])
    assert not any(a >= 0 and (stored[a] == t).all() for a, t in zip(at, table[4000:]))


def test_copies_keep_one_row(edges):
    rows = exact_dedup.deduplicate_one(edges).collect()
    assert sorted(r.doc_id for r in rows if r.kept) == [2, 3, 5, 6, 7, 8, 9]
    kept = exact_dedup.keep_one(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7, 8, 9]


def test_mixing(docs, texts):
    rows = mixing.mix(mixing.sized(docs)).toPandas().merge(docs.select("doc_id", "source").toPandas())
    assert all(r.size_ == len(WORD.findall(texts[r.doc_id])) for r in rows.rename(columns={"size": "size_"}).itertuples())
    assert (rows["taken"] <= 3 * rows["size"]).all()
    for _, g in rows.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= max(2, 0.01 * g["target"].iloc[0]) and g["source_size"].iloc[0] == g["size"].sum()
    again = mixing.mix(mixing.sized(docs.repartition(7))).toPandas()
    assert rows[["doc_id", "taken"]].sort_values("doc_id").values.tolist() == again[["doc_id", "taken"]].sort_values("doc_id").values.tolist()


def test_permutations():
    for n in (1, 2, 7, 100, 1025):
        index = np.arange(n)
        there = mixing.permuted(index, np.full(n, n), np.full(n, 99))
        assert sorted(there) == list(range(n))
        assert (mixing.permuted(there, np.full(n, n), np.full(n, 99), back=True) == index).all()


def brute_fingerprint(text):
    import xxhash

    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(values):
    found = {}
    left = set(values)
    while left:
        group = frontier = {left.pop()}
        while frontier:
            frontier = {v for v in left if any((v ^ f).bit_count() <= 3 for f in frontier)}
            left -= frontier
            group = group | frontier
        found.update({v: frozenset(group) for v in group})
    return found


def test_simhash_equals_all_pairs(docs, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    groups = brute_components(set(prints.values()))
    ids = {g: min(i for i, p in prints.items() if p in g) for g in set(groups.values())}
    for r in simhash.components(docs).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == ids[groups[prints[r.doc_id]]]


def test_cover_meets_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    for level in (1, 2, 3):
        masks = [(a, m & (1 << 64) - 1) for a, _, m in simhash.masks_of(level)]
        above = {a for a, _ in masks}
        for _ in range(40):
            for a in list(above)[:3]:
                own = [m for b, m in masks if b == a]
                free = [i for i in range(64) if not simhash_common(own) >> i & 1]
                bits = rng.choice(free, size=min(3, len(free)), replace=False)
                x = sum(1 << int(b) for b in bits)
                assert any(not x & m for m in own)


def simhash_common(masks):
    out = (1 << 64) - 1
    for m in masks:
        out &= m
    return out


def test_large_buckets_are_divided_and_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    values = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, size=int(rng.integers(0, 7)), replace=False)) for _ in range(400)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {frozenset(v - (1 << 64) if v >> 63 else v for v in g) for g in set(brute_components(values).values()) if len(g) > 1}
    for bucket in (8, 2048):
        roots = simhash.contract(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket=bucket)).collect()
        got = {}
        for r in roots:
            got.setdefault(r.root, set()).add(r.node)
        assert {frozenset(g) for g in got.values()} == want


def test_license_places_and_labels(spark):
    rows = [(1, "x Licensed under the Apache License, Version 2.0. y"), (2, "CC BY cc-by All rights reserved GENERAL public\nlicense"), (3, "the general license public"), (4, None), (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction")]
    got = {r.doc_id: r for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache-2.0" and got[1].n_base == 0 and got[1].first_word is None
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (4, 0, 7, "cc-by,gpl,reserved")
    assert got[3].labels == "" and got[3].score == 0 and got[4].n_words == 0 and got[5].labels == "mit"


def test_shards_differ_by_one_row(docs, texts):
    rows = hilbert_shard.shard(docs).toPandas()
    counts = rows.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert len(counts) == 40 and counts["count"].max() - counts["count"].min() <= 1 and (counts["nunique"] == counts["count"]).all() and (counts["max"] == counts["count"] - 1).all()
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows.itertuples())
    again = hilbert_shard.shard(docs.repartition(5)).toPandas()
    assert rows.sort_values("doc_id")["shard"].tolist() == again.sort_values("doc_id")["shard"].tolist()


def test_hilbert_neighbours_differ_in_one_step(spark):
    for n, bits in ((2, 3), (3, 2)):
        grid = [tuple(int(x) for x in np.unravel_index(i, (1 << bits,) * n)) for i in range(1 << bits * n)]
        df = spark.createDataFrame(grid, ", ".join(f"d{i} int" for i in range(n)))
        rows = sorted(hilbert_shard.hilbert_index(df, [f"d{i}" for i in range(n)], bits, "h").collect(), key=lambda r: r.h)
        assert [r.h for r in rows] == list(range(1 << bits * n))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_forward_sums_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bc"]
    p = np.random.default_rng(0).random((len(pieces), 2))
    p /= p.sum(0)
    lattice = language_id.Lattice(pieces)

    def brute(text, k):
        return sum(p[i, k] * brute(text[len(x) :], k) for i, x in enumerate(pieces) if text.startswith(x)) if text else 1.0

    for word in (b"abcabcb", b"a", b"xyz"):
        want = [math.log(brute(b" " + word, k)) for k in (0, 1)]
        assert lattice.log_likelihood([word], p)[0] == pytest.approx(want) and lattice.scaled(word, p) == pytest.approx(want)


def test_language_held_out_accuracy(spark, docs):
    rows = queries.op10_language_id(spark, SF).toPandas().merge(docs.select("doc_id", "lang").toPandas())
    held = rows[rows["held_out"]]
    assert len(held) and (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.itertuples())


def test_und_without_letters(edges):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(edges, edges).collect()}
    assert got[1] == got[2] == got[6] == ("und", 0.0) and got[3][0] != "und"


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div><article><h1>Head&amp;line</h1>
      <p>First <b>bold</b>
      text &lt;x&gt;</p><script>var a="<p>no</p>"</script><p>Second<br>line<aside>side</aside></p><!-- c --><div class="ad">Buy</div><p>Last</article>
      <section id=comments><p>A comment of a reader that is long enough to look like text in itself, really.</p></section><footer>&copy; us</footer></body></html>"""
    assert html_extract.main_text(page) == "Head&line\n\nFirst bold text <x>\n\nSecond line\n\nLast"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""
    body = "Words of an article without any mark of its own, long enough to be taken for the text of the page. " * 3
    assert html_extract.main_text(f"<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><div><p>{body}</p><p>{body}</p></div><div class=footer>end</div>") == f"{body.strip()}\n\n{body.strip()}"


def test_secrets_and_false_positives(docs, texts):
    pattern = re.compile(r'AKIA[A-Z0-9]{16}|password=[0-9a-f]+|token = "[0-9a-f]{40}"')
    rows = secret_scan.scan(docs).toPandas()
    got = rows[rows["is_secret"]].groupby("doc_id").size().to_dict()
    assert got == {i: n for i, t in texts.items() if (n := len(pattern.findall(t)))}


def test_ablation_reads_bits(docs):
    ledger = quality_rules.ledger(docs).toPandas()
    rows = quality_rules.ledger(docs)
    for r in quality_rules.ablation(rows, "v1").collect():
        bit, mask = quality_rules.BITS[r.rule], quality_rules.policy_mask("v1")
        f = ledger["failures"] & mask
        assert (r.failed, r.failed_alone, r.kept_without) == (int((f & bit != 0).sum()), int((f == bit).sum()), int((f & ~bit == 0).sum()))


def test_pipeline_equals_brute_force(spark, docs, texts):
    """Language ID keeps all; copies and near copies as by hand; the mix takes what the operator says; tokens are the library's."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    out = corpus_pipeline.run(spark, SF).toPandas()
    keep = {}
    for i, t in texts.items():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        keep[key] = max(keep.get(key, -1), i)
    prints = {i: brute_fingerprint(texts[i]) for i in keep.values()}
    groups = brute_components(set(prints.values()))
    stay = {min(i for i, p in prints.items() if p in g) for g in set(groups.values())}
    assert set(out["doc_id"]) <= stay
    left = docs.where(docs["doc_id"].isin([int(i) for i in stay]))
    taken = {r.doc_id: r.taken for r in mixing.mix(mixing.sized(left)).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = {}
    for r in out.itertuples():
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        part = tokenizer.decode(ids, skip_special_tokens=False)
        assert part in texts[r.doc_id] and ids == tokenizer.encode(part, add_special_tokens=False).ids and r.n_tokens == len(ids)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(part))
    assert words == {i: n for i, n in taken.items() if n}
