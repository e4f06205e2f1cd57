"""Mixing: targets and totals against brute force, many and hot sources, parts of texts, draws of shards."""

import random
import re
from collections import Counter

import pytest

from graphspark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights, most=3.0):
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def plan_of(spark, sizes):
    rows = spark.createDataFrame([(f"s{i:06d}" if i < len(sizes) - 1 else None, n) for i, n in enumerate(sizes)], "source string, size long")
    return mixing.planned(mixing.sources_of(rows))


@pytest.mark.parametrize("sizes", [[10, 1000, 1000], [0, 0], [5], [1, 1, 10_000, 3, 700, 0, 90_000], [511, 512, 513, 1024, 1025]])
def test_targets(spark, sizes):
    plan = sorted(plan_of(spark, sizes).collect(), key=lambda r: r.k)
    assert [r.source_size for r in plan] == sizes
    assert [r.target for r in plan] == pytest.approx(brute_targets(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]))


def test_every_source_comes_to_its_target_by_the_word(spark):
    """1,000 sources of all sizes, one with a third of all words, and one more without a name."""
    rng = random.Random(6)
    rows = [(i, f"s{rng.randint(0, 999):03d}", int(rng.paretovariate(0.7))) for i in range(4_000)]
    rows += [(i, "hot", rng.randint(0, 60)) for i in range(4_000, 7_000)] + [(None, None, 7), (None, None, 7), (99_999, "s000", 0)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    source = {i: s for i, s, _ in rows}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())


def test_shards_draw_what_is_planned(spark):
    """Every slot of a source once, in every shard as many slots as it has, and shares that vary as a draw's do."""
    slots = [3_000, 0, 30, 900, 1]
    plan = spark.createDataFrame(list(enumerate(slots)), "k long, slots long")
    rows = mixing.shard_counts(plan, 64).collect()
    seen, shards = [set() for _ in slots], Counter()
    for r in rows:
        assert r.n > 0 and not seen[r.k] & set(range(r.first, r.first + r.n))
        seen[r.k] |= set(range(r.first, r.first + r.n))
        shards[r.shard] += r.n
    assert seen == [set(range(n)) for n in slots]
    assert [shards[i] for i in range(len(shards))] == [64] * (sum(slots) // 64) + [sum(slots) % 64]
    first = Counter()
    for r in rows:
        first[r.shard] += r.n * (r.k == 0)
    shares = [first[i] / 64 for i in range(sum(slots) // 64)]
    assert 0.6 < sum(shares) / len(shares) < 0.9 and len(set(shares)) > 5


def test_wide_plans_are_joined_without_a_broadcast(spark, monkeypatch):
    plan = spark.createDataFrame([(i, i % 7) for i in range(500)], "k long, slots long")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(mixing.shard_counts(plan, 64))
    monkeypatch.setattr(mixing, "broadcast_if_small", lambda df: df)
    assert key(mixing.shard_counts(plan, 64)) == want


def test_parts_of_texts_add_up(spark):
    rng = random.Random(1)
    texts = {i: rng.choice([" \n", ""]) + "".join(f"w{i}_{j}" + rng.choice([" ", "\n\n", " \t "]) for j in range(n)) for i, n in enumerate([0, 1, 5, 511, 512, 513, 3_000, 40_000])}
    rows = [(i, t, "ab"[i % 2], 1, "x", 0) for i, t in texts.items()] + [(None, "again and again", "a", 1, "x", 0)] * 2 + [(99, None, None, 1, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k int, words string, start int")
    out = mixing.take(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in mixing.mix(mixing.sized(docs)).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    found = {}
    for r in out.collect():
        assert r.text in (texts[r.doc_id] if r.doc_id is not None else "again and again")
        found.setdefault(r.doc_id, []).append(r.text)
    assert {i: sum(len(WORD.findall(t)) for t in parts) for i, parts in found.items()} == {i: n for i, n in taken.items() if n}
    whole = next(i for i in (6, 7) if taken[i] >= len(WORD.findall(texts[i])))
    left, parts = texts[whole], sorted(set(found[whole]), key=texts[whole].find)
    assert "".join(parts) == left or sum(map(len, parts)) > len(left)
    assert mixing.take(docs.limit(0)).count() == 0
