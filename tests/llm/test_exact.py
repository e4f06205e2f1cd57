"""Exact de-duplication against a history, with ids that are skewed, null or repeated."""

import hashlib
import random

from graphspark.llm import exact_dedup


def _brute(rows, history):
    """(doc_id, keep_id, group_size, kept) of the rows: the largest id of both stays, a null one last, the history's copy first."""
    key = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups, held, out = {}, {(i, key(t)) for i, t in history}, []
    for i, t in [*history, *rows]:
        groups.setdefault(key(t), []).append(i)
    for i, t in rows:
        keep = max((x for x in groups[key(t)] if x is not None), default=None)
        out.append((i, keep, len(groups[key(t)]), i == keep and (i, key(t)) not in held))
        held |= {(i, key(t))} if i == keep else set()
    return out


def test_against_a_history(spark):
    rng = random.Random(8)
    texts = [None, "", "A", "a", "b", "É", "é", "x" * 100_000, *(f"t{i}" for i in range(60))]
    pick = lambda n: [(rng.choice([None, *range(-30, 40), 1 << 60]), rng.choice(texts)) for _ in range(n)]
    for rows, history in ((pick(300), pick(200)), (pick(50), []), ([], pick(50)), (pick(100), pick(3))):
        frame = lambda r: spark.createDataFrame([(*x, 1, "d") for x in r], "doc_id long, text string, n int, digest string")
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.deduplicate(frame(rows), frame(history)).collect()]
        key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0, *x[2:])
        assert sorted((x[:4] for x in got), key=key) == sorted(_brute(rows, history), key=key)
        assert {x[4] for x in got} <= {hashlib.sha256((t or "").encode().lower()).hexdigest() for t in texts}
        one = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate_one(frame(rows + history)).collect()]
        assert sorted(one, key=key) == sorted(_brute(rows + history, []), key=key)


def test_halves_of_skewed_ids(spark):
    """Ids far apart, or dense at one end, still leave about half of the rows in each half."""
    for ids in ([-(10**15), *range(4_000)], [10**15 + i for i in range(4_000)], [2 * i for i in range(4_000)]):
        old, new = exact_dedup._halves(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
        assert 0.4 < old.count() / len(ids) < 0.6 and old.count() + new.count() == len(ids)
