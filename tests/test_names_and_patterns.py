"""Terms on word borders, ignore patterns by repository, numbers within keys, and places of repeated names."""

import random
import re

import numpy as np
import pytest

from graphspark.functions import find, scale
from graphspark.functions.text import gitignore_to_regex
from graphspark.operators import functional, ignores, intents, search


def test_words_equal_regular_expressions(spark, monkeypatch):
    rng = random.Random(2)
    pieces = ["ab", "a", "b_", "é", "-", " ", ".", "aB", "ab1"]
    texts = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(200)] + [(900, None), (901, "")]
    terms = ["ab", "a", "ab-a", "aB", "ab1", "é", "", "a.b"]
    df, names = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms] * 2, "term string")
    want = sorted((i, t) for i, x in texts for t in terms if t and x and re.search((r"(?<![A-Za-z0-9_])" if t[0].isascii() else "") + re.escape(t) + (r"(?![A-Za-z0-9_])" if t[-1].isascii() else ""), x))
    assert sorted((r.id, r.term) for r in find.hits(df, names, words=True).collect()) == want
    monkeypatch.setattr(find, "BLOCK_BYTES", 6)  # several blocks of terms
    assert sorted((r.id, r.term) for r in find.hits(df, names, words=True).collect()) == want
    assert find.hits(df, names.limit(0), words=True).count() == 0 == find.hits(df.limit(0), names, words=True).count()


def test_all_names_in_all_bodies(spark):
    bodies = spark.createDataFrame([("view", 1, "SELECT * FROM Orders o JOIN order_lines"), ("procedure", 2, "orders_old; ORDERS."), ("view", 3, None)], "kind string, id long, body string")
    tables = spark.createDataFrame([("orders",), ("Order_Lines",), ("lines",), (None,), ("",)], "table string")
    fks = spark.createDataFrame([(7, "ORDERS"), (8, "other"), (9, None)], "table_id long, ref_table string")
    got = sorted(map(tuple, search.all_schema_dependents(tables, fks, bodies).collect()))
    assert got == [("order_lines", "view", 1), ("orders", "foreign_key", 7), ("orders", "procedure", 2), ("orders", "view", 1)]
    files = spark.createDataFrame([("a", "x orderLine y"), ("b", "order_line"), ("c", "order-line;"), ("d", "orderliness"), ("e", None)], "file string, text string")
    assert sorted(map(tuple, search.all_references([files, files], spark.createDataFrame([("orderLine",), ("",)], "term string")).collect())) == [("orderLine", "a"), ("orderLine", "b"), ("orderLine", "c")]


def test_tries_equal_patterns_one_by_one():
    rng = random.Random(4)
    for _ in range(400):
        patterns = []
        while len(patterns) < 8:
            p = rng.choice(["", "/"]) + "/".join(rng.choice(["a", "b", "*", "a*", "?b", "**", "a.b"]) for _ in range(rng.randint(1, 3))) + rng.choice(["", "/"])
            if p.strip("/") != "**" and "**/**" not in p and not p.endswith("**/"):
                patterns.append(p)
        trie = ignores.Trie(list(enumerate(patterns)))
        for _ in range(20):
            path = "/".join(rng.choice(["a", "b", "ab", "axb", "a.b", "aab"]) for _ in range(rng.randint(1, 4)))
            want = next((k for k, p in enumerate(patterns) if re.search(gitignore_to_regex(p), path)), ignores._NEVER)
            assert trie.first(path) == want, (patterns, path)


def test_patterns_by_repository(spark, monkeypatch):
    rng = random.Random(6)
    files = [(rng.choice(["hot", "hot", "x", "y", None]), "/".join(rng.choice(["src", "lib", "web", "gen"]) for _ in range(rng.randint(0, 3))) + rng.choice(["/", "", "/x/"]).strip("/") + f"/f{i}{rng.choice(['.ts', '.py', '.md'])}") for i in range(300)]
    files = [(r, p.strip("/")) for r, p in files] + [("x", None)]
    patterns = [("hot", k, p) for k, p in enumerate([f"f{k}.ts" for k in range(3_000)] + ["gen/", "*.py"])] + [("x", 5, "lib/"), ("x", 2, "/src/**"), ("x", 9, "never/"), (None, 1, "*")]
    df, table = spark.createDataFrame(files, "repo string, path string"), spark.createDataFrame(patterns, "repo string, position int, pattern string")
    own = {r: sorted((k, p) for q, k, p in patterns if q == r) for r in ("hot", "x", "y")}
    small = {r: [(k, p, re.compile(gitignore_to_regex(p))) for k, p in v] for r, v in own.items()}
    want = sorted(((r, p, next((q for k, q, c in small.get(r, []) if p is not None and c.search(p)), None)) for r, p in files), key=str)
    got = lambda: sorted(((r.repo, r.path, r.pattern) for r in ignores.first_patterns(df, table).collect()), key=str)
    assert got() == want
    seen = ignores.preview_by_repo(df.where("path IS NOT NULL"), table)
    assert {r.reason for r in seen.collect()} == {"unsupported", "own", "kept"}
    n = {(r.repo, r.pattern): r.n for r in ignores.hits_by_repo(seen, table).collect()}
    assert n["x", "never/"] == 0 and n["hot", "*.py"] > 0 and len(n) == len(patterns)
    monkeypatch.setattr(ignores, "BLOCK", 1_500)
    assert got() == want and ignores.first_patterns(df.limit(0), table).count() == 0


@pytest.mark.parametrize("parts", [1, 7, None])
def test_batches_of_a_hot_key(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(["hot", "hot", "hot", "a", None][rng.integers(0, 5)], int(i)) for i in rng.permutation(500)]
    df = spark.createDataFrame(rows, "repo string, at long").repartition(6)
    want = {}
    for key in {k for k, _ in rows}:
        want |= {(key, a): n // 20 for n, a in enumerate(sorted(a for k, a in rows if k == key))}
    assert {(r.repo, r["at"]): r.batch for r in intents.fixed_batches(df, "repo", "at", 20, parts).collect()} == want
    assert intents.fixed_batches(df.limit(0), "repo", "at", 20, parts).count() == 0
    if parts == 7:  # the hot key's rows are in several ranges
        spread = df.repartitionByRange(7, "repo", "at").selectExpr("repo", "spark_partition_id() AS p").where("repo = 'hot'").select("p").distinct().count()
        assert spread >= 4
    assert scale.ranges_for(df) == scale.LEAST_RANGES


def test_places_of_hot_names(spark):
    rows = [("hot", i) for i in range(500)] + [("twice", 1), ("twice", 2), ("once", 1), (" ", 1), (" ", 2), (None, 1), (None, 2)]
    got = sorted((r.name, r.id, r["rank"], r.total) for r in functional.places(spark.createDataFrame(rows, "name string, id long").repartition(5), "name", ["id"], 3).collect())
    assert got == [("hot", 0, 1, 500), ("hot", 1, 2, 500), ("hot", 2, 3, 500), ("twice", 1, 1, 2), ("twice", 2, 2, 2)]
    plan = functional.places(spark.createDataFrame(rows, "name string, id long"), "name", ["id"], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
