"""Operators that are cut into blocks, ranges or buckets, against brute force over small data and small blocks."""

import fnmatch
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.functions import find, scale
from graphspark.functions import text as fn
from graphspark.operators import design, gates, intents, metric_tree, names, search
from graphspark.streaming import status


def _reached(nodes, linked):
    """Components of the nodes that have a link, by their smallest member."""
    out, left = {}, set(nodes)
    while left:
        group = front = {left.pop()}
        while front:
            front = {y for y in left if any(linked(x, y) for x in front)}
            left -= front
            group = group | front
        if len(group) > 1:
            out.update({x: min(group) for x in group})
    return out


@pytest.mark.parametrize("block", [3, 2_000])
def test_near_duplicate_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(names, "BLOCK", block)
    rng = random.Random(3)
    words = ["Login", "Sign-in", "SignIn", "Form", "Input", "Page", "Order", "List", "Table", "Cart", "Detail", "View", "Btn", "Button", "Home"]
    rows = [(rng.choice(["Page", "Flow"]), rng.choice(["web", None]), rng.choice(["", " ", "_"]).join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for _ in range(160)] + [("Page", "web", n) for n in (" ", "!!", "login form", "LOGIN FORM", "form login")]
    df = spark.createDataFrame(rows, "label string, platform string, name string")
    keyed, _ = names.classes_of(df)
    told = df.select("label", fn.platform_key("platform").alias("platform"), F.lower("name").alias("key"), F.array_sort(fn.name_tokens("name")).alias("p")).where("trim(key) <> ''").groupBy("label", "platform", "key").agg(F.min("p").alias("p"))
    sets = {(r.label, r.platform, r.key): (set(r.p), set(r.w)) for r in told.withColumn("w", design.expanded(F.col("p"))).collect()}

    def linked(x, y):
        return x != y and x[:2] == y[:2] and any(sets[x][k] and sets[y][k] and round(len(sets[x][k] & sets[y][k]) / len(sets[x][k] | sets[y][k]), 4) >= 0.6 for k in (0, 1))

    want = {x: n for x in sets if (n := sum(linked(x, y) for y in sets))}
    groups = _reached(sets, linked)
    got = names.near_duplicate_links(df).collect()
    assert {(r.label, r.platform, r.key): r.links for r in got} == want and len(got) == len(want)
    assert {(r.label, r.platform, r.key): r.cluster for r in got} == {x: g[2] for x, g in groups.items()}
    pairs = {(r.label, r.platform, *sorted((r.a, r.b))) for r in design.near_duplicate_names(df).collect()}
    assert {(*x[:2], *sorted((x[2], y[2]))) for x, y in itertools.combinations(sets, 2) if linked(x, y)} == pairs
    assert names.near_duplicate_links(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [24, 4_096])
def test_vector_links_and_clusters_equal_all_pairs(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    vectors = {i: (centres[i % 12] + rng.normal(size=6) * (0.05 if i % 3 else 0.9)).tolist() for i in range(150)}
    vectors |= {150: [0.0] * 6, 151: vectors[3], 152: None}
    group = {i: "hot" if i % 4 else f"g{i % 3}" for i in vectors}
    df = spark.createDataFrame([(i, group[i], x) for i, x in vectors.items()], "id long, grp string, embedding array<double>")
    unit = {i: np.array(x) / max(np.linalg.norm(x), 1e-30) for i, x in vectors.items() if x is not None}
    linked = lambda a, b: a != b and group[a] == group[b] and unit[a] @ unit[b] >= 0.8 - 1e-12
    pairs = {(a, b) for a, b in itertools.combinations(unit, 2) if linked(a, b)}
    assert {(r.a, r.b) for r in intents.similar_pairs(df, 0.2, block).collect()} == pairs
    assert {r.id: r.links for r in intents.similar_links(df, 0.2, block).collect() if r.links} == {i: n for i in unit if (n := sum(i in p for p in pairs))}
    assert {r.id: r.cluster for r in intents.cluster(df, 0.2, block).collect()} == {i: None for i in vectors} | _reached(unit, linked)
    assert intents.cluster(df.limit(0), 0.2, block).count() == 0


def test_metric_tree_leaves_out_pairs(spark):
    """64 dimensions, 12 clusters, and a third of all rows equal: of the pairs of blocks a small share stays, and the links are those of all pairs."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 64))
    rows = [(i, "a", (centres[i % 12] + rng.normal(size=64) * 0.25).tolist()) for i in range(1_200)] + [(2_000 + i, "a", centres[0].tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, grp string, embedding array<double>")
    kept, whole = metric_tree.kept_share(intents.classes(df)[0], 0.2, 40)
    assert whole > 400 and kept < 0.2 * whole
    x = metric_tree.unit([v for _, _, v in rows])
    close = x @ x.T >= 0.8 - 1e-12
    assert {r.id: r.links for r in intents.similar_links(df, 0.2, 40).collect()} == {i: int(n) - 1 for (i, _, _), n in zip(rows, close.sum(1))}
    assert len({r.cluster for r in intents.cluster(df, 0.2, 40).collect()}) == 12


def test_capacity_batches_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", "c"]), i, rng.choice([0, 1, 3, 5, 9, 10, 11, 40])) for i in range(500)]
    df = spark.createDataFrame(rows, "grp string, pos long, size long").repartition(5)
    for cap, solo in ((10, True), (10, False), (25, True), (100_000, True)):
        want = {}
        for g in "abc":
            mine = sorted((p, s) for x, p, s in rows if x == g)
            for (p, _), batch in zip(mine, intents._packed([s for _, s in mine], cap, solo, 0, 0)[0]):
                want[g, p] = batch
        for parts in (1, 9):
            assert {(r.grp, r.pos): r.batch for r in intents.capacity_batches(df, cap, solo, parts).collect()} == want


def test_top_k_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(-1, 2, 5).astype(float).tolist()) for i in range(90)] + [(90, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = df.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    key = lambda d: sorted((r.query_id, round(r.score, 9)) for r in d.collect())
    whole = key(search.semantic_top_k(asked, df, 6))
    unit = {i: np.array(x) / max(np.linalg.norm(x), 1e-30) for i, x in rows if x is not None}
    want = sorted((q, s) for q in unit if q % 4 == 0 for s, i in sorted(((round(float(unit[q] @ unit[i]), 9), i) for i in unit), key=lambda x: (-x[0], x[1]))[:6])
    assert whole == want
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(search, "NODE_BLOCK", 11)
    assert key(search.semantic_top_k(asked, df, 6)) == want
    assert search.semantic_top_k(asked.limit(0), df, 6).count() == 0


def test_terms_in_blocks(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcabc"), (2, ""), (3, None), (1, "xbc"), (4, "a" * 300_000)], "id long, text string")
    terms = spark.createDataFrame([(x,) for x in ["abc", "bc", "zz", "", None, "bc", "aa"]], "term string")
    want = sorted([(1, "abc"), (1, "bc"), (1, "bc"), (4, "aa")])
    assert sorted(map(tuple, find.hits(texts, terms).collect())) == want
    monkeypatch.setattr(find, "BLOCK", 1)
    assert sorted(map(tuple, find.hits(texts, terms).collect())) == want
    assert find.hits(texts, terms.limit(0)).count() == 0 and find.hits(texts.limit(0), terms).count() == 0


def test_running_sums_over_ranges(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k long, v long")
    rows = sorted(map(tuple, scale.running(df, [F.col("k")], F.col("v"), "s", 7).collect()))
    assert [s for _, _, s in rows] == [sum(v for _, v, _ in rows[:i]) for i in range(101)]


def _ignored(pattern, path):
    """By the rules of ignore files, folder by folder."""
    names_, parts = pattern.strip("/").split("/"), path.split("/")
    rooted = pattern.startswith("/") or len(names_) > 1

    def match(ns, ps):
        """Whether the names take up a beginning of the path, and how much of it."""
        if not ns:
            return [0]
        out = []
        if ns[0] == "**":
            for n in range(len(ps) + 1):
                out += [n + m for m in match(ns[1:], ps[n:])] if len(ns) > 1 else ([n] if n else [])
        elif ps and fnmatch.fnmatchcase(ps[0], ns[0].replace("[", "[[]")):
            out += [1 + m for m in match(ns[1:], ps[1:])]
        return out

    starts = [0] if rooted else range(len(parts))
    return any(n < len(parts) if pattern.endswith("/") else n > 0 for s in starts for n in [s + m for m in match(names_, parts[s:])] if n > s)


def test_ignore_patterns_equal_the_rules():
    import re

    rng = random.Random(11)
    for _ in range(3_000):
        pattern = rng.choice(["", "/"]) + "/".join(rng.choice(["a", "b", "*", "a*", "?b", "**", "a.b"]) for _ in range(rng.randint(1, 3))) + rng.choice(["", "/"])
        path = "/".join(rng.choice(["a", "b", "ab", "axb", "a.b", "aab"]) for _ in range(rng.randint(1, 4)))
        if pattern.strip("/") and "**" != pattern.strip("/"):
            assert bool(re.search(fn.gitignore_to_regex(pattern), path)) == _ignored(pattern, path), (pattern, path)


def test_gates_as_a_stream(spark, tmp_path):
    rows = [(1, "Buyer", 1, "Submit order", None, False, None), (1, "Buyer", 2, "Click the tab", "x", False, None), (2, "System", 3, "Receive POST /api/a/b", "x", True, "/api/a/c"), (2, "System", 4, "Persist item", "writes table t", False, None)]
    actions = spark.createDataFrame(rows, "payload_id long, persona string, action_id long, action string, description string, has_api boolean, url string")
    actions.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = status.stream_gate_payloads(spark.readStream.schema(actions.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("gates").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    got = sorted(map(tuple, spark.table("gates").collect()))
    assert got == sorted(map(tuple, gates.row_gates(actions).collect())) == [(1, "description", 1, "missing"), (1, "forbidden_words", 2, "click,tab"), (1, "rule_a", 1, "submit"), (2, "path_linked", 3, "other_url")]


def test_fields_of_hot_payloads(spark):
    actions = spark.createDataFrame([(1, "Buyer", i, f"Enter field {i % 7}", None, i % 50 == 0, None) for i in range(300)], "payload_id long, persona string, action_id long, action string, description string, has_api boolean, url string")
    fields = spark.createDataFrame([(1, f"Field {i}", f"f{i}", i != 3) for i in range(9)] + [(2, "Field 1", "f1", True)], "payload_id long, label string, code string, editable boolean")
    assert sorted((r.payload_id, r.label) for r in gates.check_field_coverage(fields.drop("editable"), actions).collect()) == [(1, "Field 7"), (1, "Field 8"), (2, "Field 1")]
    got = sorted((r.check, -1 if r.action_id is None else r.action_id, r.detail) for r in gates.check_atomicity(actions, fields).collect())
    assert got == sorted([("input_with_api", i, "enter") for i in range(0, 300, 50)] + [("no_action", -1, "f7"), ("no_action", -1, "f8")])


def test_sums_within_keys_over_ranges(spark):
    """Against a plain loop: a key with nearly all rows, a null key, ties across keys, and no rows."""
    rng = random.Random(8)
    rows = [("hot" if i % 20 else rng.choice(["a", "b", None]), i, rng.randint(-5, 9)) for i in range(2_000)]
    table = spark.createDataFrame(rows, "key string, at long, n long").repartition(7)
    got = {r.at: (r.key, r.n, r.before) for r in scale.running_within(table, "key", ["at"], F.col("n"), "before", parts=11).collect()}
    sums = {}
    for key, at, n in rows:
        assert got[at] == (key, n, sums.get(key, 0))
        sums[key] = sums.get(key, 0) + n
    assert len(got) == len(rows)
    down = {r.at: r.before for r in scale.running_within(table, "key", [F.col("at").desc()], F.col("n"), "before", parts=3).collect()}
    assert all(down[at] == sums[key] - got[at][2] - n for key, at, n in rows)
    assert scale.running_within(table.limit(0), "key", ["at"], F.col("n"), "before").collect() == []
