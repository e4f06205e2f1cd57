"""Small cases of operators that SQL does not cover, and their edges."""

import itertools

import pytest
from pyspark.sql import functions as F

from graphspark.functions import text as fn
from graphspark.operators import design, functional, gates, intents, merges, repos, spec
from graphspark.sources import exports
from graphspark.streaming import status


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scalar_functions(spark):
    one = spark.createDataFrame([("/A/{id}/?q=1", " Portal ", "LoginForm SignIn_form", "decimal(18,4)", "")], "u string, p string, n string, d string, e string")
    r = one.select(fn.norm_route("u"), fn.platform_key("p"), fn.platform_key("e"), F.array_sort(fn.name_tokens("n")), fn.decompose_data_type("d"), fn.valid_description(F.lit("tbd")), fn.url_needle(F.lit("Query.users"))).first()
    assert r[0] == "/a/:p" and r[1] == "portal" and r[2] == "default" and r[3] == ["form", "in", "login", "sign"]
    assert tuple(r[4]) == ("decimal", None, 18, 4) and r[5] is False and r[6] == "users"


def test_citations_are_named_once_in_order(spark):
    df = spark.createDataFrame([('["a.md", {"name": "b"}, "a.md", "x"]',), ("nothing",), (None,)], "c string")
    assert [r[0] for r in df.select(fn.normalize_citations("c")).collect()] == [["a.md", "b"], [], []]


def test_filters_raise_on_unknown_fields_and_operators(spark):
    df = spark.range(3)
    assert fn.apply_filters(df, {"id": {"$gte": 1}}).count() == 2
    with pytest.raises(ValueError):
        fn.apply_filters(df, {"nope": 1})
    with pytest.raises(ValueError):
        fn.apply_filters(df, {"id": {"$near": 1}})


@pytest.mark.parametrize("pattern,path,hit", [("dist/", "a/dist/x.js", True), ("/src1/**", "src1/a/b", True), ("/src1/**", "x/src1/a", False), ("*.md", "a/b.md", True), ("a/**/b", "a/x/y/b", True), ("a?c", "abc", True)])
def test_ignore_patterns(pattern, path, hit):
    import re

    assert bool(re.search(fn.gitignore_to_regex(pattern), path)) == hit


def test_substring_and_word_rules_differ(spark):
    actions = spark.createDataFrame([(1, "Buyer", 1, "Review table", None, False, None), (1, "Buyer", 2, "Click the tab", None, False, None)], "payload_id int, persona string, action_id int, action string, description string, has_api boolean, url string")
    assert functional.platform_agnostic(actions).count() == 2
    assert [r.action_id for r in gates.check_forbidden_words(actions).collect()] == [2]


def test_schema_gate(spark):
    df = spark.createDataFrame([(1, [("P", [("O", ["s"])])]), (2, []), (3, [(" ", [("O", [])])]), (4, None)], "payload_id int, personas array<struct<persona:string,outcomes:array<struct<outcome:string,scenarios:array<string>>>>>")
    assert {(r.payload_id, r.detail) for r in gates.check_schema(df).collect()} == {(2, "personas"), (3, "persona"), (3, "outcome"), (4, "personas")}


def test_near_duplicates_equal_all_pairs(spark):
    names = ["LoginForm", "SignInForm", "login_form", "Order List Page", "Order Table Page", "Order Page", "Cart", "Cart Detail", "CartDetails View"]
    df = spark.createDataFrame([("Page", "web", n) for n in names], "label string, platform string, name string")
    got = {(r.a, r.b) for r in design.near_duplicate_names(df, 0.6).collect()}
    rows = df.select("name", fn.name_tokens("name").alias("p"), design.expanded(fn.name_tokens("name")).alias("w")).collect()
    want = set()
    for x, y in itertools.combinations(rows, 2):
        score = max(len(set(x[k]) & set(y[k])) / len(set(x[k]) | set(y[k])) for k in ("p", "w"))
        if score >= 0.6 and x.name.lower() != y.name.lower():
            want.add(tuple(sorted((x.name.lower(), y.name.lower()))))
    assert got == want


def test_merge_is_idempotent(spark):
    a = spark.createDataFrame([(1, "Pay  Bill", None, "old")], "persona_id int, outcome string, platform string, description string")
    b = spark.createDataFrame([(1, "pay bill", None, None), (1, "New", "web", "d")], "persona_id int, outcome string, platform string, description string")
    once = merges.merge_outcomes(a, b)
    again = merges.merge_outcomes(once.select("persona_id", "outcome", "platform", "description"), b)
    assert values(once.select("key_id", "description")) == values(again.select("key_id", "description"))
    assert {r.description for r in once.collect()} == {"old", "d"}


def test_components_equal_union_find(spark):
    import random

    random.seed(4)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(40)]
    parent = list(range(60))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.cluster for r in intents.components(spark.createDataFrame(links, "a long, b long").where("a <> b")).collect()}
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}


def test_capacity_batches(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([4, 4, 4, 12, 1])], "grp string, pos int, size int")
    assert [r.batch for r in intents.capacity_batches(df, 10, True).orderBy("pos").collect()] == [0, 0, 1, 2, 3]


def test_delete_leaves_shared_children(spark):
    links = spark.createDataFrame([(10, 1), (10, 2), (11, 1)], "child int, parent int")
    below = spark.createDataFrame([(20, 11), (21, 10)], "child int, parent int")
    gone = merges.delete_with_orphan_cleanup(spark.createDataFrame([(1,)], "id int"), [links, below])
    assert [values(g) for g in gone] == [[(11,)], [(20,)]]


def test_export_roundtrip(spark, tmp_path):
    import json

    graph = {"data": {"personas": [{"id": "p", "persona": "System", "outcomes": [{"id": "o", "outcome": "O", "scenarios": [{"id": "s", "scenario": "S", "steps": [{"id": "t", "step": "T", "actions": [{"id": "a", "action": "A", "apis": [{"type": "REST", "url": "/x"}]}]}]}, {"id": "s2", "scenario": "E", "steps": []}]}]}]}}
    for i, raw in enumerate([json.dumps(graph), json.dumps([{"type": "text", "text": json.dumps(graph)}]), json.dumps([{"text": json.dumps([{"text": json.dumps(graph)}])}]), json.dumps([graph])]):
        (tmp_path / f"e{i}.json").write_text(raw)
        flat = exports.flatten_functional(exports.read_graph_export(spark, str(tmp_path / f"e{i}.json")))
        assert {k: v.count() for k, v in flat.items()} == {"persona": 1, "outcome": 1, "scenario": 2, "step": 1, "action": 1, "api": 1}, i
        assert {(r.scenario_id, r.step_count, r.action_count) for r in flat["scenario"].collect()} == {("s", 1, 1), ("s2", 0, 0)}


def test_spec_rows_have_fillers(spark):
    scenario = spark.createDataFrame([(1, "S"), (2, "E")], "scenario_id int, scenario string")
    step = spark.createDataFrame([(5, 1, "T", "2024-01-01"), (6, 1, "U", None)], "step_id int, scenario_id int, step string, created_at string")
    action = spark.createDataFrame([(9, 5, "A"), (8, 5, "B")], "action_id int, step_id int, action string")
    got = [(r.scenario, r.step, r.action) for r in spec.plain_rows(scenario, step, action).orderBy("scenario_id", "step_pos", "action_no").collect()]
    assert got == [("S", "T", "B"), (None, None, "A"), (None, "U", "(no actions)"), ("E", None, "(no steps)")]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.sql("SELECT id AS event_id, timestampadd(MINUTE, CAST(id * 37 % 3000 AS INT), TIMESTAMP '2024-01-01') AS ts, id % 5 AS repo_id, element_at(array('started', 'active', 'error', 'node_creation'), CAST(id % 4 + 1 AS INT)) AS stage FROM range(400)")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    for i, (job, mode) in enumerate([(status.stream_latest_status, "complete"), (lambda e: status.stream_status_counts(e, "1 day", "5 days"), "complete")]):
        stream = job(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("memory").queryName(f"q{i}").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{i}")).start().awaitTermination()
        assert values(spark.table(f"q{i}")) == values(job(events))


def test_stalls_stream_appends_closed_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7, "started"), (2, "2024-01-01 00:10:00", 7, "node_creation"), (3, "2024-01-01 00:10:00", 8, "active"), (4, "2024-01-02 00:00:00", 9, "active")]
    events = spark.createDataFrame(rows, "event_id long, ts string, repo_id long, stage string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = status.stream_stalls(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("stalls").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert [(r.repo_id, r.stage) for r in spark.table("stalls").collect()] == [(7, "node_creation")]


def test_preview_takes_the_first_own_pattern(spark):
    files = spark.createDataFrame([("r", "a/x.py"), ("r", "dist/x.py"), ("r", "a/x.md"), ("r", "b/y.ts")], "repo string, path string")
    seen = repos.preview_ignores(files, ["a/", "*.py"])
    assert {r.path: r.reason for r in seen.collect()} == {"a/x.py": "a/", "dist/x.py": "built-in", "a/x.md": "unsupported", "b/y.ts": "kept"}
    assert {r.pattern: r.n for r in repos.pattern_hits(seen, ["a/", "*.py"]).collect()} == {"a/": 1, "*.py": 0}


def test_triage_groups_without_language_or_prefix(spark):
    fields = "key long, name string, language string, pushed_at date, archived boolean, fork boolean, empty boolean"
    rows = [(1, "hr-a", "Go", None, False, False, False), (2, "hr-b-c", None, None, False, False, False), (3, "solo", "VB", None, False, False, False), (4, None, "Java", None, True, False, False)]
    df = spark.createDataFrame(rows, fields)
    assert values(repos.triage_groups(df, "2024-01-01")) == [("(none)", 1, 0), ("Go", 1, 1), ("VB", 1, 0)]
    assert values(repos.triage_groups(df, "2024-01-01", "prefix")) == [("(none)", 1, 0), ("hr", 2, 1)]
    assert values(df.where(repos.unsupported()).select("key")) == [(1,)]
    assert repos.triage_groups(df.limit(0), "2024-01-01").count() == 0


def test_layer_boundaries(spark):
    nodes = spark.createDataFrame([(1, "UserExperience"), (2, "DataLake"), (3, "Services"), (4, None)], "id long, layer string")
    links = spark.createDataFrame([(1, 2), (1, 2), (3, 1), (3, 2), (1, 3), (4, 1), (1, None), (1, 9)], "source long, target long")
    assert values(merges.layer_boundaries(nodes, links)) == [(1, 2, "direct_storage_call"), (3, 1, "reverse_flow")]
    assert merges.layer_boundaries(nodes, links.limit(0)).count() == 0
