"""Steps whose tasks, pairs or state calls once grew with the whole table."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from graphspark.functions import scale
from graphspark.operators import design, intents, merges, search
from graphspark.plans import queries
from graphspark.streaming import stalls


def rows_of(df):
    return sorted(map(str, df.collect()))


def plan_of(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_templates_by_group_equal_pairs(spark):
    pages = spark.createDataFrame([(i, ["LIST", "FORM", None][i % 3]) for i in range(1, 30)] + [(5, "LIST"), (None, "LIST")], "id long, page_type string")
    kinds = [(i, f"T{i % 3}" if i % 5 else "ListPageLayout", "TEMPLATE" if i % 3 else "ATOM") for i in range(1, 15)] + [(4, "Other", "TEMPLATE"), (None, "N", "TEMPLATE")]
    components = spark.createDataFrame(kinds, "id long, name string, type string")
    group_of, group_on = [(c, c % 4) for c in range(1, 11)] + [(4, 0)], [(p, p % 6) for p in range(1, 25)] + [(5, 5), (None, 1)]
    own = [(c, p) for c in range(1, 15) for p in range(1, 30) if (c * p) % 11 == 3] + [(4, 4), (4, 4), (12, 29)]
    pairs = [(c, p) for c, g in group_of for p, h in group_on if g == h]
    links = lambda rows: spark.createDataFrame(rows, "child long, parent long")
    of, on = spark.createDataFrame(group_of, "child long, group long"), spark.createDataFrame(group_on, "parent long, group long")
    assert set(own) & set(pairs)
    assert rows_of(design.template_compliance(pages, components, links(own), of, on)) == rows_of(design.template_compliance(pages, components, links(own + pairs)))


def test_joins_are_dealt_by_counted_rows(spark, monkeypatch):
    monkeypatch.setattr(scale, "TASK_ROWS", 2)
    used, steps = spark.createDataFrame([(i % 20,) for i in range(40)], "step_id long"), spark.createDataFrame([(i, 1) for i in range(10, 30)], "step_id long, scenario_id long")
    got = design.step_coverage(used, steps)
    assert rows_of(got) == sorted([f"Row(issue='unknown', step_id={i})" for i in range(10)] + [f"Row(issue='uncovered', step_id={i})" for i in range(20, 30)])
    assert ", 30)" in plan_of(got) and "hashpartitioning(scenario_id" not in plan_of(got)
    one = steps.select("scenario_id").distinct()
    assert rows_of(design.step_coverage(used, steps, one)) == rows_of(got) and rows_of(design.step_coverage(used, steps, one.limit(0))) == [f"Row(issue='unknown', step_id={i})" for i in range(10)]


def test_chains_without_parents_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(scale, "TASK_ROWS", 2)
    links = lambda rows: spark.createDataFrame(rows, "child long, parent long")
    on, up, above = links([(1, 1), (1, 1), (2, 2), (3, None)]), links([(1, 10), (1, 10), (1, 11), (1, 12), (1, 13)]), links([(10, None), (10, None), (11, 99), (12, 7), (12, 99), (13, 98), (13, 98)])
    got = design.broken_chains(on, up, above, spark.createDataFrame([(7,), (7,)], "id long"))
    assert rows_of(got) == sorted(str(r) for r in spark.createDataFrame([("page_without_flow", 2), ("page_without_flow", None), ("flow_without_journey", 10), ("flow_with_missing_journeys", 11), ("flow_with_missing_journeys", 13)], "issue string, id long").collect())
    assert "isnotnull(parent" in plan_of(got) and ", 8)" in plan_of(got)


def test_consistency_is_dealt_and_takes_links_twice(spark, monkeypatch):
    pairs = lambda rows, names: spark.createDataFrame(rows, names)
    action, step = [(1, 100), (1, 101), (2, 102), (3, 103)], [(100, 5), (101, 6), (102, 5), (103, 5)]
    on, up, flow = [(1, 10), (2, 11), (3, 12)], [(10, 20), (11, 21)], [(20, 5), (21, 6)]
    run = lambda n: design.step_action_consistency(pairs(action, "component_id long, action_id long"), pairs(step, "action_id long, step_id long"), pairs(on * n, "child long, parent long"), pairs(up * n, "child long, parent long"), pairs(flow, "child long, parent long"))
    want = ["Row(component_id=1, step_id=6, action_id=101)", "Row(component_id=2, step_id=5, action_id=102)"]
    assert rows_of(run(1)) == want
    monkeypatch.setattr(scale, "TASK_ROWS", 1)
    assert rows_of(run(5)) == want and ", 14)" in plan_of(run(5))


def test_state_is_called_by_day_and_not_by_event():
    class Map(dict):
        calls = 0

        def updateValue(self, k, v):
            self.calls, self[k] = self.calls + 1, v

        def iterator(self):
            self.calls += 1
            return iter([*self.items()])

        def removeKey(self, k):
            self.calls += 1
            del self[k]

    class Handle:
        def getMapState(self, *_):
            self.map = Map()
            return self.map

        def getValueState(self, *_):
            return None

        def registerTimer(self, at):
            self.at = at

    from pyspark.sql import Row

    watch, handle = stalls._Watch(1, 3), Handle()
    watch.init(handle)
    for part in (range(5, 600), range(0, 300)):
        list(watch.handleInputRows((1,), iter([Row(at=i * 1_000_000, event_id=i, stage="started") for i in part]), None))
    assert handle.map.calls <= 4 and handle.at == 0 and len(stalls._events(handle.map[(0,)][0])) == 600


def test_streamed_files_grow_with_rows_and_batches_do_not(spark, monkeypatch):
    monkeypatch.setattr(queries, "RANGE_ROWS", 10)
    tables = type("T", (), {"spark": spark})()
    rows, folder = queries.streamed(tables, spark.range(400), 4, 2)
    run = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    assert len(spark.read.parquet(f"{folder}/in").inputFiles()) == 40
    assert len([p for p in run.recentProgress if p["numInputRows"]]) == 2 and spark.read.parquet(f"{folder}/out").count() == 400


def test_text_is_split_off_once(spark):
    df = spark.createDataFrame([("User: Docker up",), ("Docker: fine",), (None,), ("plain",)], "intent string")
    got = intents.filter_non_functional(df)
    assert rows_of(got) == ["Row(intent='Docker: fine')", "Row(intent='plain')"] and "exists(" not in plan_of(got)
    assert intents.filter_non_functional(df, []).count() == 4


def test_mapping_of_merges_is_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(merges, "cut", lambda df: made.append(scale.cut(df)) or made[-1])
    nodes = spark.createDataFrame([("flow", 1, "A", None, None, 0), ("flow", 2, "a ", None, None, 1), ("page", 3, "P", None, None, 0)], "label string, id long, name string, platform string, scenario_id long, seq int")
    merged, moved = merges.merge_design_graph(nodes, spark.createDataFrame([("page", 3, 2), ("page", 3, 1), ("page", 3, 1)], "label string, child long, parent long"))
    assert len(made) == 1 and rows_of(moved) == ["Row(label='page', child=3, parent=1)"] and merged.count() == 2


def test_references_are_dealt_by_counted_pairs(spark, monkeypatch):
    monkeypatch.setattr(scale, "TASK_ROWS", 2)
    files = spark.createDataFrame([(str(i), "order list") for i in range(30)] * 2, "file string, text string")
    got = search.all_references([files], spark.createDataFrame([("order",), ("list",)], "term string"))
    assert got.count() == 60 and got.rdd.getNumPartitions() == 60 and got.groupBy("term").agg(F.count("*").alias("n")).where("n = 30").count() == 2
