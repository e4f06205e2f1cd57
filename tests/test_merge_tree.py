"""Merged trees against the rule in plain Python, on odd names, copies and null keys."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from graphspark.functions.text import name_key
from graphspark.operators import merges

ODD = ["a", " A ", "a  b", "A\tb", "a \x0b\f\r\n b", "x|y", "x\\|y", "p > q", "\\", "\t", "  ", "", "É  è", "no break", None]


def key_of(name):
    bare = None if name is None else re.sub(r"[ \t\n\x0b\f\r]+", " ", name).strip(" ").lower()
    return "" if bare is None else re.sub(r"([\\|>])", r"\\\1", bare)


def test_name_keys_equal_the_regular_expression(spark):
    rows = spark.createDataFrame([(n,) for n in ODD], "n string").select("n", name_key("n").alias("k"), F.lower(F.trim(F.regexp_replace("n", r"\s+", " "))).alias("want")).collect()
    assert len(rows) == len(ODD) and all(r.k == r.want for r in rows)


def side(spark, n):
    text = lambda i: None if i % 3 == 0 else f"d{i % 2}-{n}"
    persona = [(i, ODD[i]) for i in range(4)] + [(1, "again"), (None, "lost")]
    outcome = [(i, i % 5, ODD[(i * (n + 1)) % 15], [None, " Web ", "web"][i % 3], text(i)) for i in range(40)] + [(3, None, "lost", None, None)]
    scenario = [(i, i % 50, ODD[i % 15], text(i), None if i % 4 == 0 else [f"c{i % 3}", "x", None][: i % 4]) for i in range(90)]
    make = spark.createDataFrame
    return {
        "persona": persona, "outcome": outcome, "scenario": scenario,
    }, {
        "persona": make(persona, "persona_id long, persona string"), "outcome": make(outcome, "outcome_id long, persona_id long, outcome string, platform string, description string"),
        "scenario": make(scenario, "scenario_id long, outcome_id long, scenario string, description string, citations array<string>"),
    }


def test_merge_equals_the_rule(spark):
    (a, old), (b, new) = side(spark, 0), side(spark, 1)
    nodes = {}
    for seq, s in enumerate((a, b)):
        personas = [(i, key_of(name), name) for i, name in s["persona"]]
        outcomes = [(i, f"{path} > {'' if name is None else key_of(name) + '|'}{(p or '').strip().lower() or 'default'}", name, d) for i, up, name, p, d in s["outcome"] for j, path, _ in personas if up is not None and up == j]
        scenarios = [(f"{path} > {key_of(name)}", name, d, c) for _, up, name, d, c in s["scenario"] for j, path, _, _ in outcomes if up == j]
        found = [("persona", p, n, None, None) for _, p, n in personas] + [("outcome", p, n, d, None) for _, p, n, d in outcomes] + [("scenario", *r) for r in scenarios]
        for level, path, name, d, c in found:
            nodes.setdefault((level, path), []).append((seq, name, d, c or []))
    blank = lambda x: (x is not None, x or "")
    want = {}
    for k, rows in nodes.items():
        first = min(rows, key=lambda r: (r[0], blank(r[1])))
        said = [(r[0], r[2]) for r in rows if r[2] is not None]
        want[k] = (first[1], max(said)[1] if said else None, {x for r in rows for x in r[3]}, first[0] == 1)
    merged = merges.merge_tree(old, new)
    got = {(r.level, r.path): (r.name, r.description, set(r.citations), r.is_new) for r in merged.collect()}
    assert got == want and merged.count() == len(want)


def test_keys_are_made_after_the_join_and_values_are_held_once(spark):
    with redirect_stdout(io.StringIO()) as out:
        merges.merge_tree(side(spark, 0)[1], side(spark, 1)[1]).explain()
    plan = out.getvalue()
    assert "min_by(" not in plan and "max_by(" not in plan and re.search(r"keys=\[(xxhash64\(|h#|_groupingexpression#)", plan)
    assert "own#" not in plan
