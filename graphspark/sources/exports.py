"""Exports of graphs: unwrap, flatten, nest again; event logs; findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_system

_ACTION = "struct<id:string,action:string,description:string,apis:array<struct<type:string,method:string,url:string>>>"
_STEP = f"struct<id:string,step:string,actions:array<{_ACTION}>>"
_SCENARIO = f"struct<id:string,scenario:string,description:string,steps:array<{_STEP}>>"
_OUTCOME = f"struct<id:string,outcome:string,platform:string,description:string,scenarios:array<{_SCENARIO}>>"
EXPORT = f"personas array<struct<id:string,persona:string,outcomes:array<{_OUTCOME}>>>"
EVENT = "ts timestamp, event string, repo string, status string, stage string"


def unwrap(raw: Column) -> Column:
    """The graph's JSON from a text that may be wrapped once or twice as ``[{"text": ...}]``, in a list, or under ``data``."""
    once = F.coalesce(F.get_json_object(raw, "$[0].text"), raw)
    twice = F.coalesce(F.get_json_object(once, "$[0].text"), once)
    first = F.coalesce(F.get_json_object(twice, "$[0]"), twice)
    return F.coalesce(F.get_json_object(first, "$.data"), first)


def parse_exports(raw: DataFrame, text: str = "value") -> DataFrame:
    """One row a text, with nested ``personas``."""
    return raw.select(F.from_json(unwrap(F.col(text)), f"struct<{EXPORT.replace('personas ', 'personas:', 1)}>").alias("g")).select("g.personas")


def read_graph_export(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, with nested ``personas``."""
    return parse_exports(spark.read.text(path, wholetext=True))


_NODE = "struct<label:string,type:string,id:string,name:string>"


def nodes_by_label(raw: DataFrame, labels: list[str], text: str = "value") -> DataFrame:
    """(label, id, name) of the nodes of JSON texts in any of their forms: lists by label, a list under ``nodes`` or ``data``, or a list alone.

    In a list a node's label is its ``label``, else its ``type``; unknown labels are left out. A text with any list by label has no other.
    """
    parsed = lambda path: F.from_json(F.get_json_object(text, path), f"array<{_NODE}>")
    named_as = lambda label: lambda n: F.struct(F.lit(label).alias("label"), n["id"].alias("id"), n["name"].alias("name"))
    listed = [F.transform(F.coalesce(parsed(f"$.{x}"), F.array().cast(f"array<{_NODE}>")), named_as(x)) for x in labels]
    flat = F.coalesce(parsed("$.nodes"), parsed("$.data"), F.from_json(F.when(F.ltrim(text).startswith("["), F.col(text)), f"array<{_NODE}>"), F.array().cast(f"array<{_NODE}>"))
    named = F.filter(F.transform(flat, lambda n: F.struct(F.coalesce(n["label"], n["type"]).alias("label"), n["id"].alias("id"), n["name"].alias("name"))), lambda n: n["label"].isin(labels))
    by_label = F.concat(*listed)
    return raw.select(F.explode(F.when(F.size(by_label) > 0, by_label).otherwise(named)).alias("n")).select("n.*")


def flatten_functional(graph: DataFrame) -> dict[str, DataFrame]:
    """Persona, outcome, scenario, step, action and api tables with their parents' ids and names, from the top down to actions, and whether the persona is a System."""
    named = ["persona", "is_system", "outcome", "scenario"]
    persona = graph.select(F.explode("personas").alias("p")).select(F.col("p.id").alias("persona_id"), F.col("p.persona").alias("persona"), F.coalesce(is_system("p.persona"), F.lit(False)).alias("is_system"), F.col("p.outcomes").alias("children"))
    outcome = persona.select("persona_id", *named[:2], F.explode("children").alias("o")).select("persona_id", *named[:2], F.col("o.id").alias("outcome_id"), "o.outcome", "o.platform", "o.description", F.col("o.scenarios").alias("children"))
    scenario = outcome.select(*named[:3], "outcome_id", F.explode("children").alias("s")).select(*named[:3], "outcome_id", F.col("s.id").alias("scenario_id"), "s.scenario", "s.description", F.col("s.steps").alias("children"))
    scenario = scenario.withColumns({"step_count": F.coalesce(F.size("children"), F.lit(0)), "action_count": F.coalesce(F.aggregate("children", F.lit(0), lambda n, s: n + F.coalesce(F.size(s["actions"]), F.lit(0))), F.lit(0))})
    step = scenario.select(*named, "scenario_id", F.posexplode("children").alias("order", "t")).select(*named, "scenario_id", (F.col("order") + 1).alias("order"), F.col("t.id").alias("step_id"), "t.step", F.col("t.actions").alias("children"))
    action = step.select(*named, "step_id", "step", F.posexplode("children").alias("order", "a")).select(*named, "step_id", "step", (F.col("order") + 1).alias("order"), F.col("a.id").alias("action_id"), "a.action", "a.description", F.col("a.apis").alias("children"))
    api = action.select("action_id", F.explode("children").alias("x")).select("action_id", "x.type", "x.method", "x.url")
    return {k: v.drop("children") for k, v in (("persona", persona), ("outcome", outcome), ("scenario", scenario), ("step", step), ("action", action), ("api", api))}


def rebuild_outcome_detail(scenario: DataFrame, step: DataFrame, action: DataFrame) -> DataFrame:
    """One row a scenario, with the outcome that it belongs to: its steps in order with their actions, nested again. An outcome's document is its rows; none is gathered in one row, however many scenarios an outcome has."""
    actions = action.groupBy("step_id").agg(F.sort_array(F.collect_list(F.struct("action_id", "action", "description"))).alias("actions"))
    steps = step.join(actions, "step_id", "left").groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("step_id", "step", "actions"))).alias("steps"))
    return scenario.join(steps, "scenario_id", "left").select("outcome_id", "scenario_id", "scenario", "description", F.coalesce("steps", F.array()).alias("steps"))


def outcome_manifest(outcome: DataFrame, persona: DataFrame) -> DataFrame:
    """(outcome_id, outcome, persona): a row for each outcome that has a document."""
    return outcome.join(persona, "persona_id").select("outcome_id", "outcome", "persona")


def write_outcome_detail(detail: DataFrame, manifest: DataFrame, path: str) -> None:
    """The documents, a folder an outcome, and the manifest beside them."""
    detail.write.mode("overwrite").partitionBy("outcome_id").json(f"{path}/outcomes")
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def read_jsonl_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(EVENT).json(path)


def findings(check: str, severity: str, rows: DataFrame, key: str, detail: str | None = None) -> DataFrame:
    """Rows of a check as findings (check, severity, key, detail)."""
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col(key).cast("string").alias("key"), (F.col(detail).cast("string") if detail else F.lit(None).cast("string")).alias("detail"))


def write_report(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)
