"""Specification tables: ordered rows of scenarios, steps and actions, and indexes of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import running


def sort_by_order(df: DataFrame, *ties: str) -> DataFrame:
    """Rows by their ``order``, those without one last; ``ties`` makes the order total."""
    return df.orderBy(F.col("order").asc_nulls_last(), *ties)


def _numbered(df: DataFrame, parent: str, ident: str, name: str) -> DataFrame:
    """Items of a parent numbered from 1 by ``order``, those without one last."""
    order = [F.col("order").asc_nulls_last()] if "order" in df.columns else []
    return df.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(*order, ident)))


def plain_rows(scenario: DataFrame, step: DataFrame, action: DataFrame) -> DataFrame:
    """One row an action (or a filler row), steps in order (created_at, step_id); names and numbers stand on their first row alone."""
    steps = step.withColumn("step_no", F.row_number().over(Window.partitionBy("scenario_id").orderBy(F.col("created_at").asc_nulls_last(), "step_id")))
    rows = scenario.select("scenario_id", "scenario").join(steps.select("scenario_id", "step_id", "step", "step_no"), "scenario_id", "left").join(action.select("step_id", "action_id", "action"), "step_id", "left")
    in_step = F.row_number().over(Window.partitionBy("scenario_id", "step_no").orderBy("action_id", "action"))
    row = rows.withColumn("action_no", in_step)
    first_scenario = (F.coalesce("step_no", F.lit(1)) == 1) & (F.col("action_no") == 1)
    text = F.when(F.col("step_no").isNull(), "(no steps)").when(F.col("action").isNull(), "(no actions)").otherwise(F.col("action"))
    return row.select("scenario_id", F.when(first_scenario, F.col("scenario")).alias("scenario"), F.when(F.col("action_no") == 1, F.col("step_no")).alias("step_no"), F.when(F.col("action_no") == 1, F.col("step")).alias("step"), F.coalesce("step_no", F.lit(0)).alias("step_pos"), "action_no", text.alias("action"))


def full_rows(scenario: DataFrame, step: DataFrame, action: DataFrame) -> DataFrame:
    """A scenario's own table: one row an action, or a filler row, by ``order`` (ids break ties); a step's number and name stand on its first row alone.

    ``source`` is the first citation (array ``citations``) of the action, else of its step, else of the outcome (the scenario's column
    ``outcome_citations``); a step without actions has its own alone.
    """
    steps = _numbered(step, "scenario_id", "step_id", "step_pos").select("scenario_id", "step_id", "step", "step_pos", F.get("citations", F.lit(0)).alias("step_source"))
    actions = _numbered(action, "step_id", "action_id", "action_no").select("step_id", "action_id", "action", "action_no", F.get("citations", F.lit(0)).alias("action_source"))
    rows = scenario.select("scenario_id", F.get("outcome_citations", F.lit(0)).alias("outcome_source")).join(steps, "scenario_id", "left").join(actions, "step_id", "left")
    text = F.when(F.col("step_id").isNull(), "").when(F.col("action_id").isNull(), "(no actions)").otherwise(F.col("action"))
    source = F.when(F.col("step_id").isNull(), F.lit(None)).when(F.col("action_id").isNull(), F.col("step_source")).otherwise(F.coalesce("action_source", "step_source", "outcome_source"))
    first = F.coalesce("action_no", F.lit(1)) == 1
    return rows.select(
        "scenario_id", F.coalesce("step_pos", F.lit(0)).alias("step_pos"), F.coalesce("action_no", F.lit(1)).alias("action_no"), F.when(first, F.col("step_pos")).alias("step_no"),
        F.when(F.col("step_id").isNull(), "(no steps)").when(first, F.col("step")).alias("step"), text.alias("action"), source.alias("source"),
    )


def outcome_citations(citations: DataFrame) -> DataFrame:
    """(outcome_id, pos, doc): distinct documents in the order in which they are first seen."""
    first = citations.groupBy("outcome_id", "doc").agg(F.min("pos").alias("pos"))
    return first.groupBy("outcome_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc"))), lambda x: x["doc"]), ",").alias("docs"))


def source_index(citations: DataFrame) -> DataFrame:
    """Distinct documents by name, numbered from 1; sorted in ranges, so that no task holds them all."""
    docs = citations.select("doc").where("doc IS NOT NULL").distinct()
    return running(docs, [F.col("doc")], F.lit(1), "before").select("doc", (F.col("before") + 1).cast("int").alias("no"))
