"""Checks of functional graphs: personas, outcomes, scenarios, steps and actions as flat tables.

Names of columns: persona(persona_id, persona), outcome(outcome_id, persona_id, outcome, platform, cited), scenario(scenario_id, outcome_id,
scenario, description, cited), step(step_id, scenario_id), action(step_id, action, description). Hot names are summed before they are
shuffled; parents are joined by key and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.find import hits
from ..functions.scale import broadcast_if_small, cut
from ..functions.text import is_system, name_key, platform_key, valid_description
from ..functions.values import FORBIDDEN_PERSONA_NAMES, FORBIDDEN_UI_WORDS, OVERLAP_KEYWORDS

def ratio(part, whole, when_empty: float = 100.0):
    return F.when(whole == 0, F.lit(when_empty)).otherwise(F.round(100.0 * part / whole, 1))


def with_persona(scenario: DataFrame, outcome: DataFrame, persona: DataFrame) -> DataFrame:
    return scenario.join(outcome.select("outcome_id", "persona_id", "outcome"), "outcome_id").join(persona, "persona_id")


def _described() -> Column:
    return F.coalesce(F.trim("description") != "", F.lit(False)).cast("int")


def actions_by_step(action) -> DataFrame:
    """(step_id, a, h): a step's actions, and those with a description that is not blank; summed before any join."""
    return action.groupBy("step_id").agg(F.count("*").alias("a"), F.sum(_described()).alias("h"))


def graph_totals(persona, outcome, scenario, step, action, by_step: DataFrame | None = None) -> DataFrame:
    """Counts of each level by persona, and for the whole graph (persona null). ``by_step``: ``actions_by_step``, if it is there already."""
    s = scenario.select("scenario_id", "outcome_id")
    steps = step.groupBy("scenario_id").agg(F.count("*").alias("steps"))
    by_step = actions_by_step(action) if by_step is None else by_step
    actions = by_step.join(step.select("step_id", "scenario_id"), "step_id").groupBy("scenario_id").agg(F.sum("a").alias("actions"))
    by_outcome = s.join(steps, "scenario_id", "left").join(actions, "scenario_id", "left").groupBy("outcome_id").agg(F.count("*").alias("scenarios"), F.sum("steps").alias("steps"), F.sum("actions").alias("actions"))
    rows = persona.join(outcome, "persona_id", "left").join(by_outcome, "outcome_id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return rows.rollup("persona").agg(F.count("outcome_id").alias("outcomes"), zero("scenarios"), zero("steps"), zero("actions"))


def empty_scenarios(scenario, step) -> DataFrame:
    return scenario.join(step, "scenario_id", "left_anti").select("scenario_id", "scenario")


def duplicate_scenarios(scenario, outcome, persona) -> DataFrame:
    """Scenario names that occur more than once, with the number of places and of personas."""
    return with_persona(scenario, outcome, persona).groupBy("scenario").agg(F.count("*").alias("n"), F.count_distinct("persona").alias("personas"), F.count_distinct("outcome_id").alias("outcomes")).where("n > 1")


def places(rows: DataFrame, name: str, order: list[str], n: int = 5) -> DataFrame:
    """Of names that repeat: the first ``n`` rows in the order, with their ``rank`` and the name's whole number ``total``.

    Spark keeps at most ``n`` rows a name in each task before they are shuffled (the rank is filtered right above its window), and totals
    are summed before they are, so that a hot name is gathered nowhere.
    """
    totals = rows.where(F.trim(name) != "").groupBy(name).agg(F.count("*").alias("total")).where("total > 1")
    rank = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    first = rows.where(F.trim(name) != "").withColumn("rank", rank).where(F.col("rank") <= n)
    return first.join(totals, name)


def uncited(levels: dict[str, DataFrame]) -> DataFrame:
    """(level, id, name) of all nodes without a citation; each level has (id, name, cited)."""
    out = None
    for level, nodes in levels.items():
        rows = nodes.where(~F.coalesce("cited", F.lit(False))).select(F.lit(level).alias("level"), "id", "name")
        out = rows if out is None else out.union(rows)
    return out


def duplicate_outcomes(outcome) -> DataFrame:
    """P1 where one persona has the outcome name twice, else P2."""
    each = outcome.groupBy("outcome", "persona_id").agg(F.count("*").alias("k"))
    return each.groupBy("outcome").agg(F.sum("k").alias("n"), F.when(F.max("k") > 1, "P1").otherwise("P2").alias("severity")).where("n > 1")


def citation_coverage(outcome, scenario) -> DataFrame:
    rows = outcome.select(F.lit("outcome").alias("level"), "cited").unionByName(scenario.select(F.lit("scenario").alias("level"), "cited"))
    got = F.sum(F.col("cited").cast("int"))
    return rows.groupBy("level").agg(F.count("*").alias("total"), got.alias("with_citation"), ratio(got, F.count("*")).alias("pct"))


def description_coverage(scenario, outcome, persona, step, action, by_step: DataFrame | None = None) -> DataFrame:
    """Scenarios, System actions and human actions that have a description that is not blank."""
    by_step = actions_by_step(action) if by_step is None else by_step
    owner = with_persona(scenario.select("scenario_id", "outcome_id"), outcome, persona).select("scenario_id", is_system("persona").alias("sys"))
    kind = F.when(F.col("sys"), "system_action").otherwise("human_action").alias("kind")
    actions = by_step.join(step.select("step_id", "scenario_id"), "step_id").join(owner, "scenario_id").groupBy(kind).agg(F.sum("a").alias("total"), F.sum("h").alias("described"))
    rows = scenario.agg(F.lit("scenario").alias("kind"), F.count("*").alias("total"), F.sum(_described()).alias("described")).where("total > 0").unionByName(actions)
    return rows.select("kind", "total", "described", ratio(F.col("described"), F.col("total")).alias("pct"))


def platform_agnostic(action, words=FORBIDDEN_UI_WORDS) -> DataFrame:
    """Per action name with a word of user interfaces (as a substring): its uses and the words."""
    found = F.array_join(F.array_sort(F.filter(F.array(*map(F.lit, words)), lambda w: F.lower("action").contains(w))), ",")
    return action.groupBy("action").agg(F.count("*").alias("n")).withColumn("words", found).where("words <> ''")


def persona_quality(persona, outcome, scenario, step, action, by_step: DataFrame | None = None) -> DataFrame:
    totals = graph_totals(persona, outcome, scenario, step, action, by_step)
    whole = totals.where("persona IS NULL").select(F.col("scenarios").alias("all_scenarios"))
    share = F.col("scenarios") / F.greatest("all_scenarios", F.lit(1))
    flags = F.array_join(F.filter(F.array(F.when(share > 0.4, "BLOATED"), F.when((F.col("scenarios") <= 1) & (F.col("actions") < 5), "THIN"), F.when(F.lower(F.trim("persona")).isin(FORBIDDEN_PERSONA_NAMES), "FORBIDDEN")), lambda x: x.isNotNull()), ",")
    return totals.where("persona IS NOT NULL").join(F.broadcast(whole)).select("persona", "outcomes", "scenarios", "actions", F.round(share, 4).alias("share"), flags.alias("flags"))


def cross_persona_overlap(scenario, outcome, persona, keywords=OVERLAP_KEYWORDS) -> DataFrame:
    """Keywords in the scenario names of three personas or more."""
    names = with_persona(scenario, outcome, persona).select("persona", F.lower("scenario").alias("s")).distinct()
    hit = names.select("persona", F.explode(F.filter(F.array(*map(F.lit, keywords)), lambda w: F.col("s").contains(w))).alias("keyword"))
    return hit.groupBy("keyword").agg(F.count_distinct("persona").alias("personas"), F.array_join(F.array_sort(F.collect_set("persona")), ",").alias("persona_list")).where("personas >= 3")


def source_coverage(stories: DataFrame, texts: DataFrame) -> DataFrame:
    """Per story of (story, keyword): the share of keywords that stand in some text; FULL from 60 %, PARTIAL above 0, else MISSING. Any number of keywords: texts are read once for each block of them."""
    rows = stories.withColumn("term", F.lower("keyword"))
    seen = hits(texts.select(F.lower("text").alias("text")), rows).distinct().withColumnRenamed("term", "found")
    rows = rows.join(seen, F.col("term") == F.col("found"), "left").groupBy("story").agg(F.count("*").alias("total"), F.count("found").alias("found"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("found").isNull(), F.col("keyword")))), ",").alias("missing"))
    return rows.withColumn("status", F.when(F.col("found") >= 0.6 * F.col("total"), "FULL").when(F.col("found") > 0, "PARTIAL").otherwise("MISSING"))


def embed_texts(persona, outcome, scenario, step, action) -> DataFrame:
    """(level, id, embed_text) of every node: the names of the chain above it and its own, a line each, the persona's first."""
    line = lambda level: F.concat(F.lit(f"{level.capitalize()}: "), F.col(level))
    chain = persona.select("persona_id", line("persona").alias("text"))
    out = chain.select(F.lit("persona").alias("level"), F.col("persona_id").cast("long").alias("id"), F.col("text").alias("embed_text"))
    above = "persona"
    for level, rows in (("outcome", outcome), ("scenario", scenario), ("step", step), ("action", action)):
        chain = rows.select(f"{above}_id", f"{level}_id", level).join(chain, f"{above}_id").select(f"{level}_id", F.concat_ws("\n", "text", line(level)).alias("text"))
        out = out.union(chain.select(F.lit(level), F.col(f"{level}_id").cast("long"), "text"))
        above = level
    return out


def health(findings: DataFrame) -> DataFrame:
    """From (severity, n): the sums by severity and the label."""
    p = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).cast("long").alias(s.lower())
    label = F.when((F.col("p0") == 0) & (F.col("p1") <= 3), "HEALTHY").when(F.col("p0") == 0, "NEEDS_ATTENTION").otherwise("CRITICAL")
    return findings.agg(p("P0"), p("P1"), p("P2")).withColumn("label", label)


def functional_health(persona, outcome, scenario, step, action) -> DataFrame:
    """Sums of findings by severity. Actions are read once, with the scenario of their step; totals are computed once."""
    n = lambda severity, df: df.agg(F.count("*").alias("n")).select(F.lit(severity).alias("severity"), "n")
    by_step = cut(actions_by_step(action))
    quality = cut(persona_quality(persona, outcome, scenario, step, action, by_step))
    cited = citation_coverage(outcome, scenario).agg((F.sum("with_citation") < F.sum("total")).cast("long").alias("n")).select(F.lit("P1").alias("severity"), "n")
    described = description_coverage(scenario, outcome, persona, step, action, by_step).where("kind = 'system_action' AND pct < 80")
    duplicates = duplicate_outcomes(outcome)
    flags = quality.agg(*[F.sum(F.col("flags").contains(f).cast("long")).alias(f) for f in ("FORBIDDEN", "BLOATED", "THIN")], F.sum((F.col("flags").contains("BLOATED") | F.col("flags").contains("THIN")).cast("long")).alias("odd"))
    flagged = flags.select(F.explode(F.array(F.struct(F.lit("P0").alias("severity"), F.col("FORBIDDEN").alias("n")), F.struct(F.lit("P1").alias("severity"), F.col("odd").alias("n")))).alias("f")).select("f.*")
    parts = [
        n("P0", empty_scenarios(scenario, step)), flagged, n("P1", duplicate_scenarios(scenario, outcome, persona)), duplicates.groupBy("severity").agg(F.count("*").alias("n")),
        n("P1", platform_agnostic(action)), cited, n("P1", described), n("P2", cross_persona_overlap(scenario, outcome, persona)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return health(out)


def outcome_halves(outcome, persona) -> DataFrame:
    """Outcomes by name that have a human or a System half alone."""
    each = outcome.join(persona, "persona_id").groupBy(name_key("outcome").alias("outcome_key")).agg(F.max(is_system("persona")).alias("has_system"), F.max(~is_system("persona")).alias("has_human"))
    return each.where("has_system <> has_human")


def reconcile_outcomes(outcome) -> DataFrame:
    """Within a persona, outcomes of one name go to the one with the smallest id: old id, kept id and name."""
    key = name_key("outcome")
    kept = outcome.groupBy("persona_id", key.alias("k")).agg(F.min(F.struct("outcome_id", "outcome")).alias("m"))
    joined = outcome.select("outcome_id", "persona_id", key.alias("k")).join(kept, ["persona_id", "k"])
    return joined.select("outcome_id", F.col("m.outcome_id").alias("kept_id"), F.col("m.outcome").alias("kept_name"))


def scope_by_parent(edges: list[DataFrame], roots: DataFrame) -> list[DataFrame]:
    """Cascade over (child, parent) edges: children with any kept parent, level by level."""
    out, kept = [], roots
    for e in edges:
        kept = e.join(kept.toDF("parent"), "parent", "left_semi").select("child").distinct()
        out.append(kept)
    return out


def scenario_paging(scenario, outcome, persona, page: int, limit: int) -> DataFrame:
    """Scenarios without a design, not of a System persona; a page of them by id, and whether more follow (counted before the filters)."""
    total = scenario.agg(F.count("*").alias("total"))
    systems = outcome.join(persona.where(is_system("persona")), "persona_id").select("outcome_id")
    rows = scenario.where(~F.coalesce("is_design_generated", F.lit(False))).join(systems, "outcome_id", "left_anti")
    picked = rows.orderBy("scenario_id").offset((page - 1) * limit).limit(limit)
    return picked.join(F.broadcast(total)).select("scenario_id", "scenario", (F.lit(page * limit) < F.col("total")).alias("has_more"))


def ordered_steps(scenarios, step) -> DataFrame:
    """Steps of a page of scenarios, numbered from 1 within each by id."""
    mine = step.join(broadcast_if_small(cut(scenarios.select("scenario_id"))), "scenario_id", "left_semi")
    return mine.select("scenario_id", "step_id", "step", F.row_number().over(Window.partitionBy("scenario_id").orderBy("step_id")).alias("order"))


def description_gaps(nodes: DataFrame) -> DataFrame:
    """Per label: nodes, and those whose description is missing, too short or a placeholder."""
    bad = F.sum((~valid_description("description")).cast("int"))
    return nodes.groupBy("label").agg(F.count("*").alias("total"), bad.alias("missing"), ratio(F.count("*") - bad, F.count("*")).alias("pct"))


def outcome_platforms(outcome) -> DataFrame:
    return outcome.groupBy(platform_key("platform").alias("platform")).agg(F.count("*").alias("n"))
