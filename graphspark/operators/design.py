"""Checks of design graphs. Many-parent links are edge tables (child, parent); id arrays are exploded once by ``edges``.

Columns: nodes have id, name and type columns; every walk reduces to distinct (child, ancestor) after each hop, so that shared nodes do
not multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import broadcast_if_small, cut, tasks_for
from ..functions.text import is_system, name_tokens, platform_key
from ..functions.values import COMPONENT_TYPES, EXPECTED_TEMPLATES, MIN_SUPPORTING, SYNONYMS
from .functional import health


def edges(nodes: DataFrame, array: str) -> DataFrame:
    """(child, parent), duplicates included."""
    return nodes.select(F.col("id").alias("child"), F.explode(array).alias("parent"))


def orphan_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return nodes.join(links.select(F.col("child").alias("id")), "id", "left_anti")


def dangling_parent_refs(links: DataFrame, parents: DataFrame) -> DataFrame:
    """Links whose parent is no node of ``parents`` (column id)."""
    return links.join(parents.select(F.col("id").alias("parent")), "parent", "left_anti").select("child", "parent")


def broken_chains(component_page, page_flow, flow_journey, journeys) -> DataFrame:
    """Pages of components without flows; flows of pages without journeys, or whose journeys all are missing. Links may come twice.

    Rows are dealt by key to as many tasks as their number asks for; links without a parent, of which there may be many, are not shuffled.
    """
    parts = tasks_for(component_page, page_flow, flow_journey)
    pages = component_page.select(F.col("parent").alias("id")).repartition(parts, "id").distinct()
    above = page_flow.select(F.col("child").alias("id"), "parent").repartition(parts, "id")
    no_flow = pages.join(above, "id", "left_anti").select(F.lit("page_without_flow").alias("issue"), "id")
    flows = above.join(pages, "id", "left_semi").select(F.col("parent").alias("child")).repartition(parts, "child").distinct()
    known = journeys.select(F.col("id").alias("parent")).distinct().withColumn("known", F.lit(1))
    links = flow_journey.where("parent IS NOT NULL").select("child", "parent").repartition(parts, "parent").join(known, "parent", "left")
    links = links.repartition(parts, "child").groupBy("child").agg(F.count("parent").alias("n"), F.count("known").alias("k"))
    state = flows.join(links, "child", "left").where("coalesce(k, 0) = 0")
    return no_flow.union(state.select(F.when(F.coalesce("n", F.lit(0)) == 0, "flow_without_journey").otherwise("flow_with_missing_journeys").alias("issue"), F.col("child").alias("id")))


def duplicate_linkage(links: DataFrame) -> DataFrame:
    return links.groupBy("child", "parent").agg(F.count("*").alias("n")).where("n > 1")


def empty_hierarchy(parents: DataFrame, links: DataFrame, issue: str) -> DataFrame:
    return parents.join(links.select(F.col("parent").alias("id")), "id", "left_anti").select(F.lit(issue).alias("issue"), "id")


def duplicate_names(nodes: DataFrame, kind: str) -> DataFrame:
    """Exact names that repeat within (kind, platform); blank names are left out before the shuffle."""
    return nodes.where(F.trim("name") != "").groupBy("name", kind, platform_key("platform").alias("platform")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def expanded(tokens):
    """Tokens with their synonyms."""
    others: dict[str, list[str]] = {}
    for x, y in SYNONYMS:
        others.setdefault(x, []).append(y)
        others.setdefault(y, []).append(x)
    known = F.create_map(*[c for token, words in others.items() for c in (F.lit(token), F.array(*map(F.lit, words)))])
    return F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), F.array().cast("array<string>"))))))


def near_duplicate_names(nodes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Pairs of lower-case names of one label and platform whose token sets have a Jaccard score of ``threshold`` or more, plain or with synonyms.

    Distinct names first. Of a set with n tokens only the rarest n - ceil(threshold * n) + 1 are indexed, so that frequent tokens meet
    in no bucket; both token sets are indexed apart. The sets travel with the index: a pair is scored where it meets, and counts only
    at the first indexed token that the two share, so candidates are never shuffled.
    """
    tokens = name_tokens("name")
    names = nodes.where(F.trim("name") != "").select("label", platform_key("platform").alias("platform"), F.lower("name").alias("key"), F.array_sort(tokens).alias("plain"), F.array_sort(expanded(tokens)).alias("wide"))
    names = names.groupBy("label", "platform", "key").agg(F.min("plain").alias("plain"), F.min("wide").alias("wide"))
    name, pairs = ["label", "platform", "key"], None

    def jaccard(k: str):
        shared = F.size(F.array_intersect(f"a.{k}", f"b.{k}"))
        return F.coalesce(F.round(shared / F.nullif(F.size(f"a.{k}") + F.size(f"b.{k}") - shared, F.lit(0)), 4), F.lit(0.0))

    for which in ("plain", "wide"):
        one = names.select(*name, "plain", "wide", F.explode(which).alias("token"))
        often = one.groupBy("label", "platform", "token").agg(F.count("*").alias("f"))
        ranked = one.join(often, ["label", "platform", "token"]).groupBy(*name).agg(F.first("plain").alias("plain"), F.first("wide").alias("wide"), F.array_sort(F.collect_list(F.struct("f", "token"))).getField("token").alias("rare"))
        index = ranked.withColumn("rare", F.slice("rare", 1, (F.size("rare") - F.ceil(threshold * F.size("rare")) + 1).cast("int"))).withColumn("token", F.explode("rare"))
        small, large = F.least(F.size(f"a.{which}"), F.size(f"b.{which}")), F.greatest(F.size(f"a.{which}"), F.size(f"b.{which}"))
        on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("label", "platform", "token")]
        met = index.alias("a").join(index.alias("b"), on).where((F.col("a.key") < F.col("b.key")) & (small >= threshold * large) & (jaccard(which) >= threshold))
        if which == "wide":  # what the plain sets have met is out already; names without synonyms have nothing new
            met = met.where(((F.col("a.plain") != F.col("a.wide")) | (F.col("b.plain") != F.col("b.wide"))) & (jaccard("plain") < threshold))
        met = met.where(F.array_intersect("a.rare", "b.rare")[0] == F.col("a.token"))
        met = met.select("a.label", "a.platform", F.col("a.key").alias("a"), F.col("b.key").alias("b"), F.greatest(jaccard("plain"), jaccard("wide")).alias("score"))
        pairs = met if pairs is None else pairs.union(met)
    return pairs


def missing_scenario_id(journeys: DataFrame) -> DataFrame:
    return journeys.where("scenario_id IS NULL").select("id", "name")


def duplicate_scenario_ids(journeys: DataFrame, own=None) -> DataFrame:
    """Scenario ids on more than one journey, over all platforms; ``own`` tells the journeys of this run."""
    once = journeys.where("scenario_id IS NOT NULL").withColumn("own", own if own is not None else F.lit(True)).dropDuplicates(["id"])
    return once.groupBy("scenario_id").agg(F.count("*").alias("n"), F.bool_or("own").alias("counts")).where("n > 1")


def child_platform_mismatch(children: DataFrame, links: DataFrame, parents: DataFrame) -> DataFrame:
    """Children whose parents' platforms are not just their own; ``passed`` is what the child hands down."""
    rows = _platforms(children, links, parents.select(F.col("id").alias("parent"), platform_key("platform").alias("p")))
    return rows.where(F.col("expected") != F.array("platform")).select("id", "platform", F.array_join("expected", ",").alias("expected"), "passed")


def _platforms(children: DataFrame, links: DataFrame, handed: DataFrame) -> DataFrame:
    """id, platform, expected and passed of the children of nodes (parent, p)."""
    up = links.distinct().join(handed, "parent").groupBy("child").agg(F.sort_array(F.collect_set("p")).alias("expected"))
    rows = children.select("id", platform_key("platform").alias("platform")).join(up, F.col("id") == F.col("child")).drop("child")
    return rows.withColumn("passed", F.when(F.array_contains("expected", F.col("platform")), F.col("platform")).otherwise(F.col("expected")[0]))


def platforms_handed_down(journeys: DataFrame, levels: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(label, id, platform, expected, reason): nodes (label, nodes, links to the level above) that are not on the platform handed down to them from their journeys, level by level."""
    handed, out = journeys.where("id IS NOT NULL").select(F.col("id").alias("parent"), platform_key("platform").alias("p")), None
    reason = F.when(F.array_contains("expected", F.col("platform")), "shared by journeys on different platforms").otherwise("not on its journey's platform")
    for label, nodes, links in levels:
        rows = cut(_platforms(nodes, links, handed))
        bad = rows.where(F.col("expected") != F.array("platform")).select(F.lit(label).alias("label"), "id", "platform", F.array_join("expected", ",").alias("expected"), reason.alias("reason"))
        handed, out = rows.select(F.col("id").alias("parent"), F.col("passed").alias("p")), bad if out is None else out.union(bad)
    return out


def actions_on_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that have links to actions (child, parent), with their number: actions belong to components."""
    return pages.select("id", "name").join(links.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("n")), "id")


def design_health(findings: list[tuple[str, DataFrame]]) -> DataFrame:
    """From (severity, finding rows) of each check: sums by severity and the label. Rows with a column ``n`` count that often, rows with a column ``severity`` have their own."""
    out = None
    for severity, rows in findings:
        n = F.coalesce(F.sum("n"), F.lit(0)) if "n" in rows.columns else F.count("*")
        part = rows.groupBy("severity").agg(n.cast("long").alias("n")) if "severity" in rows.columns else rows.agg(n.cast("long").alias("n")).select(F.lit(severity).alias("severity"), "n")
        out = part if out is None else out.unionByName(part)
    return health(out)


def invalid_enums(nodes: DataFrame, field: str, valid: list[str]) -> DataFrame:
    """P0 where the value is outside the closed set; P1 where its upper-case form is inside."""
    bad = nodes.where(F.col(field).isNotNull() & ~F.col(field).isin(valid))
    return bad.select("id", F.col(field).alias("value"), F.when(F.upper(field).isin(valid), "P1").otherwise("P0").alias("severity"))


def template_compliance(pages: DataFrame, components: DataFrame, component_page: DataFrame, component_group: DataFrame | None = None, page_group: DataFrame | None = None) -> DataFrame:
    """Pages with no template (P0), with more than one, or with one that their type doesn't expect (P2).

    Links that hold for whole groups are given as such: ``component_group`` (child, group) and ``page_group`` (parent, group) link all components
    of a group to all its pages; a node has one group. Templates are summed by group, and no pairs are made. A link that a group has as well counts once.
    """
    templates = components.where("type = 'TEMPLATE'").groupBy(F.col("id").alias("child")).agg(F.count("*").alias("n"), F.min("name").alias("template"))
    sums = [F.sum("n").alias("n"), F.min("template").alias("template")]
    links = component_page.select("child", "parent").distinct().join(templates, "child")
    if component_group is not None and page_group is not None:
        of, on = component_group.select("child", "group").distinct(), page_group.select("parent", "group").distinct()
        by_group = of.join(templates, "child").groupBy("group").agg(*sums)
        both = F.coalesce(F.col("group") == F.col("page_group"), F.lit(False))
        own = links.join(of, "child", "left").join(on.withColumnRenamed("group", "page_group"), "parent", "left").where(~both)
        per = own.select("parent", "n", "template").unionByName(on.join(by_group, "group").select("parent", "n", "template")).groupBy(F.col("parent").alias("id")).agg(*sums)
    else:
        per = links.groupBy(F.col("parent").alias("id")).agg(*sums)
    expected = F.element_at(F.create_map(*[F.lit(x) for kv in EXPECTED_TEMPLATES.items() for x in kv]), F.col("page_type"))
    rows = pages.select("id", "page_type").join(per, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    issue = F.when(F.col("n") == 0, "none").when(F.col("n") > 1, "several").when(F.col("template") != expected, "unexpected")
    return rows.select("id", F.col("n").cast("long").alias("templates"), issue.alias("issue"), F.when(F.col("n") == 0, "P0").otherwise("P2").alias("severity")).where("issue IS NOT NULL")


def supporting_components(components: DataFrame, uses: DataFrame) -> DataFrame:
    """From (id, used name): too few by type, names that no component has, templates that use other than organisms."""
    least = F.element_at(F.create_map(*[F.lit(x) for kv in MIN_SUPPORTING.items() for x in kv]), F.col("type"))
    counts = uses.groupBy("id").agg(F.count("*").alias("n"))
    few = components.join(counts, "id", "left").where(F.coalesce("n", F.lit(0)) < least).select("id", F.lit("too_few").alias("issue"), F.lit(None).cast("string").alias("used"))
    last = components.groupBy(F.lower("name").alias("key")).agg(F.max_by("type", "id").alias("used_type"))
    named = uses.join(last, F.lower("used") == F.col("key"), "left")
    unknown = named.where("key IS NULL").select("id", F.lit("unknown").alias("issue"), "used")
    level = named.join(components.select("id", "type"), "id").where("type = 'TEMPLATE' AND used_type <> 'ORGANISM'").select("id", F.lit("not_organism").alias("issue"), "used")
    return few.union(unknown).union(level)


def type_distribution(components: DataFrame) -> DataFrame:
    """Counts by type; types outside the closed set count once, as UNKNOWN."""
    return components.groupBy(F.when(F.col("type").isin(COMPONENT_TYPES), F.col("type")).otherwise("UNKNOWN").alias("type")).agg(F.count("*").alias("n"))


def modality_distribution(flows: DataFrame) -> DataFrame:
    """Counts of flows by modality as it stands; UNKNOWN where there is none."""
    return flows.groupBy(F.coalesce("modality", F.lit("UNKNOWN")).alias("modality")).agg(F.count("*").alias("n"))


def journey_platform_mismatch(journeys, scenario, outcome) -> DataFrame:
    """Journeys whose platform isn't that of their scenario's outcome; several outcome platforms are ambiguous."""
    want = scenario.join(outcome.select("outcome_id", platform_key("platform").alias("p")), "outcome_id").groupBy("scenario_id").agg(F.sort_array(F.collect_set("p")).alias("expected"))
    rows = journeys.select("id", "scenario_id", platform_key("platform").alias("platform")).join(want, "scenario_id")
    return rows.where((F.size("expected") > 1) | (F.col("expected")[0] != F.col("platform"))).select("id", "platform", F.array_join("expected", ",").alias("expected"), (F.size("expected") > 1).alias("ambiguous"))


def scenario_coverage(journeys, scenario, outcome, persona) -> DataFrame:
    """One row: journeys of unknown scenarios, human scenarios, those covered, and the share."""
    owner = outcome.join(persona, "persona_id").select("outcome_id", is_system("persona").alias("sys"))
    human = scenario.join(owner, "outcome_id").where("NOT sys").select("scenario_id")
    have = journeys.select("scenario_id").where("scenario_id IS NOT NULL").distinct()
    unknown = journeys.where("scenario_id IS NOT NULL").join(scenario.select("scenario_id"), "scenario_id", "left_anti").agg(F.count("*").alias("unknown_journeys"))
    covered = human.join(have.withColumn("c", F.lit(1)), "scenario_id", "left").agg(F.count("*").alias("human_scenarios"), F.count("c").alias("covered"))
    return unknown.join(covered).withColumn("pct", F.when(F.col("human_scenarios") == 0, 100.0).otherwise(F.round(100.0 * F.col("covered") / F.col("human_scenarios"), 1)))


def step_coverage(used: DataFrame, steps: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Step ids that no step has, and steps of covered scenarios (column scenario_id; None: all steps) that nothing uses. Rows are dealt by step to as many tasks as their number asks for."""
    parts = tasks_for(used, steps)
    dealt = lambda df: df.select("step_id").repartition(parts, "step_id")
    mine = dealt(used)
    gone = mine.distinct().join(dealt(steps), "step_id", "left_anti").select(F.lit("unknown").alias("issue"), "step_id")
    asked = steps if covered is None else steps.join(covered, "scenario_id", "left_semi")
    bare = dealt(asked).join(mine, "step_id", "left_anti").select(F.lit("uncovered").alias("issue"), "step_id")
    return gone.union(bare.distinct())


def step_action_consistency(component_action, action_step, component_page, page_flow, flow_step) -> DataFrame:
    """Component's actions whose step is in none of the steps of the flows that hold the component's pages; components without such steps are left out. Links may come twice.

    Walked from the actions' steps up to their pages, and not from components down to all steps that they reach. Rows are dealt by key to as
    many tasks as their number asks for; which components have steps at all is known from distinct ids.
    """
    parts = tasks_for(component_action, page_flow)
    by = lambda df, *keys: df.repartition(parts, *keys)
    rows = by(component_action, "action_id").join(by(action_step, "action_id"), "action_id").select("component_id", "action_id", "step_id")
    flows = flow_step.select(F.col("child").alias("parent"), F.col("parent").alias("step_id"))
    asked = by(rows.select("step_id"), "step_id").distinct()
    flowing = by(by(flows, "step_id").join(asked, "step_id", "left_semi").distinct(), "parent")
    pages = by(flowing.join(by(page_flow, "parent"), "parent").select("step_id", F.col("child").alias("parent")), "step_id").distinct()
    mine = component_page.select(F.col("child").alias("component_id"), "parent")
    pairs = by(by(rows.select("component_id", "step_id"), "step_id").distinct().join(pages, "step_id"), "component_id", "parent")
    fine = by(pairs.join(by(mine, "component_id", "parent"), ["component_id", "parent"], "left_semi").select("component_id", "step_id"), "component_id", "step_id")
    stepped = by(by(page_flow, "parent").join(by(flows.select("parent"), "parent"), "parent", "left_semi").select(F.col("child").alias("parent")), "parent").distinct()
    some = by(mine, "parent").join(stepped, "parent", "left_semi").select("component_id").distinct()
    return by(rows.join(broadcast_if_small(cut(some)), "component_id", "left_semi"), "component_id", "step_id").join(fine, ["component_id", "step_id"], "left_anti")


def on_both(flow_step: DataFrame, page_step: DataFrame) -> DataFrame:
    """Steps on a flow and on a page, with the numbers of each."""
    n = lambda df, c: df.distinct().groupBy(F.col("parent").alias("step_id")).agg(F.count("*").alias(c))
    return n(flow_step, "flows").join(n(page_step, "pages"), "step_id")


def over_shared(links: DataFrame, most: int, out: str = "id") -> DataFrame:
    """Parents (steps, actions) with more than ``most`` distinct children."""
    return links.groupBy(F.col("parent").alias(out)).agg(F.count_distinct("child").alias("n")).where(F.col("n") > most)


def accumulation(links: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """Atoms and templates with more than ``most`` links up."""
    n = links.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return nodes.where(F.col("type").isin("ATOM", "TEMPLATE")).select("id", "type").join(n, "id")
