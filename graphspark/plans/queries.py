"""One query for each operator, named after it, with the SQL that gives the same rows in DuckDB where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions.scale import RANGE_ROWS, shared_dir
from ..functions.values import INBOUND_VERBS, LAYOUT_TYPES, OUTBOUND_VERBS, OVERLAP_KEYWORDS, PAGE_TYPES
from ..operators import changes, design, functional, gates, intents, interfaces, merges, repos, search, spec
from ..sources import exports
from ..streaming import stalls
from ..streaming import status as streams
from ..streaming import tables as stream_tables
from .bindings import Tables, named_in, with_views
from .registry import FOUND, NK, PK, ROUTE, SYS, query, text_list


def _graph(t):
    return t.b_persona, t.b_outcome, t.b_scenario, t.b_step, t.b_action


# Scalar functions
query("norm_route", f"""
    SELECT {ROUTE} AS route, count(*) AS n FROM b_api GROUP BY 1
""")(
    lambda t: t.b_api.groupBy(fn.norm_route("url").alias("route")).agg(F.count("*").alias("n"))
)
query("name_key", f"""
    SELECT {NK} AS k, count(*) AS n FROM b_outcome_all GROUP BY 1
""")(
    lambda t: t.b_outcome_all.groupBy(fn.name_key("outcome").alias("k")).agg(F.count("*").alias("n"))
)
query("platform_key", f"SELECT {PK} AS platform, count(*) AS n FROM b_outcome_all GROUP BY 1")(lambda t: functional.outcome_platforms(t.b_outcome_all))
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(intent, '^[^\n]*?: ', '')), '\([^)]*\)', '', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
query("normalize_intent", f"SELECT doc_id, {NORM} AS norm FROM b_intent")(lambda t: t.b_intent.select("doc_id", fn.normalize_intent("intent").alias("norm")))
query("apply_filters", """
    SELECT id, name FROM b_component
    WHERE type IN ('ATOM', 'MOLECULE') AND feature_id >= 5 AND feature_id < 20 AND lower(name) LIKE '%supplier%'
""")(
    lambda t: fn.apply_filters(t.b_component, {"type": {"$in": ["ATOM", "MOLECULE"]}, "feature_id": {"$gte": 5, "$lt": 20}, "name": {"$containsi": "Supplier"}}).select("id", "name")
)

# Functional graph
_S = """
    s AS (SELECT outcome_id, count(*) AS scenarios, sum(st) AS steps, sum(ac) AS actions FROM b_scenario LEFT
    JOIN (SELECT scenario_id, count(*) AS st FROM b_step GROUP BY 1) USING (scenario_id) LEFT JOIN (SELECT scenario_id, count(*) AS ac
    FROM b_action JOIN b_step USING (step_id) GROUP BY 1) USING (scenario_id) GROUP BY 1)
"""
_TOTALS = f"""
    WITH {_S}
    SELECT persona, count(outcome_id) AS outcomes, CAST(coalesce(sum(scenarios), 0) AS BIGINT) AS scenarios, CAST(coalesce(sum(steps),
        0) AS BIGINT) AS steps, CAST(coalesce(sum(actions), 0) AS BIGINT) AS actions
    FROM b_persona LEFT JOIN b_outcome USING (persona_id) LEFT JOIN s USING (outcome_id) GROUP BY ROLLUP (persona)
"""
query("graph_totals", _TOTALS)(lambda t: functional.graph_totals(*_graph(t)))
query("empty_scenarios", """
    SELECT scenario_id, scenario FROM b_scenario WHERE scenario_id NOT IN (SELECT scenario_id FROM b_step)
""")(
    lambda t: functional.empty_scenarios(t.b_scenario, t.b_step)
)
_DUP = """
    SELECT scenario, count(*) AS n, count(DISTINCT persona) AS personas, count(DISTINCT outcome_id) AS outcomes FROM b_scenario
    JOIN b_outcome USING (outcome_id) JOIN b_persona USING (persona_id) GROUP BY 1 HAVING count(*) > 1
"""
query("duplicate_scenarios", _DUP)(lambda t: functional.duplicate_scenarios(t.b_scenario, t.b_outcome, t.b_persona))
query("duplicate_scenario_places", """
    WITH r AS (SELECT scenario, scenario_id, outcome_id, persona, row_number() OVER (PARTITION BY scenario ORDER BY scenario_id) AS rank, count(*) OVER (PARTITION BY scenario) AS total
    FROM b_scenario JOIN b_outcome USING (outcome_id) JOIN b_persona USING (persona_id))
    SELECT scenario, scenario_id, outcome_id, persona, CAST(rank AS INTEGER) AS rank, total FROM r WHERE total > 1 AND rank <= 5 AND trim(scenario) <> ''
""")(
    lambda t: functional.places(functional.with_persona(t.b_scenario, t.b_outcome, t.b_persona).select("scenario", "scenario_id", "outcome_id", "persona"), "scenario", ["scenario_id"])
)
query("uncited_nodes", """
    SELECT 'outcome' AS level, outcome_id AS id, outcome AS name FROM b_outcome WHERE NOT cited UNION ALL SELECT 'scenario', scenario_id, scenario FROM b_scenario WHERE NOT cited
""")(
    lambda t: functional.uncited({"outcome": t.b_outcome.selectExpr("outcome_id AS id", "outcome AS name", "cited"), "scenario": t.b_scenario.selectExpr("scenario_id AS id", "scenario AS name", "cited")})
)
query("duplicate_outcomes", """
    SELECT outcome, CAST(sum(k) AS BIGINT) AS n, CASE WHEN max(k) > 1 THEN 'P1' ELSE 'P2' END AS severity
    FROM (SELECT outcome, persona_id, count(*) AS k FROM b_outcome_all GROUP BY 1, 2) GROUP BY 1 HAVING sum(k) > 1
""")(
    lambda t: functional.duplicate_outcomes(t.b_outcome_all)
)
_CITED = """
    SELECT level, count(*) AS total, CAST(sum(CAST(cited AS INT)) AS BIGINT) AS with_citation, round(100.0 * sum(CAST(cited AS INT)) / count(*), 1) AS pct
    FROM (SELECT 'outcome' AS level, cited FROM b_outcome UNION ALL SELECT 'scenario', cited FROM b_scenario) GROUP BY 1
"""
query("citation_coverage", _CITED)(lambda t: functional.citation_coverage(t.b_outcome, t.b_scenario))
query("description_coverage", f"""
    SELECT kind, count(*) AS total, CAST(sum(h) AS BIGINT) AS described, round(100.0 * sum(h) / count(*), 1) AS pct
    FROM (SELECT 'scenario' AS kind, CASE WHEN trim(description) <> '' THEN 1 ELSE 0 END AS h FROM b_scenario UNION ALL
    SELECT CASE WHEN {SYS} THEN 'system_action' ELSE 'human_action' END, CASE WHEN trim(a.description) <> '' THEN 1 ELSE 0 END FROM b_action a
    JOIN b_step USING (step_id) JOIN b_scenario s USING (scenario_id) JOIN b_outcome USING (outcome_id) JOIN b_persona USING (persona_id))
    GROUP BY 1
""")(
    lambda t: functional.description_coverage(t.b_scenario, t.b_outcome, t.b_persona, t.b_step, t.b_action)
)
query("cross_persona_overlap", f"""
    SELECT k AS keyword, count(DISTINCT persona) AS personas, string_agg(DISTINCT persona, ',' ORDER BY persona) AS persona_list
    FROM (VALUES {", ".join(f"({text_list([k])})" for k in OVERLAP_KEYWORDS)}) AS v(k) JOIN (SELECT persona, scenario FROM b_topic
    JOIN b_outcome USING (outcome_id) JOIN b_persona USING (persona_id)) ON contains(lower(scenario), k) GROUP BY 1
    HAVING count(DISTINCT persona) >= 3
""")(
    lambda t: functional.cross_persona_overlap(t.b_topic, t.b_outcome, t.b_persona)
)
_STORIES = [("a", "machinery"), ("a", "flow 7"), ("b", "building"), ("b", "rocket"), ("b", "submarine"), ("c", "unicorn")]
query("source_coverage", """
    SELECT story, count(*) AS total, CAST(sum(f) AS BIGINT) AS found, coalesce(string_agg(CASE WHEN f = 0 THEN k END, ','
    ORDER BY k), '') AS missing, CASE WHEN sum(f) >= 0.6 * count(*) THEN 'FULL' WHEN sum(f) > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS status
    FROM (SELECT story, k, CASE WHEN EXISTS (SELECT 1 FROM b_scenario WHERE contains(lower(scenario), k)) THEN 1 ELSE 0 END AS f
    FROM (VALUES ('a', 'machinery'), ('a', 'flow 7'), ('b', 'building'), ('b', 'rocket'), ('b', 'submarine'), ('c', 'unicorn')) AS v(story, k))
    GROUP BY 1
""")(
    lambda t: functional.source_coverage(t.spark.createDataFrame(_STORIES, "story string, keyword string"), t.b_scenario.select(F.col("scenario").alias("text")))
)
query("outcome_halves", f"""
    SELECT {NK} AS outcome_key, bool_or({SYS}) AS has_system, bool_or(NOT {SYS}) AS has_human FROM b_outcome_all JOIN b_persona USING (persona_id)
    GROUP BY 1 HAVING bool_or({SYS}) <> bool_or(NOT {SYS})
""")(
    lambda t: functional.outcome_halves(t.b_outcome_all, t.b_persona)
)
query("reconcile_outcomes", f"""
    SELECT outcome_id, min(outcome_id) OVER w AS kept_id, first_value(outcome) OVER (PARTITION BY persona_id, {NK}
    ORDER BY outcome_id) AS kept_name FROM b_outcome_all WINDOW w AS (PARTITION BY persona_id, {NK})
""")(
    lambda t: functional.reconcile_outcomes(t.b_outcome_all)
)
query("scope_by_persona", """
    WITH j AS (SELECT id FROM b_journey WHERE id % 2 = 0), f AS (SELECT DISTINCT child FROM b_flow_parent WHERE parent IN (SELECT id
    FROM j)), p AS (SELECT DISTINCT child FROM b_page_parent WHERE parent IN (SELECT child FROM f)), c AS (SELECT DISTINCT child
    FROM b_component_parent WHERE parent IN (SELECT child FROM p)) SELECT 'flow' AS label, child AS id FROM f UNION ALL SELECT 'page', child
    FROM p UNION ALL SELECT 'component', child FROM c
""")(
    lambda t: _labelled(["flow", "page", "component"], functional.scope_by_parent([t.b_flow_parent, t.b_page_parent, t.b_component_parent], t.b_journey.where("id % 2 = 0").select("id")))
)
query("pending_scenarios", f"""
    SELECT scenario_id, scenario, 100 < (SELECT count(*) FROM b_scenario) AS has_more FROM b_scenario
    WHERE NOT is_design_generated AND outcome_id NOT IN (SELECT outcome_id FROM b_outcome JOIN b_persona USING (persona_id) WHERE {SYS})
    ORDER BY scenario_id LIMIT 50 OFFSET 50
""")(
    lambda t: functional.scenario_paging(t.b_scenario, t.b_outcome, t.b_persona, 2, 50)
)
query("scenario_steps", f"""
    SELECT scenario_id, step_id, step, row_number() OVER (PARTITION BY scenario_id ORDER BY step_id) AS "order" FROM b_step
    WHERE scenario_id IN (SELECT scenario_id FROM b_scenario WHERE NOT is_design_generated AND outcome_id NOT IN (SELECT outcome_id
    FROM b_outcome JOIN b_persona USING (persona_id) WHERE {SYS}) ORDER BY scenario_id LIMIT 50 OFFSET 50)
""")(
    lambda t: functional.ordered_steps(functional.scenario_paging(t.b_scenario, t.b_outcome, t.b_persona, 2, 50), t.b_step)
)


def _labelled(labels, frames):
    out = None
    for label, df in zip(labels, frames):
        df = df.select(F.lit(label).alias("label"), F.col(df.columns[0]).alias("id"))
        out = df if out is None else out.unionByName(df)
    return out


def _payload(t):
    """An outcome as a payload: its actions, with the persona."""
    owner = functional.with_persona(t.b_scenario.select("scenario_id", "outcome_id"), t.b_outcome, t.b_persona).select("scenario_id", "persona", "outcome_id")
    return t.b_action.join(t.b_step.select("step_id", "scenario_id"), "step_id").join(owner, "scenario_id").select(F.col("outcome_id").alias("payload_id"), "persona", "action_id", "action", "description", "has_api", F.when(F.col("has_api"), F.concat(F.lit("/api/v1/items/"), "l_suppkey")).alias("url"), "l_suppkey")


_P = """
    (SELECT outcome_id AS payload_id, persona, action_id, action, a.description, has_api, l_suppkey FROM b_action a JOIN b_step USING (step_id)
    JOIN b_scenario USING (scenario_id) JOIN b_outcome USING (outcome_id) JOIN b_persona USING (persona_id))
"""
query("check_citations", """
    SELECT outcome_id AS payload_id, 'citations' AS "check", level, node_id, CASE WHEN level = 'outcome' THEN 'not_allowed' ELSE 'missing' END AS detail
    FROM (SELECT outcome_id, 'outcome' AS level, outcome_id AS node_id, cited FROM b_outcome UNION ALL
    SELECT outcome_id, 'scenario', scenario_id, cited FROM b_scenario) WHERE (level = 'outcome') = cited
""")(
    lambda t: gates.check_citations(t.b_outcome.select(F.col("outcome_id").alias("payload_id"), F.lit("outcome").alias("level"), F.col("outcome_id").alias("node_id"), F.when(F.col("cited"), "repo/a").alias("reference")).unionByName(t.b_scenario.select(F.col("outcome_id").alias("payload_id"), F.lit("scenario").alias("level"), F.col("scenario_id").alias("node_id"), F.when(F.col("cited"), "repo/b").alias("reference"))), F.lit("repo"))
)
query("check_side_effect_coverage", f"""
    SELECT payload_id, count(*) AS total, CAST(sum(CAST(has_api AS INT)) AS BIGINT) AS matched, round(100.0 * sum(CAST(has_api AS INT)) / count(*),
        1) AS pct
    FROM {_P} GROUP BY 1 HAVING sum(CAST(has_api AS INT)) < 0.9 * count(*)
""")(
    lambda t: gates.coverage_below(_payload(t), "has_api")
)
# Design graph
query("orphan_nodes", """
    SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT child FROM b_flow_parent)
""")(
    lambda t: design.orphan_nodes(t.orders.select(F.col("o_orderkey").alias("id")), t.b_flow_parent)
)
query("dangling_parent_refs", """
    SELECT child, parent FROM b_flow_parent WHERE parent NOT IN (SELECT id FROM b_journey)
""")(
    lambda t: design.dangling_parent_refs(t.b_flow_parent, t.b_journey)
)
query("broken_chains", """
    WITH p AS (SELECT DISTINCT parent AS id FROM b_component_parent), f AS (SELECT DISTINCT parent AS id FROM b_page_parent
    WHERE child IN (SELECT id FROM p)), s AS (SELECT f.id, count(l.parent) AS n, count(j.id) AS k FROM f LEFT
    JOIN b_flow_parent l ON l.child = f.id LEFT JOIN b_journey j ON j.id = l.parent GROUP BY 1) SELECT 'page_without_flow' AS issue, id FROM p
    WHERE id NOT IN (SELECT child FROM b_page_parent) UNION ALL
    SELECT CASE WHEN n = 0 THEN 'flow_without_journey' ELSE 'flow_with_missing_journeys' END, id FROM s WHERE k = 0
""")(
    lambda t: design.broken_chains(t.links("b_component_parent"), t.links("b_page_parent"), t.b_flow_parent, t.b_journey)
)
query("duplicate_linkage", """
    SELECT l_orderkey AS child, l_linenumber AS parent, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")(
    lambda t: design.duplicate_linkage(t.lineitem.select(F.col("l_orderkey").alias("child"), F.col("l_linenumber").alias("parent")))
)
query("empty_hierarchy", """
    SELECT 'journey_without_flow' AS issue, id FROM b_journey WHERE id NOT IN (SELECT parent FROM b_flow_parent)
    UNION ALL SELECT 'flow_without_page', id FROM b_flow WHERE id NOT IN (SELECT parent FROM b_page_parent WHERE child % 3 = 0)
    UNION ALL SELECT 'page_without_component', id FROM b_page WHERE id NOT IN (SELECT parent FROM b_component_parent WHERE child % 7 = 0)
""")(
    lambda t: design.empty_hierarchy(t.b_journey, t.b_flow_parent, "journey_without_flow")
    .union(design.empty_hierarchy(t.b_flow, t.b_page_parent.where("child % 3 = 0"), "flow_without_page"))
    .union(design.empty_hierarchy(t.b_page, t.b_component_parent.where("child % 7 = 0"), "page_without_component"))
)
query("duplicate_names", f"""
    SELECT name, page_type, {PK} AS platform, count(*) AS n, min(id) AS first_id FROM b_page WHERE trim(name) <> '' GROUP BY 1, 2, 3
    HAVING count(*) > 1
""")(
    lambda t: design.duplicate_names(t.b_page, "page_type")
)
query("missing_scenario_id", "SELECT id, name FROM b_journey WHERE scenario_id IS NULL")(lambda t: design.missing_scenario_id(t.b_journey))
query("duplicate_scenario_ids", """
    SELECT scenario_id, count(DISTINCT id) AS n, bool_or(id % 2 = 0) AS counts FROM b_journey WHERE scenario_id IS NOT NULL GROUP BY 1
    HAVING count(DISTINCT id) > 1
""")(
    lambda t: design.duplicate_scenario_ids(t.b_journey, F.col("id") % 2 == 0)
)
_LAYOUT = "CASE p_size % 6 WHEN 0 THEN 'GRID' WHEN 1 THEN 'FLEX' WHEN 2 THEN 'SIDEBAR' WHEN 3 THEN 'FULL' WHEN 4 THEN 'full' ELSE 'Masonry' END"
query("invalid_layouts", f"""
    SELECT p_partkey AS id, {_LAYOUT} AS value, CASE WHEN p_size % 6 = 4 THEN 'P1' ELSE 'P0' END AS severity FROM part WHERE p_size % 6 > 3
""")(
    lambda t: design.invalid_enums(t.part.selectExpr("p_partkey AS id", f"{_LAYOUT} AS layout_type"), "layout_type", LAYOUT_TYPES)
)
query("type_distribution", "SELECT type, count(*) AS n FROM b_component GROUP BY 1")(lambda t: design.type_distribution(t.b_component))
query("scenario_coverage", f"""
    WITH h AS (SELECT scenario_id FROM b_scenario JOIN b_outcome USING (outcome_id) JOIN b_persona USING (persona_id) WHERE NOT {SYS})
    SELECT (SELECT count(*) FROM b_journey WHERE scenario_id IS NOT NULL AND scenario_id NOT IN (SELECT scenario_id
    FROM b_scenario)) AS unknown_journeys, count(*) AS human_scenarios, count(j.scenario_id) AS covered, round(100.0 * count(j.scenario_id) / count(*),
        1) AS pct
    FROM h LEFT JOIN (SELECT DISTINCT scenario_id FROM b_journey) j USING (scenario_id)
""")(
    lambda t: design.scenario_coverage(t.b_journey, t.b_scenario, t.b_outcome, t.b_persona)
)
query("step_coverage", """
    WITH u AS (SELECT DISTINCT l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS step_id FROM lineitem
    WHERE l_quantity > 30) SELECT 'unknown' AS issue, step_id FROM u WHERE step_id NOT IN (SELECT step_id FROM b_step) UNION ALL
    SELECT DISTINCT 'uncovered', step_id FROM b_step WHERE scenario_id IN (SELECT scenario_id FROM b_journey) AND step_id NOT IN (SELECT step_id
    FROM u)
""")(
    lambda t: design.step_coverage(t.lineitem.where("l_quantity > 30").selectExpr("l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS step_id"), t.b_step, t.b_journey.select("scenario_id"))
)
query("action_coverage", """
    WITH u AS (SELECT DISTINCT action_id FROM b_action WHERE has_api) SELECT 'uncovered' AS issue, action_id FROM b_action
    WHERE action_id NOT IN (SELECT action_id FROM u) GROUP BY 2
""")(
    lambda t: design.step_coverage(t.b_action.where("has_api").select(F.col("action_id").alias("step_id")), t.b_action.select(F.col("action_id").alias("step_id"))).withColumnRenamed("step_id", "action_id")
)
query("step_on_flow_and_page", """
    SELECT step_id, f.n AS flows, p.n AS pages FROM (SELECT o_orderkey AS step_id, count(DISTINCT o_custkey) AS n FROM orders
    WHERE o_orderkey % 2 = 0 GROUP BY 1) f JOIN (SELECT l_orderkey AS step_id, count(DISTINCT l_partkey) AS n FROM lineitem
    WHERE l_linenumber = 1 GROUP BY 1) p USING (step_id)
""")(
    lambda t: design.on_both(t.orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("child"), F.col("o_orderkey").alias("parent")), t.lineitem.where("l_linenumber = 1").select(F.col("l_partkey").alias("child"), F.col("l_orderkey").alias("parent")))
)
query("action_on_many_components", """
    SELECT l_partkey AS action_id, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1
""")(
    lambda t: design.over_shared(t.lineitem.select(F.col("l_suppkey").alias("child"), F.col("l_partkey").alias("parent")), 1, "action_id")
)
query("action_accumulation", """
    SELECT id, type, n FROM b_component JOIN (SELECT child AS id, count(*) AS n FROM b_component_parent GROUP BY 1
    HAVING count(*) > 5) USING (id) WHERE type IN ('ATOM', 'TEMPLATE')
""")(
    lambda t: design.accumulation(t.b_component_parent, t.b_component)
)
query("over_shared_steps", """
    SELECT parent AS step_id, count(DISTINCT child) AS n FROM b_flow_parent GROUP BY 1 HAVING count(DISTINCT child) > 3
""")(
    lambda t: design.over_shared(t.b_flow_parent, 3, "step_id")
)

# Interfaces and registries
_H = f"""
    h AS (SELECT {ROUTE} AS path, string_agg(DISTINCT upper(coalesce(method, 'GET')), ',' ORDER BY upper(coalesce(method, 'GET'))) AS verbs
    FROM b_api WHERE type = 'REST' AND is_system GROUP BY 1)
"""
_CALLS = f"""
    WITH {_H}
    SELECT action_id, c.path, verb, verbs AS handler_verbs, CASE WHEN url LIKE 'https:%' THEN 'external' WHEN url NOT LIKE '/%' THEN 'relative-url' WHEN verbs IS NULL THEN 'NO HANDLER' WHEN contains(',' || verbs || ',', ',' || verb || ',') THEN 'matched' WHEN c.path = '/app/area1/:p' THEN 'verb-agnostic' ELSE 'method-mismatch' END AS result
    FROM (SELECT *, {ROUTE} AS path, upper(coalesce(method, 'GET')) AS verb FROM b_api WHERE type = 'REST' AND NOT is_system) c LEFT
    JOIN h USING (path)
"""
query("match_calls_to_handlers", _CALLS)(lambda t: interfaces.match_calls_to_handlers(t.b_api, ["/app/area1/:p"]))
query("call_match_summary", f"""
    SELECT result, count(*) AS n FROM ({_CALLS}) GROUP BY 1
""")(
    lambda t: interfaces.call_match_summary(interfaces.match_calls_to_handlers(t.b_api, ["/app/area1/:p"]))
)
query("uncalled_handlers", f"""
    WITH {_H} SELECT path, verbs FROM h WHERE path NOT IN (SELECT {ROUTE} FROM b_api WHERE type = 'REST' AND NOT is_system AND url LIKE '/%')
""")(
    lambda t: interfaces.uncalled_handlers(t.b_api)
)
query("interface_quadrants", f"""
    WITH v AS (SELECT type, {ROUTE} AS path, is_system, lower(regexp_extract(trim(action), '^[A-Za-z]+')) AS verb FROM b_api WHERE url IS NOT NULL),
    d AS (SELECT *, CASE WHEN NOT is_system THEN 'o' WHEN verb IN ({text_list(INBOUND_VERBS)}) THEN 'i' WHEN verb IN ({text_list(OUTBOUND_VERBS)}) THEN 'o' END AS dir FROM v),
    o AS (SELECT type, path, count(*) AS n, bool_or(NOT is_system) AS human FROM d WHERE dir = 'o' GROUP BY 1, 2),
    i AS (SELECT type, path, count(*) AS n FROM d WHERE dir = 'i' GROUP BY 1, 2)
    SELECT type, path, coalesce(o.n, 0) AS n_outbound, coalesce(i.n, 0) AS n_inbound,
        CASE WHEN o.n IS NULL THEN 'dangling-inbound' WHEN i.n IS NULL THEN 'dangling-outbound' WHEN human THEN 'human-system' ELSE 'system-system' END AS kind
    FROM o FULL JOIN i USING (type, path)
""")(
    lambda t: interfaces.interface_quadrants(t.b_api)
)
query("interface_directions", f"""
    SELECT CASE WHEN NOT is_system THEN 'outbound' WHEN regexp_matches(lower(action), '^\\s*(receive|consume|handle)\\b') THEN 'inbound'
        WHEN regexp_matches(lower(action), '^\\s*(call|invoke|publish|send)\\b') THEN 'outbound' ELSE 'internal' END AS direction, is_system, count(*) AS n
    FROM b_api GROUP BY 1, 2
""")(
    lambda t: t.b_api.groupBy(F.coalesce(interfaces.direction(), F.lit("internal")).alias("direction"), "is_system").agg(F.count("*").alias("n"))
)
query("route_crosscheck", f"""
    WITH l AS (SELECT {ROUTE} AS path, count(*) AS n FROM b_api WHERE is_system GROUP BY 1), r AS (SELECT {ROUTE} AS path, count(*) AS n
    FROM b_api WHERE NOT is_system GROUP BY 1)
    SELECT path, coalesce(l.n, 0) AS n_left, coalesce(r.n, 0) AS n_right,
        CASE WHEN r.n IS NULL THEN 'left_only' WHEN l.n IS NULL THEN 'right_only' ELSE 'both' END AS side
    FROM l FULL JOIN r USING (path)
""")(
    lambda t: interfaces.crosscheck(*(t.b_api.where(c).select(fn.norm_route("url").alias("path")) for c in ("is_system", "NOT is_system")), "path")
)
query("orphan_handler_files", """
    SELECT path FROM b_file WHERE path LIKE '%/app/%.py' AND NOT indexed
""")(
    lambda t: interfaces.orphan_handler_files(t.b_file, t.b_file.where("indexed"), r"/app/.*\.py$")
)
_HOPS = "SELECT event_type AS from_app, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_app FROM events"
query("journey_map", f"""
    SELECT from_app, to_app, count(*) AS n, to_app IS NOT NULL AS resolved FROM ({_HOPS}) GROUP BY 1, 2
""")(
    lambda t: interfaces.journey_map(_sql_views(t, _HOPS))
)


def _sql_views(t, sql: str) -> DataFrame:
    """A text that names tables and views, in Spark."""
    for name in named_in(sql):
        getattr(t, name).createOrReplaceTempView(name)
    return t.spark.sql(sql)


def _registries(t):
    c = t.b_component
    left, right = c.where("id % 3 <> 0").select("name", "type"), c.where("id % 5 <> 0").selectExpr("CASE WHEN id % 7 = 0 THEN concat('R', name) ELSE name END AS name", "CASE WHEN id % 4 = 1 AND id % 8 = 1 THEN 'ATOM' ELSE type END AS type")
    return left, right, c.where("id % 7 = 0").selectExpr("name", "concat('R', name) AS as_name")


_REG = """
    l AS (SELECT name AS left_name, CASE WHEN id % 7 = 0 THEN 'R' || name ELSE name END AS key, type AS left_type, id % 7 = 0 AS via
    FROM b_component
    WHERE id % 3 <> 0), r AS (SELECT CASE WHEN id % 7 = 0 THEN 'R' || name ELSE name END AS key,
        CASE WHEN id % 8 = 1 THEN 'ATOM' ELSE type END AS right_type
    FROM b_component
    WHERE id % 5 <> 0), c AS (SELECT key, left_name, left_type, right_type, coalesce(via, false) AS via_equivalence,
        CASE WHEN right_type IS NULL THEN 'left_only' WHEN left_name IS NULL THEN 'right_only' ELSE 'matched' END AS side
    FROM l FULL JOIN r USING (key))
"""
query("compare_component_registries", f"WITH {_REG} SELECT * FROM c")(lambda t: interfaces.compare_registries(*_registries(t)))
query("component_children_drift", """
    WITH e AS (SELECT DISTINCT l_partkey AS name, l_partkey + 1 AS as_name FROM lineitem WHERE l_partkey % 3 = 0),
    l AS (SELECT DISTINCT l_suppkey AS key, coalesce(as_name, l_partkey) AS child FROM lineitem LEFT JOIN e ON name = l_partkey WHERE l_linenumber <= 4),
    r AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS child FROM lineitem WHERE l_linenumber >= 3)
    SELECT key, CAST(sum(CASE WHEN r.child IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS left_only,
        CAST(sum(CASE WHEN l.child IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS right_only,
        CAST(sum(CASE WHEN l.child = r.child THEN 1 ELSE 0 END) AS BIGINT) AS common
    FROM l FULL JOIN r USING (key, child) GROUP BY 1 HAVING count(l.child) > 0 AND count(r.child) > 0
""")(
    lambda t: _kids(t)
)
def _kids(t):
    side = lambda c: t.lineitem.where(c).select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("child"))
    same = t.lineitem.where("l_partkey % 3 = 0").selectExpr("l_partkey AS name", "l_partkey + 1 AS as_name").distinct()
    return interfaces.children_drift(side("l_linenumber <= 4"), side("l_linenumber >= 3"), same)



# Merges
query("merge_design", """
    WITH k AS (SELECT id, lower(trim(name)) AS k, coalesce(nullif(lower(trim(platform)), ''), 'default') AS p
    FROM b_page), m AS (SELECT k, p, min(id) AS kept FROM k GROUP BY 1, 2) SELECT DISTINCT kept AS id, parent FROM b_page_parent
    JOIN k ON k.id = child JOIN m USING (k, p)
""")(
    lambda t: merges.merge_design(t.b_page.withColumn("seq", F.col("id") % 2), t.b_page_parent)[1]
)


def _design_links(t):
    """``b_design_link`` with links that come twice."""
    return t.b_flow_parent.select(F.lit("flow").alias("label"), "child", "parent").union(t.links("b_page_parent").select(F.lit("page"), "child", "parent")).union(t.links("b_component_parent").select(F.lit("component"), "child", "parent"))


_MERGED = f"""
    k AS (SELECT label, id, name, platform, scenario_id, seq, lower(trim(name)) AS k, {PK} AS p FROM b_design_node),
    of_scenario AS (SELECT id, k, min(id) OVER (PARTITION BY scenario_id) AS kept FROM k WHERE label = 'journey' AND scenario_id IS NOT NULL),
    mapping AS (
        SELECT 'journey' AS label, id, kept FROM of_scenario
        UNION ALL SELECT 'journey', id, coalesce((SELECT min(kept) FROM of_scenario o WHERE o.k = n.k), min(id) OVER (PARTITION BY k)) FROM k n WHERE label = 'journey' AND scenario_id IS NULL
        UNION ALL SELECT label, id, min(id) OVER (PARTITION BY label, k, p) FROM k WHERE label <> 'journey'
    ),
    moved AS (
        SELECT DISTINCT l.label, c.kept AS child, coalesce(a.kept, l.parent) AS parent FROM b_design_link l JOIN (SELECT DISTINCT * FROM mapping) c ON c.label = l.label AND c.id = l.child
        LEFT JOIN (SELECT DISTINCT * FROM mapping) a ON a.id = l.parent AND a.label = CASE l.label WHEN 'flow' THEN 'journey' WHEN 'page' THEN 'flow' ELSE 'page' END
    )
"""
query("merge_design_nodes", f"""
    WITH {_MERGED},
    n AS (SELECT k.label, kept AS id, arg_max(name, (seq, name)) AS name, arg_max(platform, (seq, platform)) FILTER (WHERE platform IS NOT NULL) AS platform, max(scenario_id) AS scenario_id FROM k JOIN (SELECT DISTINCT * FROM mapping) m ON m.label = k.label AND m.id = k.id GROUP BY 1, 2)
    SELECT n.label, n.id, name, platform, scenario_id, coalesce(ids, '') AS parent_ids FROM n LEFT JOIN (SELECT label, child, string_agg(CAST(parent AS STRING), ',' ORDER BY parent) AS ids FROM moved GROUP BY 1, 2) m ON m.label = n.label AND m.child = n.id
""")(lambda t: merges.merge_design_graph(t.b_design_node, _design_links(t))[0].withColumn("parent_ids", F.array_join("parent_ids", ",")))
query("merge_design_links", f"WITH {_MERGED} SELECT * FROM moved")(lambda t: merges.merge_design_graph(t.b_design_node, _design_links(t))[1])
_DELETED = """
    j AS (SELECT id FROM b_journey WHERE id % 2 = 0),
    f AS (SELECT child AS id FROM (SELECT DISTINCT child, parent FROM b_flow_parent) LEFT JOIN j ON parent = j.id GROUP BY 1 HAVING count(*) = count(j.id)),
    p AS (SELECT child AS id FROM b_page_parent LEFT JOIN f ON parent = f.id GROUP BY 1 HAVING count(*) = count(f.id)),
    c AS (SELECT child AS id FROM b_component_parent LEFT JOIN p ON parent = p.id GROUP BY 1 HAVING count(*) = count(p.id))
"""
query("delete_with_orphan_cleanup", f"WITH {_DELETED} SELECT 'flow' AS label, id FROM f UNION ALL SELECT 'page', id FROM p UNION ALL SELECT 'component', id FROM c")(
    lambda t: merges.delete_design(t.b_journey.where("id % 2 = 0"), t.b_design_link, merges.DESIGN[1:])[0]
)
query("delete_strips_parents", f"""
    WITH {_DELETED},
    k AS (
        SELECT DISTINCT 'flow' AS label, child, parent FROM b_flow_parent WHERE parent NOT IN (SELECT id FROM j) AND child NOT IN (SELECT id FROM f)
        UNION ALL SELECT 'page', child, parent FROM b_page_parent WHERE parent NOT IN (SELECT id FROM f) AND child NOT IN (SELECT id FROM p)
        UNION ALL SELECT 'component', child, parent FROM b_component_parent WHERE parent NOT IN (SELECT id FROM p) AND child NOT IN (SELECT id FROM c)
    )
    SELECT label, child, string_agg(CAST(parent AS STRING), ',' ORDER BY parent) AS parent_ids FROM k GROUP BY 1, 2
""")(
    lambda t: merges.parent_arrays(merges.delete_design(t.b_journey.where("id % 2 = 0"), t.b_design_link, merges.DESIGN[1:])[1]).withColumn("parent_ids", F.array_join("parent_ids", ","))
)
query("merge_batch_scenarios", """
    SELECT outcome_id, scenario, min(scenario_id) AS scenario_id FROM b_scenario GROUP BY 1, 2
""")(
    lambda t: merges.merge_batches(t.b_scenario.select("outcome_id", "scenario", "scenario_id"), ["outcome_id", "scenario"], ["scenario_id"])
)


def _arch(t):
    return t.part.selectExpr("'Services' AS layer", "p_brand AS name", "CASE p_partkey % 3 WHEN 0 THEN 'doc' WHEN 1 THEN 'iac' ELSE 'code' END AS source", "p_type AS description", "p_container AS technology", "CAST(p_size AS STRING) AS region") if "p_container" in t.part.columns else t.part.selectExpr("'Services' AS layer", "p_brand AS name", "CASE p_partkey % 3 WHEN 0 THEN 'doc' WHEN 1 THEN 'iac' ELSE 'code' END AS source", "p_type AS description", "p_type AS technology", "CAST(p_size AS STRING) AS region")


query("layer_inventory", """
    SELECT layer, n, n = 0 AS empty FROM (SELECT 'Services' AS layer, (SELECT count(*) FROM part) AS n UNION ALL
    SELECT unnest(['UserExperience', 'ApiGateway', 'Agents', 'DataLake', 'EventQueue', 'ObservabilityMonitoring', 'Infrastructure']), 0)
""")(
    lambda t: merges.layer_inventory(_arch(t))
)
query("layer_boundaries", """
    SELECT DISTINCT l_partkey AS source, l_suppkey AS target, CASE WHEN l_partkey % 3 = 0 THEN 'direct_storage_call' ELSE 'reverse_flow' END AS issue
    FROM lineitem WHERE (l_partkey % 3 = 0 AND l_suppkey % 3 = 1) OR (l_partkey % 3 = 2 AND l_suppkey % 3 = 0)
""")(
    lambda t: merges.layer_boundaries(t.part.selectExpr("p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN 'UserExperience' WHEN 1 THEN 'DataLake' ELSE 'Services' END AS layer"), t.lineitem.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")))
)

# Search and impact
_NOUNS = ["the", "apache", "license", "password"]
query("keyword_sweep", """
    SELECT noun, count(*) AS total, count(*) > 60 AS too_common FROM documents
    JOIN (VALUES ('the'), ('apache'), ('license'), ('password')) AS v(noun) ON contains(lower(text), noun) GROUP BY 1
""")(
    lambda t: search.keyword_sweep(t.documents.select(F.col("doc_id").alias("id"), "text"), _NOUNS)[0]
)
query("best_hit_per_path", """
    SELECT l_suppkey AS query_id, CAST(l_partkey % 100 AS STRING) AS path, max(l_discount) AS score FROM lineitem WHERE l_discount >= 0.05
    GROUP BY 1, 2
""")(
    lambda t: search.best_hit_per_path(t.lineitem.selectExpr("l_suppkey AS query_id", "CAST(l_partkey % 100 AS STRING) AS path", "l_discount AS score", "l_orderkey AS id"), 0.05).select("query_id", "path", "score")
)
query("expand_touched_scenarios", """
    SELECT scenario_id, outcome_id FROM b_scenario WHERE outcome_id IN (SELECT outcome_id FROM b_scenario WHERE scenario_id % 500 = 1)
""")(
    lambda t: search.expand_touched_scenarios(t.b_scenario.where("scenario_id % 500 = 1"), t.b_scenario)
)
query("covering_design_nodes", """
    SELECT DISTINCT child AS id FROM b_component_parent WHERE parent IN (SELECT id FROM b_page WHERE id % 50 = 0)
""")(
    lambda t: search.covering_nodes(t.b_component_parent, t.b_page.where("id % 50 = 0"))
)
query("file_fan_in", """
    SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS imported_by FROM lineitem GROUP BY 1
""")(
    lambda t: search.file_fan_in(t.lineitem.select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("source")))
)
query("scenarios_citing_files", """
    WITH c AS (SELECT DISTINCT l_suppkey AS node_id, l_partkey AS reference
    FROM lineitem), x AS (SELECT node_id, count(*) AS citations, CAST(sum(CASE WHEN reference % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS changed
    FROM c GROUP BY 1) SELECT *, citations = changed AS all_gone FROM x WHERE changed > 0
""")(
    lambda t: search.nodes_citing_files(t.part.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("path")), t.lineitem.select(F.col("l_suppkey").alias("node_id"), F.col("l_partkey").alias("reference")))
)

# Intents
query("exact_dedup", "SELECT DISTINCT intent FROM b_intent")(lambda t: t.b_intent.select("intent").distinct())
query("normalized_dedup", f"""
    WITH x AS (SELECT DISTINCT intent FROM b_intent), n AS (SELECT intent, {NORM} AS norm FROM x) SELECT norm, intent, merged
    FROM (SELECT norm, intent, count(*) OVER (PARTITION BY norm) AS merged, row_number() OVER (PARTITION BY norm
    ORDER BY length(intent) DESC, intent) AS r FROM n) WHERE r = 1
""")(
    lambda t: intents.normalized_dedup(t.b_intent)
)
query("split_persona", """
    SELECT doc_id, split_part(intent, ': ', 1) AS persona, substr(intent, 5) AS text FROM b_intent
""")(
    lambda t: t.b_intent.select("doc_id", fn.split_persona("intent")[0].alias("persona"), fn.split_persona("intent")[1].alias("text"))
)
query("fixed_batches", """
    SELECT repo, doc_id, CAST(floor((row_number() OVER (PARTITION BY repo ORDER BY doc_id) - 1) / 20) AS BIGINT) AS batch FROM b_file
""")(
    lambda t: intents.fixed_batches(t.b_file.select("repo", "doc_id"), "repo", "doc_id", 20)
)

# Repositories and changes
query("display_names", """
    SELECT CAST(s_suppkey AS STRING) || '/x' AS key, CASE WHEN count(*) OVER (PARTITION BY s_nationkey) = 1 THEN CAST(s_nationkey AS STRING) ELSE CAST(s_suppkey AS STRING) || '__x' END AS display_name
    FROM supplier
""")(
    lambda t: repos.display_names(t.supplier.selectExpr("concat(s_suppkey, '/x') AS key", "CAST(s_nationkey AS STRING) AS name"))
)
_REPOS = ["o_orderkey AS key", "CASE WHEN o_orderkey % 3 = 0 THEN 'solo' ELSE o_orderstatus || '-' || CAST(o_orderkey AS STRING) END AS name", "CASE o_orderkey % 4 WHEN 0 THEN 'C#' WHEN 1 THEN 'Java' WHEN 2 THEN 'Go' END AS language", "CAST(o_orderdate AS DATE) AS pushed_at", "o_orderkey % 7 = 0 AS archived", "o_orderkey % 5 = 0 AS fork", "o_orderkey % 11 = 0 AS empty"]
_KEPT = f"(SELECT * FROM (SELECT {', '.join(_REPOS)} FROM orders) WHERE NOT archived AND NOT fork AND NOT empty AND pushed_at >= DATE '1996-01-01')"
query("triage_by_language", f"""
    SELECT coalesce(language, '(none)') AS "group", count(*) AS n, CAST(sum(CASE WHEN language = 'Go' THEN 1 ELSE 0 END) AS BIGINT) AS unsupported
    FROM {_KEPT} GROUP BY 1
""")(
    lambda t: repos.triage_groups(t.orders.selectExpr(*_REPOS), "1998-01-01")
)
query("triage_by_prefix", f"""
    SELECT CASE WHEN name = 'solo' THEN '(none)' ELSE split_part(name, '-', 1) END AS "group", count(*) AS n,
        CAST(sum(CASE WHEN language = 'Go' THEN 1 ELSE 0 END) AS BIGINT) AS unsupported
    FROM {_KEPT} GROUP BY 1
""")(
    lambda t: repos.triage_groups(t.orders.selectExpr(*_REPOS), "1998-01-01", "prefix")
)
query("unsupported_languages", f"""
    SELECT key, language FROM (SELECT {', '.join(_REPOS)} FROM orders) WHERE language = 'Go'
""")(
    lambda t: t.orders.selectExpr(*_REPOS).where(repos.unsupported()).select("key", "language")
)
query("tree_stats", r"""
    WITH c AS (SELECT repo, CASE WHEN regexp_extract(path, '(\.[^./]+)$', 1) = '' THEN '(none)' ELSE lower(regexp_extract(path, '(\.[^./]+)$',
        1)) END AS value, count(*) AS n
    FROM b_file GROUP BY 1, 2) SELECT repo, value, n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, value) AS r FROM c)
    WHERE r <= 3
""")(
    lambda t: repos.tree_stats(t.b_file, "ext", 3)
)
_PATTERNS = ["*.cs", "/src1/**", "never-there/"]
_STATUS = "CASE stage WHEN 'active' THEN 'indexed' WHEN 'error' THEN 'error' ELSE 'ingesting' END"
_LATEST = f"""
    SELECT repo_id, ts, stage, {_STATUS} AS status FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, event_id DESC) AS r
    FROM b_status_event) WHERE r = 1
"""
query("repo_status", _LATEST)(lambda t: repos.latest_status(t.b_status_event))
query("status_summary", f"""
    SELECT status, count(*) AS n FROM ({_LATEST}) GROUP BY 1
""")(
    lambda t: repos.latest_status(t.b_status_event).groupBy("status").agg(F.count("*").alias("n"))
)
query("stalled_repos", f"""
    SELECT repo_id, stage FROM ({_LATEST}) WHERE status = 'ingesting' AND ts < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 30 MINUTE
""")(
    lambda t: repos.stalled(repos.latest_status(t.b_status_event), "2024-01-30 12:00:00").select("repo_id", "stage")
)
query("retry_candidates", f"""
    WITH a AS (SELECT repo_id, count(*) AS attempts FROM b_status_event WHERE stage = 'error' GROUP BY 1) SELECT repo_id, attempts
    FROM ({_LATEST}) JOIN a USING (repo_id) WHERE status = 'error' AND attempts < 30
""")(
    lambda t: repos.retry_candidates(repos.latest_status(t.b_status_event).join(t.b_status_event.where("stage = 'error'").groupBy("repo_id").agg(F.count("*").alias("attempts")), "repo_id"), 30)
)
_COUNTED = "SELECT repo, path, loc, len(string_split(text, '.')) AS functions, doc_id % 4 AS classes, indexed, on_disk FROM b_file"


def _counted(t, side):
    return t.b_file.where(side).select("repo", "path", "loc", F.size(F.split("text", r"\.", -1)).alias("functions"), (F.col("doc_id") % 4).alias("classes"))


query("coverage_audit", f"""
    WITH k AS ({_COUNTED}), i AS (SELECT repo, count(*) AS f, sum(loc) AS l, sum(functions) AS u, sum(classes) AS c FROM k WHERE indexed GROUP BY 1),
    d AS (SELECT repo, count(*) AS f, sum(loc) AS l, sum(functions) AS u, sum(classes) AS c FROM k WHERE on_disk AND repo <> 'src1' GROUP BY 1),
    b AS (SELECT repo, coalesce(i.f, 0) AS files_indexed, coalesce(d.f, 0) AS files_disk, coalesce(i.u, 0) AS functions_indexed, coalesce(d.u, 0) AS functions_disk, coalesce(i.c, 0) AS classes_indexed, coalesce(d.c, 0) AS classes_disk, coalesce(i.l, 0) AS loc_indexed, coalesce(d.l, 0) AS loc_disk FROM i FULL JOIN d USING (repo))
    SELECT repo, files_indexed, files_disk, files_indexed - files_disk AS files_delta, {", ".join(f"CAST({m}_indexed AS BIGINT) AS {m}_indexed, CAST({m}_disk AS BIGINT) AS {m}_disk, CAST({m}_indexed - {m}_disk AS BIGINT) AS {m}_delta" for m in ("functions", "classes", "loc"))} FROM b
""")(
    lambda t: repos.coverage_audit(_counted(t, "indexed"), _counted(t, "on_disk AND repo <> 'src1'"))
)
query("unindexed_files", """
    WITH n AS (SELECT repo, path, regexp_extract(path, '[^/]*$') AS base FROM b_file WHERE on_disk AND NOT indexed)
    SELECT repo, path, CASE WHEN NOT regexp_matches(base, '\\.(ts|py|cs)$') THEN 'unsupported' WHEN contains('/' || path, '/dist/') OR contains('/' || path, '/tests/') THEN 'excluded' ELSE 'missing' END AS reason
    FROM n
""")(
    lambda t: repos.unindexed_reasons(t.b_file.where("on_disk"), t.b_file.where("indexed"))
)
query("ghost_files", "SELECT repo, path FROM b_file WHERE indexed AND NOT on_disk")(lambda t: repos.only_in(t.b_file.where("indexed"), t.b_file.where("on_disk")))
query("repos_behind", """
    WITH r AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'c' || CAST(c_nationkey AS STRING) END AS commit FROM customer),
    h AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'c' || CAST(c_custkey % 25 AS STRING) END AS head FROM customer WHERE c_custkey % 10 <> 0)
    SELECT key, CASE WHEN head IS NULL THEN 'unreadable' WHEN commit IS NOT DISTINCT FROM head THEN 'current' ELSE 'behind' END AS state FROM r LEFT JOIN h USING (key)
""")(
    lambda t: repos.repos_behind(
        t.customer.selectExpr("c_custkey AS key", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'c' || CAST(c_nationkey AS STRING) END AS commit"),
        t.customer.where("c_custkey % 10 <> 0").selectExpr("c_custkey AS key", "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'c' || CAST(c_custkey % 25 AS STRING) END AS head"),
    )
)
query("exclude_irrelevant", """
    WITH b AS (SELECT *, regexp_extract(path, '[^/]*$') AS base, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder FROM b_path WHERE path IS NOT NULL),
    k AS (
        SELECT * FROM b WHERE NOT regexp_matches(base, '\\.(md|txt|yml|yaml|lock|log)$') AND NOT (base LIKE '%.json' AND base <> 'project.json') AND NOT regexp_matches(base, '(\\.|_)(test|spec)\\.')
            AND NOT starts_with(base, '.env') AND base <> 'Dockerfile' AND base <> 'Makefile' AND NOT starts_with(base, 'docker-compose')
            AND NOT list_has_any(string_split(folder, '/'), ['node_modules', 'dist', 'build', '.git', '.vscode', '.idea', '__pycache__', 'azure-pipelines', 'scripts', 'tools', 'docs', 'e2e'])
    )
    SELECT page_id, path FROM k WHERE NOT regexp_matches(base, '\\.(css|scss|less|svg|png|jpg)$')
        OR folder IN (SELECT folder FROM b WHERE regexp_matches(base, '\\.(tsx|jsx|vue|svelte|component\\.ts|component\\.html)$'))
""")(
    lambda t: changes.exclude_irrelevant(t.b_path).select("page_id", "path")
)
_MAP = r"""
    f AS (SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS base FROM b_path WHERE path IS NOT NULL),
    w AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS ws FROM f WHERE base IN ('package.json', 'project.json', 'angular.json') AND contains(path, '/')),
    o AS (SELECT path, base, ws FROM f JOIN w ON starts_with(path, ws || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(ws) DESC) = 1),
    g AS (SELECT ws, min(CASE WHEN contains('/' || path, '/src/app/') OR regexp_matches(base, '\.component\.(ts|html)$') THEN 0 WHEN regexp_matches(base, '\.(controller|service|module)\.ts$') THEN 1 WHEN base IN ('handler.ts', 'bootstrap.ts') THEN 2 END) AS sign FROM o GROUP BY 1),
    m AS (
        SELECT ws, string_split(ws, '/') AS s, sign FROM w LEFT JOIN g USING (ws)
    ),
    k AS (
        SELECT ws, CASE WHEN s[1] = 'apps' AND s[3] IN ('web', 'syndication') THEN 'frontend,detect' WHEN s[1] = 'apps' AND s[3] = 'api' THEN 'backend,detect' WHEN s[1] = 'apps' AND (s[2] = 'lambda' OR s[3] = 'sitemap-lambda') THEN 'backend,lambda'
            WHEN s[1] = 'libs' AND starts_with(s[2], 'ngx-') THEN 'shared-frontend,angular' WHEN s[1] = 'libs' AND starts_with(s[2], 'nest-') THEN 'shared-backend,nestjs' WHEN s[1] = 'libs' AND starts_with(s[2], 'express-') THEN 'shared-backend,express'
            WHEN s[1] = 'libs' AND ends_with(s[2], '-common') THEN 'shared-both,other' WHEN sign = 0 THEN 'frontend,angular' WHEN sign = 1 THEN 'backend,nestjs' WHEN sign = 2 THEN 'backend,lambda' ELSE 'shared-both,other' END AS k
        FROM m
    ),
    spaces AS (SELECT ws, string_split(k, ',')[1] AS wtype, string_split(k, ',')[2] AS framework FROM k)
"""
query("workspace_map", f"WITH {_MAP} SELECT * FROM spaces")(lambda t: changes.workspace_map(t.b_path))


def _spaces(t):
    return changes.assign_workspace(t.b_path, changes.workspace_map(t.b_path))


_W = rf"""
    WITH {_MAP},
    own AS (SELECT path, ws, wtype FROM (SELECT DISTINCT path FROM b_path) JOIN spaces ON path = ws OR starts_with(path, ws || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(ws) DESC) = 1)
    SELECT page_id, b.path, status, ws AS workspace, coalesce(wtype, CASE
        WHEN regexp_matches(b.path, '(\.(controller|service|resolver)\.ts|Controller\.(cs|java)|(^|/)views\.py|(^|/)routes\.py)$') THEN 'backend'
        WHEN regexp_matches('/' || b.path, '/(pages|views|components|src/app)/') OR regexp_matches(b.path, '\.(tsx|jsx|vue|svelte|cshtml|aspx|html)$') THEN 'frontend'
        WHEN regexp_matches('/' || b.path, '/(controllers|resolvers|services|routes|handlers|consumers|processors|jobs|middleware)/') THEN 'backend' ELSE 'irrelevant' END) AS wtype
    FROM b_path b LEFT JOIN own ON own.path = b.path
"""
query("assign_workspace", f"SELECT page_id, path, status, workspace, wtype FROM ({_W})")(lambda t: _spaces(t))
query("analysis_passes", f"""
    SELECT analysis, count(*) AS n FROM ({_W}) JOIN (VALUES ('frontend', 'frontend'), ('shared-frontend', 'frontend'), ('backend', 'backend'), ('shared-backend', 'backend'), ('shared-both', 'frontend'), ('shared-both', 'backend')) AS p(wtype, analysis) USING (wtype) GROUP BY 1
""")(lambda t: changes.analysis_passes(_spaces(t)).groupBy("analysis").agg(F.count("*").alias("n")))
query("scope_filter", """
    SELECT page_id, path FROM b_change WHERE path LIKE 'apps/en/%' OR path = 'apps/en' OR path LIKE 'apps/fr/%' OR path = 'apps/fr'
""")(
    lambda t: changes.scope_filter(t.b_change, ["apps/en", "apps/fr/"]).select("page_id", "path")
)
query("affected_apps", """
    SELECT l_suppkey AS library, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS apps FROM lineitem WHERE l_suppkey % 3 = 0
    GROUP BY 1
""")(
    lambda t: changes.affected_apps(t.supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("library")), t.lineitem.select(F.col("l_suppkey").alias("library"), F.col("l_returnflag").alias("app")).distinct())
)

# Specification tables
query("outcome_citations", """
    SELECT outcome_id, string_agg(doc, ',' ORDER BY pos, doc) AS docs
    FROM (SELECT outcome_id, split_part(scenario, ' ', 1) AS doc, min(scenario_id) AS pos FROM b_scenario GROUP BY 1, 2) GROUP BY 1
""")(
    lambda t: spec.outcome_citations(t.b_scenario.select("outcome_id", F.split("scenario", " ")[0].alias("doc"), F.col("scenario_id").alias("pos")))
)
query("source_index", """
    SELECT source AS doc, CAST(row_number() OVER (ORDER BY source) AS INTEGER) AS no FROM (SELECT DISTINCT source FROM documents
    WHERE source IS NOT NULL)
""")(
    lambda t: spec.source_index(t.documents.select(F.col("source").alias("doc")))
)

def _schema(t):
    facts = t.lineitem.where("l_linenumber = 1").selectExpr("l_suppkey AS table_id", "'FK' AS kind", "array(l_partkey) AS columns", "l_partkey % 100 AS ref_table")
    facts = facts.union(t.lineitem.where("l_linenumber = 3 AND l_suppkey % 3 = 0").selectExpr("l_suppkey", "'PK'", "array(l_partkey, l_partkey + 1)", "NULL"))
    return merges.derive_schema_fields(t.lineitem.selectExpr("l_suppkey AS table_id", "l_partkey AS name").distinct(), facts, t.lineitem.where("l_linenumber = 2").selectExpr("l_suppkey AS table_id", "array(l_partkey) AS columns"))


query("derive_schema_fields", """
    SELECT l_suppkey AS table_id, l_partkey AS name, bool_or(l_linenumber = 1) AS is_foreign_key, bool_or(l_linenumber = 2) AS is_indexed
    FROM lineitem GROUP BY 1, 2
""")(lambda t: _schema(t)[1])
query("derive_schema_tables", """
    SELECT l_suppkey AS table_id, count(DISTINCT l_partkey) AS column_count, bool_or(l_linenumber = 3 AND l_suppkey % 3 = 0) AS has_primary_key FROM lineitem GROUP BY 1
""")(lambda t: _schema(t)[0])
query("derive_schema_edges", "SELECT DISTINCT l_suppkey AS table_id, l_partkey % 100 AS ref_table FROM lineitem WHERE l_linenumber = 1")(lambda t: _schema(t)[2])
query("schema_ingest_check", """
    WITH l AS (SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1), r AS (SELECT p_brand AS label, count(*) AS n FROM part
    WHERE p_partkey % 9 <> 0 GROUP BY 1)
    SELECT label, coalesce(l.n, 0) AS n_left, coalesce(r.n, 0) AS n_right, CASE WHEN r.n IS NULL THEN 'left_only' ELSE 'both' END AS side FROM l
    FULL JOIN r USING (label)
""")(
    lambda t: interfaces.crosscheck(t.part.select(F.col("p_brand").alias("label")), t.part.where("p_partkey % 9 <> 0").select(F.col("p_brand").alias("label")), "label")
)
query("connect_candidates", """
    SELECT s_suppkey AS repo_id FROM supplier WHERE s_suppkey % 4 <> 0 ORDER BY 1 LIMIT (SELECT greatest(40 - count(*), 0) FROM supplier
    WHERE s_suppkey % 4 = 0)
""")(
    lambda t: repos.connect_candidates(t.supplier.selectExpr("s_suppkey AS repo_id", "CASE WHEN s_suppkey % 4 = 0 THEN 'ingesting' ELSE 'planned' END AS status"), 40)
)
query("focus_tables", """
    SELECT table_id, CAST(sum(h) AS BIGINT) AS hits
    FROM (SELECT p_partkey AS table_id, CAST(contains(lower(p_name), 'e') AS INT) + CAST(contains(lower(p_name), 's') AS INT) AS h FROM part
    UNION ALL SELECT p_partkey, CAST(contains(lower(p_type), 'e') AS INT) + CAST(contains(lower(p_type), 's') AS INT) FROM part) GROUP BY 1
    HAVING sum(h) > 0
""")(
    lambda t: search.focus_tables(t.part.selectExpr("p_partkey AS table_id", "p_name AS name"), t.part.selectExpr("p_partkey AS table_id", "p_type AS name"), ["e", "s"])
)
query("schema_dependents", """
    SELECT 'foreign_key' AS kind, l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'view', doc_id FROM documents
    WHERE regexp_matches(text, '(?i)\\bapache\\b')
""")(
    lambda t: search.schema_dependents("apache", t.lineitem.selectExpr("l_suppkey AS table_id", "CASE WHEN l_returnflag = 'A' THEN 'apache' ELSE 'x' END AS ref_table"), t.documents.selectExpr("'view' AS kind", "doc_id AS id", "text AS body"))
)
_NAMES = "SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]{5,}', 0)) AS name FROM conversations WHERE role = 'user'"
query("all_schema_dependents", rf"""
    WITH n AS (SELECT name FROM ({_NAMES}) WHERE name <> '')
    SELECT name AS table, 'foreign_key' AS kind, part_id AS id FROM (SELECT p_partkey AS part_id, lower(string_split(p_name, ' ')[1]) AS name FROM part) JOIN n USING (name)
    UNION ALL SELECT name, 'view', doc_id FROM documents JOIN n ON contains(lower(text), name) AND regexp_matches(lower(text), '\b' || name || '\b')
""")(
    lambda t: search.all_schema_dependents(_user_words(t).withColumnRenamed("name", "table"), t.part.select(F.col("p_partkey").alias("table_id"), F.split("p_name", " ")[0].alias("ref_table")), t.documents.selectExpr("'view' AS kind", "doc_id AS id", "text AS body"))
)
query("all_references", rf"""
    SELECT name AS term, path AS file FROM b_file JOIN (SELECT name FROM ({_NAMES}) WHERE name <> '') ON contains(lower(text), name) AND regexp_matches(lower(text), '\b' || name || '\b') GROUP BY 1, 2
""")(
    lambda t: search.all_references([t.b_file.select(F.col("path").alias("file"), "text")], _user_words(t).withColumnRenamed("name", "term"))
)


def _user_words(t):
    return t.conversations.where("role = 'user'").select(F.lower(F.regexp_extract("text", "[A-Za-z]{5,}", 0)).alias("name")).where("name <> ''").distinct()


query("anchor_architecture", """
    SELECT p_partkey AS code_ontology_id, p_brand AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)
""")(
    lambda t: search.anchor(t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("code_ontology_id")), t.part.selectExpr("p_partkey AS code_ontology_id", "p_brand AS name"))
)
query("attach_citations", """
    WITH own AS (SELECT DISTINCT o_custkey AS scenario_id, 'src/' || CAST(o_orderkey AS STRING) AS path FROM orders WHERE o_orderkey % 5 = 0)
    SELECT * FROM own UNION ALL SELECT scenario_id, 'o/' || CAST(outcome_id AS STRING) FROM b_scenario
    WHERE scenario_id NOT IN (SELECT scenario_id FROM own)
""")(
    lambda t: intents.attach_citations(t.b_scenario.select("scenario_id", "outcome_id"), t.orders.where("o_orderkey % 5 = 0").selectExpr("o_custkey AS scenario_id", "concat('src/', o_orderkey) AS path"), t.b_outcome.selectExpr("outcome_id", "concat('o/', outcome_id) AS path"))
)
def _attached(t):
    cache = t.b_intent.where("doc_id % 2 = 0").groupBy(fn.normalize_intent("intent").alias("norm")).agg(F.min("doc_id").alias("first"))
    return intents.attach_embeddings(t.b_intent, cache.select("norm", F.array(F.col("first").cast("double")).alias("embedding")))


query("attach_embeddings", f"""
    WITH c AS (SELECT DISTINCT {NORM} AS norm FROM b_intent WHERE doc_id % 2 = 0) SELECT DISTINCT {NORM} AS norm FROM b_intent
    WHERE {NORM} NOT IN (SELECT norm FROM c)
""")(lambda t: _attached(t)[1])
query("attached_embeddings", f"""
    WITH n AS (SELECT doc_id, {NORM} AS norm FROM b_intent), c AS (SELECT norm, CAST(min(doc_id) AS DOUBLE) AS first FROM n WHERE doc_id % 2 = 0 GROUP BY 1)
    SELECT doc_id, first FROM n LEFT JOIN c USING (norm)
""")(lambda t: _attached(t)[0].select("doc_id", F.get("embedding", F.lit(0)).alias("first")))
query("findings_report", """
    SELECT 'empty_scenarios' AS "check", 'P0' AS severity, CAST(scenario_id AS STRING) AS key, scenario AS detail FROM b_scenario
    WHERE scenario_id NOT IN (SELECT scenario_id FROM b_step)
""")(
    lambda t: exports.findings("empty_scenarios", "P0", functional.empty_scenarios(t.b_scenario, t.b_step), "scenario_id", "scenario")
)

# Streams: the given rows are written as files, read as a stream with a trigger that ends, and the kept table is the result
_WATERMARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM b_status_event)"


def streamed(t, rows: DataFrame, files: int = 4, each: int | None = None) -> tuple[DataFrame, str]:
    """The rows as a stream of files, ``each`` of ``files`` a batch (None: all), and a folder of its own for what is kept. Event times need a zone.

    A file of over ``RANGE_ROWS`` rows is several, and a batch has as many more: the number of batches stays, and no task writes or reads a fixed part of all rows.
    """
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows
    folder = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    times = max(1, -(-rows.count() // (files * RANGE_ROWS)))
    rows.repartition(files * times).write.parquet(f"{folder}/in")
    reader = t.spark.readStream.schema(rows.schema)
    return (reader if each is None else reader.option("maxFilesPerTrigger", each * times)).parquet(f"{folder}/in"), folder


def _plain(time: str):
    return F.col(time).cast("timestamp_ntz").alias(time)


def _kept(t, found: DataFrame, folder: str) -> DataFrame:
    """What an append-mode stream writes."""
    found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(found.schema).parquet(f"{folder}/out")


def _latest_table(t):
    rows, folder = streamed(t, t.b_status_event.select("event_id", "ts", F.col("repo_id").cast("long").alias("repo_id"), "stage"), 4, 1)
    table = stream_tables.latest_status_table(t.spark, f"{folder}/table", compact_every=3)
    table.start(rows, f"{folder}/log", availableNow=True).awaitTermination()
    return table.read().select("repo_id", _plain("ts"), "stage", repos.status_of().alias("status"))


query("stream_latest_status", _LATEST)(_latest_table)


def _counts_table(t):
    rows, folder = streamed(t, t.b_status_event, 4, 2)
    table = stream_tables.counts_table(t.spark, f"{folder}/table")
    stream_tables.start_counts(streams.stream_status_counts(rows, watermark="10000 days"), table, f"{folder}/log", availableNow=True).awaitTermination()
    return table.read().select(_plain("window_start"), "status", "n")


query("stream_status_counts", f"""
    SELECT date_trunc('day', ts) AS window_start, {_STATUS} AS status, count(*) AS n FROM b_status_event GROUP BY 1, 2
""")(_counts_table)


def _stalls(t):
    rows, folder = streamed(t, t.b_status_event)
    return _kept(t, streams.stream_stalls(rows, "6 hours"), folder).select("repo_id", _plain("stalled_at"), "stage")


query("stream_stalls", f"""
    WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM b_status_event
    WINDOW w AS (PARTITION BY repo_id ORDER BY ts, event_id)), k AS (SELECT *, sum(s) OVER (PARTITION BY repo_id ORDER BY ts, event_id) AS k
    FROM g), l AS (SELECT *, row_number() OVER (PARTITION BY repo_id, k ORDER BY ts DESC, event_id DESC) AS r FROM k)
    SELECT repo_id, ts + INTERVAL 6 HOUR AS stalled_at, stage FROM l WHERE r = 1 AND stage NOT IN ('active', 'error') AND ts + INTERVAL 6 HOUR <= {_WATERMARK}
""")(_stalls)


def _timers(t):
    rows, folder = streamed(t, t.b_repo_log)
    stalls.use_timers(t.spark)
    return _kept(t, stalls.stream_candidates(rows, 180, 4), folder).withColumn("at", _plain("at"))


_CANDIDATES = """
    WITH e AS (
        SELECT *, sum(CASE WHEN stage = 'connected' THEN 1 ELSE 0 END) OVER w AS life, lead(ts) OVER (PARTITION BY repo_id ORDER BY ts, event_id) AS next,
            last_value(CASE WHEN stage NOT IN ('still_running', 'retry_check_failed') THEN stage END IGNORE NULLS) OVER w AS said,
            last_value(CASE WHEN stage NOT IN ('still_running', 'retry_check_failed') THEN ts END IGNORE NULLS) OVER w AS progress, last_value(CASE WHEN stage = 'still_running' THEN ts END IGNORE NULLS) OVER w AS probed
        FROM b_repo_log WHERE ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM b_repo_log) WINDOW w AS (PARTITION BY repo_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    ),
    a AS (SELECT *, CAST(sum(CASE WHEN stage IN ('retried', 'retry_check_failed') THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS attempts, greatest(greatest(progress, coalesce(probed, progress)) + INTERVAL 3 HOUR, ts) AS due FROM e)
    SELECT repo_id, 'error' AS kind, ts AS at, said AS stage, attempts FROM a WHERE said = 'error' AND attempts < 4
    UNION ALL SELECT repo_id, 'stalled', due, said, attempts FROM a WHERE said NOT IN ('error', 'active') AND attempts < 4 AND (due < next OR next IS NULL AND due <= (SELECT max(ts) - INTERVAL 1 HOUR FROM b_repo_log))
"""
query("stream_stall_timers", _CANDIDATES)(_timers)
query("stall_candidates", _CANDIDATES)(lambda t: stalls.stall_candidates(t.b_repo_log, t.b_repo_log.selectExpr("max(ts) - INTERVAL 1 HOUR AS t").first().t, 180, 4))


from . import rules  # noqa: E402, F401  (registers more queries, which use the SQL of those above)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in FOUND.items() if sql}
