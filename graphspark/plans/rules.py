"""More queries, whose SQL writes out the rule, over views whose rows take every branch of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import values as v
from ..functions.scale import shared_dir
from ..operators import changes, design, functional, gates, ignores, interfaces, intents, merges, names, repos, search, spec
from ..sources import exports
from ..streaming import status as streams
from ..streaming import tables as stream_tables
from . import queries as base
from .registry import PK, SYS, any_of, query, sql_of, text_list

VERB = r"lower(regexp_extract(trim(action), '^(\S+)', 1))"
PAYLOAD = base._P
_SEGMENTS = "list_filter(string_split({0}, '/'), lambda x: x <> '' AND x NOT LIKE '{{%' AND x NOT LIKE ':%')"


def squeezed(*columns: str) -> str:
    return "lower(regexp_replace(" + " || ".join(f"coalesce({c}, '')" for c in columns) + r", '\s+', '', 'g'))"


# Scalar functions

query("norm_repo_url", r"""
    WITH u AS (
        SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z+]+://([^/@]*@)?', ''), '[?#].*$', ''), '/+$', ''), '\.git$', '') AS repo_url
        FROM b_clone
    )
    SELECT page_id, repo_url, CASE
        WHEN contains(split_part(repo_url, '/', 1), 'github') THEN 'github'
        WHEN contains(split_part(repo_url, '/', 1), 'bitbucket') THEN 'bitbucket'
        WHEN contains(split_part(repo_url, '/', 1), 'dev.azure.com') OR contains(split_part(repo_url, '/', 1), 'visualstudio.com') THEN 'azure'
        ELSE 'gitlab' END AS provider
    FROM u
""")(lambda t: t.b_clone.select("page_id", fn.norm_repo_url("url").alias("repo_url"), fn.provider_of("url").alias("provider")))

TOKENS = r"""list_sort(list_distinct(list_filter(regexp_split_to_array(
    lower(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')))"""
_CAMEL = "CASE id % 3 WHEN 0 THEN name WHEN 1 THEN 'Page2Form' || name ELSE 'LoginXMLForm_' || name END"
query("name_tokens", f"SELECT id, array_to_string({TOKENS.format(_CAMEL)}, ',') AS tokens FROM b_page")(
    lambda t: t.b_page.select("id", F.array_join(F.array_sort(fn.name_tokens(F.expr(_CAMEL))), ",").alias("tokens"))
)

_CUT = r"regexp_replace(regexp_replace(url, '\s*\((?s:.*)$', ''), '[?#](?s:.*)$', '')"
query("url_needle", rf"""
    SELECT url, CASE WHEN regexp_matches(url, '^(Query|Mutation)\.\w+$') THEN split_part(url, '.', 2)
        ELSE array_to_string({_SEGMENTS.format(_CUT)}[-3:], '/') END AS needle, count(*) AS n
    FROM b_url GROUP BY 1, 2
""")(lambda t: t.b_url.groupBy("url", fn.url_needle("url").alias("needle")).agg(F.count("*").alias("n")))



_URL_NEEDLE = rf"CASE WHEN regexp_matches(url, '^(Query|Mutation)\.\w+$') THEN split_part(url, '.', 2) ELSE array_to_string({_SEGMENTS.format(_CUT)}[-3:], '/') END"
query("template_compliance", f"""
    WITH x AS (SELECT parent AS id, count(*) AS n, min(c.name) AS tpl FROM (SELECT DISTINCT child, parent FROM b_template_on) l JOIN b_template c ON c.id = l.child AND c.type = 'TEMPLATE' GROUP BY 1),
    k AS (SELECT p.id, coalesce(n, 0) AS templates, tpl, CASE page_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in v.EXPECTED_TEMPLATES.items())} END AS expected FROM b_page p LEFT JOIN x USING (id)),
    i AS (SELECT id, templates, CASE WHEN templates = 0 THEN 'none' WHEN templates > 1 THEN 'several' WHEN tpl <> expected THEN 'unexpected' END AS issue FROM k)
    SELECT id, templates, issue, CASE WHEN templates = 0 THEN 'P0' ELSE 'P2' END AS severity FROM i WHERE issue IS NOT NULL
""")(lambda t: design.template_compliance(t.b_page, t.b_template, *_template_links(t)))


def _template_links(t) -> tuple:
    """The links of ``b_template_on`` without its pairs of whole groups (rest of the key by 20), and the groups."""
    four = t.supplier.where("s_suppkey % 4 = 0").selectExpr("s_suppkey AS child", "s_suppkey % 20 AS `group`")
    own = t.part.selectExpr("p_partkey AS parent", "p_partkey % 37 AS child").join(four.select("child"), "child").select("child", "parent")
    return t.links("b_component_parent").where("child % 4 <> 0").union(own), four, t.part.selectExpr("p_partkey AS parent", "p_partkey % 20 AS `group`")



def token_of(column: str) -> str:
    return rf"trim(regexp_replace(regexp_extract({column}, '{v.ROUTE_TOKEN}'), '^\s+', ''))"



_BARE = r"regexp_replace(regexp_replace(token, '^(?i:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+', ''), '[?#].*$', '')"
NEEDLE = rf"lower(CASE WHEN contains({_BARE}, '://') THEN regexp_replace({_BARE}, '/+$', '') ELSE array_to_string({_SEGMENTS.format(_BARE)}[-2:], '/') END)"
query("route_token", f"""
    SELECT said, token, {NEEDLE} AS needle, count(*) AS n FROM (SELECT said, {token_of('said')} AS token FROM b_said) GROUP BY 1, 2, 3
""")(lambda t: t.b_said.select("said", fn.route_token("said").alias("token")).groupBy("said", "token", fn.route_needle("token").alias("needle")).agg(F.count("*").alias("n")))

_TYPE = r"regexp_extract(data_type, '^\s*(\w+)(?:\s*\(\s*(\d+)(?:\s*,\s*(\d+))?\s*\))?', {0})"
query("decompose_data_type", f"""
    SELECT id, lower({_TYPE.format(1)}) AS base,
        CASE WHEN {_TYPE.format(3)} = '' THEN CAST(nullif({_TYPE.format(2)}, '') AS INTEGER) END AS length,
        CASE WHEN {_TYPE.format(3)} <> '' THEN CAST({_TYPE.format(2)} AS INTEGER) END AS precision,
        CAST(nullif({_TYPE.format(3)}, '') AS INTEGER) AS scale
    FROM b_type
""")(lambda t: t.b_type.select("id", fn.decompose_data_type("data_type").alias("d")).select("id", "d.*"))

query("build_embed_text", """
    WITH p AS (SELECT persona_id, 'Persona: ' || persona AS t FROM b_persona),
    o AS (SELECT outcome_id, t || chr(10) || 'Outcome: ' || outcome AS t FROM b_outcome JOIN p USING (persona_id)),
    s AS (SELECT scenario_id, t || chr(10) || 'Scenario: ' || scenario AS t FROM b_scenario JOIN o USING (outcome_id)),
    e AS (SELECT step_id, t || chr(10) || 'Step: ' || step AS t FROM b_step JOIN s USING (scenario_id)),
    a AS (SELECT action_id, t || chr(10) || 'Action: ' || action AS t FROM b_action JOIN e USING (step_id))
    SELECT 'persona' AS level, persona_id AS id, t AS embed_text FROM p UNION ALL SELECT 'outcome', * FROM o
    UNION ALL SELECT 'scenario', * FROM s UNION ALL SELECT 'step', * FROM e UNION ALL SELECT 'action', * FROM a
""")(lambda t: functional.embed_texts(*base._graph(t)))

_CITED = """CASE doc_id % 6 WHEN 0 THEN '["a.md", {"documentName": "b' || CAST(doc_id % 9 AS STRING) || '"}, "a.md", "x", {"name": "c"}, {"documentName": "d", "name": "e"}]'
    WHEN 1 THEN '[]' WHEN 2 THEN 'nothing' WHEN 3 THEN NULL WHEN 4 THEN '[{"other": "f"}, ""]' ELSE '["' || source || '"]' END"""
query("normalize_citations", f"""
    WITH c AS (SELECT doc_id, {_CITED} AS c FROM documents),
    j AS (SELECT doc_id, CASE WHEN json_valid(c) THEN from_json(c, '["JSON"]') END AS items FROM c),
    n AS (
        SELECT doc_id, list_filter(list_transform(items, lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN coalesce(x->>'$.documentName', x->>'$.name')
            WHEN length(x->>'$') > 1 THEN x->>'$' END), lambda x: x IS NOT NULL) AS names FROM j
    )
    SELECT doc_id, coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ','), '') AS names FROM n
""")(lambda t: t.documents.select("doc_id", F.array_join(fn.normalize_citations(F.expr(_CITED)), ",").alias("names")))

# Functional graph

query("platform_agnostic", f"""
    SELECT * FROM (
        SELECT action, count(*) AS n, array_to_string(list_sort(list_filter([{text_list(v.FORBIDDEN_UI_WORDS)}], lambda w: contains(lower(action), w))), ',') AS words
        FROM b_action GROUP BY 1
    ) WHERE words <> ''
""")(lambda t: functional.platform_agnostic(t.b_action))

query("persona_quality", f"""
    SELECT persona, outcomes, scenarios, actions, round(share, 4) AS share, array_to_string(list_filter([
        CASE WHEN share > 0.4 THEN 'BLOATED' END, CASE WHEN scenarios <= 1 AND actions < 5 THEN 'THIN' END,
        CASE WHEN lower(trim(persona)) IN ({text_list(v.FORBIDDEN_PERSONA_NAMES)}) THEN 'FORBIDDEN' END], lambda x: x IS NOT NULL), ',') AS flags
    FROM (SELECT *, scenarios / (SELECT greatest(count(*), 1) FROM b_scenario) AS share FROM ({sql_of('graph_totals')})) WHERE persona IS NOT NULL
""")(lambda t: functional.persona_quality(*base._graph(t)))

_HEALTH = "CASE WHEN p0 = 0 AND p1 <= 3 THEN 'HEALTHY' WHEN p0 = 0 THEN 'NEEDS_ATTENTION' ELSE 'CRITICAL' END AS label"


def _sums(parts: list[tuple[str, str]]) -> str:
    """SQL of the sums of (severity, SQL of a number) and their label."""
    rows = " UNION ALL ".join(f"SELECT '{s}' AS s, CAST(({sql}) AS BIGINT) AS n" for s, sql in parts)
    total = ", ".join(f"CAST(coalesce(sum(CASE WHEN s = '{s}' THEN n END), 0) AS BIGINT) AS {s.lower()}" for s in ("P0", "P1", "P2"))
    return f"SELECT *, {_HEALTH} FROM (SELECT {total} FROM ({rows}))"


def _count(name: str, where: str = "true", what: str = "count(*)") -> str:
    return f"SELECT {what} FROM ({sql_of(name).replace('b_outcome_all', 'b_outcome')}) WHERE {where}"  # of the tree's own outcomes


query("functional_health", _sums([
    ("P0", _count("empty_scenarios")), ("P0", _count("persona_quality", "contains(flags, 'FORBIDDEN')")), ("P1", _count("duplicate_scenarios")),
    ("P1", _count("duplicate_outcomes", "severity = 'P1'")), ("P1", _count("platform_agnostic")), ("P1", "SELECT CASE WHEN (SELECT sum(with_citation) < sum(total) FROM (" + sql_of("citation_coverage") + ")) THEN 1 ELSE 0 END"),
    ("P1", _count("description_coverage", "kind = 'system_action' AND pct < 80")), ("P1", _count("persona_quality", "contains(flags, 'BLOATED') OR contains(flags, 'THIN')")),
    ("P2", _count("duplicate_outcomes", "severity = 'P2'")), ("P2", f"SELECT count(*) FROM (SELECT k FROM (VALUES {', '.join(f'({text_list([k])})' for k in v.OVERLAP_KEYWORDS)}) AS v(k) JOIN (SELECT persona, scenario FROM b_scenario JOIN b_outcome USING (outcome_id) JOIN b_persona USING (persona_id)) ON contains(lower(scenario), k) GROUP BY 1 HAVING count(DISTINCT persona) >= 3)"),
]))(lambda t: functional.functional_health(*base._graph(t)))

# Payload gates

_NEST = """CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE array(named_struct('persona', IF(c_custkey % 7 = 0, ' ', c_mktsegment), 'outcomes', filter(array(named_struct('outcome', c_name, 'scenarios',
    filter(array(named_struct('scenario', IF(c_custkey % 13 = 0, '', 'S'), 'description', IF(c_custkey % 17 = 0, NULL, 'D'), 'steps', array(named_struct('step', 'T', 'actions',
    filter(array(named_struct('action', IF(c_custkey % 23 = 0, NULL, 'A'), 'citations', array(named_struct('type', 'code', 'name', 'n', 'reference', IF(c_custkey % 29 = 0, 'no slash', 'repo/a'))),
    'apis', array(named_struct('type', 'REST', 'method', 'GET', 'url', IF(c_custkey % 31 = 0, NULL, '/x'), 'request', '', 'response', '')))), x -> c_custkey % 19 <> 0))))),
    x -> c_custkey % 3 <> 0))), x -> c_custkey % 11 <> 0))) END AS personas"""
_TOP, _MID, _LOW = "c_custkey % 5 <> 0", "c_custkey % 5 <> 0 AND c_custkey % 11 <> 0", "c_custkey % 5 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 3 <> 0"
query("check_schema", "SELECT c_custkey AS payload_id, 'schema' AS \"check\", detail FROM (" + " UNION ALL ".join(
    f"SELECT c_custkey, '{detail}' AS detail FROM customer WHERE {where}" for detail, where in [
        ("personas", "c_custkey % 5 = 0"), ("persona", f"{_TOP} AND c_custkey % 7 = 0"), ("outcomes", f"{_TOP} AND c_custkey % 11 = 0"), ("outcome", f"{_MID} AND c_custkey % 3 = 0"),
        ("scenario", f"{_LOW} AND c_custkey % 13 = 0"), ("scenario.description", f"{_LOW} AND c_custkey % 17 = 0"), ("step", f"{_LOW} AND c_custkey % 19 = 0"),
        ("action", f"{_LOW} AND c_custkey % 19 <> 0 AND c_custkey % 23 = 0"), ("citation", f"{_LOW} AND c_custkey % 19 <> 0 AND c_custkey % 29 = 0"), ("api", f"{_LOW} AND c_custkey % 19 <> 0 AND c_custkey % 31 = 0"),
    ]) + ")")(lambda t: gates.check_schema(t.customer.selectExpr("c_custkey AS payload_id", _NEST)))

_STORE = "(" + " OR ".join(f"coalesce(regexp_matches(description, '{p}'), false)" for p in v.IDENTIFIER_PATTERNS) + ")"
query("check_rule_a", f"""
    SELECT payload_id, 'rule_a' AS "check", action_id, {VERB} AS detail FROM {PAYLOAD} WHERE NOT has_api AND (
        (NOT {SYS} AND {VERB} IN ({text_list(v.NETWORK_VERBS)})) OR ({SYS} AND {VERB} IN ({text_list(v.SIDE_EFFECT_VERBS)}) AND NOT {_STORE}))
""")(lambda t: gates.check_rule_a(base._payload(t)))

query("check_forbidden_words", rf"""
    SELECT * FROM (
        SELECT payload_id, 'forbidden_words' AS "check", action_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(action), '\b({'|'.join(v.FORBIDDEN_UI_WORDS)})\b', 1))), ',') AS detail
        FROM {PAYLOAD} WHERE NOT {SYS}
    ) WHERE detail <> ''
""")(lambda t: gates.check_forbidden_words(base._payload(t)))

query("check_persona", f"""
    SELECT payload_id, 'persona' AS "check", detail FROM (
        SELECT outcome_id AS payload_id, CASE WHEN {SYS} THEN 'kind'
            WHEN len(list_intersect(regexp_extract_all(lower(persona), '[a-z]+'), [{text_list(v.FORBIDDEN_PERSONA_NAMES)}])) > 0 THEN 'forbidden' END AS detail
        FROM b_outcome_all JOIN b_persona USING (persona_id)
    ) WHERE detail IS NOT NULL
""")(lambda t: gates.check_persona(t.b_outcome_all.join(t.b_persona, "persona_id").select(F.col("outcome_id").alias("payload_id"), "persona"), "human"))

_LINKED = f"""
    SELECT payload_id, 'path_linked' AS "check", action_id, detail FROM (
        SELECT *, CASE WHEN NOT has_api THEN 'no_api' WHEN NOT contains(lower('/api/v1/items/' || CAST(l_suppkey AS STRING)), {NEEDLE}) THEN 'other_url' END AS detail FROM (
            SELECT *, coalesce(nullif({token_of('action')}, ''), {token_of('description')}) AS token FROM {PAYLOAD}
            WHERE {VERB} IN ({text_list(sorted({*v.NETWORK_VERBS, *v.SIDE_EFFECT_VERBS}))})
        ) WHERE token <> ''
    ) WHERE detail IS NOT NULL
"""
query("check_path_linked", _LINKED)(lambda t: gates.check_path_linked(base._payload(t)))

_BLANK = "coalesce(trim(description) = '', true)"
query("check_descriptions", f"SELECT payload_id, action_id FROM {PAYLOAD} WHERE {_BLANK}")(lambda t: gates.check_descriptions(base._payload(t)).select("payload_id", "action_id"))

query("stream_gate_payloads", f"""
    {sql_of('check_rule_a')} UNION ALL {sql_of('check_forbidden_words')} UNION ALL {_LINKED}
    UNION ALL SELECT payload_id, 'description', action_id, 'missing' FROM {PAYLOAD} WHERE {_BLANK}
""")(lambda t: _findings(t))


def _findings(t):
    rows, folder = base.streamed(t, base._payload(t), 4, 2)
    stream_tables.start_findings(rows, f"{folder}/out", f"{folder}/log", availableNow=True).awaitTermination()
    return stream_tables.read_findings(t.spark, f"{folder}/out", streams.stream_gate_payloads(base._payload(t)).schema)

_INPUTS = f"i AS (SELECT payload_id, action_id, action, has_api, {squeezed('action', 'description')} AS t FROM {PAYLOAD} WHERE NOT {SYS} AND {VERB} IN ({text_list(v.INPUT_VERBS)}))"
query("check_atomicity", f"""
    WITH {_INPUTS}, f AS (SELECT payload_id, label, code, coalesce(code, label) AS field FROM b_field WHERE editable),
    r AS (
        SELECT DISTINCT payload_id, action_id, field FROM i JOIN f USING (payload_id)
        WHERE ({squeezed('label')} <> '' AND contains(t, {squeezed('label')})) OR ({squeezed('code')} <> '' AND contains(t, {squeezed('code')}))
    )
    SELECT payload_id, 'clubbed' AS "check", action_id, CAST(count(*) AS STRING) AS detail FROM r GROUP BY 1, 3 HAVING count(*) > 1
    UNION ALL SELECT payload_id, 'input_with_api', action_id, {VERB} FROM i WHERE has_api
    UNION ALL SELECT DISTINCT payload_id, 'no_action', CAST(NULL AS BIGINT), field FROM f
    WHERE payload_id IN (SELECT payload_id FROM {PAYLOAD} WHERE NOT {SYS}) AND (payload_id, field) NOT IN (SELECT payload_id, field FROM r)
""")(lambda t: gates.check_atomicity(base._payload(t), t.b_field))

_WIDGETS = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in v.WIDGET_PATTERNS)
query("check_widget_coverage", f"""
    WITH w AS (SELECT page_id AS payload_id, CAST(sum({_WIDGETS}) AS BIGINT) AS widgets FROM b_source_text GROUP BY 1),
    a AS (SELECT l_orderkey AS payload_id, count(*) AS actions FROM lineitem GROUP BY 1)
    SELECT payload_id, widgets, coalesce(actions, 0) AS actions FROM w LEFT JOIN a USING (payload_id) WHERE coalesce(actions, 0) < 0.9 * widgets
""")(lambda t: gates.check_widget_coverage(t.lineitem.select(F.col("l_orderkey").alias("payload_id")), t.b_source_text.select(F.col("page_id").alias("payload_id"), "text")))

query("check_node", f"""
    SELECT id, label, issue FROM (
        SELECT id, label, CASE
            WHEN label IS NULL OR label NOT IN ('Persona', 'Outcome', 'Scenario', 'Step', 'Action') THEN 'label'
            WHEN label <> 'Persona' AND parent_id IS NULL THEN 'parent'
            WHEN label IN ('Step', 'Action') AND name IS NULL THEN 'name'
            WHEN label IN ('Scenario', 'Step', 'Action') AND description IS NULL THEN 'description'
            WHEN label = 'Persona' AND lower(name) IN ({text_list(v.FORBIDDEN_NODE_PERSONAS)}) THEN 'forbidden_persona'
            WHEN label = 'Outcome' AND {any_of(v.TECHNICAL_OUTCOMES, 'lower(name)')} THEN 'technical_outcome' END AS issue
        FROM b_node
    ) WHERE issue IS NOT NULL
""")(lambda t: gates.check_node(t.b_node))

# Design graph

_SYNONYMS = ", ".join(f"({text_list([a, b])})" for x, y in v.SYNONYMS for a, b in ((x, y), (y, x)))
query("near_duplicate_names", f"""
    WITH k AS (SELECT {PK} AS platform, lower(name) AS key, min({TOKENS.format('name')}) AS plain FROM b_page WHERE trim(name) <> '' GROUP BY 1, 2),
    p AS (SELECT platform, key, unnest(plain) AS token FROM k),
    w AS (SELECT * FROM p UNION SELECT platform, key, b FROM p JOIN (VALUES {_SYNONYMS}) AS v(a, b) ON a = token),
    np AS (SELECT platform, key, count(*) AS n FROM p GROUP BY 1, 2), nw AS (SELECT platform, key, count(*) AS n FROM w GROUP BY 1, 2),
    sp AS (SELECT platform, x.key AS a, y.key AS b, count(*) AS s FROM p x JOIN p y USING (platform, token) WHERE x.key < y.key GROUP BY 1, 2, 3),
    sw AS (SELECT platform, x.key AS a, y.key AS b, count(*) AS s FROM w x JOIN w y USING (platform, token) WHERE x.key < y.key GROUP BY 1, 2, 3),
    j AS (
        SELECT sp.platform, a, b, s / (x.n + y.n - s) AS score FROM sp JOIN np x ON x.platform = sp.platform AND x.key = a JOIN np y ON y.platform = sp.platform AND y.key = b
        UNION ALL SELECT sw.platform, a, b, s / (x.n + y.n - s) FROM sw JOIN nw x ON x.platform = sw.platform AND x.key = a JOIN nw y ON y.platform = sw.platform AND y.key = b
    ),
    l AS (SELECT DISTINCT platform, a, b FROM j WHERE round(score, 4) >= 0.6)
    SELECT 'Page' AS label, platform, key, count(*) AS links FROM (SELECT platform, a AS key FROM l UNION ALL SELECT platform, b FROM l) GROUP BY 2, 3
""")(
    lambda t: names.near_duplicate_links(t.b_page.select(F.lit("Page").alias("label"), "platform", "name")).drop("cluster")
)
query("near_duplicate_clusters")(lambda t: names.near_duplicate_links(t.b_page.select(F.lit("Page").alias("label"), "platform", "name")).select("platform", "key", "cluster"))


def _down(above: str, nodes: str, links: str) -> str:
    """Nodes with the platforms that are handed down to them by ``above`` (id, p)."""
    return f"""SELECT n.id, n.platform, e AS expected, CASE WHEN list_contains(e, n.platform) THEN n.platform ELSE e[1] END AS p
        FROM (SELECT id, {PK} AS platform FROM {nodes}) n JOIN (SELECT child, list_sort(list(DISTINCT p)) AS e FROM {links} JOIN {above} u ON u.id = parent GROUP BY 1) x ON x.child = n.id"""


query("child_platform_mismatch", f"""
    WITH j AS (SELECT id, {PK} AS p FROM b_journey), f AS ({_down('j', 'b_flow', 'b_flow_parent')}), g AS ({_down('f', 'b_page_on', 'b_page_parent')}), c AS ({_down('g', 'b_component_on', 'b_component_parent')}),
    a AS (SELECT 'Flow' AS label, * FROM f UNION ALL SELECT 'Page', * FROM g UNION ALL SELECT 'Component', * FROM c)
    SELECT label, id, platform, array_to_string(expected, ',') AS expected,
        CASE WHEN list_contains(expected, platform) THEN 'shared by journeys on different platforms' ELSE 'not on its journey''s platform' END AS reason
    FROM a WHERE expected <> [platform]
""")(lambda t: design.platforms_handed_down(t.b_journey, [("Flow", t.b_flow, t.b_flow_parent), ("Page", t.b_page_on, t.b_page_parent), ("Component", t.b_component_on, t.b_component_parent)]))

_KIND = "CASE p_partkey % 7 WHEN 0 THEN 'Wizard' WHEN 1 THEN 'list' WHEN 2 THEN NULL WHEN 3 THEN 'Dashboard' ELSE 'FORM' END"
query("invalid_enums", f"""
    SELECT id, value, CASE WHEN upper(value) IN ({text_list(v.PAGE_TYPES)}) THEN 'P1' ELSE 'P0' END AS severity FROM (SELECT p_partkey AS id, {_KIND} AS value FROM part)
    WHERE value NOT IN ({text_list(v.PAGE_TYPES)})
""")(lambda t: design.invalid_enums(t.part.selectExpr("p_partkey AS id", f"{_KIND} AS page_type"), "page_type", v.PAGE_TYPES))

query("supporting_components", """
    WITH n AS (SELECT id, count(*) AS n FROM b_uses GROUP BY 1), l AS (SELECT lower(name) AS key, max_by(type, id) AS used_type FROM b_component GROUP BY 1)
    SELECT id, 'too_few' AS issue, CAST(NULL AS STRING) AS used FROM b_component LEFT JOIN n USING (id) WHERE coalesce(n, 0) < CASE type WHEN 'ATOM' THEN 0 ELSE 2 END
    UNION ALL SELECT id, 'unknown', used FROM b_uses WHERE lower(used) NOT IN (SELECT key FROM l)
    UNION ALL SELECT u.id, 'not_organism', used FROM b_uses u JOIN l ON key = lower(used) JOIN b_component c ON c.id = u.id WHERE c.type = 'TEMPLATE' AND used_type <> 'ORGANISM'
""")(lambda t: design.supporting_components(t.b_component, t.b_uses.select("id", "used")))

_NODES = """SELECT 'UserJourney' AS label, CAST(NULL AS STRING) AS description FROM b_journey UNION ALL SELECT 'Flow', description FROM b_flow
    UNION ALL SELECT 'Page', 'shows ' || page_type FROM b_page UNION ALL SELECT 'Component', CASE WHEN id % 2 = 0 THEN 'N/A  ' ELSE name END FROM b_component"""
query("design_description_coverage", f"""
    SELECT label, count(*) AS total, CAST(sum(bad) AS BIGINT) AS missing, round(100.0 * (count(*) - sum(bad)) / count(*), 1) AS pct FROM (
        SELECT label, CASE WHEN length(trim(coalesce(description, ''))) >= 5 AND lower(trim(coalesce(description, ''))) NOT IN ({text_list(v.PLACEHOLDER_DESCRIPTIONS)}) THEN 0 ELSE 1 END AS bad FROM ({_NODES})
    ) GROUP BY 1
""")(lambda t: functional.description_gaps(base._sql_views(t, _NODES)))

query("modality_distribution", "SELECT coalesce(modality, 'UNKNOWN') AS modality, count(*) AS n FROM b_flow GROUP BY 1")(lambda t: design.modality_distribution(t.b_flow))

_TWICE = "SELECT scenario_id, outcome_id FROM b_scenario UNION ALL SELECT scenario_id, (outcome_id + 1) % 25 FROM b_scenario WHERE scenario_id % 6 = 0"
query("journey_platform_mismatch", f"""
    WITH o AS (SELECT outcome_id, {PK} AS p FROM b_outcome), w AS (SELECT scenario_id, list_sort(list(DISTINCT p)) AS e FROM ({_TWICE}) JOIN o USING (outcome_id) GROUP BY 1)
    SELECT id, platform, array_to_string(e, ',') AS expected, len(e) > 1 AS ambiguous FROM (SELECT id, scenario_id, {PK} AS platform FROM b_journey) JOIN w USING (scenario_id)
    WHERE len(e) > 1 OR e[1] <> platform
""")(lambda t: design.journey_platform_mismatch(t.b_journey, base._sql_views(t, _TWICE), t.b_outcome))

_STEPS = "SELECT l_suppkey AS component_id, l_orderkey * 10 + l_linenumber AS action_id, l_orderkey + l_linenumber % 2 AS step_id FROM lineitem"
query("step_action_consistency", f"""
    WITH a AS ({_STEPS}), f AS (SELECT o_orderkey AS flow, o_orderkey AS step_id FROM orders WHERE o_orderkey % 5 <> 0),
    m AS (SELECT DISTINCT action_id, step_id FROM a), r AS (SELECT a.component_id, a.action_id, m.step_id FROM a JOIN m USING (action_id)),
    fine AS (
        SELECT DISTINCT r.component_id, r.step_id FROM r JOIN f ON f.step_id = r.step_id JOIN b_page_parent p ON p.parent = f.flow
        JOIN b_component_parent c ON c.parent = p.child AND c.child = r.component_id
    ),
    reach AS (SELECT DISTINCT c.child FROM b_component_parent c WHERE c.parent IN (SELECT p.child FROM b_page_parent p WHERE p.parent IN (SELECT flow FROM f)))
    SELECT component_id, action_id, step_id FROM r WHERE component_id IN (SELECT child FROM reach) AND (component_id, step_id) NOT IN (SELECT component_id, step_id FROM fine)
""")(
    lambda t: design.step_action_consistency(
        base._sql_views(t, _STEPS).select("component_id", "action_id"), base._sql_views(t, _STEPS).select("action_id", "step_id").distinct(), t.links("b_component_parent"), t.links("b_page_parent"),
        t.orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("child"), F.col("o_orderkey").alias("parent")),
    )
)

query("actions_on_pages", "SELECT id, name, count(*) AS n FROM b_page JOIN lineitem ON l_partkey = id WHERE l_returnflag = 'A' GROUP BY 1, 2")(
    lambda t: design.actions_on_pages(t.b_page, t.lineitem.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("child"), F.col("l_orderkey").alias("parent")))
)


def _design_findings(t):
    run = lambda name: base.FOUND[name][0](t)
    return [
        ("P0", run("empty_hierarchy")), ("P0", run("missing_scenario_id")), ("P0", run("duplicate_scenario_ids").where("counts").drop("n")), ("", run("invalid_enums")), ("P0", run("dangling_parent_refs")), ("P0", run("broken_chains")),
        ("P0", run("child_platform_mismatch")), ("P0", run("journey_platform_mismatch")), ("", run("template_compliance")), ("P1", run("orphan_nodes")), ("P1", run("duplicate_names").drop("n")),
        ("P1", run("near_duplicate_names").agg((F.sum("links") / 2).cast("long").alias("n"))), ("P1", run("duplicate_linkage").drop("n")), ("P1", run("supporting_components")), ("P1", run("actions_on_pages").drop("n")),
        ("P1", run("design_description_coverage").select(F.col("missing").alias("n"))),
    ]


query("design_health", _sums([
    ("P0", _count("empty_hierarchy")), ("P0", _count("missing_scenario_id")), ("P0", _count("duplicate_scenario_ids", "counts")), ("P0", _count("invalid_enums", "severity = 'P0'")), ("P1", _count("invalid_enums", "severity = 'P1'")),
    ("P0", _count("dangling_parent_refs")), ("P0", _count("broken_chains")), ("P0", _count("child_platform_mismatch")), ("P0", _count("journey_platform_mismatch")), ("P0", _count("template_compliance", "severity = 'P0'")),
    ("P2", _count("template_compliance", "severity = 'P2'")), ("P1", _count("orphan_nodes")), ("P1", _count("duplicate_names")), ("P1", _count("near_duplicate_names", what="coalesce(sum(links), 0) / 2")),
    ("P1", _count("duplicate_linkage")), ("P1", _count("supporting_components")), ("P1", _count("actions_on_pages")), ("P1", _count("design_description_coverage", what="coalesce(sum(missing), 0)")),
]))(lambda t: design.design_health(_design_findings(t)))

# Registries

_LEVEL = "list_position(['ATOM', 'MOLECULE', 'ORGANISM', 'TEMPLATE'], {0})"
_A, _B = _LEVEL.format("left_type"), _LEVEL.format("right_type")
query("component_type_drift", f"""
    WITH {base._REG} SELECT key, left_type, right_type, CASE WHEN least({_A}, {_B}) = 3 AND greatest({_A}, {_B}) = 4 THEN 'LOW' WHEN abs({_A} - {_B}) = 1 THEN 'MEDIUM' ELSE 'HIGH' END AS severity
    FROM c WHERE side = 'matched' AND left_type <> right_type
""")(lambda t: interfaces.component_type_drift(interfaces.compare_registries(*base._registries(t))))

query("registry_health", f"""
    WITH {base._REG}, d AS ({sql_of('component_children_drift')}),
    s AS (SELECT count(CASE WHEN side = 'matched' THEN 1 END) / count(*) AS a,
        count(CASE WHEN side = 'matched' AND left_type = right_type THEN 1 END) / nullif(count(CASE WHEN side = 'matched' THEN 1 END), 0) AS b FROM c),
    k AS (SELECT count(CASE WHEN left_only = 0 AND right_only = 0 THEN 1 END) / nullif(count(*), 0) AS c FROM d)
    SELECT round(a, 4) AS name_presence, round(coalesce(b, 0), 4) AS type_alignment, round(coalesce(k.c, 0), 4) AS children_alignment, round((a + coalesce(b, 0) + coalesce(k.c, 0)) / 3, 4) AS overall FROM s, k
""")(lambda t: interfaces.registry_health(interfaces.compare_registries(*base._registries(t)), base._kids(t)))

query("validate_registry", """
    WITH t AS (SELECT name, min(type) AS type FROM b_component GROUP BY 1), n AS (SELECT name, count(*) AS n FROM b_uses GROUP BY 1),
    k AS (SELECT DISTINCT t.name, CASE WHEN c.type IS NULL THEN 'unknown_child' WHEN (t.type = 'MOLECULE' AND c.type <> 'ATOM') OR (t.type = 'ORGANISM' AND c.type NOT IN ('MOLECULE', 'ATOM'))
        OR (t.type = 'TEMPLATE' AND c.type <> 'ORGANISM') THEN 'child_level' END AS issue FROM b_uses u JOIN t ON t.name = u.name LEFT JOIN t c ON c.name = u.used)
    SELECT name, 'too_few' AS issue FROM t LEFT JOIN n USING (name) WHERE type <> 'ATOM' AND coalesce(n, 0) < 2
    UNION ALL SELECT name, 'atom_with_children' FROM t JOIN n USING (name) WHERE type = 'ATOM' UNION ALL SELECT name, issue FROM k WHERE issue IS NOT NULL
""")(lambda t: merges.validate_registry(t.b_component.select("name", "type"), t.b_uses.select("name", F.col("used").alias("child"))))

# Merges


def _side(t, new: bool) -> dict:
    """The tree as it stands, or a payload with a part of it in other words."""
    cites = lambda c: F.when(F.lit(new), F.array(F.concat(F.lit("n"), (F.col(c) % 3).cast("string")), F.lit("x"))).otherwise(F.array(F.concat(F.lit("o"), (F.col(c) % 2).cast("string")), F.lit("x"))).alias("citations")
    say = (lambda c: F.concat(F.lit(" "), F.upper(c)).alias(c)) if new else (lambda c: F.col(c))
    keep = lambda df, c: df.where(F.col(c) % 4 != (0 if new else 1))
    text = F.lit("new" if new else "old").alias("description")
    return {
        "persona": t.b_persona.select("persona_id", say("persona"), cites("persona_id")), "outcome": keep(t.b_outcome, "outcome_id").select("outcome_id", "persona_id", say("outcome"), "platform", F.when(F.col("outcome_id") % 3 == 0, text).alias("description"), cites("outcome_id")),
        "scenario": keep(t.b_scenario, "scenario_id").select("scenario_id", "outcome_id", say("scenario"), F.when(F.col("scenario_id") % 5 != 0, text).alias("description"), cites("scenario_id")),
        "step": t.b_step.select("step_id", "scenario_id", say("step"), cites("step_id")), "action": t.b_action.select("action_id", "step_id", say("action"), "description", cites("action_id"), F.when(F.col("has_api"), F.array(F.lit("/new" if new else "/old"))).alias("apis")),
    }


def _side_sql(new: bool) -> str:
    n = int(new)
    cites = lambda c: f"['n' || CAST({c} % 3 AS STRING), 'x']" if new else f"['o' || CAST({c} % 2 AS STRING), 'x']"
    say = lambda c: f"' ' || upper({c})" if new else c
    key = lambda c: rf"regexp_replace(lower(trim(regexp_replace({say(c)}, '\s+', ' ', 'g'))), '([\\|>])', '\\\1', 'g')"
    keep = lambda c: f"{c} % 4 <> {0 if new else 1}"
    text, none = "'new'" if new else "'old'", "CAST(NULL AS STRING[])"
    return f"""
        p{n} AS (SELECT persona_id, {say('persona')} AS name, {key('persona')} AS path, CAST(NULL AS STRING) AS d, {cites('persona_id')} AS c, {none} AS a FROM b_persona),
        o{n} AS (SELECT outcome_id, {say('outcome')} AS name, path || ' > ' || {key('outcome')} || '|' || {PK} AS path, CASE WHEN outcome_id % 3 = 0 THEN {text} END AS d, {cites('outcome_id')} AS c, {none} AS a FROM b_outcome JOIN p{n} USING (persona_id) WHERE {keep('outcome_id')}),
        s{n} AS (SELECT scenario_id, {say('scenario')} AS name, path || ' > ' || {key('scenario')} AS path, CASE WHEN scenario_id % 5 <> 0 THEN {text} END AS d, {cites('scenario_id')} AS c, {none} AS a FROM b_scenario JOIN o{n} USING (outcome_id) WHERE {keep('scenario_id')}),
        t{n} AS (SELECT step_id, {say('step')} AS name, path || ' > ' || {key('step')} AS path, CAST(NULL AS STRING) AS d, {cites('step_id')} AS c, {none} AS a FROM b_step JOIN s{n} USING (scenario_id)),
        a{n} AS (SELECT {say('action')} AS name, path || ' > ' || {key('action')} AS path, description AS d, {cites('action_id')} AS c, CASE WHEN has_api THEN ['{'/new' if new else '/old'}'] END AS a FROM b_action JOIN t{n} USING (step_id))"""


_ALL = " UNION ALL ".join(f"SELECT '{level}' AS level, name, path, d, c, a, {n} AS seq FROM {x}{n}" for n in (0, 1) for x, level in zip("posta", merges.TREE))
query("merge_functional", f"""
    WITH {_side_sql(False)}, {_side_sql(True)}, n AS ({_ALL}),
    m AS (
        SELECT level, path, min_by(name, (seq, name)) AS name, coalesce(max(CASE WHEN seq = 1 THEN d END), max(CASE WHEN seq = 0 THEN d END)) AS description,
            list_sort(list_distinct(flatten(list(coalesce(c, []))))) AS citations, list_sort(list_distinct(flatten(list(coalesce(a, []))))) AS apis, min(seq) = 1 AS is_new FROM n GROUP BY 1, 2
    )
    SELECT level, path, sha256(path) AS key_id, name, description, array_to_string(citations, ',') AS citations, array_to_string(apis, ',') AS apis, is_new FROM m
""")(lambda t: merges.merge_tree(_side(t, False), _side(t, True)).withColumns({c: F.array_join(c, ",") for c in ("citations", "apis")}))

query("widen_component_scope", """
    SELECT type, name, features, apps, shared, supporting, CASE WHEN features >= 3 OR apps >= 2 OR shared THEN 'GLOBAL' WHEN features = 2 THEN 'DOMAIN' ELSE 'PAGE' END AS scope FROM (
        SELECT type, name, count(DISTINCT feature) AS features, count(DISTINCT app) AS apps, bool_or(shared) AS shared, coalesce(string_agg(DISTINCT uses, ',' ORDER BY uses), '') AS supporting FROM b_observed GROUP BY 1, 2)
""")(lambda t: merges.widen_scope(t.b_observed).withColumn("supporting", F.array_join("supporting", ",")))

_ARCH = {"name": "doc iac code", "description": "doc iac code", "domain": "doc iac code", "technology": "iac code doc", "region": "iac code doc", "deployment": "iac code doc"}
_ARCH_ROWS = """a AS (SELECT layer, lower(name) AS k, source, name, description, CASE WHEN domain_a IS NULL OR domain_a = domain_b THEN domain_b WHEN domain_a < domain_b THEN domain_a || ',' || domain_b ELSE domain_b || ',' || domain_a END AS domain, technology, region, deployment FROM b_arch)"""
_LONG = " UNION ALL ".join(f"SELECT layer, k, '{f}' AS field, {f} AS value, source, list_position({order.split()}, source) AS rank FROM a WHERE {f} IS NOT NULL" for f, order in _ARCH.items())


def _architecture(t):
    return merges.merge_architecture(t.b_arch.withColumn("domain", F.filter(F.array("domain_a", "domain_b"), lambda d: d.isNotNull())))


query("merge_architecture_sources", f"""
    WITH {_ARCH_ROWS}, l AS ({_LONG}), e AS (SELECT layer, k, field, value, min(rank) AS rank, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM l GROUP BY 1, 2, 3, 4)
    SELECT layer, k, field, value, sources, value = first(value) OVER (PARTITION BY layer, k, field ORDER BY rank, value) AS chosen FROM e QUALIFY count(*) OVER (PARTITION BY layer, k, field) > 1
""")(lambda t: _architecture(t)[1])
_BEST = lambda f: f"first({f} ORDER BY list_position({_ARCH[f].split()}, source), {f}) FILTER (WHERE {f} IS NOT NULL) AS {f}"
query("merge_architecture_rows", f"""
    WITH {_ARCH_ROWS}, d AS (SELECT layer, lower(name) AS k, string_agg(DISTINCT d, ',' ORDER BY d) AS domains FROM (SELECT layer, name, unnest([domain_a, domain_b]) AS d FROM b_arch) WHERE d IS NOT NULL GROUP BY 1, 2)
    SELECT a.layer, {", ".join(_BEST(f) for f in _ARCH)}, any_value(domains) AS domains,
        CASE WHEN bool_or(source = 'doc') THEN 'documented' WHEN bool_or(source = 'code') THEN 'code-discovered' ELSE 'iac-discovered' END AS origin
    FROM a LEFT JOIN d ON d.layer = a.layer AND d.k = a.k GROUP BY a.layer, a.k
""")(lambda t: _architecture(t)[0])

_TYPES = ", ".join(f"({text_list([*(x.split('*') if '*' in x else (x, ''))])}, '{layer}', {str(look).lower()})" for table, look in ((v.RESOURCE_LAYERS, False), (v.FLAGGED_RESOURCES, True)) for layer, types in table.items() for x in types.split())
query("classify_iac_resources", f"""
    WITH k AS (SELECT * FROM (VALUES {_TYPES}) AS v(prefix, suffix, layer, look)),
    m AS (SELECT rtype, layer, look, row_number() OVER (PARTITION BY rtype ORDER BY length(prefix) + length(suffix) DESC, prefix DESC) AS r FROM (SELECT DISTINCT rtype FROM b_resource) JOIN k ON starts_with(rtype, prefix) AND ends_with(rtype, suffix))
    SELECT id, b.rtype, layer, layer IS NULL OR look AS flagged FROM b_resource b LEFT JOIN (SELECT * FROM m WHERE r = 1) m ON m.rtype = b.rtype
""")(lambda t: merges.classify_resources(t.b_resource))

# Search and impact

query("keyword_sweep_hits", """
    WITH h AS (SELECT noun, doc_id AS id FROM documents JOIN (VALUES ('the'), ('apache'), ('license'), ('password')) AS v(noun) ON contains(lower(text), noun))
    SELECT id, noun FROM h WHERE noun IN (SELECT noun FROM h GROUP BY 1 HAVING count(*) <= 60)
""")(lambda t: search.keyword_sweep(t.documents.select(F.col("doc_id").alias("id"), "text"), base._NOUNS)[1].select("id", "noun"))

query("semantic_top_k", """
    WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
    SELECT query_id, id, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM s) WHERE r <= 10
""")(lambda t: search.semantic_top_k(t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), 10).select("query_id", "id", F.round("score", 5).alias("score")))

query("call_graph_neighbours", """
    WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem), h0 AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey % 1000 = 1),
    h1 AS (SELECT DISTINCT t AS id FROM e WHERE s IN (SELECT id FROM h0) AND t NOT IN (SELECT id FROM h0)),
    h2 AS (SELECT DISTINCT t AS id FROM e WHERE s IN (SELECT id FROM h1) AND t NOT IN (SELECT id FROM h0 UNION ALL SELECT id FROM h1))
    SELECT id, 0 AS distance FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2
""")(lambda t: search.neighbours(t.lineitem.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")), t.lineitem.where("l_orderkey % 1000 = 1").select(F.col("l_orderkey").alias("id")), 2))

# Intents

_SAID = "substr(intent, strpos(intent, ': ') + 2)"
query("filter_non_functional", f"SELECT doc_id FROM b_intent WHERE NOT {any_of(v.NON_FUNCTIONAL, _SAID)}")(
    lambda t: intents.filter_non_functional(t.b_intent).select("doc_id")
)

_VECTORS = lambda t: t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("grp"), "embedding")
_PAIRS = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3"
query("similar_pairs", f"SELECT a AS id, count(*) AS links FROM ({_PAIRS}) GROUP BY 1")(lambda t: intents.similar_links(_VECTORS(t), 0.70).where("links > 0"))
_CLUSTERS = f"""
    SELECT vec_id AS id, CAST(label AS STRING) AS grp, cluster FROM embeddings LEFT JOIN (
        WITH RECURSIVE p AS ({_PAIRS}), r AS (SELECT DISTINCT a AS id, a AS seen FROM p UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.seen)
        SELECT id, min(seen) AS cluster FROM r GROUP BY 1
    ) AS c ON c.id = vec_id
"""
query("cluster_intents", _CLUSTERS)(lambda t: intents.cluster(_VECTORS(t), 0.70))
query("cluster_summary", f"SELECT grp, count(*) AS n, count(DISTINCT cluster) AS clusters, CAST(sum(CASE WHEN cluster IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS singletons FROM ({_CLUSTERS}) GROUP BY 1")(
    lambda t: intents.cluster_summary(intents.cluster(_VECTORS(t), 0.70))
)

query("capacity_batches", """
    SELECT grp, pos, size, batch FROM (
        WITH RECURSIVE o AS (SELECT repo AS grp, doc_id AS pos, loc AS size, row_number() OVER (PARTITION BY repo ORDER BY doc_id) AS n FROM b_file),
        r AS (
            SELECT grp, pos, size, n, CAST(0 AS BIGINT) AS batch, CASE WHEN size >= 20000 THEN 0 ELSE size END AS held FROM o WHERE n = 1
            UNION ALL SELECT o.grp, o.pos, o.size, o.n,
                r.batch + CASE WHEN r.size >= 20000 THEN 1 ELSE 0 END + CASE WHEN r.held > 0 AND (r.held + o.size > 20000 OR o.size >= 20000) THEN 1 ELSE 0 END,
                CASE WHEN o.size >= 20000 THEN 0 WHEN r.held > 0 AND r.held + o.size > 20000 THEN o.size ELSE r.held + o.size END
            FROM r JOIN o ON o.grp = r.grp AND o.n = r.n + 1
        )
        SELECT * FROM r
    )
""")(lambda t: intents.capacity_batches(t.b_file.select(F.col("repo").alias("grp"), F.col("doc_id").alias("pos"), F.col("loc").alias("size")), 20_000, True))

_CLEAN = r"regexp_replace(text, '\r?\n', ' ', 'g')"
query("extract_branches", f"""
    WITH k AS (
        SELECT fn, pos, CASE WHEN stype IN ({text_list(v.BRANCH_TYPES)}) THEN CASE WHEN {any_of(v.BRANCH_WORDS, f'lower({_CLEAN})')} THEN 'BRANCH' END
            WHEN stype = 'decorator' THEN CASE WHEN {any_of(v.ROUTE_WORDS, _CLEAN)} THEN 'ROUTE' END
            WHEN stype = 'query_statement' THEN CASE WHEN {any_of(v.QUERY_WORDS, f'lower({_CLEAN})')} THEN 'DB' END END AS kind
        FROM b_statement_of WHERE length(text) >= 10
    ),
    r AS (SELECT *, count(*) OVER (PARTITION BY fn) AS n, row_number() OVER (PARTITION BY fn, kind = 'DB' ORDER BY pos) AS r FROM k WHERE kind IS NOT NULL)
    SELECT fn, pos, kind FROM r WHERE n <= 8 OR (kind = 'DB' AND r <= 2) OR (kind <> 'DB' AND r <= 6)
""")(lambda t: intents.extract_branches(t.b_statement_of))

# Repositories and changes

_EXT = r"lower(regexp_extract(path, '(\.[^./]+)$', 1))"
_BUILT_IN = "|".join(f"(?:{fn.gitignore_to_regex(p)})" for p in v.DEFAULT_IGNORES)
_OWN = " ".join(f"WHEN regexp_matches(path, '{fn.gitignore_to_regex(p)}') THEN '{p}'" for p in base._PATTERNS)
_REASON = f"CASE WHEN {_EXT} NOT IN ({text_list(v.SUPPORTED_EXTENSIONS)}) THEN 'unsupported' WHEN regexp_matches(path, '{_BUILT_IN}') THEN 'built-in' {_OWN} ELSE 'kept' END AS reason"
query("preview_ignores", f"SELECT doc_id, {_REASON} FROM b_file")(lambda t: repos.preview_ignores(t.b_file, base._PATTERNS).select("doc_id", "reason"))
query("pattern_hits", f"SELECT pattern, count(reason) AS n FROM (VALUES {', '.join(f'({text_list([p])})' for p in base._PATTERNS)}) AS v(pattern) LEFT JOIN (SELECT {_REASON} FROM b_file) ON reason = pattern GROUP BY 1")(
    lambda t: repos.pattern_hits(repos.preview_ignores(t.b_file, base._PATTERNS), base._PATTERNS)
)

query("change_breakdown", f"""
    SELECT workspace, wtype, count(*) AS changed, count(CASE WHEN status = 'A' THEN 1 END) AS to_create, count(CASE WHEN status = 'M' THEN 1 END) AS to_update, count(CASE WHEN status IN ('D', 'R') THEN 1 END) AS to_flag
    FROM ({base._W}) GROUP BY 1, 2
""")(lambda t: changes.change_breakdown(base._spaces(t)))

# Exports and specification tables

query("plain_rows", """
    WITH t AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY created_at NULLS LAST, step_id) AS step_no FROM b_step),
    r AS (SELECT s.scenario_id, s.scenario, t.step, t.step_no, a.action_id, a.action FROM b_scenario s LEFT JOIN t ON t.scenario_id = s.scenario_id LEFT JOIN b_action a ON a.step_id = t.step_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, step_no ORDER BY action_id NULLS FIRST, action NULLS FIRST) AS action_no FROM r)
    SELECT scenario_id, CASE WHEN coalesce(step_no, 1) = 1 AND action_no = 1 THEN scenario END AS scenario, CASE WHEN action_no = 1 THEN step_no END AS step_no, CASE WHEN action_no = 1 THEN step END AS step,
        coalesce(step_no, 0) AS step_pos, action_no, CASE WHEN step_no IS NULL THEN '(no steps)' WHEN action IS NULL THEN '(no actions)' ELSE action END AS action
    FROM n
""")(lambda t: spec.plain_rows(t.b_scenario, t.b_step, t.b_action))

_O1, _O2 = "CASE WHEN step_id % 4 = 0 THEN NULL ELSE CAST(step_id % 5 AS INT) END", "CASE WHEN action_id % 3 = 0 THEN NULL ELSE CAST(action_id % 7 AS INT) END"
query("full_rows", f"""
    WITH t AS (SELECT scenario_id, step_id, step, row_number() OVER (PARTITION BY scenario_id ORDER BY {_O1} NULLS LAST, step_id) AS step_pos, CASE WHEN step_id % 6 = 0 THEN 'step.md' END AS ss FROM b_step),
    a AS (SELECT step_id, action_id, min(action) AS action, row_number() OVER (PARTITION BY step_id ORDER BY min({_O2}) NULLS LAST, action_id) AS action_no, CASE WHEN action_id % 5 = 0 THEN 'action.md' END AS sa FROM b_action GROUP BY 1, 2),
    r AS (SELECT s.scenario_id, CASE WHEN outcome_id % 2 = 0 THEN 'outcome.md' END AS so, t.step_id, step, step_pos, ss, action_id, action, action_no, sa FROM b_scenario s LEFT JOIN t ON t.scenario_id = s.scenario_id LEFT JOIN a ON a.step_id = t.step_id)
    SELECT scenario_id, coalesce(step_pos, 0) AS step_pos, coalesce(action_no, 1) AS action_no, CASE WHEN coalesce(action_no, 1) = 1 THEN step_pos END AS step_no,
        CASE WHEN step_id IS NULL THEN '(no steps)' WHEN coalesce(action_no, 1) = 1 THEN step END AS step, CASE WHEN step_id IS NULL THEN '' WHEN action_id IS NULL THEN '(no actions)' ELSE action END AS action,
        CASE WHEN step_id IS NULL THEN NULL WHEN action_id IS NULL THEN ss ELSE coalesce(sa, ss, so) END AS source
    FROM r
""")(
    lambda t: spec.full_rows(
        t.b_scenario.selectExpr("scenario_id", "IF(outcome_id % 2 = 0, array('outcome.md'), array()) AS outcome_citations"),
        t.b_step.selectExpr("scenario_id", "step_id", "step", f"{_O1} AS `order`", "IF(step_id % 6 = 0, array('step.md', 'z'), CAST(array() AS ARRAY<STRING>)) AS citations"),
        t.b_action.groupBy("step_id", "action_id").agg(F.min("action").alias("action")).selectExpr("step_id", "action_id", "action", f"{_O2} AS `order`", "IF(action_id % 5 = 0, array('action.md'), NULL) AS citations"),
    )
)
query("sort_by_order", f"SELECT step_id, {_O1} AS \"order\" FROM b_step")(lambda t: spec.sort_by_order(t.b_step.selectExpr("step_id", f"{_O1} AS `order`"), "step_id"))

query("rebuild_outcome_detail", """
    WITH a AS (SELECT step_id, count(*) AS n, min(action) AS first FROM b_action GROUP BY 1),
    t AS (SELECT scenario_id, count(*) AS steps, sum(coalesce(n, 0)) AS actions, min(first) AS first FROM b_step LEFT JOIN a USING (step_id) GROUP BY 1)
    SELECT outcome_id, scenario_id, description, coalesce(steps, 0) AS steps, CAST(coalesce(actions, 0) AS BIGINT) AS actions, first FROM b_scenario LEFT JOIN t USING (scenario_id)
""")(
    lambda t: exports.rebuild_outcome_detail(t.b_scenario, t.b_step, t.b_action).selectExpr(
        "outcome_id", "scenario_id", "description", "CAST(size(steps) AS BIGINT) AS steps", "CAST(aggregate(steps, 0, (n, s) -> n + coalesce(size(s.actions), 0)) AS BIGINT) AS actions",
        "array_min(flatten(transform(filter(steps, s -> s.actions IS NOT NULL), s -> s.actions.action))) AS first",
    )
)
query("outcome_manifest", "SELECT outcome_id, outcome, persona FROM b_outcome_all JOIN b_persona USING (persona_id)")(lambda t: exports.outcome_manifest(t.b_outcome_all, t.b_persona))

_JSON = """CASE id % 4 WHEN 0 THEN '{"Page": [{"id": "' || CAST(id AS STRING) || '", "name": "n"}], "Flow": []}' WHEN 1 THEN '{"nodes": [{"type": "Flow", "id": "' || CAST(id AS STRING) || '"}, {"label": "Other", "id": "x"}]}'
    WHEN 2 THEN '[{"label": "Component", "type": "Page", "id": "' || CAST(id AS STRING) || '"}]' ELSE 'no json' END AS value"""
query("nodes_by_label", """
    SELECT 'Page' AS label, CAST(id AS STRING) AS id, 'n' AS name FROM b_page WHERE id % 4 = 0 UNION ALL SELECT 'Flow', CAST(id AS STRING), NULL FROM b_page WHERE id % 4 = 1 UNION ALL SELECT 'Component', CAST(id AS STRING), NULL FROM b_page WHERE id % 4 = 2
""")(lambda t: exports.nodes_by_label(t.b_page.selectExpr(_JSON), ["UserJourney", "Flow", "Page", "Component"]))


def _exported(t):
    """A graph document for each scenario, as an export has it, with its steps in the order of their ids."""
    steps = t.b_step.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("step_id", "step"))).alias("s"))
    rows = t.b_scenario.join(steps, "scenario_id", "left").join(t.b_outcome.select("outcome_id", "outcome", "persona_id"), "outcome_id").join(t.b_persona, "persona_id")
    return rows.selectExpr(
        "array(named_struct('id', CAST(persona_id AS STRING), 'persona', persona, 'outcomes', array(named_struct('id', CAST(outcome_id AS STRING), 'outcome', outcome, 'platform', '', 'description', '', 'scenarios', "
        "array(named_struct('id', CAST(scenario_id AS STRING), 'scenario', scenario, 'description', description, 'steps', transform(coalesce(s, array()), x -> named_struct('id', CAST(x.step_id AS STRING), 'step', x.step, "
        "'actions', array(named_struct('id', concat('a', x.step_id), 'action', 'Do', 'description', '', 'apis', array(named_struct('type', 'REST', 'method', 'GET', 'url', '/x')))))))))))) AS personas"
    )


query("flatten_functional", f"""
    SELECT persona, {SYS} AS is_system, outcome, scenario, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY step_id) AS INTEGER) AS "order", CAST(step_id AS STRING) AS step_id, step
    FROM b_step JOIN b_scenario USING (scenario_id) JOIN b_outcome USING (outcome_id) JOIN b_persona USING (persona_id)
""")(lambda t: exports.flatten_functional(_exported(t))["step"].drop("scenario_id"))


def _written(t, frame, kind: str) -> str:
    """Where rows were written, in a new folder that driver and executors share."""
    import uuid

    path = f"{shared_dir(t.spark)}/{kind}-{uuid.uuid4().hex}"
    frame.write.format(kind).options(timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS").save(path)
    return path


query("read_graph_export", f"""
    SELECT persona, {SYS} AS is_system, outcome, scenario, count(step_id) AS step_count FROM b_scenario LEFT JOIN b_step USING (scenario_id) JOIN b_outcome USING (outcome_id) JOIN b_persona USING (persona_id)
    GROUP BY scenario_id, 1, 2, 3, 4
""")(lambda t: exports.flatten_functional(exports.parse_exports(_exported(t).select(F.to_json(F.array(F.struct(F.to_json(F.struct(F.struct("personas").alias("data"))).alias("text")))).alias("value"))))["scenario"].selectExpr("persona", "is_system", "outcome", "scenario", "CAST(step_count AS BIGINT) AS step_count"))
query("read_jsonl_log", "SELECT ts, 'stage' AS event, CAST(repo_id AS STRING) AS repo, stage FROM b_status_event")(
    lambda t: exports.read_jsonl_log(t.spark, _written(t, t.b_status_event.selectExpr("ts", "'stage' AS event", "CAST(repo_id AS STRING) AS repo", "stage"), "json")).select("ts", "event", "repo", "stage")
)
query("write_report", sql_of("findings_report"))(lambda t: t.spark.read.parquet(_written(t, base.FOUND["findings_report"][0](t), "parquet")))

# Patterns by repository, by their rules: a pattern of one name holds at any depth, one with a slash inside from the root
_FITS = r"""
    f AS (SELECT *, regexp_extract(path, '[^/]*$') AS base, '/' || path AS p FROM b_file),
    m AS (
        SELECT doc_id, position, pattern FROM f JOIN b_pattern USING (repo)
        WHERE CASE position WHEN 1 THEN base LIKE 'f1%.ts' WHEN 2 THEN starts_with(path, repo || '/de/') WHEN 3 THEN base LIKE '%.cs' WHEN 4 THEN starts_with(path, 'fr/app/') WHEN 5 THEN contains(p, '/app/') WHEN 9 THEN contains(p, '/never-there/') ELSE base = pattern END
    ),
    seen AS (
        SELECT doc_id, repo, CASE WHEN NOT regexp_matches(base, '\.(ts|py|cs)$') THEN 'unsupported' WHEN contains(p, '/dist/') OR contains(p, '/tests/') THEN 'built-in' WHEN w.position IS NOT NULL THEN 'own' ELSE 'kept' END AS reason, w.position, w.pattern
        FROM f LEFT JOIN (SELECT doc_id, min(position) AS position, min_by(pattern, position) AS pattern FROM m GROUP BY 1) w USING (doc_id)
    )
"""
_PREVIEW = lambda t: ignores.preview_by_repo(t.b_file.select("doc_id", "repo", "path"), t.b_pattern)
query("preview_ignores_by_repo", f"WITH {_FITS} SELECT doc_id, reason, CASE WHEN reason = 'own' THEN position END AS position, CASE WHEN reason = 'own' THEN pattern END AS pattern FROM seen")(
    lambda t: _PREVIEW(t).select("doc_id", "reason", "position", "pattern")
)
query("pattern_hits_by_repo", f"""
    WITH {_FITS} SELECT b.repo, b.position, b.pattern, count(s.doc_id) AS n FROM b_pattern b LEFT JOIN (SELECT * FROM seen WHERE reason = 'own') s ON s.repo = b.repo AND s.position = b.position GROUP BY 1, 2, 3
""")(lambda t: ignores.hits_by_repo(_PREVIEW(t), t.b_pattern))

# Rules that were checked by their outcome, by the rule itself
query("check_field_coverage", f"""
    WITH t AS (SELECT payload_id, {squeezed('action', 'description')} AS t FROM {PAYLOAD}), f AS (SELECT payload_id, label, code, {squeezed('label')} AS a, {squeezed('code')} AS b FROM b_field)
    SELECT payload_id, label, code FROM f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.payload_id = f.payload_id AND (a <> '' AND contains(t, a) OR b <> '' AND contains(t, b)))
""")(lambda t: gates.check_field_coverage(t.b_field.select("payload_id", "label", "code"), base._payload(t)))
query("check_citation_completeness", """
    SELECT payload_id, path FROM b_read r WHERE NOT EXISTS (SELECT 1 FROM b_cited c WHERE c.payload_id = r.payload_id AND regexp_extract(reference, '[^/]+$') = regexp_extract(path, '[^/]+$'))
""")(lambda t: gates.check_citation_completeness(t.b_read, t.b_cited))
query("check_wrapper", """
    SELECT body_id, missing FROM (SELECT body_id, CASE WHEN payload IS NULL THEN 'payload' WHEN coalesce(trim(project_uuid), '') = '' THEN 'project.uuid' WHEN coalesce(trim(project_name), '') = '' THEN 'project.name' WHEN skip IS NULL THEN 'skipStepAndAction' END AS missing FROM b_body) WHERE missing IS NOT NULL
""")(lambda t: gates.check_wrapper(t.b_body))
query("triage_repos", """
    SELECT key, CASE WHEN archived THEN 'archived' WHEN fork THEN 'fork' WHEN empty THEN 'empty' WHEN pushed_at < DATE '1998-01-01' - INTERVAL 24 MONTH THEN 'stale' ELSE 'keep' END AS suggestion FROM b_repo
""")(lambda t: repos.triage(t.b_repo, "1998-01-01"))
_REPO_URL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z+]+://([^/@]*@)?', ''), '[?#].*$', ''), '/+$', ''), '\.git$', '')"
query("adopt_existing", f"""
    WITH p AS (SELECT {_REPO_URL} AS u, branch, min(project_id) AS adopted FROM b_project GROUP BY 1, 2), n AS (SELECT DISTINCT lower(name) AS ln FROM b_project), r AS (SELECT key, lower(name) AS ln, {_REPO_URL} AS u, branch FROM b_repo)
    SELECT key, CASE WHEN adopted IS NOT NULL THEN 'adopt' WHEN n.ln IS NOT NULL THEN 'name-conflict' ELSE 'connect' END AS action, adopted FROM r LEFT JOIN p USING (u, branch) LEFT JOIN n USING (ln)
""")(lambda t: repos.adopt_existing(t.b_repo, t.b_project))
query("supporting_layer_hop", """
    SELECT id, layer FROM b_layer WHERE layer IN ('DataLake', 'EventQueue', 'Observability', 'Infrastructure') AND id IN (SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0)
""")(lambda t: search.supporting_hop(t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("id")), t.lineitem.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")), t.b_layer, ["DataLake", "EventQueue", "Observability", "Infrastructure"]))
query("reference_sweep", """
    SELECT DISTINCT file FROM b_reference WHERE contains(lower(text), 'orderline') OR contains(lower(text), 'order_line') OR contains(lower(text), 'order-line')
""")(lambda t: search.reference_sweep([t.b_reference], "orderLine"))
_STORES = """
    SELECT store, CASE WHEN read_only AND needs_ddl THEN 'blocking' WHEN needs_ddl THEN 'writable' ELSE 'confirmed' END AS tier FROM b_store WHERE NOT (hits < 3 AND score_min >= 0.40 AND score_max <= 0.45)
"""
query("classify_stores", _STORES)(lambda t: search.classify_stores(t.b_store))
query("store_verdict", f"SELECT CASE max(CASE tier WHEN 'blocking' THEN 2 WHEN 'writable' THEN 1 ELSE 0 END) WHEN 2 THEN 'BLOCKING' WHEN 1 THEN 'WORK' ELSE 'NO DDL' END AS verdict FROM ({_STORES})")(lambda t: search.store_verdict(search.classify_stores(t.b_store)))
query("check_api_urls", f"""
    WITH n AS (SELECT action_id, {_URL_NEEDLE} AS needle FROM b_api)
    SELECT action_id FROM n WHERE needle <> '' AND needle NOT IN (SELECT needle FROM (SELECT DISTINCT needle FROM n WHERE needle <> '') m JOIN b_served ON contains(text, needle))
""")(lambda t: gates.check_api_urls(t.b_api, t.b_served).select("action_id"))
