"""Row-level gates of functional payloads. Input: action rows (payload_id, persona, action_id, action, description, has_api, url, cited) and audit
tables by payload_id; output: one row for each violation, with ``check`` and ``detail``. Without aggregation they also run on streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.find import hits
from ..functions.scale import cut
from ..functions.text import is_system, route_needle, route_token, url_needle, word_pattern
from ..functions.values import FORBIDDEN_NODE_PERSONAS, FORBIDDEN_PERSONA_NAMES, FORBIDDEN_UI_WORDS, IDENTIFIER_PATTERNS, INPUT_VERBS, NETWORK_VERBS, SIDE_EFFECT_VERBS, TECHNICAL_OUTCOMES, WIDGET_PATTERNS


def verb(action: str = "action") -> Column:
    return F.lower(F.regexp_extract(F.trim(action), r"^(\S+)", 1))


def _violation(rows: DataFrame, check: str, detail) -> DataFrame:
    return rows.select("payload_id", F.lit(check).alias("check"), "action_id", detail.alias("detail"))


#: The levels of a payload: the array, and the name of an item; what a level must have besides its name is in ``_faults``.
_LEVELS = [("personas", "persona"), ("outcomes", "outcome"), ("scenarios", "scenario"), ("steps", "step"), ("actions", "action")]
_REFERENCE = r"^[A-Za-z0-9_.\-]+/"


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _size(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _faults(items: Column, kind: T.DataType, depth: int) -> Column:
    """Names of what is missing in an array of items of a level, and in all below it. Fields that the rows' type doesn't have are not asked for."""
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        return F.array().cast("array<string>")
    has, name = {f.name: f.dataType for f in kind.elementType.fields}, _LEVELS[depth][1]
    below = _LEVELS[depth + 1][0] if depth + 1 < len(_LEVELS) else None

    def of(x: Column) -> Column:
        empty = (_size(x[below]) < 1) if below in has else F.lit(False)
        found = [F.when(_blank(x[name]) if name == "persona" else _blank(x[name]) | empty, F.lit(name))]
        if name == "persona":
            found.append(F.when(empty, F.lit(below)))
        if name == "scenario" and "description" in has:
            found.append(F.when(_blank(x["description"]), F.lit("scenario.description")))
        if "citations" in has:
            found.append(F.when(F.coalesce(F.exists(x["citations"], lambda c: F.coalesce(c["type"] != "code", F.lit(True)) | _blank(c["name"]) | ~F.coalesce(c["reference"].rlike(_REFERENCE), F.lit(False))), F.lit(False)), F.lit("citation")))
        if "apis" in has:
            found.append(F.when(F.coalesce(F.exists(x["apis"], lambda a: _blank(a["type"]) | a["method"].isNull() | a["url"].isNull() | a["request"].isNull() | a["response"].isNull()), F.lit(False)), F.lit("api")))
        own = F.filter(F.array(*found), lambda f: f.isNotNull())
        return F.concat(own, _faults(x[below], has[below], depth + 1)) if below in has else own

    return F.coalesce(F.flatten(F.transform(items, of)), F.array().cast("array<string>"))


def check_schema(payloads: DataFrame) -> DataFrame:
    """Nested payloads (payload_id, personas array<struct<persona, outcomes array<struct<...>>>>, down to actions, citations and apis): what is missing, once each."""
    kind = payloads.schema["personas"].dataType
    details = F.array_distinct(F.concat(F.filter(F.array(F.when(_size(F.col("personas")) != 1, F.lit("personas"))), lambda x: x.isNotNull()), _faults(F.col("personas"), kind, 0)))
    return payloads.select("payload_id", F.explode(details).alias("detail")).select("payload_id", F.lit("schema").alias("check"), "detail")


def check_rule_a(actions: DataFrame) -> DataFrame:
    """Actions that begin with a network verb (human) or a side-effect verb (System) have an api; a System one may name a data store instead."""
    store = F.lit(False)
    for p in IDENTIFIER_PATTERNS:
        store = store | F.coalesce(F.col("description").rlike(p), F.lit(False))
    sys = is_system("persona")
    bad = ~F.col("has_api") & ((~sys & verb().isin(NETWORK_VERBS)) | (sys & verb().isin(SIDE_EFFECT_VERBS) & ~store))
    return _violation(actions.where(bad), "rule_a", verb())


def check_forbidden_words(actions: DataFrame) -> DataFrame:
    hits = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("action"), F.lit(word_pattern(FORBIDDEN_UI_WORDS)), 1))), ",")
    return _violation(actions.where(~is_system("persona")).withColumn("h", hits).where("h <> ''"), "forbidden_words", F.col("h"))


def check_persona(payloads: DataFrame, kind: str) -> DataFrame:
    """From (payload_id, persona): exactly one persona, of the kind, and no forbidden word in a human one."""
    per = payloads.groupBy("payload_id").agg(F.count_distinct("persona").alias("n"), F.max(is_system("persona")).alias("sys"), F.max("persona").alias("persona"))
    words = F.array_intersect(F.regexp_extract_all(F.lower("persona"), F.lit("([a-z]+)"), 1), F.array(*map(F.lit, FORBIDDEN_PERSONA_NAMES)))
    wrong_kind = ~F.col("sys") if kind == "system" else F.col("sys")
    issue = F.when(F.col("n") != 1, "not_one").when(wrong_kind, "kind").when(F.lit(kind != "system") & (F.size(words) > 0), "forbidden")
    return per.withColumn("detail", issue).where("detail IS NOT NULL").select("payload_id", F.lit("persona").alias("check"), "detail")


def check_citations(nodes: DataFrame, repo) -> DataFrame:
    """From (payload_id, level, node_id, reference): steps, scenarios and actions need one, personas and outcomes have none, and each starts with the repository."""
    low = F.col("level").isin("scenario", "step", "action")
    issue = F.when(low & F.col("reference").isNull(), "missing").when(~low & F.col("reference").isNotNull(), "not_allowed").when(~F.col("reference").startswith(F.concat(repo, F.lit("/"))), "other_repo")
    return nodes.withColumn("detail", issue).where("detail IS NOT NULL").select("payload_id", F.lit("citations").alias("check"), "level", "node_id", "detail")


def squeezed(*columns: str) -> Column:
    """Texts without white space, in lower case."""
    return F.lower(F.regexp_replace(F.concat(*(F.coalesce(c, F.lit("")) for c in columns)), r"\s+", ""))


def _named(fields: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field) of the fields (payload_id, field, label, code) whose label or code an action's text (with its description) holds: texts are searched once for the words of all payloads, and what is found is joined by payload and word."""
    words = fields.select("payload_id", "field", F.explode(F.array(squeezed("label"), squeezed("code"))).alias("term")).where("term <> ''").distinct()
    texts = actions.select(*keys, squeezed("action", "description").alias("text"))
    return hits(texts, words).join(words, ["payload_id", "term"]).select(*keys, "field").distinct()


def check_field_coverage(fields: DataFrame, actions: DataFrame) -> DataFrame:
    """Declared fields (payload_id, label, code) that no action text of the payload holds (white space removed, lower case)."""
    rows = fields.withColumn("field", F.to_json(F.struct("label", "code")))
    return rows.join(_named(rows, actions, ["payload_id"]), ["payload_id", "field"], "left_anti").select(*fields.columns)


def check_citation_completeness(files: DataFrame, citations: DataFrame) -> DataFrame:
    """Files read (payload_id, path) whose base name no citation of the payload has."""
    base = lambda c: F.regexp_extract(c, "([^/]+)$", 1).alias("base")
    return files.select("payload_id", "path", base("path")).join(citations.select("payload_id", base("reference")), ["payload_id", "base"], "left_anti").select("payload_id", "path")


def check_atomicity(actions: DataFrame, fields: DataFrame) -> DataFrame:
    """Of human payloads: input actions that name more than one editable field (payload_id, label, code, editable) or that have an api, and editable fields that no input action names."""
    human = actions.where(~is_system("persona"))
    inputs = human.where(verb().isin(INPUT_VERBS))
    rows = fields.where("editable").select("payload_id", "label", "code" if "code" in fields.columns else F.lit(None).cast("string").alias("code")).withColumn("field", F.coalesce("code", "label"))
    named = cut(_named(rows, inputs, ["payload_id", "action_id"]))
    clubbed = named.groupBy("payload_id", "action_id").agg(F.count("*").alias("n")).where("n > 1").select("payload_id", F.lit("clubbed").alias("check"), "action_id", F.col("n").cast("string").alias("detail"))
    mine = rows.join(human.select("payload_id").distinct(), "payload_id", "left_semi").select("payload_id", "field").distinct()
    bare = mine.join(named, ["payload_id", "field"], "left_anti").select("payload_id", F.lit("no_action").alias("check"), F.lit(None).cast(dict(actions.dtypes)["action_id"]).alias("action_id"), F.col("field").alias("detail"))
    return clubbed.union(_violation(inputs.where("has_api"), "input_with_api", verb())).union(bare)


def coverage_below(rows: DataFrame, matched: str, least: float = 0.9) -> DataFrame:
    """Per payload: the share of rows with ``matched``, where it is under ``least`` (side effects, widgets)."""
    per = rows.groupBy("payload_id").agg(F.count("*").alias("total"), F.sum(F.col(matched).cast("int")).alias("matched"))
    return per.where(F.col("matched") < least * F.col("total")).withColumn("pct", F.round(100.0 * F.col("matched") / F.col("total"), 1))


def check_widget_coverage(actions: DataFrame, sources: DataFrame, patterns: list[str] = WIDGET_PATTERNS, least: float = 0.9) -> DataFrame:
    """Payloads with fewer actions than ``least`` of the widgets in their sources (payload_id, text): places of each of the patterns."""
    places = reduce(lambda a, b: a + b, (F.regexp_count("text", F.lit(p)) for p in patterns))
    widgets = sources.groupBy("payload_id").agg(F.sum(places).alias("widgets"))
    n = actions.groupBy("payload_id").agg(F.count("*").alias("actions"))
    return widgets.join(n, "payload_id", "left").withColumn("actions", F.coalesce("actions", F.lit(0))).where(F.col("actions") < least * F.col("widgets"))


def check_api_urls(apis: DataFrame, sources: DataFrame) -> DataFrame:
    """Apis whose needle stands in no source text (column text): one pass over the texts for each block of distinct needles."""
    rows = apis.withColumn("needle", url_needle("url")).where("needle <> ''")
    return rows.join(hits(sources.select("text"), rows, term="needle").distinct(), "needle", "left_anti")


def check_path_linked(actions: DataFrame) -> DataFrame:
    """Actions of network or side-effect verbs that name a route: without an api, or with one that doesn't hold the route's needle."""
    rows = actions.where(verb().isin(sorted({*NETWORK_VERBS, *SIDE_EFFECT_VERBS}))).withColumn("token", F.coalesce(F.nullif(route_token("action"), F.lit("")), route_token("description"))).where("token <> ''").withColumn("needle", route_needle("token"))
    issue = F.when(~F.col("has_api"), "no_api").when(~F.coalesce(F.lower("url").contains(F.lower("needle")), F.lit(False)), "other_url")
    return rows.withColumn("detail", issue).where("detail IS NOT NULL").select("payload_id", F.lit("path_linked").alias("check"), "action_id", "detail")


def check_descriptions(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.coalesce(F.trim("description") == "", F.lit(True)))


def check_wrapper(bodies: DataFrame) -> DataFrame:
    """(body_id, payload, project_uuid, project_name, skip): the first part that is missing."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    issue = F.when(F.col("payload").isNull(), "payload").when(blank("project_uuid"), "project.uuid").when(blank("project_name"), "project.name").when(F.col("skip").isNull(), "skipStepAndAction")
    return bodies.withColumn("missing", issue).where("missing IS NOT NULL").select("body_id", "missing")


def check_node(nodes: DataFrame) -> DataFrame:
    """(id, label, name, description, parent_id): first fault of a node. Steps and actions need a name; scenarios, steps and actions a description."""
    below, needs_text = ("Outcome", "Scenario", "Step", "Action"), ("Scenario", "Step", "Action")
    technical = reduce(lambda a, b: a | b, (F.lower("name").contains(p) for p in TECHNICAL_OUTCOMES))
    issue = (
        F.when(~F.col("label").isin("Persona", *below) | F.col("label").isNull(), "label").when(F.col("label").isin(*below) & F.col("parent_id").isNull(), "parent")
        .when(F.col("label").isin("Step", "Action") & F.col("name").isNull(), "name").when(F.col("label").isin(*needs_text) & F.col("description").isNull(), "description")
        .when((F.col("label") == "Persona") & F.lower("name").isin(FORBIDDEN_NODE_PERSONAS), "forbidden_persona").when((F.col("label") == "Outcome") & technical, "technical_outcome")
    )
    return nodes.withColumn("issue", issue).where("issue IS NOT NULL").select("id", "label", "issue")


def row_gates(actions: DataFrame) -> DataFrame:
    """(payload_id, check, action_id, detail): all gates that look at one action alone, without aggregation; they also run on streams."""
    bare = _violation(check_descriptions(actions), "description", F.lit("missing"))
    return check_rule_a(actions).union(check_forbidden_words(actions)).union(check_path_linked(actions).select("payload_id", "check", "action_id", "detail")).union(bare)
