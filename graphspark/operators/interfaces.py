"""Joins between callers and handlers, and between registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_route
from ..functions.values import INBOUND_VERBS, OUTBOUND_VERBS


def match_calls_to_handlers(api: DataFrame, verbless: list[str] = ()) -> DataFrame:
    """Human REST calls by result. Handlers are reduced to one row a path before the join, so a common path is no hot key."""
    rest = api.where("type = 'REST' AND url IS NOT NULL").withColumns({"path": norm_route("url"), "verb": F.upper(F.coalesce("method", F.lit("GET")))})
    handlers = rest.where("is_system").groupBy("path").agg(F.array_sort(F.collect_set("verb")).alias("verbs"))
    calls = rest.where("NOT is_system").join(handlers, "path", "left")
    result = (
        F.when(F.col("url").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), "external").when(~F.col("url").startswith("/"), "relative-url").when(F.col("verbs").isNull(), "NO HANDLER")
        .when(F.array_contains("verbs", F.col("verb")), "matched").when(F.col("path").isin(list(verbless)), "verb-agnostic").otherwise("method-mismatch")
    )
    return calls.select("action_id", "path", "verb", F.array_join("verbs", ",").alias("handler_verbs"), result.alias("result"))


def call_match_summary(matched: DataFrame) -> DataFrame:
    return matched.groupBy("result").agg(F.count("*").alias("n"))


def uncalled_handlers(api: DataFrame) -> DataFrame:
    rest = api.where("type = 'REST' AND url IS NOT NULL").withColumns({"path": norm_route("url"), "verb": F.upper(F.coalesce("method", F.lit("GET")))})
    called = rest.where("NOT is_system AND url LIKE '/%'").select("path")
    return rest.where("is_system").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("verb")), ",").alias("verbs")).join(called, "path", "left_anti")


def direction(action: str = "action", is_system: str = "is_system") -> Column:
    """Inbound or outbound by the verb of a system's action; a human's call is outbound; effects inside a system are neither (null)."""
    verb = F.lower(F.regexp_extract(F.trim(F.col(action)), r"^([A-Za-z]+)", 1))
    return F.when(~F.col(is_system), "outbound").when(verb.isin(INBOUND_VERBS), "inbound").when(verb.isin(OUTBOUND_VERBS), "outbound")


def interface_quadrants(api: DataFrame) -> DataFrame:
    """Interfaces (type, url, is_system, action) reconciled over all personas by type and route: callers and handlers, and who calls. Both sides are counted before they meet."""
    rows = api.where("url IS NOT NULL").select("type", norm_route("url").alias("path"), "is_system", direction().alias("direction")).where("direction IS NOT NULL")
    n = lambda c: F.sum(c.cast("long"))
    out, into = F.col("direction") == "outbound", F.col("direction") == "inbound"
    both = rows.groupBy("type", "path").agg(n(out).alias("n_outbound"), n(into).alias("n_inbound"), F.bool_or(out & ~F.col("is_system")).alias("human"))
    kind = F.when(F.col("n_outbound") == 0, "dangling-inbound").when(F.col("n_inbound") == 0, "dangling-outbound").when(F.col("human"), "human-system").otherwise("system-system")
    return both.select("type", "path", "n_outbound", "n_inbound", kind.alias("kind"))


def crosscheck(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys by side: both, left_only or right_only, with counts."""
    n = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c))
    both = n(left, "n_left").join(n(right, "n_right"), key, "full_outer")
    return both.select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"), F.when(F.col("n_right").isNull(), "left_only").when(F.col("n_left").isNull(), "right_only").otherwise("both").alias("side"))


def orphan_handler_files(files: DataFrame, owners: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.col("path").rlike(pattern)).join(owners.select("path"), "path", "left_anti").select("path")


def journey_map(transitions: DataFrame) -> DataFrame:
    """(from_app, to_app) with counts; an unresolved target is null and a row of its own."""
    return transitions.groupBy("from_app", "to_app").agg(F.count("*").alias("n"), F.max(F.col("to_app").isNotNull()).alias("resolved"))


def compare_registries(left: DataFrame, right: DataFrame, equivalence: DataFrame) -> DataFrame:
    """(name, type) tables; left names go through (name, as_name), and a row remains for each original left name."""
    renamed = left.join(equivalence, "name", "left").select(F.col("name").alias("left_name"), F.coalesce("as_name", "name").alias("key"), F.col("type").alias("left_type"), F.col("as_name").isNotNull().alias("via_equivalence"))
    both = renamed.join(right.select(F.col("name").alias("key"), F.lit(1).alias("r"), F.col("type").alias("right_type")), "key", "full_outer")
    side = F.when(F.col("r").isNull(), "left_only").when(F.col("left_name").isNull(), "right_only").otherwise("matched")
    return both.select("key", "left_name", "left_type", "right_type", F.coalesce("via_equivalence", F.lit(False)).alias("via_equivalence"), side.alias("side"))


_LEVEL = {"ATOM": 0, "MOLECULE": 1, "ORGANISM": 2, "TEMPLATE": 3}


def component_type_drift(compared: DataFrame) -> DataFrame:
    level = F.create_map(*[F.lit(x) for kv in _LEVEL.items() for x in kv])
    low, high = F.least(level[F.col("left_type")], level[F.col("right_type")]), F.greatest(level[F.col("left_type")], level[F.col("right_type")])
    severity = F.when((low == 2) & (high == 3), "LOW").when(high - low == 1, "MEDIUM").otherwise("HIGH")
    return compared.where("side = 'matched' AND left_type <> right_type").select("key", "left_type", "right_type", severity.alias("severity"))


def children_drift(left: DataFrame, right: DataFrame, equivalence: DataFrame | None = None) -> DataFrame:
    """From (key, child) of both sides: numbers of children on the left only, right only and both, by key of both sides. Children of the left go through ``equivalence`` (name, as_name) first, as names do."""
    if equivalence is not None:
        same = equivalence.groupBy(F.col("name").alias("child")).agg(F.min("as_name").alias("as_name"))
        left = left.join(same, "child", "left").select("key", F.coalesce("as_name", "child").alias("child"))
    both = left.distinct().withColumn("l", F.lit(1)).join(right.distinct().withColumn("r", F.lit(1)), ["key", "child"], "full_outer")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rows = both.groupBy("key").agg(n(F.col("r").isNull()).alias("left_only"), n(F.col("l").isNull()).alias("right_only"), n(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"), F.count("l").alias("nl"), F.count("r").alias("nr"))
    return rows.where("nl > 0 AND nr > 0").drop("nl", "nr")


def registry_health(compared: DataFrame, drift: DataFrame) -> DataFrame:
    names = compared.agg(F.count("*").alias("names"), F.sum(F.when(F.col("side") == "matched", 1).otherwise(0)).alias("matched"), F.sum(F.when((F.col("side") == "matched") & (F.col("left_type") == F.col("right_type")), 1).otherwise(0)).alias("typed"))
    kids = drift.agg(F.count("*").alias("k"), F.sum(F.when((F.col("left_only") == 0) & (F.col("right_only") == 0), 1).otherwise(0)).alias("aligned"))
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    rows = names.join(kids).select(share("matched", "names").alias("a"), share("typed", "matched").alias("b"), share("aligned", "k").alias("c"))
    return rows.select(F.round("a", 4).alias("name_presence"), F.round("b", 4).alias("type_alignment"), F.round("c", 4).alias("children_alignment"), F.round((F.col("a") + F.col("b") + F.col("c")) / 3, 4).alias("overall"))
