"""Table maintenance: upserts by name, deletes with orphans, registries and schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import cut
from ..functions.text import name_key, platform_key
from ..functions.values import FLAGGED_RESOURCES, RESOURCE_LAYERS


def merge_outcomes(existing: DataFrame, payload: DataFrame, by_platform: bool = True) -> DataFrame:
    """Upsert of (persona_id, outcome, platform, description): the later value that isn't null wins. Same result when run again."""
    keys = ["persona_id", "k", *(["p"] if by_platform else [])]
    keyed = lambda df, seq: df.select("persona_id", name_key("outcome").alias("k"), platform_key("platform").alias("p"), "outcome", "platform", "description", F.lit(seq).alias("seq"))
    rows = keyed(existing, 0).unionByName(keyed(payload, 1))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias(c)
    merged = rows.groupBy(*keys).agg(F.min_by("outcome", F.struct("seq", "outcome")).alias("outcome"), newest("platform"), newest("description"), (F.min("seq") == 1).alias("is_new"))
    return merged.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]), 256).alias("key_id"), "persona_id", "outcome", "platform", "description", "is_new")


#: Levels of the functional tree from the top; the platform is part of an outcome's identity.
TREE = ["persona", "outcome", "scenario", "step", "action"]


def merge_tree(existing: dict[str, DataFrame], payload: dict[str, DataFrame], by_platform: bool = True) -> DataFrame:
    """(level, path, key_id, name, description, citations, apis, is_new) of two functional trees merged by name at every level under its parent.

    A side has a table for each level: ``<level>_id``, ``<parent>_id``, the name in a column named like the level, and if it has them
    ``description``, ``platform`` (outcomes), and the arrays ``citations`` and ``apis`` (of strings). The later value that isn't null
    wins, citations and apis are united, and a node's id is the hash of the names above it and its own, so that a second run changes
    nothing. The name that stood there first stays.
    """
    nodes, schema = None, {"description": "string", "citations": "array<string>", "apis": "array<string>"}
    for seq, side in enumerate((existing, payload)):
        paths = None
        for depth, level in enumerate(TREE):
            if level not in side:
                break
            rows, above = side[level], [f"{TREE[depth - 1]}_id"] if depth else []
            parts = [level, *(["platform"] if level == "outcome" and by_platform and "platform" in rows.columns else [])]
            extra = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()]
            rows = rows.select(f"{level}_id", *above, *parts, *extra)
            if depth:
                rows = rows.join(paths, above)
            # Keys are made after the join: of the rows that stay alone, and not moved with them.
            own = F.concat_ws("|", *[_escaped(key(c)) for c, key in zip(parts, (name_key, platform_key))])
            rows = rows.withColumn("path", F.concat_ws(" > ", "above", own) if depth else own).withColumnRenamed(level, "name")
            paths = rows.select(f"{level}_id", F.col("path").alias("above"))
            part = rows.select(F.lit(level).alias("level"), "path", "name", *schema, F.lit(seq).alias("seq"))
            nodes = part if nodes is None else nodes.unionByName(part)
    # The smallest and largest of (side, value) hold a value once, where min_by and max_by would hold it twice.
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c)
    first = F.min(F.struct("seq", "name"))
    # Arrays by distinct items: a node with many copies never holds more than its own.
    items = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>")))))).alias(c)
    # Rows are sorted to be summed: a hash in front tells paths apart, which begin alike for most of their length.
    merged = nodes.groupBy(F.xxhash64("level", "path").alias("h"), "level", "path").agg(first["name"].alias("name"), last("description"), items("citations"), items("apis"), (first["seq"] == 1).alias("is_new"))
    return merged.select("level", "path", F.sha2("path", 256).alias("key_id"), "name", "description", "citations", "apis", "is_new")


def _escaped(key: Column) -> Column:
    """Signs that part names have a backslash before them inside a name."""
    for sign in ("\\", "|", ">"):
        key = F.replace(key, F.lit(sign), F.lit("\\" + sign))
    return key


def merge_design(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, platform, seq) of existing and payload together, and (child, parent) links: nodes by lower name and platform, links appended and distinct. Ids become the smallest of the merged."""
    keyed = nodes.withColumns({"k": F.lower(F.trim("name")), "p": platform_key("platform")})
    merged = keyed.groupBy("k", "p").agg(F.min("id").alias("kept"), F.max_by("name", "seq").alias("name"))
    mapping = keyed.join(merged, ["k", "p"]).select("id", "kept")
    moved = links.join(mapping.toDF("child", "kept"), "child").select(F.col("kept").alias("id"), "parent").distinct()
    return merged.select(F.col("kept").alias("id"), "name", F.col("p").alias("platform")), moved


#: Levels of the design graph from the top.
DESIGN = ["journey", "flow", "page", "component"]


def design_mapping(nodes: DataFrame) -> DataFrame:
    """(label, id, kept) of (label, id, name, platform, scenario_id, seq): which node each one is merged into, the one with the smallest id.

    Journeys are one for each scenario; those without a scenario are one with a journey of their name that has one, else with each other. All other
    nodes are one for each lower name and platform within their label.
    """
    rows = nodes.select("label", "id", F.lower(F.trim("name")).alias("k"), platform_key("platform").alias("p"), F.when(F.col("label") == "journey", F.col("scenario_id")).alias("s")).distinct()
    of_scenario = rows.where("label = 'journey' AND s IS NOT NULL")
    first = of_scenario.groupBy("s").agg(F.min("id").alias("kept"))
    by_scenario = of_scenario.join(first, "s").select("label", "id", "k", "kept")
    by_name = by_scenario.groupBy("k").agg(F.min("kept").alias("known"))
    rest = rows.where("label = 'journey' AND s IS NULL")
    alone = rest.groupBy("k").agg(F.min("id").alias("own"))
    named = rest.join(alone, "k").join(by_name, "k", "left").select("label", "id", F.coalesce("known", "own").alias("kept"))
    others = rows.where("label <> 'journey'")
    same = others.groupBy("label", "k", "p").agg(F.min("id").alias("kept"))
    return by_scenario.select("label", "id", "kept").unionByName(named).unionByName(others.join(same, ["label", "k", "p"]).select("label", "id", "kept"))


def merge_design_graph(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged nodes (label, id, name, platform, scenario_id, parent_ids) and links (label, child, parent) of existing and payload together.

    ``links`` has the child's label. Both ends move to the merged nodes, new parents are appended, and the arrays are built from the
    distinct links at the end; the later name stays. Running it again on its own result changes nothing.
    """
    above = F.create_map(*[F.lit(x) for low, high in zip(DESIGN[1:], DESIGN) for x in (low, high)])
    mapping = cut(design_mapping(nodes))  # it is asked for both ends of the links and for the nodes
    child, parent = mapping.toDF("label", "child", "new_child"), mapping.toDF("parent_label", "parent", "new_parent")
    moved = links.withColumn("parent_label", above[F.col("label")]).join(child, ["label", "child"]).join(parent, ["parent_label", "parent"], "left")
    moved = moved.select("label", F.col("new_child").alias("child"), F.coalesce("new_parent", "parent").alias("parent")).distinct()
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias(c)
    merged = nodes.join(mapping, ["label", "id"]).groupBy("label", F.col("kept").alias("id")).agg(newest("name"), newest("platform"), newest("scenario_id"))
    return merged.join(parent_arrays(moved).withColumnRenamed("child", "id"), ["label", "id"], "left").withColumn("parent_ids", F.coalesce("parent_ids", F.array().cast(f"array<{dict(links.dtypes)['parent']}>"))), moved


def parent_arrays(links: DataFrame) -> DataFrame:
    """(label, child, parent_ids): the sorted distinct parents of each child; a child holds no more than its own."""
    return links.groupBy("label", "child").agg(F.array_sort(F.collect_set("parent")).alias("parent_ids"))


def delete_with_orphan_cleanup(roots: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """What is deleted level by level: children all of whose parents go. ``roots`` has column id, ``levels`` have (child, parent)."""
    gone, out = roots.select("id"), []
    for links in levels:
        state = links.distinct().join(gone.select(F.col("id").alias("parent"), F.lit(1).alias("g")), "parent", "left").groupBy("child").agg(F.count("*").alias("n"), F.count("g").alias("g"))
        gone = state.where("n = g").select(F.col("child").alias("id"))
        out.append(gone)
    return out


def delete_design(roots: DataFrame, links: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Deleted nodes (label, id), the roots' children all of whose parents go and so on down, and what is left of the links (label, child, parent): none of a deleted node, on either end."""
    by_level = [links.where(F.col("label") == label).select("child", "parent") for label in labels]
    gone = delete_with_orphan_cleanup(roots, by_level)
    deleted, kept, above = None, None, roots.select("id")
    for label, own, dead in zip(labels, by_level, gone):
        rows = dead.select(F.lit(label).alias("label"), "id")
        rest = own.distinct().join(above.select(F.col("id").alias("parent")).distinct(), "parent", "left_anti").join(dead.select(F.col("id").alias("child")), "child", "left_anti").select(F.lit(label).alias("label"), "child", "parent")
        deleted, kept, above = (rows, rest, dead) if deleted is None else (deleted.union(rows), kept.union(rest), dead)
    return deleted, kept


def merge_batches(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    first = F.min(F.struct(*order, *[c for c in rows.columns if c not in keys and c not in order])).alias("r")
    return rows.groupBy(*keys).agg(first).select(*keys, "r.*")


def widen_scope(observations: DataFrame) -> DataFrame:
    """(type, name, feature, app, shared, uses): PAGE, DOMAIN or GLOBAL, and all that the component was seen to use (a row or a null each)."""
    uses = F.array_sort(F.collect_set("uses")) if "uses" in observations.columns else F.array().cast("array<string>")
    per = observations.groupBy("type", "name").agg(F.count_distinct("feature").alias("features"), F.count_distinct("app").alias("apps"), F.bool_or("shared").alias("shared"), uses.alias("supporting"))
    scope = F.when((F.col("features") >= 3) | (F.col("apps") >= 2) | F.col("shared"), "GLOBAL").when(F.col("features") == 2, "DOMAIN").otherwise("PAGE")
    return per.withColumn("scope", scope)


_CHILDREN = {"MOLECULE": ["ATOM"], "ORGANISM": ["MOLECULE", "ATOM"], "TEMPLATE": ["ORGANISM"]}


def validate_registry(components: DataFrame, uses: DataFrame) -> DataFrame:
    """Components (name, type) and (name, child): too few children, unknown children, atoms with children, children of a wrong level."""
    typed = components.groupBy("name").agg(F.min("type").alias("type"))
    counts = typed.join(uses.groupBy("name").agg(F.count("*").alias("n")), "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = counts.where("type <> 'ATOM' AND n < 2").select("name", F.lit("too_few").alias("issue")).union(counts.where("type = 'ATOM' AND n > 0").select("name", F.lit("atom_with_children").alias("issue")))
    kids = uses.join(typed, "name").join(typed.toDF("child", "child_type"), "child", "left")
    allowed = F.lit(False)
    for t, c in _CHILDREN.items():
        allowed = allowed | ((F.col("type") == t) & F.col("child_type").isin(c))
    bad = kids.select("name", F.when(F.col("child_type").isNull(), "unknown_child").when(F.col("type").isin(list(_CHILDREN)) & ~allowed, "child_level").alias("issue")).where("issue IS NOT NULL").distinct()
    return size.union(bad)


#: Fields of an architecture row by the order in which sources are believed.
ARCH_FIELDS = {"name": "doc iac code", "description": "doc iac code", "domain": "doc iac code", "technology": "iac code doc", "region": "iac code doc", "deployment": "iac code doc"}


def merge_architecture(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components merged from doc, iac and code, and what their sources disagree on.

    ``rows`` has layer, name, source and any of description, domain (an array), technology, region, deployment. Each value is a row
    (field, value, source) of its own; all fields go through one shuffle. The first result has a row a component: each field from the
    source that is believed first, ``domains`` (all sources' together) and ``origin``. The second has a row for each value of a field on
    which sources differ (layer, k, field, value, sources, chosen).
    """
    there = [f for f in ARCH_FIELDS if f in rows.columns]
    text = lambda f: F.array_join(F.array_sort(F.array_distinct(f)), ",") if dict(rows.dtypes)[f].startswith("array") else F.col(f).cast("string")
    rank = lambda f: F.array_position(F.array(*map(F.lit, ARCH_FIELDS[f].split())), F.col("source"))
    values = F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("value"), rank(f).alias("rank")) for f in there])
    long = rows.select("layer", F.lower("name").alias("k"), "source", F.explode(values).alias("v")).select("layer", "k", "source", "v.*").where("value IS NOT NULL AND value <> ''")
    each = long.groupBy("layer", "k", "field", "value").agg(F.min("rank").alias("rank"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    best = each.groupBy("layer", "k", "field").agg(F.min_by("value", F.struct("rank", "value")).alias("best"), F.count("*").alias("n"))
    differ = each.join(best.where("n > 1"), ["layer", "k", "field"]).select("layer", "k", "field", "value", "sources", (F.col("value") == F.col("best")).alias("chosen"))
    wide = best.groupBy("layer", "k").agg(*[F.max(F.when(F.col("field") == f, F.col("best"))).alias(f) for f in there])
    has = lambda s: F.bool_or(F.col("source") == s)
    origin = F.when(has("doc"), "documented").when(has("code"), "code-discovered").otherwise("iac-discovered")
    found = rows.groupBy("layer", F.lower("name").alias("k")).agg(origin.alias("origin"))
    if "domain" in there:
        all_of = rows.select("layer", F.lower("name").alias("k"), F.explode("domain").alias("d")).groupBy("layer", "k").agg(F.array_join(F.array_sort(F.collect_set("d")), ",").alias("domains"))
        found = found.join(all_of, ["layer", "k"], "left")
    return wide.join(found, ["layer", "k"], "right").drop("k"), differ


def resource_table(spark) -> DataFrame:
    """(prefix, suffix, layer, look) of the known resource types; a fixed table."""
    rows = [(*(t.split("*") if "*" in t else (t, "")), layer, look) for table, look in ((RESOURCE_LAYERS, False), (FLAGGED_RESOURCES, True)) for layer, types in table.items() for t in types.split()]
    return spark.createDataFrame(rows, "prefix string, suffix string, layer string, look boolean")


def classify_resources(resources: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(id, rtype) by the longest known beginning (and ending, if the type has one); unknown types, and those to be looked at, are flagged. A type meets the table by an equi-join on its own beginnings."""
    table = resource_table(resources.sparkSession) if table is None else table
    types = resources.select("rtype").distinct()
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("rtype"), F.lit(1))), lambda n: F.substring(F.col("rtype"), F.lit(1), n)))
    met = types.withColumn("prefix", F.explode(heads)).join(table, "prefix").where(F.col("rtype").endswith(F.col("suffix")))
    best = met.groupBy("rtype").agg(F.max_by(F.struct("layer", "look"), F.struct(F.length("prefix") + F.length("suffix"), "prefix", "suffix")).alias("m")).select("rtype", "m.layer", "m.look")
    return resources.join(best, "rtype", "left").select("id", "rtype", "layer", (F.col("layer").isNull() | F.col("look")).alias("flagged"))


LAYERS = ["UserExperience", "ApiGateway", "Services", "Agents", "DataLake", "EventQueue", "ObservabilityMonitoring", "Infrastructure"]


def layer_inventory(nodes: DataFrame) -> DataFrame:
    layers = nodes.sparkSession.createDataFrame([(x,) for x in LAYERS], "layer string")
    return layers.join(nodes.groupBy("layer").agg(F.count("*").alias("n")), "layer", "left").select("layer", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("empty"))


def layer_boundaries(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links (source, target) that cross a layer boundary: user experience straight to storage, or services back to user experience."""
    side = lambda end, layers: nodes.where(F.col("layer").isin(layers)).select(F.col("id").alias(end), F.col("layer").alias(f"{end}_layer"))
    rows = links.select("source", "target").distinct().join(side("source", ["UserExperience", "Services"]), "source").join(side("target", ["DataLake", "UserExperience"]), "target")
    issue = F.when((F.col("source_layer") == "UserExperience") & (F.col("target_layer") == "DataLake"), "direct_storage_call")
    issue = issue.when((F.col("source_layer") == "Services") & (F.col("target_layer") == "UserExperience"), "reverse_flow")
    return rows.select("source", "target", issue.alias("issue")).where("issue IS NOT NULL")


def derive_schema_fields(columns: DataFrame, constraints: DataFrame, indexes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """columns (table_id, name), constraints (table_id, kind, columns, ref_table), indexes (table_id, columns): table facts, column facts, and foreign-key edges, set-based."""
    keys = constraints.select("table_id", "kind", F.explode("columns").alias("name")).distinct()
    foreign, indexed = keys.where("kind = 'FK'").select("table_id", "name", F.lit(True).alias("is_foreign_key")), indexes.select("table_id", F.explode("columns").alias("name")).distinct().withColumn("is_indexed", F.lit(True))
    facts = columns.join(foreign, ["table_id", "name"], "left").join(indexed, ["table_id", "name"], "left").select("table_id", "name", F.coalesce("is_foreign_key", F.lit(False)).alias("is_foreign_key"), F.coalesce("is_indexed", F.lit(False)).alias("is_indexed"))
    primary = constraints.where("kind = 'PK'").select("table_id").distinct().withColumn("has_primary_key", F.lit(True))
    tables = columns.groupBy("table_id").agg(F.count("*").alias("column_count")).join(primary, "table_id", "left").withColumn("has_primary_key", F.coalesce("has_primary_key", F.lit(False)))
    return tables, facts, constraints.where("kind = 'FK'").select("table_id", "ref_table").distinct()

