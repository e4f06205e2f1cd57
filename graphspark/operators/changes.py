"""Change sets: what is left out, which workspace owns a file, scopes, and counts.

Paths are relative, with slashes. All prefix rules are equi-joins on a path's own folders, so that they hold for any number of
workspaces, scopes and files, and compare on folder borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import broadcast_if_small, cut
from ..functions.text import gitignore_to_regex
from ..functions.values import BACKEND_FILES, BACKEND_FOLDERS, CHANGE_IGNORES, COMPONENT_FILES, FRONTEND_FILES, FRONTEND_FOLDERS, STYLE_FILES, WORKSPACE_MARKERS, WORKSPACE_SIGNS, WORKSPACE_TYPES


def folder_of(path: str = "path") -> Column:
    """The folder of a file, empty at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def prefixes_of(path: str = "path") -> Column:
    """The path itself and all folders above it, but not the root."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{gitignore_to_regex(p)})" for p in patterns)


def exclude_irrelevant(changes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Changes without configuration, documents, builds, tests and assets; style files stay where a component lies in their folder.

    ``files`` (path) tells where components lie: the whole repository, or else the changes. Null paths are left out.
    """
    named = F.col("path").rlike(_any(CHANGE_IGNORES)) & ~F.col("path").rlike(r"(?:^|/)project\.json$")
    # project.json itself is relevant, but not inside a folder that is left out.
    inside = F.col("path").rlike(_any([p for p in CHANGE_IGNORES if p.endswith("/")]))
    kept = changes.where(~(named | inside)).withColumn("__folder", folder_of())
    plain, style = kept.where(~F.col("path").rlike(_any(STYLE_FILES))), kept.where(F.col("path").rlike(_any(STYLE_FILES)))
    beside = (changes if files is None else files).where(F.col("path").rlike(_any(COMPONENT_FILES))).select(folder_of().alias("__folder")).distinct()
    return plain.union(style.join(beside, "__folder", "left_semi").select(*kept.columns)).drop("__folder")


def workspace_map(files: DataFrame) -> DataFrame:
    """(ws, wtype, framework) of a repository's files (path): folders that hold a marker file, by the rules on their path, else by what lies in them.

    A file belongs to the deepest marked folder above it; signs count for that one alone. The root is no workspace.
    """
    marked = files.where(F.col("path").rlike(_any(WORKSPACE_MARKERS))).select(folder_of().alias("ws")).where("ws <> ''").distinct()
    marked = cut(marked)
    by_path = F.coalesce(*[F.when(F.col("ws").rlike("^" + gitignore_to_regex("/" + pattern)[1:]), F.struct(F.lit(kind).alias("wtype"), F.lit(framework).alias("framework"))) for pattern, kind, framework in WORKSPACE_TYPES])
    signs = files.select("path", F.coalesce(*[F.when(F.col("path").rlike(_any(patterns)), n) for n, (patterns, _, _) in enumerate(WORKSPACE_SIGNS)]).alias("sign")).where("sign IS NOT NULL")
    owned = owner_of(signs, marked.select("ws"))
    first = owned.where("ws IS NOT NULL").groupBy("ws").agg(F.min("sign").alias("sign"))
    by_sign = F.coalesce(*[F.when(F.col("sign") == n, F.struct(F.lit(kind).alias("wtype"), F.lit(framework).alias("framework"))) for n, (_, kind, framework) in enumerate(WORKSPACE_SIGNS)])
    found = marked.join(first, "ws", "left").withColumn("k", F.coalesce(by_path, by_sign, F.struct(F.lit("shared-both").alias("wtype"), F.lit("other").alias("framework"))))
    return found.select("ws", "k.wtype", "k.framework")


def owner_of(files: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``files`` with ``ws``: the longest workspace path that is the file's or one of its folders, null where there is none. One row a distinct path is joined."""
    paths = files.select("path").where("path IS NOT NULL").distinct()
    met = paths.withColumn("ws", F.explode(prefixes_of())).join(broadcast_if_small(workspaces.select(F.trim(F.regexp_replace("ws", "/+$", "")).alias("ws")).distinct()), "ws")
    best = met.groupBy("path").agg(F.max_by("ws", F.length("ws")).alias("ws"))
    return files.join(best, "path", "left")


def guess_type() -> Column:
    """Frontend, backend or irrelevant by a path alone, for repositories without workspaces."""
    frontend = F.col("path").rlike(_any([f"**/{f}/" for f in FRONTEND_FOLDERS])) | F.col("path").rlike(_any(FRONTEND_FILES))
    backend = F.col("path").rlike(_any([f"**/{f}/" for f in BACKEND_FOLDERS])) | F.col("path").rlike(_any(BACKEND_FILES))
    # A file with a backend's ending is one wherever it lies; then folders decide, and endings of views.
    return F.when(F.col("path").rlike(_any(BACKEND_FILES)), "backend").when(frontend, "frontend").when(backend, "backend").otherwise("irrelevant")


def assign_workspace(changes: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``changes`` with ``workspace`` and ``wtype``: the owning workspace's (ws, wtype), else what the path tells."""
    owned = owner_of(changes, workspaces)
    types = workspaces.groupBy(F.trim(F.regexp_replace("ws", "/+$", "")).alias("ws")).agg(F.min("wtype").alias("__wtype"))
    return owned.join(broadcast_if_small(types), "ws", "left").select(*changes.columns, F.col("ws").alias("workspace"), F.coalesce("__wtype", guess_type()).alias("wtype"))


def analysis_passes(assigned: DataFrame) -> DataFrame:
    """A row for each analysis that a change belongs to: frontend, backend, both for what both share; irrelevant files none."""
    passes = F.when(F.col("wtype").isin("frontend", "shared-frontend"), F.array(F.lit("frontend"))).when(F.col("wtype").isin("backend", "shared-backend"), F.array(F.lit("backend"))).when(F.col("wtype") == "shared-both", F.array(F.lit("frontend"), F.lit("backend")))
    return assigned.withColumn("analysis", F.explode(passes))


def scope_filter(changes: DataFrame, scopes: list[str]) -> DataFrame:
    """Changes at or under one of the scopes, by folder; all where no scope is given."""
    wanted = [s.strip("/") for s in scopes if s.strip("/")]
    return changes.where(F.arrays_overlap(prefixes_of(), F.array(*map(F.lit, wanted)))) if wanted else changes


def affected_apps(libraries: DataFrame, deps: DataFrame) -> DataFrame:
    return libraries.select("library").distinct().join(deps, "library").groupBy("library").agg(F.array_join(F.array_sort(F.collect_set("app")), ",").alias("apps"))


def change_breakdown(changes: DataFrame) -> DataFrame:
    """Per workspace and its type: files changed, and those to create, to update and to flag (deleted or renamed)."""
    n = lambda *s: F.sum(F.col("status").isin(*s).cast("int")).alias("x")
    return changes.groupBy("workspace", "wtype").agg(F.count("*").alias("changed"), n("A").alias("to_create"), n("M").alias("to_update"), n("D", "R").alias("to_flag"))
