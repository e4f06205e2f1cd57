"""Repository inventories, ingest status and change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gitignore_to_regex, norm_repo_url
from ..functions.values import DEFAULT_IGNORES, IN_FLIGHT, SUPPORTED_EXTENSIONS, SUPPORTED_LANGUAGES


def display_names(repos: DataFrame) -> DataFrame:
    n = repos.groupBy("name").agg(F.count("*").alias("n"))
    return repos.join(n, "name").select("key", F.when(F.col("n") == 1, F.col("name")).otherwise(F.regexp_replace("key", "/", "__")).alias("display_name"))


def suggestion(as_of: str, months: int = 24):
    stale = F.col("pushed_at") < F.add_months(F.lit(as_of).cast("date"), -months)
    return F.when(F.col("archived"), "archived").when(F.col("fork"), "fork").when(F.col("empty"), "empty").when(stale, "stale").otherwise("keep")


def triage(repos: DataFrame, as_of: str, months: int = 24) -> DataFrame:
    return repos.select("key", suggestion(as_of, months).alias("suggestion"))


def unsupported(language: str = "language", supported: list[str] = SUPPORTED_LANGUAGES):
    """Whether a main language gives no code nodes; a repository without one is not flagged."""
    return F.coalesce(~F.col(language).isin(supported), F.lit(False))


def triage_groups(repos: DataFrame, as_of: str, by: str = "language", months: int = 24) -> DataFrame:
    """Repositories that triage keeps, by main language or by name prefix (before the first hyphen), with the number of unsupported ones."""
    keys = {"language": F.col("language"), "prefix": F.nullif(F.regexp_extract("name", "^([^-]+)-", 1), F.lit(""))}
    kept = repos.where(suggestion(as_of, months) == "keep")
    return kept.groupBy(F.coalesce(keys[by], F.lit("(none)")).alias("group")).agg(F.count("*").alias("n"), F.sum(unsupported().cast("int")).alias("unsupported"))


def adopt_existing(repos: DataFrame, projects: DataFrame) -> DataFrame:
    """Same url and branch: adopt; else same display name: conflict; else connect."""
    p = projects.select(norm_repo_url("url").alias("u"), "branch", F.col("project_id")).groupBy("u", "branch").agg(F.min("project_id").alias("adopted"))
    names = projects.select(F.lower("name").alias("ln")).distinct().withColumn("c", F.lit(1))
    rows = repos.withColumns({"u": norm_repo_url("url"), "ln": F.lower("name")}).join(p, ["u", "branch"], "left").join(names, "ln", "left")
    return rows.select("key", F.when(F.col("adopted").isNotNull(), "adopt").when(F.col("c").isNotNull(), "name-conflict").otherwise("connect").alias("action"), "adopted")


def extension(path: str = "path"):
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext == "", "(none)").otherwise(ext)


def tree_stats(files: DataFrame, kind: str, top: int) -> DataFrame:
    """(repo, value, n): the most frequent extensions or top-level folders, ties by name."""
    value = extension() if kind == "ext" else F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^([^/]*)/", 1)).otherwise("(root)")
    counts = files.groupBy("repo", value.alias("value")).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "value"))
    return counts.withColumn("r", r).where(F.col("r") <= top).drop("r")


def preview_ignores(files: DataFrame, patterns: list[str], supported=SUPPORTED_EXTENSIONS) -> DataFrame:
    """Per file: unsupported, built-in, the first own pattern that fits, or kept."""
    built_in = "|".join(f"(?:{gitignore_to_regex(p)})" for p in DEFAULT_IGNORES)
    own = F.coalesce(*[F.when(F.col("path").rlike(gitignore_to_regex(p)), p) for p in patterns]) if patterns else F.lit(None).cast("string")
    reason = F.when(~extension().isin(supported), "unsupported").when(F.col("path").rlike(built_in), "built-in").otherwise(F.coalesce(own, F.lit("kept")))
    return files.select("*", reason.alias("reason"))


def pattern_hits(previewed: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, n) for every own pattern; 0 for those that match no file."""
    table = previewed.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    n = previewed.where(F.col("reason").isin(patterns)).groupBy(F.col("reason").alias("pattern")).agg(F.count("*").alias("n"))
    return table.join(n, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


def status_of(stage: str = "stage", previous: str | None = None):
    kept = F.col(previous) if previous else F.lit("unknown")
    return F.when(F.col(stage) == "active", "indexed").when(F.col(stage) == "error", "error").when(F.col(stage).isin(IN_FLIGHT), "ingesting").otherwise(kept)


def latest_status(events: DataFrame) -> DataFrame:
    last = events.groupBy("repo_id").agg(F.max(F.struct("ts", "event_id", "stage")).alias("m"))
    return last.select("repo_id", "m.ts", "m.stage").withColumn("status", status_of())


def stalled(repos: DataFrame, now, minutes: int = 30) -> DataFrame:
    """Ingesting (repo_id, status, ts[, probed_at]) without progress for ``minutes``, and not probed within them."""
    old = lambda c: F.col(c) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")
    probed = old("probed_at") | F.col("probed_at").isNull() if "probed_at" in repos.columns else F.lit(True)
    return repos.where((F.col("status") == "ingesting") & old("ts") & probed)


def retry_candidates(repos: DataFrame, max_retries: int) -> DataFrame:
    return repos.where(F.col("status").isin("error", "stalled") & (F.col("attempts") < max_retries)).select("repo_id", "attempts")


def connect_candidates(repos: DataFrame, max_inflight: int) -> DataFrame:
    """The next discovered or planned repositories, as many as there is room for beside those in flight."""
    busy = repos.agg(F.sum((F.col("status") == "ingesting").cast("int")).alias("busy"))
    ranked = repos.where(F.col("status").isin("discovered", "planned")).orderBy("repo_id").limit(max_inflight).withColumn("r", F.row_number().over(Window.orderBy("repo_id")))  # max_inflight rows
    return ranked.join(F.broadcast(busy)).where(F.col("r") <= F.lit(max_inflight) - F.col("busy")).select("repo_id")


MEASURES = ("files", "functions", "classes", "loc")


def coverage_audit(indexed: DataFrame, disk: DataFrame) -> DataFrame:
    """Per repository files, functions, classes and lines on both sides and their differences. A side is (repo[, functions, classes, loc]), a row a file; what a side doesn't count is null."""

    def side(df: DataFrame, name: str) -> DataFrame:
        found = {"files": F.count("*")} | {m: F.sum(m) if m in df.columns else F.lit(None).cast("long") for m in MEASURES[1:]}
        return df.groupBy("repo").agg(*[c.alias(f"{m}_{name}") for m, c in found.items()])

    none = lambda df, m: m != "files" and m not in df.columns
    z = lambda m, name, df: F.lit(None).cast("long") if none(df, m) else F.coalesce(f"{m}_{name}", F.lit(0))
    both = side(indexed, "indexed").join(side(disk, "disk"), "repo", "full_outer")
    columns = [c for m in MEASURES for a, b in [(z(m, "indexed", indexed), z(m, "disk", disk))] for c in (a.alias(f"{m}_indexed"), b.alias(f"{m}_disk"), (a - b).alias(f"{m}_delta"))]
    return both.select("repo", *columns)


def unindexed_reasons(disk: DataFrame, indexed: DataFrame, supported=SUPPORTED_EXTENSIONS) -> DataFrame:
    """(repo, path, reason) of files on disk that aren't indexed: unsupported kind, left out by a built-in pattern, or missing."""
    built_in = "|".join(f"(?:{gitignore_to_regex(p)})" for p in DEFAULT_IGNORES)
    reason = F.when(~extension().isin(supported), "unsupported").when(F.col("path").rlike(built_in), "excluded").otherwise("missing")
    return only_in(disk, indexed).select("repo", "path", reason.alias("reason"))


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """(repo, path) of the left side alone: missing files, or ghosts."""
    return left.select("repo", "path").join(right.select("repo", "path"), ["repo", "path"], "left_anti")


def repos_behind(repos: DataFrame, heads: DataFrame) -> DataFrame:
    """(key, state) of repositories (key, commit) against branch heads (key, head): unreadable without a head, behind where the commits differ or none is indexed yet."""
    known = heads.groupBy("key").agg(F.max("head").alias("head"))
    rows = repos.join(known, "key", "left")
    return rows.select("key", F.when(F.col("head").isNull(), "unreadable").when(F.col("commit").eqNullSafe(F.col("head")), "current").otherwise("behind").alias("state"))
