"""Ignore patterns as a table (repo, position, pattern): the first one that fits each file, for thousands of patterns and any number of repositories.

The patterns of a repository are a trie of path segments: a file is matched by walking its segments once, whatever the number of patterns.
A pattern of one name holds at any depth unless it begins with a slash; ``*`` and ``?`` stay within a segment, ``**`` stands for any
number of them, and a pattern that ends with a slash wants a folder. What lies in a folder that fits, fits too. Negation is not
supported.

Files stay where they are. Patterns are sent to the tasks in blocks of at most ``BLOCK`` (whole repositories of a hash, checked by a
count); a worker builds a repository's trie when it meets its first file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import gitignore_to_regex
from ..functions.values import DEFAULT_IGNORES, SUPPORTED_EXTENSIONS
from .repos import extension

BLOCK = 200_000
_NEVER = 1 << 62
_kept: dict = {}


class _Node:
    __slots__ = ("names", "globs", "deep", "any", "folder")

    def __init__(self):
        self.names: dict[str, _Node] = {}
        self.globs: list[tuple[re.Pattern, _Node]] = []
        self.deep: _Node | None = None  # what follows a ``**``
        self.any = self.folder = _NEVER  # the first pattern that ends here, and the first that ends here and wants a folder

    def child(self, name: str, globs: dict) -> _Node:
        if name == "**":
            self.deep = self.deep or _Node()
            return self.deep
        if not re.search(r"[*?]", name):
            return self.names.setdefault(name, _Node())
        key = (id(self), name)
        if key not in globs:
            pattern = re.sub(r"[*?]|[^*?]+", lambda m: {"*": "[^/]*", "?": "[^/]"}.get(m[0]) or re.escape(m[0]), name)
            globs[key] = _Node()
            self.globs.append((re.compile(pattern + r"\Z"), globs[key]))
        return globs[key]


class Trie:
    """The patterns of one repository."""

    def __init__(self, patterns: Iterable[tuple[int, str]]):
        self.rooted, self.loose = _Node(), _Node()
        globs: dict = {}
        for position, pattern in patterns:
            names = pattern.strip("/").split("/")
            if names == [""]:
                continue
            node = self.loose if len(names) == 1 and not pattern.startswith("/") else self.rooted
            for name in names[:-1]:
                node = node.child(name, globs)
            if names[-1] == "**":  # all below: any one segment, and what lies in it
                node = node.child("*", globs)
            else:
                node = node.child(names[-1], globs)
            if pattern.endswith("/"):
                node.folder = min(node.folder, position)
            else:
                node.any = min(node.any, position)

    def first(self, path: str) -> int:
        """The lowest position of a pattern that fits, or ``_NEVER``."""
        segments, best = path.split("/"), _NEVER
        active = self._reached([self.rooted])
        for at, segment in enumerate(segments):
            inner = at + 1 < len(segments)
            following = []
            for node in [*active, *self._reached([self.loose])]:
                here = [node.names[segment]] if segment in node.names else []
                here += [n for pattern, n in node.globs if pattern.match(segment)]
                for n in here:
                    best = min(best, n.any, n.folder if inner else _NEVER)
                following += here
            # What stands for any number of segments stays.
            active = self._reached(following) + [n for n in active if n in self._deeps]
            if not active and not inner:
                break
        return best

    @property
    def _deeps(self) -> set:
        if not hasattr(self, "_found"):
            self._found, stack = set(), [self.rooted, self.loose]
            while stack:
                node = stack.pop()
                below = [*node.names.values(), *(n for _, n in node.globs), *([node.deep] if node.deep else [])]
                if node.deep:
                    self._found.add(node.deep)
                stack += below
        return self._found

    @staticmethod
    def _reached(nodes: list[_Node]) -> list[_Node]:
        """The nodes and those that a ``**`` for no segment leads to."""
        out = []
        for node in nodes:
            while node is not None:
                out.append(node)
                node = node.deep
        return out


def first_patterns(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """``files`` (repo, path, …) with ``position`` and ``pattern``: the first one of its repository that fits, null where none does."""
    table = patterns.select("repo", F.col("position").cast("long").alias("position"), "pattern").where("repo IS NOT NULL AND pattern IS NOT NULL AND position IS NOT NULL").distinct()
    count = table.count()
    blocks = max(1, -(-count // BLOCK))
    part = lambda df, k: df if blocks == 1 else df.where(F.coalesce(F.pmod(F.xxhash64("repo"), F.lit(blocks)), F.lit(0)) == k)
    out = None
    for k in range(blocks):
        own: dict = {}
        for r in part(table, k).collect():  # a block
            own.setdefault(r.repo, []).append((r.position, r.pattern))
        found = _matched(part(files, k), own)
        out = found if out is None else out.union(found)
    return out


def _matched(files: DataFrame, patterns: dict) -> DataFrame:
    shared, key = files.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex
    schema = T.StructType([*files.schema.fields, T.StructField("position", T.LongType()), T.StructField("pattern", T.StringType())])
    repo_at, path_at = files.columns.index("repo"), files.columns.index("path")

    def trie(repo):
        if _kept.get("key") != key:
            _kept.clear()
            _kept["key"] = key
        if repo not in _kept:
            own = shared.value.get(repo, [])
            _kept[repo] = (Trie(own), dict(sorted(own, reverse=True))) if own else None
        return _kept[repo]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions, names = [], []
            for repo, path in zip(batch.column(repo_at).to_pylist(), batch.column(path_at).to_pylist()):
                known = trie(repo) if repo is not None and path is not None else None
                at = known[0].first(path) if known else _NEVER
                positions.append(at if at != _NEVER else None)
                names.append(known[1][at] if at != _NEVER else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(positions, pa.int64()), pa.array(names, pa.string())], [*batch.schema.names, "position", "pattern"])

    return files.mapInArrow(run, schema)


def preview_by_repo(files: DataFrame, patterns: DataFrame, supported=SUPPORTED_EXTENSIONS) -> DataFrame:
    """``files`` with ``reason`` (unsupported, built-in, own or kept) and, for own, ``position`` and ``pattern``."""
    built_in = "|".join(f"(?:{gitignore_to_regex(p)})" for p in DEFAULT_IGNORES)
    early = F.when(~extension().isin(supported), "unsupported").when(F.col("path").rlike(built_in), "built-in")
    found = first_patterns(files.withColumn("early", early), patterns)
    reason = F.coalesce("early", F.when(F.col("position").isNotNull(), "own").otherwise("kept"))
    own = lambda c: F.when(F.col("early").isNull(), F.col(c)).alias(c)
    return found.select(*files.columns, reason.alias("reason"), own("position"), own("pattern"))


def hits_by_repo(previewed: DataFrame, patterns: DataFrame) -> DataFrame:
    """(repo, position, pattern, n): files that each pattern leaves out; 0 for those that match nothing that an earlier one does not."""
    n = previewed.where("position IS NOT NULL").groupBy("repo", "position").agg(F.count("*").alias("n"))
    return patterns.select("repo", F.col("position").cast("long").alias("position"), "pattern").join(n, ["repo", "position"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
