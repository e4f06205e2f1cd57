"""Search, impact and call-graph joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import find
from ..functions.scale import broadcast_if_small, cut, tasks_for


def keyword_sweep(nodes: DataFrame, nouns: list[str], max_total: int = 60) -> tuple[DataFrame, DataFrame]:
    """Totals of (id, text) by noun (case-insensitive substring), and the hits of nouns that are not too common."""
    hits = nodes.select("id", F.explode(F.filter(F.array(*map(F.lit, nouns)), lambda n: F.lower("text").contains(F.lower(n)))).alias("noun"))
    totals = hits.groupBy("noun").agg(F.count("*").alias("total")).withColumn("too_common", F.col("total") > max_total)
    return totals, hits.join(F.broadcast(totals.where(~F.col("too_common")).select("noun")), "noun")  # a row a noun


def variants(term: str) -> list[str]:
    """A camel-case term and its snake and kebab forms."""
    import re

    words = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", term).lower().split()
    return sorted({term.lower(), "_".join(words), "-".join(words), "".join(words)})


def reference_sweep(parts: list[DataFrame], term: str) -> DataFrame:
    """Files of (file, text) rows of any kind that hold the term or a variant."""
    pattern = "|".join(rf"\Q{v}\E" for v in variants(term))
    out = None
    for p in parts:
        found = p.where(F.lower("text").rlike(pattern)).select("file")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


#: Queries that are sent to the tasks at once, and nodes that meet them at once.
QUERY_BLOCK, NODE_BLOCK = 4_096, 8_192


def semantic_top_k(queries: DataFrame, nodes: DataFrame, k: int, min_score: float = -1.0) -> DataFrame:
    """(query_id, id, score): the k nearest nodes by cosine, ties by id, for any number of queries.

    Nodes stay where they are. Queries go to the tasks in blocks of about ``QUERY_BLOCK`` (by a hash of their ids, a bounded broadcast), and a
    task keeps k nodes a query of all that it reads, so that only those are shuffled and compared. Vectors without an embedding are left out.
    """
    asked, held = (df.select(name, "embedding").where("embedding IS NOT NULL") for df, name in ((queries, "query_id"), (nodes, "id")))
    blocks, out = max(1, -(-asked.count() // QUERY_BLOCK)), None
    for block in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        found = _nearest(sorted((r.query_id, r.embedding) for r in some.collect()), held, k, min_score)
        out = found if out is None else out.union(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _nearest(asked: list[tuple], nodes: DataFrame, k: int, min_score: float) -> DataFrame:
    unit = lambda v: (m := np.stack(list(v)).astype(float)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    shared = nodes.sparkSession.sparkContext.broadcast((np.array([i for i, _ in asked], np.int64), unit([v for _, v in asked]) if asked else None))

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, vectors = shared.value
        best_ids, best = np.zeros((len(keys), 0), np.int64), np.zeros((len(keys), 0))
        for table in tables:
            for at in range(0, len(table) if len(keys) else 0, NODE_BLOCK):
                part = table.iloc[at : at + NODE_BLOCK].sort_values("id")
                ids, matrix = part["id"].to_numpy(np.int64), unit(part["embedding"]).T
                kept_ids, kept = [], []
                for q in range(0, len(keys), 256):
                    scores = np.concatenate([best[q : q + 256], vectors[q : q + 256] @ matrix], 1)
                    names = np.concatenate([best_ids[q : q + 256], np.broadcast_to(ids, (len(scores), len(ids)))], 1)
                    order = np.lexsort((names, -scores))[:, :k]
                    kept_ids.append(np.take_along_axis(names, order, 1))
                    kept.append(np.take_along_axis(scores, order, 1))
                best_ids, best = np.concatenate(kept_ids), np.concatenate(kept)
        found = pd.DataFrame({"query_id": np.repeat(keys, best.shape[1]), "id": best_ids.ravel(), "score": best.ravel()})
        yield found[found["score"] >= min_score]

    return nodes.mapInPandas(run, "query_id long, id long, score double")


def best_hit_per_path(hits: DataFrame, min_score: float = 0.25) -> DataFrame:
    return hits.where((F.col("score") >= min_score) & F.col("path").isNotNull()).groupBy("query_id", "path").agg(F.max(F.struct("score", "id")).alias("m")).select("query_id", "path", "m.score", "m.id")


def expand_touched_scenarios(touched: DataFrame, scenario: DataFrame) -> DataFrame:
    """All scenarios of the outcomes of the touched ones."""
    outcomes = touched.select("scenario_id").distinct().join(scenario.select("scenario_id", "outcome_id"), "scenario_id").select("outcome_id").distinct()
    return scenario.join(outcomes, "outcome_id", "left_semi").select("scenario_id", "outcome_id")


def covering_nodes(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes with a link (child, parent) to any of the ids (column id)."""
    return links.join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id")).distinct()


def neighbours(calls: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` of the seeds along (source, target), with their distance."""
    seen = seeds.select("id").distinct().withColumn("distance", F.lit(0))
    frontier = seen
    links = calls.select("source", "target").distinct()
    for d in range(1, hops + 1):
        frontier = links.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(d))
        seen = seen.union(frontier)
    return seen


def file_fan_in(imports: DataFrame) -> DataFrame:
    return imports.groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("imported_by"))


def anchor(code_hits: DataFrame, arch: DataFrame) -> DataFrame:
    return code_hits.select("code_ontology_id").distinct().join(arch, "code_ontology_id")


def supporting_hop(services: DataFrame, links: DataFrame, nodes: DataFrame, layers: list[str]) -> DataFrame:
    """Nodes of the supporting layers one hop from the touched services."""
    out = links.join(services.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
    return nodes.where(F.col("layer").isin(layers)).join(out, "id", "left_semi").select("id", "layer")


def focus_tables(tables: DataFrame, columns: DataFrame, nouns: list[str]) -> DataFrame:
    """Tables by hits of nouns in their name or in their columns' names."""
    any_of = lambda c: F.size(F.filter(F.array(*map(F.lit, nouns)), lambda n: F.lower(c).contains(n)))
    hits = tables.select("table_id", any_of("name").alias("h")).union(columns.select("table_id", any_of("name").alias("h")))
    return hits.groupBy("table_id").agg(F.sum("h").alias("hits")).where("hits > 0")


def schema_dependents(table: str, fks: DataFrame, bodies: DataFrame) -> DataFrame:
    """Tables that refer to the table, and views and procedures (id, kind, body) that name it as a word."""
    refs = fks.where(F.col("ref_table") == table).select(F.lit("foreign_key").alias("kind"), F.col("table_id").alias("id"))
    return refs.union(bodies.where(F.col("body").rlike(rf"(?i)\b\Q{table}\E\b")).select("kind", "id"))


def all_schema_dependents(tables: DataFrame, fks: DataFrame, bodies: DataFrame) -> DataFrame:
    """(table, kind, id) for every one of ``tables`` (column table): tables that refer to it, and views and procedures whose body names it as a word, in any case. One pass over the bodies for all names."""
    names = tables.where("table <> ''").select(F.lower("table").alias("table")).distinct()
    refs = fks.select(F.lower("ref_table").alias("table"), F.lit("foreign_key").alias("kind"), F.col("table_id").alias("id")).join(names, "table", "left_semi").select("table", "kind", "id")
    texts = bodies.select("kind", "id", F.lower("body").alias("text"))
    return refs.union(find.hits(texts, names, term="table", words=True).select("table", "kind", "id"))


def all_references(parts: list[DataFrame], terms: DataFrame) -> DataFrame:
    """(term, file) for every one of ``terms`` (column term): files of (file, text) rows of any kind that hold it, or its snake or kebab form, as a word.

    Forms go to what is found, so that a frequent form's files stay where they are; pairs are dealt to as many tasks as their number asks for.
    """
    forms = F.array_distinct(F.array(F.lower("term"), *[F.lower(F.regexp_replace("term", "([a-z0-9])([A-Z])", f"$1{sign}$2")) for sign in ("_", "-")]))
    named = terms.where("term <> ''").select("term", F.explode(forms).alias("form")).distinct()
    out = None
    for p in parts:
        found = find.hits(p.select("file", F.lower("text").alias("text")), named.select("form"), term="form", words=True)
        out = found if out is None else out.unionByName(found)
    pairs = cut(out.join(broadcast_if_small(cut(named)), "form").select("term", "file"))
    return pairs.repartition(tasks_for(pairs), "term", "file").distinct()


def classify_stores(stores: DataFrame) -> DataFrame:
    """(store, read_only, needs_ddl, hits, score_min, score_max) to a tier; weak hits are skipped."""
    weak = (F.col("hits") < 3) & (F.col("score_min") >= 0.40) & (F.col("score_max") <= 0.45)
    tier = F.when(F.col("read_only") & F.col("needs_ddl"), "blocking").when(F.col("needs_ddl"), "writable").otherwise("confirmed")
    return stores.where(~weak).select("store", tier.alias("tier"))


def store_verdict(tiers: DataFrame) -> DataFrame:
    rank = F.max(F.when(F.col("tier") == "blocking", 2).when(F.col("tier") == "writable", 1).otherwise(0))
    return tiers.agg(F.element_at(F.array(F.lit("NO DDL"), F.lit("WORK"), F.lit("BLOCKING")), F.coalesce(rank, F.lit(0)) + 1).alias("verdict"))


def nodes_citing_files(changed: DataFrame, citations: DataFrame) -> DataFrame:
    """(node_id, reference): nodes that cite a changed path, and whether all their citations are among them."""
    rows = citations.distinct().join(changed.select(F.col("path").alias("reference"), F.lit(1).alias("c")).distinct(), "reference", "left")
    return rows.groupBy("node_id").agg(F.count("*").alias("citations"), F.count("c").alias("changed")).where("changed > 0").withColumn("all_gone", F.col("citations") == F.col("changed"))
